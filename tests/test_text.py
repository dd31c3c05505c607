"""Cleaning, morphology, vocabulary, translation, phrases and passages on golden rows."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import stem, textclean, translate, vocabulary
from docloom.operators import curation, phrases, segments


def _one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [("art. 10, S.T.F. é", "art um zero stf e"), ("ver https://a.com.br/x ou b@c.com", "ver ou"), ("aguas_vivas", "aguas vivas"), ("a<br>b\nc", "a b c"), ("", ""), ("ﬁnal º ½ ß", "final o um dois"), ("x " * 50_000, "x " * 49_999 + "x")],
)
def test_quick_text(spark, text, expected):
    assert " ".join(_one(spark, textclean.quick_tokens, text)) == expected


def test_null_texts_stay_null(spark):
    assert _one(spark, textclean.quick_text, None) is None
    assert _one(spark, textclean.preview, None) is None


def test_preview_and_padding(spark):
    assert _one(spark, textclean.preview, "a" * 251) == "a" * 250 + " [..]"
    assert _one(spark, lambda c: textclean.pad(c, 5), "abcdefg") == "abcdefg"
    assert _one(spark, lambda c: textclean.pad(c, 5), "ab") == "ab   "


SINGULAR = {
    "processos": "processo", "acoes": "acao", "tribunais": "tribunal", "papeis": "papel", "lencois": "lencol", "juizes": "juiz", "homens": "homem", "flores": "flor", "civis": "civil", "dois": "dois",
    "processos_penais": "processo_penal", "a": "a", "s": "s", "_": "_", "casas__": "casa",
}


def test_singular(spark):
    df = spark.createDataFrame([(t,) for t in [*SINGULAR, None]], "t string").select("t", vocabulary.singular(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == {**SINGULAR, None: None}


@pytest.mark.parametrize("word, expected", [("engloba", "englob"), ("processos", "process"), ("boa", "boa"), ("boas", "boas"), ("boiavam", "boi"), ("quilométricas", "quilométr"), ("quiserem", "quis"), ("", ""), ("a", "a"), ("felicidade", "felic"), ("rapidamente", "rapid")])
def test_stems(word, expected):
    assert stem.stem(word) == expected


def test_resolution_with_fragments(spark):
    terms = spark.createDataFrame([(t,) for t in ("processo", "englob", "a", "atend", "lei")], "term string")
    tokens = spark.createDataFrame([(t, "k") for t in ("processos", "engloba", "atendo", "lei", "xyz", "x", "a_b", None, "", "lei")], "token string, pecas string")
    got = {r["token"]: (r["pecas"], r["tipo"]) for r in vocabulary.resolution(tokens, terms).collect()}
    assert got == {"processos": (["processo"], "singular"), "engloba": (["englob", "#a"], "fragmento"), "atendo": (["atend", "#OOV"], "fragmento"), "lei": (["lei"], "termo"), "xyz": ([], "fora"), "x": ([], "fora"), "a_b": ([], "fora")}
    assert {r["token"]: r["pecas"] for r in vocabulary.resolution(tokens, terms, accept_all=True).collect()}["xyz"] == ["xyz"]
    assert vocabulary.resolution(tokens.limit(0), terms).count() == 0


def test_tokenize(spark):
    docs = spark.createDataFrame([(1, "Dano moral: 2 processos!", "k"), (1, "Dano moral: 2 processos!", "k"), (2, "", "k"), (3, None, "k"), (4, "moral removido", "k")], "doc_id int, text string, tokens string")
    rules = tuple(translate.parse_rules(["dano moral => dano_moral"]))
    vocab = vocabulary.Vocabulary(frozenset({"processo", "dois", "dano_moral", "moral"}), frozenset({"removido"}), rules)
    got = sorted((r["doc_id"], r["tokens"]) for r in vocabulary.tokenize(docs, vocab).collect())
    assert got == [(1, ["dano_moral", "dois", "processo"]), (1, ["dano_moral", "dois", "processo"]), (2, ["."]), (4, ["moral"])]


def test_removed_plurals_and_algebra(spark):
    frame = lambda *terms: spark.createDataFrame([(t,) for t in terms], "term string")
    final = {r["term"] for r in vocabulary.final_terms(frame("casa", "casas", "lei", ""), frame("dano_moral"), frame("casa")).collect()}
    assert final == {"lei", "dano_moral", *textclean.DIGIT_WORDS}


SENTENCE = "APELAÇÃO CÍVEL DE DANOS CAUSADOS AO ERÁRIO de de x"
WORDS = {"cível": "(cível)", "danos": "(danos)", "ERÁRIO": "(ERÁRIO)", "de": ""}


def test_translation_variants(spark):
    assert _one(spark, lambda c: translate.replace_words(c, WORDS), SENTENCE) == "APELAÇÃO (cível)  (danos) CAUSADOS AO (ERÁRIO)   x"
    assert _one(spark, lambda c: translate.replace_words(c, WORDS, False), SENTENCE) == "APELAÇÃO CÍVEL DE DANOS CAUSADOS AO (ERÁRIO)   x"
    for extra in (0, 60):
        rules = [("de", ""), ("ERÁRIO", "(ERÁRIO)")] + [(f"nada{i}", "x") for i in range(extra)]
        assert _one(spark, lambda c, rules=rules: translate.translate_terms(c, rules), "de de x") == "de x"
        assert _one(spark, lambda c, rules=rules: translate.translate_terms(c, rules), SENTENCE).startswith("APELAÇÃO CÍVEL DE DANOS CAUSADOS AO (ERÁRIO)")
        assert _one(spark, lambda c, rules=rules: translate.translate_terms(c, rules), None) is None


def test_rules_are_parsed():
    assert translate.parse_rules(["a b => c d", "a b => e", "  ", "xyz", "10 => dez =>"]) == [("um zero", "dez"), ("a b", "c_d"), ("xyz", "")]


def test_strange_terms(spark):
    expected = {"bbba": "S", "casa": "N", "xptz": "S", "aaa": "S", "_a": "S", "carro": "N", "aeio": "S", "nnn": "S"}
    df = spark.createDataFrame([(t,) for t in expected], "t string").select("t", curation.strange(F.col("t")).alias("e"))
    assert {r["t"]: r["e"] for r in df.collect()} == expected


def test_boxplot_positions(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10, 0)], "v double")
    got = {r["v"]: r["v_bp"] for r in curation.with_boxplots(df, ("v",)).collect()}
    b = curation.BOXPLOT
    assert got == {1.0: b[1], 2.0: b[2], 3.0: b[3], 4.0: b[5], 10.0: b[6], 0.0: ""}
    zeros = spark.createDataFrame([(0.0,)], "v double")
    assert curation.with_boxplots(zeros, ("v",)).first()["v_bp"] == ""


def test_sheet_of_a_small_corpus(spark):
    tokens = spark.createDataFrame([(1, "lei"), (1, "lei"), (1, "casa"), (2, "lei"), (2, "aaab"), (2, None), (2, "")], "doc_id int, token string")
    base = spark.createDataFrame([("casa",), ("rua",)], "term string")
    removed = spark.createDataFrame([("aaab",)], "term string")
    rows = {r["termo"]: r for r in curation.curation_sheet(tokens, base, removed).collect()}
    assert set(rows) == {"lei", "casa", "aaab", "rua"}
    assert (rows["lei"]["qtd"], rows["lei"]["qtd_docs"], rows["lei"]["tfidf"]) == (3, 2, 0.0)
    assert (rows["casa"]["vocab"], rows["aaab"]["vocab"], rows["rua"]["qtd"], rows["aaab"]["estranho"]) == ("TERMO", "REMOVIDO", 0, "N")
    assert rows["casa"]["tfidf"] == 1.0
    assert curation.core_sheet(tokens.limit(0)).count() == 0


def test_stop_splitting(spark):
    df = spark.createDataFrame([(["t1", "t2", "stop", "t3", "t4"],), (["t1", "stop", "t2"],), ([],)], "tokens array<string>")
    got = [r["r"] for r in df.select(phrases.split_at_stops(F.col("tokens"), ["stop"]).alias("r")).collect()]
    assert got == [[["t1", "t2"], ["t3", "t4"]], [], []]
    kept = [r["r"] for r in df.select(phrases.split_at_stops(F.col("tokens"), ["stop"], True).alias("r")).collect()]
    assert kept[1] == [["t1", "t2"]]
    assert sorted(r["tokens"] for r in phrases.pieces(df, ["stop"]).collect()) == [["t1", "t2"], ["t3", "t4"]]


def test_phrases_are_applied_greedily(spark):
    df = spark.createDataFrame([("conforme agravo de instrumento apreciado pelo primeiro grau".split(),), (None,)], "t array<string>")
    pairs = [("agravo", "de"), ("agravo_de", "instrumento"), ("primeiro", "grau"), ("de", "instrumento")]
    got = [r["r"] for r in df.select(phrases.transform_tokens(F.col("t"), pairs, pairs).alias("r")).collect()]
    assert got == ["conforme agravo_de_instrumento apreciado pelo primeiro_grau".split(), None]


def test_edges_and_suggestions(spark):
    df = spark.createDataFrame([("codigo", "de_defesa"), ("de", "defesa"), ("defesa", "de")], "w1 string, w2 string")
    got = {r["para"]: r["aceito"] for r in phrases.suggestions(df, ["meu termo", "# nota"], ["de_defesa"]).collect()}
    assert got == {"codigo_de_defesa": True, "defesa_de": False, "meu_termo": True}


def test_passages(spark):
    text = "(art. 5º, LXI, da CF) vale sempre aqui neste caso. Conforme art.\n105 da CF\nde 1988 tudo segue valendo ainda. Houve valor 1.234 pago inteiro agora? Sim houve pagamento inteiro agora mesmo! Fim."
    docs = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, text, "k")], "doc_id int, text string, sentenca string")
    found = segments.passages(docs)
    import unicodedata

    got = [unicodedata.normalize("NFC", r["sentenca"]) for r in found.where("doc_id = 1").orderBy("sent_no").collect()]
    # The blank after the abbreviation's point stays beside the one of the joint.
    assert got[0] == "(art.  5º, LXI, da CF) vale sempre aqui neste caso."
    assert got[1] == "Conforme art. 105 da CF de 1988 tudo segue valendo ainda."
    assert got[2].startswith("Houve valor 1234 pago") and got[2].endswith("?")
    # The last piece has too few words and is dropped.
    assert got[3:] == ["Sim houve pagamento inteiro agora mesmo!"]
    once = segments.numbered(segments.first_occurrences(found)).orderBy("sent_id").collect()
    assert [(r["sent_id"], r["doc_id"], r["vezes"]) for r in once] == [(i + 1, 1, 2) for i in range(len(got))]
    assert tuple(segments.deduplication_counts(found).first()) == (len(got), len(got))
    assert segments.first_occurrences(found, found.select("sentenca").limit(1)).count() == len(got) - 1
    assert segments.passages(docs.limit(0)).count() == 0


def test_tokens_in_the_row_and_joined_are_the_same(spark):
    """The route for large vocabularies gives the rows of the usual one; removed terms, fragments and nulls included."""
    terms = frozenset("processo pens mento casa porta".split())
    vocab = vocabulary.Vocabulary(terms, frozenset(["verde"]), (("porta azul", "porta_azul"),))
    rows = [(1, "Os processos e a casa verde: pensamento"), (2, "porta azul porta"), (3, ""), (4, None), (5, "casa " * 500), (1, "Xyz"), (None, "casas")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    key = lambda r: (r["doc_id"] or 0, r["tokens"])
    both = [sorted(map(key, vocabulary.tokenize(df, vocab, broadcast_tokens=n).collect())) for n in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) == 6 and (0, ["casa"]) in both[0] and (3, ["."]) in both[0]


def test_many_rules_are_applied_like_few(spark):
    """Above the bound of nested rules an index of words finds them; the order and what rules make of others count alike."""
    import random

    from docloom.functions import translate

    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e"]
    rules = list({" ".join(rng.choices(words, k=rng.randint(1, 3))): "_".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(90)}.items())
    assert len(rules) > translate.NESTED_RULES
    texts = [" ".join(rng.choices([*words, ""], k=rng.randint(0, 12))) for _ in range(60)] + [None]

    def one(text):
        text = f" {text} "
        for a, b in sorted(rules, key=lambda r: len(r[0]), reverse=True):
            text = text.replace(f" {a} ", f" {b} ")
        return text.strip(" ")

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(translate.translate_terms(F.col("t"), rules).alias("x")).collect()]
    assert got == [None if t is None else one(t) for t in texts]


def test_all_of_unicode_folds(spark):
    import unicodedata

    text = "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000))) if unicodedata.decomposition(c))
    df = spark.createDataFrame([(text,), ("ﬁm № 5 ½ Ⓐ 𝐀ção",), ("plain",), (None,)], "t string")
    got = [r["x"] for r in df.select(textclean.remove_accents(F.col("t")).alias("x")).collect()]
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    assert got == [fold(text), fold("ﬁm № 5 ½ Ⓐ 𝐀ção"), "plain", None]


def test_word_rules_query_over_own_table(spark, tmp_path):
    """The query reads its texts once, and rules neither chain nor match within words."""
    from docloom.plans import queries

    texts = [(1, "Recurso no processo por dano moral"), (2, "danos e dano"), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["texto"] for r in queries.word_rules(spark, str(tmp_path)).collect()}
    assert got == {1: "processo NO recurso POR dano_moral", 2: "DANOS E prejuízo", 4: ""}
