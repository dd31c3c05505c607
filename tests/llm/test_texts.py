"""Problems 5, 7, 8, 9 and 10 on small texts."""

import base64
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, encodings, mixing, personal, sentences, surrogates

needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, f"{bpe.VOCABULARY}.tiktoken")), reason="no vocabulary files")


# Problem 5

GOOD = ["A decisão não é pública.", "O juízo já apreciou a petição.", "Não há razões, à vista disso.", "A AÇÃO FOI À SEÇÃO."] * 4


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, texto string, palavra string")


def test_wrong_decodings_are_found_and_restored(spark):
    bad = {
        100: "A decisão não é pública.".encode().decode("latin-1"), 101: "O juízo já apreciou a petição.".encode().decode("cp850"), 102: "A decisão não é pública.".encode("cp1252").decode("cp850"),
        103: "Não há razões".encode("cp1252").decode("cp1251"), 104: "O ju�zo j� apreciou", 105: "A decisão. " + "Não há".encode().decode("latin-1"),
        106: "decisão".encode().decode("cp1252").encode().decode("cp1252"),
    }
    fine = {200: "A alínea Ã da tabela Â® vale ©.", 201: "", 202: None, 203: "Maßnahme für Gebühren", 204: "“força maior” – € 1,00…", 205: "Sąd oddalił", 206: "plain"}
    rows = [(i, t, "x") for i, t in enumerate(GOOD)] + [(i, t, "x") for i, t in {**bad, **fine}.items()] + [(100, bad[100], "x")]
    df = _texts(spark, rows)
    assert {r["doc_id"] for r in encodings.affected(df).collect()} == set(bad)
    out = {r["doc_id"]: r["restaurado"] for r in encodings.restored(df).collect()}
    assert out[100] == out[102] == "A decisão não é pública."
    assert out[101] == "O juízo já apreciou a petição."
    assert out[103] == "Não há razões"
    assert out[104] == "O juízo já apreciou"
    assert out[105] == "A decisão. Não há"
    assert out[106] == "decisão"


def test_copies_of_a_garbled_text_do_not_hide_it(spark):
    """The garbled text fills most rows, as copies and repeated rows; its right words are in few texts."""
    single, several = "A decisão não é pública.".encode("cp1252").decode("cp850"), "A audiência já terminou".encode().decode("cp1252")
    rows = [(i, t, "x") for i, t in enumerate(GOOD[:4] + ["Não cabe decisão.", "A decisão é pública.", "Não é pública a decisão.", "A audiência foi já."])]
    rows += [(100 + i, single, "x") for i in range(20)] + [(200 + i, several, "x") for i in range(20)] + [(100, single, "x")] * 5
    # Many texts of their own with the same garbled word.
    rows += [(300 + i, f"Ata {i}: audiência".encode().decode("cp1252"), "x") for i in range(20)]
    df = _texts(spark, rows)
    out = {r["doc_id"]: r["restaurado"] for r in encodings.restored(df).collect()}
    assert set(out) == {*range(100, 120), *range(200, 220), *range(300, 320)} == {r["doc_id"] for r in encodings.affected(df).collect()}
    assert out[100] == "A decisão não é pública." and out[200] == "A audiência já terminou" and out[307] == "Ata 7: audiência"


def test_texts_that_fit_one_pair_need_no_frequency(spark):
    """Most texts are garbled the same way, so the garbled words are more frequent than the right ones."""
    plain = "A petição {0} não foi à seção: audiência já marcada."
    rows = [(i, plain.format(i), "x") for i in range(2)] + [(100 + i, plain.format(i).encode("cp1252").decode("cp850"), "x") for i in range(20)]
    rows += [(200, "Größe von iPhone-Öffnungen", "x"), (201, "Sąd oddalił skargę.", "x")]
    out = {r["doc_id"]: r["restaurado"] for r in encodings.restored(_texts(spark, rows)).collect()}
    assert set(out) == set(range(100, 120))
    assert out[105] == plain.format(5)


def test_no_texts_to_restore(spark):
    assert encodings.affected(_texts(spark, [])).count() == 0
    assert encodings.restored(_texts(spark, [])).count() == 0


# Problem 7


def _split(text):
    return [text[a:b] for a, b in next(iter(sentences.boundaries([text])))]


@pytest.mark.parametrize(
    "parts",
    [
        ["O v. acórdão da E. Câmara (rel. Ana Lima) foi mantido.", "Nego provimento."],
        ["“Nada a declarar.”", "O credor pagou R$ 1.250,50 em 3.4.2018.", "8. O autor reside aqui."],
        ['A testemunha disse: "Não vi. Só ouvi.", e calou.', "Houve prescrição?", "Qual foi, então, o termo inicial?!", "Fim."],
        ["Os autos vieram conclusos... mas sem o parecer do Min. Público.", "J. P. Lima compareceu às 14.30 h.", "A executada é a Aurivela Com. e Ind. Ltda.", "(Ausente o vogal.)", "Foram penhorados os móveis etc.", "Sim."],
        ["Trata-se de: a) cobrança; b) multa.", "Fundamento no art. 5, inc. II, do regimento.", "Consulte-se www.x.example/b?id=1.", "Ok."],
        ["Mr. Lima v. Aurivela Inc. was decided on Jan. 5 by the panel.", "See No. 4, p. 6, n. 4.", "Dr. Lima, Ph.D., testified for the U.S. agency.", 'He said, "I left at 3 p.m. Nobody saw me." and sat down.'],
        ["Nach § 4 Abs. 2 Nr. 3 ist die Klage unzulässig.", "Er zahlte am 3. Mai 2018 viel.", "„Ich war dort. Allein.“, sagte er.", "Dr. Lima wohnt z. B. hier."],
        ["« Je n’ai rien vu. Rien. », a dit Mme Lima.", "Qui a signé ?", "L’art. 4 s’applique.", "M. Lima a versé."],
        ["Истец внёс 5 руб. в кассу.", "См. ст. 6, п. 1 регламента.", "«Нет. Нет.», и замолчал.", "Истёк срок?"],
    ],
)
def test_sentences(parts):
    for joint in (" ", "  ", "\n", " "):
        assert _split(joint.join(parts)) == parts
    assert _split(f"  {parts[0]}\n \n{parts[1]}\r\n\r\nTÍTULO\n\n") == [parts[0], parts[1], "TÍTULO"]


@pytest.mark.parametrize("parts", [["「見ていない。知らない。」と述べた。", "棄却する。", "成立したか？"], ["“我没有看到。我不知道。”证人说。", "驳回上诉。", "证据不足！"]])
def test_scripts_without_spaces(parts):
    assert _split("".join(parts)) == parts


def test_other_scripts():
    assert _split("ศาลยกฟ้อง จำเลยไม่ชำระ ปี2561 จบ") == ["ศาลยกฟ้อง", "จำเลยไม่ชำระ", "ปี2561", "จบ"]
    assert _split("डॉ. वर्मा आए। अपील खारिज है।") == ["डॉ. वर्मा आए।", "अपील खारिज है।"]
    assert _split("Έληξε; Ναι.") == ["Έληξε;", "Ναι."]
    assert _split('그는 "몰라. 몰라."라고 말했다. 끝.') == ['그는 "몰라. 몰라."라고 말했다.', "끝."]
    assert _split("هل انقضت؟ نعم.") == ["هل انقضت؟", "نعم."]


def test_blocks_compose_as_one_run():
    rng = random.Random(5)
    machine = sentences._TRANSDUCER
    import numpy as np

    symbols = np.array([rng.randrange(machine.next.shape[1]) for _ in range(5000)], np.uint8)
    state, expected = 0, []
    for s in symbols:
        expected.append(bool(machine.out[state, s]))
        state = machine.next[state, s]
    for block in (7, 512, 6000):
        assert machine.run(symbols, block).tolist() == expected


def test_sentence_table(spark):
    long = "Uma frase curta. " * 20_000
    df = spark.createDataFrame([(1, "Um. Dois.", "k"), (1, "Um. Dois.", "k"), (2, None, "k"), (3, " \n ", "k"), (4, "", "k"), (5, long, "k")], "doc_id bigint, texto string, frase string")
    rows = sentences.sentences(df).collect()
    assert sorted((r["doc_id"], r["ordem"], r["inicio"], r["fim"], r["frase"]) for r in rows if r["doc_id"] == 1) == [(1, 1, 0, 3, "Um."), (1, 2, 4, 9, "Dois.")]
    assert sum(r["doc_id"] == 5 for r in rows) == 20_000
    assert {r["doc_id"] for r in rows} == {1, 5}


# Problem 8


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(os.path.join(bpe.TOKENIZERS, f"{bpe.VOCABULARY}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _awkward(rng, n):
    bits = [" ", "  ", "\n", "\t", "s", "'s", "'re", "'", "ll", "don't", "ação", "12", "½", "２", "!?", "…", " ", "　", "日本", "👩‍⚖️", "é", "<|endoftext|>", "\x00", "\x85", "\r\n", "jurisdicionalmente"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


@needs_vocabulary
def test_ids_are_the_public_ones(spark, public):
    texts = _awkward(random.Random(6), 3000) + ["a" * 3000, "çã" * 2000, " " * 2000 + "x", "", None, "y " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("choque"))
    found = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df).collect()}
    assert found == {i: public.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df).collect()}
    assert counts == {i: len(ids) for i, ids in found.items()}


@needs_vocabulary
def test_perfect_hash_finds_all_and_nothing_else():
    tool = bpe.encoder()
    size = tool.whole.size
    got, _ = tool.whole.find(tool.whole.low, tool.whole.high, tool.whole.length)
    assert sorted(got.tolist()) == sorted(tool.whole.value.tolist()) and size == len(set(got.tolist()))
    miss, _ = tool.whole.find(tool.whole.low ^ 1, tool.whole.high, tool.whole.length + 17)
    assert (miss == -1).all()


@needs_vocabulary
def test_no_documents(spark):
    assert bpe.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# Problem 9


def test_plan_fills_up_to_the_caps():
    assert mixing.plan({}, {"a": (1.0, 1)}) == {}
    assert mixing.plan({"a": 10}, {"a": (0.0, 1), "b": (1.0, 1)}) == {}
    got = mixing.plan({"a": 1000, "b": 10, "c": 10}, {"a": (50.0, 1), "b": (25.0, 2), "c": (25.0, 1)}, 200)
    assert got == {"a": 170.0, "b": 20.0, "c": 10.0}


@needs_vocabulary
def test_shares_and_caps_of_a_mix(spark):
    rng = random.Random(8)
    rows = [(i, "palavra comum " * rng.randrange(1, 30), "grande" if i % 10 else "pequena", "k") for i in range(3000)]
    rows += [(9001, None, "grande", "k"), (9002, "", "pequena", "k"), (9003, "texto", None, "k"), (9004, "texto", "avulsa", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copias string")
    weights = spark.createDataFrame([("grande", 50.0, 2), ("pequena", 40.0, 3), ("vazia", 10.0, 2), ("grande", 50.0, 2), (None, 5.0, 1), ("nula", None, None)], "source string, peso double, max_repeticoes int")
    used, shares = mixing.mixed(docs, weights, seed=1)
    got = used.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    assert max(r["copias"] for r in got if r["source"] == "pequena") <= 3
    report = {r["source"]: r for r in shares.collect()}
    assert set(report) == {"grande", "pequena", "vazia", "nula"}
    assert abs(report["grande"]["parcela"] - 55.556) < 0.5 and abs(report["pequena"]["parcela"] - 44.444) < 0.5
    assert report["vazia"]["tokens"] == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs.repartition(9), weights, seed=1)[0].collect()))


@needs_vocabulary
def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, peso double, max_repeticoes int")
    used, shares = mixing.mixed(docs, weights)
    assert used.count() == 0 and shares.first()["tokens"] == 0


# Problem 10


def _marked(text):
    return [(kind, text[a:b]) for kind, a, b in personal.mentions(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Compareceu a Sra. Íris Lima da Costa, CPF 912.284.327-04, tel. (40) 93420-3573.", [("NOME", "Íris Lima da Costa"), ("IDENTIDADE", "912.284.327-04"), ("TELEFONE", "(40) 93420-3573")]),
        ("Contato: ana+lima@correio.example, ou ivo (arroba) caixa.test. Perfil @noticias_vale.", [("EMAIL", "ana+lima@correio.example"), ("EMAIL", "ivo (arroba) caixa.test")]),
        ("Mora na Av. do Moinho Seco, nº 1.521, apto. 2, e antes na rua Doutora Íris Lima, s/n.", [("ENDERECO", "Av. do Moinho Seco, nº 1.521"), ("ENDERECO", "rua Doutora Íris Lima, s/n")]),
        ("Witness Edith Brown, of 338 Pewter Hill Street, SSN 000-33-7124, +1 555 555 0177.", [("NOME", "Edith Brown"), ("ENDERECO", "338 Pewter Hill Street"), ("IDENTIDADE", "000-33-7124"), ("TELEFONE", "+1 555 555 0177")]),
        ("Em nome de Pestana, Genésio (passaporte ZZ127913).", [("NOME", "Pestana, Genésio"), ("IDENTIDADE", "ZZ127913")]),
        ("O Exmo. Sr. Des. Moreira ouviu J. P. Lima e MARINA DA COSTA.", [("NOME", "Moreira"), ("NOME", "J. P. Lima"), ("NOME", "MARINA DA COSTA")]),
        ("aos cuidados de ubirajara lima, na C/ Fuente Parda, n.º 2733", [("NOME", "ubirajara lima"), ("ENDERECO", "C/ Fuente Parda, n.º 2733")]),
        ("O processo 5850324-29.2022.9.99.0050, a guia n. 84431455124 e a nota fiscal 385.362.992-99 da Helena Ltda. em 03/07/2014.", []),
        ("A rua estava interditada e a avenida principal, alagada. O Min. Público e a 1ª Câmara Cível.", []),
        ("", []),
    ],
)
def test_mentions(text, expected):
    assert _marked(text) == expected


def test_redaction_changes_nothing_else(spark):
    text = "Nome: Ana Lima\nTel.: 040-3070-3653 fim"
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "x " * 200_000, "k")], "doc_id bigint, text string, tipo string")
    out = {r["doc_id"]: r["texto"] for r in personal.redacted(df).collect()}
    assert out == {1: "Nome: [NOME]\nTel.: [TELEFONE] fim", 3: "", 4: "x " * 200_000}
    assert personal.found_mentions(df).count() == 2
    assert personal.found_mentions(df.limit(0)).count() == 0


def test_surrogates_keep_form_and_identity():
    text = "ANA LIMA, CPF 912.284.327-04; depois Ana Lima (CPF 912.284.327-04) e Bia: CPF 912.284.327-05."
    spans = personal.mentions(text)
    out = personal.with_surrogates(text, spans, b"chave")
    again = personal.mentions(out)
    kinds = [k for k, _, _ in spans]
    assert [k for k, _, _ in again] == kinds
    parts = [out[a:b] for _, a, b in again]
    assert parts[0] == parts[2].upper() and parts[0].lower() != "ana lima"
    assert parts[1] == parts[3] != parts[4] and parts[1].count(".") == 2 and parts[1][-3] == "-"
    assert personal.given_names()[personal._plain(parts[2].split()[0].lower())] == "f"
    assert personal.with_surrogates(text, spans, b"outra") != out


def test_number_surrogates_never_collide():
    maker = personal.Surrogates(b"k")
    assert len({maker.number(f"{i:04d}") for i in range(10_000)}) == 10_000


def test_factors_of_a_size_are_sought_once():
    """The search for two factors of a word's many forms took most of a surrogate's time."""
    surrogates.factors.cache_clear()
    maker = personal.Surrogates(b"k")
    assert len({maker.number(f"{i:09d}") for i in range(200)}) == 200
    assert surrogates.factors.cache_info().misses == 1
    assert all(a * b == n and a >= b for n in (1, 2, 7, 12, 10**9, 5**6 * 21**7) for a, b in [surrogates.factors(n)])


def test_last_words_of_a_line():
    def model(text, at, words):
        while words and at > 0:
            while at > 0 and text[at - 1] in " \t\xa0":
                at -= 1
            if at > 0 and text[at - 1] == "\n":
                return at - 1
            while at > 0 and not text[at - 1].isspace():
                at -= 1
            words -= 1
        return at

    rng = random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choice("ab.  \n\t\xa0\r") * rng.choice((1, 1, 40)) for _ in range(rng.randrange(12)))
        at, words = rng.randint(0, len(text)), rng.randint(1, 6)
        assert personal._back(text, at, words) == model(text, at, words), (text, at, words)


def test_arrow_slices_are_read_right():
    if not os.path.exists(os.path.join(bpe.TOKENIZERS, f"{bpe.VOCABULARY}.tiktoken")):
        pytest.skip("no vocabulary files")
    texts = pa.array(["zero", "um dois", None, "", "três"])
    whole = [x for _, _, ids, _ in bpe.encode_array(texts.slice(1, 4), bpe.encoder()) for x in ids.tolist()]
    tool = bpe.encoder()
    assert whole == [int(i) for t in ("um", " dois", "tr", "ês") for i in tool.ids(t.encode())] or len(whole) > 2


def test_surroundings_of_runs_are_whole_words():
    """The nearest words around a place, whether they are near or far, on one line or several."""
    from docloom.llm import names

    words = ["a", "de", "testemunha", "inconstitucionalissimamente", "12", ",", "x" * 30]
    text = " ".join(words[(i * i + 3 * i) % len(words)] for i in range(200)) + "\n\nfim de linha\n"
    for a in range(0, len(text), 7):
        before, after = names._around(text, a, a)
        own = names._WORD.findall(text[max(0, a - 400) : a])
        assert before == own[len(own) - len(before) :] and (len(before) == 3 or "\n" in text[:a] or a < 80)
        assert after == names._WORD.findall(text[a:])[:3]


def test_surrogates_are_kept():
    """The replacements of a key stay as they were when they were first given, and what comes again isn't computed again."""
    from docloom.llm.surrogates import Surrogates

    one = Surrogates(b"docloom")
    mixed = []
    real = one._mixed
    one._mixed = lambda *args, **more: mixed.append(1) or real(*args, **more)
    assert (one.words("Rua Souza 123"), one.number("99999-1234")) == ('Tia Wuavu 073', '85151-2234')
    first = len(mixed)
    assert (one.words("Rua Souza 123"), one.number("12")) and len(mixed) == first + 2
