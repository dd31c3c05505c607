"""Vocabulary: singular forms, resolution of tokens, fragments, set algebra, and the full tokenizer.

Tokens are resolved once per distinct token and the result is joined back, so stemming and vocabulary
lookups don't grow with the corpus but with its vocabulary.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import textclean
from docloom.functions.stem import stemmed
from docloom.functions.translate import translate_terms
from docloom.session import cut

# Plural endings and what they become, longest first.
PLURALS = (("aes", "ao"), ("ais", "al"), ("oes", "ao"), ("eis", "el"), ("ois", "ol"), ("les", "l"), ("res", "r"), ("zes", "z"), ("is", "il"), ("ns", "m"), ("s", ""))
#: Marks a suffix, and a suffix out of the vocabulary.
FRAGMENT, OUT_OF_VOCABULARY = "#", "#OOV"
#: What an empty document has for tokens.
EMPTY = "."
#: Most distinct tokens whose resolution is sent to every task, and the groups a frequent token is split into where it is joined.
BROADCAST_TOKENS, SALTS = 200_000, 16


def _singular_part(token: Column) -> Column:
    out = functools.reduce(
        lambda rest, rule: F.when(token.endswith(rule[0]), F.concat(F.substring(token, F.lit(1), F.length(token) - len(rule[0])), F.lit(rule[1]))).otherwise(rest),
        reversed(PLURALS),
        token,
    )
    return F.when((F.length(token) <= 1) | token.isin(*textclean.DIGIT_WORDS), token).otherwise(out)


def singular(token: Column) -> Column:
    """Singular of a token without accents; compounds part by part, empty parts dropped.

    One-character tokens and digit words stay. Null stays null.
    """
    parts = F.array_join(F.transform(F.filter(F.split(token, "_"), lambda p: p != ""), _singular_part), "_")
    return F.when((F.length(token) > 1) & token.contains("_"), parts).otherwise(_singular_part(token))


@dataclass(frozen=True)
class Vocabulary:
    """Terms, removed terms and translation rules. No base terms means that every token is accepted."""

    terms: frozenset[str] = frozenset()
    removed: frozenset[str] = frozenset()
    rules: tuple[tuple[str, str], ...] = field(default=())

    def frame(self, spark) -> DataFrame:
        """``term`` of each term."""
        return spark.createDataFrame([(t,) for t in sorted(self.terms)], "term string")

    def removed_frame(self, spark) -> DataFrame:
        """``term`` of each removed term."""
        return spark.createDataFrame([(t,) for t in sorted(self.removed)], "term string")


def removed_plurals(terms: DataFrame, removed: DataFrame) -> DataFrame:
    """``term``: vocabulary terms whose singular is removed."""
    forms = terms.select("term", singular(F.col("term")).alias("s")).where("s <> term")
    return forms.join(removed.select(F.col("term").alias("s")).distinct(), "s", "left_semi").select("term").distinct()


def final_terms(base: DataFrame, translated: DataFrame, removed: DataFrame) -> DataFrame:
    """``term``: base terms, translation outputs and digit words, without removed terms and their plurals."""
    digits = base.sparkSession.createDataFrame([(w,) for w in textclean.DIGIT_WORDS], "term string")
    everything = base.select("term").unionByName(translated.select("term")).unionByName(digits).where("term IS NOT NULL AND term <> ''").distinct()
    left = everything.join(removed.select("term"), "term", "left_anti")
    return left.join(removed_plurals(left, removed), "term", "left_anti")


def fragments(token: Column, stem_col: Column) -> tuple[Column, Column]:
    """Prefix and suffix of a token: its stem, and the token's characters beyond the stem's length."""
    suffix = F.when(F.length(stem_col) < F.length(token), F.substring(token, F.length(stem_col) + 1, F.length(token))).otherwise(F.lit(""))
    return stem_col, suffix


def simple_fragments(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """``token, prefixo, sufixo`` of distinct tokens; one-character tokens and compounds stay whole with both parts empty."""
    distinct = tokens.select(F.col(token_col).alias("token")).where("token IS NOT NULL AND token <> ''").distinct()
    prefix, suffix = fragments(F.col("token"), F.col("radical"))
    split = distinct.withColumn("radical", stemmed(F.col("token"))).select("token", prefix.alias("prefixo"), suffix.alias("sufixo"))
    whole = (F.length("token") <= 1) | F.contains("token", F.lit("_")) | ((F.col("prefixo") == F.col("token")) & (F.col("sufixo") == ""))
    return split.select("token", F.when(whole, "").otherwise(F.col("prefixo")).alias("prefixo"), F.when(whole, "").otherwise(F.col("sufixo")).alias("sufixo"))


def resolution(tokens: DataFrame, terms: DataFrame, accept_all: bool = False, fragment: bool = True, token_col: str = "token") -> DataFrame:
    """How each distinct token is resolved: ``token, pecas ARRAY<STRING>, tipo``.

    In order: its singular in the vocabulary (``singular``), itself (``termo``); one character or a compound gives nothing
    (``fora``); without ``fragment`` itself (``inteiro``); its stem in the vocabulary gives stem and ``#suffix``, or ``#OOV`` if
    the suffix isn't in it (``fragmento``); else nothing (``fora``). With ``accept_all`` a token that gives nothing stays itself.
    Null and empty tokens are left out.
    """
    known = terms.select("term").distinct()
    distinct = tokens.select(F.col(token_col).alias("token")).where("token IS NOT NULL AND token <> ''").distinct()
    base = distinct.select("token", singular(F.col("token")).alias("s"))
    hit = lambda df, column, flag: df.join(known.select(F.col("term").alias(column), F.lit(True).alias(flag)), column, "left")
    looked = hit(hit(base, "s", "em_s"), "token", "em_t")
    whole = (F.length("token") == 1) | F.contains("token", F.lit("_"))
    one = F.when(F.col("em_s") & (F.col("s") != F.col("token")), F.array("s")).when(F.col("em_t"), F.array("token"))
    kind = F.when(F.col("em_s") & (F.col("s") != F.col("token")), "singular").when(F.col("em_t"), "termo").when(whole, "fora")
    if not fragment:
        kind = F.coalesce(kind, F.lit("inteiro"))
        one = F.when(kind == "inteiro", F.array("token")).otherwise(one)
        found = looked.select("token", one.alias("pecas"), kind.alias("tipo"))
    else:
        first = looked.select("token", one.alias("pecas"), kind.alias("tipo"))
        settled, open_ = first.where("tipo IS NOT NULL"), first.where("tipo IS NULL").select("token")
        prefix, suffix = fragments(F.col("token"), F.col("radical"))
        parts = open_.withColumn("radical", stemmed(F.col("token"))).select("token", prefix.alias("p"), suffix.alias("x"))
        parts = hit(hit(parts, "p", "em_p"), "x", "em_x")
        pieces = F.when(F.col("em_p") & F.col("em_x") & (F.col("x") != ""), F.array("p", F.concat(F.lit(FRAGMENT), F.col("x")))).when(F.col("em_p"), F.array("p", F.lit(OUT_OF_VOCABULARY)))
        broken = parts.select("token", pieces.alias("pecas"), F.when(F.col("em_p"), "fragmento").otherwise("fora").alias("tipo"))
        found = settled.unionByName(broken)
    nothing = F.array("token") if accept_all else F.array().cast("array<string>")
    return found.select("token", F.coalesce("pecas", nothing).alias("pecas"), "tipo")


def raw_tokens(text: Column, vocabulary: Vocabulary) -> Column:
    """Cleaned and translated text as tokens, before terms are removed and tokens resolved."""
    cleaned = textclean.clean(text)
    if vocabulary.rules:
        cleaned = translate_terms(cleaned, list(vocabulary.rules))
    return textclean.split_tokens(textclean.drop_orphan_underscores(cleaned))


def replaced_tokens(tokens: Column, pieces: Broadcast) -> Column:
    """Every token's pieces from a broadcast dict, in order; tokens that aren't in it give none.

    Whole batches at once: only a batch's distinct tokens are looked up.
    """

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        table = pa.array([pieces.value.get(w, ()) for w in coded.dictionary.to_pylist()] + [()], pa.list_(pa.string()))
        which = coded.indices.fill_null(len(table) - 1)
        sizes = pc.list_value_length(table).to_numpy(zero_copy_only=False)[which.to_numpy(zero_copy_only=False)]
        lengths = np.bincount(pc.list_parent_indices(lists).to_numpy(), weights=sizes, minlength=len(lists)).astype(np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, table.take(which).flatten(), mask=lists.is_null())

    return run(tokens)


def tokenize(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", accept_all: bool = False, fragment: bool = True, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``doc_id, tokens ARRAY<STRING>`` of every row whose text isn't null.

    Tokens come in text order, without removed terms; one-character tokens go after resolution; a document without tokens has
    ``['.']``. A vocabulary without terms accepts every token. Rows are documents of their own even if ``doc_id`` repeats.
    Distinct tokens are resolved once. Up to ``broadcast_tokens`` of them the table is sent to all tasks and applied within
    the row; a larger one is joined, with the same result.
    """
    spark = docs.sparkSession
    accept_all = accept_all or not vocabulary.terms
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), raw_tokens(F.col(text_col), vocabulary).alias("brutos")).withColumn("linha", F.monotonically_increasing_id())
    rows = cut(rows)
    seen = rows.select(F.explode("brutos").alias("token")).distinct()
    seen = seen.join(vocabulary.removed_frame(spark).withColumnRenamed("term", "token"), "token", "left_anti") if vocabulary.removed else seen
    table = cut(resolution(seen, vocabulary.frame(spark), accept_all, fragment).select("token", F.filter("pecas", lambda t: F.length(t) > 1).alias("pecas")))
    if table.count() <= broadcast_tokens:
        found = spark.sparkContext.broadcast({r["token"]: tuple(r["pecas"]) for r in table.collect()})
        kept = rows.select("doc_id", replaced_tokens(F.col("brutos"), found).alias("kept"))
    else:
        # A word that fills the texts has its occurrences in several groups, each with a copy of its row.
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        loose = rows.select("linha", "doc_id", F.posexplode_outer("brutos").alias("pos", "token")).withColumn("sal", F.pmod(F.col("linha"), F.lit(SALTS)))
        joined = loose.join(table.withColumn("sal", F.explode(salts)), ["token", "sal"], "left")
        gathered = joined.groupBy("linha").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "pecas"))).alias("partes"))
        kept = gathered.select("doc_id", F.flatten(F.transform("partes", lambda p: F.coalesce(p["pecas"], F.array().cast("array<string>")))).alias("kept"))
    return kept.select("doc_id", F.when(F.size("kept") == 0, F.array(F.lit(EMPTY))).otherwise(F.col("kept")).alias("tokens"))


def resolution_report(tokens: DataFrame, terms: DataFrame, accept_all: bool = False, token_col: str = "token") -> DataFrame:
    """``tipo, token, qtd``: how often each token was resolved in which way (in place of side-effect registries)."""
    counted = tokens.where(F.col(token_col).isNotNull()).groupBy(F.col(token_col).alias("token")).agg(F.count(F.lit(1)).alias("qtd"))
    return counted.join(resolution(counted, terms, accept_all), "token").select("tipo", "token", "qtd")


def text_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``termo``: distinct ``stem suffix`` forms of the quick tokens of all texts."""
    tokens = docs.select(F.explode(textclean.quick_tokens(F.col(text_col))).alias("token")).distinct()
    parts = simple_fragments(tokens)
    return parts.select(F.when(F.col("prefixo") == "", F.col("token")).otherwise(F.trim(F.concat_ws(" ", "prefixo", "sufixo"))).alias("termo")).distinct()


def model_vocabulary(vectors: DataFrame, word_col: str = "word") -> DataFrame:
    """``term`` of a trained model: fragment marks stripped, the out-of-vocabulary mark left out."""
    return vectors.where(F.col(word_col) != OUT_OF_VOCABULARY).select(F.replace(F.col(word_col), F.lit(FRAGMENT), F.lit("")).alias("term")).distinct()
