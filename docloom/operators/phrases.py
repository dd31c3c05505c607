"""N-grams: mining of bigrams and longer phrases, and their application to token lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import textclean
from docloom.session import cut

# Words no phrase begins or ends with.
EDGE_WORDS = ("de", "da", "do", "para", "ao", "a", "e", "i", "o", "u", "pra", "di", "du", "por", "em", "num", "aos", "no", "na")
#: Most phrases that may be applied at once: they are sent to every task.
MAX_PHRASES = 2_000_000


def stop_words(spark) -> list[str]:
    """Portuguese function words of Spark's public list without accents, and the digit words."""
    from pyspark.ml.feature import StopWordsRemover

    import unicodedata

    plain = {unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode() for w in StopWordsRemover.loadDefaultStopWords("portuguese")}
    # Words that join the parts of many phrases (codigo de defesa) aren't stops.
    return sorted((plain - {"de", "da", "do", "a", "e"}) | set(textclean.DIGIT_WORDS))


def sentence_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, linha, tokens``: the quick tokens of every line that has any. Repeated documents keep apart rows."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("linha", "texto"))
    return lines.select("doc_id", "linha", textclean.quick_tokens(F.col("texto")).alias("tokens")).where(F.size("tokens") > 0)


def split_at_stops(tokens: Column, stops: list[str], keep_single: bool = False) -> Column:
    """Token lists between stop words, of two tokens or more, as ``ARRAY<ARRAY<STRING>>``; all within the row.

    ``keep_single``: a single token before a stop stays and meets the token after it. Null tokens don't count; tokens mustn't
    hold the separators U+001E and U+001F.
    """
    marked = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(*stops), F.lit("\x1e")).otherwise(t)), "\x1f")
    runs = F.filter(F.transform(F.split(marked, "\x1e"), lambda r: F.filter(F.split(r, "\x1f"), lambda t: t != "")), lambda r: F.size(r) > 0)
    if not keep_single:
        return F.filter(runs, lambda r: F.size(r) > 1)
    # A run of one opens the piece that the next run ends.
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"))

    def step(acc: Column, run: Column) -> Column:
        now = F.concat(acc["now"], run)
        return F.when(F.size(now) > 1, F.struct(F.concat(acc["done"], F.array(now)).alias("done"), empty.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), now.alias("now")))

    return F.aggregate(runs, start, step, lambda acc: acc["done"])


def pieces(sentences: DataFrame, stops: list[str], keep_single: bool = False) -> DataFrame:
    """``peca BIGINT, tokens``: the pieces of all sentences between stop words. Nothing is shuffled."""
    cut_up = sentences.select(F.explode(split_at_stops(F.col("tokens"), stops, keep_single)).alias("tokens"))
    return cut_up.select(F.monotonically_increasing_id().alias("peca"), "tokens")


def mine_bigrams(tokens: DataFrame, min_count: int = 10, threshold: float = 20.0) -> DataFrame:
    """``w1, w2, n, score`` of neighbouring tokens whose score is above ``threshold``.

    Score: ``(n - min_count) * V / (n1 * n2)`` with V the distinct tokens and pairs seen; pairs of fewer than ``min_count`` don't count.
    ``tokens`` has ``tokens ARRAY<STRING>``.
    """
    tokens = cut(tokens.select("tokens"))
    words = tokens.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("tokens")
    together = tokens.where(size > 1).select(F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.struct(F.element_at("tokens", i).alias("w1"), F.element_at("tokens", i + 1).alias("w2")))).alias("p"))
    both = together.groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = words.agg(F.count(F.lit(1)).alias("v")).unionByName(both.agg(F.count(F.lit(1)).alias("v"))).agg(F.sum("v").alias("v"))
    frequent = both.where(F.col("n") >= min_count)
    scored = frequent.join(words.select(F.col("w").alias("w1"), F.col("n").alias("n1")), "w1").join(words.select(F.col("w").alias("w2"), F.col("n").alias("n2")), "w2").crossJoin(F.broadcast(vocabulary))
    score = (F.col("n") - min_count) * F.col("v") / (F.col("n1") * F.col("n2"))
    return scored.select("w1", "w2", "n", score.alias("score")).where(F.col("score") > threshold)


def phrase_list(phrases: DataFrame) -> list[tuple[str, str]]:
    """The pairs of a mined table, which must be no more than :data:`MAX_PHRASES`."""
    rows = phrases.select("w1", "w2").limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases")
    return [(r["w1"], r["w2"]) for r in rows]


def apply_phrases(tokens: Column, pairs: list[tuple[str, str]]) -> Column:
    """Neighbouring tokens that are a phrase become ``w1_w2``, greedily from the left without overlaps.

    Whole batches at once: in a run of places that each begin a phrase every second one is taken, counted from the run's first.
    """
    known = frozenset(pairs)

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        flat = lists.flatten()
        n = len(flat)
        if n < 2 or not known:
            return lists
        coded = flat.dictionary_encode()
        code = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        size = len(code)
        wanted = np.array(sorted(code[a] * size + code[b] for a, b in known if a in code and b in code), np.int64)
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = pc.list_parent_indices(lists).to_numpy()
        begins = np.zeros(n, bool)
        begins[:-1] = (owner[1:] == owner[:-1]) & (codes[:-1] >= 0) & (codes[1:] >= 0) & np.isin(codes[:-1] * size + codes[1:], wanted)
        place = np.arange(n)
        first = np.maximum.accumulate(np.where(begins & ~np.r_[False, begins[:-1]], place, -1))
        taken = begins & ((place - first) % 2 == 0)
        joined = pc.binary_join_element_wise(flat, pc.take(flat, pa.array(np.minimum(place + 1, n - 1))), "_")
        kept = np.flatnonzero(~np.r_[False, taken[:-1]])
        words = pc.if_else(pa.array(taken), joined, flat).take(pa.array(kept))
        lengths = np.bincount(owner[kept], minlength=len(lists))
        offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, words, mask=lists.is_null())

    return run(tokens)


def mine_phrases(sentences: DataFrame, stops: list[str], min_count: int = 10, threshold: float = 20.0, second: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Bigrams, and the longer phrases found after joining them (``w1`` and ``w2`` may hold underscores)."""
    bigrams = mine_bigrams(pieces(sentences, stops), min_count, threshold)
    joined = sentences.withColumn("tokens", apply_phrases(F.col("tokens"), phrase_list(bigrams)))
    return bigrams, mine_bigrams(pieces(joined, stops), min_count, second)


def transform_tokens(tokens: Column, bigrams: list[tuple[str, str]], longer: list[tuple[str, str]]) -> Column:
    """Bigrams, then longer phrases, applied to a token list."""
    return apply_phrases(apply_phrases(tokens, bigrams), longer)


def has_edge_word(term: Column) -> Column:
    """Whether a phrase of blank-separated words begins or ends with one of :data:`EDGE_WORDS`, or is empty."""
    words = F.split(term, " ")
    return (F.element_at(words, 1).isin(*EDGE_WORDS)) | (F.element_at(words, -1).isin(*EDGE_WORDS)) | (F.trim(term) == "")


def suggestions(phrases: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """``de, para, aceito``: translation rules suggested by mined phrases and by a list of one's own.

    ``exclude`` and ``include`` may be written with blanks or underscores; lines that begin with ``#`` don't count. Longest first.
    """
    spark = phrases.sparkSession
    listed = lambda lines: sorted({line.strip().replace(" ", "_") for line in lines if line.strip() and not line.startswith("#")})
    mined = phrases.select(F.concat_ws("_", "w1", "w2").alias("para"))
    extra = spark.createDataFrame([(t,) for t in listed(include)], "para string")
    dropped = spark.createDataFrame([(t,) for t in listed(exclude)], "para string")
    terms = mined.unionByName(extra).distinct().join(dropped, "para", "left_anti").where(F.length("para") > 1)
    said = terms.select(F.replace("para", F.lit("_"), F.lit(" ")).alias("de"), "para")
    return said.select("de", "para", (~has_edge_word(F.col("de"))).alias("aceito")).orderBy(F.desc(F.length("para")), "para")
