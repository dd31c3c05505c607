"""Problem 9: documents drawn by source so that each source gets its share of the tokens.

Systematic sampling. Each document of a source expects the same number of copies. Within the source
the expected copies are summed up in order of size class, then of size, one random offset is added, and
a document comes out once for every integer the running sum crosses. The running sum is made in two
levels: counts of small buckets, a running sum over the buckets, and positions within a bucket.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.session import cut

#: Documents of a bucket, on average.
BUCKET = 50_000
#: Most sources a weight table may list: the plan is made by the driver.
MAX_SOURCES = 10_000


def plan(sizes: dict[str, int], weights: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take from each source.

    ``sizes`` has the tokens there are, ``weights`` the target share and the most repetitions of a document.
    Sources without tokens are left out and the other shares scaled up. Without ``total`` the largest one is taken at
    which every source reaches its share within its cap. With it, sources that can't reach their share give
    all their cap allows and the others share the rest by weight.

    >>> plan({"a": 100, "b": 10}, {"a": (50.0, 2), "b": (50.0, 3)})
    {'a': 30.0, 'b': 30.0}
    >>> plan({"a": 100, "b": 10}, {"a": (50.0, 2), "b": (50.0, 3)}, 100)
    {'a': 70.0, 'b': 30.0}
    """
    open_ = {s: w for s, (w, cap) in weights.items() if w > 0 and cap > 0 and sizes.get(s, 0) > 0}
    if not open_:
        return {}
    most = {s: float(weights[s][1] * sizes[s]) for s in open_}
    if total is None:
        total = min(most[s] * math.fsum(open_.values()) / w for s, w in open_.items())
    taken: dict[str, float] = {}
    while open_:
        rest, share = total - math.fsum(taken.values()), math.fsum(open_.values())
        full = [s for s, w in open_.items() if rest * w / share > most[s]]
        if not full:
            taken |= {s: rest * w / share for s, w in open_.items()}
            break
        for s in full:
            taken[s] = most[s]
            del open_[s]
    return {s: taken[s] for s in weights if s in taken}


def read_weights(weights: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and cap of every listed source; of repeated rows the largest share, then cap, counts.

    A null source is no source; a null, negative or NaN share is 0; a null cap is 1.
    """
    rows = weights.where("source IS NOT NULL").select("source", F.coalesce(F.nanvl(F.col("peso").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"), F.coalesce("max_repeticoes", F.lit(1)).alias("c")).groupBy("source").agg(F.max(F.struct("w", "c")).alias("x")).select("source", "x.w", "x.c").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: (max(0.0, r["w"]), max(0, r["c"])) for r in rows}


def offset(seed: int, source: str) -> float:
    """The random offset of a source, in [0, 1)."""
    return int.from_bytes(hashlib.sha256(f"{seed}|{source}".encode()).digest()[:6], "big") / 2**48


def drawn(sizes: DataFrame, rates: dict[str, float], seed: int) -> DataFrame:
    """``doc_id, source, n_tokens, copias`` of the documents drawn at ``rates`` copies a document."""
    spark = sizes.sparkSession
    rows = [(s, float(r), offset(seed, s)) for s, r in rates.items()]
    table = spark.createDataFrame(rows, "source string, taxa double, sorte double")
    placed = sizes.where("n_tokens > 0").join(F.broadcast(table), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    slices = max(1, math.ceil(sizes.count() / BUCKET))
    placed = placed.withColumn("balde", F.struct(F.floor(2 * F.log2("n_tokens")).alias("classe"), F.pmod("h", F.lit(slices)).alias("fatia")))
    filled = placed.groupBy("source", "balde").agg(F.count(F.lit(1)).alias("n"))
    before = filled.withColumn("antes", F.sum("n").over(Window.partitionBy("source").orderBy("balde").rowsBetween(Window.unboundedPreceding, -1))).select("source", "balde", F.coalesce("antes", F.lit(0)).alias("antes"))
    inner = placed.withColumn("i", F.row_number().over(Window.partitionBy("source", "balde").orderBy("n_tokens", "h", "doc_id"))).join(before, ["source", "balde"])
    at = F.col("antes") + F.col("i")
    crossed = F.floor(at * F.col("taxa") + F.col("sorte")) - F.floor((at - 1) * F.col("taxa") + F.col("sorte"))
    return inner.select("doc_id", "source", "n_tokens", crossed.cast("int").alias("copias")).where("copias > 0")


def mixed(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 9, folder: str = bpe.TOKENIZERS, vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The documents drawn, and the shares reached.

    ``docs`` has ``doc_id, text, source``; ``weights`` has ``source, peso, max_repeticoes``. Drawn: ``doc_id, source,
    n_tokens, copias``, one row per document used; ``copias`` never exceeds its source's cap. Documents
    without a listed source or without tokens aren't drawn. Repeated rows are documents of their own. Shares:
    ``source, peso, disponivel, tokens, parcela, maior_repeticao``, one row per listed source, ``parcela`` in percent.
    """
    sizes = cut(bpe.token_counts(docs.where("source IS NOT NULL"), keep=("source",), folder=folder, vocabulary=vocabulary))
    listed = read_weights(weights)
    spark = docs.sparkSession
    names = spark.createDataFrame([(s, w) for s, (w, _) in listed.items()], "source string, peso double")
    there = sizes.join(F.broadcast(names.select("source")), "source").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    have = {r["source"]: int(r["n"]) for r in there.collect()}  # at most MAX_SOURCES rows
    goal = plan(have, listed, total)
    used = drawn(sizes, {s: t / have[s] for s, t in goal.items()}, seed)
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copias")).alias("tokens"), F.max("copias").alias("maior_repeticao"))
    known = spark.createDataFrame([(s, have.get(s, 0)) for s in listed], "source string, disponivel bigint")
    shares = names.join(known, "source").join(reached, "source", "left").select("source", "peso", "disponivel", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("maior_repeticao", F.lit(0)).alias("maior_repeticao"))
    everything = shares.agg(F.sum("tokens").alias("soma"))
    shares = shares.crossJoin(everything).select("source", "peso", "disponivel", "tokens", F.coalesce(F.round(F.try_divide(100 * F.col("tokens"), F.col("soma")), 4), F.lit(0.0)).alias("parcela"), "maior_repeticao")
    return used, shares
