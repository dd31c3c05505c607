"""Documents as they arrive: the same cleaning and group assignment as streaming plans.

All steps are stateless: a stream of texts is cleaned by the Column functions of the batch route, and a
stream of vectors is placed in existing groups by a join with the static centroids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.textclean import quick_tokens
from docloom.operators import vectors as V
from docloom.operators.clusters import ORPHAN

#: Most centroids that are sent to all tasks of a stream.
MAX_CENTROIDS = 50_000


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_tokens(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens`` of a stream (or table) of texts."""
    return texts.select(F.col(id_col).alias("doc_id"), quick_tokens(F.col(text_col)).alias("tokens"))


def stream_groups(vectors: DataFrame, centroids: DataFrame, threshold: float = 90) -> DataFrame:
    """``id, grupo, similaridade`` of a stream (or table) of vectors ``id, v`` against static centroids ``grupo, v``.

    The centroids are gathered into one row, so each incoming vector is scored within its row and no state is kept; ties
    go to the smaller group. More than :data:`MAX_CENTROIDS` centroids are an error: :func:`docloom.operators.clusters.best_group`
    has no such bound and can be run on each micro-batch.
    """
    if centroids.count() > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    limit = V.percent(threshold)
    held = centroids.select("grupo", V.normalize(F.col("v")).alias("c")).where("c IS NOT NULL").agg(F.sort_array(F.collect_list(F.struct("grupo", "c"))).alias("todos"))
    unit = vectors.select("id", V.normalize(F.col("v")).alias("v")).crossJoin(F.broadcast(held))
    scored = F.transform("todos", lambda x: F.struct((-V.dot(F.col("v"), x["c"])).alias("s"), x["grupo"].alias("grupo")))
    best = F.array_min(F.filter(scored, lambda x: -x["s"] >= limit))
    return unit.select("id", F.coalesce(best["grupo"], F.lit(ORPHAN)).alias("grupo"), F.coalesce(-100 * best["s"], F.lit(0.0)).alias("similaridade"))
