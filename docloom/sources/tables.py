"""Table schemas, sinks, and session bookkeeping of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.vectors import parse_vector

SCHEMAS = {
    "vetores": "seq_documento int, pagina int, vetor array<float>, dthr timestamp",
    "grupos": "seq_documento int, grupo int, sessao string, centroide boolean, sim double, dthr timestamp",
    "grupos_logs": "sessao string, ordem int, dthr timestamp, txt_log string",
    "grupos_matriz_tmp": "sessao string, seq_documento int, seq_documento_sim int, sim double, centroide boolean",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of a known schema."""
    return spark.createDataFrame([], SCHEMAS[name])


def vectors_from_json(rows: DataFrame) -> DataFrame:
    """Rows of ``vetores`` from ``seq_documento, pagina, vetor`` with the vector as JSON text; what is no vector becomes null."""
    return rows.select(F.col("seq_documento").cast("int"), F.col("pagina").cast("int"), parse_vector(F.col("vetor")).alias("vetor"), F.current_timestamp().alias("dthr"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text line per row, overwriting."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A sheet as CSV with header, overwriting; arrays aren't allowed."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_passages(passages: DataFrame, path: str) -> None:
    """New passages as rows of a table; never one file per passage."""
    passages.write.mode("append").parquet(path)


def retained(groups: DataFrame, logs: DataFrame, now: str | None = None, group_hours: int = 12, log_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Clusterings of the last hours and logs of the last days; rows without time go. ``now``: a timestamp, else the clock."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    keep = lambda df, span: df.where(F.col("dthr") >= at - F.expr(span))
    return keep(groups, f"INTERVAL {group_hours} HOURS"), keep(logs, f"INTERVAL {log_days} DAYS")


def replaced_session(groups: DataFrame, fresh: DataFrame, session: str) -> DataFrame:
    """Groups with a session's rows replaced by fresh ones."""
    return groups.where(~F.col("sessao").eqNullSafe(session)).unionByName(fresh)


def log_rows(spark: SparkSession, session: str, lines: list[str]) -> DataFrame:
    """Log rows of a session, numbered from 1."""
    rows = [(session, i, line) for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "sessao string, ordem int, txt_log string").select("sessao", "ordem", F.current_timestamp().alias("dthr"), "txt_log")


def clustering_log(groups: DataFrame, session: str) -> DataFrame:
    """Log of a finished clustering ``seq_documento, grupo, centroide``: its documents, those without a vector, groups and orphans."""
    n = groups.agg(F.count(F.lit(1)).alias("todos"), F.count_if(F.col("grupo") == -2).alias("sem"), F.count_if(F.col("centroide") & (F.col("grupo") > 0)).alias("grupos"), F.count_if(F.col("grupo") == -1).alias("orfaos")).first()
    return log_rows(
        groups.sparkSession,
        session,
        [f"Início do agrupamento da sessão {session}", f"{n['sem']} documentos sem vetor", f"{n['todos'] - n['sem']} documentos com vetor", f"{n['grupos']} grupos formados", f"{n['orfaos']} documentos sem grupo", "Agrupamento concluído"],
    )


def kept_matrix(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of a similarity matrix whose session still has groups."""
    return matrix.join(groups.select("sessao").distinct(), "sessao", "left_semi")
