"""Problem 2: records that differ only in formatting.

The canonical key of a record is the sorted multiset of its fields, of which only letters and
digits count. Hot keys (more than ``hot_from`` rows) are found exactly from partial counts; their
rows are spread by a salt and aggregated in two levels. All other keys take one shuffle, in which a
group has at most ``hot_from`` rows. The representative is the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut

#: Separators of fields, and what counts within a field (fixed values of the record format).
FIELD_SEPARATORS = r"[|;\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+"
IGNORED = r"[^\p{L}\p{N}]+"


def canonical(text: Column | str) -> Column:
    """Canonical form of a record, null for a record without any letter or digit."""
    column = F.col(text) if isinstance(text, str) else text
    fields = F.transform(F.split(F.lower(column), FIELD_SEPARATORS), lambda f: F.regexp_replace(f, IGNORED, ""))
    kept = F.array_sort(F.filter(fields, lambda f: f != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "|"))


def canonical_keys(records: DataFrame, id_col: str = "arquivo_id", text_col: str = "texto") -> DataFrame:
    """``id, chave``: identifier and 128-bit digest of the canonical form, blank and null texts left out."""
    return records.select(F.col(id_col).alias("id"), F.unhex(F.md5(canonical(text_col).cast("binary"))).alias("chave")).where("chave IS NOT NULL AND id IS NOT NULL")


def grouped_copies(records: DataFrame, id_col: str = "arquivo_id", text_col: str = "texto", hot_from: int = 10_000, max_hot: int = 100_000, salts: int = 64) -> DataFrame:
    """``id, representante, copias`` of every record with content.

    ``representante`` is the smallest identifier among the records of the same canonical form and
    ``copias`` their number, the record itself included. A record without copies represents itself.
    Repeated rows with the same identifier and content count as one record. An empty table gives no rows.
    """
    keyed = cut(canonical_keys(records, id_col, text_col))
    # A hot key has more than 1 / max_hot of the rows, so there are at most max_hot of them: 16 bytes each.
    limit = max(hot_from, keyed.count() // max_hot)
    hot = keyed.groupBy("chave").agg(F.count(F.lit(1)).alias("linhas")).where(F.col("linhas") > limit).select("chave", F.lit(True).alias("quente"))
    flagged = keyed.join(F.broadcast(hot), "chave", "left")
    few = flagged.where("quente IS NULL").select("chave", "id").distinct()
    of_key = Window.partitionBy("chave")
    cold = few.select("id", F.min("id").over(of_key).alias("representante"), F.count(F.lit(1)).over(of_key).alias("copias"))
    many = flagged.where("quente").select("chave", "id").withColumn("sal", F.pmod(F.xxhash64("id"), F.lit(salts)))
    first = many.groupBy("chave", "sal", "id").agg(F.lit(1).alias("um")).groupBy("chave", "sal").agg(F.min("id").alias("menor"), F.count(F.lit(1)).alias("n"))
    second = first.groupBy("chave").agg(F.min("menor").alias("representante"), F.sum("n").alias("copias"))
    spread = second.withColumn("sal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("sal", F.col("sal").cast("bigint"))
    warm = many.select("chave", "sal", "id").distinct().join(spread, ["chave", "sal"]).select("id", "representante", "copias")
    return cold.unionByName(warm)


def collapsed(records: DataFrame, id_col: str = "arquivo_id", text_col: str = "texto", **options) -> DataFrame:
    """One row per distinct record: ``representante, copias``."""
    return grouped_copies(records, id_col, text_col, **options).where("id = representante").select("representante", "copias")
