"""The curation sheet: counts, TF-IDF, box-plot positions, strange terms, vocabulary status."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vocabulary import FRAGMENT, simple_fragments
from docloom.session import cut

# The drawn positions of a box plot, and the longest token of the sheet.
BOXPLOT = ("o |---[---]---|  ", "  |-x-[---]---|  ", "  |---[x--]---|  ", "  |---[-x-]---|  ", "  |---[--x]---|  ", "  |---[---]-x-|  ", "  |---[---]---| o")
LONGEST_TOKEN = 50
#: Most terms whose frequencies are sent to every task.
BROADCAST_TERMS = 500_000


def term_counts(tokens: DataFrame, id_col: str = "doc_id", token_col: str = "token") -> DataFrame:
    """``doc_id, termo, tf`` of one row per token occurrence. Null and empty tokens don't count."""
    kept = tokens.where(F.col(token_col).isNotNull() & (F.col(token_col) != ""))
    return kept.groupBy(F.col(id_col).alias("doc_id"), F.col(token_col).alias("termo")).agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``termo, qtd, qtd_docs`` from :func:`term_counts`; two levels of counting, no distinct."""
    return counts.groupBy("termo").agg(F.sum("tf").alias("qtd"), F.count(F.lit(1)).alias("qtd_docs"))


def tfidf(counts: DataFrame, documents: DataFrame | int, frequencies: DataFrame | None = None) -> DataFrame:
    """``doc_id, termo, tf, peso``: ``tf * log2(N / df)``, of unit length within a document.

    Terms of every document weigh nothing and are left out. ``documents`` is N, or one row with it. Frequencies of up to
    :data:`BROADCAST_TERMS` terms are sent to all tasks, so that words all documents have aren't gathered in one.
    """
    frequencies = (document_frequencies(counts) if frequencies is None else frequencies).select("termo", "qtd_docs")
    frequencies = F.broadcast(frequencies) if frequencies.count() <= BROADCAST_TERMS else frequencies
    total = counts.sparkSession.range(1).select(F.lit(documents).alias("n")) if isinstance(documents, int) else documents.select(F.first(documents.columns[0]).alias("n"))
    weighed = counts.join(frequencies, "termo").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * F.log2(F.col("n") / F.col("qtd_docs"))).where("w > 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return weighed.select("doc_id", "termo", "tf", (F.col("w") / norm).alias("peso"))


def mean_weights(weights: DataFrame, places: int = 5) -> DataFrame:
    """``termo, tfidf``: mean of a term's positive weights, rounded."""
    return weights.groupBy("termo").agg(F.bround(F.avg("peso"), places).alias("tfidf"))


def boxplot_stats(values: DataFrame, column: str) -> DataFrame:
    """One row ``q1, m1, m2, q3, baixo, alto`` of the positive values of a column; nulls if there is none."""
    cuts = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.495), F.lit(0.505), F.lit(0.75)))
    q = values.where(F.col(column) > 0).agg(cuts.alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("m1"), F.col("q")[2].alias("m2"), F.col("q")[3].alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return q.select("*", (F.col("q1") - 1.5 * spread).alias("baixo"), (F.col("q3") + 1.5 * spread).alias("alto"))


def boxplot_position(value: Column, stats: str) -> Column:
    """Where a value lies, drawn; empty for zero. ``stats`` is the struct column of :func:`boxplot_stats`."""
    limits = [F.col(f"{stats}.{name}") for name in ("baixo", "q1", "m1", "m2", "q3", "alto")]
    chain = functools.reduce(lambda c, x: c.when(value < x[0], x[1]), zip(limits[1:], BOXPLOT[1:]), F.when(value == 0, "").when(value < limits[0], BOXPLOT[0]))
    return chain.otherwise(BOXPLOT[6])


def with_boxplots(sheet: DataFrame, columns: tuple[str, ...] = ("tfidf", "tamanho", "qtd", "qtd_docs")) -> DataFrame:
    """Adds ``<column>_bp``; the four statistics are one row each, joined as broadcast."""
    out = sheet = cut(sheet)
    for column in columns:
        stats = boxplot_stats(sheet, column).select(F.struct("*").alias(f"__{column}"))
        out = out.crossJoin(F.broadcast(stats)).withColumn(f"{column}_bp", boxplot_position(F.col(column), f"__{column}")).drop(f"__{column}")
    return out


def strange(term: Column) -> Column:
    """``S`` for terms that look like no word, else ``N``.

    The same character three times (r, s, a, e, i aside), three characters in a row outside ``rsaeiounl_``, a vowel
    three times or four vowels in a row, no vowel at all, or an underscore at an end.
    """
    # The patterns of a strange term.
    odd = term.rlike(r"([^rsaei])\1{2,}") | term.rlike(r"[^rsaeiounl_\n]{3,}") | term.rlike(r"([aeiou])\1{2,}|[aeiou]{4,}") | ~term.rlike("[aeiouáéíóú]") | term.startswith("_") | term.endswith("_")
    return F.when(odd, "S").otherwise("N")


def vocabulary_status(term: Column, in_base: Column, in_removed: Column, prefix_in: Column, suffix_in: Column) -> Column:
    """Status of a term: TERMO, NÃO, REMOVIDO, PREFIXO or PREFIXO+SUFIXO; compounds are named so."""
    compound = term.contains("_")
    status = F.when(in_removed, "REMOVIDO").when(compound & in_base, "TERMO (composto)").when(compound, "NÃO (composto)").when(in_base, "TERMO")
    return status.when(prefix_in & suffix_in, "PREFIXO+SUFIXO").when(prefix_in, "PREFIXO").otherwise("NÃO")


def core_sheet(tokens: DataFrame, id_col: str = "doc_id", token_col: str = "token", zero_when_weightless: bool = False) -> DataFrame:
    """``termo, tfidf, tamanho, qtd, qtd_docs`` of all terms up to :data:`LONGEST_TOKEN` characters (compounds of any length).

    ``zero_when_weightless`` sets the counts of terms that are in every document to zero, as some sheets have it.
    """
    # Read three times below: written once instead of cleaning all texts again.
    counts = cut(term_counts(tokens, id_col, token_col))
    total = counts.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    frequencies = cut(document_frequencies(counts))
    means = mean_weights(tfidf(counts, total, frequencies))
    sheet = frequencies.where((F.length("termo") <= LONGEST_TOKEN) | F.contains("termo", F.lit("_"))).join(means, "termo", "left")
    counted = lambda c: F.when(F.col("tfidf").isNull(), F.lit(0)).otherwise(F.col(c)).cast("bigint") if zero_when_weightless else F.col(c)
    clean = F.replace(F.col("termo"), F.lit(FRAGMENT), F.lit(""))
    return sheet.select(clean.alias("termo"), F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"), F.length(clean).cast("bigint").alias("tamanho"), counted("qtd").alias("qtd"), counted("qtd_docs").alias("qtd_docs"))


def curation_sheet(tokens: DataFrame, base: DataFrame, removed: DataFrame, id_col: str = "doc_id", token_col: str = "token") -> DataFrame:
    """The whole sheet: :func:`core_sheet` with fragments, status, strangeness and box plots.

    ``base`` and ``removed`` have ``term``. Base terms that no document has come out with zeros.
    """
    core = cut(core_sheet(tokens, id_col, token_col))
    absent = base.select(F.col("term").alias("termo")).distinct().join(core.select("termo"), "termo", "left_anti")
    zeros = absent.select("termo", F.lit(0.0).alias("tfidf"), F.length("termo").cast("bigint").alias("tamanho"), F.lit(0).cast("bigint").alias("qtd"), F.lit(0).cast("bigint").alias("qtd_docs"))
    rows = core.unionByName(zeros)
    parts = simple_fragments(rows, "termo").withColumnRenamed("token", "termo")
    flag = lambda df, frame, key, name: df.join(frame.select(F.col("term").alias(key)).distinct().withColumn(name, F.lit(True)), key, "left")
    joined = flag(flag(flag(flag(rows.join(parts, "termo", "left"), base, "termo", "b"), removed, "termo", "r"), base, "prefixo", "p"), base, "sufixo", "x")
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = vocabulary_status(F.col("termo"), is_true("b"), is_true("r"), is_true("p"), is_true("x"))
    own = F.contains("termo", F.lit("_")) | is_true("b") | is_true("r")
    sheet = joined.select("termo", F.coalesce("prefixo", F.lit("")).alias("prefixo"), F.coalesce("sufixo", F.lit("")).alias("sufixo"), "tfidf", "tamanho", "qtd", "qtd_docs", status.alias("vocab"), F.when(own, "N").otherwise(strange(F.col("termo"))).alias("estranho"))
    return with_boxplots(sheet)
