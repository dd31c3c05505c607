"""Whole jobs over folders of text files: curation, phrases, training, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import textclean, vocabulary
from docloom.operators import clusters, curation, embed, phrases, segments
from docloom.session import cut
from docloom.sources import corpus, tables

#: Terms of a comparison list made up from a model's vocabulary.
COMPARISON_TERMS = 250


def folder_tokens(spark: SparkSession, folder: str | list[str], vocab: vocabulary.Vocabulary, accept_all: bool = False, fragment: bool = True) -> DataFrame:
    """``doc_id, tokens`` of every file; ``doc_id`` is its path."""
    texts = corpus.read_texts(spark, folder)
    return vocabulary.tokenize(texts, vocab, "path", "texto", accept_all, fragment)


def curate_folder(spark: SparkSession, folder: str | list[str], vocabulary_folder: str, output: str) -> DataFrame:
    """The curation sheet of a folder against a vocabulary configuration, also written as CSV."""
    vocab = corpus.load_vocabulary(spark, vocabulary_folder)
    tokens = folder_tokens(spark, folder, vocab, accept_all=True, fragment=False)
    rows = tokens.select("doc_id", F.explode("tokens").alias("token"))
    sheet = cut(curation.curation_sheet(rows, vocab.frame(spark), vocab.removed_frame(spark)))
    tables.write_sheet(sheet.orderBy("termo"), output)
    return sheet


def seed_lines(spark: SparkSession, place: str) -> list[str]:
    """Lines of a seed list; a missing one is made, with a comment alone."""
    if not corpus.exists(spark, place):
        tables.write_lines(spark.createDataFrame([("# um termo por linha",)], "linha string"), "linha", place)
    return [r["value"] for r in corpus.few(spark.read.text(place), "seed lines")]


def phrase_folder(spark: SparkSession, folder: str, output: str, stops: list[str] | None = None, include: list[str] = (), exclude: list[str] = (), min_count: int = 10, threshold: float = 20.0) -> DataFrame:
    """Mined phrases of a folder: tables ``bigramas`` and ``quadrigramas``, and the suggested rules as text.

    The seed lists ``ngramas_incluir.txt`` and ``ngramas_remover.txt`` of the output count besides the given ones; they are made where they are missing.
    """
    include = [*include, *seed_lines(spark, f"{output}/ngramas_incluir.txt")]
    exclude = [*exclude, *seed_lines(spark, f"{output}/ngramas_remover.txt")]
    lines = phrases.sentence_tokens(corpus.read_texts(spark, folder), "path", "texto")
    pairs, longer = phrases.mine_phrases(lines, sorted({*(stops or phrases.stop_words(spark)), *(e for e in exclude if not e.startswith("#"))}), min_count, threshold)
    pairs, longer = cut(pairs), cut(longer)
    pairs.write.mode("overwrite").parquet(f"{output}/bigramas")
    longer.write.mode("overwrite").parquet(f"{output}/quadrigramas")
    found = cut(phrases.suggestions(pairs.unionByName(longer), include, exclude))
    rule = found.withColumn("regra", F.concat_ws(" => ", "de", "para"))
    tables.write_lines(rule.where("aceito"), "regra", f"{output}/sugeridos")
    tables.write_lines(rule.where("NOT aceito"), "regra", f"{output}/removidos")
    return found


def resolution_files(report: DataFrame, output: str) -> None:
    """The report of resolutions as one sorted list of tokens for each way; :func:`seed_lines` reads them again."""
    for kind in ("singular", "termo", "inteiro", "fragmento", "fora"):
        tables.write_lines(report.where(F.col("tipo") == kind).select("token").distinct().orderBy("token"), "token", f"{output}/{kind}")


def phrase_report(lines: DataFrame, pairs: list[tuple[str, str]], longer: list[tuple[str, str]], width: int = 200, most: int = 1000) -> DataFrame:
    """``linha`` of the first ``most`` lines with phrases applied: compounds in capitals, cut to ``width`` characters."""
    merged = phrases.transform_tokens(F.col("tokens"), pairs, longer)
    shown = F.array_join(F.transform(merged, lambda t: F.when(t.contains("_"), F.upper(t)).otherwise(t)), " ")
    return lines.orderBy("doc_id", "linha").limit(most).select("doc_id", "linha", F.substring(shown, 1, width).alias("texto"))


def split_folder(spark: SparkSession, folder: str, output: str, min_length: int = 1, min_tokens: int = 5) -> DataFrame:
    """Passages of a folder that the output doesn't hold yet, appended to it and numbered after those it has."""
    texts = corpus.read_texts(spark, folder)
    held = spark.read.parquet(output) if corpus.exists(spark, output) else None
    found = segments.passages(texts, "path", "texto", min_length, min_tokens)
    fresh = cut(segments.numbered(segments.first_occurrences(found, held), held.count() if held is not None else 0))
    tables.append_passages(fresh, output)
    return fresh


def train_folder(spark: SparkSession, folder: str | list[str], vocabulary_folder: str, model_path: str, **options) -> None:
    """A model of a folder's tokens, saved with its vocabulary and a log of its settings."""
    vocab = corpus.load_vocabulary(spark, vocabulary_folder)
    tokens = cut(folder_tokens(spark, folder, vocab))
    model = embed.train(tokens, with_vocabulary=bool(vocab.terms), **options)
    embed.save(model, model_path, {"documentos": tokens.count(), "termos": model.getVectors().count(), **options})


def comparison_terms(model, seed: int = 1, output: str | None = None) -> DataFrame:
    """``termo``: at most :data:`COMPARISON_TERMS` terms of a model's vocabulary, fragments left out, by seeded chance; kept as lines in ``output``."""
    words = model.getVectors().select(F.col("word").alias("termo")).where(~F.contains("termo", F.lit("#")))
    chosen = words.orderBy(F.xxhash64("termo", F.lit(seed)), "termo").limit(COMPARISON_TERMS)
    if output:
        tables.write_lines(chosen, "termo", output)
    return chosen


def comparison_report(model, terms: DataFrame, output: str) -> DataFrame:
    """The nearest terms of a comparison list as padded lines, also kept in ``output``."""
    lines = embed.term_report(embed.nearest_terms(model, terms))
    tables.write_lines(lines.orderBy("linha"), "linha", output)
    return lines


def vectorize_folder(spark: SparkSession, folder: str | list[str], vocabulary_folder: str, model_path: str) -> DataFrame:
    """``path, previa, tokens, vetor`` of every file of a folder."""
    vocab = corpus.load_vocabulary(spark, vocabulary_folder)
    texts = corpus.read_texts(spark, folder)
    tokens = vocabulary.tokenize(texts, vocab, "path", "texto").withColumnRenamed("doc_id", "path")
    vectors = embed.infer(embed.load(model_path), tokens)
    return texts.select("path", textclean.preview(F.col("texto")).alias("previa")).join(vectors, "path")


def cluster_folder(spark: SparkSession, folder: str | list[str], vocabulary_folder: str, model_path: str, output: str, similarity: float = 90, with_text: bool = False) -> DataFrame:
    """Files of a folder clustered in order of their path: ``pasta, arquivo, grupo, similaridade, identico, centroide[, texto]``, also written as CSV.

    Files without a known token are orphans. Groups come first, each from its centroid downwards.
    """
    files = cut(vectorize_folder(spark, folder, vocabulary_folder, model_path))
    grouped = clusters.leader(files, similarity, "path", "vetor")
    marked = clusters.identical_to_centroid(grouped, files.select(F.col("path").alias("id"), "tokens"))
    rows = marked.join(files.select(F.col("path").alias("id"), "previa"), "id")
    named = rows.select(corpus.folder_of(F.col("id")).alias("pasta"), corpus.stem_of(F.col("id")).alias("arquivo"), "grupo", "similaridade", "identico", "centroide", *([F.col("previa").alias("texto")] if with_text else []))
    sheet = cut(clusters.sheet_order(named, ["pasta", "arquivo"]).drop("ultimo"))
    tables.write_sheet(sheet, output)
    return sheet
