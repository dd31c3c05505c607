"""Reading a corpus: text files with encoding fallback, tags, lines, vocabulary files, token cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.textclean import collapse_spaces
from docloom.functions.translate import parse_rules
from docloom.functions.vocabulary import Vocabulary, final_terms, removed_plurals

#: Most terms a vocabulary configuration may have: it is read by the driver and sent to every task.
MAX_TERMS = 5_000_000
# Names that mark the files of a vocabulary configuration, in any case.
BASE_FILES, RULE_FILES, REMOVED_FILES = "vocab_base", "vocab_tradutor", "vocab_removido"


def decode_text(content: Column) -> Column:
    """UTF-8 if the bytes are, else Latin-1, which any bytes are."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "iso-8859-1"))


def stem_of(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    """Folder of a path, without the file's name."""
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def read_texts(spark: SparkSession, folders: str | list[str], extension: str = "txt", prefix: str = "", clean: bool = False, join_lines: bool = False) -> DataFrame:
    """``path, nome, modificado, texto`` of every file below the folders.

    Extension and prefix match in any case. ``clean`` collapses white space within lines, ``join_lines`` joins them by one
    blank. A missing folder is an error. Each file is one row, read whole; the file source leaves files without any byte out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([folders] if isinstance(folders, str) else folders)
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    low = F.lower(name)
    chosen = files.where(low.endswith(f".{extension}".lower() if extension else "") & low.startswith(prefix.lower()))
    lines = F.split(F.regexp_replace(decode_text(F.col("content")), r"(\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]")
    lines = F.transform(lines, collapse_spaces) if clean and not join_lines else lines
    text = F.array_join(lines, " " if join_lines else "\n")
    return chosen.select("path", name.alias("nome"), F.col("modificationTime").alias("modificado"), (collapse_spaces(text) if clean and join_lines else text).alias("texto"))


def tags(stem: Column, sidecar: Column | None = None) -> Column:
    """Tags of a file: the words after ``tag`` or ``tags`` in its name, without numbers in brackets; else those of
    its sidecar file; else a hash of the name.

    >>> # "arquivo 1 tag civil honorarios" -> [civil, honorarios]
    """
    marked = F.regexp_extract(stem, r"(?i)\btags?\b.*", 0)
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    own = words(F.regexp_replace(marked, r"(?i)\(\d+\)|\btags?\b", " "))
    beside = words(sidecar) if sidecar is not None else F.array().cast("array<string>")
    return F.when(F.size(own) > 0, own).when(F.size(F.coalesce(beside, F.array().cast("array<string>"))) > 0, beside).otherwise(F.array(F.xxhash64(stem).cast("string")))


def with_tags(texts: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Adds ``tags``; ``sidecars`` has ``path, texto`` of files named like the texts but ``.tag``."""
    base = texts.withColumn("__s", stem_of(F.col("path"))).withColumn("__f", folder_of(F.col("path")))
    if sidecars is None:
        return base.withColumn("tags", tags(F.col("__s"))).drop("__s", "__f")
    beside = sidecars.select(stem_of(F.col("path")).alias("__s"), folder_of(F.col("path")).alias("__f"), F.col("texto").alias("__t"))
    return base.join(beside, ["__s", "__f"], "left").withColumn("tags", tags(F.col("__s"), F.col("__t"))).drop("__s", "__f", "__t")


def tag_reader(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """``path, texto`` of the ``.tag`` files below the folders."""
    return read_texts(spark, folders, "tag", join_lines=True).select("path", "texto")


def text_lines(texts: DataFrame, id_col: str = "path", text_col: str = "texto") -> DataFrame:
    """``id, linha, texto`` of every line that isn't blank."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("linha", "texto"))
    return lines.where(F.trim("texto") != "")


def shuffled(texts: DataFrame, seed: int, limit: int | None = None, max_tokens: int = 0, tokens_col: str | None = None) -> DataFrame:
    """Rows in a seeded random order, at most ``limit`` of them, token lists cut to ``max_tokens`` if that isn't 0."""
    # An order of its own in every part is enough to mix; only a limit needs the smallest of all.
    drawn = texts.withColumn("__r", F.rand(seed))
    out = (drawn.orderBy("__r").limit(limit) if limit else drawn.repartition(F.col("__r")).sortWithinPartitions("__r")).drop("__r")
    return out.withColumn(tokens_col, F.slice(tokens_col, 1, max_tokens)) if tokens_col and max_tokens else out


def few(rows: DataFrame, what: str) -> list:
    """The rows of a configuration, which must be no more than :data:`MAX_TERMS`."""
    held = rows.limit(MAX_TERMS + 1).collect()
    if len(held) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} {what}")
    return held


def _few_lines(files: DataFrame, prefix: str) -> list[str]:
    return [r["l"] for r in few(files.where(F.lower("nome").startswith(prefix)).select(F.explode(F.split("texto", "\n")).alias("l")), f"lines of {prefix}")]


def vocabulary_of(base: DataFrame, removed: DataFrame, rules: list[tuple[str, str]]) -> Vocabulary:
    """A vocabulary from ``term`` of base and removed terms and rules, which are read by the driver.

    Digit words are always terms. Removed terms and plurals whose singular is removed are taken out. Without base terms the
    vocabulary is empty, even if there are rules, and then every token is accepted.
    """
    spark = base.sparkSession
    gone = {r["term"] for r in few(removed.select("term").distinct(), "removed terms")}
    if base.isEmpty():
        return Vocabulary(frozenset(), frozenset(gone), tuple(rules))
    outputs = spark.createDataFrame([(b,) for _, b in rules], "term string")
    terms = {r["term"] for r in few(final_terms(base, outputs, removed), "terms")}
    plurals = {r["term"] for r in few(removed_plurals(base.select("term").unionByName(outputs), removed), "terms")}
    return Vocabulary(frozenset(terms), frozenset(gone | plurals), tuple(rules))


def load_vocabulary(spark: SparkSession, folder: str, report: str | None = None) -> Vocabulary:
    """The vocabulary configured by the files of a folder; see :data:`BASE_FILES` and the others, and :func:`vocabulary_of`.

    ``report``: a folder for the rules and removed terms in force, as sorted lines.
    """
    from docloom.functions.textclean import remove_accents

    files = read_texts(spark, folder).cache()
    base, removed = _few_lines(files, BASE_FILES), _few_lines(files, REMOVED_FILES)
    rules = parse_rules(_few_lines(files, RULE_FILES))
    files.unpersist()
    words = lambda lines: spark.createDataFrame([(line,) for line in lines] or [("",)], "l string").select(F.explode(F.split(remove_accents(F.lower("l")), r"[ \t]+")).alias("term")).where("term <> ''").distinct()
    found = vocabulary_of(words(base), words(removed), rules)
    if report:
        lines = {"vocab_tradutor_termos": [f"{a} => {b}" for a, b in rules], "vocab_removido": sorted(found.removed)}
        for name, own in lines.items():
            spark.createDataFrame([(line,) for line in own], "value string").coalesce(1).write.mode("overwrite").text(f"{report}/{name}")
    return found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def token_cache(tokens: DataFrame, path: str, config: str) -> DataFrame:
    """Tokens kept under ``path`` for a configuration: read if there, else written first."""
    spark = tokens.sparkSession
    place = f"{path}/config={config}"
    if not exists(spark, place):
        tokens.write.mode("errorifexists").parquet(place)
    return spark.read.parquet(place)


def comparison_lines(spark: SparkSession, path: str) -> DataFrame:
    """:func:`listed_comparisons` of the lines of a text file."""
    return listed_comparisons(spark.read.text(path))


def listed_comparisons(lines: DataFrame) -> DataFrame:
    """``linha, ordem`` of a comparison list from lines ``value``: lines with ``=`` whole and first, of others each token.

    Blank lines don't count. ``ordem`` is 0 for pairs and 1 for terms; rows come sorted by it, then by line.
    """
    from docloom.functions.textclean import quick_tokens

    said = lines.where(F.trim("value") != "")
    pair = F.contains("value", F.lit("="))
    pairs = said.where(pair).select(F.trim("value").alias("linha"), F.lit(0).alias("ordem"))
    words = said.where(~pair).select(F.explode(quick_tokens(F.col("value"))).alias("linha"), F.lit(1).alias("ordem"))
    return pairs.unionByName(words).orderBy("ordem", "linha")
