"""Problem 5: text that was decoded with the wrong encoding.

For every pair (encoding a text had, encoding it was read with) the garbled form of each letter and
typographic sign is computed beforehand. Forms of several characters (UTF-8 read as something else, once
or twice) are found by a multi-pattern automaton, forms of one character by a translation table. Each distinct word
of the collection that holds a character outside ASCII is tried against all pairs. A letter from several characters
in a word that isn't ordinary writing is repaired at once; else whether a repaired word is right is decided by how many
distinct texts have it as against the word as it stands, counted over the whole collection, or by all words of a text
fitting one pair. Only the matched spans of words so decided are replaced; all other text stays as it is.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

# Names of encodings texts are commonly read with by mistake.
SINGLE = ("cp1252", "cp850", "cp437", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "iso8859_15", "cp1253", "cp1254")
#: Character that stands for bytes that couldn't be decoded.
LOST = "�"
#: A word that may be right as it stands is repaired into one that this many times more texts have.
RATIO = 3

_SIGNS = "“”‘’„‚«»‹›–—…•€™§ºª°¿¡©®·£¢¥´¨¸¹²³¼½¾±×÷µ¶†‡‰\xa0"
_ONLY_SIGNS = "^[" + re.escape("€£§°ºª•–—…¿¡®©«»“”‘’™¬±") + r"\x21-\x2f\x3a-\x40]+$"
_TOKEN = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _decode(data: bytes, encoding: str) -> str:
    """Decode; bytes the encoding has no character for become control characters, as lenient readers do."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


def repertoire() -> list[str]:
    """Letters outside ASCII of the Latin, Greek and Cyrillic scripts, and typographic signs."""
    ranges = ((0xC0, 0x180), (0x218, 0x21C), (0x384, 0x3D0), (0x401, 0x460), (0x490, 0x492))
    return [chr(c) for a, b in ranges for c in range(a, b) if chr(c).isalpha()] + list(_SIGNS)


@functools.cache
def multi_tables() -> dict[str, ahocorasick.Automaton]:
    """For each way of misreading UTF-8, an automaton from garbled sequence to character."""
    out = {}
    for wrong in (*SINGLE, "latin_1"):
        once = {c: _decode(c.encode("utf-8"), wrong) for c in repertoire()}
        twice = {c: _decode(g.encode("utf-8"), wrong) for c, g in once.items()} if wrong in ("cp1252", "latin_1", "cp850", "mac_roman") else {}
        for name, forms in ((f"utf_8>{wrong}", once), (f"utf_8>{wrong}>utf_8>{wrong}", twice)):
            if forms:
                automaton = ahocorasick.Automaton()
                for char, form in forms.items():
                    if len(form) > 1:
                        automaton.add_word(form, (len(form), char))
                automaton.make_automaton()
                out[name] = automaton
    return out


@functools.cache
def single_tables() -> dict[str, dict[int, str]]:
    """For each ordered pair of single-byte encodings, the table from garbled to true character."""
    letters = [c for c in repertoire() if c.isalpha()] + list("ºª°§“”–€")
    out = {}
    for true in SINGLE:
        for wrong in SINGLE:
            if true == wrong:
                continue
            table = {}
            for char in letters:
                try:
                    form = _decode(char.encode(true), wrong)
                except UnicodeEncodeError:
                    continue
                if len(form) == 1 and form != char and ord(form) > 127:
                    table[ord(form)] = char
            out[f"{true}>{wrong}"] = table
    return out


def words(text: str) -> set[str]:
    """Distinct words with a character outside ASCII, without ASCII marks around them."""
    return {w for m in _TOKEN.finditer(text) if (w := m.group().strip(_EDGE))}


def _even(word: str) -> bool:
    """Whether the case of a word's letters is that of ordinary writing, without signs amid them."""
    core = word.strip("“”‘’„‚«»‹›–—…•¿¡'\"()[]§ºª°€")
    parts = [p for p in re.split(r"[-'’/.,;:()0-9“”–]+", core) if p]
    return all(p.isalpha() and (p.islower() or p.isupper() or p[1:].islower() or p in ("ª", "º")) for p in parts)


def _one_script(word: str) -> bool:
    names = {unicodedata.name(c, "?").split()[0] for c in word if c.isalpha() and c not in "ºª"}
    return len(names & {"LATIN", "CYRILLIC", "GREEK"}) <= 1


def repairs(word: str) -> Iterator[tuple[str, str, int]]:
    """``repaired, pair, strength`` of every way to read a word's garbled spans.

    Strength 3: a letter from several characters; 2: only a sign from several characters; 1: letters from single ones.
    """
    for pair, automaton in multi_tables().items():
        out, last, strength = [], 0, 0
        for end, (size, char) in automaton.iter_long(word):
            begin = end - size + 1
            out += [word[last:begin], char]
            last = end + 1
            before = word[begin - 1 : begin]
            # After a capital, a mark that closes a quotation may be just that.
            doubtful = not char.isalpha() or before.isupper() and word[begin + 1] in "“”‘’–—…»«"
            strength = max(strength, 2 if doubtful else 3)
        if strength:
            yield "".join(out) + word[last:], pair, strength
    rest = [c for c in word if ord(c) > 127 and c not in "“”‘’–…"]
    if rest:
        for pair, table in single_tables().items():
            if all(ord(c) in table for c in rest):
                fixed = word.translate(table)
                if _even(fixed) and _one_script(fixed):
                    yield fixed, pair, 1


def _found_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, texto_id, palavra``: the distinct words outside ASCII of every row; equal texts have one ``texto_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, found = [], [], []
            for i, text in enumerate(batch.column("t").to_pylist()):
                own = words(text)
                row += [i] * len(own)
                keys += [hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()] * len(own)
                found += own
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["doc_id", "texto_id", "palavra"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL").mapInArrow(run, f"doc_id {kind}, texto_id binary, palavra string")


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, count, fixed, pair, strength = [], [], [], [], []
        for w, n in zip(batch.column("palavra").to_pylist(), batch.column("docs").to_pylist()):
            for r, p, s in repairs(w):
                word.append(w), count.append(n), fixed.append(r), pair.append(p), strength.append(s)
        odd = [not (_even(w) and _one_script(w)) for w in word]
        yield pa.record_batch([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(fixed, pa.string()), pa.array(pair, pa.string()), pa.array(strength, pa.int32()), pa.array(odd, pa.bool_())], names=["palavra", "docs", "certa", "par", "forca", "estranha"])


def _judged(counts: DataFrame) -> DataFrame:
    """``palavra, docs, certa, par, forca, estranha, vezes``: every way to read a word, with the texts that have either form."""
    tried = counts.where(~F.contains("palavra", F.lit(LOST))).mapInArrow(_tried, "palavra string, docs bigint, certa string, par string, forca int, estranha boolean")
    known = counts.select(F.col("palavra").alias("certa"), F.col("docs").alias("vezes"))
    return tried.join(known, "certa", "left").withColumn("vezes", F.coalesce("vezes", F.lit(0)))


def word_repairs(counts: DataFrame, judged: DataFrame) -> DataFrame:
    """``palavra, certa, par`` of every word that is garbled wherever it stands; ``certa`` is null where it can't be restored.

    ``counts`` has ``palavra, docs`` (distinct texts). A word with :data:`LOST` characters is restored to the most frequent word that agrees in all others.
    """
    right = (
        ((F.col("forca") == 3) & (F.col("estranha") | (F.col("vezes") == 0) | (2 * F.col("vezes") >= F.col("docs"))))
        | ((F.col("forca") == 2) & (F.col("vezes") >= F.col("docs")) & (F.col("vezes") > 0))
        | ((F.col("forca") == 1) & (F.col("vezes") >= RATIO * F.col("docs")))
        | ((F.col("forca") == 1) & F.col("estranha") & (F.col("vezes") >= F.col("docs")) & (F.col("vezes") > 0))
    )
    best = judged.where(right).groupBy("palavra").agg(F.max(F.struct("vezes", "forca", "certa", "par")).alias("m")).select("palavra", F.col("m.certa").alias("certa"), F.col("m.par").alias("par"))
    holes = r"[^\x00-\x7f]"
    whole = counts.where(~F.contains("palavra", F.lit(LOST)))
    shapes = whole.groupBy(F.regexp_replace("palavra", holes, LOST).alias("forma")).agg(F.max(F.struct("docs", "palavra"))["palavra"].alias("certa"))
    lost = counts.where(F.contains("palavra", F.lit(LOST))).select("palavra", F.regexp_replace("palavra", holes, LOST).alias("forma")).join(shapes, "forma", "left")
    return best.unionByName(lost.select("palavra", "certa", F.lit("perdido").alias("par")))


def text_repairs(found: DataFrame, judged: DataFrame) -> DataFrame:
    """``texto_id, palavra, certa, par`` of texts whose words all fit one pair of single-byte encodings.

    At least two words of the text mustn't be ordinary writing as they stand; their frequency doesn't count. Of several
    pairs the one counts that gives most words other texts have; where none gives any, ``certa`` is null.
    """
    # A sign after a word, as of a trade mark, is ordinary: the odd character stands between letters.
    single = judged.where("forca = 1").withColumn("estranha", F.col("estranha") & F.col("palavra").rlike(r"\p{L}[^\x00-\x7f]+\p{L}"))
    odd = single.where("estranha").select("palavra").distinct()
    doubtful = found.join(odd, "palavra", "left_semi").groupBy("texto_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("texto_id")
    own = cut(found.join(doubtful, "texto_id", "left_semi").withColumn("letra", F.col("palavra").rlike(r"[^\x00-\x7fºª\P{L}]").cast("int")))
    asked = own.groupBy("texto_id").agg(F.sum("letra").alias("pedidas"))
    fits = own.join(single, "palavra")
    pairs = fits.groupBy("texto_id", "par").agg(F.sum("letra").alias("lidas"), F.sum(F.col("estranha").cast("int")).alias("estranhas"), F.sum((F.col("vezes") > 0).cast("int")).alias("conhecidas"), F.sum("vezes").alias("soma"))
    whole = pairs.join(asked, "texto_id").where("lidas = pedidas AND estranhas >= 2")
    chosen = whole.groupBy("texto_id").agg(F.max(F.struct("conhecidas", "soma", "par")).alias("m"), F.count(F.lit(1)).alias("modos"))
    firm = (F.col("conhecidas") > 0) | (F.col("modos") == 1)
    best = chosen.select("texto_id", F.col("m.par").alias("par"), F.col("m.conhecidas").alias("conhecidas"), "modos")
    return fits.join(best, ["texto_id", "par"]).select("texto_id", "palavra", F.when(firm, F.col("certa")).alias("certa"), "par")


def garbled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "texto") -> DataFrame:
    """``doc_id, palavra, certa, par``: the garbled words of every affected document."""
    found = cut(_found_words(docs, id_col, text_col).distinct())
    texts = found.select("texto_id", "palavra").distinct()
    counts = cut(texts.groupBy("palavra").agg(F.count(F.lit(1)).alias("docs")))
    judged = cut(_judged(counts))
    amid = cut(text_repairs(texts, judged))
    # Texts found whole say nothing about which words are right.
    sound = cut(texts.join(amid.select("texto_id").distinct(), "texto_id", "left_anti").groupBy("palavra").agg(F.count(F.lit(1)).alias("n")))
    clean = counts.join(sound, "palavra", "left").select("palavra", F.coalesce("n", F.lit(1)).alias("docs"))
    again = judged.drop("docs", "vezes").join(clean, "palavra").join(sound.select(F.col("palavra").alias("certa"), F.col("n").alias("vezes")), "certa", "left").withColumn("vezes", F.coalesce("vezes", F.lit(0)))
    alone = cut(word_repairs(clean, again))
    amid = amid.join(alone, "palavra", "left_anti")
    marked = cut(found.join(alone, "palavra").select("doc_id", "palavra", "certa", "par").unionByName(found.join(amid, ["texto_id", "palavra"]).select("doc_id", "palavra", "certa", "par")).distinct())
    # A sign by itself may well be meant: it needs a garbled word beside it.
    firm = marked.where(~F.col("palavra").rlike(_ONLY_SIGNS))
    return firm.unionByName(marked.where(F.col("palavra").rlike(_ONLY_SIGNS)).join(firm.select("doc_id").distinct(), "doc_id", "left_semi"))


def affected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "texto") -> DataFrame:
    """``doc_id`` of every document whose text holds wrongly decoded spans, restorable or not.

    Null and empty texts and repeated rows add nothing. Extra columns are ignored; an empty table gives no rows.
    """
    return garbled_words(docs, id_col, text_col).select("doc_id").distinct()


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "texto") -> DataFrame:
    """``doc_id, texto, restaurado, palavras, perdidas`` of every affected row.

    ``restaurado`` has the garbled words replaced, all else untouched; ``perdidas`` counts those that couldn't be restored and stay.
    """
    fixes = garbled_words(docs, id_col, text_col).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("palavra", F.coalesce("certa", "palavra").alias("certa")))).alias("trocas"), F.count(F.lit(1)).alias("palavras"), F.sum(F.col("certa").isNull().cast("bigint")).alias("perdidas"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column("texto").to_pylist(), batch.column("trocas").to_pylist()):
                swap = dict(pairs)

                def one(m, swap=swap):
                    token = m.group()
                    core = token.strip(_EDGE)
                    return token.replace(core, swap[core]) if core in swap else token

                out.append(_TOKEN.sub(one, text))
            yield pa.record_batch([batch.column("doc_id"), batch.column("texto"), pa.array(out, pa.string()), batch.column("palavras"), batch.column("perdidas")], names=["doc_id", "texto", "restaurado", "palavras", "perdidas"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("texto")).where("texto IS NOT NULL").distinct()
    return rows.join(fixes, "doc_id").mapInArrow(run, f"doc_id {kind}, texto string, restaurado string, palavras bigint, perdidas bigint")
