"""Passages: splitting at marks, rejoining at abbreviations, minimum lengths, deduplication."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.numbering import numbered_by

# Patterns of abbreviations after which a passage goes on, matched in any case at its end.
ABBREVIATIONS = (
    "sra?s?", "exm[ao]s?", "ns?", "nos?", "doc", "ac", "publ", "ex", "lv", "vlr?", "vls?", r"exmo\(a\)", r"ilmo\(a\)", "av", "of", "min", "livr?", "co?ls?",
    "univ", "resp", "cli", "lb", "dra?s?", r"[a-z]+r\(as?\)", "ed", "pa?g", "cod", "prof", "op", "plan", "edf?", "func", "ch", "arts?", "artigs?", "artg", "pars?", "rel",
    "tel", "res", "[a-z]", "gab", "bel", "ilm[oa]", "parc", "proc", "adv", "vols?", "cels?", "pp", "ex[ao]", "eg", "pl", "ref", "reg", "f[ilí]s?", "inc", "par",
    "alin", "fts", "publ?", "v. em", "v.rev", "des", r"des\(a\)", "desemb",
)
_ABBREVIATED = re.compile(r"(?:\b" + r"|\b".join(ABBREVIATIONS) + r")\.\s*$", re.IGNORECASE)


def join_dotted_numbers(text: Column) -> Column:
    """``1.234`` becomes ``1234``."""
    return F.regexp_replace(text, r"(\d+)\.(?=\d)", "$1")


def split_at_marks(line: Column, keep_marks: bool = True) -> Column:
    """Pieces after each point, and after a question or exclamation mark before a blank; empty ones dropped.

    ``keep_marks`` False drops those two marks, after which the pieces are joined again by :func:`join_broken`.
    """
    marked = F.regexp_replace(join_dotted_numbers(line), r"([?!]) ", "$1\n" if keep_marks else "\n")
    return F.filter(F.split(F.replace(marked, F.lit("."), F.lit(".\n")), "\n"), lambda p: p != "")


def _ended(piece: str) -> bool:
    """Whether a piece ends in a mark that no abbreviation explains."""
    return piece.strip().endswith((".", "?", "!")) and not _ABBREVIATED.search(piece.strip())


def join_broken(pieces: list[str]) -> list[str]:
    """Pieces in groups that each begin after a piece that :func:`_ended`, joined by blanks.

    >>> join_broken(["Conforme art.", "5 da lei.", "Fim"])
    ['Conforme art. 5 da lei.', 'Fim']
    """
    number = itertools.accumulate((_ended(piece) for piece in pieces[:-1]), initial=0)
    groups = itertools.groupby(zip(number, pieces), key=lambda pair: pair[0])
    return [functools.reduce(lambda text, piece: f"{text.strip()} {piece}", (piece for _, piece in group)) for _, group in groups] if pieces else []


def _valid_words(text: str) -> int:
    """Words of more than two letters."""
    return sum(len(re.sub(r"[^\wá-ú]", "", word)) > 2 for word in text.split(" "))


def accumulate(pieces: list[str], min_length: int = 1, min_tokens: int = 5) -> list[str]:
    """Stretches of pieces of at least ``min_length`` characters, each piece after a blank.

    Of full stretches those with ``min_tokens`` words of more than two letters are kept. Pieces that fill none at the end go
    to the last stretch kept; without any they are one with ``min_tokens`` words of whatever length.
    """
    ends, size = [], 0
    for place, piece in enumerate(pieces, 1):
        size += 1 + len(piece)
        if size >= min_length:
            ends.append(place)
            size = 0
    full = ["".join(f" {piece}" for piece in pieces[a:b]) for a, b in zip([0, *ends], ends)]
    kept = [text for text in full if min_tokens < 1 or _valid_words(text.strip()) >= min_tokens]
    rest = "".join(f" {piece}" for piece in pieces[(ends or [0])[-1] :])
    if rest and kept:
        kept[-1] += f" {rest}"
    elif rest and (min_tokens < 1 or len(rest.strip().split(" ")) >= min_tokens):
        kept = [rest]
    return kept


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 1, min_tokens: int = 5, keep_marks: bool = True) -> DataFrame:
    """``doc_id, sent_no, sentenca`` of every passage in order, in decomposed form and trimmed.

    Null and empty texts have none. Repeated documents come out as often as they occur.
    """
    lines = F.filter(F.flatten(F.transform(F.split(F.col(text_col), r"\r\n|\r|\n"), lambda x: split_at_marks(x, keep_marks))), lambda p: p != "")
    cut = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), lines.alias("pecas"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, parts in zip(frame["doc_id"], frame["pecas"]):
                joined = [p.strip() for p in join_broken(list(parts)) if p]
                for k, passage in enumerate(accumulate(joined, min_length, min_tokens), 1):
                    rows.append((doc, k, unicodedata.normalize("NFD", passage.strip())))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_no", "sentenca"])

    kind = docs.schema[id_col].dataType.simpleString()
    return cut.mapInPandas(run, f"doc_id {kind}, sent_no int, sentenca string")


def first_occurrences(passages_df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``doc_id, sent_no, sentenca, vezes``: each distinct passage at its first place, and how often it occurs.

    ``existing`` (``sentenca``) holds passages written before: they don't come out again. The first place is the smallest
    document, then number. Partial results keep a frequent passage from gathering in one task.
    """
    first = passages_df.groupBy("sentenca").agg(F.min(F.struct("doc_id", "sent_no")).alias("p"), F.count(F.lit(1)).alias("vezes"))
    if existing is not None:
        first = first.join(existing.select("sentenca").distinct(), "sentenca", "left_anti")
    return first.select("p.doc_id", "p.sent_no", "sentenca", "vezes")


def numbered(firsts: DataFrame, start: int = 0) -> DataFrame:
    """``sent_id`` after ``start`` in order of document and number."""
    return numbered_by(firsts, ["doc_id", "sent_no"], "sent_id", start).select("sent_id", "doc_id", "sent_no", "sentenca", "vezes")


def deduplication_counts(passages_df: DataFrame) -> DataFrame:
    """One row ``novas, repetidas``."""
    counted = passages_df.groupBy("sentenca").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("novas"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repetidas"))
