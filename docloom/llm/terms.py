"""Problem 1: how often every term occurs, and in how many documents.

Vertical layout. Documents are partitioned by blocks of consecutive ids. Within a block every
term gets a compressed bitmap of the documents that hold it and, beside it, a counter of its
occurrences; bitmaps of the same term and block are merged by union, and the document frequency
is the cardinality of the union. Blocks are disjoint, so a term's totals are sums over its blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of one bitmap block: 2 ** BLOCK_BITS. A full bitmap has 512 bytes.
BLOCK_BITS = 12
_BLOCK = 1 << BLOCK_BITS
_DENSE = _BLOCK // 8
#: The blank, which is no term, stands for "any term": its bitmap has the documents with a term.
ANY_TERM = ""


def normalize_term(token: str) -> str:
    """Lower case, without accents and ``#``, trimmed.

    >>> normalize_term(' #Súmula ')
    'sumula'
    """
    parts = unicodedata.normalize("NFD", token.replace("#", "").lower())
    return unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c))).strip()


def pack(positions: np.ndarray) -> bytes:
    """Compressed bitmap of sorted distinct positions within a block.

    Few positions are kept as 16-bit numbers (first byte 0), many as a bit field (first byte 1),
    whichever is shorter.
    """
    if positions.size * 2 < _DENSE:
        return b"\0" + positions.astype("<u2").tobytes()
    bits = np.zeros(_BLOCK, np.uint8)
    bits[positions] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    """Sorted positions of a bitmap made by :func:`pack`."""
    body = np.frombuffer(bitmap, np.uint8, offset=1)
    if bitmap[:1] == b"\0":
        return body.view("<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(body, bitorder="little"))


def union(bitmaps: list[bytes]) -> bytes:
    """Union of bitmaps of one block."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    bits = np.zeros(_BLOCK, np.uint8)
    for bitmap in bitmaps:
        bits[unpack(bitmap)] = 1
    return pack(np.flatnonzero(bits))


def cardinality(bitmap: bytes) -> int:
    """Number of documents in a bitmap."""
    if bitmap[:1] == b"\0":
        return (len(bitmap) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, np.uint8, offset=1)).sum())


_POSTINGS = pa.schema([("termo", pa.string()), ("bloco", pa.int64()), ("ocorrencias", pa.int64()), ("bitmap", pa.binary())])


def _block_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial postings of each batch of (bloco, pos, tokens)."""
    for batch in batches:
        tokens = batch.column("tokens")
        flat, owner = tokens.flatten(), pc.list_parent_indices(tokens)
        coded = flat.dictionary_encode()
        if not len(coded.dictionary):
            continue
        terms: dict[str, int] = {ANY_TERM: 0}
        code_of = np.array([terms.setdefault(normalize_term(w), len(terms)) for w in coded.dictionary.to_pylist()], np.int64)
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = owner.to_numpy(zero_copy_only=False)
        term = np.where(codes >= 0, code_of[codes], 0)
        keep = term > 0
        if not keep.any():
            continue
        term, owner = term[keep], owner[keep]
        block = batch.column("bloco").to_numpy(zero_copy_only=False)[owner]
        place = batch.column("pos").to_numpy(zero_copy_only=False)[owner].astype(np.int64)
        term, block, place = np.r_[term, np.zeros_like(term)], np.r_[block, block], np.r_[place, place]
        order = np.lexsort((place, block, term))
        term, block, place = term[order], block[order], place[order]
        new_group = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        ends = np.r_[new_group[1:], term.size]
        names = list(terms)
        bitmaps = [pack(p[np.r_[True, p[1:] != p[:-1]]]) for p in (place[a:b] for a, b in zip(new_group, ends))]
        yield pa.record_batch([pa.array([names[i] for i in term[new_group]], pa.string()), pa.array(block[new_group], pa.int64()), pa.array(ends - new_group, pa.int64()), pa.array(bitmaps, pa.binary())], schema=_POSTINGS)


@F.pandas_udf(T.BinaryType())
def _union_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda bitmaps: union(list(bitmaps)))


@F.pandas_udf(T.LongType())
def _cardinality_udf(bitmaps: pd.Series) -> pd.Series:
    return bitmaps.map(cardinality)


def current_rows(plans: DataFrame) -> DataFrame:
    """The counting row of each document with its block and position.

    The latest ``dthr`` of a ``doc_id`` counts; among rows of the same time the largest token list,
    so repeated rows count once. Rows with a null ``doc_id`` can't be told apart and are left out.
    One exchange by block serves this step and the postings after it.
    """
    block = F.shiftright(F.col("doc_id"), BLOCK_BITS)
    return (
        plans.select("doc_id", "tokens", "dthr")
        .where(F.col("doc_id").isNotNull())
        .withColumn("bloco", block)
        .repartition("bloco")
        .groupBy("bloco", "doc_id")
        .agg(F.max(F.struct("dthr", "tokens"))["tokens"].alias("tokens"))
        .select("bloco", F.col("doc_id").bitwiseAND(_BLOCK - 1).cast("int").alias("pos"), "tokens")
    )


def postings(plans: DataFrame) -> DataFrame:
    """One row per term and block: ``termo, bloco, ocorrencias, bitmap``.

    Null lists, null tokens and blank tokens give nothing; the blank term's row of a block is that of
    :data:`ANY_TERM`. Extra columns are ignored.
    """
    partial = current_rows(plans).mapInArrow(_block_postings, "termo string, bloco bigint, ocorrencias bigint, bitmap binary")
    merged = partial.groupBy("termo", "bloco").agg(F.sum("ocorrencias").alias("ocorrencias"), F.collect_list("bitmap").alias("partes"))
    return merged.select("termo", "bloco", "ocorrencias", F.when(F.size("partes") == 1, F.col("partes")[0]).otherwise(_union_udf("partes")).alias("bitmap"))


def term_frequencies(plans: DataFrame) -> DataFrame:
    """``termo, qtd, qtd_docs`` of every term in the token lists of ``plans``.

    ``plans`` has ``doc_id, tokens ARRAY<STRING>, dthr``. An empty table gives no rows.
    """
    return _counted(plans).where(F.col("termo") != ANY_TERM)


def _counted(plans: DataFrame) -> DataFrame:
    sizes = postings(plans).select("termo", "ocorrencias", _cardinality_udf("bitmap").alias("docs"))
    return sizes.groupBy("termo").agg(F.sum("ocorrencias").alias("qtd"), F.sum("docs").alias("qtd_docs"))


def marked_vocabulary(plans: DataFrame, rare_below: int = 3, common_share: float = 0.5) -> DataFrame:
    """:func:`term_frequencies` with ``marca``: ``raro``, ``comum`` or null.

    ``raro``: in fewer than ``rare_below`` documents. ``comum``: in more than ``common_share`` of the
    documents with at least one term. A term that is both (only in tiny collections) is ``raro``.
    """
    counted = _counted(plans)
    total = counted.where(F.col("termo") == ANY_TERM).agg(F.coalesce(F.max("qtd_docs"), F.lit(0)).alias("documentos"))
    mark = F.when(F.col("qtd_docs") < rare_below, "raro").when(F.col("qtd_docs") > common_share * F.col("documentos"), "comum")
    terms = counted.where(F.col("termo") != ANY_TERM)
    return terms.crossJoin(F.broadcast(total)).select("termo", "qtd", "qtd_docs", mark.alias("marca"))
