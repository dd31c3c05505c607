"""Problem 8: token ids of a public byte-level BPE for a whole corpus.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself a
vocabulary entry; it is evaluated for all pre-tokens of a batch at once. The misses of a batch are
made distinct, and each is merged once with a heap over linked bytes; a bounded cache keeps the
results of frequent misses.

Pre-tokens of at most 16 bytes are handled as two 64-bit words, compared exactly with the entry
the hash points at, so a foreign pre-token can never take an entry's id.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = os.environ.get("DOCLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Bytes of text handled at once, which bounds a worker's memory whatever the batch.
PIECE_BYTES = 1 << 20
#: Distinct misses a worker remembers.
CACHE = 200_000

# Fixed values of the public pre-token pattern: suffixes split off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_U = np.uint64
#: Marks a displacement that is itself the place.
_DIRECT = _U(1 << 63)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000 : sys.maxunicode + 1]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    return table


def token_starts(data: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start in ``data`` (UTF-8 of texts laid end to end).

    ``begins`` has the offset of each text that isn't empty. The rules of the pattern are all local: a run
    of one class is a token, a blank before it belongs to it, of longer white space only the last
    character may, and an apostrophe that starts a token takes a contraction's letters with it.
    """
    n = data.size
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    point = data[at].astype(np.int32)
    wide = np.flatnonzero(point >= 0x80)
    if wide.size:
        p = at[wide]
        first = point[wide]
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b, c, d = padded[p + 1] & 63, padded[p + 2] & 63, padded[p + 3] & 63
        point[wide] = np.where(first < 0xE0, (first & 31) << 6 | b, np.where(first < 0xF0, (first & 15) << 12 | b << 6 | c, (first & 7) << 18 | b << 12 | c << 6 | d))
    kind = classes[point]
    m = at.size
    opens = np.zeros(m + 1, bool)
    opens[np.searchsorted(at, begins)] = True
    opens[m] = True
    before = np.empty(m, np.uint8)
    before[0] = 0
    before[1:] = kind[:-1]
    before[opens[:m]] = 0
    prior_blank = np.zeros(m, bool)
    prior_blank[1:] = point[:-1] == 32
    space = kind == _SPACE
    after_text = np.empty(m, bool)
    after_text[:-1] = ~space[1:]
    after_text[-1] = False
    after_text &= ~opens[1:]
    start = np.where(space, (before != _SPACE) | after_text, (before != kind) & ~((before == _SPACE) & prior_blank))
    start |= opens[:m]
    marks = np.flatnonzero((point == 39) & start)
    if marks.size:
        far = np.concatenate([point, np.zeros(3, np.int32)])
        closed = np.concatenate([opens, np.ones(3, bool)])
        start = np.concatenate([start, np.zeros(4, bool)])
        done = np.zeros(marks.size, bool)
        for suffix in CONTRACTIONS:
            fits = ~done
            for k, letter in enumerate(suffix, 1):
                fits &= (far[np.minimum(marks + k, m + 2)] == ord(letter)) & ~closed[np.minimum(marks + k, m + 3)]
            hit = marks[fits]
            start[hit + 1] = False
            start[hit + 1 + len(suffix)] = True
            done |= fits
        start = start[:m]
    return at[start] if n else at


def _mix(x: np.ndarray, salt) -> np.ndarray:
    x = (x ^ salt) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second eight bytes of each slice of at most 16 bytes; ``data`` has 16 bytes to spare."""
    view = np.ndarray((data.size - 7,), "<u8", data, 0, (1,))
    low_bits = (np.minimum(lengths, 8) * 8).astype(_U)
    high_bits = (np.clip(lengths - 8, 0, 8) * 8).astype(_U)
    full = _U(0xFFFFFFFFFFFFFFFF)
    low = view[starts] & (full >> (_U(64) - np.maximum(low_bits, _U(1)))) * (low_bits > 0)
    high = view[starts + 8] & np.where(high_bits > 0, full >> (_U(64) - np.maximum(high_bits, _U(1))), _U(0))
    return low, high


class PerfectHash:
    """Minimal perfect hash over keys of (low, high, length), with one displacement per bucket.

    ``find`` gives the value of each key, or -1 where the key isn't one of those it was built from.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, value: np.ndarray):
        n = self.size = low.size
        code = self._code(low, high, length)
        self.buckets = max(1, n // 3)
        bucket = (code % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, _U)
        taken = np.zeros(n, bool)
        slot = np.empty(n, np.int64)
        sizes = edges[1:] - edges[:-1]
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            own = code[order[edges[b] : edges[b + 1]]]
            for base in range(1, 1 << 22, 128):
                shifts = np.arange(base, base + 128).astype(_U)
                places = np.sort((_mix(own[:, None], shifts) % _U(n)).astype(np.int64), axis=0)
                free = ~(taken[places].any(axis=0) | (places[1:] == places[:-1]).any(axis=0))
                if free.any():
                    self.shift[b] = shifts[free.argmax()]
                    break
            else:
                raise ValueError("equal keys")
            place = (_mix(own, self.shift[b]) % _U(n)).astype(np.int64)
            slot[order[edges[b] : edges[b + 1]]] = place
            taken[place] = True
        # A bucket of one key names one of the places left over.
        single = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(~taken)
        self.shift[single] = _DIRECT | rest.astype(_U)
        slot[order[edges[single]]] = rest
        self.low, self.high, self.length, self.value = (np.empty_like(x) for x in (low, high, length, value))
        for to, x in ((self.low, low), (self.high, high), (self.length, length), (self.value, value)):
            to[slot] = x

    @staticmethod
    def _code(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        return _mix(low ^ _mix(high, _U(0xA5A5)) ^ length.astype(_U), _U(0x51ED))

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value or -1 of each key, and the keys' hash codes."""
        code = self._code(low, high, length)
        shift = self.shift[(code % _U(self.buckets)).astype(np.int64)]
        place = np.where(shift >= _DIRECT, shift ^ _DIRECT, _mix(code, shift) % _U(self.size)).astype(np.int64)
        same = (self.low[place] == low) & (self.high[place] == high) & (self.length[place] == length)
        return np.where(same, self.value[place], -1), code


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equal ones.

    A heap has the pairs by rank and place; bytes are linked to their neighbours, so a merge takes
    logarithmic time and a long pre-token isn't scanned again.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = stop, nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Both tiers over one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.classes = char_classes()
        short = [(t, i) for t, i in ranks.items() if len(t) <= 16]
        blob = np.frombuffer(b"".join(t.ljust(16, b"\0") for t, _ in short) + bytes(16), np.uint8)
        lengths = np.array([len(t) for t, _ in short], np.int64)
        low, high = _words(blob, np.arange(len(short)) * 16, lengths)
        self.whole = PerfectHash(low, high, lengths, np.array([i for _, i in short], np.int64))
        self.cache: dict[bytes, np.ndarray] = {}

    def ids(self, piece: bytes) -> np.ndarray:
        """Ids of one pre-token."""
        found = self.cache.get(piece)
        if found is None:
            whole = self.ranks.get(piece)
            found = np.array([whole] if whole is not None else merge(piece, self.ranks), np.int32)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and, for each text, how many; text i is ``data[offsets[i]:offsets[i + 1]]``."""
        counts = np.zeros(offsets.size - 1, np.int64)
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not filled.size:
            return np.zeros(0, np.int32), counts
        starts = token_starts(data, offsets[:-1][filled], self.classes)
        lengths = np.diff(np.r_[starts, data.size])
        spare = np.concatenate([data, np.zeros(16, np.uint8)])
        low, high = _words(spare, starts, np.minimum(lengths, 16))
        value, code = self.whole.find(low, high, lengths)
        miss = np.flatnonzero(value < 0)
        size = np.ones(starts.size, np.int64)
        source, base = value, np.zeros(starts.size, np.int64)
        if miss.size:
            order = np.argsort(code[miss], kind="stable")
            m = miss[order]
            same = (code[m][1:] == code[m][:-1]) & (low[m][1:] == low[m][:-1]) & (high[m][1:] == high[m][:-1]) & (lengths[m][1:] == lengths[m][:-1]) & (lengths[m][1:] <= 16)
            head = np.flatnonzero(np.r_[True, ~same])
            text = data.tobytes()
            parts = [self.ids(text[a:b]) for a, b in zip(starts[m[head]].tolist(), (starts[m[head]] + lengths[m[head]]).tolist())]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            pool = np.concatenate(parts)
            group = np.cumsum(np.r_[True, ~same]) - 1
            size[m] = sizes[group]
            base[m] = (np.cumsum(sizes) - sizes)[group]
        end = np.cumsum(size)
        flat = np.empty(end[-1], np.int32)
        hit = value >= 0
        flat[(end - size)[hit]] = source[hit]
        if miss.size:
            span = size[miss]
            first = np.cumsum(span) - span
            inner = np.arange(span.sum()) - np.repeat(first, span)
            flat[np.repeat((end - size)[miss], span) + inner] = pool[np.repeat(base[miss], span) + inner]
        of_text = np.searchsorted(starts, offsets)
        upto = np.r_[0, end]
        counts = upto[of_text[1:]] - upto[of_text[:-1]]
        return flat, counts


def load_ranks(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Rank of every token of a ``.tiktoken`` file."""
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.cache
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary: built once by the driver and broadcast, a few MB whatever the data."""
    return Encoder(load_ranks(folder, vocabulary))


def encode_array(texts: pa.Array, tool: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, ids, counts`` for consecutive rows, about :data:`PIECE_BYTES` of text at a time."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else texts
    if not len(texts):
        return
    _, offset_buffer, value_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = np.frombuffer(value_buffer, np.uint8) if value_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1]
        yield first, last, *tool.encode(values[own[0] : own[-1]], own - own[0])
        first = last


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids ARRAY<INT>`` of every row, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts give an empty list; every row
    comes out once, repeated rows as often as they occur. Whole texts are encoded, however long.
    """

    shared = docs.sparkSession.sparkContext.broadcast(encoder(folder, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            for first, last, ids, counts in encode_array(batch.column(1), tool):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.record_batch([batch.column(0).slice(first, last - first), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("texto")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, <keep...>, n_tokens BIGINT`` of every row; 0 for empty and null texts."""

    shared = docs.sparkSession.sparkContext.broadcast(encoder(folder, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            for first, last, _, counts in encode_array(batch.column(batch.num_columns - 1), tool):
                part = batch.slice(first, last - first)
                yield pa.record_batch([*part.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("__texto"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, n_tokens bigint")
