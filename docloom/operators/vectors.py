"""Vector expressions, exact similarity joins in blocks, search, and label suggestion and review.

Two routes to similarities: expressions over arrays for single pairs, and for joins a blocked product in
which each pair of blocks is one matrix multiplication. The blocked join is exact and its cost is that of all pairs;
the block count is a parameter, so no task grows with the data. Blocks are written once and read by each task that needs
them, so the disk used grows with the vectors, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.textclean import let
from docloom.session import cut, free

#: Rows of a block of the blocked join, on average; rows of one product within a task.
BLOCK_ROWS, SLAB = 8_192, 256
#: Similarities are the same if they agree to so many places; a limit holds up to half a unit of the last.
PLACES, SLACK = 12, 5e-13
#: Most parts that blocks are kept in; beyond, a task works on several pairs of blocks, one after the other. Least, if there are rows.
MOST_PARTS, LEAST_PARTS, FEW_ROWS = 141, 4, 1_000


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision; an error where the lengths differ, null where either is null."""
    same = F.assert_true(F.coalesce(F.size(a) == F.size(b), F.lit(True)), "vectors of different length")
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.isnull(same), product)


def norm(v: Column) -> Column:
    """Euclidean norm in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Vector of unit length; null for a null, empty, all-zero or non-finite one."""
    # The norm is taken out of the lambda, which would compute it again for each element.
    return let(norm(v), lambda size: F.when((size > 0) & (size < float("inf")), F.transform(v, lambda x: x.cast("double") / size)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def similarity(a: Column, b: Column, distance: str = "cosine") -> Column:
    """Cosine for ``c`` and ``cosine``; for any other name one minus the euclidean distance, which may be negative."""
    if distance.lower() in ("c", "cosine"):
        return cosine(a, b)
    same = F.assert_true(F.coalesce(F.size(a) == F.size(b), F.lit(True)), "vectors of different length")
    square = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.isnull(same), 1 - F.sqrt(square))


def parse_vector(text: Column) -> Column:
    """A vector from JSON text ``[0.1, ...]``, as single precision; null for what is none."""
    return F.from_json(text, "array<float>")


def percent(threshold: float) -> float:
    """A threshold as a share: above 1 it is a percentage, else it is cut to whole percents.

    >>> percent(90), percent(0.29), percent(1)
    (0.9, 0.28, 1.0)
    """
    return threshold / 100 if threshold > 1 else int(threshold * 100) / 100


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v``: one usable vector per identifier, not scaled; of repeated identifiers the largest in array order.

    Single precision stays single, which takes half the room on disk.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    good = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    size = norm(F.col("v"))
    return good.groupBy("id").agg(F.max("v").alias("v")).where((size > 0) & (size < float("inf")))


def sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v``: the vectors of :func:`usable` at unit length, in double precision."""
    return usable(vectors, id_col, vec_col).select("id", normalize(F.col("v")).alias("v"))


def in_force(vectors: DataFrame, id_col: str = "seq_documento", vec_col: str = "vetor", time_col: str = "dthr", page_col: str = "pagina", dim: int = 128) -> DataFrame:
    """``id_col, vec_col``: the vector in force of every document, where it is usable.

    In force is the row with the latest time (a null time is the earliest), of rows of the same time the one with the
    largest page, then vector. Only then null, all-zero and non-finite vectors, vectors with null elements and
    those of another length than ``dim`` are left out: a document whose vector in force is unusable has none.
    """
    last = vectors.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.struct(time_col, page_col, vec_col))[vec_col].alias(vec_col))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return last.where((F.size(vec_col) == dim) & F.forall(vec_col, finite) & F.exists(vec_col, lambda x: x != 0))


def _packed(rows: DataFrame, block_rows: int) -> DataFrame | None:
    """``b, dados``: the rows in blocks, each one value of Arrow's stream format, in the checkpoint folder; none of an empty table.

    Rows are dealt by hash of ``id`` unless they lie in a fitting number of parts already. They are counted: they should be cheap to read.
    """
    count = rows.count()
    if not count:
        return None
    wanted = min(max(-(-count // block_rows), min(LEAST_PARTS, -(-count // FEW_ROWS))), MOST_PARTS)
    parts = rows.rdd.getNumPartitions()
    # More parts than twice the blocks would make blocks small, fewer than half would leave cores idle.
    dealt = rows if wanted <= 2 * parts and parts <= min(2 * wanted, MOST_PARTS) else rows.repartition(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32

        def block(table: pa.Table) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table.combine_chunks())
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b", "dados"])

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= 2 * block_rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, block_rows))
                held, number = table.slice(block_rows).to_batches(), number + 1
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    return cut(dealt.mapInArrow(run, "b bigint, dados binary"))


def unit_matrix(table: pa.Table, scaled: bool = True) -> np.ndarray:
    """The vectors ``v`` of a table in double precision, at unit length if ``scaled``."""
    lists = table.column("v").combine_chunks()
    size = len(lists[0])
    if pc.any(pc.not_equal(pc.list_value_length(lists), size)).as_py():
        raise ValueError("vectors of different length")
    matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size).astype(np.float64)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True)) if scaled else matrix


def _product(left: DataFrame, right: DataFrame | None, schema: str, work, block_rows: int, scaled: bool, written: bool = True, merged=None) -> DataFrame:
    """``work(left, a, right, b, same)`` of every block of ``left`` with every one of ``right``, or each unordered pair of blocks of ``left``.

    No vector is shuffled or broadcast: a task reads the two blocks it multiplies. What comes out is written, then the blocks are deleted.
    Of rows that pairs of blocks have in common only what ``merged`` makes of them is written, so that their number doesn't count.
    If not ``written``, it goes to who reads it, once for each time it is read, and the blocks stay as long as something refers to them.
    """
    alone = right is None
    one = _packed(left, block_rows)
    two = one if alone or one is None else _packed(right, block_rows)
    if one is None or two is None:
        none = left.sparkSession.createDataFrame([], schema)
        return merged(none) if merged else none
    x = one.select(F.col("b").alias("i"), F.col("dados").alias("x")).hint("shuffle_replicate_nl")
    y = two.select(F.col("b").alias("j"), F.col("dados").alias("y"))
    pairs = x.join(y, F.col("i") <= F.col("j") if alone else F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            for row in range(batch.num_rows):
                lt, rt = (pa.ipc.open_stream(batch.column(side)[row].as_buffer()).read_all().combine_chunks() for side in ("x", "y"))
                a, b = unit_matrix(lt, scaled), unit_matrix(rt, scaled)
                if a.shape[1] != b.shape[1]:
                    raise ValueError("vectors of different length")
                yield from work(lt, a, rt, b, alone and i[row] == j[row])

    out = pairs.mapInArrow(run, schema)
    if not written:
        return out
    out = cut(merged(out) if merged else out)
    free(one)
    if two is not one:
        free(two)
    return out


def self_grid(rows: DataFrame, schema: str, work, block_rows: int = BLOCK_ROWS, written: bool = True, merged=None) -> DataFrame:
    """``work(left, a, right, b, same)`` for each unordered pair of blocks of ``rows``, which have ``id``, ``v`` and any further columns.

    ``left`` and ``right`` are tables, ``a`` and ``b`` their unit vectors, ``same`` tells a block with itself. All vectors must have one length.
    """
    return _product(rows, None, schema, work, block_rows, True, written, merged)


def grid(left: DataFrame, right: DataFrame, schema: str, work, block_rows: int = BLOCK_ROWS, scaled: bool = True, merged=None) -> DataFrame:
    """``work(left, a, right, b)`` for each block of ``left`` with each block of ``right``, as batches of ``schema``.

    Both sides have ``id`` and ``v`` (vectors of one length) and may have any further columns, of which ``work`` gets tables;
    ``a`` and ``b`` are the matrices, at unit length if ``scaled``. Each task holds two blocks of bounded size and nothing is
    broadcast. Both sides are counted: they should be cheap to read. An empty side gives no rows.
    """
    return _product(left, right, schema, lambda lt, a, rt, b, same: work(lt, a, rt, b), block_rows, scaled, merged=merged)


def hits(a: np.ndarray, b: np.ndarray, least: float, strict: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``x, y, s`` of all rows of two matrices of unit vectors with product ``s >= least`` (``strict``: above), a slab of ``a`` at a time.

    Products in single precision leave out what is surely below; the others are computed again in double precision.
    """
    doubt = (a.shape[1] + 8) * 2.0**-23
    low, other = a.astype(np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
    for start in range(0, len(a), SLAB):
        part = a[start : start + SLAB]
        found = np.flatnonzero(low[start : start + SLAB] @ other >= np.float32(least - doubt))
        if not found.size:
            continue
        x, y = np.divmod(found, len(b))
        if found.size * 32 > len(part) * len(b):
            s = (part @ b.T)[x, y]
        else:
            s = np.concatenate([np.einsum("ij,ij->i", part[x[k : k + 16_384]], b[y[k : k + 16_384]]) for k in range(0, found.size, 16_384)])
        keep = s > least if strict else s >= least
        if keep.any():
            yield start + x[keep], y[keep], s[keep]


def nearest(left: DataFrame, right: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, r, sim``: of each row of ``left`` the most similar row of ``right`` with ``sim >= least``, if there is one.

    ``right`` has a number ``r`` of its own; of rows as similar (to twelve places) the one with the smallest ``r`` comes out.
    """
    kind = left.schema["id"].dataType.simpleString()

    def work(lt, a, rt, b):
        numbers, ids = rt.column("r").to_numpy(), lt.column("id").combine_chunks()
        for x, y, s in hits(a, b, least - SLACK):
            sims = np.round(s, PLACES)
            order = np.lexsort((numbers[y], -sims, x))
            order = order[sims[order] >= least]
            first = order[np.r_[True, np.diff(x[order]) > 0]] if order.size else order
            yield pa.record_batch([ids.take(pa.array(x[first])), pa.array(numbers[y[first]]), pa.array(sims[first])], names=["id", "r", "sim"])

    first = lambda found: found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "r")).alias("m"))
    best = grid(left.select("id", "v"), right.select("id", "r", "v"), f"id {kind}, r bigint, sim double", work, block_rows, merged=first)
    return best.select("id", F.col("m.r").alias("r"), (-F.col("m.s")).alias("sim"))


def near_any(left: DataFrame, right: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id`` of each row of ``left`` with a row of ``right`` at least so similar."""
    kind = left.schema["id"].dataType.simpleString()

    def work(lt, a, rt, b):
        for x, _, _ in hits(a, b, least - SLACK):
            yield pa.record_batch([lt.column("id").combine_chunks().take(pa.array(np.unique(x)))], names=["id"])

    return grid(left.select("id", "v"), right.select("id", "v"), f"id {kind}", work, block_rows, merged=DataFrame.distinct)


def similar_pairs(vectors: DataFrame, above: float, id_col: str = "id", vec_col: str = "v", inclusive: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, sim`` of all pairs ``a < b`` with cosine above ``above`` (or equal, if ``inclusive``).

    Exact, in blocks. Unusable vectors are left out; of repeated identifiers one vector counts. Pairs are never kept:
    they are computed as they are read, since they may be many times the vectors.
    """
    rows = cut(usable(vectors, id_col, vec_col))
    kind = rows.schema["id"].dataType.simpleString()

    def work(lt, a, rt, b, same):
        left, right = lt.column("id").combine_chunks(), rt.column("id").combine_chunks()
        for x, y, s in hits(a, b, above, not inclusive):
            if same:
                keep = x < y
                x, y, s = x[keep], y[keep], s[keep]
            first, second = left.take(pa.array(x)), right.take(pa.array(y))
            swap = pc.greater(first, second)
            yield pa.record_batch([pc.if_else(swap, second, first), pc.if_else(swap, first, second), pa.array(s, pa.float64())], names=["a", "b", "sim"])

    out = self_grid(rows, f"a {kind}, b {kind}, sim double", work, block_rows, written=False)
    free(rows)
    return out


def classes(rows: DataFrame) -> DataFrame:
    """``id, classe`` of vectors: those with equal unit vectors (to nine places) are one class, named by its smallest identifier."""
    keyed = cut(rows.select("id", F.md5(F.to_json(F.transform(normalize(F.col("v")), lambda x: F.round(x, 9))).cast("binary")).alias("k")))
    return keyed.join(keyed.groupBy("k").agg(F.min("id").alias("classe")), "k").select("id", "classe")


def link_counts(vectors: DataFrame, above: float, id_col: str = "id", vec_col: str = "v", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, classe, ligacoes`` of every usable vector: its class and the number of others with cosine above ``above``.

    The similarity join as one row per vector: links are counted inside the blocks and never written out. Equal unit vectors
    are one class, named by its smallest identifier, and link to each other.
    """
    rows = cut(usable(vectors, id_col, vec_col))
    kind = rows.schema["id"].dataType.simpleString()

    def work(lt, a, rt, b, same):
        one, two = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for x, y, _ in hits(a, b, above, True):
            if same:
                x = x[x != y]
            one += np.bincount(x, minlength=len(a))
            two += np.bincount(y, minlength=len(b))
        # Each block with itself gives all its rows; what else is zero isn't written.
        for table, n in ((lt, one),) if same else ((lt, one), (rt, two)):
            some = np.arange(len(n)) if same else np.flatnonzero(n)
            yield pa.record_batch([table.column("id").combine_chunks().take(pa.array(some)), pa.array(n[some])], names=["id", "n"])

    counts = self_grid(rows, f"id {kind}, n bigint", work, block_rows, merged=lambda found: found.groupBy("id").agg(F.sum("n").alias("ligacoes")))
    return counts.join(classes(rows), "id").select("id", "classe", "ligacoes")


def weighted_degrees(rows: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, ligacoes, soma`` of vectors ``id, v, m``: the others at least so similar, each counted ``m`` times, and
    their summed similarity. Counted inside the blocks: no link is written. A vector's own copies, ``m - 1``, count too."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(lt, a, rt, b, same):
        m, w = lt.column("m").to_numpy(), rt.column("m").to_numpy()
        one, two = (np.zeros(len(a), np.int64), np.zeros(len(a))), (np.zeros(len(b), np.int64), np.zeros(len(b)))
        for x, y, s in hits(a, b, least - SLACK):
            if same:
                keep = x != y
                x, y, s = x[keep], y[keep], s[keep]
            for (links, total), at, times in ((one, x, w[y]), (two, y, m[x])):
                links += np.bincount(at, times, len(links)).astype(np.int64)
                total += np.bincount(at, times * s, len(total))
        for table, (links, total) in ((lt, one),) if same else ((lt, one), (rt, two)):
            some = np.arange(len(links)) if same else np.flatnonzero(links)
            yield pa.record_batch([table.column("id").combine_chunks().take(pa.array(some)), pa.array(links[some]), pa.array(total[some])], names=["id", "n", "s"])

    total_of = lambda found: found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = self_grid(rows.select("id", "m", "v"), f"id {kind}, n bigint, s double", work, block_rows, merged=total_of)
    return found.join(rows.select("id", "m"), "id").select("id", (F.col("n") + F.col("m") - 1).alias("ligacoes"), (F.col("s") + F.col("m") - 1).alias("soma"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """``id_1, id_2, sim`` in both directions."""
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
    return pairs.select(both, "sim").select(F.col("e.x").alias("id_1"), F.col("e.y").alias("id_2"), "sim")


def similar_view(vectors: DataFrame, above: float = 0.7) -> DataFrame:
    """The similarity view: ``seq_documento_1, seq_documento_2, pagina_1, pagina_2, dthr_1, dthr_2, sim, sim_100``.

    Both directions of all pairs of different documents whose cosine is above the limit. ``vectors`` has
    ``seq_documento, pagina, vetor, dthr``; of repeated documents the row with the latest time counts.
    """
    last = vectors.groupBy("seq_documento").agg(F.max(F.struct("dthr", "pagina", "vetor")).alias("m")).select("seq_documento", "m.dthr", "m.pagina", "m.vetor")
    pairs = mirrored(similar_pairs(last, above, "seq_documento", "vetor"))
    side = lambda n: last.select(F.col("seq_documento").alias(f"id_{n}"), F.col("pagina").alias(f"pagina_{n}"), F.col("dthr").alias(f"dthr_{n}"))
    joined = pairs.join(side(1), "id_1").join(side(2), "id_2")
    return joined.select(F.col("id_1").alias("seq_documento_1"), F.col("id_2").alias("seq_documento_2"), "pagina_1", "pagina_2", "dthr_1", "dthr_2", "sim", F.round(F.col("sim") * 100, 2).alias("sim_100"))


def search(vectors: DataFrame, queries: DataFrame, above: float, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``q, id, sim`` of every vector similar to each query vector (``q, v``), the most similar first.

    The stated queries against all vectors, in blocks.
    """
    base, asked = cut(usable(vectors, id_col, vec_col)), cut(usable(queries, "q", "v"))
    kinds = base.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()

    def work(lt, a, rt, b):
        for x, y, s in hits(a, b, above, True):
            yield pa.record_batch([rt.column("id").combine_chunks().take(pa.array(y)), lt.column("id").combine_chunks().take(pa.array(x)), pa.array(s)], names=["q", "id", "sim"])

    return grid(base, asked, f"q {kinds[1]}, id {kinds[0]}, sim double", work).where("q <> id").orderBy("q", F.desc("sim"), "id")


def top_similar(pairs: DataFrame, k: int) -> DataFrame:
    """``id_1, id_2, sim, ordem``: of each vector its ``k`` most similar; ties to the smaller identifier."""
    window = Window.partitionBy("id_1").orderBy(F.desc("sim"), "id_2")
    return mirrored(pairs).withColumn("ordem", F.row_number().over(window)).where(F.col("ordem") <= k)


def label_review(pairs: DataFrame, labels: DataFrame, similar: float) -> DataFrame:
    """``a, b, sim, rotulo_a, rotulo_b``: similar pairs whose labels differ. ``labels`` has ``id, rotulo``."""
    tagged = pairs.where(F.col("sim") >= similar).join(labels.select(F.col("id").alias("a"), F.col("rotulo").alias("rotulo_a")), "a").join(labels.select(F.col("id").alias("b"), F.col("rotulo").alias("rotulo_b")), "b")
    return tagged.where("rotulo_a <> rotulo_b").select("a", "b", "sim", "rotulo_a", "rotulo_b")


def label_suggestions(pairs: DataFrame, labels: DataFrame, similar: float, only_missing: bool = True) -> DataFrame:
    """``id, rotulo, sim, votos``: for vectors without a label, the one of their similar neighbours with most votes.

    Ties go to the higher similarity, then to the smaller label. Without ``only_missing`` vectors with a label get one too,
    from their neighbours alone.
    """
    near = mirrored(pairs.where(F.col("sim") >= similar))
    known = labels.select(F.col("id").alias("id_2"), "rotulo").where("rotulo IS NOT NULL")
    asked = near.join(known.select(F.col("id_2").alias("id_1")), "id_1", "left_anti") if only_missing else near
    open_ = asked.join(known, "id_2")
    votes = open_.groupBy(F.col("id_1").alias("id"), "rotulo").agg(F.count(F.lit(1)).alias("votos"), F.max("sim").alias("sim"))
    best = Window.partitionBy("id").orderBy(F.desc("votos"), F.desc("sim"), "rotulo")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "rotulo", "sim", "votos")
