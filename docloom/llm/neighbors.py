"""Problem 3: the most similar other vectors of every vector.

NN-descent. Equal vectors are folded into one node first, so copies cost nothing and tie exactly.
A few random-projection trees, whose cuts are fitted on a bounded sample and through which every
vector is sent, give each node its first neighbours by comparing all pairs within a leaf. Then
rounds of joins bring each node's vector to the nodes around it, where neighbours of neighbours are
compared; each node keeps its best ``width``. New queries walk the finished graph greedily.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

#: The graph keeps so many neighbours of each node while it is built.
WIDTH = 16
#: Random-projection trees for the first neighbours, and vectors a leaf holds on average.
TREES, LEAF = 8, 400
#: Vectors on which the trees' cuts are fitted (a bound, whatever the input).
SAMPLE = 20_000
#: Rounds of neighbours of neighbours.
ROUNDS = 3
SEED = 7


def usable(vectors: DataFrame, id_col: str = "seq_documento", vec_col: str = "vetor", time_col: str = "dthr", dim: int = 128) -> DataFrame:
    """``id, vetor``: the usable vector in force of every document, of unit length.

    In force is the row with the latest time (a null time is the earliest); of different vectors of the same
    time the largest in array order counts. Null, all-zero and non-finite vectors, vectors with null
    elements and those of another length than ``dim`` are unusable, and a document whose vector in force is
    unusable has none. Extra columns are ignored.
    """
    held = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vetor"), F.col(time_col).alias("t")).where("id IS NOT NULL")
    last = held.groupBy("id").agg(F.max(F.struct("t", "vetor"))["vetor"].alias("vetor")).where(F.size("vetor") == dim)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vetor").flatten()
            raw = flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            good = np.isfinite(raw).all(1)
            size = np.sqrt(np.einsum("ij,ij->i", raw[good], raw[good]))
            keep = np.flatnonzero(good)[size > 0]
            unit = (raw[good][size > 0] / size[size > 0, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim, dtype=np.int32)), pa.array(unit.ravel()))
            yield pa.record_batch([batch.column("id").take(pa.array(keep)), lists], names=["id", "vetor"])

    kind = last.schema["id"].dataType.simpleString()
    return last.mapInArrow(scale, f"id {kind}, vetor array<float>")


def fold(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, vetor`` (the smallest document of each distinct vector) and members ``no, id``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vetor").flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else []
            # Adding zero makes the two zeros one.
            keys = [hashlib.blake2b((row + np.float32(0)).tobytes(), digest_size=16).digest() for row in rows]
            yield pa.record_batch([batch.column("id"), batch.column("vetor"), pa.array(keys, pa.binary())], names=["id", "vetor", "chave"])

    kind = vectors.schema["id"].dataType.simpleString()
    digest = cut(vectors.select("id", "vetor").mapInArrow(mark, f"id {kind}, vetor array<float>, chave binary"))
    nodes = digest.groupBy("chave").agg(F.min("id").alias("no"))
    members = digest.select("chave", "id").join(nodes, "chave").select("no", "id")
    return digest.join(nodes.select(F.col("no").alias("id")), "id", "left_semi").select("id", "vetor"), members


class Forest:
    """Trees of cuts halfway through a sample, each along the line between two of its vectors.

    A node that fewer than ``FEW`` sampled vectors reach is cut along an axis of its level at zero, so the number
    of axes stays below ``2 * SAMPLE / FEW`` a tree, however deep the trees are.
    """

    FEW = 24

    def __init__(self, sample: np.ndarray, total: int, trees: int, leaf: int, seed: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.trees = []
        for _ in range(trees):
            axes = [*rng.standard_normal((self.depth + 1, dim)).astype(np.float32)]
            cuts = [0.0] * len(axes)
            level_of = [[] for _ in range(self.depth)]
            where = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                order = np.argsort(where, kind="stable")
                edges = np.r_[0, np.flatnonzero(np.diff(where[order])) + 1, len(order)]
                known = {}
                for x, y in zip(edges[:-1], edges[1:]):
                    own = order[x:y]
                    if own.size >= self.FEW:
                        one, two = sample[rng.choice(own, 2, replace=False)]
                        axis = one - two if np.any(one != two) else axes[level]
                        known[int(where[own[0]])] = len(axes)
                        cuts.append(float(np.median(sample[own] @ axis)))
                        axes.append(axis)
                level_of[level] = known
                row = np.fromiter((known.get(w, level) for w in where.tolist()), np.int64, len(where))
                side = np.einsum("ij,ij->i", sample, np.array(axes)[row]) > np.array(cuts)[row]
                where = 2 * where + side
            self.trees.append((np.array(axes, np.float32), np.array(cuts, np.float32), level_of))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.empty((len(vectors), len(self.trees)), np.int64)
        for t, (axes, cuts, level_of) in enumerate(self.trees):
            where = np.zeros(len(vectors), np.int64)
            for level, known in enumerate(level_of):
                row = np.fromiter((known.get(w, level) for w in where.tolist()), np.int64, len(where))
                where = 2 * where + (np.einsum("ij,ij->i", vectors, axes[row]) > cuts[row])
            out[:, t] = where
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32, copy=False)


def _best_pairs(ids: np.ndarray, vectors: np.ndarray, width: int, floor: float, anchors: bool = False, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's ``width`` most similar other rows, in blocks of rows; ties to the smaller id.

    ``anchors``: also the first row, by id, that is similar enough. Such links span a dense group that the best ones may not.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    us, vs, sims = [], [], []
    for start in range(0, len(ids), block):
        sim = vectors[start : start + block] @ vectors.T
        rows = np.arange(sim.shape[0])
        sim[rows, start + rows] = -2
        if sim.shape[1] > width:
            best = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        else:
            best = np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
        value = np.take_along_axis(sim, best, 1)
        ok = value >= floor
        if anchors:
            near = sim >= floor
            first = near.argmax(1)
            far = near[rows, first]
            us.append(ids[start : start + block][far])
            vs.append(ids[first[far]])
            sims.append(sim[rows, first][far])
        us.append(np.repeat(ids[start : start + block], ok.sum(1)))
        vs.append(ids[best[ok]])
        sims.append(value[ok])
    return np.concatenate(us), np.concatenate(vs), np.concatenate(sims)


_EDGE = "u bigint, v bigint, sim float"


def _edges_batch(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float32())], names=["u", "v", "sim"])


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(starts[:-1], starts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _top(edges: DataFrame, width: int) -> DataFrame:
    """The best ``width`` distinct neighbours of each ``u`` as one row ``u, viz ARRAY<STRUCT<sim, v>>``."""
    merged = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = merged.groupBy("u").agg(F.sort_array(F.collect_list(F.struct(F.col("sim"), (-F.col("v")).alias("menos"))), asc=False).alias("viz"))
    return ranked.select("u", F.transform(F.slice("viz", 1, width), lambda x: F.struct(x["sim"].alias("sim"), (-x["menos"]).alias("v"))).alias("viz"))


def _first_edges(nodes: DataFrame, forest: Forest, dim: int, width: int, floor: float, limit: int, anchors: bool = False) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(forest)
    trees = len(forest.trees)

    def plant(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.leaves(_matrix(batch.column("vetor"), dim))
                for t in range(trees):
                    yield pa.record_batch([pa.array(leaves[:, t] * trees + t), batch.column("id").cast(pa.int64()), batch.column("vetor")], names=["folha", "id", "vetor"])

    def compare(batches):
        for leaf in _grouped(batches, "folha"):
            leaf = leaf.combine_chunks()
            ids, vectors = leaf.column("id").to_numpy(), _matrix(leaf.column("vetor").combine_chunks(), dim)
            # A leaf beyond the limit (the sample missed a dense spot) is halved along random axes.
            rng = np.random.default_rng(len(ids))
            parts = [np.arange(len(ids))]
            while parts:
                part = parts.pop()
                if part.size > limit:
                    by = part[np.argsort(vectors[part] @ rng.standard_normal(dim).astype(np.float32), kind="stable")]
                    parts += [by[: part.size // 2], by[part.size // 2 :]]
                elif part.size > 1:
                    yield _edges_batch(*_best_pairs(ids[part], vectors[part], width, floor, anchors))

    planted = nodes.mapInArrow(plant, "folha bigint, id bigint, vetor array<float>")
    return planted.repartition("folha").sortWithinPartitions("folha").mapInArrow(compare, _EDGE)


def _round(nodes: DataFrame, graph: DataFrame, dim: int, width: int, floor: float) -> DataFrame:
    """Edges found among the neighbours of every node: the local join of NN-descent.

    Around each node meet its own neighbours and the nodes that chose it. A node chosen by very many
    (a hub) has its circle split by a salt of the members into rooms of about ``4 * width``; each room
    also gets the node's own neighbours, so nobody is left out and no room grows with the data.
    """
    own = graph.select(F.col("u").alias("c"), F.explode("viz").alias("x")).select("c", F.col("x.v").alias("m"))
    fans = own.select(F.col("m").alias("c"), F.col("c").alias("m"))
    rooms = fans.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * width)).cast("int").alias("salas"))
    placed = fans.join(rooms, "c").select("c", F.pmod(F.xxhash64("m"), F.col("salas")).cast("int").alias("sala"), "m")
    everywhere = own.join(rooms, "c", "left").select("c", F.explode(F.sequence(F.lit(0), F.coalesce("salas", F.lit(1)) - 1)).alias("sala"), "m")
    circle = placed.unionByName(everywhere).distinct()
    seated = circle.join(nodes.select(F.col("id").cast("bigint").alias("m"), "vetor"), "m").select(F.xxhash64("c", "sala").alias("mesa"), "m", "vetor")

    def compare(batches):
        for table in _grouped(batches, "mesa"):
            table = table.combine_chunks()
            if table.num_rows > 1:
                ids, vectors = table.column("m").to_numpy(), _matrix(table.column("vetor").combine_chunks(), dim)
                ids, first = np.unique(ids, return_index=True)
                if ids.size > 1:
                    yield _edges_batch(*_best_pairs(ids, vectors[first], width, floor))

    return seated.repartition("mesa").sortWithinPartitions("mesa").mapInArrow(compare, _EDGE)


def neighbor_graph(nodes: DataFrame, dim: int = 128, width: int = WIDTH, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, floor: float = -1.0, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``u, viz ARRAY<STRUCT<sim FLOAT, v BIGINT>>`` of every node with a neighbour of at least ``floor``.

    ``nodes`` has ``id, vetor`` with unit vectors. ``viz`` is sorted by descending similarity, ties by id.
    """
    graph = cut(_top(leaf_edges(nodes, dim, width, trees, leaf, floor, sample, seed), width))
    return descend(nodes, graph, dim, width, rounds, floor)


def planted_forest(nodes: DataFrame, dim: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Projection trees fitted on a bounded sample of the nodes."""
    total = nodes.count()
    share = min(1.0, 1.3 * sample / max(1, total))
    drawn = nodes.select("vetor").sample(fraction=share, seed=seed).limit(sample) if share < 1 else nodes.select("vetor")
    rows = drawn.toArrow()
    fitted = _matrix(rows.column("vetor").combine_chunks(), dim) if rows.num_rows else np.zeros((0, dim), np.float32)
    return Forest(fitted, total, trees, leaf, seed)


def leaf_edges(nodes: DataFrame, dim: int, width: int = WIDTH, trees: int = TREES, leaf: int = LEAF, floor: float = -1.0, sample: int = SAMPLE, seed: int = SEED, anchors: bool = False) -> DataFrame:
    """``u, v, sim`` from all pairs within the leaves of the trees."""
    forest = planted_forest(nodes, dim, trees, leaf, sample, seed)
    return _first_edges(nodes, forest, dim, width, floor, 8 * leaf, anchors)


def descend(nodes: DataFrame, graph: DataFrame, dim: int, width: int = WIDTH, rounds: int = ROUNDS, floor: float = -1.0) -> DataFrame:
    """The graph after ``rounds`` rounds of neighbours of neighbours."""
    for _ in range(rounds):
        old = graph.select("u", F.explode("viz").alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.sim").alias("sim"))
        graph = cut(_top(_round(nodes, graph, dim, width, floor).unionByName(old), width))
    return graph


def graph_edges(graph: DataFrame) -> DataFrame:
    """``u, v, sim`` of a neighbour graph."""
    return graph.select("u", F.explode("viz").alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.sim").alias("sim"))


def most_similar(vectors: DataFrame, k: int = 5, above: float = 0.7, dim: int = 128, **options) -> DataFrame:
    """``id, viz BIGINT, sim``: of every document its at most ``k`` most similar others with ``sim > above``.

    ``vectors`` has ``id, vetor`` as :func:`usable` gives them. Copies of a vector have sim 1 with each other;
    ties go to the smaller id. Approximate in which neighbours are found; every ``sim`` is computed, none estimated.
    """
    nodes, members = fold(vectors)
    nodes, members = cut(nodes), cut(members)
    graph = neighbor_graph(nodes, dim, floor=above, **options)
    return expand(graph, members, k, above)


def expand(graph: DataFrame, members: DataFrame, k: int, above: float) -> DataFrame:
    """Neighbours of documents from those of nodes: the first ``k + 1`` copies of a node are enough for anyone."""
    first = members.groupBy("no").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("copias"))
    around = graph_edges(graph).where(F.col("sim") > above)
    reach = around.join(first.withColumnRenamed("no", "v"), "v").select(F.col("u").alias("no"), F.round("sim", 7).alias("sim"), F.explode("copias").alias("viz"))
    itself = first.where(F.size("copias") > 1).select("no", F.lit(1.0).cast("float").alias("sim"), F.explode("copias").alias("viz"))
    offer = reach.unionByName(itself)
    best = offer.groupBy("no").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("viz").alias("v"))), asc=True).alias("o"))
    best = best.select("no", F.slice("o", 1, k + 1).alias("o"))
    own = members.join(best, "no").select("id", F.slice(F.filter("o", lambda x: x["v"] != F.col("id")), 1, k).alias("o"))
    return own.select("id", F.explode("o").alias("x")).select("id", F.col("x.v").alias("viz"), (-F.col("x.s")).alias("sim"))


def unordered(similar: DataFrame) -> DataFrame:
    """One row per unordered pair that occurs in either direction: ``a < b``."""
    return similar.select(F.least("id", "viz").alias("a"), F.greatest("id", "viz").alias("b")).distinct()


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _leaf_starts(queries: DataFrame, nodes: DataFrame, forest: Forest, dim: int, beam: int) -> DataFrame:
    """``q, v``: the ``beam`` nodes most similar to each query in each of the leaves it falls into."""
    shared = nodes.sparkSession.sparkContext.broadcast(forest)
    trees = len(forest.trees)

    def plant(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.leaves(_matrix(batch.column("vetor"), dim))
                for t in range(trees):
                    yield pa.record_batch([pa.array(leaves[:, t] * trees + t), batch.column("id"), batch.column("pedida"), batch.column("vetor")], names=["folha", "id", "pedida", "vetor"])

    def compare(batches):
        for leaf in _grouped(batches, "folha"):
            leaf = leaf.combine_chunks()
            ids, vectors = leaf.column("id").to_numpy(), _matrix(leaf.column("vetor").combine_chunks(), dim)
            asked = leaf.column("pedida").to_numpy()
            q, v, own, rest = ids[asked], ids[~asked], vectors[asked], vectors[~asked]
            if not v.size:
                continue
            take = min(beam, v.size)
            for start in range(0, q.size, 1024):
                best = np.argpartition(-(own[start : start + 1024] @ rest.T), take - 1, axis=1)[:, :take]
                yield pa.record_batch([pa.array(np.repeat(q[start : start + 1024], take)), pa.array(v[best.ravel()])], names=["q", "v"])

    both = nodes.select(F.col("id").cast("bigint").alias("id"), F.lit(False).alias("pedida"), "vetor").unionByName(queries.select(F.col("q").cast("bigint").alias("id"), F.lit(True).alias("pedida"), "vetor"))
    planted = both.mapInArrow(plant, "folha bigint, id bigint, pedida boolean, vetor array<float>")
    return planted.repartition("folha").sortWithinPartitions("folha").mapInArrow(compare, "q bigint, v bigint")


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int = 5, beam: int = 16, entries: int = 32, dim: int = 128, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``q, v, sim``: the ``k`` nodes most similar to each query, by greedy walks over the graph.

    ``queries`` has ``q, vetor``. The walk of a query starts at the best nodes of its leaves in the projection trees
    and at ``entries`` nodes spread by hash, and at each step looks at the neighbours of the best ``beam`` nodes not
    yet looked at; it ends when no query has any.
    """
    ids = nodes.select(F.col("id").cast("bigint").alias("v"), "vetor")
    spread = ids.select("v").orderBy(F.xxhash64("v"), "v").limit(entries)
    ask = queries.select(F.col("q").cast("bigint").alias("q"), F.col("vetor").alias("p"))
    start = _leaf_starts(queries, nodes, planted_forest(nodes, dim, trees, leaf, sample, seed), dim, beam).unionByName(ask.select("q").crossJoin(F.broadcast(spread))).distinct()

    def judged(pairs: DataFrame) -> DataFrame:
        return pairs.join(ids, "v").join(ask, "q").select("q", "v", dot(F.col("p"), F.col("vetor")).alias("sim"))

    def best(pool: DataFrame) -> DataFrame:
        held = pool.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "v", "vista"))).alias("c"))
        return cut(held.select("q", F.explode(F.slice("c", 1, beam)).alias("x")).select("q", "x.v", (-F.col("x.s")).alias("sim"), "x.vista"))

    pool = best(judged(start).withColumn("vista", F.lit(False)))
    links = graph_edges(graph).select(F.col("u").alias("f"), F.col("v").alias("n"))
    # Links both ways, so that no node is out of reach only because nobody chose it.
    links = cut(links.unionByName(links.select(F.col("n").alias("f"), F.col("f").alias("n"))).distinct())
    # A node pushed out of a pool never returns, as the pool only gets better: the walks end.
    while True:
        fresh = pool.where("NOT vista").select("q", F.col("v").alias("f"))
        if fresh.isEmpty():
            break
        seen = pool.withColumn("vista", F.lit(True))
        reached = fresh.join(links, "f").select("q", F.col("n").alias("v")).distinct()
        added = judged(reached.join(seen.select("q", "v"), ["q", "v"], "left_anti")).withColumn("vista", F.lit(False))
        pool = best(seen.unionByName(added))
    ranked = pool.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "v"))), 1, k).alias("c"))
    return ranked.select("q", F.explode("c").alias("x")).select("q", F.col("x.v").alias("v"), (-F.col("x.s")).alias("sim"))


def search_documents(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``q, viz, sim``: the ``k`` most similar other documents of each query that is a document itself.

    ``found`` has ``q, v, sim`` with the ``k + 1`` most similar nodes; of a node with copies all are documents, and ties
    go to the smaller one, as in :func:`expand`.
    """
    first = members.groupBy(F.col("no").cast("bigint").alias("v")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("copias"))
    reach = found.join(first, "v").select("q", F.round("sim", 7).alias("sim"), F.explode("copias").alias("viz")).where("q <> viz")
    best = reach.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "viz"))), 1, k).alias("c"))
    return best.select("q", F.explode("c").alias("x")).select("q", "x.viz", (-F.col("x.s")).alias("sim"))
