"""Problems 3 and 6 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import communities, neighbors, queries

SCHEMA = "seq_documento int, pagina int, vetor array<float>, t string"


def _clustered(rng, groups, size, dim=128, spread=0.035):
    centers = rng.standard_normal((groups, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    rows = (centers[:, None, :] + spread * rng.standard_normal((groups, size, dim))).reshape(-1, dim)
    return rows * rng.uniform(0.5, 3, (len(rows), 1))


def _frame(spark, matrix, extra=()):
    rows = [(i, 1, [float(x) for x in v], "2024-01-01 00:00:00") for i, v in enumerate(matrix)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).withColumn("dthr", F.col("t").cast("timestamp")).withColumn("id", F.lit("choque"))


def _dirty(matrix):
    n = len(matrix)
    old = [float(x) for x in matrix[1]]
    return [
        (0, 1, [0.5] * 128, "2020-01-01 00:00:00"), (2, 1, [float(x) for x in matrix[2]], "2024-01-01 00:00:00"), (n, 1, None, "2024-01-01 00:00:00"), (n + 1, 1, [0.0] * 128, "2024-01-01 00:00:00"),
        (n + 2, 1, [float("nan")] * 128, "2024-01-01 00:00:00"), (n + 3, 1, [1.0] * 64, "2024-01-01 00:00:00"), (n + 4, 1, [1.0] * 127 + [None], "2024-01-01 00:00:00"), (n + 5, 1, old, "2024-01-01 00:00:00"),
        (n + 5, 1, None, "2025-01-01 00:00:00"), (None, 1, old, "2024-01-01 00:00:00"), (n + 6, 1, [float("inf")] + [1.0] * 127, None), (n + 7, 1, old, None),
    ]


def test_usable_vectors_in_force(spark):
    matrix = _clustered(np.random.default_rng(1), 2, 3)
    found = {r["id"]: r["vetor"] for r in neighbors.usable(_frame(spark, matrix, _dirty(matrix))).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 5, 13}
    assert np.allclose([np.linalg.norm(v) for v in found.values()], 1, atol=1e-6)
    assert np.allclose(found[0], matrix[0] / np.linalg.norm(matrix[0]), atol=1e-6)


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(2)
    matrix = np.vstack([_clustered(rng, 30, 30), _clustered(rng, 1, 300)])
    matrix[10] = matrix[11] = matrix[12]
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sims, -2)
    expected = set()
    for i, row in enumerate(sims):
        for j in np.argsort(-row, kind="stable")[:5]:
            if row[j] > 0.7:
                expected.add((min(i, int(j)), max(i, int(j))))
    found = neighbors.unordered(neighbors.most_similar(neighbors.usable(_frame(spark, matrix)), leaf=100))
    got = {tuple(r) for r in found.collect()}
    assert len(expected & got) / len(expected) > 0.95
    assert len(expected & got) / len(got) > 0.95
    assert {(10, 11), (10, 12), (11, 12)} <= got


def test_copies_tie_to_smaller_documents(spark):
    rows = np.tile(_clustered(np.random.default_rng(3), 1, 1), (9, 1))
    got = {(r["id"], r["viz"]) for r in neighbors.most_similar(neighbors.usable(_frame(spark, rows))).collect()}
    assert got == {(i, j) for i in range(9) for j in [x for x in range(9) if x != i][:5]}


def test_greedy_search_reaches_brute_force(spark):
    rng = np.random.default_rng(4)
    matrix = _clustered(rng, 10, 40, spread=0.06)
    nodes = neighbors.usable(_frame(spark, matrix))
    graph = neighbors.neighbor_graph(nodes, leaf=100)
    asked = nodes.where("id % 50 = 0").select(F.col("id").alias("q"), "vetor")
    got = {(r["q"], r["v"]) for r in neighbors.greedy_search(asked, nodes, graph, k=5, entries=64).collect()}
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    expected = {(i, int(j)) for i in range(0, len(matrix), 50) for j in np.argsort(-np.round(unit[i] @ unit.T, 6), kind="stable")[:5]}
    assert len(expected & got) / len(expected) >= 0.9


def test_search_reaches_groups_without_entry(spark, tmp_path):
    """More groups than entries, no links between them, and copies of an asked document."""
    matrix = _clustered(np.random.default_rng(8), 60, 40)
    matrix[101] = matrix[102] = matrix[100]
    _frame(spark, matrix).write.parquet(str(tmp_path / "vetores.parquet"))
    got = {(r[0], r[1]) for r in queries.p3_search(spark, str(tmp_path)).collect()}
    unit = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)
    expected = set()
    for i in range(0, len(matrix), 50):
        sims = np.round(unit @ unit[i], 6)
        sims[i] = -2
        expected |= {(i, int(j)) for j in np.argsort(-sims, kind="stable")[:5]}
    assert len(got) == len(expected)
    assert {(100, 101), (100, 102)} <= got
    assert len(expected & got) / len(expected) >= 0.97


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA).withColumn("dthr", F.col("t").cast("timestamp"))
    one = _frame(spark, _clustered(np.random.default_rng(5), 1, 1))
    for df in (empty, one):
        vectors = neighbors.usable(df)
        assert neighbors.most_similar(vectors).count() == 0
        assert communities.document_groups(vectors).count() == 0


def test_groups_are_found_whole(spark):
    rng = np.random.default_rng(6)
    matrix = np.vstack([_clustered(rng, 1, 250), _clustered(rng, 12, 8), _clustered(rng, 40, 1)])
    matrix[3] = matrix[4]
    matrix[-1] = matrix[-2]
    vectors = neighbors.usable(_frame(spark, matrix))
    groups = communities.document_groups(vectors, leaf=60).cache()
    got = {(r["id"], r["grupo"]) for r in groups.collect()}
    expected = {(i, 0) for i in range(250)} | {(250 + 8 * g + k, 250 + 8 * g) for g in range(12) for k in range(8)} | {(384, 384), (385, 384)}
    assert got == expected
    shown = communities.described(groups, vectors).collect()
    assert {r["seq_documento"] for r in shown} == {i for i, _ in got}
    big = [r for r in shown if r["grupo"] == 1]
    assert len(big) == 250 and all(r["tamanho"] == 250 for r in big)
    assert sum(r["centroide"] for r in shown) == 14
    assert sorted(r["ordem"] for r in big if r["ordem"]) == [1, 2, 3]
    assert all(abs(r["sim"] - 1) < 1e-5 for r in shown if r["centroide"])


def test_modularity_splits_at_full_resolution(spark):
    def clique(first, n):
        return [(a, b, 1.0) for a in range(first, first + n) for b in range(a + 1, first + n)]

    links = spark.createDataFrame(clique(0, 6) + clique(10, 6) + [(0, 10, 1.0)], "a long, b long, w double")
    whole = {r["grupo"] for r in communities.communities(links).collect()}
    assert len(whole) == 1
    split = {r["v"]: r["grupo"] for r in communities.communities(links, resolution=1.0).collect()}
    assert len({split[v] for v in range(6)}) == 1 and split[0] != split[11]
