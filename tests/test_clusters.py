"""Both clusterings against sequential models on random graphs with ties, and the audit of their results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import clusters
from docloom.operators import vectors as V


def _matrix(rng, n, dim=6, kinds=4):
    """Few distinct directions, so exact ties and copies occur."""
    pool = [[rng.choice([0.0, 1.0, 2.0]) for _ in range(dim)] for _ in range(kinds * 3)]
    pool = [p for p in pool if any(p)] or [[1.0] * dim]
    return [list(rng.choice(pool)) for _ in range(n)]


def _sims(matrix):
    m = np.array(matrix)
    m = m / np.sqrt((m * m).sum(1, keepdims=True))
    return np.array([[sum(a * b for a, b in zip(x, y)) for y in m] for x in m])


def _leader(matrix, limit):
    s = _sims(matrix)
    heads = []
    for i in range(len(matrix)):
        if not any(s[i][h] >= limit for h in heads):
            heads.append(i)
    owner = {}
    for i in range(len(matrix)):
        if i in heads:
            owner[i] = i
        else:
            owner[i] = max(heads, key=lambda h: (s[i][h], -h))
    sizes = {h: sum(o == h for o in owner.values()) for h in heads}
    order = []
    for i in range(len(matrix)):
        if sizes[owner[i]] > 1 and owner[i] not in order:
            order.append(owner[i])
    return {i: (order.index(o) + 1 if o in order else -1, int(o == i and o in order)) for i, o in owner.items()}


def _density(matrix, limit):
    s = _sims(matrix)
    n = len(matrix)
    near = {i: [j for j in range(n) if j != i and s[i][j] >= limit] for i in range(n)}
    rank = sorted((i for i in range(n) if near[i]), key=lambda i: (-len(near[i]), -round(sum(s[i][j] for j in near[i]), 9), i))
    free, heads = set(rank), []
    for i in rank:
        if i in free:
            heads.append(i)
            free -= {i, *near[i]}
    owner = {}
    for i in rank:
        mine = [h for h in heads if h in near[i]]
        if i in heads:
            owner[i] = i
        else:
            owner[i] = max(mine, key=lambda h: (s[i][h], heads.index(h)))
    sizes = {h: sum(o == h for o in owner.values()) for h in heads}
    order = sorted((h for h in heads if sizes[h] > 1), key=lambda h: (-sizes[h], h))
    return {i: (order.index(owner[i]) + 1 if i in owner and owner[i] in order else -1, bool(i in owner and owner[i] == i and i in order)) for i in range(n)}


@pytest.mark.parametrize("seed", range(2))
def test_leader_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    matrix = _matrix(rng, 28)
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(matrix)], "id int, v array<double>, grupo string")
    got = {r["id"]: (r["grupo"], r["centroide"]) for r in clusters.leader(df, 85).collect()}
    assert got == _leader(matrix, 0.85)


@pytest.mark.parametrize("seed", range(2))
def test_density_is_the_sequential_one_and_passes_its_audit(spark, seed):
    rng = random.Random(100 + seed)
    matrix = _matrix(rng, 26)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(matrix)], "seq_documento int, vetor array<double>")
    found = clusters.density(df, df, 88, session="s").cache()
    got = {r["seq_documento"]: (r["grupo"], r["centroide"]) for r in found.collect()}
    assert got == _density(matrix, 0.88)
    report = clusters.audit(found, df, "s", 88).orderBy("ordem").collect()
    assert [r["resultado"] for r in report[3:]] == ["ok"] * 5


def test_the_two_algorithms_differ_where_they_must(spark):
    """A path 1 - 2 - 3 and a lone vector: the first row leads one way, the one with most links the other."""
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.8, 0.6, 0.0]), (3, [0.28, 0.96, 0.0]), (4, [0.0, 0.0, 1.0])], "id int, v array<double>")
    got = {r["id"]: (r["grupo"], r["centroide"], r["similaridade"]) for r in clusters.leader(rows, 80).collect()}
    assert got == {1: (1, 1, 100.0), 2: (1, 0, 80.0), 3: (-1, 0, 0.0), 4: (-1, 0, 0.0)}
    found = {r["id"]: (r["grupo"], r["centroide"]) for r in clusters.density(rows, rows, 80, id_col="id", vec_col="v").select(F.col("seq_documento").alias("id"), "grupo", "centroide").collect()}
    assert found == {1: (1, False), 2: (1, True), 3: (1, False), 4: (-1, False)}


@pytest.mark.parametrize("seed", range(2))
def test_rounds_and_blocks_change_nothing(spark, seed):
    """Heads of few rows and small blocks: the rounds, the doubling and the grid are all used; one group has most rows."""
    rng = random.Random(40 + seed)
    matrix = _matrix(rng, 60) + [[1.0, 1.0, 1.0, 1.0, 1.0, 1.0 + rng.random() / 50] for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(matrix)], "seq_documento int, vetor array<double>")
    got = {r["id"]: (r["grupo"], r["centroide"]) for r in clusters.leader(df, 85, "seq_documento", "vetor", head=5, block_rows=16).collect()}
    assert got == _leader(matrix, 0.85)
    got = {r["seq_documento"]: (r["grupo"], r["centroide"]) for r in clusters.density(df, df, 88, head=5, block_rows=16).collect()}
    assert got == _density(matrix, 0.88)


def test_audit_compares_members_with_their_own_similarity(spark):
    """A member nearer to another centroid fails although that centroid is below the limit, and the lowest similarity is cut."""
    groups = spark.createDataFrame([(1, 1, "s", True, 1.0), (2, 2, "s", True, 1.0), (3, 1, "s", False, 0.766)], "seq_documento int, grupo int, sessao string, centroide boolean, sim double")
    vecs = spark.createDataFrame([(1, [0.766, 0.642845]), (2, [0.94, -0.341174]), (3, [1.0, 0.0])], "seq_documento int, vetor array<double>")
    for percent in (70, 95):
        assert [r["resultado"] for r in clusters.audit(groups, vecs, "s", percent).orderBy("ordem").collect()] == ["ok", "3", "2", "ok", "falha", "ok", "ok", "ok"]
    assert clusters.audit(groups, vecs, "s").orderBy("ordem").first()["mensagem"].endswith("76")


def test_unusable_and_missing_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "seq_documento int, vetor array<double>")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "seq_documento int")
    got = {r["seq_documento"]: r["grupo"] for r in clusters.density(docs, df).collect()}
    assert got == {1: 1, 2: 1, 3: -2, 4: -2, 5: -2, 6: -1, 7: -2}
    assert clusters.leader(df.limit(0), 90, "seq_documento", "vetor").count() == 0


def test_audit_reports_failures(spark):
    groups = spark.createDataFrame([(1, 1, "s", True, 1.0), (2, 1, "s", True, 0.5), (3, -1, "s", False, None), (4, 2, "s", False, 1.0)], "seq_documento int, grupo int, sessao string, centroide boolean, sim double")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "seq_documento int, vetor array<double>")
    report = [r["resultado"] for r in clusters.audit(groups, vecs, "s", 90).orderBy("ordem").collect()]
    assert report == ["ok", "4", "2", "falha", "ok", "falha", "falha", "falha"]


def test_best_group_and_identity(spark):
    heads = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "grupo int, v array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])], "q int, v array<double>")
    got = {r["q"]: (r["grupo"], round(r["similaridade"])) for r in clusters.best_group(asked, heads, 90).collect()}
    assert got == {1: (1, 100), 2: (2, 100), 3: (-1, 0)}
    clustered = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, -1, 0)], "id int, grupo int, centroide int")
    tokens = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"]), (4, ["a"])], "id int, tokens array<string>")
    assert {r["id"]: r["identico"] for r in clusters.identical_to_centroid(clustered, tokens).collect()} == {1: "Sim", 2: "Sim", 3: "Não", 4: ""}


def test_blocked_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((150, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id int, v array<double>")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    sims = unit @ unit.T
    expected = {(i, j) for i in range(150) for j in range(i + 1, 150) if sims[i, j] > 0.5}
    got = V.similar_pairs(df, 0.5, block_rows=20).collect()
    assert {(r["a"], r["b"]) for r in got} == expected and len(got) == len(expected)
    assert all(abs(r["sim"] - sims[r["a"], r["b"]]) < 1e-12 for r in got)


def test_thresholds():
    assert [V.percent(x) for x in (90, 0.9, 1, 0.29)] == [0.9, 0.9, 1.0, 0.28]


def test_link_counts_and_classes(spark):
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((90, 8))
    matrix[7] = matrix[3] * 2
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)] + [(100, None), (101, [0.0] * 8)], "id int, v array<double>")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = {r["id"]: (r["classe"], r["ligacoes"]) for r in V.link_counts(df, 0.4, block_rows=20).collect()}
    assert got == {i: (3 if i == 7 else i, int((sims[i] > 0.4).sum())) for i in range(90)}
    assert V.link_counts(df.limit(0), 0.4).count() == 0


def test_clusters_use_vectors_in_force(spark, tmp_path):
    """A superseded vector that is larger in array order, and one followed by an unusable row, don't count."""
    from pyspark.sql import functions as F

    from docloom.plans import queries

    a, b = [1.0] + [0.0] * 127, [0.0, 1.0] + [0.0] * 126
    rows = [(1, a, "2024-01-01"), (2, a, "2023-01-01"), (2, b, "2024-01-01"), (3, b, "2024-01-01"), (4, a, "2023-01-01"), (4, None, "2024-01-01"), (5, a, "2024-01-01"), (5, b, None)]
    df = spark.createDataFrame(rows, "seq_documento int, vetor array<float>, t string").select("seq_documento", F.lit(1).alias("pagina"), "vetor", F.col("t").cast("timestamp").alias("dthr"))
    df.write.parquet(str(tmp_path / "vetores.parquet"))
    sf = str(tmp_path)
    assert {r["id"]: r["grupo"] for r in queries.leader_clusters(spark, sf).collect()} == {1: 1, 5: 1, 2: 2, 3: 2}
    assert {r["seq_documento"]: r["grupo"] for r in queries.density_clusters(spark, sf).collect()} == {1: 1, 5: 1, 2: 2, 3: 2, 4: clusters.NO_VECTOR}
    assert {r["seq_documento"]: (r["classe"], r["ligacoes"]) for r in queries.similar_links(spark, sf).collect()} == {1: (1, 1), 5: (1, 1), 2: (2, 1), 3: (2, 1)}
    assert [r["resultado"] for r in queries.density_audit(spark, sf).orderBy("ordem").collect()] == ["ok", "5", "2", "ok", "ok", "ok", "ok", "ok"]


def _shuffled(spark):
    """Bytes of shuffle files written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_blocks_are_not_written_once_for_each_pair(spark):
    """Twelve blocks: a copy of each vector for each block it meets would be twelve times the input."""
    matrix = np.random.default_rng(3).standard_normal((1200, 64))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id int, v array<double>")
    before = _shuffled(spark)
    assert V.link_counts(df, 0.9, block_rows=100).count() == 1200
    assert _shuffled(spark) - before < 4 * matrix.nbytes


def test_limits_are_decided_in_double_precision(spark):
    """Similarities nearer to the limit than single precision tells, on both sides of it and on it."""
    step = 1e-9
    df = spark.createDataFrame([(i, [0.8 + k * step, (1 - (0.8 + k * step) ** 2) ** 0.5]) for i, k in enumerate(range(-3, 4), 1)] + [(0, [1.0, 0.0])], "id int, v array<double>")
    found = {r["b"] for r in V.similar_pairs(df, 0.8 + step / 2).where("a = 0").collect()}
    assert found == {5, 6, 7}
    assert {r["id"] for r in V.near_any(df.where("id > 0"), df.where("id = 0"), 0.8 + step / 2).collect()} == {5, 6, 7}


def test_cut_and_clusterings_leave_no_shuffle_files(spark):
    """Shuffle files of finished steps used to stay until the driver collected garbage: density took 7.8 times its input in disk."""
    from docloom.session import cut

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(held.size()) if (name := held.apply(i).getName()).endswith(".data")}

    before = files()
    assert cut(spark.range(10_000).selectExpr("id % 1000 AS k").groupBy("k").count()).count() == 1_000
    assert len(files() - before) <= 1  # that of the last count


def test_similar_pairs_are_not_written(spark):
    """Pairs may be many times the vectors: they go to who reads them, and only the vectors are kept."""
    df = spark.createDataFrame([(i, [1.0, i / 50]) for i in range(40)], "id int, v array<double>")
    pairs = V.similar_pairs(df, 0.9)
    assert "MapInArrow" in pairs._jdf.queryExecution().analyzed().toString()
    s = _sims([[1.0, i / 50] for i in range(40)])
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i][j] > 0.9}
    assert pairs.count() == len(pairs.collect())


def test_products_write_merged_rows(spark, monkeypatch):
    """What pairs of blocks find is written once a row, not once for each pair of blocks; an audit writes its counts only."""
    written = []
    real = V.cut

    def noted(df):
        out = real(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(V, "cut", noted)
    rows = real(spark.createDataFrame([(i, 1, [1.0, i / 1000]) for i in range(40)], "id int, m int, v array<double>").repartition(8, "id"))
    got = {r["id"]: r["ligacoes"] for r in V.weighted_degrees(rows, 0.9, 3).collect()}
    assert got == dict.fromkeys(range(40), 39)
    assert [n for columns, n in written if columns == ["id", "n", "s"]] == [40]
    vectors = rows.select(F.col("id").alias("seq_documento"), F.col("v").alias("vetor"))
    groups = clusters.density(vectors, vectors, 90, session="s")
    assert [r["resultado"] for r in clusters.audit(groups, vectors, "s", 90).orderBy("ordem").collect()] == ["ok", "40", "1", *["ok"] * 5]
    assert [n for columns, n in written if "orfao" in columns] == [1]
