"""Problems 1, 2 and 4 against brute force, with dirty, empty, skewed and repeated input."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import copies, pairs, terms

PLANS = "doc_id bigint, tokens array<string>, dthr timestamp, termo string"
RECORDS = "arquivo_id bigint, texto string, chave string"
EDGES = "sessao string, seq_documento int, seq_documento_sim int, sim double, s string"


def test_bitmaps_round_trip_and_union():
    rng = random.Random(1)
    for size in (0, 1, 40, 300, 4000):
        a, b = (np.array(sorted(rng.sample(range(4096), size)), np.int64) for _ in range(2))
        assert (terms.unpack(terms.pack(a)) == a).all()
        assert terms.cardinality(terms.pack(a)) == size
        both = terms.union([terms.pack(a), terms.pack(b)])
        assert set(terms.unpack(both)) == set(a) | set(b)
        assert terms.cardinality(both) == len(set(a) | set(b))
    assert len(terms.pack(np.arange(4096))) == 513


def test_terms_of_dirty_plans(spark):
    t1, t2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    rows = [
        (1, ["Súmula ", "#sumula", None, " ", "x"], t1), (1, ["Súmula ", "#sumula", None, " ", "x"], t1), (1, ["velho"], "2023-01-01 00:00:00"),
        (2, ["SÚMULA"], t2), (3, ["súmula", "y"], None), (4, None, t1), (5, [], t1), (6, [None, "#"], t1), (None, ["x"], t1), (2**40, ["sumula"] * 70000, t1),
        (7, ["novo"], t1), (7, None, t2),
    ]
    df = spark.createDataFrame([(i, t, None, "choque") for i, t, _ in rows], PLANS).drop("dthr")
    df = spark.createDataFrame([(i, t, d, "choque") for i, t, d in rows], "doc_id bigint, tokens array<string>, d string, termo string").withColumn("dthr", F.col("d").cast("timestamp"))
    found = {r["termo"]: (r["qtd"], r["qtd_docs"], r["marca"]) for r in terms.marked_vocabulary(df).collect()}
    assert found == {"sumula": (70004, 4, "comum"), "x": (1, 1, "raro"), "y": (1, 1, "raro")}


def test_terms_of_no_plans(spark):
    empty = spark.createDataFrame([], PLANS)
    assert terms.marked_vocabulary(empty).count() == 0
    assert terms.term_frequencies(empty).count() == 0


def _canonical(text):
    import re

    fields = sorted(f for f in ("".join(c for c in part.lower() if c.isalnum()) for part in re.split(r"[|;\r\n]", text or "")) if f)
    return "|".join(fields)


@pytest.mark.parametrize("hot_from", [3, 10_000])
def test_copies_match_brute_force_with_a_hot_key(spark, hot_from):
    rng = random.Random(2)
    bases = ["Autor: Ana | Réu: Bia", "Autor: Ana | Réu: Bía", "Valor: 1,00; Classe: X", "a|a", "a"]
    rows = []
    for i in range(600):
        parts = (bases[0] if i % 3 == 0 else rng.choice(bases)).replace(";", "|").split("|")
        rng.shuffle(parts)
        text = rng.choice([" | ", ";", "\r\n", "|| "]).join(p.upper() if rng.random() < 0.5 else f" ({p})." for p in parts)
        rows.append((i * 7, text, "k"))
    rows += [(10_000, None, "k"), (10_001, "", "k"), (10_002, " | ;\n", "k"), (rows[5][0], rows[5][1], "k"), (None, "a", "k"), (20_000, "longo " * 40_000, "k"), (20_001, "LONGO" * 40_000, "k")]
    groups = collections.defaultdict(set)
    for i, text, _ in rows:
        if i is not None and _canonical(text):
            groups[_canonical(text)].add(i)
    expected = {(i, min(g), len(g)) for g in groups.values() for i in g}
    df = spark.createDataFrame(rows, RECORDS).repartition(7)
    found = copies.grouped_copies(df, hot_from=hot_from)
    assert {tuple(r) for r in found.select("id", "representante", "copias").collect()} == expected
    assert found.count() == len(expected)
    assert {tuple(r) for r in copies.collapsed(df, hot_from=hot_from).collect()} == {(min(g), len(g)) for g in groups.values()}


def test_copies_of_nothing(spark):
    assert copies.grouped_copies(spark.createDataFrame([], RECORDS)).count() == 0


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, a, b in edges:
        x, y = find((s, a)), find((s, b))
        parent[max(x, y)] = min(x, y)
    return {(*x, find(x)[1]) for x in list(parent)}


def _shapes(rng):
    """Chains, stars, rings, trees and random graphs with shuffled numbers."""
    edges, base = [], 0
    for shape in ("chain", "star", "ring", "tree", "random", "pair", "random", "chain"):
        n = {"pair": 2, "chain": 60, "star": 40, "ring": 30}.get(shape, 25)
        names = list(range(base, base + n))
        rng.shuffle(names)
        if shape in ("chain", "ring", "pair"):
            own = [(names[i], names[i + 1]) for i in range(n - 1)] + ([(names[-1], names[0])] if shape == "ring" else [])
        elif shape == "star":
            own = [(names[0], x) for x in names[1:]]
        elif shape == "tree":
            own = [(names[i], names[rng.randrange(i)]) for i in range(1, n)]
        else:
            own = [tuple(rng.sample(names, 2)) for _ in range(int(n * 1.3))]
        edges += own
        base += n
    return edges


def test_groups_of_all_shapes(spark):
    rng = random.Random(3)
    edges = [("s1", a, b) for a, b in _shapes(rng)] + [("s2", a, b) for a, b in _shapes(rng)]
    rows = [(s, a, b, rng.choice([0.9, 0.95, 95.0, 1.0, 90.0]), "z") for s, a, b in edges]
    rows += [(s, b, a, x, z) for s, a, b, x, z in rows[::3]] + rows[::5]
    noise = [("s1", 1, 400, 0.89, "z"), ("s1", 2, 2, 1.0, "z"), ("s1", 3, None, 0.99, "z"), ("s1", 900, 901, None, "z"), ("s1", 902, 903, float("nan"), "z"), (None, 904, 905, 1.0, "z"), ("s1", 906, 907, 2.0, "z"), ("s1", 908, 909, 2.5, "z")]
    expected = _components([*edges, ("s1", 906, 907)])
    found = [tuple(r) for r in pairs.session_groups(spark.createDataFrame(rows + noise, EDGES)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_groups_of_nothing(spark):
    assert pairs.session_groups(spark.createDataFrame([], EDGES)).count() == 0
    assert pairs.session_groups(spark.createDataFrame([("s", 1, 2, 0.1, "z")], EDGES)).count() == 0
