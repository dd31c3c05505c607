"""Problem 4: one group identifier for all records linked directly or through others.

Two phases on an edge list ``(s, a, b)`` (``s``: session, ``a < b``):

1. *Reduction.* Each round removes vertices of degree one, and of the vertices of degree two an
   independent set chosen by random priority, whose two neighbours are joined directly. So pendant
   trees are stripped and chains shrink by a constant factor a round, as in list ranking by splicing.
   Every removed vertex remembers a neighbour that outlives it.
2. *Core.* What is left is contracted: each vertex points to its smallest neighbour, pointers are
   doubled, and edges are drawn between the targets, until no edge is left.

Then labels go back in reverse order: over the contractions, and to the removed vertices of each
round. No neighbour list is ever gathered: all steps are joins and aggregates with partial results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut


def matches(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Distinct undirected matches ``s, a, b`` with ``a < b``.

    ``sim`` above 2 is on the 0-100 scale. Rows with a null or NaN ``sim``, a null document or session, of a
    document with itself, and repeated or mirrored rows add nothing.
    """
    sim = F.when(F.col("sim") > 2, F.col("sim") / 100).otherwise(F.col("sim"))
    x, y = F.col("seq_documento"), F.col("seq_documento_sim")
    good = pairs.where((sim >= threshold) & ~F.isnan("sim") & (x != y) & F.col("sessao").isNotNull())
    return good.select(F.col("sessao").alias("s"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
    return edges.select("s", ends.alias("e")).select("s", "e.v", "e.u")


def _strip(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One reduction round: the removed vertices ``s, v, p, q`` and the edges that stay.

    ``p`` is the neighbour to take the label from; ``q`` is the other one of a chain vertex, else null.
    """
    around = _both_ways(edges)
    low = around.groupBy("s", "v").agg(F.count(F.lit(1)).alias("grau"), F.min("u").alias("p"), F.max("u").alias("q")).where("grau <= 2")
    # Of two neighbours that both could go, the one with the higher priority goes; leaves before chain vertices.
    rank = F.struct((2 - F.col("grau")).alias("folha"), F.xxhash64("v", F.lit(turn)).alias("sorte"), F.col("v").alias("v"))
    low = low.select("s", "v", "grau", "p", "q", rank.alias("vez"))
    asked = low.select("s", "v", F.explode(F.array_distinct(F.array("p", "q"))).alias("u"), "vez")
    rival = low.select("s", F.col("v").alias("u"), F.col("vez").alias("outra"))
    beaten = asked.join(rival, ["s", "u"]).where(F.col("outra") > F.col("vez")).select("s", "v").distinct()
    gone = low.join(beaten, ["s", "v"], "left_anti").select("s", "v", "p", F.when(F.col("grau") == 2, F.col("q")).alias("q"))
    gone = cut(gone)
    dead = gone.select("s", "v")
    stay = edges.join(dead.withColumnRenamed("v", "a"), ["s", "a"], "left_anti").join(dead.withColumnRenamed("v", "b"), ["s", "b"], "left_anti")
    bridge = gone.where("q IS NOT NULL").select("s", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return gone, stay.select("s", "a", "b").unionByName(bridge).distinct()


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One core round: the map ``s, v, t`` of every vertex to its target, and the edges between targets."""
    parent = _both_ways(edges).groupBy("s", "v").agg(F.min("u").alias("m")).select("s", "v", F.least("v", "m").alias("t"))
    for _ in range(2):
        up = parent.select("s", F.col("v").alias("t"), F.col("t").alias("tt"))
        parent = parent.join(up, ["s", "t"]).select("s", "v", F.col("tt").alias("t"))
    parent = cut(parent)
    left = parent.select("s", F.col("v").alias("a"), F.col("t").alias("x"))
    right = parent.select("s", F.col("v").alias("b"), F.col("t").alias("y"))
    moved = edges.join(left, ["s", "a"]).join(right, ["s", "b"]).where("x <> y")
    return parent, moved.select("s", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, worth: float = 0.2, max_rounds: int = 40) -> DataFrame:
    """``s, v, grupo``: the component of every vertex, named by its smallest vertex.

    ``edges`` has ``s, a, b``. Reduction rounds go on while each removes at least the share ``worth`` of the
    edges. ``max_rounds`` bounds the core rounds, of which a contraction needs logarithmically many;
    running out of them is an error, never a partial answer.
    """
    edges = cut(edges)
    left = edges.count()
    removed, maps = [], []
    turn = 0
    while left:
        gone, rest = _strip(edges, turn)
        rest = cut(rest)
        now = rest.count()
        removed.append(gone)
        edges, before, left, turn = rest, left, now, turn + 1
        if before - left < worth * before:
            break
    while left:
        if len(maps) == max_rounds:
            raise RuntimeError("the core did not contract")
        parent, rest = _contract(edges)
        edges = cut(rest)
        left = edges.count()
        maps.append(parent)
    labels = maps[-1].select("s", "v", F.col("t").alias("g")) if maps else None
    for parent in reversed(maps[:-1]):
        final = labels.select("s", F.col("v").alias("t"), "g")
        labels = parent.join(final, ["s", "t"], "left").select("s", "v", F.coalesce("g", "t").alias("g"))
    for gone in reversed(removed):
        if labels is None:
            here = gone.select("s", "v", F.col("p").alias("g")).unionByName(gone.select("s", F.col("p").alias("v"), F.col("p").alias("g"))).distinct()
            labels = cut(here)
            continue
        known = labels.select("s", F.col("v").alias("p"), "g")
        # A neighbour without a label had no other edge left: it stands for itself.
        back = gone.join(known, ["s", "p"], "left").select("s", "v", "p", F.coalesce("g", "p").alias("g"), F.col("g").isNull().alias("novo"))
        own = back.where("novo").select("s", F.col("p").alias("v"), F.col("p").alias("g")).distinct()
        # Written in each round: the labels are read twice in the next, and plans would double.
        labels = cut(labels.unionByName(back.select("s", "v", "g")).unionByName(own))
    if labels is None:
        return edges.select("s", F.col("a").alias("v"), F.col("a").alias("grupo"))
    labels = labels if removed else cut(labels)
    smallest = labels.groupBy("s", "g").agg(F.min("v").alias("grupo"))
    return labels.join(smallest, ["s", "g"]).select("s", "v", "grupo")


def session_groups(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``sessao, seq_documento, menor_seq`` of every document with a match in a session.

    ``menor_seq`` is the smallest document linked to it, directly or through others. A table without
    matches gives no rows.
    """
    found = components(matches(pairs, threshold))
    return found.select(F.col("s").alias("sessao"), F.col("v").alias("seq_documento"), F.col("grupo").alias("menor_seq"))
