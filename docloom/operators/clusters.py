"""Threshold clustering: by row order, by density, and the audit of a clustering.

Both clusterings are one kernel: centroids are the lexicographically first maximal independent set
of the graph "similarity at least t" under a fixed priority, and every other vector goes to its most similar
centroid. The graph is never written: vectors are compared with centroids, in blocks, and what comes out of a
product is one row a vector.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import vectors as V
from docloom.operators.numbering import numbered_by
from docloom.session import cut, free

#: A document without group, and one without vector.
ORPHAN, NO_VECTOR = -1, -2
#: Rows that one task settles one after the other.
HEAD = 4_096


def _greedy(rows: DataFrame, limit: float) -> DataFrame:
    """``id, r, v`` of the rows taken in order of ``r`` such that no two are similar. For at most :data:`HEAD` rows: one task."""

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        matrix = V.unit_matrix(table)
        open_, taken = np.ones(table.num_rows, bool), []
        for i in range(table.num_rows):
            if open_[i]:
                taken.append(i)
                open_ &= matrix @ matrix[i] < limit - V.SLACK
        yield from table.take(pa.array(taken)).to_batches()

    return rows.select("id", "r", "v").repartition(1).sortWithinPartitions("r").mapInArrow(run, rows.select("id", "r", "v").schema)


def _settled(rows: DataFrame, limit: float, head: int, block_rows: int) -> DataFrame:
    """``id, r, v`` of the rows that the greedy choice in order of ``r`` takes among these.

    While there are more than ``head``, all rows without a similar one before them are taken at once and their like leave.
    Of a product of blocks only the rows come out that have a similar one before them, so a dense group costs no more than a loose one.
    ``rows`` is a table that :func:`cut` gave and that nothing else reads: it is deleted as soon as it has been used.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def beaten(lt, a, rt, b, same):
        own, other = lt.column("r").to_numpy(), rt.column("r").to_numpy()
        lost = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for x, y, _ in V.hits(a, b, limit - V.SLACK):
            lost[0][x[own[x] > other[y]]] = True
            lost[1][y[other[y] > own[x]]] = True
        for table, which in zip((lt, rt), lost):
            yield pa.record_batch([table.column("id").combine_chunks().filter(pa.array(which))], names=["id"])

    taken, open_ = [], rows
    while open_.count() > head:
        lost = V.self_grid(open_, f"id {kind}", beaten, block_rows, merged=DataFrame.distinct)
        fresh = cut(open_.join(lost, "id", "left_anti"))
        taken.append(fresh)
        behind = cut(open_.join(lost, "id", "left_semi"))
        free(open_)
        open_ = cut(behind.join(V.near_any(behind, fresh, limit, block_rows), "id", "left_anti"))
        free(behind)
    out = cut(functools.reduce(DataFrame.unionByName, (t.select("id", "r", "v") for t in [*taken, _greedy(open_, limit)])))
    for done in [*taken, open_]:
        free(done)
    return out


def centroids_in_order(rows: DataFrame, limit: float, head: int = HEAD, block_rows: int = V.BLOCK_ROWS) -> DataFrame:
    """``id, r, v`` of the rows that become centroids: taken in order of ``r`` if no centroid before is similar enough.

    ``rows`` has ``id``, distinct whole numbers ``r`` and vectors ``v``, and is cheap to read. The first ``head`` rows are settled,
    what is similar to their centroids leaves, then three times as many as before, and so on: rows are compared with
    centroids, not with each other, and no link is ever written.
    """
    left, upto, taken = rows.select("id", "r", "v"), head, []
    while True:
        first = left.agg(F.min("r").alias("r")).first()["r"]
        if first is None:
            break
        upto = max(upto, first + head - 1)
        now, rest = cut(left.where(F.col("r") <= upto)), cut(left.where(F.col("r") > upto))
        # The two parts take the room of the whole, which isn't needed any more, unless it is what the caller gave.
        if taken:
            free(left)
        fresh = _settled(now, limit, head, block_rows)
        taken.append(fresh)
        left = cut(rest.join(V.near_any(rest, fresh, limit, block_rows), "id", "left_anti"))
        free(rest)
        upto *= 4
    if not taken:
        return left
    out = cut(functools.reduce(DataFrame.unionByName, taken))
    for done in [*taken, left]:
        free(done)
    return out


def _placed(unit: DataFrame, ranked: DataFrame, limit: float, last: bool, head: int, block_rows: int) -> DataFrame:
    """``id, centro, sim``: every row of ``unit`` that has a centroid at its most similar one, centroids themselves included.

    ``ranked``: ``id, r``. Of centroids as similar the first by ``r`` counts, or the ``last``. ``unit`` is a table that
    :func:`cut` gave and that nothing else reads: it is deleted, as are all copies of vectors as soon as they have been used.
    """
    rows = cut(unit.join(ranked, "id").select("id", "r", "v"))
    free(unit)
    heads = centroids_in_order(rows, limit, head, block_rows)
    others = cut(rows.join(heads.select("id"), "id", "left_anti"))
    free(rows)
    sign = -1 if last else 1
    best = V.nearest(others, heads.select("id", (sign * F.col("r")).alias("r"), "v"), limit, block_rows)
    free(others)
    members = best.withColumn("r", sign * F.col("r")).join(heads.select("r", F.col("id").alias("centro")), "r").select("id", "centro", "sim")
    return members.unionByName(heads.select("id", F.col("id").alias("centro"), F.lit(1.0).alias("sim")))


def _folded(unit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each distinct vector, ``id, v, m`` with the number of its rows, and ``id, classe`` of all rows."""
    members = cut(V.classes(unit))
    sizes = members.groupBy("classe").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("classe", "id")
    return cut(unit.join(sizes, "id")), members


def leader(vectors: DataFrame, threshold: float = 90, id_col: str = "id", vec_col: str = "v", order_col: str | None = None, head: int = HEAD, block_rows: int = V.BLOCK_ROWS) -> DataFrame:
    """Clustering in row order: ``id, grupo, similaridade, centroide``.

    A row becomes a centroid if no earlier centroid is similar enough; then every other row goes to its most similar
    centroid, ties to the earlier one. Groups of one are -1 with similarity 0. Groups are numbered by the first row
    that belongs to them; similarity is in percent, rounded to two places. Rows are ordered by ``order_col`` (default:
    the identifier). Unusable vectors are orphans. Equal vectors are worked on once.
    """
    limit = V.percent(threshold)
    keyed = vectors.select(F.col(id_col).alias("id"), F.col(order_col or id_col).alias("o")).where("id IS NOT NULL").groupBy("id").agg(F.min("o").alias("o"))
    keyed = cut(keyed)
    unit = cut(V.usable(vectors, id_col, vec_col))
    order = numbered_by(keyed.join(unit.select("id"), "id", "left_semi"), ["o", "id"], "r").select("id", "r")
    order = cut(order)
    same = cut(V.classes(unit).join(order, "id"))
    # Of equal rows the first one stands for all.
    ranked = same.groupBy("classe").agg(F.min("r").alias("r"), F.min_by("id", "r").alias("no"))
    placed = _placed(unit, ranked.select(F.col("no").alias("id"), "r"), limit, False, head, block_rows)
    rows = cut(same.join(ranked.select("classe", "no"), "classe").join(placed.withColumnRenamed("id", "no"), "no").select("id", "r", "centro", F.when(F.col("no") == F.col("centro"), 1.0).otherwise(F.col("sim")).alias("sim")))
    first = rows.groupBy("centro").agg(F.min("r").alias("primeiro"), F.count(F.lit(1)).alias("n")).where("n > 1")
    number = numbered_by(first, ["primeiro"], "grupo").select("centro", F.col("grupo").cast("int"))
    grouped = rows.join(number, "centro").select("id", "grupo", F.bround(F.col("sim") * 100, 2).alias("similaridade"), (F.col("id") == F.col("centro")).cast("int").alias("centroide"))
    return keyed.select("id").join(grouped, "id", "left").select("id", F.coalesce("grupo", F.lit(ORPHAN)).alias("grupo"), F.coalesce("similaridade", F.lit(0.0)).alias("similaridade"), F.coalesce("centroide", F.lit(0)).alias("centroide"))


def densities(edges: DataFrame) -> DataFrame:
    """``id, ligacoes, soma``: number of links and sum of similarities of each vertex."""
    return edges.groupBy(F.col("id_1").alias("id")).agg(F.count(F.lit(1)).alias("ligacoes"), F.sum("sim").alias("soma"))


def density(documents: DataFrame, vectors: DataFrame, percent: float = 90, floor: float = 70, session: str = "", id_col: str = "seq_documento", vec_col: str = "vetor", head: int = HEAD, block_rows: int = V.BLOCK_ROWS) -> DataFrame:
    """Clustering by density: ``seq_documento, grupo, sessao, centroide, sim``.

    The limit is the larger of ``percent`` and ``floor``. The document with most links, then the largest sum of
    similarities, then the smallest identifier becomes a centroid and takes its neighbours, until no link is left; then each
    document goes to its most similar centroid, and on an exact tie to the one chosen last. Documents without group have -1,
    those without a usable vector -2. Groups are numbered by descending size, then by their centroid's identifier.
    Equal vectors are worked on once.
    """
    limit = max(floor, percent) / 100
    ids = documents.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    own = cut(V.usable(vectors.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi"), id_col, vec_col))
    nodes, same = _folded(own)
    free(own)
    linked = V.weighted_degrees(nodes, limit, block_rows).where("ligacoes > 0").withColumn("soma", F.round("soma", 9))
    ranked = numbered_by(linked, [F.desc("ligacoes"), F.desc("soma"), F.col("id")], "r").select("id", "r")
    placed = _placed(nodes, ranked, limit, True, head, block_rows)
    rows = cut(same.join(placed.withColumnRenamed("id", "classe"), "classe").select("id", "centro", "sim"))
    sizes = rows.groupBy("centro").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    number = numbered_by(sizes, [F.desc("n"), F.col("centro")], "grupo").select("centro", F.col("grupo").cast("int"))
    grouped = rows.join(number, "centro").select("id", "grupo", (F.col("id") == F.col("centro")).alias("centroide"), "sim")
    out = ids.join(grouped, "id", "left").join(same.select("id", F.lit(True).alias("usavel")), "id", "left")
    state = F.coalesce("grupo", F.when(F.col("usavel"), ORPHAN).otherwise(NO_VECTOR))
    return out.select(F.col("id").alias("seq_documento"), state.alias("grupo"), F.lit(session).alias("sessao"), F.coalesce("centroide", F.lit(False)).alias("centroide"), "sim")


def best_group(queries: DataFrame, centroids: DataFrame, threshold: float = 90, distance: str = "cosine") -> DataFrame:
    """``q, grupo, similaridade`` of each vector ``q, v`` against the centroids ``grupo, v``; -1 and 0 where none is similar enough.

    Ties go to the smaller group. Cosines are products of blocks; for the euclidean measure vectors keep their length and the
    distance comes from the product. Unusable vectors are in no group.
    """
    limit = V.percent(threshold)
    asked = queries.select(F.col("q").alias("id"), F.col("v").cast("array<double>").alias("v"))
    heads = centroids.select(F.col("grupo").alias("id"), F.col("grupo").cast("bigint").alias("r"), F.col("v").cast("array<double>").alias("v"))
    finite = lambda df: df.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    if distance.lower() in ("c", "cosine"):
        unit = lambda df: finite(df).withColumn("v", V.normalize(F.col("v"))).where("v IS NOT NULL")
        best = V.nearest(cut(unit(asked)), cut(unit(heads)), limit)
    else:
        kind = asked.schema["id"].dataType.simpleString()

        def work(lt, a, rt, b):
            order = np.argsort(rt.column("r").to_numpy(), kind="stable")
            numbers, b = rt.column("r").to_numpy()[order], b[order]
            square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
            sims = np.round(1 - np.sqrt(np.maximum(square, 0)), V.PLACES)
            best = sims.argmax(1)
            value = sims[np.arange(len(sims)), best]
            ok = np.flatnonzero(value >= limit)
            yield pa.record_batch([lt.column("id").combine_chunks().take(pa.array(ok)), pa.array(numbers[best[ok]]), pa.array(value[ok])], names=["id", "r", "sim"])

        found = V.grid(cut(finite(asked)), cut(finite(heads)), f"id {kind}, r bigint, sim double", work, scaled=False)
        best = found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "r")).alias("m")).select("id", "m.r", (-F.col("m.s")).alias("sim"))
    return queries.select("q").join(best.withColumnRenamed("id", "q"), "q", "left").select("q", F.coalesce(F.col("r").cast("int"), F.lit(ORPHAN)).alias("grupo"), F.coalesce(100 * F.col("sim"), F.lit(0.0)).alias("similaridade"))


def identical_to_centroid(clustered: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``identico``: ``Sim`` if a member's tokens are its centroid's, ``Não`` if not, empty for orphans.

    ``clustered`` has ``id, grupo, centroide``; ``tokens`` has ``id, tokens``. Token lists are compared themselves, not hashes.
    """
    rows = clustered.join(tokens.select("id", "tokens"), "id", "left")
    heads = rows.where((F.col("centroide") == 1) & (F.col("grupo") > 0)).select("grupo", F.col("tokens").alias("do_centro"))
    joined = rows.join(heads, "grupo", "left")
    return joined.select("id", "grupo", *[c for c in clustered.columns if c not in ("id", "grupo")], F.when(F.col("grupo") < 0, "").when(F.col("tokens") == F.col("do_centro"), "Sim").otherwise("Não").alias("identico"))


def audit(groups: DataFrame, vectors: DataFrame, session: str, percent: float = 0) -> DataFrame:
    """Eight checks of a session's clustering: ``ordem, mensagem, resultado``.

    The limit in percent, the number of rows, the number of groups, and ``ok`` or ``falha`` for: orphans near a
    centroid, members more similar to the centroid of another group than their stored similarity (by more than 1e-6, whatever
    the limit), more than one centroid, none, and stored similarities off by more than 0.01. Without ``percent`` the session's
    lowest similarity, cut to whole percents, is the limit. ``vectors`` has ``seq_documento, vetor``. Documents are compared with
    centroids only.
    """
    own = groups.where(F.col("sessao") == session).select(F.col("seq_documento").alias("id"), "grupo", "centroide", F.col("sim").cast("double").alias("sim"))
    unit = V.usable(vectors, "seq_documento", "vetor")
    placed = cut(own)
    if percent <= 0:
        percent = int(placed.where("sim > 0").agg(F.coalesce(F.min("sim"), F.lit(0.0)).alias("m")).first()["m"] * 100)
    with_vector = placed.where(f"grupo > 0 OR grupo = {ORPHAN}").join(unit, "id").select("id", F.col("grupo").cast("bigint").alias("g"), F.coalesce("centroide", F.lit(False)).alias("c"), F.coalesce("sim", F.lit(float("nan"))).alias("s"), "v")
    with_vector = cut(with_vector)
    heads = with_vector.where("c AND g > 0").select("id", "g", "v")

    def work(lt, a, rt, b):
        ids, other = lt.column("id").to_numpy(), rt.column("id").to_numpy()
        g, h, c, s = lt.column("g").to_numpy(), rt.column("g").to_numpy(), lt.column("c").to_numpy(), lt.column("s").to_numpy()
        for start in range(0, len(a), 512):
            x = slice(start, start + 512)
            sims = a[x] @ b.T
            apart = ids[x, None] != other[None, :]
            orphan = ((np.round(sims, 6) >= percent / 100) & apart).any(1) & (g[x] == ORPHAN)
            better = ((sims > s[x, None] + 1e-6) & apart & (g[x, None] != h[None, :])).any(1) & (g[x] > 0) & ~c[x]
            wrong = ((np.abs(sims - s[x, None]) > 0.01) & (g[x, None] == h[None, :])).any(1) & (g[x] > 0)
            yield pa.record_batch([pa.array([int(which.sum())]) for which in (orphan, better, wrong)], names=["orfao", "melhor", "errada"])

    total = lambda seen: seen.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("orfao", "melhor", "errada")])
    failures = V.grid(with_vector, heads, "orfao bigint, melhor bigint, errada bigint", work, merged=total)
    free(with_vector)
    orphans, better, wrong = (failures.select(F.col(name).alias("n")) for name in ("orfao", "melhor", "errada"))
    per_group = placed.where("grupo > 0").groupBy("grupo").agg(F.count_if(F.col("centroide")).alias("c"))
    many, none = (per_group.where(rule).agg(F.count(F.lit(1)).alias("n")) for rule in ("c > 1", "c = 0"))
    verdict = lambda df: df.select(F.when(F.col("n") == 0, "ok").otherwise("falha").alias("resultado"))
    counted = lambda df: df.agg(F.count(F.lit(1)).cast("string").alias("resultado"))
    # The messages of the report.
    rows = [
        (f"Avaliando similaridade >= {int(percent)}", placed.sparkSession.range(1).select(F.lit("ok").alias("resultado"))),
        ("Total de registros no grupo", counted(placed)),
        ("Total de grupos criados", counted(placed.where("centroide AND grupo > 0"))),
        ("Verificação de órfãos", verdict(orphans)),
        ("Verificação de melhores similaridades", verdict(better)),
        ("Verificação se tem só um centróide por grupo ", verdict(many)),
        ("Verificação se existe 1 centróide por grupo ", verdict(none)),
        ("Verificação das similaridades calculadas", verdict(wrong)),
    ]
    out = None
    for order, (message, result) in enumerate(rows, 1):
        line = result.select(F.lit(order).alias("ordem"), F.lit(message).alias("mensagem"), "resultado")
        out = line if out is None else out.unionByName(line)
    return out


def sheet_order(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``ultimo``, 1 for orphans, and sorts as a sheet: groups first, each from its centroid downwards, ties by ``keys``."""
    marked = clustered.withColumn("ultimo", (F.col("grupo") < 0).cast("int"))
    return marked.orderBy("ultimo", "grupo", F.desc("similaridade"), F.desc("centroide"), *keys)
