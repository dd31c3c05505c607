"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, communities, copies, encodings, mixing, neighbors, pairs, personal, sentences, terms
from docloom.session import load

SEED = 20240601


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to curate."""
    return terms.marked_vocabulary(load(spark, sf_dir, "cache_plan")).where("marca IS NOT NULL").select("termo", "marca")


def p1_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, documents and mark."""
    return terms.marked_vocabulary(load(spark, sf_dir, "cache_plan"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with the first record of its set."""
    found = copies.grouped_copies(load(spark, sf_dir, "util_agrupamento_facil")).where("id <> representante")
    return found.select(F.col("representante").alias("arquivo_id_1"), F.col("id").alias("arquivo_id_2"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with the number of its copies."""
    return copies.collapsed(load(spark, sf_dir, "util_agrupamento_facil")).select(F.col("representante").alias("arquivo_id"), "copias")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.usable(load(spark, sf_dir, "vetores"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of which one is among the five most similar of the other."""
    found = neighbors.unordered(neighbors.most_similar(_vectors(spark, sf_dir)))
    return found.select(F.col("a").cast("int").alias("seq_documento_1"), F.col("b").cast("int").alias("seq_documento_2"))


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other documents of every document whose number is divisible by 50, by greedy graph search."""
    vectors = _vectors(spark, sf_dir)
    nodes, members = neighbors.fold(vectors)
    nodes, members = neighbors.cut(nodes), neighbors.cut(members)
    graph = neighbors.neighbor_graph(nodes)
    asked = vectors.where(F.col("id") % 50 == 0).select(F.col("id").alias("q"), "vetor")
    found = neighbors.search_documents(neighbors.greedy_search(asked, nodes, graph, k=6), members, 5)
    return found.select(F.col("q").cast("int").alias("seq_documento_1"), F.col("viz").cast("int").alias("seq_documento_2"), F.round("sim", 6).alias("sim"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matched document of a session with the first document of its group."""
    return pairs.session_groups(load(spark, sf_dir, "grupos_matriz_tmp"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wrongly decoded text."""
    return encodings.affected(load(spark, sf_dir, "util_doc2vec_facil"))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with their text restored where possible."""
    return encodings.restored(load(spark, sf_dir, "util_doc2vec_facil"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grouped document with the first document of its group."""
    found = communities.document_groups(_vectors(spark, sf_dir))
    return found.select(F.col("id").alias("seq_documento"), F.col("grupo").alias("menor_seq"))


def p6_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups in the shape of grupos, with sizes and typical members."""
    vectors = _vectors(spark, sf_dir)
    return communities.described(communities.cut(communities.document_groups(vectors)), vectors)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every sentence."""
    return sentences.sentences(load(spark, sf_dir, "util_quebrar_paragrafos")).select("doc_id", "inicio", "fim").distinct()


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence in order and in the original wording."""
    return sentences.sentences(load(spark, sf_dir, "util_quebrar_paragrafos"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.token_ids(load(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that each source gets its share of the tokens."""
    return mixing.mixed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "fontes_pesos"), seed=SEED)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that mix reaches."""
    return mixing.mixed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "fontes_pesos"), seed=SEED)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of personal information."""
    return personal.found_mentions(load(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typed placeholders in place of the mentions."""
    return personal.redacted(load(spark, sf_dir, "documents"))


def p10_surrogated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with keyed surrogates in place of the mentions."""
    return personal.surrogated(load(spark, sf_dir, "documents"), b"chave de demonstracao")


QUERIES = {q.__name__: q for q in (p1_found, p1_vocabulary, p2_found, p2_collapsed, p3_found, p3_search, p4_found, p5_found, p5_restored, p6_found, p6_described, p7_found, p7_sentences, p8_ids, p9_mix, p9_shares, p10_found, p10_redacted, p10_surrogated)}

# Accents stripped as in the operator: decompose, drop combining marks.
_TERMS = """
atual AS (SELECT doc_id, max({'d': coalesce(dthr, TIMESTAMPTZ '0001-01-01'), 't': tokens}) AS m FROM cache_plan WHERE doc_id IS NOT NULL GROUP BY doc_id),
exploded AS (SELECT doc_id, unnest(m.t) AS token FROM atual),
limpo AS (SELECT doc_id, trim(strip_accents(lower(replace(token, '#', '')))) AS termo FROM exploded WHERE token IS NOT NULL),
validos AS (SELECT * FROM limpo WHERE termo <> ''),
contagem AS (SELECT termo, count(*) AS qtd, count(DISTINCT doc_id) AS qtd_docs FROM validos GROUP BY termo),
total AS (SELECT count(DISTINCT doc_id) AS n FROM validos),
marcado AS (SELECT termo, qtd, qtd_docs, CASE WHEN qtd_docs < 3 THEN 'raro' WHEN qtd_docs > 0.5 * n THEN 'comum' END AS marca FROM contagem, total)
"""
_RECORDS = r"""
campos AS (SELECT arquivo_id, list_sort(list_filter(list_transform(regexp_split_to_array(lower(texto), '[|;\r\n]+'), lambda f: regexp_replace(f, '[^\p{L}\p{N}]+', '', 'g')), lambda f: f <> '')) AS c FROM util_agrupamento_facil WHERE texto IS NOT NULL AND arquivo_id IS NOT NULL),
chaves AS (SELECT DISTINCT arquivo_id, c FROM campos WHERE len(c) > 0)
"""
_PAIRS_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT sessao AS s, seq_documento AS x, seq_documento_sim AS y FROM grupos_matriz_tmp WHERE seq_documento <> seq_documento_sim AND sessao IS NOT NULL AND NOT isnan(sim) AND CASE WHEN sim > 2 THEN sim / 100 ELSE sim END >= 0.9),
d AS (SELECT s, x, y FROM e UNION SELECT s, y, x FROM e),
r AS (SELECT s, x AS v, x AS m FROM d UNION SELECT r.s, d.y, r.m FROM r JOIN d ON r.s = d.s AND r.v = d.x WHERE r.m < d.y)
SELECT s AS sessao, v AS seq_documento, min(m) AS menor_seq FROM r GROUP BY s, v
"""

ORACLES = {
    "p1_found": f"WITH {_TERMS} SELECT termo, marca FROM marcado WHERE marca IS NOT NULL",
    "p1_vocabulary": f"WITH {_TERMS} SELECT termo, qtd, qtd_docs, marca FROM marcado",
    "p2_found": f"WITH {_RECORDS} SELECT * FROM (SELECT min(arquivo_id) OVER (PARTITION BY c) AS arquivo_id_1, arquivo_id AS arquivo_id_2 FROM chaves) WHERE arquivo_id_1 <> arquivo_id_2",
    "p2_collapsed": f"WITH {_RECORDS} SELECT min(arquivo_id) AS arquivo_id, count(*) AS copias FROM chaves GROUP BY c",
    "p4_found": _PAIRS_SQL,
}
