"""Files, tags, vocabulary configuration, sinks, sessions, embeddings and streams."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import embed
from docloom.operators import vectors as V
from docloom.sources import corpus, tables
from docloom.streaming import incoming


@pytest.fixture
def folder(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "um tag civil honorarios.txt").write_text("linha  um\r\n\nlinha dois\n", encoding="utf-8")
    (deep / "dois (12) tags x (3) y.TXT").write_bytes("ação".encode("latin-1"))
    (deep / "sem marca.txt").write_text("é", encoding="utf-8")
    (deep / "sem marca.tag").write_text("k1 k2", encoding="utf-8")
    (deep / "vazio.txt").write_text("", encoding="utf-8")
    (deep / "solto.txt").write_text("é", encoding="utf-8")
    (deep / "outro.csv").write_text("x", encoding="utf-8")
    return str(tmp_path)


def test_files_are_read_with_fallback(spark, folder):
    got = {r["nome"]: r["texto"] for r in corpus.read_texts(spark, folder).collect()}
    assert got == {"um tag civil honorarios.txt": "linha  um\n\nlinha dois", "dois (12) tags x (3) y.TXT": "ação", "sem marca.txt": "é", "solto.txt": "é"}
    assert corpus.read_texts(spark, folder, prefix="UM", clean=True, join_lines=True).first()["texto"] == "linha um linha dois"
    with pytest.raises(Exception):
        corpus.read_texts(spark, folder + "/falta").count()


def test_tags(spark, folder):
    texts = corpus.read_texts(spark, folder)
    got = {r["nome"]: r["tags"] for r in corpus.with_tags(texts, corpus.tag_reader(spark, folder)).collect()}
    assert got["um tag civil honorarios.txt"] == ["civil", "honorarios"]
    assert got["dois (12) tags x (3) y.TXT"] == ["x", "y"]
    assert got["sem marca.txt"] == ["k1", "k2"]
    assert len(got["solto.txt"]) == 1 and got["solto.txt"][0].lstrip("-").isdigit()


def test_lines_and_shuffling(spark, folder):
    texts = corpus.read_texts(spark, folder)
    assert sorted(r["texto"] for r in corpus.text_lines(texts).collect()) == ["ação", "linha  um", "linha dois", "é", "é"]
    assert corpus.shuffled(texts, 3, limit=2).count() == 2
    assert [r["nome"] for r in corpus.shuffled(texts, 3).collect()] == [r["nome"] for r in corpus.shuffled(texts, 3).collect()]


def test_vocabulary_configuration(spark, tmp_path):
    (tmp_path / "VOCAB_BASE direito.txt").write_text("processo  casa casas\nLei juízo", encoding="utf-8")
    (tmp_path / "vocab_removido.txt").write_text("casa", encoding="utf-8")
    (tmp_path / "Vocab_Tradutor.txt").write_text("dano moral => dano moral\nvenia\n", encoding="utf-8")
    vocab = corpus.load_vocabulary(spark, str(tmp_path))
    assert {"processo", "lei", "juizo", "dano_moral", "zero"} <= vocab.terms
    assert not {"casa", "casas"} & vocab.terms and {"casa", "casas"} <= vocab.removed
    assert vocab.rules == (("dano moral", "dano_moral"), ("venia", ""))


def test_rules_alone_are_no_vocabulary(spark, tmp_path):
    (tmp_path / "vocab_tradutor.txt").write_text("a b => c", encoding="utf-8")
    assert corpus.load_vocabulary(spark, str(tmp_path)).terms == frozenset()


def test_cache_and_comparison_lines(spark, tmp_path):
    tokens = spark.createDataFrame([(1, ["a"])], "doc_id int, tokens array<string>")
    place = str(tmp_path / "cache")
    assert corpus.token_cache(tokens, place, "x").count() == 1
    assert corpus.token_cache(tokens.limit(0), place, "x").count() == 1
    (tmp_path / "termos.txt").write_text("lei casa\n\na b = c d\n", encoding="utf-8")
    assert sorted(r["linha"] for r in corpus.comparison_lines(spark, str(tmp_path / "termos.txt")).collect()) == ["a b = c d", "casa", "lei"]


def test_tables_and_sessions(spark, tmp_path):
    assert tables.empty_table(spark, "grupos_matriz_tmp").columns == ["sessao", "seq_documento", "seq_documento_sim", "sim", "centroide"]
    rows = spark.createDataFrame([(1, 1, "[0.5, 1]"), (2, 1, "nada"), (3, 1, None)], "seq_documento int, pagina int, vetor string")
    assert {r["seq_documento"]: r["vetor"] for r in tables.vectors_from_json(rows).collect()} == {1: [0.5, 1.0], 2: None, 3: None}
    at = datetime.datetime(2024, 1, 2)
    held = spark.createDataFrame([(1, at), (2, at - datetime.timedelta(hours=13)), (3, None)], "id int, dthr timestamp")
    groups, logs = tables.retained(held, held, "2024-01-02 00:00:00")
    assert [r["id"] for r in groups.collect()] == [1] and sorted(r["id"] for r in logs.collect()) == [1, 2]
    log = tables.clustering_log(spark.createDataFrame([(1, 1, True), (2, 1, False), (3, -1, False), (4, -2, False)], "seq_documento int, grupo int, centroide boolean"), "s")
    assert [r["ordem"] for r in log.orderBy("ordem").collect()] == [1, 2, 3, 4, 5, 6]
    tables.write_lines(log, "txt_log", str(tmp_path / "log"))
    tables.write_sheet(log, str(tmp_path / "planilha"))
    assert spark.read.text(str(tmp_path / "log")).count() == 6 and spark.read.option("header", True).csv(str(tmp_path / "planilha")).count() == 6
    tables.append_passages(log, str(tmp_path / "frases"))
    tables.append_passages(log, str(tmp_path / "frases"))
    assert spark.read.parquet(str(tmp_path / "frases")).count() == 12
    fresh = tables.replaced_session(log.select("sessao", "ordem"), log.where("ordem = 1").select("sessao", "ordem"), "s")
    assert fresh.count() == 1


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.similarity(F.col("a"), F.col("b"), "euclid").alias("e"), V.normalize(F.col("a")).alias("n")).collect()
    assert abs(got[0]["c"] - 0.96) < 1e-12 and abs(got[0]["e"] - (1 - 2**0.5)) < 1e-12 and got[0]["n"] == [0.6, 0.8]
    assert got[1]["c"] is None and got[1]["n"] is None and got[2]["c"] is None
    with pytest.raises(Exception):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.dot(F.col("a"), F.col("b"))).collect()


def test_embeddings(spark, tmp_path):
    rows = [(i, (["juiz", "lei", "processo"] if i % 2 else ["casa", "rua", "porta"]) * 5) for i in range(60)]
    tokens = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    model = embed.train(tokens, dims=8, window=3, epochs=2, min_count=1, partitions=1)
    inferred = embed.infer(model, tokens).collect()
    assert all(abs(sum(x * x for x in r["vetor"]) - 1) < 1e-9 for r in inferred)
    pairs = spark.createDataFrame([(["juiz"], ["juiz"]), (["juiz"], ["desconhecido"])], "a array<string>, b array<string>")
    sims = [r["sim"] for r in embed.compare_pairs(model, pairs).collect()]
    assert sorted(s is None for s in sims) == [False, True] and abs(next(s for s in sims if s is not None) - 1) < 1e-9
    near = embed.nearest_terms(model, spark.createDataFrame([("juiz",), ("falta",)], "termo string"), 2, -1.0)
    assert {r["termo"] for r in near.collect()} == {"juiz"} and near.count() == 2
    assert embed.term_report(near).first()["linha"].startswith("juiz ")
    embed.save(model, str(tmp_path / "m"), {"epocas": 2})
    assert embed.load(str(tmp_path / "m")).getVectors().count() == model.getVectors().count()
    similar = embed.compare_documents(embed.infer(model, tokens).select(F.col("doc_id").alias("id"), "vetor"), 0.7)
    assert similar.count() == 60
    flat = embed.plane(embed.infer(model, tokens).select("doc_id", "vetor", F.lit(1).alias("grupo"), F.lit(0).alias("centroide")))
    assert {"x", "y", "tamanho", "cor"} <= set(flat.columns)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "entrada")
    spark.createDataFrame([(1, "Ação civil"), (2, None)], "doc_id int, text string").write.parquet(source)
    stream = incoming.stream_tokens(incoming.read_stream(spark, source, "doc_id int, text string"))
    query = stream.writeStream.format("memory").queryName("tokens_novos").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["doc_id"]: r["tokens"] for r in spark.table("tokens_novos").collect()} == {1: ["acao", "civil"], 2: None}
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "grupo int, v array<double>")
    vecs = str(tmp_path / "vetores")
    spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "id int, v array<double>").write.parquet(vecs)
    groups = incoming.stream_groups(incoming.read_stream(spark, vecs, "id int, v array<double>"), held)
    query = groups.writeStream.format("memory").queryName("grupos_novos").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["id"]: r["grupo"] for r in spark.table("grupos_novos").collect()} == {1: 1, 2: -1, 3: -1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_document_vectors_have_the_usual_length(spark):
    from docloom.plans import queries

    rows = queries.document_vectors(spark, "/root/testdata/sf0.001").collect()
    assert rows and {len(r["vetor"]) for r in rows if r["vetor"]} == {300}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_document_vectors_clean_each_text_once(spark, monkeypatch):
    from docloom.plans import queries

    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(queries, "cut", kept)
    with pytest.raises(InterruptedError):
        queries.document_vectors(spark, "/root/testdata/sf0.001")
    assert plans[0].count(" zero ") == 1
