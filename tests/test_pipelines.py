"""Whole jobs over small folders."""

import pytest

from docloom.functions.vocabulary import Vocabulary
from docloom.operators import embed, phrases
from docloom.plans import pipelines
from docloom.sources import corpus


@pytest.fixture
def folders(tmp_path):
    texts, vocab = tmp_path / "textos", tmp_path / "vocab"
    texts.mkdir()
    vocab.mkdir()
    for i in range(12):
        body = "O juiz julgou o processo de dano moral da parte.\n" * 4 if i % 2 else "A casa da rua tem porta verde e janela azul.\n" * 4
        (texts / f"doc {i:02d}.txt").write_text(body, encoding="utf-8")
    (texts / "vazio.txt").write_text("§§§", encoding="utf-8")
    (vocab / "VOCAB_BASE.txt").write_text("juiz processo dano moral parte casa rua porta verde janela azul", encoding="utf-8")
    (vocab / "VOCAB_TRADUTOR.txt").write_text("dano moral => dano_moral", encoding="utf-8")
    return str(texts), str(vocab), tmp_path


def test_curation_job(spark, folders):
    texts, vocab, out = folders
    rows = {r["termo"]: r for r in pipelines.curate_folder(spark, texts, vocab, str(out / "planilha")).collect()}
    assert rows["juiz"]["qtd"] == 24 and rows["juiz"]["vocab"] == "TERMO"
    assert rows["dano_moral"]["vocab"] == "TERMO (composto)"
    assert spark.read.option("header", True).csv(str(out / "planilha")).count() == len(rows)


def test_phrase_job(spark, folders):
    texts, _, out = folders
    found = {r["para"] for r in pipelines.phrase_folder(spark, texts, str(out / "frases"), min_count=3, threshold=0.1, include=["porta verde"]).collect()}
    assert "porta_verde" in found and "dano_moral" in found
    assert spark.read.text(str(out / "frases/sugeridos")).count() + spark.read.text(str(out / "frases/removidos")).count() == len(found)
    lines = phrases.sentence_tokens(corpus.read_texts(spark, texts), "path", "texto")
    report = pipelines.phrase_report(lines, [("dano", "moral")], [], width=60, most=5)
    assert report.count() == 5 and any("DANO_MORAL" in r["texto"] for r in pipelines.phrase_report(lines, [("dano", "moral")], []).collect())


def test_passage_job_is_incremental(spark, folders):
    texts, _, out = folders
    place = str(out / "frases")
    first = pipelines.split_folder(spark, texts, place).orderBy("sent_id").collect()
    assert [r["sent_id"] for r in first] == list(range(1, len(first) + 1)) and len(first) == 2
    assert pipelines.split_folder(spark, texts, place).count() == 0


def test_training_and_clustering_jobs(spark, folders):
    texts, vocab, out = folders
    pipelines.train_folder(spark, texts, vocab, str(out / "modelo"), dims=8, window=3, epochs=2, partitions=1)
    terms = pipelines.comparison_terms(embed.load(str(out / "modelo")))
    assert {"juiz", "casa"} <= {r["termo"] for r in terms.collect()}
    rows = pipelines.cluster_folder(spark, texts, vocab, str(out / "modelo"), str(out / "grupos"), 95, True).collect()
    assert len(rows) == 13 and {r["arquivo"]: r["grupo"] for r in rows}["vazio"] == -1
    groups = {r["arquivo"]: r["grupo"] for r in rows}
    assert len({groups[f"doc {i:02d}"] for i in range(0, 12, 2)}) == 1 and len({groups[f"doc {i:02d}"] for i in range(1, 12, 2)}) == 1
    assert sum(r["centroide"] for r in rows) == len({g for g in groups.values() if g > 0})
    assert {r["identico"] for r in rows} == {"Sim", ""}


def test_tokens_of_a_folder(spark, folders):
    texts, _, _ = folders
    tokens = pipelines.folder_tokens(spark, texts, Vocabulary())
    assert tokens.count() == 13


def test_jobs_from_the_command_line(spark, folders):
    from docloom.__main__ import main

    texts, vocab, out = folders
    main(["split", texts, str(out / "trechos"), "--tokens", "3"], spark)
    assert spark.read.parquet(str(out / "trechos")).count() == 2
    (out / "frases").mkdir()
    (out / "frases/ngramas_remover.txt").write_text("# fora\ndano moral\n", encoding="utf-8")
    main(["phrases", texts, str(out / "frases"), "--min-count", "3", "--threshold", "0.1"], spark)
    rules = {r["value"] for r in spark.read.text(str(out / "frases/sugeridos")).collect()}
    assert rules and "dano moral => dano_moral" not in rules
    assert spark.read.text(str(out / "frases/ngramas_incluir.txt")).count() == 1


def test_reports_are_kept(spark, folders):
    _, vocab, out = folders
    corpus.load_vocabulary(spark, vocab, str(out / "log"))
    assert [r["value"] for r in spark.read.text(str(out / "log/vocab_tradutor_termos")).collect()] == ["dano moral => dano_moral"]
    report = spark.createDataFrame([("fora", "b", 1), ("fora", "a", 2), ("termo", "c", 1)], "tipo string, token string, qtd bigint")
    pipelines.resolution_files(report, str(out / "oov"))
    assert pipelines.seed_lines(spark, str(out / "oov/fora")) == ["a", "b"]
