"""Queries of the core operators over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import textclean, translate, vocabulary
from docloom.operators import clusters, curation, embed, numbering, phrases, segments, vectors
from docloom.plans import pipelines, sqltext
from docloom.session import cut, free, load, shared_place, spread
from docloom.sources import corpus, tables

# Translation rules and edge of a sample configuration.
RULES = ["parte autora => parte_autora", "nexo causal => nexo_causal", "multa", "dano moral => dano_moral", "prazo prescricional => prazo_prescricional"]
STOPS = ["ao", "com", "como", "dos", "das", "em", "foi", "na", "no", "nos", "nao", "o", "os", "para", "pela", "pelo", "por", "que", "se", "sem", "um", "uma", *textclean.DIGIT_WORDS]
SIMILAR, CLOSE = 0.3, 0.9
AT = "2022-12-03 12:00:00"
MANY_RULES = [*RULES, *STOPS, *(f"{a} {b} => {a}_{b}" for a in textclean.DIGIT_WORDS for b in textclean.DIGIT_WORDS)]
WORD_RULES = {"recurso": "processo", "processo": "recurso", "dano moral": "dano_moral", "dano": "prejuízo"}
INCLUDED, EXCLUDED = ["# comentário", "a casa de", "minha_lista", "recurso especial"], ["# nada", "dano moral", "parte_autora"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token of more than one character."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(textclean.quick_tokens(F.col("text"))).alias("token")).where(F.length("token") > 1)


def _vocab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sheet = load(spark, sf_dir, "curadoria_planilha_vocab").where("termo IS NOT NULL")
    base = sheet.where("vocab LIKE 'TERMO%'").select(F.col("termo").alias("term")).distinct()
    return base, sheet.where("vocab = 'REMOVIDO'").select(F.col("termo").alias("term")).distinct()


def quick_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text of every document."""
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", textclean.quick_text(F.col("text")).alias("texto"))


def curation_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean TF-IDF of every term."""
    return curation.core_sheet(_tokens(spark, sf_dir))


def curation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole curation sheet against the vocabulary of earlier sheets."""
    base, removed = _vocab(spark, sf_dir)
    return curation.curation_sheet(_tokens(spark, sf_dir), base, removed)


def curation_boxplots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-plot positions of length and counts."""
    rows = curation.core_sheet(_tokens(spark, sf_dir)).select("termo", "tamanho", "qtd", "qtd_docs")
    return curation.with_boxplots(rows, ("tamanho", "qtd", "qtd_docs")).select("termo", "tamanho_bp", "qtd_bp", "qtd_docs_bp")


def strange_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strangeness of every term of the sheets."""
    terms = load(spark, sf_dir, "curadoria_planilha_vocab").where("termo IS NOT NULL AND termo <> ''").select("termo").distinct()
    return terms.select("termo", curation.strange(F.col("termo")).alias("estranho"))


def singular_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular of every token."""
    return _tokens(spark, sf_dir).select("token").distinct().select("token", vocabulary.singular(F.col("token")).alias("singular"))


def resolved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of every token against the sheets' vocabulary, without fragments."""
    base, _ = _vocab(spark, sf_dir)
    found = vocabulary.resolution(_tokens(spark, sf_dir), base, fragment=False)
    return found.select("token", "tipo", F.array_join("pecas", " ").alias("pecas"))


def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token is resolved in which way, with fragments."""
    base, _ = _vocab(spark, sf_dir)
    return vocabulary.resolution_report(_tokens(spark, sf_dir), base)


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final tokens of every document with translation rules, accepting all tokens."""
    vocab = vocabulary.Vocabulary(rules=tuple(translate.parse_rules(RULES)))
    return vocabulary.tokenize(_docs(spark, sf_dir), vocab).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> vocabulary.Vocabulary:
    """The sheets' vocabulary with the sample rules, as a tokenizer takes it; read by the driver like a vocabulary folder."""
    base, removed = _vocab(spark, sf_dir)
    return corpus.vocabulary_of(base, removed, translate.parse_rules(RULES))


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text of every document with links written before and after it."""
    linked = F.concat(F.lit("https://www.exemplo.com/a?b=1 http://exemplo.org/x "), F.col("text"), F.lit(" www.exemplo.net/y www.a.org"))
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", textclean.quick_text(linked).alias("texto"))


def vocabulary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final tokens of every document with the sheets' vocabulary: rules, removed terms, singulars and fragments."""
    found = vocabulary.tokenize(_docs(spark, sf_dir), _vocabulary(spark, sf_dir))
    return found.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def final_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base terms, outputs of rules and digit words, without removed terms and their plurals."""
    base, removed = _vocab(spark, sf_dir)
    outputs = spark.createDataFrame([(b,) for _, b in translate.parse_rules(RULES)], "term string")
    return vocabulary.final_terms(base, outputs, removed)


def removed_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms whose singular is removed, where every singular of a term and every removed term is."""
    base, removed = _vocab(spark, sf_dir)
    singular = base.select(vocabulary.singular(F.col("term")).alias("s"), "term").where("s <> term").select(F.col("s").alias("term"))
    return vocabulary.removed_plurals(base, removed.unionByName(singular))


def fragmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the sheets as stem and suffix, in order."""
    terms = load(spark, sf_dir, "curadoria_planilha_vocab").select(F.col("termo").alias("token"))
    return vocabulary.simple_fragments(terms).select(F.col("token").alias("termo"), "prefixo", "sufixo").orderBy("termo")


def sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as the translator takes them, from lines made of the sheets' terms."""
    lines = load(spark, sf_dir, "curadoria_planilha_vocab").where("termo IS NOT NULL").select(F.concat("termo", F.lit(" 7 => "), F.initcap("termo"), F.lit(" (nº 1)")).alias("l")).distinct()
    return translate.rules_frame(spark, translate.parse_rules([r["l"] for r in corpus.few(lines, "rules")])).select("src", "dst")


def many_rules_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts after more rules than are nested: digit pairs, stop words removed, and the sample rules."""
    return quick_texts(spark, sf_dir).select("doc_id", translate.translate_terms(F.col("texto"), translate.parse_rules(MANY_RULES)).alias("texto"))


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts after whole-word rules in one pass, in any case."""
    return quick_texts(spark, sf_dir).select("doc_id", translate.replace_words(F.upper("texto"), WORD_RULES).alias("texto"))


def translated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts after the translation rules."""
    quick = quick_texts(spark, sf_dir)
    return quick.select("doc_id", translate.translate_terms(F.col("texto"), translate.parse_rules(RULES)).alias("texto"))


def text_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stem and suffix forms of all tokens."""
    return vocabulary.text_vocabulary(_docs(spark, sf_dir))


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_bigrams(phrases.pieces(phrases.sentence_tokens(_docs(spark, sf_dir)), STOPS))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams mined between stop words."""
    return _bigrams(spark, sf_dir).select("w1", "w2", "n", F.round("score", 6).alias("score"))


def listed_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested rules with phrases of one's own included and others excluded."""
    return phrases.suggestions(_bigrams(spark, sf_dir), INCLUDED, EXCLUDED)


def bigram_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation rules suggested by the bigrams."""
    return phrases.suggestions(_bigrams(spark, sf_dir))


def longer_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of three and four words, mined after joining the bigrams."""
    return phrases.mine_phrases(phrases.sentence_tokens(_docs(spark, sf_dir)), STOPS)[1]


def phrased_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their bigrams joined."""
    lines = phrases.sentence_tokens(_docs(spark, sf_dir))
    pairs = phrases.phrase_list(_bigrams(spark, sf_dir))
    return lines.select("doc_id", "linha", F.array_join(phrases.apply_phrases(F.col("tokens"), pairs), " ").alias("tokens"))


def phrase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines with their phrases in capitals, cut to a width."""
    return pipelines.phrase_report(phrases.sentence_tokens(_docs(spark, sf_dir)), phrases.phrase_list(_bigrams(spark, sf_dir)), [])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document."""
    return segments.passages(_docs(spark, sf_dir))


def passages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct passages at their first place, numbered."""
    return segments.numbered(segments.first_occurrences(segments.passages(_docs(spark, sf_dir))))


def long_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 200 characters and ten words."""
    return segments.passages(_docs(spark, sf_dir), min_length=200, min_tokens=10)


def passage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many passages are new and how many repeat one."""
    return segments.deduplication_counts(segments.passages(_docs(spark, sf_dir)))


def new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines that no Portuguese document has."""
    docs = load(spark, sf_dir, "documents")
    split = lambda df: corpus.text_lines(df, "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("linha").alias("sent_no"), F.col("texto").alias("sentenca"))
    return segments.first_occurrences(split(docs), split(docs.where("lang = 'pt'")))


def lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines that aren't blank at their first place."""
    lines = corpus.text_lines(_docs(spark, sf_dir), "doc_id", "text")
    return segments.first_occurrences(lines.select(F.col("id").alias("doc_id"), F.col("linha").alias("sent_no"), F.col("texto").alias("sentenca")))


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every document: in its name, else beside it (here its source), else the mark of a hashed name."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "arquivo", corpus.tags(F.col("arquivo"), F.col("source")).alias("t"))
    hashed = F.col("t") == F.array(F.xxhash64("arquivo").cast("string"))
    return rows.select("doc_id", F.when(hashed, F.lit("#")).otherwise(F.array_join("t", " ")).alias("tags"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder and name of the files of token lists and texts."""
    paths = load(spark, sf_dir, "cache_plan").select("path").unionByName(load(spark, sf_dir, "util_doc2vec_facil").select("path"))
    return paths.distinct().select("path", corpus.folder_of(F.col("path")).alias("pasta"), corpus.stem_of(F.col("path")).alias("nome"))


def cached_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, kept in the shared folder and read from there."""
    tokens = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", textclean.quick_tokens(F.col("text")).alias("tokens"))
    kept = corpus.token_cache(tokens, shared_place(spark, "tokens"), "rapido")
    return kept.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def exported_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every term, written as a sheet and read from it."""
    place = shared_place(spark, "planilha")
    tables.write_sheet(curation.core_sheet(_tokens(spark, sf_dir)).select("termo", "tamanho", "qtd", "qtd_docs"), place)
    return spark.read.option("header", True).schema("termo string, tamanho bigint, qtd bigint, qtd_docs bigint").csv(place)


def comparison_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison list from the sheets: pairs of a fragment and its term whole and first, of other terms their tokens."""
    line = F.when(F.col("prefixo") != "", F.concat_ws(" = ", "prefixo", "termo")).otherwise(F.replace("termo", F.lit("_"), F.lit(" ")))
    return corpus.listed_comparisons(load(spark, sf_dir, "curadoria_planilha_vocab").where("termo IS NOT NULL").select(line.alias("value")).distinct())


def padded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and status padded, never cut."""
    rows = load(spark, sf_dir, "curadoria_planilha_vocab").where("termo IS NOT NULL AND vocab IS NOT NULL")
    return rows.select(F.concat(textclean.pad(F.col("termo"), 10), F.lit(" | "), textclean.pad(F.col("vocab"), 12)).alias("linha")).distinct()


def document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First characters of every document."""
    return _docs(spark, sf_dir).select("doc_id", textclean.preview(F.col("text")).alias("previa"))


def _own_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable vectors in force of vetores, one row per document."""
    return vectors.in_force(load(spark, sf_dir, "vetores"))


def similar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity view over vetores, one row per document: its class and number of links."""
    last = _own_vectors(spark, sf_dir)
    found = vectors.link_counts(last, 0.7, "seq_documento", "vetor")
    return found.select(F.col("id").alias("seq_documento"), "classe", "ligacoes")


def similar_pairs_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity view between the first documents of each distinct vector; ``similar_links`` has who shares one."""
    last = _own_vectors(spark, sf_dir)
    own = cut(vectors.usable(last, "seq_documento", "vetor"))
    first = own.join(cut(vectors.classes(own)).where("id = classe").select("id"), "id", "left_semi")
    pairs = vectors.similar_pairs(first, 0.7)
    free(own)
    return pairs.select(F.col("a").alias("seq_documento_1"), F.col("b").alias("seq_documento_2"), F.round("sim", 6).alias("sim"), F.round(F.col("sim") * 100, 2).alias("sim_100"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents similar above 0.8 to those whose number is divisible by 50, the most similar first."""
    last = _own_vectors(spark, sf_dir)
    asked = last.where("seq_documento % 50 = 0").select(F.col("seq_documento").alias("q"), F.col("vetor").alias("v"))
    return vectors.search(last, asked, 0.8, "seq_documento", "vetor").select(F.col("q").alias("seq_documento_1"), F.col("id").alias("seq_documento_2"), F.round("sim", 6).alias("sim"))


def vectors_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors inserted as JSON text: their length and sum; null where the text is no vector."""
    rows = load(spark, sf_dir, "vetores").select("seq_documento", "pagina", F.when(F.forall("vetor", lambda x: ~F.isnan(x)), F.to_json("vetor")).alias("vetor"))
    made = tables.vectors_from_json(rows)
    return made.select("seq_documento", F.size("vetor").alias("n"), F.round(F.aggregate("vetor", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("soma"))


def pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and one minus the distance of every embedding to the first of its label."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    first = rows.groupBy("label").agg(F.min_by("embedding", "id").alias("primeiro"))
    measured = rows.join(first, "label")
    return measured.select("id", F.round(vectors.similarity(F.col("embedding"), F.col("primeiro")), 6).alias("cosseno"), F.round(vectors.similarity(F.col("embedding"), F.col("primeiro"), "euclidean"), 6).alias("distancia"))


def _heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return rows, rows.where("q % 10 = 0").select(F.col("q").cast("int").alias("grupo"), "v")


def best_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of given centroids for every embedding."""
    found = clusters.best_group(*_heads(spark, sf_dir), SIMILAR)
    return found.select("q", "grupo", F.round("similaridade", 4).alias("similaridade"))


def nearest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by one minus the euclidean distance."""
    found = clusters.best_group(*_heads(spark, sf_dir), 0.01, "euclidean")
    return found.select("q", "grupo", F.round("similaridade", 4).alias("similaridade"))


def compared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every embedding the similar ones with another label's name, with whole percents, the most similar first."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vetor"), F.concat(F.lit("nome "), "label").alias("nome"))
    found = embed.compare_documents(rows, SIMILAR, name_col="nome")
    return found.select("id", F.array_join(F.transform("similares", lambda x: F.concat_ws(":", x["id"].cast("string"), x["pct"].cast("string"))), " ").alias("similares"))


def similar_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of embeddings."""
    return vectors.similar_pairs(load(spark, sf_dir, "embeddings"), SIMILAR, "vec_id", "embedding").select("a", "b", F.round("sim", 6).alias("sim"))


def top_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each embedding the three most similar above the limit."""
    pairs = vectors.similar_pairs(load(spark, sf_dir, "embeddings"), SIMILAR, "vec_id", "embedding")
    return vectors.top_similar(pairs, 3).select("id_1", "id_2", "ordem")


def search_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings similar to those whose number is divisible by 50."""
    rows = load(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return vectors.search(rows, asked, SIMILAR, "vec_id", "embedding").select("q", "id", F.round("sim", 6).alias("sim"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("rotulo"))


def label_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar embeddings with different labels."""
    pairs = vectors.similar_pairs(load(spark, sf_dir, "embeddings"), SIMILAR, "vec_id", "embedding")
    return vectors.label_review(pairs, _labels(spark, sf_dir), SIMILAR).select("a", "b", "rotulo_a", "rotulo_b")


def label_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that the neighbours of each embedding have most often."""
    pairs = vectors.similar_pairs(load(spark, sf_dir, "embeddings"), 0.25, "vec_id", "embedding")
    return vectors.label_suggestions(pairs, _labels(spark, sf_dir), 0.25, only_missing=False).select("id", "rotulo", "votos")


def density_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and summed similarity of every embedding with a similar one."""
    pairs = vectors.similar_pairs(load(spark, sf_dir, "embeddings"), SIMILAR, "vec_id", "embedding", inclusive=True)
    return clusters.densities(vectors.mirrored(pairs)).select("id", "ligacoes", F.round("soma", 5).alias("soma"))


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering of vetores in row order."""
    return clusters.leader(_own_vectors(spark, sf_dir), 90, "seq_documento", "vetor")


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering of vetores by density."""
    rows = load(spark, sf_dir, "vetores")
    found = clusters.density(rows, _own_vectors(spark, sf_dir), 90, session="consulta")
    return found.withColumn("sim", F.round("sim", 6))


def density_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of that clustering."""
    groups = cut(density_clusters(spark, sf_dir))
    return clusters.audit(groups, _own_vectors(spark, sf_dir), "consulta", 90)


def clustering_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of that clustering."""
    groups = cut(density_clusters(spark, sf_dir))
    return tables.clustering_log(groups, "consulta").select("sessao", "ordem", "txt_log")


def clustered_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustering in row order as a sheet: groups first, each from its centroid downwards, with a place for each row."""
    rows = clusters.sheet_order(leader_clusters(spark, sf_dir), ["id"])
    return numbering.numbered_by(rows, ["ultimo", F.col("grupo"), F.desc("similaridade"), F.desc("centroide"), F.col("id")], "lugar").select("id", "grupo", "lugar")


def kept_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the similarity matrix by session, of sessions that still have groups."""
    held = tables.kept_matrix(load(spark, sf_dir, "grupos_matriz_tmp"), retained_groups(spark, sf_dir))
    return held.groupBy("sessao").agg(F.count(F.lit(1)).alias("linhas"))


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering of embeddings in row order at a low limit."""
    return clusters.leader(load(spark, sf_dir, "embeddings"), 30, "vec_id", "embedding")


def identical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the texts of clustered files are those of their centroid."""
    rows = load(spark, sf_dir, "util_agrupamento_facil")
    # A group of the sheet may name several centroids: the smallest file stands for it.
    first = rows.where("centroide = 1 AND grupo > 0 AND texto IS NOT NULL").groupBy("grupo").agg(F.min("arquivo_id").alias("c"))
    marked = rows.join(first, "grupo", "left").select(F.col("arquivo_id").alias("id"), "grupo", F.coalesce((F.col("arquivo_id") == F.col("c")).cast("int"), F.lit(0)).alias("centroide"))
    tokens = rows.select(F.col("arquivo_id").alias("id"), textclean.quick_tokens(F.col("texto")).alias("tokens"))
    return clusters.identical_to_centroid(marked, tokens).select("id", "grupo", "identico")


def session_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of earlier runs by size, renumbered within their session."""
    rows = load(spark, sf_dir, "grupos").where("grupo > 0").groupBy("sessao", "grupo").agg(F.countDistinct("seq_documento").alias("tamanho"))
    from pyspark.sql import Window

    return rows.withColumn("novo", F.row_number().over(Window.partitionBy("sessao").orderBy(F.desc("tamanho"), "grupo")))


def retained_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusterings kept at a fixed time."""
    rows = load(spark, sf_dir, "grupos")
    return tables.retained(rows, rows, AT, group_hours=24 * 20)[0].select("seq_documento", "grupo", "sessao")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents from a model trained on their tokens."""
    # Nulls go after the cut: a filter before it is pushed below the projection, and each text is cleaned twice.
    tokens = cut(_docs(spark, sf_dir).select("doc_id", textclean.quick_tokens(F.col("text")).alias("tokens"))).where("tokens IS NOT NULL")
    return embed.infer(embed.train(tokens), tokens).select("doc_id", "vetor")


_ALL = (
    quick_texts, linked_texts, curation_core, curation_sheet, curation_boxplots, exported_sheet, strange_terms, singular_forms, resolved_tokens, resolution_report, tokenized, vocabulary_tokens,
    final_vocabulary, removed_plurals, fragmented_terms, sheet_rules, translated_texts, many_rules_texts, word_rules, text_vocabulary, bigrams, bigram_suggestions, listed_suggestions, longer_phrases,
    phrased_texts, phrase_report, passages, long_passages, passages_once, passage_counts, lines_once, new_lines, document_tags, path_parts, cached_tokens, comparison_list, padded_terms,
    document_previews, similar_links, similar_pairs_of_classes, similar_documents, vectors_from_text, pair_measures, similar_embeddings, top_embeddings, search_embeddings, best_groups,
    nearest_groups, compared_documents, label_review, label_suggestions, density_ranking, leader_clusters, density_clusters, density_audit, clustering_log, clustered_sheet, embedding_clusters,
    identical_texts, session_sizes, retained_groups, kept_matrix, document_vectors,
)
QUERIES = {q.__name__: q for q in _ALL}

_DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_CLEAN = sqltext.quick_steps(_DOCS, "text", "doc_id")
_TOKENS = f"{_CLEAN},\ntok AS (SELECT doc_id, w AS token FROM (SELECT doc_id, unnest({sqltext.tokens_of('t')}) AS w FROM limpo) WHERE length(w) > 1)"
_COUNTS = f"{_TOKENS},\ntf AS (SELECT doc_id, token AS termo, count(*) AS tf FROM tok GROUP BY 1, 2),\ndf AS (SELECT termo, sum(tf)::BIGINT AS qtd, count(*) AS qtd_docs FROM tf GROUP BY 1),\nn AS (SELECT count(DISTINCT doc_id) AS n FROM tf)"
_WEIGHTS = "w AS (SELECT doc_id, termo, tf.tf * log2(n.n / df.qtd_docs) AS w FROM tf JOIN df USING (termo), n WHERE df.qtd_docs < n.n),\np AS (SELECT termo, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS peso FROM w),\nm AS (SELECT termo, round_even(avg(peso), 5) AS tfidf FROM p GROUP BY 1)"
_VOCAB = "base AS (SELECT DISTINCT termo AS term FROM curadoria_planilha_vocab WHERE vocab LIKE 'TERMO%' AND termo IS NOT NULL),\nremovido AS (SELECT DISTINCT termo AS term FROM curadoria_planilha_vocab WHERE vocab = 'REMOVIDO' AND termo IS NOT NULL)"


def _box(column: str) -> str:
    labels = curation.BOXPLOT
    limits = ["q.q[1] - 1.5 * (q.q[4] - q.q[1])", "q.q[1]", "q.q[2]", "q.q[3]", "q.q[4]", "q.q[4] + 1.5 * (q.q[4] - q.q[1])"]
    cases = " ".join(f"WHEN {column} < {limit} THEN {sqltext.quote(label)}" for limit, label in zip(limits, labels))
    return f"(SELECT CASE WHEN {column} = 0 THEN '' {cases} ELSE {sqltext.quote(labels[6])} END FROM (SELECT quantile_cont({column}, [0.25, 0.495, 0.505, 0.75]) AS q FROM s WHERE {column} > 0) q)"


def _rules_sql(expr: str, lines: list[str] = RULES) -> str:
    expr = f"' ' || {expr} || ' '"
    for a, b in translate.parse_rules(lines):
        expr = f"replace({expr}, ' {a} ', ' {b} ')"
    return f"trim({expr})"


_STOPS = ", ".join(sqltext.quote(s) for s in STOPS)
_LINE_CLEAN = sqltext.quick_steps("(SELECT doc_id, i AS linha, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)))", "text", "doc_id, linha")
_BIGRAMS = f"""
WITH {_LINE_CLEAN},
listas AS (SELECT row_number() OVER () AS s, {sqltext.tokens_of('t')} AS w FROM limpo),
soltos AS (SELECT s, i AS pos, w[i] AS token FROM (SELECT s, w, unnest(range(1, len(w) + 1)) AS i FROM listas)),
corridas AS (SELECT s, pos, token, token IN ({_STOPS}) AS parada, sum(CASE WHEN token IN ({_STOPS}) THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY pos) AS c FROM soltos),
pecas AS (SELECT *, count(*) OVER (PARTITION BY s, c) AS k, lead(token) OVER (PARTITION BY s, c ORDER BY pos) AS seguinte FROM corridas WHERE NOT parada),
uteis AS (SELECT * FROM pecas WHERE k > 1),
palavras AS (SELECT token, count(*) AS n FROM uteis GROUP BY 1),
pares AS (SELECT token AS w1, seguinte AS w2, count(*) AS n FROM uteis WHERE seguinte IS NOT NULL GROUP BY 1, 2),
v AS (SELECT (SELECT count(*) FROM palavras) + (SELECT count(*) FROM pares) AS v),
notas AS (SELECT w1, w2, pares.n, (pares.n - 10) * v.v / (a.n * b.n) AS score FROM pares JOIN palavras a ON a.token = w1 JOIN palavras b ON b.token = w2, v WHERE pares.n >= 10),
achados AS (SELECT * FROM notas WHERE score > 20)
"""
_EDGES = ", ".join(sqltext.quote(w) for w in phrases.EDGE_WORDS)
_UNIT = "u AS (SELECT vec_id AS id, label AS rotulo, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),\nx AS (SELECT id, rotulo, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM u)"
_DIRECTED = f"{_UNIT},\ne AS (SELECT p.id AS id_1, q.id AS id_2, list_dot_product(p.v, q.v) AS sim, p.rotulo AS r1, q.rotulo AS r2 FROM x p JOIN x q ON p.id <> q.id)"

_SHEET = f"""
nucleo AS (SELECT termo, coalesce(tfidf, 0) AS tfidf, length(termo) AS tamanho, qtd, qtd_docs FROM df LEFT JOIN m USING (termo) WHERE length(termo) <= 50 OR contains(termo, '_')),
linhas AS (SELECT * FROM nucleo UNION ALL SELECT term, 0, length(term), 0, 0 FROM base WHERE term NOT IN (SELECT termo FROM nucleo)),
{sqltext.stems('linhas', 'termo')},
{sqltext.fragments()},
s AS (SELECT termo, prefixo, sufixo, tfidf, tamanho, qtd, qtd_docs, termo IN (FROM base) AS b, termo IN (FROM removido) AS r, prefixo IN (FROM base) AS p, sufixo IN (FROM base) AS x, contains(termo, '_') AS k FROM linhas JOIN partes ON token = termo)
"""
_STATUS = "CASE WHEN r THEN 'REMOVIDO' WHEN k AND b THEN 'TERMO (composto)' WHEN k THEN 'NÃO (composto)' WHEN b THEN 'TERMO' WHEN p AND x THEN 'PREFIXO+SUFIXO' WHEN p THEN 'PREFIXO' ELSE 'NÃO' END"
_DIGITS = ", ".join(f"({sqltext.quote(w)})" for w in textclean.DIGIT_WORDS)
_OUTPUTS = ", ".join(f"({sqltext.quote(b)})" for _, b in translate.parse_rules(RULES) if b)
_FINAL = f"""
tudo AS (SELECT term FROM base UNION SELECT * FROM (VALUES {_OUTPUTS}) UNION SELECT * FROM (VALUES {_DIGITS})),
formas AS (SELECT term, {sqltext.singular('term')} AS s FROM tudo),
final AS (SELECT term FROM formas WHERE term NOT IN (FROM removido) AND NOT (s <> term AND s IN (FROM removido) AND NOT contains(term, '_')))
"""
_RESOLVED = f"""
distintos AS (SELECT DISTINCT token, {sqltext.singular('token')} AS s FROM ditos),
{sqltext.stems('distintos', 'token')},
juntos AS (SELECT d.token, s, radical, substr(d.token, length(radical) + 1) AS sufixo FROM distintos d JOIN radicais USING (token)),
resolvidos AS (SELECT token, CASE WHEN s <> token AND s IN (FROM vocab) THEN 'singular' WHEN token IN (FROM vocab) THEN 'termo' WHEN length(token) = 1 OR contains(token, '_') THEN 'fora' WHEN radical IN (FROM vocab) THEN 'fragmento' ELSE 'fora' END AS tipo, s, radical,
  CASE WHEN sufixo <> '' AND sufixo IN (FROM vocab) THEN '#' || sufixo ELSE '#OOV' END AS resto FROM juntos)
"""
_MERGED = f"""
frases AS (SELECT list(w1 || ' ' || w2) AS f FROM achados),
unidos AS (SELECT doc_id, linha, substr(list_reduce(w, lambda dito, t: CASE WHEN list_contains(f, regexp_extract(dito, '[^ ]+$') || ' ' || t) THEN dito || '_' || t ELSE dito || ' ' || t END, ''), 2) AS t FROM (SELECT doc_id, linha, {sqltext.tokens_of('t')} AS w FROM limpo) x, frases WHERE len(w) > 0)
"""
_LONGER = f"""{_BIGRAMS}, {_MERGED},
listas2 AS (SELECT row_number() OVER () AS s, string_split(t, ' ') AS w FROM unidos),
soltos2 AS (SELECT s, i AS pos, w[i] AS token FROM (SELECT s, w, unnest(range(1, len(w) + 1)) AS i FROM listas2)),
corridas2 AS (SELECT s, pos, token, token IN ({_STOPS}) AS parada, sum(CASE WHEN token IN ({_STOPS}) THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY pos) AS c FROM soltos2),
uteis2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY s, c) AS k, lead(token) OVER (PARTITION BY s, c ORDER BY pos) AS seguinte FROM corridas2 WHERE NOT parada) WHERE k > 1),
palavras2 AS (SELECT token, count(*) AS n FROM uteis2 GROUP BY 1),
pares2 AS (SELECT token AS w1, seguinte AS w2, count(*) AS n FROM uteis2 WHERE seguinte IS NOT NULL GROUP BY 1, 2),
v2 AS (SELECT (SELECT count(*) FROM palavras2) + (SELECT count(*) FROM pares2) AS v)
"""
_SPACE = "[\\s\\v\\p{Z}\\x1c-\\x1f\\x85]"
_PLAIN = f"regexp_replace(p, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_ABBREVIATED = "(?i)(?:" + "|".join("(^|[^\\p{L}\\p{N}_])" + a for a in segments.ABBREVIATIONS) + f")\\.{_SPACE}*$"
_JOINED = f"""
marcas AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda l: replace(regexp_replace(regexp_replace(regexp_replace(l, '(\\d)\\.(\\d)', '\\1\\2', 'g'), '(\\d)\\.(\\d)', '\\1\\2', 'g'), '([?!]) ', '\\1' || chr(10), 'g'), '.', '.' || chr(10))) AS linhas FROM documents WHERE text IS NOT NULL),
soltas AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, list_filter(flatten(list_transform(linhas, lambda l: string_split(l, chr(10)))), lambda q: q <> '') AS ps FROM marcas)),
ditas AS (SELECT doc_id, i, p, regexp_matches(q, '[.?!]$') AND NOT regexp_matches(q, '{_ABBREVIATED}') AS fim FROM (SELECT *, {_PLAIN} AS q FROM soltas)),
numeradas AS (SELECT *, coalesce(sum(fim::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ditas),
juntas AS (SELECT doc_id, g, {_PLAIN} AS p FROM (SELECT doc_id, g, coalesce(string_agg(regexp_replace(p, '{_SPACE}+$', ''), ' ' ORDER BY i) FILTER (regexp_matches(p, '[^\\s\\v\\p{{Z}}\\x1c-\\x1f\\x85]')), '') AS p FROM numeradas GROUP BY doc_id, g))
"""
_WORDS = "len(list_filter(string_split({0}, ' '), lambda w: length(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_á-ú]', '', 'g')) > 2))"
_PASSAGES = f"{_JOINED},\npassagens AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INT AS sent_no, {sqltext.mapped('p', sqltext.decompositions())} AS sentenca FROM juntas WHERE {_WORDS.format('p')} >= 5)"
# Stretches grow in a text of its own, cut by chr(2); what fills none is after the last.
_LONG = f"""{_JOINED},
cheias AS (SELECT doc_id, string_split(list_reduce(ps, lambda a, q: a || ' ' || q || CASE WHEN length(regexp_extract(a || ' ' || q, '[^\x02]*$')) >= 200 THEN chr(2) ELSE '' END, ''), chr(2)) AS t FROM (SELECT doc_id, list(p ORDER BY g) AS ps FROM juntas GROUP BY doc_id)),
boas AS (SELECT doc_id, list_filter(t[:-2], lambda x: {_WORDS.format('trim(x)')} >= 10) AS k, t[-1] AS resto FROM cheias),
prontas AS (SELECT doc_id, CASE WHEN resto = '' THEN k WHEN len(k) > 0 THEN list_append(k[:-2], k[-1] || ' ' || resto) WHEN len(string_split(trim(resto), ' ')) >= 10 THEN [resto] ELSE [] END AS k FROM boas),
passagens AS (SELECT doc_id, i::INT AS sent_no, {sqltext.mapped('p', sqltext.decompositions())} AS sentenca FROM (SELECT doc_id, i, {_PLAIN.replace('(p,', '(x,')} AS p FROM (SELECT doc_id, generate_subscripts(k, 1) AS i, unnest(k) AS x FROM prontas)))
"""
_IN_FORCE = "l AS (SELECT seq_documento AS id, max({'d': coalesce(dthr, TIMESTAMPTZ '0001-01-01'), 'p': coalesce(pagina, -2147483648), 'v': coalesce(vetor, [])}) AS m FROM vetores WHERE seq_documento IS NOT NULL GROUP BY 1),\nf AS (SELECT id, m.v::DOUBLE[] AS v FROM l WHERE len(m.v) = 128 AND NOT list_contains(list_transform(m.v, lambda e: e IS NULL OR NOT isfinite(e)), true) AND list_contains(list_transform(m.v, lambda e: e <> 0), true)),\nx AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM f)"
_BY_ID = "ordem AS (SELECT id, v, row_number() OVER (ORDER BY id) AS rn FROM x)"
_LEADER = "tam AS (SELECT centro, count(*) AS n, min(rn) AS primeiro FROM donos JOIN ordem USING (id) GROUP BY 1 HAVING count(*) > 1),\nnum AS (SELECT centro, row_number() OVER (ORDER BY primeiro)::INT AS grupo FROM tam),\nlider AS (SELECT id, grupo, round_even(100 * sim, 2) AS similaridade, (id = centro)::INT AS centroide FROM donos JOIN num USING (centro))"
_BY_DENSITY = "graus AS (SELECT a.id, any_value(a.v) AS v, count(*) AS n, round(sum(list_dot_product(a.v, b.v)), 9) AS s FROM x a JOIN x b ON a.id <> b.id AND round(list_dot_product(a.v, b.v), 12) >= 0.9 GROUP BY a.id),\nordem AS (SELECT id, v, row_number() OVER (ORDER BY n DESC, s DESC, id) AS rn FROM graus)"
_DENSITY = f"WITH RECURSIVE {_IN_FORCE},\n{_BY_DENSITY},{sqltext.cover('ordem', 0.9, True)},\ntam AS (SELECT centro, count(*) AS n FROM donos GROUP BY 1 HAVING count(*) > 1),\nnum AS (SELECT centro, row_number() OVER (ORDER BY n DESC, centro)::INT AS grupo FROM tam),\ndens AS (SELECT d.id AS seq_documento, coalesce(grupo, CASE WHEN x.id IS NULL THEN -2 ELSE -1 END)::INT AS grupo, coalesce(o.id = o.centro AND grupo IS NOT NULL, false) AS centroide, CASE WHEN grupo IS NOT NULL THEN sim END AS sim FROM (SELECT DISTINCT seq_documento AS id FROM vetores WHERE seq_documento IS NOT NULL) d LEFT JOIN x USING (id) LEFT JOIN donos o USING (id) LEFT JOIN num USING (centro))"
_HEADS = "heads AS (SELECT id::INT AS grupo, v FROM e0 WHERE id % 10 = 0)"
_CLASSES = "c AS (SELECT id, min(id) OVER (PARTITION BY list_transform(v, lambda e: round(e, 9))) AS classe, v FROM x)"

ORACLES = {
    "quick_texts": f"WITH {_CLEAN} SELECT doc_id, t AS texto FROM limpo",
    "curation_core": f"WITH {_COUNTS},\n{_WEIGHTS} SELECT termo, coalesce(tfidf, 0) AS tfidf, length(termo) AS tamanho, qtd, qtd_docs FROM df LEFT JOIN m USING (termo) WHERE length(termo) <= 50 OR contains(termo, '_')",
    "curation_boxplots": f"WITH {_COUNTS},\ns AS (SELECT termo, length(termo) AS tamanho, qtd, qtd_docs FROM df WHERE length(termo) <= 50) SELECT termo, {_box('tamanho')} AS tamanho_bp, {_box('qtd')} AS qtd_bp, {_box('qtd_docs')} AS qtd_docs_bp FROM s",
    "strange_terms": f"SELECT DISTINCT termo, {sqltext.strange('termo')} AS estranho FROM curadoria_planilha_vocab WHERE termo IS NOT NULL AND termo <> ''",
    "singular_forms": f"WITH {_TOKENS} SELECT DISTINCT token, {sqltext.singular('token')} AS singular FROM tok",
    "resolved_tokens": f"WITH {_TOKENS},\n{_VOCAB},\nd AS (SELECT DISTINCT token, {sqltext.singular('token')} AS s FROM tok) SELECT token, CASE WHEN s <> token AND s IN (FROM base) THEN 'singular' WHEN token IN (FROM base) THEN 'termo' WHEN length(token) = 1 OR contains(token, '_') THEN 'fora' ELSE 'inteiro' END AS tipo, CASE WHEN s <> token AND s IN (FROM base) THEN s WHEN token IN (FROM base) THEN token WHEN length(token) = 1 OR contains(token, '_') THEN '' ELSE token END AS pecas FROM d",
    "tokenized": f"WITH {_CLEAN},\nr AS (SELECT doc_id, list_filter(string_split({_rules_sql('t')}, ' '), lambda w: length(w) > 1) AS w FROM limpo) SELECT doc_id, CASE WHEN len(w) = 0 THEN '.' ELSE array_to_string(w, ' ') END AS tokens FROM r",
    "removed_plurals": f"WITH {_VOCAB},\nf AS (SELECT term, {sqltext.singular('term')} AS s FROM base WHERE NOT contains(term, '_')) SELECT DISTINCT term FROM f WHERE s <> term AND (s IN (FROM removido) OR s IN (SELECT s FROM f WHERE s <> term))",
    "translated_texts": f"WITH {_CLEAN} SELECT doc_id, {_rules_sql('t')} AS texto FROM limpo",
    "bigrams": f"{_BIGRAMS} SELECT w1, w2, n, round(score, 6) AS score FROM achados",
    "bigram_suggestions": f"{_BIGRAMS} SELECT w1 || ' ' || w2 AS de, w1 || '_' || w2 AS para, NOT (w1 IN ({_EDGES}) OR w2 IN ({_EDGES})) AS aceito FROM achados",
    "lines_once": "WITH l AS (SELECT doc_id, i - 1 AS sent_no, parts[i] AS sentenca FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))), k AS (SELECT * FROM l WHERE trim(sentenca, ' ') <> '') SELECT (min({'d': doc_id, 's': sent_no})).d AS doc_id, (min({'d': doc_id, 's': sent_no})).s::INT AS sent_no, sentenca, count(*) AS vezes FROM k GROUP BY sentenca",
    "document_tags": "WITH t AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(arquivo, '(?i)\\btags?\\b.*'), '(?i)\\(\\d+\\)|\\btags?\\b', ' ', 'g'), '\\s+'), lambda w: w <> ''), ' ') AS t, array_to_string(list_filter(regexp_split_to_array(coalesce(source, ''), '\\s+'), lambda w: w <> ''), ' ') AS b FROM documents) SELECT doc_id, CASE WHEN t <> '' THEN t WHEN b <> '' THEN b ELSE '#' END AS tags FROM t",
    "document_previews": "SELECT doc_id, CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || ' [..]' ELSE text END AS previa FROM documents",
    "similar_links": f"WITH {_IN_FORCE},\n{_CLASSES},\nk AS (SELECT a.id, count(b.id) AS ligacoes FROM x a LEFT JOIN x b ON a.id <> b.id AND list_dot_product(a.v, b.v) > 0.7 GROUP BY a.id) SELECT id AS seq_documento, classe, ligacoes FROM k JOIN c USING (id)",
    "similar_pairs_of_classes": f"WITH {_IN_FORCE},\n{_CLASSES},\nr AS (SELECT id, v FROM c WHERE id = classe),\ne AS (SELECT a.id AS p, b.id AS q, list_dot_product(a.v, b.v) AS s FROM r a JOIN r b ON a.id < b.id) SELECT p AS seq_documento_1, q AS seq_documento_2, round(s, 6) AS sim, round(s * 100, 2) AS sim_100 FROM e WHERE s > 0.7",
    "similar_documents": f"WITH {_IN_FORCE} SELECT a.id AS seq_documento_1, b.id AS seq_documento_2, round(list_dot_product(a.v, b.v), 6) AS sim FROM x a JOIN x b ON a.id <> b.id AND a.id % 50 = 0 AND list_dot_product(a.v, b.v) > 0.8",
    "vectors_from_text": "SELECT seq_documento, CASE WHEN vetor IS NULL OR list_contains(list_transform(vetor, lambda e: isnan(e)), true) THEN NULL ELSE len(vetor)::INT END AS n, CASE WHEN NOT list_contains(list_transform(vetor, lambda e: isnan(e)), true) THEN round(list_sum(list_transform(vetor, lambda e: e::DOUBLE)), 4) END AS soma FROM vetores",
    "pair_measures": "WITH p AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS q FROM embeddings GROUP BY 1) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosseno, round(1 - list_distance(embedding::DOUBLE[], q), 6) AS distancia FROM embeddings JOIN p USING (label)",
    "best_groups": f"WITH {_UNIT},\ns AS (SELECT p.id, h.id::INT AS grupo, round(list_dot_product(p.v, h.v), 12) AS sim FROM x p JOIN x h ON h.id % 10 = 0),\nm AS (SELECT id, arg_min(grupo, (-sim, grupo)) AS grupo, max(sim) AS sim FROM s WHERE sim >= {SIMILAR} GROUP BY 1) SELECT vec_id AS q, coalesce(grupo, -1) AS grupo, round(coalesce(100 * sim, 0), 4) AS similaridade FROM embeddings LEFT JOIN m ON id = vec_id",
    "nearest_groups": "WITH s AS (SELECT p.vec_id AS id, h.vec_id::INT AS grupo, round(1 - list_distance(p.embedding::DOUBLE[], h.embedding::DOUBLE[]), 12) AS sim FROM embeddings p JOIN embeddings h ON h.vec_id % 10 = 0),\nm AS (SELECT id, arg_min(grupo, (-sim, grupo)) AS grupo, max(sim) AS sim FROM s WHERE sim >= 0.01 GROUP BY 1) SELECT vec_id AS q, coalesce(grupo, -1) AS grupo, round(coalesce(100 * sim, 0), 4) AS similaridade FROM embeddings LEFT JOIN m ON id = vec_id",
    "compared_documents": f"WITH {_DIRECTED} SELECT id_1 AS id, string_agg(id_2 || ':' || trunc(sim * 100)::INT, ' ' ORDER BY sim DESC, id_2) AS similares FROM e WHERE sim >= {SIMILAR} AND r1 IS DISTINCT FROM r2 GROUP BY 1",
    "leader_clusters": f"WITH RECURSIVE {_IN_FORCE},\n{_BY_ID},{sqltext.cover('ordem', 0.9)},\n{_LEADER} SELECT x.id, coalesce(grupo, -1) AS grupo, coalesce(similaridade, 0) AS similaridade, coalesce(centroide, 0) AS centroide FROM x LEFT JOIN lider USING (id)",
    "clustered_sheet": f"WITH RECURSIVE {_IN_FORCE},\n{_BY_ID},{sqltext.cover('ordem', 0.9)},\n{_LEADER},\nt AS (SELECT x.id, coalesce(grupo, -1) AS grupo, coalesce(similaridade, 0) AS s, coalesce(centroide, 0) AS c FROM x LEFT JOIN lider USING (id)) SELECT id, grupo, row_number() OVER (ORDER BY grupo < 0, grupo, s DESC, c DESC, id) AS lugar FROM t",
    "embedding_clusters": f"WITH RECURSIVE {_UNIT},\n{_BY_ID},{sqltext.cover('ordem', SIMILAR)},\n{_LEADER} SELECT x.id, coalesce(grupo, -1) AS grupo, coalesce(similaridade, 0) AS similaridade, coalesce(centroide, 0) AS centroide FROM x LEFT JOIN lider USING (id)",
    "density_clusters": f"{_DENSITY} SELECT seq_documento, grupo, 'consulta' AS sessao, centroide, round(sim, 6) AS sim FROM dens",
    "clustering_log": f"{_DENSITY},\nn AS (SELECT count(*) AS t, count(*) FILTER (grupo = -2) AS s, count(*) FILTER (centroide) AS g, count(*) FILTER (grupo = -1) AS o FROM dens) SELECT 'consulta' AS sessao, unnest(range(1, 7))::INT AS ordem, unnest(['Início do agrupamento da sessão consulta', s || ' documentos sem vetor', (t - s) || ' documentos com vetor', g || ' grupos formados', o || ' documentos sem grupo', 'Agrupamento concluído']) AS txt_log FROM n",
    "density_audit": f"{_DENSITY},\nv AS (SELECT dens.*, x.v FROM dens JOIN x ON x.id = seq_documento),\nk AS (SELECT seq_documento AS c, grupo AS gc, v AS cv FROM v WHERE centroide),\npar AS (SELECT v.*, c, gc, list_dot_product(v, cv) AS d FROM v JOIN k ON c <> seq_documento),\nr AS (SELECT 1 AS ordem, 'Avaliando similaridade >= 90' AS mensagem, 'ok' AS resultado UNION ALL SELECT 2, 'Total de registros no grupo', (SELECT count(*) FROM dens)::VARCHAR UNION ALL SELECT 3, 'Total de grupos criados', (SELECT count(*) FROM dens WHERE centroide)::VARCHAR UNION ALL SELECT 4, 'Verificação de órfãos', CASE WHEN (SELECT count(*) FROM par WHERE grupo = -1 AND round(d, 6) >= 0.9) = 0 THEN 'ok' ELSE 'falha' END UNION ALL SELECT 5, 'Verificação de melhores similaridades', CASE WHEN (SELECT count(*) FROM par WHERE grupo > 0 AND NOT centroide AND gc <> grupo AND d > sim + 1e-6) = 0 THEN 'ok' ELSE 'falha' END UNION ALL SELECT 6, 'Verificação se tem só um centróide por grupo ', CASE WHEN (SELECT count(*) FROM (SELECT grupo FROM dens WHERE grupo > 0 AND centroide GROUP BY 1 HAVING count(*) > 1)) = 0 THEN 'ok' ELSE 'falha' END UNION ALL SELECT 7, 'Verificação se existe 1 centróide por grupo ', CASE WHEN (SELECT count(*) FROM dens WHERE grupo > 0 AND grupo NOT IN (SELECT grupo FROM dens WHERE centroide)) = 0 THEN 'ok' ELSE 'falha' END UNION ALL SELECT 8, 'Verificação das similaridades calculadas', CASE WHEN (SELECT count(*) FROM par WHERE grupo = gc AND abs(d - sim) > 0.01) = 0 THEN 'ok' ELSE 'falha' END) SELECT * FROM r",
    "kept_matrix": f"SELECT sessao, count(*) AS linhas FROM grupos_matriz_tmp WHERE sessao IN (SELECT sessao FROM grupos WHERE dthr >= TIMESTAMPTZ '{AT}+00' - INTERVAL 480 HOURS) GROUP BY 1",
    "curation_sheet": f"WITH {_COUNTS},\n{_WEIGHTS},\n{_VOCAB},{_SHEET} SELECT termo, prefixo, sufixo, tfidf, tamanho, qtd, qtd_docs, {_STATUS} AS vocab, CASE WHEN k OR b OR r THEN 'N' ELSE {sqltext.strange('termo')} END AS estranho, {_box('tfidf')} AS tfidf_bp, {_box('tamanho')} AS tamanho_bp, {_box('qtd')} AS qtd_bp, {_box('qtd_docs')} AS qtd_docs_bp FROM s",
    "exported_sheet": f"WITH {_COUNTS} SELECT termo, length(termo) AS tamanho, qtd, qtd_docs FROM df WHERE length(termo) <= 50 OR contains(termo, '_')",
    "linked_texts": f"WITH {_CLEAN} SELECT doc_id, t AS texto FROM limpo",
    "resolution_report": f"WITH {_TOKENS},\n{_VOCAB},\nditos AS (SELECT token FROM tok),\nvocab AS (FROM base),{_RESOLVED} SELECT tipo, token, count(*) AS qtd FROM tok JOIN resolvidos USING (token) GROUP BY 1, 2",
    "vocabulary_tokens": f"WITH {_CLEAN},\n{_VOCAB},{_FINAL},\nvocab AS (SELECT term FROM final),\nfora AS (SELECT term FROM removido UNION SELECT term FROM formas WHERE s <> term AND s IN (FROM removido) AND NOT contains(term, '_') AND term NOT IN (VALUES {_DIGITS})),\nw AS (SELECT doc_id, list_filter(string_split({_rules_sql('t')}, ' '), lambda w: w <> '') AS w FROM limpo),\nditos AS (SELECT * FROM (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM w) WHERE token NOT IN (FROM fora)),{_RESOLVED},\npecas AS (SELECT doc_id, i, CASE tipo WHEN 'singular' THEN s WHEN 'termo' THEN token WHEN 'fragmento' THEN CASE WHEN length(radical) > 1 THEN radical || ' ' ELSE '' END || resto END AS p FROM ditos JOIN resolvidos USING (token)),\nlinhas AS (SELECT doc_id, string_agg(p, ' ' ORDER BY i) FILTER (length(p) > 1) AS t FROM pecas GROUP BY 1) SELECT doc_id, coalesce(linhas.t, '.') AS tokens FROM limpo LEFT JOIN linhas USING (doc_id)",
    "final_vocabulary": f"WITH {_VOCAB},{_FINAL} SELECT term FROM final",
    "fragmented_terms": f"WITH t AS (SELECT termo FROM curadoria_planilha_vocab WHERE termo IS NOT NULL AND termo <> ''),{sqltext.stems('t', 'termo')},\n{sqltext.fragments()} SELECT token AS termo, prefixo, sufixo FROM partes",
    "sheet_rules": "SELECT DISTINCT trim(regexp_replace(lower(termo), '[^a-z0-9]+', ' ', 'g')) || ' sete' AS src, trim(regexp_replace(lower(termo), '[^a-z0-9]+', '_', 'g'), '_') || '_no_um' AS dst FROM curadoria_planilha_vocab WHERE termo IS NOT NULL",
    "many_rules_texts": f"WITH {_CLEAN} SELECT doc_id, {_rules_sql('t', MANY_RULES)} AS texto FROM limpo",
    "word_rules": f"WITH {_CLEAN},\nu AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(t), '\\bRECURSO\\b', chr(1), 'g'), '\\bPROCESSO\\b', 'recurso', 'g'), '\\bDANO MORAL\\b', 'dano_moral', 'g'), '\\bDANO\\b', 'prejuízo', 'g') AS t FROM limpo) SELECT doc_id, replace(t, chr(1), 'processo') AS texto FROM u",
    "text_vocabulary": f"WITH {_TOKENS},\nditos AS (SELECT DISTINCT unnest({sqltext.tokens_of('t')}) AS token FROM limpo),{sqltext.stems('ditos', 'token')},\n{sqltext.fragments()} SELECT DISTINCT CASE WHEN prefixo = '' THEN token ELSE trim(prefixo || ' ' || sufixo) END AS termo FROM partes",
    "listed_suggestions": f"{_BIGRAMS},\nt AS (SELECT w1 || '_' || w2 AS para FROM achados UNION SELECT * FROM (VALUES ('a_casa_de'), ('minha_lista'), ('recurso_especial'))),\nd AS (SELECT replace(para, '_', ' ') AS de, para FROM t WHERE para NOT IN ('dano_moral', 'parte_autora')) SELECT de, para, NOT (regexp_extract(de, '^[^ ]+') IN ({_EDGES}) OR regexp_extract(de, '[^ ]+$') IN ({_EDGES})) AS aceito FROM d",
    "longer_phrases": f"{_LONGER} SELECT w1, w2, pares2.n, (pares2.n - 10) * v2.v / (a.n * b.n) AS score FROM pares2 JOIN palavras2 a ON a.token = w1 JOIN palavras2 b ON b.token = w2, v2 WHERE pares2.n >= 10 AND (pares2.n - 10) * v2.v / (a.n * b.n) > 10",
    "phrased_texts": f"{_BIGRAMS}, {_MERGED} SELECT doc_id, (linha - 1)::INT AS linha, t AS tokens FROM unidos",
    "phrase_report": f"{_BIGRAMS}, {_MERGED} SELECT doc_id, (linha - 1)::INT AS linha, substr(array_to_string(list_transform(string_split(t, ' '), lambda w: CASE WHEN contains(w, '_') THEN upper(w) ELSE w END), ' '), 1, 200) AS texto FROM unidos ORDER BY 1, 2 LIMIT 1000",
    "passages": f"WITH {_PASSAGES} SELECT doc_id, sent_no, sentenca FROM passagens",
    "long_passages": f"WITH {_LONG} SELECT doc_id, sent_no, sentenca FROM passagens",
    "passages_once": f"WITH {_PASSAGES},\nu AS (SELECT sentenca, min({{'d': doc_id, 's': sent_no}}) AS p, count(*) AS vezes FROM passagens GROUP BY 1) SELECT row_number() OVER (ORDER BY p) AS sent_id, p.d AS doc_id, p.s AS sent_no, sentenca, vezes FROM u",
    "passage_counts": f"WITH {_PASSAGES} SELECT count(DISTINCT sentenca) AS novas, count(*) - count(DISTINCT sentenca) AS repetidas FROM passagens",
    "new_lines": "WITH l AS (SELECT doc_id, lang, i - 1 AS sent_no, parts[i] AS sentenca FROM (SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))), k AS (SELECT * FROM l WHERE trim(sentenca, ' ') <> '') SELECT (min({'d': doc_id, 's': sent_no})).d AS doc_id, (min({'d': doc_id, 's': sent_no})).s::INT AS sent_no, sentenca, count(*) AS vezes FROM k WHERE sentenca NOT IN (SELECT sentenca FROM k WHERE lang = 'pt') GROUP BY sentenca",
    "path_parts": "WITH p AS (SELECT path FROM cache_plan UNION SELECT path FROM util_doc2vec_facil) SELECT path, regexp_replace(path, '[/\\\\][^/\\\\]*$', '') AS pasta, regexp_replace(regexp_extract(path, '[^/\\\\]*$'), '\\.[^.]*$', '') AS nome FROM p",
    "cached_tokens": f"WITH {_CLEAN} SELECT doc_id, array_to_string({sqltext.tokens_of('t')}, ' ') AS tokens FROM limpo",
    "comparison_list": "WITH d AS (SELECT DISTINCT CASE WHEN prefixo <> '' THEN prefixo || ' = ' || termo ELSE replace(termo, '_', ' ') END AS l FROM curadoria_planilha_vocab WHERE termo IS NOT NULL) SELECT trim(l) AS linha, 0 AS ordem FROM d WHERE contains(l, '=') UNION ALL SELECT * FROM (SELECT unnest(list_filter(string_split(regexp_replace(lower(l), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: w <> '')) AS linha, 1 FROM d WHERE NOT contains(l, '='))",
    "padded_terms": "SELECT DISTINCT CASE WHEN length(termo) < 10 THEN rpad(termo, 10, ' ') ELSE termo END || ' | ' || CASE WHEN length(vocab) < 12 THEN rpad(vocab, 12, ' ') ELSE vocab END AS linha FROM curadoria_planilha_vocab WHERE termo IS NOT NULL AND vocab IS NOT NULL",
    "identical_texts": f"WITH {sqltext.quick_steps('util_agrupamento_facil', 'texto', 'arquivo_id')},\nk AS (SELECT grupo, min(arquivo_id) AS c FROM util_agrupamento_facil WHERE centroide = 1 AND grupo > 0 AND texto IS NOT NULL GROUP BY 1) SELECT u.arquivo_id AS id, u.grupo, CASE WHEN u.grupo < 0 THEN '' WHEN {sqltext.tokens_of('a.t')} = {sqltext.tokens_of('b.t')} THEN 'Sim' ELSE 'Não' END AS identico FROM util_agrupamento_facil u LEFT JOIN k USING (grupo) LEFT JOIN limpo a ON a.arquivo_id = u.arquivo_id LEFT JOIN limpo b ON b.arquivo_id = k.c",
    "similar_embeddings": f"WITH {_DIRECTED} SELECT id_1 AS a, id_2 AS b, round(sim, 6) AS sim FROM e WHERE id_1 < id_2 AND sim > {SIMILAR}",
    "top_embeddings": f"WITH {_DIRECTED} SELECT id_1, id_2, ordem FROM (SELECT *, row_number() OVER (PARTITION BY id_1 ORDER BY sim DESC, id_2)::INT AS ordem FROM e WHERE sim > {SIMILAR}) WHERE ordem <= 3",
    "search_embeddings": f"WITH {_DIRECTED} SELECT id_1 AS q, id_2 AS id, round(sim, 6) AS sim FROM e WHERE id_1 % 50 = 0 AND sim > {SIMILAR}",
    "label_review": f"WITH {_DIRECTED} SELECT id_1 AS a, id_2 AS b, r1 AS rotulo_a, r2 AS rotulo_b FROM e WHERE id_1 < id_2 AND sim > {SIMILAR} AND r1 <> r2",
    "label_suggestions": f"WITH {_DIRECTED}, v AS (SELECT id_1 AS id, r2 AS rotulo, count(*) AS votos, max(sim) AS sim FROM e WHERE sim > 0.25 AND r2 IS NOT NULL GROUP BY 1, 2) SELECT id, rotulo, votos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votos DESC, sim DESC, rotulo) AS r FROM v) WHERE r = 1",
    "density_ranking": f"WITH {_DIRECTED} SELECT id_1 AS id, count(*) AS ligacoes, round(sum(sim), 5) AS soma FROM e WHERE sim >= {SIMILAR} GROUP BY 1",
    "session_sizes": "SELECT sessao, grupo, tamanho, row_number() OVER (PARTITION BY sessao ORDER BY tamanho DESC, grupo)::INT AS novo FROM (SELECT sessao, grupo, count(DISTINCT seq_documento) AS tamanho FROM grupos WHERE grupo > 0 GROUP BY 1, 2)",
    "retained_groups": f"SELECT seq_documento, grupo, sessao FROM grupos WHERE dthr >= TIMESTAMPTZ '{AT}+00' - INTERVAL 480 HOURS",
}
