"""Named queries: every operator applied to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.operators import corpus, embeddings, graph, hierarchy, mentions, network, ordering, pairs, search
from corpusloom.operators.lexical_index import LexicalIndex
from corpusloom.operators.similarity import similar_pairs
from corpusloom.runtime import materialize, scratch_dir, spread
from corpusloom.schemas import ASSOCIATION, PROCESSED
from corpusloom.sources import readers, writers

# Frequent words of the tables, with names of two words among them.
LEXICON_CHARACTERS = ["of the", "inea", "onthan", "oreat", "ouan", "elle", "le la", "erver", "hein"]
LEXICON_PLACES = ["and the", "inin", "theor", "de la", "ouou", "schen", "thand"]
LANGUAGES = ["en", "fr", "de", "es"]
MAX_WORDS = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def _tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.clean_tokens(F.col("text")).alias("tokens"))


def _texts(spark, sf_dir):
    """Texts for the word pair operators, which clean and split them as ``_tokens`` does."""
    return _documents(spark, sf_dir).select("doc_id", F.col("text").alias("tokens"))


def _scratch(spark) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


# --- text ----------------------------------------------------------------------------


def clean_text(spark, d):
    return _documents(spark, d).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


def tokens_by_lang(spark, d):
    words = X.word_tokens(X.clean_text(F.col("text")))
    kept = X.drop_stop_words_by(words, F.col("lang"), LANGUAGES)
    return _documents(spark, d).select("doc_id", F.array_join(kept, " ").alias("tokens"))


def search_tokens(spark, d):
    return _documents(spark, d).select(
        "doc_id", F.array_join(X.search_tokens(F.col("text")), " ").alias("tokens")
    )


def term_frequency(spark, d):
    return corpus.term_frequency(_tokens(spark, d))


def term_frequency_top(spark, d):
    return term_frequency(spark, d).limit(10)


def split_sentences(spark, d):
    return corpus.split_sentences(_documents(spark, d).select("doc_id", "text"), "text")


def naive_sentences(spark, d):
    return corpus.split_sentences(_documents(spark, d).select("doc_id", "text"), "text", naive=True)


def processed_sentences(spark, d):
    sentences = corpus.process_sentences(split_sentences(spark, d))
    return sentences.select(
        "doc_id", "sentence_id", "cleaned_sentence", F.array_join("tokens", " ").alias("tokens")
    )


def sentence_counts(spark, d):
    rows = corpus.split_sentences(_documents(spark, d).select("source", "text"), "text")
    return corpus.count_by(rows, "source", "n_sentences")


def _books(spark, d):
    """Every document as a book: each paragraph becomes a chapter under a numbered heading."""
    paragraphs = F.transform(
        F.split("text", "\n"), lambda p, i: F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit(" "), p)
    )
    return _documents(spark, d).select("doc_id", F.array_join(paragraphs, "\n").alias("text"))


def split_chapters(spark, d):
    return corpus.split_chapters(_books(spark, d))


def split_chapters_long(spark, d):
    return corpus.split_chapters(_books(spark, d), heading=r"Chapter \d+")


# --- association ---------------------------------------------------------------------


def cooccurrence_doc(spark, d):
    return corpus.cooccurrence(_texts(spark, d), min_freq=corpus.DEFAULT_MIN_FREQ)


def cooccurrence_sentence(spark, d):
    rows = split_sentences(spark, d)
    return corpus.cooccurrence(rows, "sentence", min_freq=corpus.DEFAULT_MIN_FREQ)


def cooccurrence_corpus(spark, d):
    return corpus.cooccurrence_stream(_texts(spark, d), ["doc_id"], min_freq=corpus.DEFAULT_MIN_FREQ)


def _six(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


def pmi_doc(spark, d):
    return _six(corpus.pmi(_texts(spark, d)), "mi_score")


def pmi_corpus(spark, d):
    return _six(corpus.pmi(_texts(spark, d), order=["doc_id"]), "mi_score")


def pmi_top(spark, d):
    return pmi_corpus(spark, d).limit(10)


def association_measure(spark, d):
    """A measure of one's own: the share of the expected count."""
    ratio = lambda n_pair, n_1, n_2, total: n_pair * total / (n_1 * n_2)
    return _six(corpus.pmi(_texts(spark, d), measure=ratio), "mi_score")


def row_ids(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id")
    return ordering.with_row_ids(docs, ["source", "doc_id"])


# --- mentions ------------------------------------------------------------------------


def _tagged(spark, d):
    rows = split_sentences(spark, d)
    return mentions.tag_mentions(rows, "sentence", LEXICON_CHARACTERS, LEXICON_PLACES)


def mention_tags(spark, d):
    return mentions.joined_mentions(_tagged(spark, d)).select("doc_id", "sentence_id", "character", "place")


def mention_filter(spark, d):
    kept = mentions.joined_mentions(mentions.keep_mentioned(_tagged(spark, d)))
    return kept.select("doc_id", "sentence_id", "sentence", "character", "place")


def factorize_label(spark, d):
    docs = mentions.tag_mentions(
        _documents(spark, d).select("doc_id", "text"), "text", LEXICON_CHARACTERS, LEXICON_PLACES
    )
    joined = mentions.joined_mentions(docs)
    return mentions.label_first_character(joined, "doc_id").select("doc_id", "character", "character_label")


def hover_labels(spark, d):
    rows = mentions.joined_mentions(_tagged(spark, d))
    return graph.point_table(rows).select(
        "doc_id", "sentence_id", "character_label", "place_label", "hover_text"
    )


# --- network -------------------------------------------------------------------------


def _association(spark, d):
    return corpus.pmi_pairs(_texts(spark, d)).select("word1", "word2", "mi_score")


def vocabulary(spark, d):
    return network.vocabulary(_association(spark, d))


def word_strength(spark, d):
    return _six(network.word_strength(_association(spark, d)), "strength")


def prune_network(spark, d):
    pairs_ = materialize(_association(spark, d))
    return _six(network.prune_network(pairs_, MAX_WORDS), "mi_score")


def association_matrix(spark, d):
    return _six(network.association_matrix(_association(spark, d)), "mi")


def distance_pairs(spark, d):
    matrix = materialize(network.association_matrix(_association(spark, d)))
    return _six(network.to_distance(matrix), "distance")


def absent_distance(spark, d):
    matrix = materialize(network.association_matrix(_association(spark, d)))
    return _six(network.absent_distance(matrix), "absent")


# --- hierarchy -----------------------------------------------------------------------

def _merges(spark, d, method: str = "average") -> DataFrame:
    pairs_ = network.prune_network(materialize(_association(spark, d)), MAX_WORDS)
    matrix = materialize(network.association_matrix(pairs_))
    absent = network.absent_distance(matrix).first()["absent"]
    return materialize(
        hierarchy.average_linkage(network.to_distance(matrix), absent, network.matrix_words(matrix), method)
    )


def linkage_merges(spark, d):
    return _six(_merges(spark, d).select("step", "left", "right", "height", "size"), "height")


def linkage_single(spark, d):
    return _six(_merges(spark, d, "single").select("left", "right", "height", "size"), "height")


def linkage_complete(spark, d):
    return _six(_merges(spark, d, "complete").select("left", "right", "height", "size"), "height")


def clusters_by_distance(spark, d):
    return hierarchy.cut_by_distance(_merges(spark, d), 0.7)


def clusters_by_count(spark, d):
    return hierarchy.cut_by_count(_merges(spark, d), 20)


def clusters_by_threshold(spark, d):
    merges = _merges(spark, d)
    return hierarchy.cut_by_distance(merges, hierarchy.count_threshold(merges, 7))


def cluster_sizes(spark, d):
    return hierarchy.cluster_sizes(clusters_by_count(spark, d))


def cluster_count(spark, d):
    return hierarchy.cluster_count(clusters_by_distance(spark, d))


def cluster_sample(spark, d):
    return hierarchy.sample_clusters(clusters_by_count(spark, d), 50)


def tree_nodes(spark, d):
    return _six(hierarchy.tree_nodes(_merges(spark, d)), "height")


def truncated_tree(spark, d):
    return hierarchy.truncated_tree(_merges(spark, d), 50)


# --- exact and lexical retrieval -----------------------------------------------------


def _keyword_queries(spark, d):
    """Second to fourth word of every benchmark item."""
    return _table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.slice(F.split("text", r"\s+"), 2, 3).alias("keywords")
    )


def _text_queries(spark, d):
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _passages(spark, d):
    return _documents(spark, d).select("doc_id", "text")


def exact_match(spark, d):
    hits = search.exact_match(_keyword_queries(spark, d), _passages(spark, d))
    return hits.select("query_id", "doc_id", "match_type")


def keyword_positions(spark, d):
    hits = search.exact_match(_keyword_queries(spark, d), _passages(spark, d))
    return hits.select("query_id", "doc_id", F.explode("keyword_positions").alias("keyword", "position"))


def bm25_stats(spark, d):
    docs = _passages(spark, d).select(X.search_tokens(F.col("text")).alias("tokens"))
    return _six(search.bm25_idf(materialize(search.bm25_stats(docs))), "idf")


def first_documents(spark, d):
    return search.first_documents(_documents(spark, d), 100).select("doc_id", "source")


def bm25_indexed(spark, d):
    """The passages indexed in two batches, then searched through the stored blocks."""
    index = LexicalIndex(spark, _scratch(spark))
    for k in range(2):
        index.add(_passages(spark, d).where(F.col("doc_id") % 2 == k), f"part{k}")
    return index.search(_text_queries(spark, d), 5)[0].select("query_id", "doc_id", "score", "rank")


def bm25_topk(spark, d):
    return search.bm25_search(_text_queries(spark, d), _passages(spark, d), 5, keep_zero=True)


# --- vectors -------------------------------------------------------------------------


def _vectors(spark, d):
    return _table(spark, d, "embeddings")


def parse_embedding(spark, d):
    """Vectors written as JSON lists or as spaced lists and parsed back."""
    listed = V.to_text(F.col("embedding"))
    spaced = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), " "), F.lit("]"))
    text = F.when(F.col("label") % 2 == 0, listed).otherwise(spaced)
    parsed = _vectors(spark, d).select("vec_id", V.parse(text).alias("v"))
    return parsed.select(
        "vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x), 4).alias("total")
    )


def cosine_pairs(spark, d):
    return similar_pairs(_vectors(spark, d), 0.3, "vec_id", "embedding", "label")


def centrality(spark, d):
    scored = embeddings.mean_similarity(_vectors(spark, d), "label")
    return _six(scored.select("label", "vec_id", "avg_similarity"), "avg_similarity")


def central_extremes(spark, d):
    return embeddings.central_extremes(_vectors(spark, d), "label", "vec_id")


def semantic_topk(spark, d):
    """The centre of every label looks for its nearest vectors in the whole table."""
    centers = embeddings.group_centroids(_vectors(spark, d), "label").withColumnRenamed("label", "query_id")
    hits = search.semantic_search(centers, _vectors(spark, d), 5, 0.35, "vec_id")
    return hits.select("query_id", "vec_id", F.col("score").alias("similarity"), "rank")


def _encode(df, column):
    return embeddings.embed_text(df, column, embeddings.letter_profile, native=True)


def retrieve_priority(spark, d):
    hits = search.retrieve(_keyword_queries(spark, d), _passages(spark, d), _encode)
    return hits.select(
        "query_id",
        "doc_id",
        "match_type",
        "similarity",
        F.array_join("keywords_contained", "|").alias("keywords_contained"),
        F.map_keys("keyword_positions").getItem(0).alias("first_keyword"),
    )


def _encoded_queries(spark, d):
    return _encode(_text_queries(spark, d), "query")


def _encoded_passages(spark, d):
    return _encode(_passages(spark, d), "text")


def rerank_topk(spark, d):
    queries_, docs = _encoded_queries(spark, d), _encoded_passages(spark, d)
    hits = materialize(search.semantic_search(queries_, docs, 32, None))
    best = search.rerank(hits, queries_, docs, 3)
    named = search.attach_text(best, docs)
    return named.select("query_id", "doc_id", "score", "cross_score", "rank", X.shorten(F.col("passage")).alias("passage"))


def search_report(spark, d):
    return search.search_report(_encoded_queries(spark, d), _encoded_passages(spark, d))


# --- training pairs ------------------------------------------------------------------


def training_pairs(spark, d):
    return pairs.training_pairs(_passages(spark, d))


def pair_split(spark, d):
    return pairs.split_pairs(pairs.training_pairs(_passages(spark, d))).select("doc_id", "i", "kind", "label", "split")


def encoder_eval(spark, d):
    both = pairs.training_pairs(_passages(spark, d)).select("text_a", "text_b", "label")
    encoded = both.select(
        "label",
        embeddings.letter_profile(F.col("text_a")).alias("vec_a"),
        embeddings.letter_profile(F.col("text_b")).alias("vec_b"),
    )
    return _six(embeddings.evaluate_encoder(encoded), "pearson", "spearman")


# --- graphs and maps -----------------------------------------------------------------


def knn_graph(spark, d):
    return graph.knn_graph(_vectors(spark, d), 50, "vec_id")


def knn_graph_grouped(spark, d):
    return graph.knn_graph(_vectors(spark, d), 20, "vec_id", metric="euclidean", group="label")


def _fuzzy(spark, d):
    return graph.fuzzy_graph(materialize(graph.knn_graph(_vectors(spark, d), 20, "vec_id", metric="euclidean")), 20)


def fuzzy_graph(spark, d):
    return _six(_fuzzy(spark, d), "weight")


def _layout(spark, d, k=2):
    return graph.layout(_vectors(spark, d), k, "vec_id")


def layout_2d(spark, d):
    return _six(_layout(spark, d), "x", "y")


def layout_3d(spark, d):
    return _six(_layout(spark, d, 3), "x", "y", "z")


def layout_spectral(spark, d):
    edges = materialize(_fuzzy(spark, d))
    return _six(graph.spectral_layout(edges, 2), "x", "y")


def edge_table(spark, d):
    """Neighbour edges drawn at the first two entries of their vectors."""
    edges = graph.knn_graph(_vectors(spark, d), 50, "vec_id").select("src", "dst", (1 - F.col("distance")).alias("weight"))
    return _six(graph.edge_table(edges, _corner(spark, d), "vec_id"), "x0", "y0", "x1", "y1", "weight")


def _corner(spark, d):
    """Given coordinates: the first two entries of each vector."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return _vectors(spark, d).select("vec_id", at(0).alias("x"), at(1).alias("y"))


def _chapter_vectors(spark, d):
    vectors = _vectors(spark, d).select(F.col("label").alias("chapter"), "vec_id", "embedding")
    return ordering.index_in_group(vectors, "chapter", ["vec_id"])


def _chapter_texts(spark, d):
    turns = _table(spark, d, "conversations").select(
        F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), F.col("text").alias("sentence")
    )
    tagged = mentions.tag_mentions(turns, "sentence", LEXICON_CHARACTERS, LEXICON_PLACES)
    return mentions.joined_mentions(tagged)


def align_pad(spark, d):
    aligned = graph.align_pad(_chapter_vectors(spark, d).drop("embedding"), _chapter_texts(spark, d))
    return aligned.select("chapter", "idx", "vec_id", "sentence", "character", "place")


def length_mismatch(spark, d):
    return graph.length_mismatch(_chapter_vectors(spark, d), _chapter_texts(spark, d))


def point_table(spark, d):
    """Every vector at its given coordinates, with its sentence and labels."""
    vectors = _chapter_vectors(spark, d).drop("embedding").join(_corner(spark, d), "vec_id")
    points = graph.point_table(graph.align_pad(vectors, _chapter_texts(spark, d)))
    return _six(points, "x", "y").select(
        "chapter", "idx", "vec_id", "x", "y", "sentence", "character", "place", "character_label", "place_label", "hover_text"
    )


def pca_project(spark, d):
    projected = embeddings.pca_project(_vectors(spark, d), 8, group="label")
    return projected.select(
        "vec_id", "label", *[F.round(F.get("coords", F.lit(i)), 6).alias(f"pc{i + 1}") for i in range(8)]
    )


def embed_text(spark, d):
    """Word vectors trained on the documents; a document is the mean of its words.

    Training depends on how the rows are split over tasks, so only stable facts are returned.
    """
    tokens = materialize(_tokens(spark, d))
    model = embeddings.fit_word2vec(tokens, size=32)
    encoded = embeddings.embed_with_model(tokens, model)
    length = V.norm(V.doubles(F.col("embedding")))
    return encoded.select(
        "doc_id",
        F.size("embedding").alias("dim"),
        (length > 0).alias("has_words"),
        F.forall("embedding", lambda x: ~F.isnan(x)).alias("finite"),
    )


def embed_text_tfidf(spark, d):
    tokens = materialize(_tokens(spark, d))
    encoded = embeddings.embed_with_model(tokens, embeddings.fit_tfidf(tokens, size=512))
    return encoded.select("doc_id", F.size("embedding").alias("dim"), F.round(V.norm(V.doubles(F.col("embedding"))), 4).alias("length"))


def embed_profile(spark, d):
    encoded = _encoded_passages(spark, d)
    return encoded.select(
        "doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("profile")
    )


def embed_profile_batch(spark, d):
    """The letter counts again, from an encoder that runs on Arrow batches."""

    def encoder(batches):
        for texts in batches:
            lowered = texts.str.lower()
            yield lowered.map(lambda t: [float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"])

    encoded = embeddings.embed_text(_passages(spark, d), "text", encoder)
    return encoded.select(
        "doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("profile")
    )


# --- round trips ---------------------------------------------------------------------


def io_chapter_csv(spark, d):
    """Processed sentences written as one CSV folder per chapter and read back."""
    path = _scratch(spark)
    rows = corpus.process_sentences(split_sentences(spark, d))
    chapter = rows.withColumn("chapter_no", (F.col("doc_id") % 20).cast("int"))
    writers.write_chapter_csv(chapter.select("chapter_no", *PROCESSED.names), path)
    back = readers.read_chapter_folder(spark, path, PROCESSED)
    words = F.size(F.filter(F.split(X.as_text(F.col("tokens")), " "), lambda t: t != ""))
    return back.groupBy("chapter_no").agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum(F.length("sentence")).alias("n_chars"),
        F.sum(words).alias("n_tokens"),
    )


def io_association_csv(spark, d):
    path = _scratch(spark)
    table = corpus.pmi(_texts(spark, d)).select(*[F.col(c.lower()).alias(c) for c in ASSOCIATION.names])
    writers.write_csv(table, path)
    return _six(readers.read_association(spark, path), "mi_score")


def io_jsonl_gz(spark, d):
    path = _scratch(spark)
    writers.write_paragraphs(_documents(spark, d).select(F.split("text", "\n").alias("paragraphs")), path)
    return readers.read_paragraphs(spark, path)


def io_books(spark, d):
    """Text files, one folder per source, read back as whole files."""
    path = _scratch(spark)
    _documents(spark, d).select("source", "text").write.partitionBy("source").text(path)
    books = readers.read_books(spark, path)
    source = F.regexp_extract("path", "source=([^/]+)", 1)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    return books.groupBy(source.alias("source")).agg(F.sum(words).alias("n_words"))


def io_embeddings(spark, d):
    path = _scratch(spark)
    writers.write_embeddings(_vectors(spark, d).withColumnRenamed("label", "chapter_no"), path)
    back = readers.read_embeddings(spark, path)
    return back.groupBy("chapter_no").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.round(F.sum(F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda t, x: t + x)), 4).alias("total"),
    )


def io_similarity(spark, d):
    path = _scratch(spark)
    writers.write_similarity(cosine_pairs(spark, d), central_extremes(spark, d), path)
    return spark.read.schema(
        "label int, most_similar_id long, most_similar_score double, least_similar_id long, least_similar_score double"
    ).json(f"{path}/summary")


def io_similarity_pairs(spark, d):
    """The pair table as written and read back."""
    path = _scratch(spark)
    writers.write_similarity(cosine_pairs(spark, d), central_extremes(spark, d), path, centrality(spark, d))
    return readers.read_similarity(spark, path, "pairs")


def io_similarity_averages(spark, d):
    """Average similarity of every row, as written and read back."""
    path = _scratch(spark)
    writers.write_similarity(cosine_pairs(spark, d), central_extremes(spark, d), path, centrality(spark, d))
    return readers.read_similarity(spark, path, "averages")


def bad_vectors(spark, d):
    """Cells of an embedding column that do not parse; every seventh is spoilt."""
    text = F.when(F.col("vec_id") % 7 == 0, "no vector").otherwise(V.to_text(F.col("embedding")))
    cells = _vectors(spark, d).select(text.alias("cell")).withColumn("v", V.parse(F.col("cell")))
    return readers.bad_vectors(cells, "cell", "v")


def training_sample(spark, d):
    """The first pairs only, as a trial run asks for."""
    return pairs.training_pairs(_passages(spark, d), max_samples=500)


def io_corpus(spark, d):
    rows = readers.read_corpus(spark, f"{d}/documents.parquet")
    return rows.select("doc_id", F.length("text").alias("n"))


QUERIES = [
    clean_text, tokens_by_lang, search_tokens, term_frequency, term_frequency_top, split_sentences,
    naive_sentences, processed_sentences, sentence_counts, split_chapters, split_chapters_long,
    cooccurrence_doc, cooccurrence_sentence, cooccurrence_corpus, pmi_doc, pmi_corpus, pmi_top,
    association_measure, row_ids, mention_tags, mention_filter, factorize_label, hover_labels,
    vocabulary, word_strength, prune_network, association_matrix, distance_pairs, absent_distance,
    linkage_merges, linkage_single, linkage_complete, clusters_by_distance, clusters_by_count, clusters_by_threshold, cluster_sizes,
    cluster_count, cluster_sample, tree_nodes, truncated_tree, exact_match, keyword_positions,
    bm25_stats, first_documents, bm25_topk, bm25_indexed, parse_embedding, cosine_pairs, centrality, central_extremes, semantic_topk,
    retrieve_priority, rerank_topk, search_report, training_pairs, pair_split, encoder_eval,
    knn_graph, knn_graph_grouped, fuzzy_graph, layout_2d, layout_3d, layout_spectral, edge_table,
    align_pad, length_mismatch, point_table, pca_project, embed_text, embed_text_tfidf, embed_profile,
    io_chapter_csv, io_association_csv, io_jsonl_gz, io_books, io_embeddings, io_similarity, io_corpus,
    io_similarity_pairs, io_similarity_averages, bad_vectors, training_sample, embed_profile_batch,
]
