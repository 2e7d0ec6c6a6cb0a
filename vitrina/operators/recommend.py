"""Similar-product recommenders over relational TF-IDF, and their offline evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.functions.text import drop_stop_words, normalise_key, word_tokens
from vitrina.functions.vectors import closeness, euclidean_distance, vector_cosine
from vitrina.operators import decompose
from vitrina.operators.lookup import attach, attach_frequent
from vitrina.operators.stats import min_max_scale, top_k_by_score
from vitrina.session import cut_lineage, written

RATIOS = ("ratio_store", "ratio_partner", "ratio_other")

# Scores are rounded before ranking, so that the order of addition cannot decide a tie.
SCORE_DIGITS = 9

# Queries whose features travel together as one array; a larger set takes several.
QUERY_BLOCK = 4096


def content_tokens(text: Column, stop: Sequence[str] | None = None) -> Column:
    return drop_stop_words(word_tokens(text), stop)


def term_counts(docs: DataFrame, stop: Sequence[str] | None = None) -> DataFrame:
    """``(id, term, count)``; the text of an id may be spread over several rows."""
    tokens = docs.select("id", F.explode(content_tokens(F.col("text"), stop)).alias("term"))
    return tokens.groupBy("id", "term").agg(F.count(F.lit(1)).alias("count"))


def tfidf(docs: DataFrame, stop: Sequence[str] | None = None) -> DataFrame:
    """``(id, term, weight)`` with smooth idf ``ln((1+n)/(1+df)) + 1`` and unit length per document."""
    # The rows of an id meet as texts, so its words are counted where they are; the counts are for the idf and for the weights.
    counts = written(term_counts(docs.select("id", "text").repartition("id"), stop))
    total = docs.agg(F.count_distinct("id")).scalar()
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = frequency.select("term", "_df", (F.log((total + 1.0) / (F.col("_df") + 1.0)) + 1.0).alias("_idf"))
    raw = attach_frequent(counts, idf, "term", "_df").select("id", "term", (F.col("count") * F.col("_idf")).alias("_w"))
    # A document's terms are few, and the window leaves the rows partitioned by id for what follows.
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("_w") / length).alias("weight"))


def text_scores(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, id, score)``: cosine with each queried document, for documents that share a term."""
    asked = weights.join(queries.select(F.col("query").alias("id")), "id", "left_semi").select(
        F.col("id").alias("query"), "term", F.col("weight").alias("_q"))
    products = attach(weights, asked, ["term"], how="inner").filter(F.col("id") != F.col("query"))
    return products.groupBy("id", "query").agg(F.round(F.sum(F.col("weight") * F.col("_q")), SCORE_DIGITS).alias("score"))


def recommend_text(docs: DataFrame, queries: DataFrame, k: int = 5, stop: Sequence[str] | None = None, scores: DataFrame | None = None) -> DataFrame:
    """``(query, id, score, position)``: the k best by text, documents without a shared term filling up by id.

    ``scores`` are the ``text_scores`` of these documents and queries, if they are at hand.
    """
    scores = text_scores(tfidf(docs, stop), queries) if scores is None else scores
    scored = cut_lineage(top_k_by_score(scores, "query", "score", ["id"], k).drop("position"))
    # At most k scored documents and the query itself can stand among the first 2k + 1 ids.
    first = docs.select("id").distinct().orderBy("id").limit(2 * k + 1).agg(F.collect_list("id").alias("_first")).scalar()
    filler = queries.select("query", F.explode(first).alias("id")).filter("id <> query")
    filler = filler.join(scored.select("query", "id"), ["query", "id"], "left_anti").select("query", "id", F.lit(0.0).alias("score"))
    return top_k_by_score(scored.select("query", "id", "score").unionByName(filler), "query", "score", ["id"], k)


def _query_blocks(products: DataFrame, queries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features of the queried products in arrays ``_asked`` of about ``QUERY_BLOCK`` structs, with the number ``_block`` of each."""
    asked = cut_lineage(products.join(queries.select(F.col("query").alias("id")), "id", "left_semi"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    return asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(F.col("id").alias("query"), *columns)).alias("_asked"))


def recommend_hybrid(
    products: DataFrame, queries: DataFrame, k: int = 5, weights: Sequence[float] = (0.4, 0.3, 0.3), stop: Sequence[str] | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """The k best by text cosine, sentiment closeness and cosine of price ratios.

    ``products`` has ``id, text, sentiment`` and the three ratios. Every product is scored against
    every query inside its own row; only each task's k best per query are shuffled. ``scores`` as in ``recommend_text``.
    """
    w_text, w_mood, w_price = weights
    scores = text_scores(tfidf(products.select("id", "text"), stop), queries) if scores is None else scores
    by_doc = scores.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("query", "score"))).alias("_text"))
    features = products.select("id", "sentiment", F.array(*RATIOS).alias("_ratios"))
    asked = cut_lineage(_query_blocks(features, queries, ["sentiment", "_ratios"]))
    numbers = F.sequence(F.lit(0), F.lit(asked.count() - 1)) if asked.count() else F.array().cast("array<int>")
    number = F.row_number().over(Window.orderBy("_block")) - 1  # one row for each block of queries
    rows = features.join(by_doc, "id", "left").withColumn("_block", F.explode(numbers))
    rows = rows.join(asked.withColumn("_block", number), "_block").withColumn("_asked", F.explode("_asked"))
    rows = rows.filter(F.col("_asked.query") != F.col("id"))
    text = F.coalesce(F.try_element_at("_text", F.col("_asked.query")), F.lit(0.0))
    mood = closeness(F.col("sentiment"), F.col("_asked.sentiment"))
    price = vector_cosine(F.col("_ratios"), F.col("_asked._ratios"))
    score = F.round(w_text * text + w_mood * mood + w_price * price, SCORE_DIGITS)
    scored = rows.select(F.col("_asked.query").alias("query"), "id", score.alias("score"))
    return top_k_by_score(scored, "query", "score", ["id"], k)


def truncated_svd(docs: DataFrame, components: int = 50, stop: Sequence[str] | None = None) -> DataFrame:
    """``(id, reduced)``: documents in the space of the leading singular vectors of their TF-IDF matrix, not centred.

    Weights as in ``tfidf``. Arrays are as long as the matrix has components, at most ``components``; documents without a term
    are at zero.
    """
    found = decompose.truncated_svd(tfidf(docs, stop), components)
    zeros = F.array_repeat(F.lit(0.0), len(found.values))
    rows = docs.select("id").distinct().join(found.rows, "id", "left")
    return cut_lineage(rows.select("id", F.coalesce("reduced", zeros).alias("reduced")))


def cluster_features(products: DataFrame, components: int = 50, clusters: int = 5, seed: int = 42, stop: Sequence[str] | None = None) -> DataFrame:
    """``(id, vector, cluster)``: reduced text and scaled price ratios, grouped by k-means."""
    scaled = min_max_scale(products.select("id", *RATIOS), RATIOS)
    reduced = truncated_svd(products.select("id", "text"), components, stop)
    joined = reduced.join(scaled, "id").select(
        "id", F.concat("reduced", F.array(*[F.coalesce(f"{r}_scaled", F.lit(0.0)) for r in RATIOS])).alias("vector"))
    joined = cut_lineage(joined.withColumn("features", array_to_vector("vector")))
    model = KMeans(k=clusters, seed=seed, predictionCol="cluster").fit(joined)
    return model.transform(joined).select("id", "vector", "cluster")


def recommend_cluster(features: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest products of the query's own cluster by Euclidean distance."""
    asked = features.join(queries.select(F.col("query").alias("id")), "id", "left_semi").select(
        "cluster", F.col("id").alias("query"), F.col("vector").alias("_q"))
    near = attach(features, asked, ["cluster"], how="inner").filter(F.col("id") != F.col("query"))
    distance = F.round(euclidean_distance(F.col("vector"), F.col("_q")), SCORE_DIGITS)
    return top_k_by_score(near.select("query", "id", (-distance).alias("score")), "query", "score", ["id"], k)


def find_query(products: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row id of each asked URL, and the URLs that do not occur."""
    wanted = urls.select("url").distinct()
    found = products.join(wanted, "url", "left_semi").groupBy("url").agg(F.min("id").alias("query"))
    return found, wanted.join(found, "url", "left_anti")


def sample_queries(products: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """At most n ids, chosen by hash so that every run and engine chooses the same."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).cast("binary"))
    return products.select(F.col("id").alias("query")).orderBy(key, "query").limit(n)


def relevant_set(products: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, id)``: other products with the same normalised name."""
    named = products.select("id", normalise_key(F.col("name")).alias("_key"))
    asked = named.join(queries.select(F.col("query").alias("id")), "id", "left_semi").select(F.col("id").alias("query"), "_key")
    return attach(named, asked, ["_key"], how="inner").filter("id <> query").select("query", "id")


def precision_recall_at_k(recommended: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """``(query, hits, precision, recall)`` for queries with recommendations.

    The relevant products are only counted, per name; they are never listed.
    """
    named = products.select("id", normalise_key(F.col("name")).alias("_key"))
    sizes = named.groupBy("_key").agg((F.count(F.lit(1)) - 1).alias("_relevant"))
    asked = recommended.select("query").distinct().join(named.withColumnRenamed("id", "query"), "query").join(sizes, "_key")
    pairs = recommended.select("query", "id").join(named.withColumnRenamed("_key", "_rec"), "id").join(asked, "query")
    return pairs.groupBy("query", "_relevant").agg(F.count_if(F.col("_rec") == F.col("_key")).alias("hits")).select(
        "query", "hits", (F.col("hits") / k).alias("precision"),
        F.coalesce(F.try_divide(F.col("hits"), F.col("_relevant")), F.lit(0.0)).alias("recall"))


def rating_error(recommended: DataFrame, products: DataFrame) -> DataFrame:
    """``(query, error)``: gap between the query's rating and the mean of its recommendations, NULL if any is missing."""
    ratings = products.select("id", "rating")
    means = recommended.join(ratings, "id").groupBy("query").agg(
        F.when(F.count("rating") == F.count(F.lit(1)), F.avg("rating")).alias("_mean"))
    own = means.join(ratings.withColumnRenamed("id", "query"), "query")
    return own.select("query", F.abs(F.col("rating") - F.col("_mean")).alias("error"))


def evaluate(recommended: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """One row: mean precision, recall and rating error."""
    recommended = cut_lineage(recommended)
    hits = precision_recall_at_k(recommended, products, k).agg(
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))
    error = rating_error(recommended, products).agg(F.coalesce(F.avg("error"), F.lit(0.0)).alias("mae")).scalar()
    return hits.withColumn("mae", error)


def compare_recommenders(products: DataFrame, k: int = 5, **methods: DataFrame) -> DataFrame:
    """``(method, precision, recall, mae)`` for each named table of recommendations."""
    rows = [evaluate(found, products, k).select(F.lit(name).alias("method"), "precision", "recall", "mae") for name, found in methods.items()]
    return reduce(DataFrame.union, rows)
