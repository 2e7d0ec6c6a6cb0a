"""Queries for features, clusters, recommenders, topics and review scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import text
from vitrina.functions.money import PRICES
from vitrina.operators import features, matching, recommend, reviews, stats, topics
from vitrina.plans.bindings import OFFERS_SQL, filled_offers, offers, table
from vitrina.plans.registry import query
from vitrina.plans.scalar_queries import NORMALISED_SQL, WORDS_SQL
from vitrina.session import cut_lineage, written

NUMERIC = [*PRICES, "rating"]


# --- products for the recommenders: a document with its part's prices and its label ------------------

def products(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    prices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.avg(1 - discount), 6).alias("ratio_store"), F.round(F.avg(1 - discount / 2), 6).alias("ratio_partner"),
        F.round(F.avg((1 - discount) * (1 + tax)), 6).alias("ratio_other"), F.round(F.avg("l_quantity") / 10, 6).alias("rating"))
    mood = labels.select(F.col("doc_id").alias("id"), (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment"))
    named = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("u/"), F.col("source"), F.lit("/"), F.col("lang")).alias("url"),
                        F.col("source").alias("name"), "text")
    return named.join(mood, "id", "left").join(prices, "id", "left").na.fill({"sentiment": 0.0})


_PRODUCTS_SQL = """
prices AS (SELECT l_partkey AS id, round(avg(1 - l_discount), 6) AS ratio_store, round(avg(1 - l_discount / 2), 6) AS ratio_partner,
  round(avg((1 - l_discount) * (1 + l_tax)), 6) AS ratio_other, round(avg(l_quantity) / 10, 6) AS rating FROM lineitem GROUP BY l_partkey),
products AS MATERIALIZED (SELECT d.doc_id AS id, 'u/' || source || '/' || lang AS url, source AS name, text,
  coalesce(CAST(quality - toxic AS DOUBLE), 0) AS sentiment, ratio_store, ratio_partner, ratio_other, rating
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN prices p ON d.doc_id = p.id)"""

_TOKENS_SQL = f"""
tokens AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
counts AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tokens WHERE term NOT IN {WORDS_SQL} GROUP BY ALL)"""

_TFIDF_SQL = _TOKENS_SQL + """,
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
raw AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w FROM counts JOIN dfs USING (term)),
tfidf AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""

_QUERIES_SQL = """
queries AS MATERIALIZED (SELECT doc_id AS query FROM documents ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100),
texted AS MATERIALIZED (SELECT q.id AS query, t.id, round(sum(q.weight * t.weight), 9) AS score FROM tfidf q JOIN queries ON q.id = queries.query
  JOIN tfidf t ON t.term = q.term AND t.id <> q.id GROUP BY ALL)"""

_BY_TEXT_SQL = """
dense AS (SELECT q.query, p.id, coalesce(score, 0) AS score FROM queries q JOIN products p ON p.id <> q.query LEFT JOIN texted s ON s.query = q.query AND s.id = p.id),
by_text AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS position FROM dense QUALIFY position <= 5)"""

_HYBRID_SQL = """
mixed AS (SELECT q.query, p.id, round(0.4 * coalesce(score, 0) + 0.3 * (1 / (1 + abs(p.sentiment - o.sentiment))) +
  0.3 * coalesce((p.ratio_store * o.ratio_store + p.ratio_partner * o.ratio_partner + p.ratio_other * o.ratio_other) /
    nullif(sqrt(p.ratio_store * p.ratio_store + p.ratio_partner * p.ratio_partner + p.ratio_other * p.ratio_other) *
    sqrt(o.ratio_store * o.ratio_store + o.ratio_partner * o.ratio_partner + o.ratio_other * o.ratio_other), 0), 0), 9) AS score
  FROM queries q JOIN products o ON o.id = q.query JOIN products p ON p.id <> q.query LEFT JOIN texted s ON s.query = q.query AND s.id = p.id),
by_mix AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS position FROM mixed QUALIFY position <= 5)"""

_ALL_SQL = f"WITH {_PRODUCTS_SQL},{_TFIDF_SQL},{_QUERIES_SQL},{_BY_TEXT_SQL}"
_RATED = lambda: F.round("score", 6).alias("score")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("tfidf", f"WITH {_TFIDF_SQL} SELECT id, term, round(weight, 6) AS weight FROM tfidf")
def _(spark, sf_dir):
    return recommend.tfidf(_docs(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("sample_queries", "SELECT doc_id AS query FROM documents ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def _(spark, sf_dir):
    return recommend.sample_queries(_docs(spark, sf_dir))


@query("recommend_text", _ALL_SQL + " SELECT query, id, round(score, 6) AS score, position FROM by_text")
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return recommend.recommend_text(docs, recommend.sample_queries(docs)).select("query", "id", _RATED(), "position")


@query("recommend_hybrid", _ALL_SQL + f",{_HYBRID_SQL} SELECT query, id, round(score, 6) AS score, position FROM by_mix")
def _(spark, sf_dir):
    rows = products(spark, sf_dir)
    return recommend.recommend_hybrid(rows, recommend.sample_queries(rows)).select("query", "id", _RATED(), "position")


@query("truncated_svd")
def _(spark, sf_dir):
    return recommend.truncated_svd(_docs(spark, sf_dir)).select("id", F.array_join(F.transform("reduced", lambda x: F.round(x, 6)), " ").alias("reduced"))


def _by_cluster(rows):
    return recommend.recommend_cluster(cut_lineage(recommend.cluster_features(rows)), recommend.sample_queries(rows))


@query("recommend_cluster")
def _(spark, sf_dir):
    return _by_cluster(products(spark, sf_dir))


@query("find_query", f"""WITH {_PRODUCTS_SQL},
asked AS (SELECT DISTINCT 'u/' || source || '/' || CASE WHEN n_chars % 2 = 0 THEN lang ELSE 'xx' END AS url FROM documents)
SELECT a.url, coalesce(min(p.id), -1) AS query FROM asked a LEFT JOIN products p ON p.url = a.url GROUP BY a.url""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lang = F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("xx")
    urls = docs.select(F.concat(F.lit("u/"), "source", F.lit("/"), lang).alias("url"))
    found, unknown = recommend.find_query(products(spark, sf_dir), urls)
    return found.unionByName(unknown, allowMissingColumns=True).na.fill({"query": -1})


@query("relevant_set", f"""WITH {_PRODUCTS_SQL}, queries AS (SELECT doc_id AS query FROM documents ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100)
SELECT q.id AS query, p.id FROM queries JOIN products q ON q.id = query JOIN products p ON lower(trim(p.name)) = lower(trim(q.name)) AND p.id <> q.id""")
def _(spark, sf_dir):
    rows = products(spark, sf_dir)
    return recommend.relevant_set(rows, recommend.sample_queries(rows))


_HITS_SQL = """
SELECT b.query, count(*) FILTER (p.name = q.name) AS hits, any_value(n) AS relevant FROM {0} b JOIN products q ON q.id = b.query JOIN products p ON p.id = b.id
JOIN (SELECT name, count(*) - 1 AS n FROM products GROUP BY name) s ON s.name = q.name GROUP BY b.query"""
_ERRORS_SQL = """
SELECT b.query, abs(any_value(q.rating) - CASE WHEN count(p.rating) = count(*) THEN avg(p.rating) END) AS error
FROM {0} b JOIN products q ON q.id = b.query JOIN products p ON p.id = b.id GROUP BY b.query"""


@query("precision_recall_at_k", _ALL_SQL + f"""
SELECT query, hits, round(hits / 5, 6) AS precision, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 6) AS recall FROM ({_HITS_SQL.format('by_text')})""")
def _(spark, sf_dir):
    rows = products(spark, sf_dir)
    found = recommend.recommend_text(rows.select("id", "text"), recommend.sample_queries(rows))
    return recommend.precision_recall_at_k(found, rows).select(
        "query", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("rating_error", _ALL_SQL + f" SELECT query, round(error, 5) AS error FROM ({_ERRORS_SQL.format('by_text')})")
def _(spark, sf_dir):
    rows = products(spark, sf_dir)
    found = recommend.recommend_text(rows.select("id", "text"), recommend.sample_queries(rows))
    return recommend.rating_error(found, rows).withColumn("error", F.round("error", 5))


def _metrics_sql(method: str, source: str) -> str:
    return f"""SELECT '{method}' AS method, round((SELECT avg(hits / 5) FROM ({_HITS_SQL.format(source)})), 6) AS precision,
  round((SELECT avg(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END) FROM ({_HITS_SQL.format(source)})), 6) AS recall,
  round((SELECT avg(error) FROM ({_ERRORS_SQL.format(source)})), 5) AS mae"""


def _rounded_metrics(df):
    return df.select("method", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("mae", 5).alias("mae"))


@query("compare_recommenders", _ALL_SQL + f",{_HYBRID_SQL} {_metrics_sql('text', 'by_text')} UNION ALL {_metrics_sql('hybrid', 'by_mix')}")
def _(spark, sf_dir):
    rows = cut_lineage(products(spark, sf_dir))
    asked, docs = cut_lineage(recommend.sample_queries(rows)), rows.select("id", "text")
    scores = cut_lineage(recommend.text_scores(recommend.tfidf(docs), asked))  # both methods start from them
    found = recommend.compare_recommenders(
        rows, text=recommend.recommend_text(docs, asked, scores=scores), hybrid=recommend.recommend_hybrid(rows, asked, scores=scores))
    return _rounded_metrics(found)


@query("evaluate_cluster_recommender")
def _(spark, sf_dir):
    rows = cut_lineage(products(spark, sf_dir))
    return _rounded_metrics(recommend.compare_recommenders(rows, cluster=_by_cluster(rows)))


# --- features and clusters ----------------------------------------------------------------------------

@query("sample_with_replacement")
def _(spark, sf_dir):
    rows = offers(spark, sf_dir).select("offer_id", *PRICES, "rating")
    return features.sample_with_replacement(rows, 300_000, ["offer_id"])


@query("assemble_features")
def _(spark, sf_dir):
    filled = stats.impute_column_mean(filled_offers(spark, sf_dir), ["rating"])
    return features.assemble_features(filled, NUMERIC).select("offer_id", F.col("features").cast("string").alias("features"))


@query("one_hot", "SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{t}' AS DOUBLE) AS \"p_type_{t}\"" for t in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def _(spark, sf_dir):
    found = features.one_hot(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type")
    return found.drop("p_type")


def _matrix(spark, sf_dir):
    return features.standard_features(filled_offers(spark, sf_dir), NUMERIC).select("offer_id", "features")


@query("pca_variance")
def _(spark, sf_dir):
    return features.pca_variance(_matrix(spark, sf_dir), len(NUMERIC))


@query("components_for")
def _(spark, sf_dir):
    variance = features.pca_variance(_matrix(spark, sf_dir), len(NUMERIC))
    return variance.filter(F.col("component") == features.components_for(variance))


@query("pca_project")
def _(spark, sf_dir):
    projected, _ = features.pca_project(_matrix(spark, sf_dir), 2)
    return projected.select("offer_id", F.col("projected").cast("string").alias("projected"))


def _vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    return table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))


@query("kmeans_best_of")
def _(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return features.kmeans_best_of(rows, 10).transform(rows).select("vec_id", "cluster")


@query("elbow_curve")
def _(spark, sf_dir):
    return features.elbow_curve(_vectors(spark, sf_dir))


@query("silhouette_curve")
def _(spark, sf_dir):
    return features.silhouette_curve(_vectors(spark, sf_dir))


@query("cluster_products")
def _(spark, sf_dir):
    rows = filled_offers(spark, sf_dir).withColumn("kind", F.when(F.col("brand") > "Brand#3", "equipment").otherwise("accessory"))
    return features.cluster_products(rows, ["list_price", "store_price", "partner_price", "rating"]).select("offer_id", "cluster")


# --- topics -------------------------------------------------------------------------------------------

@query("count_vectors", f"""WITH {_TOKENS_SQL}
SELECT id, term, tf AS count FROM counts WHERE term IN (SELECT term FROM counts GROUP BY term
  HAVING count(*) >= 0.1 * (SELECT count(*) FROM documents) AND count(*) <= 0.9 * (SELECT count(*) FROM documents))""")
def _(spark, sf_dir):
    return topics.count_vectors(_docs(spark, sf_dir))


def _reviews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("lang").alias("store"), F.col("source").alias("url"), "text",
                       text.clean_text(F.col("text")).alias("comment_clean"))


@query("topics_by_product")
def _(spark, sf_dir):
    found = topics.topics_by_product(cut_lineage(_reviews(spark, sf_dir)), "url", "comment_clean")
    return found.select("doc_id", "url", "topic", "topic_words")


@query("topic_words")
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    cells, vocabulary = topics.document_cells(docs)
    _, model = topics.lda_topics(docs, cells)
    return topics.topic_words(model, vocabulary)


@query("lda_topics")
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return topics.lda_topics(docs, topics.document_cells(docs)[0])[0]


# Topic of a product: the weekday-like number of its key; the join is what is checked.
@query("join_topics", """
SELECT doc_id, CAST(length(source) % 3 AS INTEGER) AS topic, 'topic ' || CAST(length(source) % 3 AS VARCHAR) AS topic_words FROM documents""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("url"))
    number = F.length("url") % 3
    found = rows.select("url").distinct().withColumns(
        {"topic": number.cast("int"), "topic_words": F.concat(F.lit("topic "), number.cast("string"))})
    return topics.join_topics(rows, found, "url").drop("url")


# --- review scoring -------------------------------------------------------------------------------------

# Word lists derived from the texts: words of 3 to 6 letters, valued by their length and first letter.
def _terms(spark, sf_dir, normalised=None):
    if normalised is None:
        normalised = table(spark, sf_dir, "documents").select(text.normalised_words(F.col("text")).alias("text"))
    return normalised.select(F.explode(F.split("text", " ")).alias("term")).distinct().filter(F.length("term").between(3, 6))


def _valences(spark, sf_dir, terms=None):
    return (_terms(spark, sf_dir) if terms is None else terms).withColumn("valence", ((F.ascii("term") + F.length("term")) % 9 - 4).cast("double"))


EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")


def _emotions(spark, sf_dir, normalised=None, terms=None):
    names = F.array(*[F.lit(e) for e in EMOTIONS])
    return (_terms(spark, sf_dir, normalised) if terms is None else terms).withColumn("emotion", F.get(names, F.ascii(F.expr("right(term, 1)")) % 8))


def _normalised(spark, sf_dir):
    return cut_lineage(table(spark, sf_dir, "documents").select("doc_id", text.normalised_words(F.col("text")).alias("text")))


_WORDS_SQL = f"""
words AS MATERIALIZED (SELECT doc_id, pos, w[pos] AS term FROM (SELECT doc_id, w, unnest(range(1, length(w) + 1)) AS pos
  FROM (SELECT doc_id, string_split({NORMALISED_SQL.format('text')}, ' ') AS w FROM documents)))"""


@query("lexicon_polarity", f"""WITH {_WORDS_SQL},
valued AS (SELECT doc_id, pos, CASE WHEN length(term) BETWEEN 3 AND 6 THEN (ascii(term) + length(term)) % 9 - 4 END AS v,
  CASE WHEN term IN ('not', 'no', 'ne') THEN 1 ELSE 0 END AS neg, CASE WHEN term = 'and' THEN 0.293 WHEN term = 'of' THEN -0.293 ELSE 0 END AS inc FROM words),
placed AS (SELECT doc_id, v, coalesce(lag(neg, 1) OVER w, 0) + coalesce(lag(neg, 2) OVER w, 0) + coalesce(lag(neg, 3) OVER w, 0) AS n,
  coalesce(lag(inc, 1) OVER w, 0) + 0.95 * coalesce(lag(inc, 2) OVER w, 0) + 0.9 * coalesce(lag(inc, 3) OVER w, 0) AS b FROM valued WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sums AS (SELECT doc_id, coalesce(sum((v + sign(v) * b::DOUBLE) * CASE WHEN n > 0 THEN -0.74::DOUBLE ELSE 1 END), 0) AS s FROM placed GROUP BY doc_id)
SELECT doc_id, round(s / sqrt(s * s + 15), 6) AS compound, CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'positivo' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'negativo' ELSE 'neutral' END AS polarity FROM sums""")
def _(spark, sf_dir):
    rows = _normalised(spark, sf_dir)
    terms = rows.select(F.explode(F.split("text", " ")).alias("term")).distinct()
    boosters = terms.filter(F.col("term").isin("and", "of")).withColumn("increment", F.when(F.col("term") == "and", 0.293).otherwise(-0.293))
    scored = reviews.lexicon_compound(rows, "doc_id", "text", _valences(spark, sf_dir), ("not", "no", "ne"), boosters)
    return scored.select("doc_id", F.round("compound", 6).alias("compound"), reviews.polarity_label(F.round("compound", 9)).alias("polarity"))


@query("lexicon_emotion", f"""WITH {_WORDS_SQL},
hits AS (SELECT doc_id, ({list(EMOTIONS)})[ascii(term[-1]) % 8 + 1] AS emotion, count(*) AS n FROM words WHERE length(term) BETWEEN 3 AND 6 GROUP BY ALL),
best AS (SELECT doc_id, emotion FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, emotion) = 1)
SELECT d.doc_id, coalesce(emotion, 'neutral') AS emotion_lexicon FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id""")
def _(spark, sf_dir):
    rows = _normalised(spark, sf_dir)
    return reviews.lexicon_emotion(rows, "doc_id", "text", _emotions(spark, sf_dir, rows))


def star_model():
    """Stand-in for a pre-trained model: one to five stars by the length of the text."""

    def stars(texts: list[str]) -> list[str]:
        counts = [1 + len(t) % 5 for t in texts]
        return [f"{n} star" if n == 1 else f"{n} stars" for n in counts]

    return stars


def emotion_model():
    labels = ("Alegría", "tristeza", "ira", "asco", "sorpresa", "miedo", "confusión", "joy")
    return lambda texts: [labels[len(t) % 8] for t in texts]


_STARS_SQL = "CAST(1 + length(text) % 5 AS VARCHAR) || CASE WHEN length(text) % 5 = 0 THEN ' star' ELSE ' stars' END"


@query("batch_score", f"""
SELECT conv_id, turn, CASE WHEN t = '' THEN NULL ELSE {_STARS_SQL.replace('text', 't')} END AS stars
FROM (SELECT conv_id, turn, array_to_string(list_slice(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), 1, 512), ' ') AS t FROM conversations)""")
def _(spark, sf_dir):
    return reviews.batch_score(table(spark, sf_dir, "conversations"), "text", star_model, "stars").select("conv_id", "turn", "stars")


@query("stars_to_polarity", f"""
SELECT doc_id, CASE WHEN s IN ('4 stars', '5 stars') THEN 'positivo' WHEN s IN ('1 star', '2 stars') THEN 'negativo' ELSE 'neutral' END AS polarity
FROM (SELECT doc_id, {_STARS_SQL} AS s FROM documents)""")
def _(spark, sf_dir):
    n = F.length("text") % 5 + 1
    label = F.concat(n.cast("string"), F.when(n == 1, " star").otherwise(" stars"))
    return table(spark, sf_dir, "documents").select("doc_id", reviews.stars_to_polarity(label).alias("polarity"))


@query("emotion_bucket", """
SELECT doc_id, CASE length(text) % 4 WHEN 0 THEN 'feliz' WHEN 1 THEN 'desilusionado' WHEN 2 THEN 'joy' ELSE 'triste' END AS emotion FROM documents""")
def _(spark, sf_dir):
    n = F.length("text") % 4
    label = F.when(n == 0, "Alegría").when(n == 1, "asco").when(n == 2, "Joy").otherwise("TRISTEZA")
    return table(spark, sf_dir, "documents").select("doc_id", reviews.emotion_bucket(label).alias("emotion"))


@query("score_unique_reviews", f"""
SELECT doc_id, {_STARS_SQL} AS stars FROM documents""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("url"), "text")

    def score(unique):
        n = F.length("text") % 5 + 1
        return unique.withColumn("stars", F.concat(n.cast("string"), F.when(n == 1, " star").otherwise(" stars")))

    return reviews.score_unique_reviews(rows, ["url", "text"], score).select("doc_id", "stars")


@query("train_text_polarity")
def _(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = reviews.train_text_polarity(labelled.filter(~held_out), "text", "label")
    scored = reviews.predict_polarity(model, labelled.filter(held_out), "text")
    return scored.select("doc_id", "label", "prediction")


@query("score_reviews")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("store"), F.col("source").alias("url"), "text")
    terms = written(_terms(spark, sf_dir))  # both lists are made from one pass over the texts
    found = reviews.score_reviews(
        rows, "doc_id", "url", "text", _valences(spark, sf_dir, terms), _emotions(spark, sf_dir, terms=terms), star_model, emotion_model)
    return found.drop("text", "comment_clean")
