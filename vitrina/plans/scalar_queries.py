"""Queries for the scalar functions: text, money, dates, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import dates, money, similarity, text, vectors
from vitrina.plans.bindings import FILLED_SQL, OFFERS_SQL, filled_offers, offers, table
from vitrina.operators.stats import min_over_name
from vitrina.plans.registry import query
from vitrina.session import written

WORDS_SQL = "(" + ", ".join("'" + w + "'" for w in text.stop_words()) + ")"

TRANSLITERATED_SQL = (
    "regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace({0}, 'ß', 'ss'), 'æ', 'ae'), "
    "'œ', 'oe'), 'ø', 'o'), 'Æ', 'AE'), 'Œ', 'OE'), 'Ø', 'O')), '[^\\x00-\\x7F]', '', 'g')"
)
NORMALISED_SQL = (
    "trim(regexp_replace(regexp_replace(" + TRANSLITERATED_SQL.format("lower({0})") + ", '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
)


def clean_sql(column: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({NORMALISED_SQL.format(column)}, ' '), "
        f"lambda w: w NOT IN {WORDS_SQL}), ' ')"
    )


def _digest(column):
    """Key, length and md5 of a long text result."""
    return [F.length(column).cast("long").alias("length"), F.md5(column.cast("binary")).alias("digest")]


def _digest_sql(expression: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, CAST(length(r) AS BIGINT) AS length, md5(r) AS digest FROM (SELECT {key}, {expression} AS r FROM {source})"


def _documents(spark, sf_dir, expression):
    return table(spark, sf_dir, "documents").select("doc_id", *_digest(expression))


@query("strip_accents", _digest_sql("strip_accents(text)"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.strip_accents(F.col("text")))


@query("to_ascii", _digest_sql("regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.to_ascii(F.col("text")))


@query("transliterate", _digest_sql(TRANSLITERATED_SQL.format("text")))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.transliterate(F.col("text")))


@query("clean_text", _digest_sql(clean_sql("text")))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.clean_text(F.col("text")))


@query("remove_stopwords", _digest_sql(
    f"array_to_string(list_filter(string_split(text, ' '), lambda w: w NOT IN {WORDS_SQL}), ' ')"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.remove_stopwords(F.col("text")))


# Lemma table derived from the texts: a word of more than three letters ending in s -> the word without it.
@query("lemmatise", f"""
WITH cleaned AS (SELECT doc_id, {NORMALISED_SQL.format('text')} AS t FROM documents)
SELECT doc_id, CAST(length(r) AS BIGINT) AS length, md5(r) AS digest FROM (
  SELECT doc_id, array_to_string(list_transform(string_split(t, ' '),
    lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END), ' ') AS r FROM cleaned)""")
def _(spark, sf_dir):
    docs = written(table(spark, sf_dir, "documents").select("doc_id", text.normalised_words(F.col("text")).alias("text")))
    return text.lemmatise(docs, "text", _lemmas(docs, "text"), "doc_id").select("doc_id", *_digest(F.col("text_lemmas")))


def _lemmas(docs, column):
    forms = docs.select(F.explode(F.split(column, " ")).alias("form")).distinct()
    return forms.filter((F.length("form") > 3) & F.col("form").endswith("s")).withColumn("lemma", F.expr("left(form, length(form) - 1)"))


@query("clean_text_lemmas", f"""
SELECT doc_id, CAST(length(r) AS BIGINT) AS length, md5(r) AS digest FROM (
  SELECT doc_id, array_to_string(list_transform(string_split(t, ' '),
    lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END), ' ') AS r
  FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents))""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lemmas = _lemmas(docs.select(text.clean_text(F.col("text")).alias("cleaned")), "cleaned")
    return text.clean_text_lemmas(docs, "text", lemmas, "doc_id").select("doc_id", *_digest(F.col("text_clean")))


@query("newline_to_space", _digest_sql("replace(text, chr(10), ' ')"))
def _(spark, sf_dir):
    return text.newline_to_space(table(spark, sf_dir, "documents")).select("doc_id", *_digest(F.col("text")))


@query("strip_review_marks", _digest_sql("regexp_replace(text, '[,;.\\n\\r]', '', 'g')"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.strip_review_marks(F.col("text")))


@query("trim_text", _digest_sql("regexp_replace(t, '^\\s+|\\s+$', '', 'g')",
                                "(SELECT doc_id, ' ' || chr(10) || text || chr(9) || ' ' AS t FROM documents)"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.trim_all(F.concat(F.lit(" \n"), "text", F.lit("\t "))))


@query("canonical_category", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'economy' WHEN 'SMALL' THEN 'small' ELSE p_type END AS category FROM part""")
def _(spark, sf_dir):
    aliases = {"ECONOMY": "economy", "SMALL": "small"}
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.canonical_category(F.col("p_type"), aliases).alias("category"))


@query("alias_store", """
SELECT s_suppkey, CASE s_name WHEN 'Supplier#000000000' THEN 'retail_1' WHEN 'Supplier#000000001' THEN 'retail_2' ELSE s_name END AS store
FROM supplier""")
def _(spark, sf_dir):
    aliases = {"Supplier#000000000": "retail_1", "Supplier#000000001": "retail_2"}
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias_store(F.col("s_name"), aliases).alias("store"))


@query("clean_brand", """
SELECT p_partkey, regexp_replace(regexp_replace(trim(lower(replace(b, 'por ', ''))), '^por\\s+', ''), '\\s+', ' ', 'g') AS brand
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'por ' ELSE ' Vapor  ' END || p_brand || '  X' AS b FROM part)""")
def _(spark, sf_dir):
    lead = F.when(F.col("p_size") % 2 == 0, "por ").otherwise(" Vapor  ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.clean_brand(F.concat(lead, "p_brand", F.lit("  X"))).alias("brand"))


@query("concat_features", f"""WITH {OFFERS_SQL}
SELECT offer_id, concat_ws(' ', name, brand, CASE WHEN rating IS NULL THEN NULL ELSE category END) AS features FROM offers""")
def _(spark, sf_dir):
    seen = F.when(F.col("rating").isNotNull(), F.col("category"))
    return offers(spark, sf_dir).select("offer_id", text.concat_features("name", "brand", seen).alias("features"))


@query("match_text", f"""WITH {OFFERS_SQL}
SELECT offer_id, category || ' ' || name || CASE WHEN rating IS NULL THEN NULL ELSE 'equipment' END || brand AS match_text FROM offers""")
def _(spark, sf_dir):
    kind = F.when(F.col("rating").isNotNull(), F.lit("equipment"))
    return offers(spark, sf_dir).select(
        "offer_id", text.match_text(F.col("category"), F.col("name"), kind, F.col("brand")).alias("match_text"))


@query("spec_pair_text", "SELECT event_id, event_type || ': ' || json_extract_string(props, '$.k') AS spec FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.spec_pair_text(F.col("event_type"), F.get_json_object("props", "$.k")).alias("spec"))


@query("map_labels", """
SELECT event_id, CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 END AS DOUBLE) AS polarity FROM events""")
def _(spark, sf_dir):
    numbers = {"error": -1, "view": 0, "purchase": 1}
    return table(spark, sf_dir, "events").select("event_id", text.map_labels(F.col("event_type"), numbers).cast("double").alias("polarity"))


@query("truncate_tokens", _digest_sql(
    "array_to_string(list_slice(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), 1, 512), ' ')"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, text.truncate_tokens(F.col("text")))


@query("normalise_key", "SELECT p_partkey, lower(trim('  ' || p_name || ' ' || p_brand || '  ')) AS name_key FROM part")
def _(spark, sf_dir):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "), "p_brand", F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_key(padded).alias("name_key"))


# Money text: five writings of the same price, chosen by line number.
_WRITTEN_SQL = """
written AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_linenumber % 5
      WHEN 0 THEN '$ ' || CAST(whole // 1000 AS VARCHAR) || '.' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0')
      WHEN 1 THEN CAST(whole AS VARCHAR) || ',' || lpad(CAST(cents AS VARCHAR), 2, '0')
      WHEN 2 THEN '-' || CAST(whole AS VARCHAR)
      WHEN 3 THEN CAST(whole AS VARCHAR) || ',1,' || CAST(cents AS VARCHAR)
      ELSE 'COP ' || CAST(whole AS VARCHAR) || ',5 (oferta)' END AS written
  FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS whole, CAST(l_quantity AS BIGINT) AS cents FROM lineitem))"""


def _written(spark, sf_dir):
    whole = F.floor("l_extendedprice")
    cents = F.col("l_quantity").cast("long")
    digits, fraction = whole.cast("string"), cents.cast("string")
    case = F.col("l_linenumber") % 5
    written = (
        F.when(case == 0, F.concat(F.lit("$ "), F.floor(whole / 1000).cast("string"), F.lit("."),
                                   F.lpad((whole % 1000).cast("string"), 3, "0")))
        .when(case == 1, F.concat(digits, F.lit(","), F.lpad(fraction, 2, "0")))
        .when(case == 2, F.concat(F.lit("-"), digits))
        .when(case == 3, F.concat(digits, F.lit(",1,"), fraction))
        .otherwise(F.concat(F.lit("COP "), digits, F.lit(",5 (oferta)")))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", written.alias("written"))


_NUMBER_SQL = "CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({0} AS DOUBLE) END"


@query("parse_price", f"""WITH {_WRITTEN_SQL},
paths AS (SELECT *, trim(replace(replace(written, '.', ''), ',', '.')) AS a,
  replace(replace(regexp_replace(written, '[^0-9.,]', '', 'g'), '.', ''), ',', '.') AS b FROM written)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, written,
  coalesce({_NUMBER_SQL.format('a')}, {_NUMBER_SQL.format('b')}) AS price FROM paths""")
def _(spark, sf_dir):
    return _written(spark, sf_dir).withColumn("price", money.parse_price(F.col("written")))


@query("parse_rating", f"""WITH {_WRITTEN_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  try_cast(nullif(regexp_extract(written, '([0-9]+\\.[0-9]+|[0-9]+)', 1), '') AS DOUBLE) AS rating FROM written""")
def _(spark, sf_dir):
    return _written(spark, sf_dir).withColumn("rating", money.parse_rating(F.col("written"))).drop("written")


@query("digits_only_number", f"""WITH {_WRITTEN_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  try_cast(regexp_replace(written, '[^0-9]', '', 'g') AS DOUBLE) AS number FROM written""")
def _(spark, sf_dir):
    return _written(spark, sf_dir).withColumn("number", money.digits_only_number(F.col("written"))).drop("written")


@query("parse_date", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS captured_on FROM lineitem""")
def _(spark, sf_dir):
    case = F.col("l_linenumber") % 4
    written = (
        F.when(case == 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(case == 1, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .when(case == 2, F.date_format("l_shipdate", "yyyyMMdd"))
        .otherwise(F.concat(F.lit("el "), F.date_format("l_shipdate", "dd-MM-yyyy")))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format(dates.parse_date(written), "yyyy-MM-dd").alias("captured_on"))


@query("date_parts", f"""WITH {OFFERS_SQL}
SELECT offer_id, CAST(year(captured_on) AS INTEGER) AS year, CAST(month(captured_on) AS INTEGER) AS month,
  CAST(day(captured_on) AS INTEGER) AS day FROM offers""")
def _(spark, sf_dir):
    return dates.date_parts(offers(spark, sf_dir)).select("offer_id", "year", "month", "day")


@query("weekday", f"""WITH {OFFERS_SQL}
SELECT offer_id, dayname(captured_on) AS weekday, CAST(isodow(captured_on) - 1 AS INTEGER) AS weekday_order FROM offers""")
def _(spark, sf_dir):
    day = F.col("captured_on")
    return offers(spark, sf_dir).select(
        "offer_id", dates.weekday(day).alias("weekday"), dates.weekday_order(day).alias("weekday_order"))


# Prices are raised by powers of ten, so that every size class occurs.
@query("rescale_tiers", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN v > 1e13 THEN v / 1e8 WHEN v > 1e12 THEN v / 1e7
  WHEN v > 1e10 THEN v / 1e4 WHEN v > 1e9 THEN v / 1e3 WHEN v > 1e8 THEN v / 100 WHEN v > 3e7 THEN v / 10 ELSE v END, 3) AS price
FROM (SELECT *, l_extendedprice * CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 1e3 WHEN 3 THEN 1e4 WHEN 4 THEN 1e5
  WHEN 5 THEN 1e7 WHEN 6 THEN 1e8 ELSE 1e9 END AS v FROM lineitem)""")
def _(spark, sf_dir):
    line = F.col("l_linenumber")
    factor = (F.when(line == 1, 1.0).when(line == 2, 1e3).when(line == 3, 1e4).when(line == 4, 1e5)
              .when(line == 5, 1e7).when(line == 6, 1e8).otherwise(1e9))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(money.rescale_tiers(F.col("l_extendedprice") * factor), 3).alias("price"))


_PRICE_LIST = ", ".join(f"round({c}, 6) AS {c}" for c in money.PRICES)


def _rounded_prices():
    return [F.round(c, 6).alias(c) for c in money.PRICES]


@query("row_max_fill", f"WITH {FILLED_SQL} SELECT offer_id, {_PRICE_LIST} FROM filled")
def _(spark, sf_dir):
    return filled_offers(spark, sf_dir).select("offer_id", *_rounded_prices())


# Only the two gap-ridden columns take part, so that rows without any price occur.
@query("row_max_fill_zero", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(coalesce(partner_price, other_price, 0), 6) AS partner_price,
  round(coalesce(other_price, partner_price, 0), 6) AS other_price FROM offers""")
def _(spark, sf_dir):
    pair = ("partner_price", "other_price")
    return money.row_max_fill(offers(spark, sf_dir), pair, all_null=0.0).select(
        "offer_id", *[F.round(c, 6).alias(c) for c in pair])


@query("fill_from_list_price", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(store_price, 6) AS store_price, round(coalesce(partner_price, list_price), 6) AS partner_price,
  round(coalesce(other_price, list_price), 6) AS other_price FROM offers""")
def _(spark, sf_dir):
    filled = money.fill_from_list_price(offers(spark, sf_dir))
    return filled.select("offer_id", *[F.round(c, 6).alias(c) for c in money.PRICES[1:]])


@query("fill_constant", f"""WITH {OFFERS_SQL}
SELECT offer_id, coalesce(rating, 0) AS rating, round(coalesce(other_price, -1), 6) AS other_price FROM offers""")
def _(spark, sf_dir):
    return offers(spark, sf_dir).na.fill({"rating": 0.0, "other_price": -1.0}).select(
        "offer_id", "rating", F.round("other_price", 6).alias("other_price"))


@query("price_ratios", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(store_price / list_price, 6) AS ratio_store, round(partner_price / list_price, 6) AS ratio_partner,
  round(other_price / list_price, 6) AS ratio_other FROM offers""")
def _(spark, sf_dir):
    ratios = money.price_ratios(offers(spark, sf_dir))
    return ratios.select("offer_id", *[F.round(f"ratio_{k}", 6).alias(f"ratio_{k}") for k in ("store", "partner", "other")])


@query("price_gaps", f"""WITH {FILLED_SQL},
lowest AS (SELECT name, min(store_price) AS floor FROM filled GROUP BY name)
SELECT offer_id, round((list_price - floor) / nullif(floor, 0), 6) AS pct_gap,
  round(list_price - floor, 6) AS net_gap FROM filled JOIN lowest USING (name)""")
def _(spark, sf_dir):
    pair = F.col("list_price"), F.col("min_store_price")
    return min_over_name(filled_offers(spark, sf_dir), ["store_price"]).select(
        "offer_id", F.round(money.pct_gap(*pair), 6).alias("pct_gap"), F.round(money.net_gap(*pair), 6).alias("net_gap"))


@query("discount_amounts", f"""WITH {FILLED_SQL}
SELECT offer_id, round(list_price - store_price, 6) AS store_discount, round(list_price - other_price, 6) AS other_discount FROM filled""")
def _(spark, sf_dir):
    found = money.discount_amounts(filled_offers(spark, sf_dir))
    return found.select("offer_id", *[F.round(c, 6).alias(c) for c in ("store_discount", "other_discount")])


@query("row_min", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(least(store_price, other_price), 6) AS lowest FROM offers""")
def _(spark, sf_dir):
    return offers(spark, sf_dir).select("offer_id", F.round(money.row_min("store_price", "other_price"), 6).alias("lowest"))


@query("row_cv", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(list_aggregate(p, 'stddev_samp') / list_aggregate(p, 'avg'), 6) AS cv
FROM (SELECT offer_id, [list_price, store_price, partner_price, other_price] AS p FROM offers)""")
def _(spark, sf_dir):
    return offers(spark, sf_dir).select("offer_id", F.round(money.row_cv(*money.PRICES), 6).alias("cv"))


@query("row_mean", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(list_aggregate([partner_price / list_price, other_price / list_price], 'avg'), 6) AS mean_ratio FROM offers""")
def _(spark, sf_dir):
    ratios = money.price_ratios(offers(spark, sf_dir))
    return ratios.select("offer_id", F.round(money.row_mean("ratio_partner", "ratio_other"), 6).alias("mean_ratio"))


@query("copy_as_text", f"WITH {OFFERS_SQL} SELECT offer_id, rating, CAST(rating AS VARCHAR) AS rating_text FROM offers")
def _(spark, sf_dir):
    return offers(spark, sf_dir).select("offer_id", "rating", F.col("rating").cast("string").alias("rating_text"))


# Longest common subsequence by its dynamic program: one list per letter of the first text, where
# cell j is the running maximum of the row above and of the diagonal plus one on equal letters.
LCS_SQL = """list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0), list_transform(range(1, length({a}) + 1), lambda i: [i])),
  lambda acc, i: list_prepend(0, list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: CASE WHEN {a}[i[1]] = {b}[k] THEN greatest(acc[k] + 1, acc[k + 1]) ELSE acc[k + 1] END)))))[-1]"""


@query("indel_ratio", f"""
WITH names AS (SELECT DISTINCT lower(p_name) AS name, lower(p_type) AS type FROM part)
SELECT name, type, round(200.0 * {LCS_SQL.format(a='name', b='type')} / (length(name) + length(type)), 6) AS ratio FROM names""")
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
    return pairs.select("name", "type", F.round(similarity.indel_ratio(F.col("name"), F.col("type")), 6).alias("ratio"))


# Each vector against the mean direction of its label.
_MEANS_SQL = """
cells AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i),
means AS (SELECT label, list(m ORDER BY i) AS mean FROM cells GROUP BY label)"""


def _with_label_means(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    cells = vecs.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(
        F.avg(F.col("v").cast("double")).alias("m"))
    means = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells")).select(
        "label", F.transform("cells", lambda c: c["m"]).alias("mean"))
    return vecs.join(means, "label")


@query("vector_cosine", f"""WITH {_MEANS_SQL}
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean), 6) AS cosine FROM embeddings JOIN means USING (label)""")
def _(spark, sf_dir):
    return _with_label_means(spark, sf_dir).select(
        "vec_id", F.round(vectors.vector_cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


@query("euclidean_distance", f"""WITH {_MEANS_SQL}
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), mean), 6) AS distance FROM embeddings JOIN means USING (label)""")
def _(spark, sf_dir):
    return _with_label_means(spark, sf_dir).select(
        "vec_id", F.round(vectors.euclidean_distance(F.col("embedding"), F.col("mean")), 6).alias("distance"))


@query("closeness", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(1 / (1 + abs(rating - 2.5)), 6) AS closeness FROM offers""")
def _(spark, sf_dir):
    return offers(spark, sf_dir).select(
        "offer_id", F.round(vectors.closeness(F.col("rating"), F.lit(2.5)), 6).alias("closeness"))
