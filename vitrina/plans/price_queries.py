"""Queries for validation, filters, joins, aggregates, windows and series over the offers view."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from vitrina.functions import dates, money
from vitrina.operators import density, lookup, matching, profile, quality, quantiles, series, stats
from vitrina.plans.bindings import BRANDS_SQL, FILLED_SQL, OFFERS_SQL, brand_kinds, filled_offers, offers, table
from vitrina.plans.registry import query

PRICES = money.PRICES
OFFER_COLUMNS = ("offer_id", "captured_on", "store", "category", "url", "name", "brand", "rating", *PRICES)
_VALID_SQL = " AND ".join(f"{c} IS NOT NULL" for c in OFFER_COLUMNS)
_PRICES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in PRICES)
_DAY_SQL = "strftime(captured_on, '%Y-%m-%d') AS captured_on"


def _day():
    return F.date_format("captured_on", "yyyy-MM-dd").alias("captured_on")


def _prices(columns=PRICES, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


# --- validation and filters -------------------------------------------------------------------

@query("split_valid_rows", f"""WITH {OFFERS_SQL}
SELECT offer_id, CASE WHEN {_VALID_SQL} THEN 'valid' ELSE 'quarantine' END AS status FROM offers""")
def _(spark, sf_dir):
    valid, bad = quality.split_valid_rows(offers(spark, sf_dir), OFFER_COLUMNS)
    return valid.select("offer_id", F.lit("valid").alias("status")).union(bad.select("offer_id", F.lit("quarantine")))


@query("ingest_summary", f"""WITH {OFFERS_SQL},
valid AS (SELECT category, store, name, captured_on, count(*) AS n FROM offers WHERE {_VALID_SQL} GROUP BY ALL)
SELECT (SELECT count(*) FROM offers) AS input_rows, CAST(sum(n) AS BIGINT) AS valid_rows,
  CAST((SELECT count(*) FROM offers) - sum(n) AS BIGINT) AS quarantined_rows,
  CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, {len(OFFER_COLUMNS)} AS column_count FROM valid""")
def _(spark, sf_dir):
    return quality.ingest_summary(offers(spark, sf_dir), OFFER_COLUMNS, ("category", "store", "name", "captured_on"))


@query("project", f"WITH {OFFERS_SQL} SELECT store, url, name FROM offers")
def _(spark, sf_dir):
    return offers(spark, sf_dir).select("store", "url", "name")


@query("drop_column", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").drop("text")


@query("select_campaign_rows", f"""WITH {OFFERS_SQL}
SELECT offer_id, {_DAY_SQL} FROM offers WHERE (year(captured_on) = 2000 OR (month(captured_on) = 12 AND day(captured_on) > 14))
AND (list_price > 50000 OR store_price > 50000 OR partner_price > 50000 OR other_price > 50000)""")
def _(spark, sf_dir):
    return quality.select_campaign_rows(offers(spark, sf_dir), year=2000, above=50_000).select("offer_id", _day())


@query("filter_since", f"WITH {OFFERS_SQL} SELECT offer_id, {_DAY_SQL} FROM offers WHERE captured_on >= DATE '2000-01-01'")
def _(spark, sf_dir):
    return quality.filter_since(offers(spark, sf_dir), datetime.date(2000, 1, 1)).select("offer_id", _day())


@query("filter_equal", f"WITH {OFFERS_SQL} SELECT offer_id, store FROM offers WHERE category = 'ECONOMY'")
def _(spark, sf_dir):
    return offers(spark, sf_dir).filter(F.col("category") == "ECONOMY").select("offer_id", "store")


@query("filter_price_band", f"WITH {OFFERS_SQL} SELECT offer_id, list_price FROM offers WHERE list_price BETWEEN 30000 AND 60000")
def _(spark, sf_dir):
    return quality.filter_price_band(offers(spark, sf_dir), 30_000, 60_000).select("offer_id", "list_price")


@query("drop_null_rows", f"WITH {OFFERS_SQL} SELECT offer_id, rating FROM offers WHERE {_VALID_SQL}")
def _(spark, sf_dir):
    return quality.drop_null_rows(offers(spark, sf_dir)).select("offer_id", "rating")


_TRIM_SQL, _last = "", "filled"
for _c in PRICES:
    _TRIM_SQL += f""",
trim_{_c} AS (SELECT * FROM {_last} WHERE {_c} >= (SELECT quantile_cont({_c}, 0.01) FROM {_last})
  AND {_c} <= (SELECT quantile_cont({_c}, 0.99) FROM {_last}))"""
    _last = f"trim_{_c}"


@query("trim_outliers", f"WITH {FILLED_SQL}{_TRIM_SQL} SELECT offer_id, {_PRICES_SQL} FROM {_last}")
def _(spark, sf_dir):
    return quality.trim_outliers(filled_offers(spark, sf_dir)).select("offer_id", *_prices())


@query("drop_top_n", f"WITH {OFFERS_SQL} SELECT offer_id, list_price FROM offers ORDER BY list_price DESC, offer_id OFFSET 3")
def _(spark, sf_dir):
    return quality.drop_top_n(offers(spark, sf_dir)).select("offer_id", "list_price")


# --- joins and set operations --------------------------------------------------------------------

@query("join_brand_kind", f"""WITH {OFFERS_SQL},{BRANDS_SQL}
SELECT offer_id, o.brand, coalesce(kind, 'Errores') AS kind FROM offers o LEFT JOIN brand_kinds b ON o.brand = b.brand""")
def _(spark, sf_dir):
    return lookup.join_brand_kind(offers(spark, sf_dir), brand_kinds(spark, sf_dir)).select("offer_id", "brand", "kind")


# Specifications of a product: its sizes and types; sentiment of a product: mean of a line's discount.
@query("join_specs_sentiment", """
WITH specs AS (SELECT p_partkey, unnest([{'place': 0, 'text': 'type: ' || p_type}, {'place': 1, 'text': 'size: ' || p_size},
  {'place': 2, 'text': 'brand: ' || p_brand}]) AS pair FROM part),
texts AS (SELECT p_partkey, string_agg(pair.text, ' ' ORDER BY pair.place) AS specs_text FROM specs GROUP BY p_partkey),
sent AS (SELECT l_partkey AS p_partkey, avg(l_tax) AS sentiment FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, md5(coalesce(specs_text, '')) AS specs_digest, round(coalesce(sentiment, 0), 6) AS sentiment
FROM part LEFT JOIN texts USING (p_partkey) LEFT JOIN sent USING (p_partkey)""")
def _(spark, sf_dir):
    """Every part has three rows of specifications; its sentiment is the mean tax of its line items."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    pair = lambda place, name: F.struct(
        F.lit(place).alias("place"), F.concat(F.lit(f"{name}: "), F.col(f"p_{name}").cast("string")).alias("specs_text"))
    pairs = part.select("p_partkey", F.inline(F.array(*[pair(i, name) for i, name in enumerate(("type", "size", "brand"))])))
    specs = stats.concat_by_key(pairs, "p_partkey", "specs_text", ["place"])
    sentiment = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_tax").alias("sentiment"))
    joined = lookup.join_by_url(part.select("p_partkey"), specs, sentiment, key="p_partkey").na.fill({"specs_text": "", "sentiment": 0.0})
    return joined.select(
        "p_partkey", F.md5(F.col("specs_text").cast("binary")).alias("specs_digest"), F.round("sentiment", 6).alias("sentiment"))


@query("semi_join_names", f"""WITH {OFFERS_SQL}
SELECT offer_id, name FROM offers WHERE name IN (SELECT p_name FROM part WHERE p_size = 7)""")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_name").alias("name"))
    return lookup.semi_join(offers(spark, sf_dir), names, ["name"]).select("offer_id", "name")


@query("anti_join_done", f"""WITH {OFFERS_SQL}
SELECT offer_id, url FROM offers o WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 25 AND 'p/' || CAST(p_partkey AS VARCHAR) = o.url)""")
def _(spark, sf_dir):
    done = table(spark, sf_dir, "part").filter("p_size > 25").select(
        F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("url"))
    return lookup.anti_join(offers(spark, sf_dir), done, ["url"]).select("offer_id", "url")


@query("lookup_map", """
SELECT p_partkey, coalesce(g, -1) AS group_id FROM part LEFT JOIN
  (SELECT p_name AS name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS g FROM (SELECT DISTINCT p_name FROM part WHERE p_size = 9)) ON p_name = name""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_name").alias("name"))
    groups = matching.number_rows(part.filter("p_size = 9").select("name").distinct(), ["name"], "group_id")
    return lookup.lookup_map(part, groups, "name", "group_id", -1).select("p_partkey", "group_id")


@query("union_batches", """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return lookup.union_batches(customers, suppliers)


@query("split_by_membership", f"WITH {OFFERS_SQL} SELECT offer_id FROM offers WHERE NOT ({_VALID_SQL})")
def _(spark, sf_dir):
    _, rest = lookup.split_by(offers(spark, sf_dir), quality.non_null_count(OFFER_COLUMNS) == len(OFFER_COLUMNS))
    return rest.select("offer_id")


# --- aggregates -----------------------------------------------------------------------------------

@query("count_by_day_store", f"WITH {OFFERS_SQL} SELECT {_DAY_SQL}, store, count(*) AS n FROM offers GROUP BY ALL")
def _(spark, sf_dir):
    return stats.count_by(offers(spark, sf_dir), ["captured_on", "store"]).select(_day(), "store", "n")


@query("count_by_day_store_name", f"WITH {OFFERS_SQL} SELECT {_DAY_SQL}, store, name, count(*) AS n FROM offers GROUP BY ALL")
def _(spark, sf_dir):
    return stats.count_by(offers(spark, sf_dir), ["captured_on", "store", "name"]).select(_day(), "store", "name", "n")


@query("impute_group_mean", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(coalesce(rating, avg(rating) OVER (PARTITION BY category)), 6) AS rating FROM offers""")
def _(spark, sf_dir):
    return stats.impute_group_mean(offers(spark, sf_dir)).select("offer_id", F.round("rating", 6).alias("rating"))


@query("impute_column_mean", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(coalesce(rating, avg(rating) OVER ()), 6) AS rating,
  round(coalesce(other_price / list_price, avg(other_price / list_price) OVER ()), 6) AS ratio_other FROM offers""")
def _(spark, sf_dir):
    ratios = money.price_ratios(offers(spark, sf_dir))
    return stats.impute_column_mean(ratios, ["rating", "ratio_other"]).select("offer_id", *_prices(["rating", "ratio_other"]))


@query("dedupe_full_row", "SELECT DISTINCT text, lang, source FROM documents".join(["SELECT md5(text) AS digest, lang, source FROM (", ")"]))
def _(spark, sf_dir):
    rows = quality.dedupe_full_row(table(spark, sf_dir, "documents").select("text", "lang", "source"))
    return rows.select(F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "source")


@query("count_duplicates", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS duplicates FROM documents""")
def _(spark, sf_dir):
    return quality.count_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))


@query("dedupe_by_keys", f"""WITH {OFFERS_SQL}
SELECT offer_id, name, store FROM offers QUALIFY row_number() OVER (PARTITION BY name, store ORDER BY captured_on, offer_id) = 1""")
def _(spark, sf_dir):
    return quality.dedupe_by_keys(offers(spark, sf_dir), ["name", "store"], ["captured_on", "offer_id"]).select("offer_id", "name", "store")


@query("distinct_values", """
SELECT 'category' AS column_name, p_type AS value FROM part GROUP BY ALL UNION ALL SELECT 'name', p_name FROM part GROUP BY ALL""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kinds = part.select(F.lit("category").alias("column_name"), F.col("p_type").alias("value")).distinct()
    return kinds.union(part.select(F.lit("name"), "p_name").distinct())


_NAME_STATS_SQL = """
name_stats AS (SELECT name, count(DISTINCT list_price) AS distinct_list_prices, avg(list_price) AS mean_list_price,
  avg(store_price) AS mean_store_price, avg(partner_price) AS mean_partner_price, avg(other_price) AS mean_other_price
  FROM {0} GROUP BY name)"""
_MEANS = [f"mean_{p}" for p in PRICES]
_MEANS_SQL = ", ".join(f"round({m}, 3) AS {m}" for m in _MEANS)


@query("name_price_stats", f"WITH {OFFERS_SQL},{_NAME_STATS_SQL.format('offers')} SELECT name, distinct_list_prices, {_MEANS_SQL} FROM name_stats")
def _(spark, sf_dir):
    return stats.name_price_stats(offers(spark, sf_dir)).select("name", "distinct_list_prices", *_prices(_MEANS, 3))


@query("varied_names", f"""WITH {OFFERS_SQL},{_NAME_STATS_SQL.format('offers')}
SELECT name, distinct_list_prices, {_MEANS_SQL} FROM name_stats WHERE distinct_list_prices > 900
AND greatest(mean_list_price, mean_store_price, mean_partner_price, mean_other_price) <> least(mean_list_price, mean_store_price, mean_partner_price, mean_other_price)""")
def _(spark, sf_dir):
    found = stats.varied_names(stats.name_price_stats(offers(spark, sf_dir)), more_than=900)
    return found.select("name", "distinct_list_prices", *_prices(_MEANS, 3))


@query("mean_by_url", f"""WITH {OFFERS_SQL}
SELECT url, round(avg(store_price / list_price), 9) AS ratio_store, round(avg(other_price / list_price), 9) AS ratio_other FROM offers GROUP BY url""")
def _(spark, sf_dir):
    columns = ["ratio_store", "ratio_other"]
    return stats.mean_by(money.price_ratios(offers(spark, sf_dir)), ["url"], columns).select("url", *_prices(columns, 9))


@query("concat_by_key", """
SELECT source, lang, CAST(length(t) AS BIGINT) AS length, md5(t) AS digest FROM (
  SELECT source, arg_min(lang, doc_id) AS lang, string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents GROUP BY source)""")
def _(spark, sf_dir):
    joined = stats.concat_by_key(table(spark, sf_dir, "documents"), "source", "text", ["doc_id"], first=["lang"])
    return joined.select(
        "source", "lang", F.length("text").cast("long").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("mean_line", f"""WITH {OFFERS_SQL},
lowest AS (SELECT name, min(list_price) AS min_list_price FROM offers GROUP BY name)
SELECT category, store, {_DAY_SQL}, round(avg(min_list_price), 4) AS mean, count(*) AS n, round(stddev_samp(min_list_price), 3) AS deviation
FROM offers JOIN lowest USING (name) GROUP BY category, store, captured_on""")
def _(spark, sf_dir):
    lines = stats.mean_line(stats.min_over_name(offers(spark, sf_dir), ["list_price"]), "min_list_price")
    return lines.select("category", "store", _day(), F.round("mean", 4).alias("mean"), "n", F.round("deviation", 3).alias("deviation"))


def _gaps(spark, sf_dir):
    """Offers with the gap of their list price to the lowest store price of their name."""
    lowest = stats.min_over_name(filled_offers(spark, sf_dir), ["store_price"])
    return lowest.withColumn("gap", money.pct_gap(F.col("list_price"), F.col("min_store_price")))


@query("mean_line_gap", f"""WITH {FILLED_SQL},
lowest AS (SELECT name, min(store_price) AS floor FROM filled GROUP BY name)
SELECT category, store, {_DAY_SQL}, round(avg((list_price - floor) / floor), 6) AS mean, count(*) AS n FROM filled JOIN lowest USING (name) GROUP BY ALL""")
def _(spark, sf_dir):
    return stats.mean_line(_gaps(spark, sf_dir), "gap").select("category", "store", _day(), F.round("mean", 6).alias("mean"), "n")


@query("mean_line_ci")
def _(spark, sf_dir):
    return density.mean_line_ci(_gaps(spark, sf_dir), "gap", ["category", "store", "captured_on"], "offer_id")


_BOX_SQL = """
quartiles AS (SELECT {keys}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM {source} WHERE v IS NOT NULL GROUP BY {keys})
SELECT {keys}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
  round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM {source} JOIN quartiles USING ({keys}) WHERE v IS NOT NULL GROUP BY {keys}, q1, median, q3"""
_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("box_stats_cv", f"""WITH {FILLED_SQL},
lowest AS (SELECT name, min(list_price) AS a, min(store_price) AS b, min(partner_price) AS c, min(other_price) AS d FROM filled GROUP BY name),
measured AS (SELECT category, store, list_aggregate([a, b, c, d], 'stddev_samp') / list_aggregate([a, b, c, d], 'avg') AS v FROM filled JOIN lowest USING (name)),
""" + _BOX_SQL.format(keys="category, store", source="measured"))
def _(spark, sf_dir):
    lowest = stats.min_over_name(filled_offers(spark, sf_dir))
    measured = lowest.withColumn("cv", money.row_cv(*[f"min_{p}" for p in PRICES]))
    return quantiles.box_stats(measured, "cv", ["category", "store"]).select("category", "store", "n", "outliers", *_prices(_BOX))


@query("box_stats_weekday", f"""WITH {OFFERS_SQL},
measured AS (SELECT category, dayname(captured_on) AS weekday, least(store_price, other_price) AS v FROM offers),
""" + _BOX_SQL.format(keys="category, weekday", source="measured"))
def _(spark, sf_dir):
    measured = offers(spark, sf_dir).withColumns(
        {"weekday": dates.weekday(F.col("captured_on")), "lowest": money.row_min("store_price", "other_price")})
    return quantiles.box_stats(measured, "lowest", ["category", "weekday"]).select("category", "weekday", "n", "outliers", *_prices(_BOX))


_CORR_SQL = """
correlations AS (SELECT category, name, CASE WHEN min(list_price) < max(list_price) AND min(other_price) < max(other_price) THEN corr(list_price, other_price) END AS v,
  count(*) AS n FROM {0} WHERE list_price IS NOT NULL AND other_price IS NOT NULL GROUP BY category, name)"""


@query("group_corr", f"WITH {OFFERS_SQL},{_CORR_SQL.format('offers')} SELECT category, name, round(v, 6) AS correlation, n FROM correlations")
def _(spark, sf_dir):
    found = stats.group_corr(offers(spark, sf_dir), "list_price", "other_price", ["category", "name"])
    return found.select("category", "name", F.round("correlation", 6).alias("correlation"), "n")


@query("box_stats_corr", f"WITH {OFFERS_SQL},{_CORR_SQL.format('offers')}," + _BOX_SQL.format(keys="category", source="correlations"))
def _(spark, sf_dir):
    found = stats.group_corr(offers(spark, sf_dir), "list_price", "other_price", ["category", "name"])
    return quantiles.box_stats(found, "correlation", ["category"]).select("category", "n", "outliers", *_prices(_BOX))


@query("kde", f"""WITH {FILLED_SQL},
lowest AS (SELECT name, min(store_price) AS floor FROM filled GROUP BY name),
measured AS (SELECT category, store, (list_price - floor) / floor AS v FROM filled JOIN lowest USING (name)),
bands AS (SELECT category, store, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM measured GROUP BY ALL HAVING stddev_samp(v) > 0),
grid AS (SELECT *, lo - 3 * bw + g * ((hi - lo + 6 * bw) / 199) AS x FROM bands, range(0, 200) AS r(g))
SELECT category, store, g AS grid_point, round(x, 6) + 0.0 AS x, round(sum(exp(-0.5 * pow((x - v) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM grid JOIN measured USING (category, store) GROUP BY category, store, g, x, n, bw""")
def _(spark, sf_dir):
    return density.kde(_gaps(spark, sf_dir), "gap", ["category", "store"]).select("category", "store", "grid_point", (F.round("x", 6) + 0.0).alias("x"), F.round("density", 6).alias("density"))


_PROFILED = ("rating", "list_price", "store_price", "partner_price", "other_price")


@query("profile_columns", f"WITH {OFFERS_SQL},\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS v FROM offers" for c in _PROFILED) + """),
m AS (SELECT "column", avg(v) AS a FROM long GROUP BY 1)
SELECT "column", count(*) AS row_count, count(*) FILTER (v IS NULL) AS missing, count(DISTINCT v) AS distinct_values,
  count(*) FILTER (v = 0) AS zeros, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 3) AS mean,
  round(stddev_samp(v), 3) AS deviation, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3,
  round(avg(pow(v - a, 3)) / pow(avg(pow(v - a, 2)), 1.5), 6) AS skewness,
  round(avg(pow(v - a, 4)) / pow(avg(pow(v - a, 2)), 2) - 3, 6) AS kurtosis
FROM long JOIN m USING ("column") GROUP BY "column" """)
def _(spark, sf_dir):
    found = profile.profile_numeric(offers(spark, sf_dir), _PROFILED)
    return found.select(
        "column", "row_count", "missing", "distinct_values", "zeros", *_prices(["mean", "deviation"], 3),
        *_prices(["min", "max", "q1", "median", "q3", "skewness", "kurtosis"]))


@query("frequent_values", f"WITH {OFFERS_SQL},\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value FROM offers" for c in ("store", "category", "name", "brand")) + """),
c AS (SELECT "column", value, count(*) AS n FROM long GROUP BY ALL)
SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS position FROM c
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 10""")
def _(spark, sf_dir):
    return profile.frequent_values(offers(spark, sf_dir), ["store", "category", "name", "brand"])


def _uncertainty_sql(a: str, b: str) -> str:
    joint = f"(SELECT {a} AS x, {b} AS y, count(*) AS n FROM offers GROUP BY ALL)"
    h = "ln(sum(n)) - sum(n * ln(n)) / sum(n)"
    hx = f"(SELECT {h} FROM (SELECT {a}, count(*) AS n FROM offers GROUP BY ALL))"
    hy = f"(SELECT {h} FROM (SELECT {b}, count(*) AS n FROM offers GROUP BY ALL))"
    return f"SELECT '{a}' AS a, '{b}' AS b, 'uncertainty' AS measure, ({hx} + {hy} - (SELECT {h} FROM {joint})) / {hx} AS value"


def _ratio_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, 'correlation_ratio' AS measure, sqrt(sum(n * pow(m - g, 2)) / any_value(total)) AS value FROM (
  SELECT {a}, count(*) AS n, avg({b}) AS m, (SELECT avg({b}) FROM offers) AS g, (SELECT sum(pow({b} - (SELECT avg({b}) FROM offers), 2)) FROM offers) AS total
  FROM offers WHERE {b} IS NOT NULL GROUP BY {a})"""


@query("association_matrix", f"WITH {OFFERS_SQL} SELECT a, b, measure, round(value, 6) AS value FROM (" + " UNION ALL ".join(
    [f"SELECT '{a}' AS a, '{b}' AS b, 'pearson' AS measure, corr({a}, {b}) AS value FROM offers"
     for a, b in [("rating", "list_price"), ("rating", "other_price"), ("list_price", "other_price")]]
    + [_ratio_sql(a, b) for a in ("category", "brand") for b in ("rating", "list_price", "other_price")]
    + [_uncertainty_sql("category", "brand"), _uncertainty_sql("brand", "category")]) + ")")
def _(spark, sf_dir):
    found = profile.association_matrix(offers(spark, sf_dir), ["rating", "list_price", "other_price"], ["category", "brand"])
    return found.withColumn("value", F.round("value", 6))


_SCALED_SQL = "round((rating - (SELECT min(rating) FROM offers)) / ((SELECT max(rating) FROM offers) - (SELECT min(rating) FROM offers)), 6)"


@query("min_max_scale", f"""WITH {OFFERS_SQL}
SELECT offer_id, {_SCALED_SQL} AS rating_scaled, round((list_price - (SELECT min(list_price) FROM offers)) /
  ((SELECT max(list_price) FROM offers) - (SELECT min(list_price) FROM offers)), 6) AS list_price_scaled FROM offers""")
def _(spark, sf_dir):
    return stats.min_max_scale(offers(spark, sf_dir), ["rating", "list_price"]).select(
        "offer_id", *_prices(["rating_scaled", "list_price_scaled"]))


@query("standardise", f"""WITH {OFFERS_SQL}
SELECT offer_id, round((rating - (SELECT avg(rating) FROM offers)) / (SELECT stddev_pop(rating) FROM offers), 6) AS rating_std,
  round((list_price - (SELECT avg(list_price) FROM offers)) / (SELECT stddev_pop(list_price) FROM offers), 6) AS list_price_std FROM offers""")
def _(spark, sf_dir):
    return stats.standardise(offers(spark, sf_dir), ["rating", "list_price"]).select("offer_id", *_prices(["rating_std", "list_price_std"]))


# Ratings above 4.4 stand for infinite values, missing ones for NaN.
@query("nonfinite_to_mean", f"""WITH {OFFERS_SQL}
SELECT offer_id, round(CASE WHEN rating <= 4.4 THEN rating ELSE (SELECT avg(rating) FROM offers WHERE rating <= 4.4) END, 6) AS rating FROM offers""")
def _(spark, sf_dir):
    rating = F.when(F.col("rating") > 4.4, F.lit(float("inf"))).otherwise(F.coalesce("rating", F.lit(float("nan"))))
    cleaned = stats.nonfinite_to_mean(offers(spark, sf_dir).withColumn("rating", rating), ["rating"])
    return cleaned.select("offer_id", F.round("rating", 6).alias("rating"))


@query("price_points", f"""WITH {FILLED_SQL}
SELECT DISTINCT category, store, name, round(list_price, 6) AS list_price, round(store_price, 6) AS store_price, round(other_price, 6) AS other_price FROM filled""")
def _(spark, sf_dir):
    points = stats.price_points(filled_offers(spark, sf_dir))
    return points.select("category", "store", "name", *_prices(["list_price", "store_price", "other_price"])).distinct()


@query("price_grid", f"""WITH {FILLED_SQL}
SELECT category, CAST(floor(log10(list_price) * 10) AS BIGINT) AS x_cell, CAST(floor(log10(other_price) * 10) AS BIGINT) AS y_cell, count(*) AS points FROM filled GROUP BY ALL""")
def _(spark, sf_dir):
    return stats.price_grid(filled_offers(spark, sf_dir), "other_price")


_FIRST_SQL = """
seen AS (SELECT category, name, min(captured_on) AS first_seen FROM {0} WHERE list_price BETWEEN 30000 AND 60000 GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY first_seen, name) AS position FROM seen QUALIFY position <= 3)"""


@query("first_names_per_category", f"""WITH {OFFERS_SQL},{_FIRST_SQL.format('offers')}
SELECT category, name, strftime(first_seen, '%Y-%m-%d') AS first_seen, CAST(position AS INTEGER) AS position FROM firsts""")
def _(spark, sf_dir):
    band = quality.filter_price_band(offers(spark, sf_dir), 30_000, 60_000)
    return stats.first_names_per_category(band).withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd"))


# Whole cents: their sums are exact, so the means do not depend on the order of addition.
@query("price_history", f"WITH {FILLED_SQL},{_FIRST_SQL.format('filled')}, chosen AS (SELECT * FROM filled WHERE name IN (SELECT name FROM firsts))\n" + " UNION ALL ".join(
    f"SELECT name, '{p}' AS price_type, {_DAY_SQL}, avg(floor({p} * 100 + 0.5)) AS mean_cents FROM chosen GROUP BY name, captured_on" for p in PRICES))
def _(spark, sf_dir):
    filled = filled_offers(spark, sf_dir)
    names = stats.first_names_per_category(quality.filter_price_band(filled, 30_000, 60_000))
    cents = filled.withColumns({p: F.floor(F.col(p) * 100 + 0.5).cast("double") for p in PRICES})
    return stats.price_history(cents, names).select("name", "price_type", _day(), F.col("mean_price").alias("mean_cents"))


# --- windows, order, limits ------------------------------------------------------------------------

@query("min_over_name", f"WITH {OFFERS_SQL} SELECT offer_id, " + ", ".join(
    f"round(min({p}) OVER (PARTITION BY name), 6) AS min_{p}" for p in PRICES) + " FROM offers")
def _(spark, sf_dir):
    return stats.min_over_name(offers(spark, sf_dir)).select("offer_id", *_prices([f"min_{p}" for p in PRICES]))


@query("scale_within_name", f"""WITH {OFFERS_SQL}
SELECT offer_id, round((list_price - min(list_price) OVER w) / nullif(max(list_price) OVER w - min(list_price) OVER w, 0), 6) AS list_price_scaled
FROM offers WINDOW w AS (PARTITION BY name)""")
def _(spark, sf_dir):
    return stats.scale_within_name(offers(spark, sf_dir), "list_price").select("offer_id", F.round("list_price_scaled", 6).alias("list_price_scaled"))


@query("top_k_by_score", f"""WITH {OFFERS_SQL}
SELECT store, offer_id, list_price, CAST(row_number() OVER (PARTITION BY store ORDER BY list_price DESC, offer_id) AS INTEGER) AS position FROM offers
QUALIFY row_number() OVER (PARTITION BY store ORDER BY list_price DESC, offer_id) <= 5""")
def _(spark, sf_dir):
    return stats.top_k_by_score(offers(spark, sf_dir), "store", "list_price", ["offer_id"]).select("store", "offer_id", "list_price", "position")


@query("sort_by_price", f"WITH {OFFERS_SQL} SELECT offer_id, list_price FROM offers ORDER BY list_price DESC, offer_id")
def _(spark, sf_dir):
    return offers(spark, sf_dir).select("offer_id", "list_price").orderBy(F.desc("list_price"), "offer_id")


@query("sort_by_weekday", f"WITH {OFFERS_SQL} SELECT offer_id, CAST(isodow(captured_on) - 1 AS INTEGER) AS weekday_order, store FROM offers ORDER BY ALL")
def _(spark, sf_dir):
    ordered = offers(spark, sf_dir).select("offer_id", dates.weekday_order(F.col("captured_on")).alias("weekday_order"), "store")
    return ordered.orderBy("weekday_order", "store", "offer_id")


@query("head_rows", f"WITH {OFFERS_SQL} SELECT offer_id, list_price FROM offers ORDER BY captured_on, offer_id LIMIT 5")
def _(spark, sf_dir):
    return offers(spark, sf_dir).orderBy("captured_on", "offer_id").limit(5).select("offer_id", "list_price")


# --- series ----------------------------------------------------------------------------------------

@query("daily_mean", f"WITH {OFFERS_SQL} SELECT store, strftime(captured_on, '%Y-%m-%d') AS day, round(avg(list_price), 5) AS mean FROM offers GROUP BY ALL")
def _(spark, sf_dir):
    return series.daily_mean(offers(spark, sf_dir)).select(
        "store", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("mean", 5).alias("mean"))


@query("daily_mean_calendar", """
WITH days AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS mean FROM events GROUP BY ALL),
span AS (SELECT event_type, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM days GROUP BY event_type)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(mean, 5) AS mean FROM span LEFT JOIN days USING (event_type, day)""")
def _(spark, sf_dir):
    found = series.daily_mean(table(spark, sf_dir, "events"), "value", ["event_type"], "ts", calendar=True)
    return found.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("mean", 5).alias("mean"))


@query("stl_decompose")
def _(spark, sf_dir):
    return series.stl_decompose(series.daily_mean(offers(spark, sf_dir)))
