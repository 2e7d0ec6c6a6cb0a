"""Queries for the similarity join and the groupings built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import text
from vitrina.operators import embeddings, matching, stats
from vitrina.plans.bindings import product_offers, table
from vitrina.plans.registry import query

# Longest common subsequence, bit-parallel: one bit per letter of b, one step per letter of a.
_COMMON_SQL = """length(b) - bit_count(list_reduce(list_prepend((1::HUGEINT << length(b)) - 1,
  list_transform(range(1, length(a) + 1), lambda i: coalesce(list_sum(list_transform(range(1, length(b) + 1),
    lambda k: CASE WHEN a[i] = b[k] THEN 1::HUGEINT << (k - 1) ELSE 0::HUGEINT END)), 0::HUGEINT))),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(b)) - 1)))"""



def _edges_sql(items: str, threshold: int, extra: str = "TRUE") -> str:
    """Pairs of numbered items; length band and edit distance drop only pairs that cannot qualify."""
    return f"""
pairs AS MATERIALIZED (SELECT x.item AS i, y.item AS j, x.text AS a, y.text AS b FROM {items} x JOIN {items} y ON x.item < y.item
  AND 2 * least(length(x.text), length(y.text)) >= {threshold / 100} * (length(x.text) + length(y.text)) AND {extra}
  AND levenshtein(x.text, y.text) <= {1 - threshold / 100:.2f} * (length(x.text) + length(y.text)) + 1e-9),
edges AS MATERIALIZED (SELECT * FROM (SELECT i, j, 200.0::DOUBLE * ({_COMMON_SQL}) / (length(a) + length(b)) AS ratio FROM pairs) WHERE ratio >= {threshold})"""


_SEQUENTIAL_SQL = """
numbered AS MATERIALIZED (SELECT item, row_number() OVER (ORDER BY item) AS n FROM items),
earlier AS MATERIALIZED (SELECT y.n, list(x.n) AS nbrs FROM edges JOIN numbered x ON x.item = i JOIN numbered y ON y.item = j GROUP BY y.n),
nodes AS MATERIALIZED (SELECT n, coalesce(nbrs, CAST([] AS BIGINT[])) AS nbrs FROM numbered LEFT JOIN earlier USING (n)),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS leaders
  UNION ALL SELECT walk.n + 1, CASE WHEN list_has_any(leaders, nbrs) THEN leaders ELSE list_append(leaders, nodes.n) END
  FROM walk JOIN nodes ON nodes.n = walk.n + 1),
led AS MATERIALIZED (SELECT unnest(leaders) AS n FROM (SELECT leaders FROM walk ORDER BY n DESC LIMIT 1)),
grouped AS MATERIALIZED (SELECT m.item AS item, coalesce(l.item, m.item) AS leader FROM numbered m
  LEFT JOIN (SELECT e.j, {pick}(e.i) AS li FROM edges e JOIN numbered x ON x.item = e.i JOIN led ON led.n = x.n GROUP BY e.j) g
    ON g.j = m.item AND m.n NOT IN (SELECT n FROM led)
  LEFT JOIN numbered l ON l.item = g.li)"""


def _items(spark, sf_dir):
    return product_offers(spark, sf_dir).withColumn("item", F.col("text"))


_TEXT_ITEMS_SQL = "items AS MATERIALIZED (SELECT DISTINCT p_name || ' ' || p_brand AS item, p_name || ' ' || p_brand AS text FROM part)"


@query("similarity_self_join", f"""WITH {_TEXT_ITEMS_SQL},{_edges_sql('items', 85)}
SELECT i AS a, j AS b, round(ratio, 6) AS ratio FROM edges""")
def _(spark, sf_dir):
    return matching.similarity_self_join(_items(spark, sf_dir), 85).withColumn("ratio", F.round("ratio", 6))


_GROUPS_SQL = f"WITH RECURSIVE {_TEXT_ITEMS_SQL},{_edges_sql('items', 85)},{_SEQUENTIAL_SQL.format(pick='min')}"


@query("leader_groups", _GROUPS_SQL + " SELECT item, leader FROM grouped")
def _(spark, sf_dir):
    return matching.leader_groups(_items(spark, sf_dir), 85)


@query("number_groups", _GROUPS_SQL + """
SELECT item, leader, CAST(dense_rank() OVER (ORDER BY leader) - 1 AS BIGINT) AS group_id FROM grouped""")
def _(spark, sf_dir):
    return matching.number_groups(matching.leader_groups(_items(spark, sf_dir), 85)).select("item", "leader", "group_id")


# The second method of the report takes each brand as a group.
@query("group_report", _GROUPS_SQL + """,
ids AS (SELECT item, CAST(dense_rank() OVER (ORDER BY leader) - 1 AS BIGINT) AS group_id FROM grouped),
brands AS (SELECT item, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS BIGINT) AS group_id FROM (SELECT DISTINCT p_name AS item, min(p_brand) AS brand FROM part GROUP BY p_name))
SELECT coalesce(x.group_id, y.group_id) AS group_id, coalesce(x.m, '') AS by_ratio, coalesce(y.m, '') AS by_brand
FROM (SELECT group_id, string_agg(item, '; ' ORDER BY item) AS m FROM ids GROUP BY 1) x
FULL JOIN (SELECT group_id, string_agg(item, '; ' ORDER BY item) AS m FROM brands GROUP BY 1) y ON x.group_id = y.group_id""")
def _(spark, sf_dir):
    ratio = matching.number_groups(matching.leader_groups(_items(spark, sf_dir), 85))
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("item")).agg(F.min("p_brand").alias("leader"))
    return matching.group_report(by_ratio=ratio, by_brand=matching.number_groups(brands))


def _priced_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    joined = text.match_text(F.col("p_type"), F.col("p_name"), F.lit("equipment"), F.col("p_brand"))
    scaled = stats.min_max_scale(part, ["p_retailprice"])
    return scaled.select(F.col("p_partkey").alias("item"), joined.alias("text"), F.col("p_retailprice_scaled").alias("price"))


# Prices lie on a scale from 0 to 1; pairs further apart than the gap never meet.
_PRICED_SQL = """items AS MATERIALIZED (SELECT p_partkey AS item, p_type || ' ' || p_name || 'equipment' || p_brand AS text,
  (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS price FROM part)"""


# As above, with the bits of each text's letters made once for the text instead of once for each pair.
_MASKED_SQL = """
letters AS (SELECT text, text[k] AS letter, sum(1::HUGEINT << (k - 1)) AS bits
  FROM (SELECT text, unnest(range(1, length(text) + 1)) AS k FROM (SELECT DISTINCT text FROM items)) GROUP BY ALL),
masks AS MATERIALIZED (SELECT text, map_from_entries(list((letter, CAST(bits AS HUGEINT)))) AS bits FROM letters GROUP BY text),
close AS MATERIALIZED (SELECT x.item AS i, y.item AS j, x.text AS a, y.text AS b FROM items x JOIN items y ON x.item < y.item
  AND 2 * least(length(x.text), length(y.text)) >= 0.75 * (length(x.text) + length(y.text)) AND abs(x.price - y.price) <= 0.15
  AND levenshtein(x.text, y.text) <= 0.25 * (length(x.text) + length(y.text)) + 1e-9),
rated AS MATERIALIZED (SELECT a, b, 200.0::DOUBLE * (length(b) - bit_count(list_reduce(list_prepend((1::HUGEINT << length(b)) - 1,
  list_transform(range(1, length(a) + 1), lambda i: coalesce(map_extract_value(bits, a[i]), 0::HUGEINT))),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(b)) - 1)))) / (length(a) + length(b)) AS ratio
  FROM (SELECT DISTINCT a, b FROM close) JOIN masks ON masks.text = b),
edges AS MATERIALIZED (SELECT i, j FROM close JOIN rated USING (a, b) WHERE ratio >= 75)"""


@query("match_products", f"WITH RECURSIVE {_PRICED_SQL},{_MASKED_SQL},{_SEQUENTIAL_SQL.format(pick='max')} SELECT item, leader FROM grouped")
def _(spark, sf_dir):
    return matching.match_products(_priced_parts(spark, sf_dir))


@query("embedding_groups")
def _(spark, sf_dir):
    return embeddings.embedding_groups(product_offers(spark, sf_dir).withColumn("item", F.col("text")), threshold=0.7)
