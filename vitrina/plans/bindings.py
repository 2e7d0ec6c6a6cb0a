"""Views that bind the driver tables to the vocabulary of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.functions.money import row_max_fill
from vitrina.session import BROADCAST_ROWS, spread


# Tables of texts and pages: their work is computation, not volume.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def _side(rows: DataFrame) -> DataFrame:
    """The smaller side of a join with the line items: broadcast when counted small, else hashed part by part, so that no line item is sorted."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer per line item; discount and rating gaps come from flags and quantities."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    stores = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return (
        lines.join(_side(parts), lines.l_partkey == parts.p_partkey)
        .join(_side(stores), lines.l_suppkey == stores.s_suppkey)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("offer_id"),
            F.to_date("l_shipdate").alias("captured_on"),
            F.col("s_name").alias("store"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("url"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.when(F.col("l_quantity") <= 45, F.col("l_quantity") / 10).alias("rating"),
            price.alias("list_price"),
            (price * (1 - discount)).alias("store_price"),
            F.when(F.col("l_returnflag") != "R", price * (1 - discount / 2)).alias("partner_price"),
            F.when(F.col("l_linestatus") != "O", price * (1 - discount) * (1 + F.col("l_tax"))).alias("other_price"),
        )
    )


def filled_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_max_fill(offers(spark, sf_dir))


def brand_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand list derived from the brand numbers; brands above 20 are not listed."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    number = F.regexp_extract("brand", r"(\d+)", 1).cast("int")
    return brands.filter(number <= 20).select(
        "brand", F.when(number <= 12, "equipment").otherwise("accessory").alias("kind")
    )


def product_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct product names with brand, for matching."""
    part = table(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", "p_name", "p_brand").alias("text")).distinct()


# The same views for the SQL check; each is a list of common table expressions.
OFFERS_SQL = """
offers AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
         CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS offer_id,
         CAST(l_shipdate AS DATE) AS captured_on, s_name AS store, p_type AS category,
         'p/' || CAST(l_partkey AS VARCHAR) AS url, p_name AS name, p_brand AS brand,
         CASE WHEN l_quantity <= 45 THEN l_quantity / 10 END AS rating,
         l_extendedprice AS list_price,
         l_extendedprice * (1 - l_discount) AS store_price,
         CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount / 2) END AS partner_price,
         CASE WHEN l_linestatus <> 'O' THEN l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS other_price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

FILLED_SQL = OFFERS_SQL + """,
filled AS (
  SELECT * REPLACE (
    coalesce(partner_price, greatest(list_price, store_price, partner_price, other_price)) AS partner_price,
    coalesce(other_price, greatest(list_price, store_price, partner_price, other_price)) AS other_price)
  FROM offers)"""

BRANDS_SQL = """
brand_kinds AS (
  SELECT brand, CASE WHEN num <= 12 THEN 'equipment' ELSE 'accessory' END AS kind
  FROM (SELECT DISTINCT p_brand AS brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS num FROM part)
  WHERE num <= 20)"""
