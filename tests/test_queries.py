"""A sample of the registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "mean_line", "clean_text", "parse_price", "trim_outliers", "box_stats_weekday", "kde", "profile_columns", "leader_groups",
    "recommend_hybrid", "compare_recommenders", "lexicon_polarity", "product_cards", "reviews_container_message", "reviews_paged_list", "reviews_nested", "stream_counts", "stream_dedupe", "lemmatise", "clean_text_lemmas",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def rows(frame):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    names = sorted(frame.columns)
    return names, sorted(str([clean(v) for v in row]) for row in frame[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        expected = con.execute(contract.oracle_sql()[name]).df()
    assert rows(contract.queries()[name](spark, DATA).toPandas()) == rows(expected)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert not contract.entry(spark).isEmpty()
