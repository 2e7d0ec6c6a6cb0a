import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from vitrina.plans import source_queries
from vitrina.plans.registry import QUERIES
from vitrina.schemas import MISSING_FIELD, NO_COMMENT, NO_SCORE, RAW_OFFER_COLUMNS, RAW_OFFERS, STATUS_PROPERTY, UNAVAILABLE
from vitrina.sources import delimited, html, resume
from vitrina.streaming import offers as streams


def test_read_offers_csv_with_both_dialects_and_a_bad_file(spark, tmp_path):
    header, row = list(RAW_OFFER_COLUMNS), [f"v{i}" for i in range(13)]
    (tmp_path / "a.csv").write_bytes((",".join(header) + "\n" + ",".join(["señal", *row[1:]]) + "\n").encode("latin-1"))
    (tmp_path / "b.csv").write_bytes((";".join(header) + "\n" + ";".join(["señal", *row[1:]]) + "\n").encode("utf-8"))
    (tmp_path / "c.csv").write_text("x|y\n1|2\n")
    rows, bad = delimited.read_offers_csv(spark, str(tmp_path))
    assert [r["captured_on"] for r in rows.collect()] == ["señal", "señal"]
    assert [r["file"].rsplit("/", 1)[1] for r in bad.collect()] == ["c.csv"]


def test_specification_pages(spark):
    table = ('<table><tbody class="tabla-especificaciones"><tr class="fila-especificacion"><div class="contenedor-caracteristica"> RAM </div>'
             '<span class="valor-caracteristica">8 GB</span></tr><tr class="fila-especificacion"><p></tr></tbody></table>')
    pages = spark.createDataFrame([("s", "1", "n", table), ("s", "2", "n", "<p>nada"), ("s", "3", "n", "Publicación pausada" + table)], "store string, url string, name string, html string")
    found = [(r["url"], r["property"], r["value"]) for r in html.specifications(pages).orderBy("url", "property").collect()]
    gone = (STATUS_PROPERTY, UNAVAILABLE)
    assert found == [("1", *gone), ("1", "RAM", "8 GB"), ("2", *gone), ("3", *gone)]


def test_review_pages_keep_every_url(spark):
    review = '<div data-fs-reviews-container="true">{}</div>'
    message = '<div data-fs-review-message="true"> Muy, <b>bueno</b>. </div>'
    page = review.format(message) + review.format("") + review.format(message)
    pages = spark.createDataFrame([("s", "1", "n", "container_message", page), ("s", "2", "n", "paged_list", ""), ("s", "3", "n", "unknown", page)],
                                  "store string, url string, name string, layout string, html string")
    found = [(r["url"], r["score"], r["comment"]) for r in html.page_reviews(pages).orderBy("url", F.desc("comment")).collect()]
    assert found == [("1", NO_SCORE, NO_COMMENT), ("1", NO_SCORE, "Muybueno"), ("2", NO_SCORE, NO_COMMENT), ("3", NO_SCORE, NO_COMMENT)]


def test_pages_of_a_url_are_one_listing(spark):
    listing = '<div id="yotpo-reviews-container">{}</div>'
    review = '<div class="yotpo-review"><p class="yotpo-read-more-text">{}</p></div>'
    score = '<b class="yotpo-bottom-line-left-panel yotpo-bottom-line-score">4,5</b>'
    nested = '<i class="_numerator_7vdzo_22">3.9</i><div class="_review-text_xpeer_69"><div class="_review-text_16yc3_2">Muy <b>bien</b></div></div>'
    pages = [
        ("s", "1", "n", "paged_list", score + listing.format(review.format("uno") + '<div class="yotpo-review"></div>')),
        ("s", "1", "n", "paged_list", listing.format(review.format("dos"))), ("s", "1", "n", "paged_list", listing.format("")),
        ("s", "2", "n", "paged_list", score), ("s", "2", "n", "paged_list", ""), ("s", None, None, "nested", nested), ("s", "4", "n", "nested", "")]
    found = html.page_reviews(spark.createDataFrame(pages, "store string, url string, name string, layout string, html string")).collect()
    assert sorted((r["url"] or "", r["score"], r["comment"]) for r in found) == [
        ("", "3.9", "Muybien"), ("1", "45", "dos"), ("1", "45", NO_COMMENT), ("1", "45", "uno"), ("2", "45", NO_COMMENT), ("4", NO_SCORE, NO_COMMENT)]


def test_product_cards_mark_missing_fields(spark):
    page = '<div class="product-item"><a class="product-link" href="/x">y</a><h3 class="product-title"> TV </h3></div>'
    found = html.product_cards(spark.createDataFrame([("2025-01-01", "s", "c", page)], "captured_on string, store string, category string, html string")).first()
    assert found["url"] == "/x" and found["name"] == "TV" and found["list_price"] == MISSING_FIELD and tuple(found.asDict()) == RAW_OFFER_COLUMNS


def test_selectors():
    root = html._Tree('<div id="a"><p class="x y">1<b>2</b></p></div><p data-k="v">3').root
    texts = lambda s: ["".join(n.texts()) for n in html.select(root, s)]
    assert texts("p") == ["12", "3"] and texts("#a > p.y") == ["12"] and texts("div b") == ["2"] and texts("div > b") == [] and texts('[data-k="v"]') == ["3"]


def test_resume(spark):
    rows = spark.range(250).withColumnRenamed("id", "position")
    saved = resume.next_checkpoint(rows, 100)
    assert resume.resume_by_position(rows, saved).count() == 50
    assert resume.resume_by_position(rows, saved.limit(0)).count() == 250


def test_stream_clean_equals_batch(spark, tmp_path):
    good = ["15/12/2024", "s", "Celular", "u", "Na", "n", "b", "v", "4.5", "1.000", "Na", "Na", "2.000"]
    rows = spark.createDataFrame([good, [*good[:5], None, *good[6:]]], RAW_OFFERS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_files(spark, str(tmp_path / "in"), RAW_OFFERS)
    streams.stream_clean(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "ok")).drop("batch").collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in streams.clean_raw(rows.filter("name IS NOT NULL")).collect()]
    assert found[0]["store_price"] == 2000.0 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    # A second run over the same folder finds nothing new.
    streams.stream_clean(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1


def test_stream_once_remembers_all_earlier_runs(spark, tmp_path):
    def run(number, rows):
        spark.createDataFrame(rows, "url string, n int, at timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        streams.stream_once(stream, ["url"], ["at"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r["url"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    day = lambda d: datetime.datetime(2024, 1, d)
    one = {("a", 1), (None, 4)}
    assert run(0, [("a", 2, day(2)), ("a", 1, day(1)), (None, 4, day(1)), (None, 5, day(1))]) == one
    # a month later and with an earlier time: the key stays as it was
    assert run(1, [("a", 9, day(31)), (None, 0, day(1)), ("b", 3, day(31))]) == {*one, ("b", 3)}
    assert run(2, [("a", 9, day(31)), ("b", 9, day(30))]) == {*one, ("b", 3)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_stream_dedupe_forgets_keys_beyond_the_delay(spark, tmp_path):
    for number in range(6):
        rows = [(f"u{number}-{i}", datetime.datetime(2024, 1, 1 + 3 * number, 0, i)) for i in range(20)] * 2
        spark.createDataFrame(rows, "url string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], "url string, at timestamp").schema)
        run = streams.stream_dedupe(stream, ["url"], "at").writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert sum(s["numRowsTotal"] for p in run.recentProgress[-1:] for s in p["stateOperators"]) <= 40
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120


def test_product_pages_are_parsed_on_all_cores(spark, tmp_path):
    """A small file of products makes large pages: they do not stay in the one partition of the scan."""
    rows = [(i, f"part {i}", "Brand#1", "SMALL", i % 30) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["specifications"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.select("url").distinct().count() == 200


def test_a_task_holds_the_rows_of_few_pages():
    pages = ["x" * html.PAGE_LETTERS, None, "y", "z" * html.PAGE_LETTERS, "w"]
    parts = [pages[part] for part in html._parts(pages)]
    assert sum(parts, []) == pages and all(sum(len(p or "") for p in part) <= html.PAGE_LETTERS + 1 for part in parts)
    assert html._parts([]) == [slice(0, 0)]


def test_rows_of_a_file_are_not_shuffled_for_its_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(RAW_OFFER_COLUMNS) + "\n" + ",".join("x" * 13) + "\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = delimited.read_offers_csv(spark, str(tmp_path))
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_items_are_not_sorted_for_their_offers(spark, tmp_path, monkeypatch):
    from vitrina.plans import bindings
    monkeypatch.setattr(bindings, "BROADCAST_ROWS", 1)
    tables = {
        "lineitem": "1L l_orderkey, 1 l_linenumber, id l_partkey, 3L l_suppkey, timestamp'2024-01-01' l_shipdate, 5.0D l_quantity, 2.0D l_extendedprice, "
                    "0.0D l_discount, 0.0D l_tax, 'N' l_returnflag, 'O' l_linestatus",
        "part": "id p_partkey, 'n' p_name, 'b' p_brand, 't' p_type", "supplier": "3L s_suppkey, 's' s_name"}
    for name, columns in tables.items():
        spark.range(1 if name == "supplier" else 2).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = bindings.offers(spark, str(tmp_path))
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ingest_batch_deals_its_files_without_a_task_for_each(spark, tmp_path, monkeypatch):
    """Eight tasks of line items give more parts than files; four files and the broken one are counted."""

    def save(rows, schema, name, n=1):
        spark.createDataFrame(rows, schema).repartition(n).write.parquet(f"{tmp_path}/{name}.parquet")

    day = datetime.datetime(2025, 1, 2)
    save([(1, "bolt", "Brand#1", "TYPE"), (2, "nut, big", "Brand#2", "TYPE")], "p_partkey long, p_name string, p_brand string, p_type string", "part")
    save([(1, "store one"), (2, "store two")], "s_suppkey long, s_name string", "supplier")
    save([(i, i % 2 + 1, i % 2 + 1, 1, float(i % 50), 10.0 + i, 0.1, 0.0, "N", "F", day) for i in range(400)],
         "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, l_shipdate timestamp", "lineitem", 8)
    folders = []
    make = source_queries.scratch_path
    monkeypatch.setattr(source_queries, "scratch_path", lambda *args: folders.append(make(*args)) or folders[-1])
    found = QUERIES["ingest_batch"](spark, str(tmp_path)).first().asDict()
    assert found == {"input_rows": 400, "valid_rows": 400, "quarantined_rows": 0, "duplicate_rows": 398, "column_count": 13,
                     "files": 5, "read_files": 4, "unread_files": 1}
    parts = [p for p in pathlib.Path(folders[0]).rglob("*.csv") if "broken" not in str(p)]
    assert len(parts) > 4


def test_compressed_offer_files_are_read_like_plain_ones(spark, tmp_path):
    rows = [tuple(f"{c} {i}, ñ" for c in RAW_OFFERS.names) for i in range(3)]
    df = spark.createDataFrame(rows, RAW_OFFERS)
    df.filter("seller = 'seller 0, ñ'").write.csv(str(tmp_path / "plain"), header=True, encoding="ISO-8859-1", escape='"')
    df.filter("seller <> 'seller 0, ñ'").write.csv(str(tmp_path / "small"), header=True, sep=";", escape='"', compression="gzip")
    df.select("store").write.csv(str(tmp_path / "broken"), header=True, compression="gzip")
    found, bad = delimited.read_offers_csv(spark, f"{tmp_path}/*")
    assert sorted(tuple(r[c] for c in RAW_OFFERS.names) for r in found.collect()) == rows
    assert all("/broken/" in r["file"] for r in bad.collect()) and not bad.isEmpty()


def test_offer_files_take_less_disk_than_their_text(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "offers")
    monkeypatch.setattr(source_queries, "scratch_path", lambda _, name: f"{folder}/{name}")
    text = ["some text of an offer, and its price"] * 13
    raw = spark.range(2000).select(*[F.lit(v).alias(c) for c, v in zip(RAW_OFFERS.names, text)])
    monkeypatch.setattr(source_queries, "_raw_offers", lambda *args: raw)
    rows, _ = delimited.read_offers_csv(spark, source_queries._write_dialects(spark, ""))
    assert rows.count() == 2000
    assert sum(p.stat().st_size for p in (tmp_path / "offers").rglob("part-*")) < 2000 * len(",".join(text)) / 10
