"""Toxicity, chat formatting, WARC derivatives and URL reputation on small tables and against direct computations."""

import hashlib
import os
import random
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from vitrina.llm import catalog, chat, reputation, toxicity, warc

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")

# ---- toxicity


def labelled(spark):
    """Words of two families of stems; toxic texts hold some of a third, in ever new forms."""
    rng = random.Random(5)
    word = lambda stems: rng.choice(stems) + "".join(rng.choice("aeiou") + rng.choice("nrst") for _ in range(2))
    docs, labels = [], []
    for i in range(240):
        words = [word(["pal", "mon", "tir", "sel"]) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = word(["groxvu"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(900, None, "n"), (901, "", "n"), (902, " \n", "n"), (903, "ok " * 50_000, "n"), (0, docs[0][1], "x"), (None, "pal", "n")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_forms_are_known_by_their_stem(spark):
    docs, labels = labelled(spark)
    rows = toxicity.detect(docs, labels).collect()
    assert len(rows) == 246 and [*rows[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    mine = [r for r in rows if r.held_out and r.doc_id < 240]
    assert sum(r.predicted != (r.doc_id % 4 == 0) for r in mine) <= len(mine) // 20
    empty = [r.score for r in rows if r.doc_id in (900, 901, 902)]
    assert empty[0] == empty[1] == empty[2]


def test_accepted_keeps_all_columns_and_clean_rows(spark):
    docs, labels = labelled(spark)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {900, 901, 902, 903, None} <= ids and len(ids & set(range(0, 240, 4))) <= 6


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = labelled(spark)
    none = labels.filter("toxic = 1")
    assert {r.predicted for r in toxicity.detect(docs.limit(5), none).collect()} <= {0, 1}
    assert toxicity.detect(docs.limit(0), labels).count() == 0
    scores = {round(r.score, 9) for r in toxicity.detect(docs.limit(5), labels.limit(0)).collect()}
    assert max(scores) < 0.7


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({(r.doc_id, round(r.score, 9)) for r in toxicity.detect(docs, x).collect()} for x in (labels, turned))
    assert one == two


# ---- reply trees


def test_paths_of_random_trees(spark):
    rng = random.Random(3)
    n = 200
    parent = [None] + [rng.choice([i - 1, rng.randrange(i), None, 10_000]) for i in range(1, n)]
    score = [rng.choice([None, rng.random()]) for _ in range(n)]
    messages = spark.createDataFrame([(i, parent[i], score[i]) for i in range(n)], "id long, parent long, score double")

    def up(i):
        out = []
        while i is not None and i < n:
            out.append(i)
            i = parent[i]
        return out[::-1]

    best = {}
    for leaf in set(range(n)) - set(parent):
        path = up(leaf)
        best.setdefault(path[0], []).append((-sum(score[i] or 0 for i in path) / len(path), leaf))
    expected = {(leaf, root, k, i) for root, found in best.items() for _, leaf in sorted(found)[:2] for k, i in enumerate(up(leaf))}
    assert {tuple(r) for r in chat.paths(messages, 2).collect()} == expected


def test_a_cycle_is_an_error(spark):
    messages = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0)], "id long, parent long, score double")
    with pytest.raises(ValueError):
        chat.paths(messages)


def test_conversations_come_back_as_they_were(spark):
    said = ["</s>[INST] ok [/INST]", "<s>user\nx</s>", "a<\\b[\\", None, "", "ü\u2028\U0001f600" * 3, "[n \\[n"]
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["user", "assistant", None, "a\nb", "assistant", "<x", "assistant"], said))]
    rows += [(2, 0, "assistant", "twice"), (2, 0, "assistant", "twice"), (None, None, "user", "no number"), (4, 1, "assistant", "x" * 100_000)]
    rows += [(5, t, "assistant", f"{t},") for t in range(1100)]  # more than two chunks
    table = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, path string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_trees(chat.conversation_tree(table))).collect()}
    assert set(got) == {1, 2, None, 4, 5}
    for conv, r in got.items():
        mine = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    empty = table.limit(0)
    assert chat.read_back(chat.format_trees(chat.conversation_tree(empty))).count() == 0


# ---- URLs


def judged(spark, urls, rules=catalog.RULES):
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, bad int, host string")
    return [tuple(r)[1:] for r in reputation.judge(pages, rules).orderBy("page_id").collect()]


def test_rules_and_parts_of_urls(spark):
    assert judged(spark, [
        "http://WWW.Example.com/en/1?x#y", "https://m.example.com/en/", "https://example.com/fr/?a", "http://a.net/fr/#t", "http://a.net/fr",
        "http://com", "http://xcom/", None, "no scheme", "", "ftp://u@h:80?q/://", "a://b://c/d", "http://example.com/en"]) == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("m.example.com", "/en/", "example.com/en/", "block"),
        ("example.com", "/fr/", "com/", "allow"), ("a.net", "/fr/", "net/fr/", "block"), ("a.net", "/fr", None, "allow"),
        ("com", "", None, "allow"), ("xcom", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("u@h:80", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("example.com", "/en", "com/", "allow")]


def test_hosts_shrink_towards_their_domain(spark):
    rows = [(f"http://bad{i}.spam.org/", 1) for i in range(8) for _ in range(6)] + [(f"http://h{i}.fine.org/", 0) for i in range(8) for _ in range(6)]
    rows += [("http://new.spam.org/", None), ("http://new.fine.org/", None), ("http://one.fine.org/", 1)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    found = {r.host: r for r in reputation.host_reputation(pages, "url", "bad").collect()}
    assert found["new.spam.org"].rate > 0.6 > 0.4 > found["one.fine.org"].rate > found["new.fine.org"].rate
    assert found["bad0.spam.org"].bound > 0.5 > found["new.fine.org"].bound
    verdicts = {r.host: r.verdict for r in reputation.judge(pages, ()).collect()}
    assert verdicts["bad3.spam.org"] == "block" and verdicts["h3.fine.org"] == verdicts["one.fine.org"] == "allow"
    assert reputation.judge(pages.limit(0), ()).count() == 0


# ---- WARC


def test_records_refer_to_their_response(spark):
    page = "<html lang=de><meta charset='x'><title>A &amp; B</title><script>var t='</p>';</script><!-- <p>no -->" \
           "<p>One<br>two <b>three</b><a href='/l?a&amp;b' title=\"x>y\">four</a><style>p{}"
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nX: y", page, "k"), (2, None, None, "k"), (3, "u", "", "k"), (1, "http://a/\r\nX: y", page, "k"), (4, "v", "<p>" * 50_000 + "end", "k")],
        "page_id long, url string, html string, record string")
    made = warc.derive(warc.responses(pages, "2000-01-01T00:00:00Z"), info="<urn:uuid:info>").collect()
    assert len(made) == 10
    for r in made:
        headers, block = warc.read_record(bytes(r.record))
        assert headers["WARC-Type"] == r.warc_type and headers["WARC-Record-ID"] == r.record_id and headers["WARC-Refers-To"] == r.refers_to
        assert ("WARC-Target-URI" in headers) == (r.key != 2) and "X" not in headers
        if r.key == 1 and r.warc_type == "conversion":
            assert block.decode() == "One\ntwo threefour" and headers["WARC-Warcinfo-ID"] == "<urn:uuid:info>"
        if r.key == 1 and r.warc_type == "metadata":
            told = block.decode().split("\r\n")
            assert {"title: A & B", "language: de", "charset: x", "outlink: /l?a&b", "source-header-Content-Type: text/html",
                    f"source-payload-digest: {warc.digest(page.encode())}", f"source-length: {len(page)}"} <= set(told)
    assert len({r.record_id for r in made}) == 8
    assert warc.derive(warc.responses(pages.limit(0), "d")).count() == 0
    with pytest.raises(ValueError):
        warc.read_record(bytes(made[0].record)[:-5] + b"x\r\n\r\n")


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_sql(spark, name):
    with duckdb.connect() as con:
        for t in ("documents", "embeddings", "pages", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        expected = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    names = sorted(expected.columns)
    assert sorted(got.columns) == names
    plain = lambda df: sorted(str([None if x != x else x for x in row]) for row in df[names].itertuples(index=False, name=None))
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("unit", ["<a ", "<a href", "<html ", "<meta ", "<!", "<script ", "<title ", "<a \"", "<a '\"", "<", "<p title='"])
@pytest.mark.parametrize("closing", ["", ">"])
def test_broken_pages_take_linear_time(unit, closing):
    page = unit * (1_000_000 // len(unit)) + closing
    start = time.perf_counter()
    warc.read_page(page)
    assert time.perf_counter() - start < 10


def test_unclosed_parts_hide_the_rest_of_a_page():
    assert warc.read_page("<p>seen<script> a > b and < more").text == "seen"
    assert warc.read_page("<p>seen<!-- a > b and < more").text == "seen"
    assert warc.read_page("<p>seen</p>1 < 2 <!-- not this").text == "seen\n1 < 2"
    found = warc.read_page("<html lang=es><a href=/x>x</a><!-- <a href=/y> --><a title='<' href='/z'>z</a>")
    assert (found.language, found.links) == ("es", ["/x", "/z"])
