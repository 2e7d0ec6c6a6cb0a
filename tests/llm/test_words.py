"""Spelling variants, sharding and lexical search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitrina.llm import lexical, sharding, variants

# ---- spelling variants


def plain_variants(rows):
    counts = Counter()
    for key, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % variants.THINNED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(others, default=None)
        out[w] = [n, len(others), *((best[1], -best[0]) if best and -best[0] >= 5 * n else (None, None))]

    def root(w):
        return root(out[w][2]) if out[w][2] else w

    return {(w, f, root(w), n, k, m) for w, (n, k, f, m) in out.items()}


@pytest.mark.parametrize("hot", [variants.HOT_WORDS, 1])
def test_variants_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(variants, "HOT_WORDS", hot)  # also with every shared reduced form joined by left-out letters
    monkeypatch.setattr(variants, "THINNED", 7)
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdeéñ", k=rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abcabc", "bcabca"]
    pool = list(base)
    for w in base:
        for _ in range(3):
            at = rng.randrange(len(w))
            pool.append(w[:at] + rng.choice(["", "x", "÷", w[at] * 2]) + w[at + 1 :])
    weights = [rng.choice([1, 1, 5, 30, 160]) for _ in pool]
    rows = [(i, " ".join(rng.choices(pool, weights, k=60))) for i in range(200)]
    rows += [(None, "ABCABC É" * 6), (1, None), (2, ""), (3, "1 2"), (rows[0]), (9, "Zürich-zürich " * 4000)]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(docs).collect()}
    expected = plain_variants(rows)
    assert got == expected
    assert sum(w[1] is not None and w[1] != w[2] for w in expected) > 0  # some ways are longer than one step
    assert variants.group_variants(docs.limit(0)).count() == 0


def test_roots_follow_long_ways(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {tuple(r) for r in variants._roots(forms).collect()} == {(f"w{i}", "w21") for i in range(21)}


# ---- sharding


def sharded(spark, docs, folder, n=8):
    got = sharding.write_shards(docs, str(folder), n)
    shard, slot = [c for c in got.columns if c not in docs.columns][::-1]
    by = {}
    for r in got.collect():
        by.setdefault(r[shard], []).append((r[slot], tuple(r[c] for c in docs.columns)))
    return {s: [x for _, x in sorted(rows, key=lambda y: y[0])] for s, rows in by.items() if [y for y, _ in sorted((a, 0) for a, _ in rows)] == list(range(len(rows)))}, got


@pytest.mark.parametrize("bucket", [sharding.BUCKET_BYTES, 3000])
def test_shards_hold_every_row_once(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", bucket)
    rows = [(i, f"text {i}", i) for i in range(300)] + [(None, None, 0), (7, "", 1), (8, "x" * 100_000, 2)] + [(5, "same", 3)] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    shards, got = sharded(spark, docs, tmp_path / "a")
    assert got.columns == [*docs.columns, "slot_", "shard"]
    assert sorted(shards) == list(range(8)) and {len(s) for s in shards.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    assert Counter(x for s in shards.values() for x in s) == Counter(rows)
    same = [sum(x[1] == "same" for x in s) for s in shards.values()]
    assert max(same) < 45  # 150 of 453 rows alike: 19 a shard, if the order is random
    ids = [x[0] for s in sorted(shards) for x in shards[s] if x[0] is not None and x[1] != "same"]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.65 * len(ids)


def test_shards_of_files_repeat_and_few_rows_fit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 3000)
    spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit(1).alias("_metadata")).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    first, _ = sharded(spark, docs, tmp_path / "a")
    again, _ = sharded(spark, docs, tmp_path / "b")
    assert first == again and sum(map(len, first.values())) == 500
    few, _ = sharded(spark, docs.limit(3), tmp_path / "c")
    assert sorted(map(len, few.values())) == [1, 1, 1]
    assert sharded(spark, docs.limit(0), tmp_path / "d")[1].count() == 0


# ---- lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * c.total() * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + ((x[2],) if x[2] is not None else ()))[:k])}
    return out


@pytest.mark.parametrize("block,width", [(lexical.BLOCK_ROWS, lexical.SPARSITY), (3, 1)])
def test_search_equals_brute_force(spark, monkeypatch, block, width):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", block)
    monkeypatch.setattr(lexical, "SPARSITY", width)  # also with sketches that tell terms apart badly
    monkeypatch.setattr(lexical, "LEAST_WIDTH", 8)
    rng = random.Random(6)
    words = ["w%d" % int(300 * rng.random() ** 3) for _ in range(2000)] + ["É", "ß9", "_x_", "A\x7fB", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "... ;"), (None, "w1 w2"), (docs[0]), (1003, "w0 " * 50_000 + "É"), (1004, "é É日本")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(20)]
    items += [(100, None), (101, "unheard of"), (102, "w0 w0 W0,w0"), (103, "--"), items[0], (104, "A\x7fB")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    index = lexical.build_index(table)
    for k in (20, 3):
        got = [tuple(r) for r in lexical.top_k(index, asked, k=k).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_search(docs, items, k)
    assert lexical.top_k(index, asked.limit(0)).count() == lexical.top_k(lexical.build_index(table.limit(0)), asked).count() == 0


def test_equal_scores_go_by_key(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(50, 0, -1)] + [(99, "other")], "doc_id long, text string")
    got = lexical.top_k(lexical.build_index(docs), spark.createDataFrame([(1, "alpha")], "item_id long, text string"), k=20).collect()
    assert [(r["rank"], r["key"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 21)]
