"""Near-dedup, mixing, packing, token files, vector search and the pipeline against brute force."""

import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vitrina.llm import mixing, mtree, packing, rptree, simhash, token_files, tokens
from vitrina.llm.base import components
from vitrina.llm.rans import Block, Table, encode

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


class Sets:
    """Smallest reachable member by plain union."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (300, None)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(30)]
    sets = Sets(range(500))
    for a, b in edges:
        if b is not None:
            sets.join(a, b)
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, sets.root(x)) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = BLANKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def texts(rng):
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = [None, "", " \t\n", "one", "One", "two words", "É x\x1cy É", "x " * 20_000]
    for _ in range(40):
        words = rng.choices(base, k=rng.randint(5, 200))
        out.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(base)
            out.append(" ".join(words))
    return out


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    found = texts(rng)
    rows = [(i, t, "f") for i, t in enumerate(found)] + [(3, "one", "f"), (None, "two words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = [plain_fingerprint(t) for t in found]
    sets = Sets(range(len(found)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    for tree_rows in (simhash.TREE_ROWS, 3):  # also with every shard cut into many trees
        monkeypatch.setattr(simhash, "TREE_ROWS", tree_rows)
        got = simhash.near_duplicates(docs, F.col("doc_id")).collect()
        assert len(got) == len(rows)
        for r in got:
            key = 5 if r.key is None else r.key
            assert (r.fp % (1 << 64), r.component) == (prints[key], sets.root(key))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({sets.root(i) for i in range(len(found))})
    assert simhash.near_duplicates(docs.limit(0), F.col("doc_id")).count() == simhash.keep_one(docs.limit(0)).count() == 0


def test_bk_trees_find_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    values = np.unique(rng.choice(centres, 600) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)))
    rng.shuffle(values)
    roots = np.zeros(len(values), int)
    parent, edge = simhash.grow(values, roots)
    assert parent[0] == -1 and all(np.bitwise_count(values[i] ^ values[parent[i]]) == edge[i] for i in range(1, len(values)))
    pairs = {(q, t) for qs, ts in simhash.search(values, parent, edge, values, roots, 4) for q, t in zip(qs.tolist(), ts.tolist())}
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= 4))))


# ---- mixing


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", "d", None]), 1.0) for i in range(900)]
    rows += [(5000, None, "a", 1.0), (5001, "", None, 1.0), (5002, "long " * 900, "e", 1.0), (None, "no key", "b", 1.0), (7, rows[7][1], rows[7][2], 1.0), (6000, " ", "void", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == {tuple(r) for r in mixing.mix(docs).collect()}
    names = sorted({s for *_, s, _ in rows if s}) + [None]
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] >= 2 * sizes[s]}
        if not more:
            break
        capped |= more
    of = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        source = of[r.doc_id, r["size"]]
        target = 2 * sizes[source] if source in capped else level * weight[source]
        assert r.source_size == sizes[source] and abs(r.target - target) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
    for s in names:
        target = 2 * sizes[s] if s in capped else level * weight[s]
        assert abs(taken[s] - target) <= max(3, 0.01 * target)
    often = mixing.mixed(docs)
    assert often.columns == docs.columns
    words = often.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in words if r.n} == {s: n for s, n in taken.items() if n}
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_one_very_long_document_leaves_no_gap(spark):
    rows = [(i * 1000 + j, "w " * (9_000 if j == 200 else 100), f"s{i}") for i in range(8) for j in range(201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1.0,), share=0.345)
    sums = got.groupBy((F.col("doc_id") / 1000).cast("int").alias("s"), "target").agg(F.sum("taken").alias("n")).collect()
    assert len(sums) == 8 and all(abs(r.n - r.target) <= 100 for r in sums)


# ---- tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_are_the_library_s(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    enc, library = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(6)
    bits = ["the", "Word", "É", "ß", "12", "3.5", "don't", "'S", "...", "$$$.", "日本", " ", "\x1c", "​", "é", "<|endoftext|>", "<|", "²", "İ", "Σ",
            "\x00", "\x7f", "½", "a.b", "x!", "(y),"]
    blanks = [" ", " ", " ", " ", "\n", "  ", " \n", "\n ", "\t", "\r\n", "", "\n\n", "\v"]
    cases = ["", " ", "\n", " a", "a ", "\na", "a\n", "  a"] + ["".join(rng.choice(bits) + rng.choice(blanks) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text in cases + cases[:50]:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert enc.encode(None) == b""


@pytest.mark.parametrize("name, blank", [("word_bpe_49k.json", ""), ("byte_bpe_50k.json", " ")])
def test_words_are_remembered_without_their_marks(name, blank):
    """A word costs one call of the merge model, whatever mark follows it."""
    enc = tokens.Encoder(public_tokenizers.path(name))
    text = " été. été, été; été! (été)"
    assert enc.encode(text) == enc.whole(text)
    assert set(enc) == {f"{blank}été", ".", ",", ";", "!", f"{blank}(", ")"} | {"été"}


def small_docs(spark):
    rng = random.Random(7)
    rows = [(i * 7 % 50, " ".join(rng.choices(["alpha", "beta", "gamma.", "Delta,", "xyz"], k=rng.randint(0, 900))), "k") for i in range(50)]
    rows += [(100, None, "k"), (101, "", "k"), (None, "no key", "k"), (3, "again", "k"), (3, "again", "k"), (102, "many words " * 20_000, "k")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_pieces_cover_every_id_once(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows, docs = small_docs(spark)
    expected = sorted(((i is None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows))
    for shard in (packing.SHARD_TOKENS, 9000):
        monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
        pieces = packing.pack(docs, path, end_id=2).collect()
        by_sequence, by_doc = {}, {}
        for p in pieces:
            by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
            by_doc.setdefault((p.doc_id is None, p.doc_id or 0), []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist(), p.doc_tokens, p.length))
        for found in by_sequence.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at and length > 0
                at += length
            assert at <= 4096 and at & (at - 1) == 0
        for (absent, i), found in by_doc.items():
            whole = [ids for a, k, ids in expected if (a, k) == (absent, i)]
            assert all(len(ids) == length for _, ids, _, length in found)
            if len(whole) == 1:
                assert sum((ids for _, ids, _, _ in sorted(found)), []) == whole[0]
            assert sum(length for *_, length in found) == sum(map(len, whole))
        assert sum(p.length for p in pieces) == sum(len(ids) for *_, ids in expected)
    assert packing.pack(docs.limit(0), path, end_id=2).count() == 0


def test_index_finds_the_related_document():
    rng = np.random.default_rng(8)
    docs = [rng.integers(10, 2000, 200).astype("<u2") for _ in range(30)]
    docs[17] = np.concatenate([docs[4][:150], rng.integers(10, 2000, 50).astype("<u2")])
    counts = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=2000)
    idf = np.log1p((30 - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    index = packing.Index(docs, idf, 200.0)
    free = np.ones(30, bool)
    free[4] = False
    assert index.neighbours(4, free)[0] == 17
    free[17] = False
    assert 17 not in index.neighbours(4, free)


@pytest.mark.parametrize("terms", [40, 3000])
def test_neighbours_equal_plain_bm25_over_all_terms(terms):
    rng = np.random.default_rng(terms)
    docs = [np.minimum(rng.zipf(1.2, rng.integers(1, 400)), terms - 1).astype("<u2") for _ in range(400)] + [np.array([2], "<u2")]
    docs[50] = docs[51] = docs[52]  # ties
    n, mean = len(docs), float(np.mean([len(d) for d in docs]))
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=terms)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = packing.Index(docs, idf, mean)
    counts = [dict(zip(*(x.tolist() for x in packing.term_counts(d)))) for d in docs]

    def score(q, d):
        norm = packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)
        return sum(float(idf[t]) * counts[d][t] * (packing.K1 + 1) / (counts[d][t] + norm) for t in counts[q] if t in counts[d])

    for seed in (0, 51, 123, n - 1):
        free = rng.random(n) < 0.8
        free[seed] = False
        plain = {d: score(seed, d) for d in np.flatnonzero(free).tolist()}
        found = index.neighbours(seed, free).tolist()
        assert sorted(found) == [d for d, x in plain.items() if x > 0]
        assert [plain[d] for d in found] == pytest.approx(sorted((x for x in plain.values() if x > 0), reverse=True), abs=1e-3)
        copies = [d for d in found if d in (50, 51, 52)]
        assert copies == sorted(copies)


def test_blocks_round_trip_from_every_checkpoint():
    rng = np.random.default_rng(9)
    for n in (0, 1, 63, 64, 5000, 400_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype("<u2")
        table = Table.of(np.bincount(ids, minlength=50_257))
        data = encode(ids, table, np.array([5, 0]), np.array([n, 0]), np.array([False, True]))
        block = Block.read(data, table)
        assert (block.ids() == ids).all() and block.docs.tolist() == [5, 0] and block.absent.tolist() == [False, True]
        for k in range(len(block.checks)):
            start = block.checks[k][0] * block.lanes
            assert (block.ids(k) == ids[start:]).all()
            if k:
                assert (block.ids(k - 1, k) == ids[block.checks[k - 1][0] * block.lanes : start]).all()
    broken = bytearray(data)
    broken[-3] ^= 1
    for bad in (bytes(broken), data[:20], data[:-1]):
        with pytest.raises(ValueError):
            Block.read(bad, table)
    with pytest.raises(ValueError):
        encode(np.array([3]), Table.of(np.array([1, 0, 0, 0])), np.array([1]), np.array([1]), np.array([False]))


def test_files_hold_all_ids_in_order(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows, docs = small_docs(spark)
    token_files.write(docs, str(tmp_path / "files"), path, end_id=2, block_tokens=3000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, str(tmp_path / "files")).collect())
    raw = [(i is not None, i or 0, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t, _ in rows]
    raw.sort(key=lambda x: x[:2])
    at = 0
    for (start, doc, n, crc), (known, i, ids) in zip(got, raw, strict=True):
        assert (start, doc) == (at, i if known else None)
        if doc != 3:
            assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert at == sum(len(ids) for *_, ids in raw)
    (tmp_path / "moved").mkdir()
    (tmp_path / "files").rename(tmp_path / "moved" / "files")
    moved = token_files.read(spark, str(tmp_path / "moved" / "files"))
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in moved.collect()) == got
    token_files.write(docs.limit(0), str(tmp_path / "none"), path, end_id=2)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
    other = spark.createDataFrame([(3, 1 << 20)], "id long, freq long")
    other.write.mode("overwrite").parquet(str(tmp_path / "moved" / "files" / "table"))
    with pytest.raises(ValueError):
        token_files.read(spark, str(tmp_path / "moved" / "files"))


# ---- vectors


def vectors(rng, n=600):
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.01, 0.05, 1.0])).tolist(), int(rng.integers(3)), "c") for i in range(n)]
    rows += [(n + i, rows[5][1], rows[5][2], "c") for i in range(9)] + [(5, rows[5][1], rows[5][2], "c")]
    odd = [None, [], [None] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [0.0] * 16]
    rows += [(2000 + i, v, 1, "c") for i, v in enumerate(odd)] + [(3000, rows[5][1], None, "c"), (3001, [1.0, 2.0], 1, "c"), (3002, [1.0, 2.0], 1, "c"), (3003, [2.0, -1.0], 1, "c")]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def test_forest_equals_brute_force(spark, monkeypatch):
    rows = vectors(np.random.default_rng(10))
    table = spark.createDataFrame(rows, SCHEMA)
    usable = [i for i, (_, v, label, _) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, sets = [0] * len(rows), Sets(range(len(rows)))
    data = {i: np.array(rows[i][1], np.float32).astype(float) for i in usable}
    for i in usable:
        for j in usable:
            if i != j and rows[i][2] == rows[j][2] and len(data[i]) == len(data[j]):
                if data[i] @ data[j] / np.linalg.norm(data[i]) / np.linalg.norm(data[j]) >= 0.98:
                    links[i] += 1
                    sets.join(i, j)
    least = {}
    for i in range(len(rows)):
        least[sets.root(i)] = min(least.get(sets.root(i), rows[i][0]), rows[i][0])
    expected = sorted((rows[i][0], links[i], least[sets.root(i)], rows[i][0] == least[sets.root(i)]) for i in range(len(rows)))
    for leaf, block in ((rptree.LEAF_ROWS, rptree.BLOCK), (16, 8)):  # also with deep trees and every leaf in blocks
        monkeypatch.setattr(rptree, "LEAF_ROWS", leaf)
        monkeypatch.setattr(rptree, "BLOCK", block)
        assert sorted(map(tuple, rptree.near_duplicates(table).collect())) == expected
    assert rptree.near_duplicates(table.limit(0)).count() == 0


def test_m_trees_are_exact(spark, monkeypatch):
    rows = vectors(np.random.default_rng(11))
    table = spark.createDataFrame(rows, SCHEMA)
    data = {}
    for i, v, *_ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            data.setdefault((i, tuple(v)), np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64))
    expected = set()
    for (i, _), q in data.items():
        if i % 5 == 0:
            scores = sorted((-int(q @ x), j) for (j, _), x in data.items() if j != i and len(x) == len(q))[:5]
            expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)}
    for shard, page in ((mtree.SHARD_ROWS, mtree.PAGE_ROWS), (100, 4)):
        monkeypatch.setattr(mtree, "SHARD_ROWS", shard)
        monkeypatch.setattr(mtree, "PAGE_ROWS", page)
        assert {tuple(r) for r in mtree.top_k(table, every=5, k=5).collect()} == expected
    assert mtree.top_k(table.limit(0), every=5, k=5).count() == 0


# ---- pipeline


@needs_data
def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, DATA)
    kept = corpus_pipeline.drop_near_copies(spark, clean, DATA)
    assert clean.columns == kept.columns == docs.columns
    prints = {r.doc_id: plain_fingerprint(r.text) for r in clean.collect()}
    sets = Sets(prints)
    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and (a ^ b).bit_count() <= 4:
                sets.join(i, j)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({sets.root(i) for i in prints})
    mixed = corpus_pipeline.mix_sources(spark, kept, DATA)
    taken = {r.doc_id: r.taken for r in mixing.mix(kept).collect()}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()} == {i: n for i, n in taken.items() if n}
    pieces = corpus_pipeline.run(spark, DATA)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert pieces.agg(F.sum("length")).first()[0] == expected


def test_stages_stand_odd_tables(spark):
    """Null keys, empty tables and columns with the operators' own names."""
    said = "one two three four five six"
    rows = [(None, said, None, "s"), (1, said, "a", "s"), (1, said, "a", "s"), (2, None, None, "t"), (3, "", "a", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    for table in (docs, docs.limit(0)):
        kept = corpus_pipeline.drop_near_copies(spark, table, None)
        mixed = corpus_pipeline.mix_sources(spark, kept, None)
        pieces = corpus_pipeline.pack_sequences(spark, mixed, None)
        assert kept.columns == mixed.columns == docs.columns
        assert kept.count() == (2 if table is docs else 0)  # the texts with words, and those without
        assert pieces.filter("doc_id = 1").isEmpty() == (table is not docs)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cuts_at_blanks_and_marks_are_the_pieces(name):
    """Short texts of all that decides on the cuts, each with an encoder that has to find their pieces anew."""
    enc, library = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(5)
    parts = ["Ab", "né", "7", "42", " ", "\n", "\t", ".", ",", "!", "$", "-", "'s", "'t", "'", "(", ")", "\x01"]
    for weights in (np.ones(len(parts)), np.array([9, 9, 1, 1, 9, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0])):
        for picks in rng.choice(len(parts), (1500, 12), p=weights / weights.sum()):
            text = "".join(parts[i] for i in picks)
            assert [p for c in enc.pieces(text) for p in tokens._KINDS[enc.kind].findall(c)] == tokens._KINDS[enc.kind].findall(
                text.lower() if enc.kind == "word" else text), repr(text)
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_remembered_chunks_are_freed():
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    before = enc.encode("a few words")
    enc.older = dict(enc)
    tokens.forget()
    assert not enc and not enc.older and enc.encode("a few words") == before


def test_queries_go_through_a_tree_together():
    rng = np.random.default_rng(8)
    vectors = np.unique(rng.integers(-9, 9, size=(700, 4)), axis=0)
    ids = [[int(i), 10_000 + int(i)] if i % 5 == 0 else [int(i)] for i in range(len(vectors))]
    tree = mtree.build(vectors, ids, float((vectors.astype(float) ** 2).sum(1).max()))
    own = np.array([0, 1, 5, 999_999])
    line, vec_id, score = mtree.search(tree, vectors[[0, 1, 5, 7]], own, 4)
    for i, at in enumerate((0, 1, 5, 7)):
        pairs = [(-int(vectors[j] @ vectors[at]), v) for j, group in enumerate(ids) for v in group if v != own[i]]
        assert [(-s, v) for s, v in zip(score[line == i].tolist(), vec_id[line == i].tolist())] == sorted(pairs)[:4]
