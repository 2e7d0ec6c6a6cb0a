"""The letter models of toxicity against a plain Kneser-Ney recursion, and the labelled sample against sorting."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.llm import toxicity


def plain_ratio(word, counts, shared):
    """Log of toxic over ordinary likelihood of a word, letter by letter, by recursion over ever shorter histories."""

    def chance(toxic, gram):
        if len(gram) == toxicity.SHARED_ORDER:
            return shared(gram)
        below = chance(toxic, gram[1:])
        after = {g: n for g, n in counts[toxic, len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return below
        return max(after.get(gram, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(after) / total * below

    edged, out = f"\n{word}\n", 0.0
    for i in range(2, len(edged) + 1):
        gram = edged[max(0, i - toxicity.ORDER) : i]
        out += math.log(chance(1, gram)) - math.log(chance(0, gram))
    return out


def test_word_ratios_equal_plain_kneser_ney(spark):
    rng = random.Random(3)
    lexicon = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(lexicon[:40] if i % 3 else lexicon[20:], k=12))) for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, marked)
    fitted = [(r.key, r.toxic) for r in toxicity.labelled_sample(marked, "doc_id", "toxic").filter("fit").collect()]
    texts, said = dict(docs), defaultdict(Counter)
    for key, toxic in fitted:
        said[toxic].update(set(texts[key].split()))
    counts = {}
    for toxic in (0, 1):
        for order in range(toxicity.SHARED_ORDER + 1, toxicity.ORDER + 1):
            found, before = Counter(), set()
            for word, n in said[toxic].items():
                edged = f"\n{word}\n"
                for i in range(len(edged) - order + 1):
                    gram = edged[i : i + order]
                    if order == toxicity.ORDER:
                        found[gram] += n
                    elif i == 0:
                        found[gram] += 1
                    else:
                        before.add(edged[i - 1 : i + order])
            found.update(g[1:] for g in before)
            counts[toxic, order] = found
    letters = model.letters
    pairs = toxicity.pair_probability(toxicity.shared_pairs(table, letters)).reshape(letters.base, letters.base)
    number = {"\n": 0} | {chr(c): i + 2 for i, c in enumerate(letters.listed.tolist())}
    words = [*lexicon, "abc", "ébda", "aaaaaaaaaa", "d"]
    expected = [plain_ratio(w, counts, lambda g: pairs[number[g[0]], number[g[1]]]) for w in words]
    assert np.allclose(model.word_ratios(words), expected, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", [40, 4000])
def test_sample_takes_the_smallest_hashes(spark, monkeypatch, rows):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 30)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    labels = spark.range(rows).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    got = {(r.key, r.toxic, r.fit) for r in toxicity.labelled_sample(labels, "doc_id", "toxic").collect()}
    parts = defaultdict(list)
    for r in labels.filter(~toxicity.held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.lit("labelled"), "doc_id")).collect():
        parts[r.toxic, r.h % 3 != 2].append((r.h, r.doc_id))
    assert got == {(k, toxic, fit) for (toxic, fit), of in parts.items() for _, k in sorted(of)[: 30 if fit else 20]}
    assert toxicity.labelled_sample(labels.limit(0), "doc_id", "toxic").count() == 0
