import datetime
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrina.functions import text
from vitrina.functions.similarity import indel_ratios
from vitrina.operators import (
    decompose, density, embeddings, features, kmeans, lda, lookup, matching, profile, quality, quantiles, recommend, reviews, series, stats, topics)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(2)] + [("one", 5.0), ("few", 1.0), ("few", 2.0), ("few", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r["g"], r["prob"]): r["quantile"] for r in quantiles.exact_quantiles(df, "v", (0.01, 0.25, 0.5, 0.99), ["g"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for (g, p), value in found.items():
        assert value == pytest.approx(pdf[pdf.g == g].v.quantile(p))
    assert len(found) == 12


def test_trim_outliers_is_sequential(spark):
    rng = random.Random(3)
    pdf = pd.DataFrame({"list_price": [rng.random() for _ in range(500)], "store_price": [rng.random() for _ in range(500)]})
    found = quality.trim_outliers(spark.createDataFrame(pdf), ["list_price", "store_price"], 0.05, 0.9).toPandas()
    for c in ("list_price", "store_price"):
        pdf = pdf[(pdf[c] >= pdf[c].quantile(0.05)) & (pdf[c] <= pdf[c].quantile(0.9))]
    assert sorted(found.list_price) == sorted(pdf.list_price)


def test_split_valid_rows(spark):
    full = spark.createDataFrame([("a", "Na"), ("b", None)], "x string, y string")
    valid, bad = quality.split_valid_rows(full, ["x", "y"])
    assert [r["x"] for r in valid.collect()] == ["a"] and [r["x"] for r in bad.collect()] == ["b"]
    valid, bad = quality.split_valid_rows(full, ["x", "y", "z"])
    assert valid.count() == 0 and bad.count() == 2


def test_campaign_rows(spark):
    d = datetime.date
    rows = [(d(2024, 12, 15), 100000.0), (d(2023, 12, 15), 100001.0), (d(2024, 12, 14), 200000.0), (d(2025, 3, 1), 200000.0)]
    df = spark.createDataFrame([(a, p, None, None, None) for a, p in rows],
                               "captured_on date, list_price double, store_price double, partner_price double, other_price double")
    assert [r[0] for r in quality.select_campaign_rows(df).collect()] == [d(2023, 12, 15), d(2025, 3, 1)]


def test_drop_top_n(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(4)], "offer_id string, list_price double")
    assert [r[1] for r in quality.drop_top_n(df).collect()] == [0.0]


def test_impute_and_attach_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "category string, rating double")
    found = sorted((r["category"], r["rating"] or -1) for r in stats.impute_group_mean(df).collect())
    assert found == [("a", 1.0), ("a", 1.0), ("b", -1)]


def test_brand_join_duplicate_policies(spark):
    offers = spark.createDataFrame([("A",), ("B",)], "brand string")
    brands = spark.createDataFrame([("A", "x"), ("A", "y")], "brand string, kind string")
    assert lookup.join_brand_kind(offers, brands).count() == 3
    assert lookup.join_brand_kind(offers, brands, on_duplicate="first").count() == 2
    with pytest.raises(ValueError):
        lookup.join_brand_kind(offers, brands, on_duplicate="fail")


def _ratio(a, b):
    return indel_ratios([a], [b])[0]


def _greedy(items, threshold, max_gap, last):
    """The sequential pass: item -> leader."""
    like = lambda i, j: _ratio(items[i][1], items[j][1]) >= threshold and abs(items[i][2] - items[j][2]) <= max_gap
    leaders, out = [], {}
    for i in range(len(items)):
        near = [j for j in leaders if like(j, i)]
        if near:
            out[i] = near[-1] if last else near[0]
        else:
            leaders.append(i)
            out[i] = i
    return out


@pytest.mark.parametrize("threshold,last,block", [(85, False, 4096), (75, True, 4096), (80, False, 16), (75, True, 16)])
def test_greedy_groups_equal_the_sequential_pass(spark, threshold, last, block):
    rng = random.Random(threshold + block)
    words = ["tele", "televisor", "smart", "led", "a", "ab", "55", "pulgadas", "negro", "negra"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(120)] + ["b", "bb", "x", "televisor led", "televisor led"]
    items = [(i, t, rng.random()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(items, "item long, text string, price double")
    found = matching.leader_groups(df, threshold, 0.3, "last" if last else "first", block)
    assert {r["item"]: r["leader"] for r in found.collect()} == _greedy(items, threshold, 0.3, last)


def test_similarity_join_loses_no_pair(spark):
    rng = random.Random(9)
    texts = sorted({"".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(90)})
    df = spark.createDataFrame([(t, t) for t in texts], "item string, text string")
    for threshold in (75, 85):
        found = {(r["a"], r["b"]) for r in matching.similarity_self_join(df, threshold).collect()}
        assert found == {(a, b) for a in texts for b in texts if a < b and _ratio(a, b) >= threshold}


def test_price_cells_form_pairs_at_most_twice(spark):
    """Every pair within the gap meets; those that meet are at most two gaps apart, in one or two cells."""
    rng = random.Random(8)
    prices = [rng.random() for _ in range(300)] + [0.3, 0.45, 0.6, None, float("nan")]
    df = spark.createDataFrame([(i, f"text {i}", p) for i, p in enumerate(prices)], "item long, text string, price double")
    keyed = matching.cell_keys(df, 0.15)
    cells = {r["item"]: set(r["_keys"]) for r in keyed.collect()}
    close = [(a, b) for a in range(303) for b in range(a) if abs(prices[a] - prices[b]) <= 0.15]
    assert all(cells[a] & cells[b] for a, b in close) and not cells[303] and not cells[304]
    formed = sum(len(cells[a] & cells[b]) for a in cells for b in range(a))
    met = sum(bool(cells[a] & cells[b]) for a in cells for b in range(a))
    assert formed == matching._candidate_pairs(keyed) and formed <= 2 * met
    assert all(abs(prices[a] - prices[b]) <= 0.31 for a in range(303) for b in range(a) if cells[a] & cells[b])
    # a lone price needs no cells by text, and the other way round
    assert set(matching.blocking_keys(df.filter("item < 50"), 75, 0.15).columns) == {"item", "text", "price", "_keys"}


def test_number_rows_is_consecutive(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r["v"] == r["n"] for r in matching.number_rows(df, ["v"], "n").collect())


def test_embedding_groups_equal_the_sequential_pass(spark):
    texts = ["smart tv led", "smart tv", "tv led", "nevera", "nevera dos puertas", "lavadora", "smart", "dos puertas"]
    df = spark.createDataFrame([(t, t) for t in texts], "item string, text string")
    vectors = {r["item"]: np.array(r["vector"]) for r in embeddings.phrase_vectors(df).collect()}
    leaders, expected = [], {}
    for t in sorted(texts):
        expected[t] = next((j for j in leaders if vectors[j] @ vectors[t] >= 0.7), t)
        if expected[t] == t:
            leaders.append(t)
    assert {r["item"]: r["leader"] for r in embeddings.embedding_groups(df).collect()} == expected


def test_pivot_cells_lose_no_pair_and_stay_small(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    points = np.repeat(centres, 20, axis=0) + rng.normal(size=(800, 24)) * rng.choice([0.1, 0.35], size=(800, 1))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[5] = 0
    points[7] = points[8]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "item long, vector array<double>").cache()
    cosines = points @ points.T
    for threshold, share in ((0.95, 0.1), (0.7, 1.0)):
        pivots = embeddings.choose_pivots(df, threshold)
        cells = embeddings.pivot_cells(df, pivots, threshold).cache()
        expected = {(i, j) for i, j in zip(*np.nonzero(cosines >= threshold)) if i < j}
        found = [(r["a"], r["b"]) for r in embeddings.close_pairs(cells, cells, threshold).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
        sizes = [r["count"] for r in cells.selectExpr("explode(_keys) AS cell").groupBy("cell").count().collect()]
        assert max(sizes) <= share * len(points)
        leaders, groups = [], {}
        for i in range(len(points)):
            groups[i] = next((j for j in leaders if cosines[i, j] >= threshold), i)
            if groups[i] == i:
                leaders.append(i)
        assert {r["item"]: r["leader"] for r in embeddings.vector_groups(df, threshold, block=200).collect()} == groups
    assert embeddings.vector_groups(df.limit(0)).count() == 0


def test_stl_parts_add_up_and_find_the_week(spark):
    days = pd.date_range("2024-01-01", periods=120).date
    y = [100 + 0.5 * i + (10 if i % 7 == 0 else 0) for i in range(120)]
    df = spark.createDataFrame([("s", d, v) for d, v in zip(days, y)] + [("short", days[0], 1.0)], "store string, day date, mean double")
    found = series.stl_decompose(df).toPandas()
    whole = found[found.store == "s"].sort_values("day")
    assert np.allclose(whole.trend + whole.season + whole.residual, y)
    assert whole.season.iloc[49] > 6 and abs(whole.residual).median() < 0.5
    assert found[found.store == "short"].trend.isna().all()


def test_kde_matches_the_direct_sum(spark):
    v = np.random.default_rng(5).normal(size=80)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    found = density.kde(df, "v", ["g"]).toPandas().sort_values("grid_point")
    width = v.std(ddof=1) * len(v) ** -0.2
    direct = [np.exp(-0.5 * ((x - v) / width) ** 2).sum() / (len(v) * width * np.sqrt(2 * np.pi)) for x in found.x]
    assert np.allclose(found.density, direct)


def test_bootstrap_band_is_repeatable_and_holds_the_mean(spark):
    df = spark.createDataFrame([("a", str(i), float(i % 10)) for i in range(200)], "g string, id string, v double")
    once = density.mean_line_ci(df, "v", ["g"], "id", 200).first()
    assert once["low"] < once["mean"] < once["high"]
    assert once == density.mean_line_ci(df.repartition(3), "v", ["g"], "id", 200).first()


def test_sample_with_replacement_is_exact(spark):
    found = features.sample_with_replacement(spark.range(10), 57, ["id"])
    assert found.count() == 57 and found.select("draw").distinct().count() == 57


def test_pca_and_clusters(spark):
    rows = [(float(i), 2.0 * i, float(i % 3)) for i in range(60)]
    matrix = features.standard_features(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    variance = features.pca_variance(matrix, 3)
    assert features.components_for(variance) == 2
    costs = [r["cost"] for r in features.elbow_curve(matrix, range(2, 5), 2).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)


def _lloyd(x, centres, iterations=20, tolerance=1e-4):
    """One model alone, row against centre."""
    for _ in range(iterations):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        still = (((new - centres) ** 2).sum(1) <= tolerance ** 2).all()
        centres = new
        if still:
            break
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_kmeans_search_equals_single_fits(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (120, 3)) + 1000 for c in (0, 4, 9)] + [np.full((150, 3), 1007.0)])
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)] + [(-1, None)], StructType().add("id", "long").add("features", VectorUDT())).repartition(5)
    models, silhouettes = kmeans.search(df, range(2, 6), 3, seed=7)
    sample, weights = kmeans._start_rows(df.filter("id >= 0").select(vector_to_array("features").alias("x")))
    assert weights.sum() == len(x) and len(np.unique(sample, axis=0)) == len(sample)
    starts = [kmeans.start_centres(sample, weights, 5, (7, r)) for r in range(3)]
    scores = silhouettes()
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
    for k, model in models.items():
        assert model.cost == pytest.approx(min(_lloyd(x, s[:k])[1] for s in starts), rel=1e-9)
        labelled = model.transform(df)
        assert labelled.filter("id = -1").first()["cluster"] is None
        held = labelled.filter("id >= 0")
        sizes = {r["cluster"]: r["count"] for r in held.groupBy("cluster").count().collect()}
        assert sizes == {i: n for i, n in enumerate(model.sizes) if n}
        assert scores[k] == pytest.approx(judge.evaluate(held), rel=1e-6)


def test_kmeans_with_fewer_different_rows_than_clusters(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 1.0]),)] * 40, ["features"])
    models, silhouettes = kmeans.search(df, [2, 3], 2)
    assert {k: (m.cost, m.sizes.tolist()) for k, m in models.items()} == {2: (0.0, [40, 0]), 3: (0.0, [40, 0, 0])}
    assert silhouettes() == {2: None, 3: None}
    with pytest.raises(ValueError):
        features.kmeans_best_of(df.limit(0), 2)


def test_recommend_text_fills_up_by_id(spark):
    docs = spark.createDataFrame([(1, "rojo azul"), (2, "verde"), (3, "rojo"), (4, "negro"), (5, "gris"), (6, "blanco"), (7, "rosa")], "id long, text string")
    found = recommend.recommend_text(docs, spark.createDataFrame([(1,)], "query long"), 5, stop=[])
    assert [r["id"] for r in found.orderBy("position").collect()] == [3, 2, 4, 5, 6]


def test_precision_and_recall(spark):
    products = spark.createDataFrame([(i, n, 4.0) for i, n in enumerate(["a", "A ", "a", "a", "a", "b", "c", "d"])], "id long, name string, rating double")
    found = spark.createDataFrame([(0, i) for i in (1, 2, 5, 6, 7)] + [(5, 0)], "query long, id long")
    rows = {r["query"]: (r["precision"], r["recall"]) for r in recommend.precision_recall_at_k(found, products).collect()}
    assert rows == {0: (0.4, 0.5), 5: (0.0, 0.0)}


def test_polarity_bounds_and_labels(values):
    label = reviews.polarity_label(F.col("x"))
    assert values([0.05, -0.05, 0.049, None], label, "double") == ["positivo", "negativo", "neutral", "neutral"]
    assert values(["5 stars", "1 star", "3 stars"], reviews.stars_to_polarity(F.col("x"))) == ["positivo", "negativo", "neutral"]
    assert values(["Alegría", "asco", "joy"], reviews.emotion_bucket(F.col("x"))) == ["feliz", "desilusionado", "joy"]


def test_batch_score_survives_bad_texts(spark):
    def make_model():
        def label(texts):
            if "bad" in texts:
                raise ValueError
            return [t.upper() for t in texts]
        return label

    df = spark.createDataFrame([("a",), ("bad",), (" ",), (None,)], "t string").coalesce(1)
    assert [r["l"] for r in reviews.batch_score(df, "t", make_model, "l").collect()] == ["A", None, None, None]


@pytest.mark.parametrize("terms,components", [(12, 50), (40, 30)])
def test_singular_values_equal_numpy(spark, monkeypatch, terms, components):
    rng = np.random.default_rng(terms)
    matrix = rng.random((150, terms)) * (rng.random((150, terms)) < 0.2)
    matrix[5] = matrix[6]
    matrix[:, 3] = matrix[:, 4]
    rows = [(int(i), f"t{j}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    found = decompose.truncated_svd(spark.createDataFrame(rows, "id long, term string, weight double"), components, rounds=60)
    expected = np.linalg.svd(matrix, compute_uv=False)
    rank = min(components, int((expected > 1e-9).sum()))
    assert np.allclose(found.values, expected[:rank], rtol=1e-6)
    got = {r["id"]: np.array(r["reduced"]) for r in found.rows.collect()}
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    near = np.array([[got[i] @ got[j] if i in got and j in got else 0.0 for j in range(150)] for i in range(150)])
    assert np.allclose(near, (u[:, :rank] * s[:rank] ** 2) @ u[:, :rank].T, atol=1e-5)
    assert decompose.truncated_svd(spark.createDataFrame([], "id long, term string, weight double")).values == []


def test_documents_without_terms_are_at_zero(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "red bolt"), (3, ""), (4, None)], "id long, text string")
    got = {r["id"]: r["reduced"] for r in recommend.truncated_svd(docs).collect()}
    assert got[3] == got[4] == [0.0, 0.0] and len(got[1]) == 2 and abs(got[1][0] - got[2][0]) < 1e-9


def test_association_matrix_with_nulls(spark):
    """Against direct sums; nulls of either column leave a row out of that pair only."""
    rng = random.Random(11)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", "q", "r", None]), rng.choice([1.0, 2.5, None]), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, u double, `v w` double")
    got = {(r["a"], r["b"], r["measure"]): r["value"] for r in profile.association_matrix(df, ["u", "v w"], ["a", "b"]).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "u", "v w"])

    def entropy(counts):
        share = counts / counts.sum()
        return -(share * np.log(share)).sum()

    both = pdf.dropna(subset=["a", "b"])
    h = entropy(both.groupby(["a", "b"]).size())
    expected = {("u", "v w", "pearson"): pdf["u"].corr(pdf["v w"])}
    for a, b in (("a", "b"), ("b", "a")):
        expected[a, b, "uncertainty"] = (entropy(both.groupby(a).size()) + entropy(both.groupby(b).size()) - h) / entropy(both.groupby(a).size())
        for v in ("u", "v w"):
            some = pdf.dropna(subset=[a, v])
            means = some.groupby(a)[v].transform("mean")
            expected[a, v, "correlation_ratio"] = math.sqrt(((means - some[v].mean()) ** 2).sum() / ((some[v] - some[v].mean()) ** 2).sum())
    assert got == pytest.approx(expected)
    assert profile.association_matrix(df, [], ["a"]).count() == 0
    assert {r["measure"] for r in profile.association_matrix(df, ["u", "v w"], []).collect()} == {"pearson"}
    assert all(r["value"] is None for r in profile.association_matrix(df.limit(0), ["u", "v w"], ["a", "b"]).collect())


def test_topics_part_documents_of_different_words(spark):
    """Both sides of the counts: more documents than terms, and more terms than documents."""
    few = [(i, " ".join(f"{'ab'[i % 2]}{(i + j) % 6}x" for j in range(5))) for i in range(60)]
    many = [(i, " ".join(f"{'ab'[i % 2]}{j}x" for j in range(40) if (i + j) % 3)) for i in range(12)]
    for rows in (few, many):
        docs = spark.createDataFrame([*rows, (99, None)], "id long, text string")
        cells, vocabulary = topics.document_cells(docs)
        found, model = topics.lda_topics(docs, cells, k=2, iterations=20)
        topic = {r["id"]: r["topic"] for r in found.collect()}
        assert len(topic) == len(rows) + 1 and topic[99] == 0
        assert len({topic[i] for i, _ in rows if i % 2 == 0}) == len({topic[i] for i, _ in rows if i % 2}) == 1 and topic[0] != topic[1]
        words = {r["topic"]: r["topic_words"].split(" ") for r in topics.topic_words(model, vocabulary, 4).collect()}
        assert [{w[0] for w in words[topic[i]]} for i in (0, 1)] == [{"a"}, {"b"}] and all(len(w) == 4 for w in words.values())


def test_quantiles_of_counts_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(1)] + [("one", 5.0), ("few", 1.0), ("few", 2.0), ("few", 2.0), (None, 3.0), ("none", None)]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    found = {(r["g"], r["prob"]): r["quantile"] for r in quantiles.quantiles_of_counts(counts.filter("g IS NOT NULL"), "v", (0.0, 0.01, 0.25, 0.5, 1.0), ["g"]).collect()}
    for (g, p), value in found.items():
        assert value == pytest.approx(np.quantile([v for h, v in rows if h == g], p))
    assert len(found) == 15


def test_topic_counts_cut_the_texts_once(spark, monkeypatch):
    """Texts of an id in several rows; words in too few or too many ids are left out."""
    calls = []
    count = topics.term_counts
    monkeypatch.setattr(topics, "term_counts", lambda *args, **named: calls.append(args) or count(*args, **named))
    rows = [(i // 2, "every" + " some" * (i < 20) + " rare" * (i == 0)) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, None)], "id long, text string")
    assert sorted(map(tuple, topics.count_vectors(docs).collect())) == [("some", i, 2) for i in range(10)]
    assert len(calls) == 1


def test_topic_chunks_stay_small():
    rows = pa.record_batch({"id": pa.array(range(1000)), "columns": pa.array([[i % 3] for i in range(1000)]), "counts": pa.array([[1.0]] * 1000)})
    chunks = list(lda._chunks(iter([rows]), 3))
    assert max(len(c) for _, c in chunks) <= 256 and sum(c.sum() for _, c in chunks) == 1000


def _plain_settle(counts, other, prior):
    """All topics in all steps."""
    weights = prior + counts.sum(1, keepdims=True) * np.full((1, other.shape[1]), 1.0 / other.shape[1])
    moving = np.arange(len(counts))
    for _ in range(lda.STEPS):
        held = lda.exp_digamma(weights[moving])
        new = prior + held * ((counts[moving] / np.maximum(held @ other.T, 1e-100)) @ other)
        change = np.abs(new - weights[moving]).mean(1)
        weights[moving] = new
        moving = moving[change > lda.REST]
    held = lda.exp_digamma(weights)
    return weights, (counts / np.maximum(held @ other.T, 1e-100)).T @ held


@pytest.mark.parametrize("own_sum", [True, False])
def test_topics_that_give_nothing_are_left_out_of_the_steps(own_sum, monkeypatch):
    rng = np.random.default_rng(2)
    counts = rng.poisson(rng.gamma(0.3, 3, (90, 40))).astype(float)
    counts[5] = 0
    other = rng.dirichlet(np.full(40, 0.1), 125).T + 1e-12
    widths, narrowed = [], lda._narrowed
    monkeypatch.setattr(lda, "_narrowed", lambda *args: widths.append((args[1][args[2]] > 1 / 125).sum(1).mean()) or narrowed(*args))
    found, expected = lda._settle(counts, other, 1 / 125, own_sum), _plain_settle(counts, other, 1 / 125)
    assert widths and min(widths) < 40  # of 125
    for a, b in zip(found, expected):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_a_topic_that_comes_back_takes_part_again(monkeypatch):
    """A topic that was left out too early is found by the last look at all topics."""
    rng = np.random.default_rng(4)
    counts, other = rng.poisson(2.0, (20, 12)).astype(float), rng.dirichlet(np.full(12, 0.3), 6).T + 1e-9
    narrowed = lda._narrowed

    def forgets(counts, weights, rows, *rest):
        weights[rows, weights[rows].argmax(1)] = 1 / 6
        return narrowed(counts, weights, rows, *rest)

    monkeypatch.setattr(lda, "_narrowed", forgets)
    monkeypatch.setattr(lda, "REST", 1e-9)
    monkeypatch.setattr(lda, "STEPS", 3000)
    weights = lda._settle(counts, other, 1 / 6, True)[0]
    held = lda.exp_digamma(weights)
    again = 1 / 6 + held * ((counts / (held @ other.T)) @ other)
    assert (weights > 1 / 6).any(1).all() and np.abs(again - weights).max() < 1e-5


def test_topic_model_keeps_the_larger_side_in_the_tasks(spark, monkeypatch):
    """Three documents and many terms: the driver's matrix has three rows."""
    shapes = []
    step = lda._pass
    monkeypatch.setattr(lda, "_pass", lambda rows, other, *rest: shapes.append(other.shape) or step(rows, other, *rest))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(500) if j % 3 != i)) for i in range(3)], "id long, text string")
    topics.lda_topics(docs, topics.document_cells(docs)[0], k=4, iterations=2)
    assert shapes == [(3, 4)] * 2


def test_bootstrap_bands_of_whole_and_cut_groups(spark, monkeypatch):
    """Groups that fit a task hand on their band and no sums; groups cut into parts have the same band."""
    rng = random.Random(3)
    rows = [(i, f"g{i % 3}" if i < 400 else f"one{i}", rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(7)
    sums = []
    parts = density._band_parts

    def counted(*rest):
        found = parts(*rest)
        sums.append(found.filter("_sum IS NOT NULL").count())
        return found

    monkeypatch.setattr(density, "_band_parts", counted)
    whole = sorted(density.mean_line_ci(df, "v", ["g"], "id", 100).collect())
    monkeypatch.setattr(density, "PART", 20)
    cut = sorted(density.mean_line_ci(df, "v", ["g"], "id", 100).collect())
    assert sums[0] == 0 and sums[1] >= 18 and len(whole) == 203
    assert [r[:1] + r[2:] for r in whole] == [r[:1] + r[2:] for r in cut]
    assert all(r["low"] == r["high"] == pytest.approx(r["mean"], rel=1e-11) for r in whole if r["n"] == 1)
    assert all(r["low"] < r["mean"] < r["high"] for r in whole if r["n"] > 1)


def _between(df, upper, lower):
    """The plan's nodes from the first ``upper`` down to the next ``lower``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    at = plan.index(upper)
    return plan[at:plan.index(lower, at)]


def test_words_are_not_shuffled_to_their_texts(spark):
    """Texts are partitioned by their key before they are words."""
    docs = spark.createDataFrame([(1, "los gatos ven gatos"), (2, "gatos"), (3, None)], "k long, t string")
    lemmas = spark.createDataFrame([("gatos", "gato")], "form string, lemma string")
    found = text.lemmatise(docs, "t", lemmas, "k")
    assert {r["k"]: r["t_lemmas"] for r in found.collect()} == {1: "los gato ven gato", 2: "gato", 3: None}
    assert "Exchange hash" not in _between(found, "ObjectHashAggregate", "Generate")
    lexicon = spark.createDataFrame([("gatos", "joy"), ("los", "fear"), ("ven", "fear")], "term string, emotion string")
    found = reviews.lexicon_emotion(docs, "k", "t", lexicon)
    assert {r["k"]: r["emotion_lexicon"] for r in found.collect()} == {1: "fear", 2: "joy", 3: "neutral"}
    assert "Exchange hash" not in _between(found, "HashAggregate", "Generate")


def test_count_vectors_drop_terms_before_they_are_counted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"all w{i} even" if i % 2 == 0 else f"all w{i} w{i}") for i in range(20)], "id long, text string")
    found = topics.count_vectors(docs)
    assert "LeftSemi" in _between(found, "HashAggregate", "Generate")
    rows = sorted(found.collect())
    assert rows == [("even", i, 1) for i in range(0, 20, 2)]
    monkeypatch.setattr(topics, "BROADCAST_ROWS", 0)
    assert sorted(topics.count_vectors(docs).collect()) == rows


def test_recommenders_share_text_scores(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(i, f"w{i % 3} w{i % 4}", float(i % 2), 0.9, 0.5, 1.0 + i / 10) for i in range(12)],
        "id long, text string, sentiment double, ratio_store double, ratio_partner double, ratio_other double")
    asked = spark.createDataFrame([(1,), (5,)], "query long")
    docs = rows.select("id", "text")
    alone = [sorted(f.collect()) for f in (recommend.recommend_text(docs, asked, stop=[]), recommend.recommend_hybrid(rows, asked, stop=[]))]
    scores = recommend.text_scores(recommend.tfidf(docs, []), asked)
    monkeypatch.setattr(recommend, "tfidf", None)
    shared = [recommend.recommend_text(docs, asked, scores=scores), recommend.recommend_hybrid(rows, asked, scores=scores)]
    assert [sorted(f.collect()) for f in shared] == alone


def test_right_vectors_are_not_written(spark, monkeypatch):
    """They stay in the tasks of their terms; entries are shuffled once, and the image alone in every round."""
    columns, write = [], decompose.written
    monkeypatch.setattr(decompose, "written", lambda df: columns.append(set(df.columns)) or write(df))
    rows = [(i, f"t{j}", 1.0 + i * j) for i in range(6) for j in range(i, i + 3)]
    assert len(decompose.truncated_svd(spark.createDataFrame(rows, "id long, term string, weight double"), 2, rounds=3).values) == 2
    assert not any({"term", "vector"} <= c for c in columns)


def test_svd_parts_terms_and_leaves_no_image(spark, monkeypatch):
    """Frequent terms, groups of other terms and terms of one row, in many blocks; the tables of a round go with it."""
    matrix = np.random.default_rng(5).random((60, 40)) * (np.random.default_rng(6).random((60, 40)) < np.linspace(0.9, 0.02, 40))
    rows = [(f"d{i}", f"t{j}", float(matrix[i, j])) for i, j in zip(*matrix.nonzero())]
    weights, paths = spark.createDataFrame(rows, "id string, term string, weight double"), []
    for name, value in {"COMMON": 9, "BLOCK_ROWS": 6, "PARTS": 3, "PART_BLOCKS": 4, "GROUPS": 2, "GROUP_TERMS": 5, "LONG": 8, "STEP": 16}.items():
        monkeypatch.setattr(decompose, name, value)
    path = decompose.scratch_path
    monkeypatch.setattr(decompose, "scratch_path", lambda *args: paths.append(path(*args)) or paths[-1])
    found = decompose.truncated_svd(weights, 4, rounds=15)
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    np.testing.assert_allclose(found.values, s[:4], rtol=1e-6)
    left = u[:, :4] * np.where(u[:, :4].sum(0) < 0, -1, 1) * s[:4]
    got = {r["id"]: r["reduced"] for r in found.rows.collect()}
    assert set(got) == {r[0] for r in rows} and max(np.abs(left[int(i[1:])] - v).max() for i, v in got.items()) < 1e-2
    assert len(paths) > 4 and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_starting_vectors_equal_their_columns(spark):
    terms = spark.createDataFrame([("a",), ("perro",), ("ñandú",), ("",)], "term string").select(
        F.xxhash64("term").alias("h"), F.array(*[decompose._start(i) for i in range(9)]).alias("v")).collect()
    assert np.array_equal(decompose._starts(np.array([r["h"] for r in terms]), 9), np.array([r["v"] for r in terms]))


def test_rows_of_frequent_keys_are_not_shuffled(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 6), (None, 7)], "term string, n long")
    small = df.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    whole = sorted(lookup.attach_frequent(df, small, "term", "rows").collect())
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 1)
    found = lookup.attach_frequent(df, small, "term", "rows")
    assert sorted(found.collect()) == whole == [("a", i, 3) for i in (1, 2, 3)] + [("b", 4, 2), ("b", 5, 2), ("c", 6, 1)]
    assert "Union" in found._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_their_text_is(spark, monkeypatch):
    plans, write = [], recommend.written
    monkeypatch.setattr(recommend, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    docs = spark.createDataFrame([(1, "red ring"), (1, "red"), (2, "blue ring"), (3, None)], "id long, text string")
    weights = {(r["id"], r["term"]): r["weight"] for r in recommend.tfidf(docs).collect()}
    assert set(weights) == {(1, "red"), (1, "ring"), (2, "blue"), (2, "ring")}
    assert plans and plans[0].count("Exchange") == 1


def test_series_of_one_length_are_fitted_together(spark):
    y = np.random.default_rng(3).gamma(2, 100, size=(5, 60))
    y[1] = 7.0
    together = series.seasonal_trend(y)
    for i in range(5):
        assert all(np.array_equal(a[i], b[0]) for a, b in zip(together, series.seasonal_trend(y[i:i + 1])))
    days = pd.date_range("2024-01-01", periods=60).date
    days = [*days[:-1], None]  # a missing day comes last
    rows = [(k, d, float(v)) for k, line in zip(["a", "b", None, "c", "d"], y) for d, v in zip(days, line)]
    found = series.stl_decompose(spark.createDataFrame(rows, "store string, day date, mean double")).toPandas().sort_values("day", na_position="last")
    assert np.array_equal(found[found.store.isna()].trend, together[0][2]) and np.array_equal(found[found.store == "d"].season, together[1][4])


def test_offers_are_evaluated_once_for_their_clusters(spark, monkeypatch):
    columns, write = [], features.written
    monkeypatch.setattr(features, "written", lambda df: columns.append(df.columns) or write(df))
    df = spark.range(40).selectExpr("id", "cast(id % 4 as double) a", "cast(id % 7 as double) b", "cast(id % 3 as string) c", "cast(id % 2 as string) d")
    assert features.cluster_products(df, ["a", "b"], ("c", "d"), k=3, restarts=2).select("cluster").distinct().count() == 3
    assert columns == [df.columns]


def test_review_lists_are_made_from_one_pass_over_the_texts(spark, tmp_path, monkeypatch):
    from vitrina.plans import model_queries
    spark.createDataFrame([(1, "Gatos, perros; GATOS", "es", "s"), (2, None, "es", "s")], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    calls, lists, terms = [], [], model_queries._terms
    monkeypatch.setattr(model_queries, "_terms", lambda *args: calls.append(args) or terms(*args))
    monkeypatch.setattr(model_queries.reviews, "score_reviews", lambda rows, key, product, text, valences, emotions, *models: lists.append(
        (valences.collect(), emotions.collect())) or rows.withColumn("comment_clean", F.col("text")))
    model_queries.query.__globals__["QUERIES"]["score_reviews"](spark, str(tmp_path))
    assert len(calls) == 1
    valences, emotions = ({r["term"]: r[1] for r in found} for found in lists[0])
    assert valences == {t: float((ord(t[0]) + len(t)) % 9 - 4) for t in ("gatos", "perros")}
    assert emotions == {t: model_queries.EMOTIONS[ord("s") % 8] for t in ("gatos", "perros")}
