import datetime
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vitrina.functions import dates, money, similarity, text, vectors

X = lambda: F.col("x")


def test_parse_price(values):
    cases = {"1.299.900": 1299900.0, "$ 1.299.900": 1299900.0, "1.299,50": 1299.5, "1299900.0": 12999000.0, "1,299,900": None,
             "-5": -5.0, "-$5": 5.0, "Na": None, "": None}
    assert values(list(cases), money.parse_price(X())) == list(cases.values())


def test_parse_price_columns_keeps_numbers(spark):
    df = spark.createDataFrame([("1.000", 1299900.0)], "a string, b double")
    assert money.parse_price_columns(df, ["a", "b"]).first() == (1000.0, 1299900.0)


def test_parse_rating(values):
    assert values(["4.8 (120)", "4,5", "Na", None], money.parse_rating(X())) == [4.8, 4.0, None, None]


def test_rescale_tiers_are_strict(values):
    given_, expected = [3e7, 30000001.0, 1e8, 1e9, 1e10, 1e12, 1e13], [3e7, 3000000.1, 1e7, 1e7, 1e7, 1e8, 1e6]
    assert values(given_, money.rescale_tiers(X()), "double") == expected


def test_row_max_fill(spark):
    df = spark.createDataFrame([(10.0, None, 7.0, None), (None,) * 4], "list_price double, store_price double, partner_price double, other_price double")
    assert [tuple(r) for r in money.row_max_fill(df).collect()] == [(10.0, 10.0, 7.0, 10.0), (None,) * 4]
    assert tuple(money.row_max_fill(df, all_null=0).collect()[1]) == (0.0,) * 4


def test_row_cv_needs_two_values(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None)], "a double, b double")
    found = [r[0] for r in df.select(money.row_cv("a", "b")).collect()]
    assert abs(found[0] - 2 ** 0.5 / 2) < 1e-12 and found[1] is None


def test_clean_text(values):
    assert values(["  El TELEVISOR, más grande! ", None], text.clean_text(X())) == ["televisor mas grande", None]


def test_accents_and_ascii(values):
    rows = ["señal ﬁn ½ Ω ß", "Ærø é"]
    assert values(rows, text.strip_accents(X())) == ["senal ﬁn ½ Ω ß", "Ærø e"]
    assert values(rows, text.to_ascii(X())) == ["senal fin 12  ", "r e"]
    assert values(rows, text.transliterate(X())) == ["senal fin 12  ss", "AEro e"]


def test_brand_review_category_marks(values):
    assert values(["por LG", "Vapor Sony"], text.clean_brand(X())) == ["lg", "vasony"]
    assert values(["Bueno, bonito; ok.\n"], text.strip_review_marks(X())) == ["Bueno bonito ok"]
    assert values(["Celular", "consolas", "Consola", "CELULAR"], text.canonical_category(X())) == ["celular", "consola", "consola", "CELULAR"]


def test_lemmatise_keeps_order_and_unknown_words(spark):
    docs = spark.createDataFrame([(1, "perros y gatos"), (2, "nada")], "id int, t string")
    lemmas = spark.createDataFrame([("perros", "perro"), ("gatos", "gato")], "form string, lemma string")
    found = {r["id"]: r["t_lemmas"] for r in text.lemmatise(docs, "t", lemmas, "id").collect()}
    assert found == {1: "perro y gato", 2: "nada"}


def test_parse_date(values):
    found = values(["2024-12-15", "15/12/2024", "20241215", "mañana"], dates.parse_date(X()))
    assert found == [datetime.date(2024, 12, 15)] * 3 + [None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.vector_cosine(F.col("a"), F.col("b")), vectors.euclidean_distance(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == 0.0 and rows[1][1] == 5.0 and abs(rows[2][0] - 1.0) < 1e-12


def test_indel_ratio_examples(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", "abc"), ("abc", "xyz"), ("", "")], "a string, b string")
    found = [round(r[0], 3) for r in df.select(similarity.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert found == [66.667, 100.0, 0.0, 100.0]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_common_length_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.indel_ratios([a], [b])[0] == (200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0)


def test_ratios_of_a_batch_equal_those_of_each_pair():
    rng = random.Random(5)
    some = lambda: "".join(rng.choices("abcdé 😀", k=rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 300])))
    left, right = zip(*((some(), some()) for _ in range(400)))

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    assert similarity.indel_ratios(list(left), list(right)).tolist() == [plain(a, b) for a, b in zip(left, right)]
    assert similarity.indel_ratios([], []).tolist() == []
