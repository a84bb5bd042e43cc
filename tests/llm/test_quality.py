import math
import re

import numpy as np
from pyspark.sql import functions as F

from hexlore.llm import quality
from hexlore.llm.common import table
from hexlore.llm.hashing import hash_runs


def test_held_out_accuracy(spark):
    """Fitted on a quarter of the ratings: the others are ranked, clean documents stay, poor and toxic ones go."""
    d = "/root/testdata/sf0.1"
    grades = quality.graded(table(spark, d, "labels")).cache()
    train = grades.where("id % 4 <> 0")
    rated = quality.rate(table(spark, d, "documents"), train)
    held = rated.join(grades.where("id % 4 = 0"), rated.doc_id == F.col("id"))
    got = {r.grade: (r.kept, r.mean) for r in held.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("mean")).collect()}
    assert got[2][0] > 0.985 and got[0][0] < 0.05 and got[1][0] < 0.6
    assert got[0][1] < got[1][1] < got[2][1]


def test_fit_orders_thresholds_and_gives_probabilities():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows = [np.r_[rng.integers(100, 200, 5), 300 + g, 300 + max(0, g - 1)] for g in grades]
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    model = quality.fit(flat, sizes, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    p = model.at_least(model.scores(flat, sizes))
    assert ((p >= 0) & (p <= 1)).all() and (np.diff(p, axis=1) <= 0).all()
    assert np.corrcoef(p.sum(axis=1), grades)[0, 1] > 0.9


def plain_features(text):
    """Hashed words, bare words and beginnings, and one step for each share of words, from plain Python."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)
    n_shapes = quality.SHAPES * quality.STEPS

    def number(w):
        octets = np.frombuffer(w, np.uint8)
        return int(hash_runs(octets, np.array([0]), np.array([len(w)]))[0] % np.uint64(quality.FEATURES - n_shapes)) + n_shapes

    words, raw = re.findall(rb"[^\x20\x09-\x0D]+", low), re.findall(rb"[^\x20\x09-\x0D]+", text)
    bare = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    n = max(1, len(words))
    letters = lambda w: sum(chr(c).isalpha() or c >= 128 for c in w)
    upper = lambda w: sum(65 <= c <= 90 for c in w)
    shares = [
        sum(any(c in b"#*$%&|<>{}[]~^=_\\/@+" for c in w) for w in raw) / n,
        sum(upper(w) >= 2 and 2 * upper(w) > letters(w) for w in raw) / n,
        sum(w.count(b"!") + w.count(b"?") > 1 for w in raw) / n,
        sum(number(a) == number(b) for a, b in zip(words, words[1:])) / n,
        1 - len({number(w) for w in words}) / n if words else 0,
        sum(letters(w) == 0 for w in raw) / n,
    ]
    steps = {k * quality.STEPS + min(quality.STEPS - 1, math.ceil(math.sqrt(max(0, x)) * (quality.STEPS - 1))) for k, x in enumerate(shares)}
    return steps | {number(w) for w in words} | {number(w[:c]) for w in bare for c in (*quality.PREFIXES, len(w))}


def test_scores_equal_plain_sums(spark):
    """Expected grades and tail probabilities of a table, from the model's numbers by plain sums over plain features."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(80)
    grades = quality.graded(table(spark, "/root/testdata/sf0.01", "labels"))
    rated = {r.doc_id: r for r in quality.rate(docs, grades).collect()}
    model = quality.train(docs, grades, 3, id_col="doc_id", text_col="text", most_rows=8000, most_bytes=32_000_000)
    weights = model.weights.astype(np.float32)
    assert np.count_nonzero(weights) > 100
    for r in docs.collect():
        own = plain_features(r.text.encode())
        assert own == set(quality.features([r.text.encode()])[0].tolist())
        tails = [1 / (1 + math.exp(t - sum(float(weights[f]) for f in sorted(own)))) for t in model.thresholds]
        assert abs(rated[r.doc_id].tail_probability - tails[-1]) < 1e-5 and abs(rated[r.doc_id].expected_grade - sum(tails)) < 1e-5
        assert rated[r.doc_id].kept == (rated[r.doc_id].tail_probability >= 0.5)


def test_slopes_equal_differences():
    """The derivatives that fitting follows, against differences of the likelihood."""
    rng = np.random.default_rng(2)
    scores, cuts, grades = rng.normal(size=40), np.array([-1.0, 0.2, 1.5]), rng.integers(0, 4, 40)

    def loss(s, t):
        t = [-math.inf, *t, math.inf]
        at = lambda x: 0.0 if x == -math.inf else 1.0 if x == math.inf else 1 / (1 + math.exp(-x))
        return -sum(math.log(at(t[g + 1] - x) - at(t[g] - x)) for x, g in zip(s, grades, strict=True))

    ds, dt = quality.slopes(scores, cuts, grades)
    for k in range(40):
        step = np.eye(40)[k] * 1e-5
        assert abs((loss(scores + step, cuts) - loss(scores - step, cuts)) / 2e-5 - ds[k]) < 1e-6
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert abs((loss(scores, cuts + step) - loss(scores, cuts - step)) / 2e-5 - dt[k]) < 1e-5


def test_training_sample_is_bounded(spark):
    """A rated id on very many rows and very long texts do not lift what is fitted over its bounds."""
    rows = [(1, "one text")] * 3000 + [(1, f"text {k}") for k in range(300)] + [(2, "long " * 20_000), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = quality.graded(spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    seen = []
    real = quality.fit
    try:
        quality.fit = lambda flat, sizes, grades, n: seen.append((len(sizes), len(flat))) or real(flat, sizes, grades, n)
        quality.rate(docs, grades, most_rows=50).count()
        quality.rate(docs, grades, most_bytes=1000).count()
    finally:
        quality.fit = real
    assert seen[0][0] <= 50 and 1 <= seen[1][0] <= 303 and seen[1][1] < 5000


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "some text"), (3, "some text"), (4, "long " * 50_000), (5, "\x00 é \U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "grade": F.lit(1), "id": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.rate(docs, quality.graded(none)).collect()
    assert len(out) == len(rows) and all(r.kept for r in out)
    some = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.rate(docs, quality.graded(some)).collect()
    assert len(out) == len(rows) and all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 2 for r in out)
    assert quality.rate(docs.limit(0), quality.graded(some)).count() == 0


def test_grades_take_the_lowest_rating(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.id: r.grade for r in quality.graded(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 1}
