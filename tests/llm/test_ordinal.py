import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import ordinal
from plumbline.llm.ordinal import SHAPES, WORDS, OrdinalModel, _rows, _score, fit, gradient, graded, rate

SCHEMA = "doc_id bigint, text string, grade string, expected string, index int"


def corpus(n=400):
    rng = random.Random(4)
    good, poor, rude = ([f"{p}{k}" for k in range(30)] for p in ("plain", "junk", "rude"))
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        words = [rng.choice(good) for _ in range(40)]
        for _ in range(12 if kind < 2 else 0):
            words[rng.randrange(40)] = rng.choice(poor if kind == 0 else rude)
        rows.append((i, " ".join(words), "c", "c", 1))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_orders_grades_on_held_out_documents(spark):
    rows, labels = corpus()
    rows += [(9000, None, "c", "c", 1), (9001, " \n", "c", "c", 1), (None, "plain1 plain2", "c", "c", 1), (3, "plain1 " * 50000, "c", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    lf = spark.createDataFrame(labels + [(0, 0, 0), (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    out = rate(df, lf).collect()
    assert len(out) == len(rows) and set(df.columns) < set(out[0].asDict())
    mean = [np.mean([r.expected_grade for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == k]) for k in range(3)]
    assert mean[0] < 0.6 < mean[1] < 1.6 < mean[2]
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.selected == (r.doc_id % 3 > 0) for r in held]) > 0.95
    for r in out:
        assert 0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2
        if r.doc_id in (9000, 9001):
            assert r.expected_grade == 0 and not r.selected


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 1)]])
def test_without_grades(spark, labels):
    df = spark.createDataFrame([(1, "a b", "c", "c", 1), (2, "", "c", "c", 1), (4, "x", "c", "c", 1)], SCHEMA)
    out = {r.doc_id: r for r in rate(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert out[1].selected == (labels != [(1, 0, 0), (2, 0, 1)]) and not out[2].selected


def test_empty_and_repeated_labels(spark):
    assert rate(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []
    lf = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (2, 1, 0), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in graded(lf).collect()} == {1: 0, 2: 1, 3: 2}


def test_fit_recovers_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    u = rng.logistic(size=4000)
    grade = np.digitize(2 * x + u, [-1.0, 1.5])
    model = fit(np.zeros(4000, int), x, np.arange(4001), grade, rounds=400, rate=0.1)
    assert isinstance(model, OrdinalModel)
    assert model.weights[0] == pytest.approx(2, abs=0.2)
    assert model.thresholds == pytest.approx([-1, 1.5], abs=0.2)


def brute_probabilities(latent, thresholds):
    """P(grade = k), one by one, from the definition."""
    at_most = [1 / (1 + np.exp(latent - t)) for t in thresholds] + [1.0]
    return [p - q for p, q in zip(at_most, [0.0, *at_most[:-1]])]


def brute_loss(w, gaps, x, grade):
    thresholds = [gaps[0]]
    for g in gaps[1:]:
        thresholds.append(thresholds[-1] + np.exp(g))
    return -np.mean([np.log(brute_probabilities(float(np.dot(row, w)), thresholds)[k]) for row, k in zip(x, grade)])


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    x, grade = rng.normal(size=(30, 6)), rng.integers(0, 4, 30)
    w, gaps = rng.normal(size=6), np.array([-1.0, 0.3, -0.4])
    index, value, row = np.tile(np.arange(6), 30), x.ravel(), np.repeat(np.arange(30), 6)
    g_w, g_gaps = gradient(w, gaps, index, value, row, grade)
    for own, point in ((g_w, w), (g_gaps, gaps)):
        for n in range(len(point)):
            step = np.zeros_like(point)
            step[n] = 1e-6
            ends = [brute_loss(*((p, gaps) if point is w else (w, p)), x, grade) for p in (point + step, point - step)]
            assert own[n] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_scores_are_those_of_the_definition():
    """Mean features by a loop over words, then expected grade and tail from the probability of each grade."""
    rng = np.random.default_rng(4)
    model = OrdinalModel(rng.normal(size=WORDS + SHAPES), np.array([-0.5, 0.7]))
    texts = ["one two two THREE!", "x", "", "####  a1 a1 a1 wörd", "b " * 300]
    batch = pa.record_batch({"rank": [0] * 5, "grade": pa.array([0] * 5, pa.int32()), "text": texts})
    counts = [b for b in _rows([batch])][0].to_pylist()
    got = next(iter(_score(model, 2, 1, 2)([batch]))).to_pylist()
    for text, own, row in zip(texts, counts, got):
        assert sum(own["value"]) == pytest.approx(2.0 if text else 0) and own["words"] == len(text.split())
        p = brute_probabilities(sum(model.weights[i] * v for i, v in zip(own["index"], own["value"])), model.thresholds)
        assert row["c3"] == pytest.approx(sum(k * q for k, q in enumerate(p)) if text else 0, rel=1e-5)
        assert row["c4"] == pytest.approx(p[1] + p[2] if text else 0, rel=1e-5)


def test_sample_ends_with_its_words(spark):
    from plumbline.llm.ordinal import train

    rows, labels = corpus(60)
    df, lf = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert isinstance(train(df, graded(lf)), OrdinalModel) and not isinstance(train(df, graded(lf), most_words=45), OrdinalModel)


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """The fit runs in a task, on the rows in the order of their ids' hashes."""
    texts = {n: " ".join(f"w{(n * k) % 17}" for k in range(1, 9)) + (" ### spam" if n % 3 == 0 else "") for n in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    grades = spark.createDataFrame([(n, 0 if n % 3 == 0 else 2) for n in texts], "doc_id bigint, grade int")
    fit = ordinal.fit
    monkeypatch.setattr(ordinal, "fit", lambda *a, **b: pytest.fail("the driver fits"))
    model = ordinal.train(docs, grades)
    ranked = [r.doc_id for r in grades.selectExpr("doc_id", "xxhash64(doc_id) rank").orderBy("rank").collect()]
    schema = ["rank", "grade", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([0 if n % 3 == 0 else 2 for n in ranked], pa.int32()), pa.array([texts[n] for n in ranked])], names=schema)
    rows = pa.Table.from_batches(ordinal._rows([batch])).combine_chunks()
    index, value = (rows.column(c).combine_chunks() for c in ("index", "value"))
    own = fit(np.asarray(index.flatten(), np.int64), np.asarray(value.flatten(), np.float64), np.concatenate([[0], np.cumsum(np.asarray(index.value_lengths()))]), np.asarray(rows.column("grade"), np.int64))
    assert (model.weights == own.weights).all() and (model.thresholds == own.thresholds).all()
    one = ordinal.train(docs, grades.where("grade = 2"))
    assert one == 2 and ordinal.train(docs, grades.limit(0)) == -1
