import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import toxicity
from plumbline.llm import wordblocks as W
from plumbline.llm.toxicity import DIM, FILTERS, ROWS, WIDTHS, Cnn, fit, gradients, padded, score, threshold, word_rows

SCHEMA = "doc_id bigint, text string, lang string, toxic string, rows int, fold int"


def test_filters_do_not_cross_texts():
    rng = np.random.default_rng(0)
    model = fit([rng.integers(1, 50, (5, 3)).astype(np.int32) for _ in range(8)], np.array([0, 1] * 4, float), epochs=1)
    texts = [rng.integers(1, 50, (n, 3)).astype(np.int32) for n in (4, 0, 1, 9)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = model.logits(np.concatenate(texts), first)
    alone = [model.logits(t, np.array([0, len(t)]))[0] for t in texts]
    assert whole == pytest.approx(alone, abs=1e-5)
    assert isinstance(model, Cnn) and padded(texts[1], np.array([0, 0]))[0].shape == (3, 3)


def test_threshold():
    assert threshold(np.array([3.0, 2, 1, 0]), np.array([1, 1, 0, 0])) == 1.25
    assert threshold(np.array([3.0, 2, -1, -2]), np.array([1, 1, 0, 0])) == 0.0
    assert threshold(np.array([1.0]), np.array([0])) == 0.0


def test_word_rows():
    data, where = W.utf8(__import__("pyarrow").array(["Idiot### x", "", "idiot Ünder"]))
    rows, first = word_rows(data, where)
    assert first.tolist() == [0, 2, 2, 4] and (rows[0] == rows[2]).all() and rows.min() > 0


def test_held_out(spark):
    rng = random.Random(6)
    plain = [f"word{n}" for n in range(300)]
    rude = {"aa": ["vile", "scoundrel"], "bb": ["lumpengei", "lumpenhof", "lumpenwei", "lumpenton"]}
    rows, labels = [], []
    for n in range(900):
        lang, toxic = "ab"[n % 2] * 2, n % 5 == 0
        words = [rng.choice(plain) + ("" if lang == "aa" else "en") for _ in range(60)]
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(rude[lang]) + "!!"
        rows.append((n, " ".join(words), lang, "c", 1, 1))
        labels.append((n, 1, int(toxic)))
    rows += [(2000, None, "aa", "c", 1, 1), (2001, "", None, "c", 1, 1), (None, "word1", "aa", "c", 1, 1), (2002, "word1 " * 200000, "aa", "c", 1, 1), (5, rows[5][1], "bb", "c", 1, 1)]
    out = score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5, 1, 1), (None, 1, 1), (9, 1, None)], "doc_id bigint, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.95
    assert not any(r.predicted for r in out if r.doc_id in (2000, 2001, 2002))


def test_without_classes(spark):
    df = spark.createDataFrame([(1, "a", "aa", "c", 1, 1)], SCHEMA)
    assert score(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).first().score == 0.0
    assert score(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")).collect() == []


def small_model(rng):
    filters = [rng.normal(size=(w * DIM, FILTERS)) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    table = rng.normal(size=(ROWS, DIM)) * 0.3
    table[0] = 0
    return Cnn(table, filters, rng.normal(size=total) * 0.1, rng.normal(size=total), 0.2)


def brute_logit(model, rows):
    """Embeddings, convolutions, maxima and output by plain loops."""
    words = [[sum(model.table[r][d] for r in row) for d in range(DIM)] for row in rows]
    z, n = model.out_bias, 0
    for w, f in zip(WIDTHS, model.filters):
        for k in range(FILTERS):
            best = None
            for p in range(max(1, len(words))):
                value = 0.0
                for o in range(w):
                    if p + o < len(words):
                        value += sum(words[p + o][d] * f[o * DIM + d][k] for d in range(DIM))
                best = value if best is None else max(best, value)
            z += max(best + model.bias[n], 0) * model.out[n]
            n += 1
    return z


def test_logits_match_plain_loops():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    texts = [rng.integers(1, 40, (n, 3)).astype(np.int32) for n in (6, 0, 1, 2, 11)]
    got = model.logits(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert got == pytest.approx([brute_logit(model, t) for t in texts])


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    model, toxic = small_model(rng), np.array([1.0, 0, 1])
    texts = [rng.integers(1, 9, (n, 3)).astype(np.int32) for n in (5, 1, 3)]

    def loss():
        z = np.array([brute_logit(model, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - toxic * z))

    grads, by_out_bias = gradients(model, texts, toxic)
    for own, param in zip(grads, [model.table, *model.filters, model.bias, model.out]):
        flat = np.flatnonzero(own.ravel()) if param is model.table else np.arange(param.size)
        for n in rng.choice(flat, 6, replace=False):
            before = param.ravel()[n]
            ends = []
            for step in (1e-6, -1e-6):
                param.flat[n] = before + step
                ends.append(loss())
            param.flat[n] = before
            assert own.ravel()[n] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)
    model.out_bias += 1e-6
    up = loss()
    model.out_bias -= 2e-6
    assert by_out_bias == pytest.approx((up - loss()) / 2e-6, abs=1e-6)


def test_all_labels_are_learned_from(spark, monkeypatch):
    """Words that stand in few of very many labelled documents count, in whatever shard these are; the counts are those of all."""
    monkeypatch.setattr(toxicity, "SHARD", 1500)
    words = [f"word{n}" for n in range(200)]
    rng = random.Random(9)
    rude = ["vile", "scoundrel", "lumpengei", "grobian", "mascalzone", "canalla"]
    rows, labels = [], []
    for n in range(9000):
        toxic = n % 9 < 4
        rows.append((n, " ".join([*rng.choices(words, k=8), *([rude[n % 6]] if toxic else [])]), "aa", "c", 1, 1))
        labels.append((n, 1, int(toxic)))
    seen = {}
    added = toxicity.added
    monkeypatch.setattr(toxicity, "added", lambda texts, arrays: seen.setdefault("first", added(texts, arrays)) if arrays is toxicity._counts else added(texts, arrays))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks)
    assert seen["first"]["lang aa"].sum() == sum(len(r[1].split()) for r in rows)
    data, where = W.utf8(pa.array([f"word1 {w} word2" for w in rude] + ["word1 word3 word2"] * 3))
    assert (model.scores(data, where) >= 0.7).tolist() == [True] * 6 + [False] * 3


def test_threshold_of_counts():
    rng = np.random.default_rng(3)
    z = rng.permutation(np.arange(400)) / 50
    y = (z + rng.normal(0, 1, 400) > 5).astype(int)
    assert threshold(z, y, of=np.ones(400)) == threshold(z, y)
    assert threshold(np.array([3.0, 2, 1, 0]), np.array([5, 1, 0, 0]), of=np.array([5, 1, 4, 9])) == 1.25


def shuffled(node, *names):
    """Shuffles of a plan whose rows have a column called so."""
    own = node.nodeName() == "Exchange" and any(node.output().apply(n).name() in names for n in range(node.output().size()))
    return own + sum(shuffled(node.children().apply(n), *names) for n in range(node.children().size()))


@pytest.mark.parametrize("few", [500_000, 0])
def test_texts_are_dealt_once(spark, monkeypatch, few):
    """Labelled texts meet their labels and go to their shards in one shuffle, without those that are held out."""
    seen, table = {}, toxicity.table
    monkeypatch.setattr(toxicity, "SHARD", 50)
    monkeypatch.setattr(toxicity, "FEW", few, raising=False)
    monkeypatch.setattr(toxicity, "table", lambda df, name: seen.setdefault(name, (df, table(df, name)))[1])
    monkeypatch.setattr(toxicity, "drop", lambda *tables: None)
    rows = [(n, f"word{n} " * (1 + n % 7) + ("vile" if n % 3 == 0 else "kind"), "aa", "c", 1, 1) for n in range(600)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(n, 1, int(n % 3 == 0)) for n in range(0, 600, 2)], "doc_id bigint, quality int, toxic int"))
        plan = seen["labelled"][0]._jdf.queryExecution().executedPlan()
        assert shuffled(plan.initialPlan(), "text", "rows") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = [n for n in range(0, 600, 2) if zlib.crc32(str(n).encode()) % 3 != 1]
    laid = seen["labelled"][1].collect()
    assert sorted(len(r.rows) // 6 for r in laid) == sorted(len(rows[n][1].split()) for n in kept)
    assert {r.shard for r in laid} == set(range(-(-len(kept) // 50)))
