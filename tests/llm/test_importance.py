import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import importance as I

SCHEMA = "doc_id bigint, text string, score string, rank int, digit string"


def brute(docs, target, longest=1, buckets=10_000, share=(10, 100), least=20):
    """doc_id, n_features, weight, score of each row, and the drawn ones in order."""

    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({n: n + 32 for n in range(65, 91)}))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(at(g) for x in texts for g in grams(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows, able = [], []
    for i, text in docs:
        words, own = grams(text)
        gain = [math.floor(1000 * math.log((t[at(g)] + 1.0) * (s_all + buckets) / ((s[at(g)] + 1.0) * (t_all + buckets)))) for g in own]
        weight = sum(gain) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        if words >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    return rows, able[: len(able) * share[0] // share[1]]


def corpus():
    rng = random.Random(6)
    words = ["Alpha", "beta", "gamma9", "é", "日本", "naïve", "x" * 70, "q", "don't", "a_b", "[", "1"]
    rows = [(n * 7919 - 400, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for n in range(300)]
    rows += [(5, None), (6, ""), (7, " . ,"), (None, "alpha " * 30), (None, "alpha " * 30), (None, "beta " * 25), (8, "ALPHA beta " * 40000)]
    return rows + [(3, "alpha beta " * 15)] * 40


@pytest.mark.parametrize("longest, share", [(1, (10, 100)), (3, (3, 4)), (1, (1, 1)), (1, (0, 100))])
def test_resample(spark, longest, share):
    docs, target = corpus(), ["beta alpha x", None, "日本 é " * 9]
    df = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in docs], SCHEMA).repartition(6)
    out = I.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), share, longest=longest).collect()
    rows, drawn = brute(docs, target, longest, share=share)
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in out) == sorted(map(str, rows))
    got = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in got] == drawn


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert I.resample(none, none).collect() == []
    one = I.resample(spark.createDataFrame([(1, "a " * 20, "", 1, "")], SCHEMA), none, (1, 1)).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in one] == [(1, 20, 1)]


@pytest.mark.parametrize("ids", [range(50), [-(2**63), 2**63 - 1, 0, -1, 1, None, None], [2**62 + n * 70000 for n in range(40)]])
@pytest.mark.parametrize("digit", [4, 16])
def test_every_kth_key(spark, monkeypatch, ids, digit):
    monkeypatch.setattr(I, "DIGIT", digit)
    rows = [(i, n % 3 * 1000 - 5) for n, i in enumerate(ids)] + [(0, 995)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, score bigint")
    digits, n = I._key(df)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert n == len(rows)
    for k in {1, 2, n // 2, n - 1, n}:
        found = I.kth_key(df, digits, k)
        low = df.where(F.struct(*digits[: len(found)]) <= F.struct(*(F.lit(x) for x in found))).collect()
        want = order[:k] + [r for r in order[k:] if r == order[k - 1]]
        assert sorted(map(str, map(tuple, low))) == sorted(map(str, want))


def test_crc32_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 400)
    ends = starts + rng.integers(0, 150, 400)
    got = ~I.crc_states(np.full(400, 0xFFFFFFFF, np.uint32), data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
