import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from plumbline.llm.debruijn import compacted, runs, without_repeats

from tests_llm_util import THUE_MORSE

SCHEMA = "doc_id bigint, text string, lang string, start string, id string, key string"


def expected(rows, k=20):
    first, docs = {}, []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        docs.append((doc, words))
        for a in range(len(words) - k + 1):
            key = tuple(words[a : a + k])
            first[key] = min(first.get(key, (doc, a)), (doc, a))
    out = []
    for doc, words in docs:
        gone = [False] * len(words)
        for a in range(len(words) - k + 1):
            if first[tuple(words[a : a + k])] < (doc, a):
                gone[a : a + k] = [True] * k
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def words(a, b):
    return " ".join(f"wörd{n}" for n in range(a, b))


CASES = {
    "empty table": [],
    "null and empty": [(1, None), (2, ""), (3, " \n\t ")],
    "copies": [(5, words(0, 50)), (2, words(0, 50)), (9, words(0, 50)), (7, words(100, 119))],
    "branches": [(1, words(0, 60)), (2, words(30, 90)), (3, words(10, 40) + "\n" + words(70, 95) + " x"), (4, words(20, 39))],
    "within itself": [(1, words(0, 25) * 1 + " " + words(0, 25)), (2, "a " * 90), (3, "a " * 21)],
    "words that repeat at once": [(n, " ".join([words(n, n + 3)] + [f"again{k % 5}"] * (20 + 3 * k) + [words(50, 50 + k)] * 3)) for n, k in enumerate(range(9))] + [(20, "x y " * 60), (21, "y " + "x y " * 30)],
    "repeated rows": [(1, words(0, 30)), (1, words(0, 30)), (0, words(5, 28))],
    "colliding words": [(n, f"{w} " + words(100 * n, 100 * n + 19)) for n, w in enumerate(THUE_MORSE)] + [(n, f"{w} " + words(0, 19)) for n, w in enumerate(THUE_MORSE, 2)],
    "long": [(1, words(0, 30000)), (2, words(29000, 31000)), (3, "\x85 " + words(5, 40))],
}


#: One table of all, as each has ids of its own.
TOGETHER = [(1000 * n + i, t) for n, rows in enumerate(CASES.values()) for i, t in rows]


@pytest.mark.parametrize("rows", [[], CASES["null and empty"], TOGETHER], ids=["empty table", "no words", "all cases"])
def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "clash", "clash", "clash") for d, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in without_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == expected(rows)


def test_null_id_sorts_last(spark):
    df = spark.createDataFrame([(None, words(0, 30)), (4, words(0, 30))], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in without_repeats(df).collect()}
    assert got == {None: 30, 4: 0}


def mosaic(k):
    """Documents made of parts of a few passages of a small vocabulary: edges repeat, branch and join."""
    rng = random.Random(4)
    some = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    base, rows = [some(rng.randint(5, 60)) for _ in range(8)], []
    for n in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            passage = rng.choice(base)
            lo = rng.randint(0, len(passage) - 1)
            text += passage[lo : lo + rng.randint(1, 60)] + some(rng.randint(0, 5))
        rows.append((n * 3 % 61, " ".join(text)))
    return rows


def test_words_that_repeat_at_once_are_one_run(spark):
    df = spark.createDataFrame([(1, "x " * 500), (2, "y " + "x " * 300), (3, "a b c " * 100)], "doc_id bigint, text string")
    assert {r.id: len(r.start) for r in runs(df).collect()} == {1: 2, 2: 2, 3: 2}


@pytest.mark.parametrize("hash_bits", [64, 8])
def test_mosaic(spark, hash_bits):
    """With 8 bits most edges collide, and are assigned to their true sources by their words."""
    rows = mosaic(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r) for r in without_repeats(df, 5, hash_bits).collect())
    assert got == expected(rows, 5)


def test_paths_are_the_graphs_nonbranching_ones(spark):
    k, rows = 5, mosaic(5)
    found = runs(spark.createDataFrame(rows, "doc_id bigint, text string"), k)
    each = found.where("size(start) > 0").select("id", "key", F.explode(F.arrays_zip("start", "edges", "source", "source_start")).alias("r")).select("id", "key", "r.*")
    assert each.where("id = source and start != source_start").count() > 5
    docs, got = {d: t.split() for d, t in rows}, {}
    for r in compacted(found, each).collect():
        for n in range(r.edges):
            got.setdefault((r.path.doc, r.path.at), {})[r["shift"] + n] = tuple(docs[r.doc][r.at + n : r.at + n + k])
    held = {}
    for words_ in docs.values():
        for n in range(len(words_) - k + 1):
            held[tuple(words_[n : n + k])] = held.get(tuple(words_[n : n + k]), 0) + 1
    after, before = {}, {}
    for words_ in docs.values():
        for n in range(len(words_) - k):
            x, y = tuple(words_[n : n + k]), tuple(words_[n + 1 : n + 1 + k])
            if held[x] > 1 and held[y] > 1:
                after.setdefault(x, set()).add(y)
                before.setdefault(y, set()).add(x)
    follows = {x: next(iter(ys)) for x, ys in after.items() if len(ys) == 1 and len(before[next(iter(ys))]) == 1}
    led = set(follows.values())
    want = []
    for x in (e for e, n in held.items() if n > 1 and e not in led):
        path = [x]
        while path[-1] in follows:
            path.append(follows[path[-1]])
        want.append(path)
    assert sorted([p[n] for n in range(len(p))] for p in got.values()) == sorted(want) and max(map(len, want)) > 10
