import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import wordblocks as W
from plumbline.llm.fingerprints import KEPT, MODULI, SPAN, PrefixHashes, _points, compare_neighbours, fingerprints, likenesses

SCHEMA = "doc_id bigint, text string, id string, key string, range int, extra int"


def test_spans_and_extensions():
    rng = random.Random(1)
    text = "".join(rng.choice("ab漢") for _ in range(400))
    h = PrefixHashes(np.array([ord(c) for c in text], np.uint32))
    for _ in range(300):
        a, b = rng.randrange(400), rng.randrange(400)
        limit = 400 - max(a, b)
        size = rng.randint(0, limit)
        same = h.span(np.array([a]), np.array([size])) == h.span(np.array([b]), np.array([size]))
        assert bool(same[0]) == (text[a : a + size] == text[b : b + size])
        common = 0
        while common < limit and text[a + common] == text[b + common]:
            common += 1
        assert h.extension(np.array([a]), np.array([b]), np.array([limit]))[0] == common


def sketch(text):
    """The least span hashes and where each stands first, by plain arithmetic."""
    def value(span):
        out = []
        for prime, base in MODULI:
            out.append(sum((ord(c) + 1) * pow(base, n, prime) for n, c in enumerate(span)) % prime)
        return int(W.mix(np.array([out[0] << 31 | out[1]], np.uint64))[0]) >> 16

    spans = [text[n : n + SPAN] for n in range(max(1, len(text) - SPAN + 1))] if text else []
    first = {}
    for n, span in enumerate(spans):
        first.setdefault(value(span), n)
    return dict(sorted(first.items())[:KEPT])


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y, in_a, in_b = sketch(a), sketch(b), set(), set()
    for h in x.keys() & y.keys():
        i, j = x[h], y[h]
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while i < len(a) and j < len(b) and a[i] == b[j]:
            in_a.add(i)
            in_b.add(j)
            i, j = i + 1, j + 1
    return (len(in_a) + len(in_b)) / max(1, len(a) + len(b))


def test_likeness_matches_brute_force():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = [base, base[:300] + "zz" + base[320:], "new " + base[100:], base[400:] + base[:400], "short", "short", "", "ab" * 80, "ab" * 40 + "c" + "ab" * 30, "".join(rng.choice("xyz") for _ in range(300)), base[:40]]
    for _ in range(4):
        other = list(base)
        for _ in range(rng.randint(1, 25)):
            other[rng.randrange(600)] = "z"
        texts.append("".join(other))
    points, where = _points(texts)
    hashes = PrefixHashes(points)
    prints = fingerprints(hashes, where)
    for n, text in enumerate(texts):
        assert dict(zip(prints[1][n].tolist(), prints[2][n].tolist())) == sketch(text)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = likenesses(hashes, where, prints, x, y)
    for i, j, value in zip(x, y, got):
        assert value == pytest.approx(brute_likeness(texts[i], texts[j])), (i, j)
    assert got[1] > 0.9 and got[2] > 0.8


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for n, (doc, text) in enumerate(order):
        text, other = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc] = (len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("count", [1, 2, 400])
def test_neighbours(spark, count):
    rng = random.Random(count)
    rows = [(n * n - 50, "".join(rng.choice("aé漢 b") for _ in range(rng.randint(0, 90)))) for n in range(count)]
    if count > 2:
        rows += [(10**15, None), (None, "no id"), (-9, "y" * 300000), (17, rows[3][1])]
    df = spark.createDataFrame([(a, b, "c", "c", 1, 1) for a, b in rows], SCHEMA).repartition(3)
    out = compare_neighbours(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == expected(rows) and len(out) == len(rows)
    prints = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.common_start >= r.n_chars - r.n_chars // 2
        prints.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_many_null_ids(spark):
    rng = random.Random(3)
    rows = [(None, "".join(rng.choice("abcde ") for _ in range(60))) for _ in range(300)] + [(5, "five " * 9), (7, "seven " * 9)]
    out = compare_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(out) == 302 and sorted((r.doc_id for r in out if r.doc_id is not None)) == [5, 7]
    shas = {r.edited_sha256 for r in out if r.doc_id == 7}
    assert shas == {hashlib.sha256(("seven " * 9)[:27].encode() + ("five " * 9)[:27].encode()).hexdigest()}


def test_ties_and_empty(spark):
    rows = [(1, "first text of one"), (1, "second text of one"), (1, "second text of one"), (0, "zero")]
    out = compare_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 1, 1]
    assert compare_neighbours(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
