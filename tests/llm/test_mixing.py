import re
from collections import defaultdict

import pytest

from plumbline.llm.mixing import mix, targets

SCHEMA = "doc_id bigint, text string, source string, size string, bucket int, s string"


def brute_targets(sizes, most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1, None: 50}, {"x": 0, "y": 5}, {"a": 0}, {}, {f"s{n}": (n * n * 37) % 101 for n in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    rows = [(n, None if n % 50 == 3 else "w\x85 " * (n * 7919 % 90), None if n % 11 == 0 else f"s{n % 5 if n % 3 else 0}") for n in range(600)]
    rows += [(1, "a b", "s1"), (1, "a b", "s1"), (None, "x y z", "s2")]
    df = spark.createDataFrame([(a, b, c, "clash", 1, "clash") for a, b, c in rows], SCHEMA)
    out = mix(df).collect()
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes, took, goal, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
        took[r.source] += r.taken
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        # each document is emitted as often as its expected copies, but for less than one
        assert abs(r.copies - r.target / r.source_size) < 1 and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    assert sorted(r["size"] for r in out) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert goal == pytest.approx(brute_targets(sizes))
    for s in sizes:
        assert abs(took[s] - goal[s]) <= largest[s]


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_are_those_of_the_mix(spark):
    from plumbline.llm.mixing import repeated

    rows = [(n, "w " * (n % 40), f"s{n % 4}", "c", 1, None) for n in range(300)] + [(1000, "a b", "s1", None, 1, "x")] * 5 + [(None, "c d", "s2", None, 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = repeated(df)
    assert out.columns == df.columns
    want, got = defaultdict(int), defaultdict(int)
    for r in mix(df).collect():
        want[r.doc_id] += r.copies
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {d: n for d, n in want.items() if n} and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
