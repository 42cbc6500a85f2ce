"""Tables in versions: merges by id, failures between the steps, writers at the same time."""

import random

import pytest

from plumbline.sources import files, versions

SCHEMA = "id bigint, part string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, p, v) for i, (p, v) in rows.items()], SCHEMA)


def held(spark, path, version=None):
    return {r.id: (r.part, r.v) for r in versions.read(spark, path, version).collect()}


def test_merges_against_a_dict(spark, tmp_path):
    path, rng, want, states = f"file://{tmp_path}/t", random.Random(2), {}, {}
    for _ in range(5):
        change = {rng.randint(-30, 60): (rng.choice("ab"), rng.choice(["x", "y", None])) for _ in range(20)}
        want = want | change
        states[versions.upsert(frame(spark, change), path, ["id"], buckets=4)] = dict(want)
        gone = rng.sample(sorted(want), 3)
        versions.delete(spark.createDataFrame([(g,) for g in gone], "id bigint"), path)
        want = {i: v for i, v in want.items() if i not in gone}
        assert held(spark, path) == want
    assert all(held(spark, path, n) == s for n, s in states.items()) and versions.versions(spark, path) == list(range(1, 11))
    some = sorted(want)[:4]
    assert {r.id for r in versions.lookup(spark.createDataFrame([(i,) for i in [*some, 999]], "id bigint"), path).collect()} == set(some)
    assert versions.vacuum(spark, path, keep=2) and versions.versions(spark, path) == [9, 10] and held(spark, path) == want and held(spark, path, 9) == states[9]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.upsert(frame(spark, {i: ("a", str(i)) for i in range(200)}), path, ["id"], buckets=8)
    before = versions.state(spark, path)["folders"]
    versions.upsert(frame(spark, {7: ("b", "new")}), path, ["id"])
    after = versions.state(spark, path)["folders"]
    assert len(before) == len(after) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert held(spark, path) == {i: ("a", str(i)) for i in range(200)} | {7: ("b", "new")}
    # a third of a partition's rows changes: the others of this partition stay
    versions.upsert(frame(spark, {i: ("a", "third") for i in range(0, 200, 3)}), path, ["id"])
    assert held(spark, path)[1] == ("a", "1") and held(spark, path)[7] == ("b", "new") and held(spark, path)[3] == ("a", "third")


def test_failure_before_the_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.replace(frame(spark, {1: ("a", "old")}), path)
    seen = []

    def crash(spark, path_, before, after):
        seen.append(held(spark, path))  # a reader between the steps
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", crash)
        with pytest.raises(OSError):
            versions.replace(frame(spark, {2: ("b", "new")}), path)
    assert seen == [{1: ("a", "old")}] and held(spark, path) == {1: ("a", "old")}
    versions.replace(frame(spark, {3: ("c", "next")}), path)
    assert held(spark, path) == {3: ("c", "next")} and held(spark, path, 1) == {1: ("a", "old")}
    assert len(versions.vacuum(spark, path)) == 2 and held(spark, path) == {3: ("c", "next")}


def test_two_writers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.upsert(frame(spark, {1: ("a", "x")}), path, ["id"])
    laid = versions._laid

    def slow(rows, path_):
        out = laid(rows, path_)
        monkeypatch.setattr(versions, "_laid", laid)
        versions.upsert(frame(spark, {2: ("b", "fast")}), path, ["id"])
        return out

    monkeypatch.setattr(versions, "_laid", slow)
    with pytest.raises(versions.Conflict):
        versions.upsert(frame(spark, {3: ("c", "slow")}), path, ["id"])
    assert held(spark, path) == {1: ("a", "x"), 2: ("b", "fast")}


def test_ids(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    twice = spark.createDataFrame([(1, "a", "b"), (1, "c", "a")], SCHEMA)
    for bad in (twice, spark.createDataFrame([(None, "a", "x")], SCHEMA)):
        with pytest.raises(Exception, match="repeated id 1|null id"):
            versions.upsert(bad, path, ["id"])
    assert versions.versions(spark, path) == []
    versions.upsert(twice, path, ["id"], order="part")
    assert held(spark, path) == {1: ("c", "a")}
    with pytest.raises(ValueError, match="has the key"):
        versions.upsert(twice, path, ["part"])
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{path}-other")
    versions.delete(spark.createDataFrame([(1,)], "id bigint"), path)
    assert held(spark, path) == {}
    versions.upsert(frame(spark, {4: ("d", None)}), path, ["id"])
    assert held(spark, path) == {4: ("d", None)}


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    assert files.create_text(spark, path, "one") and not files.create_text(spark, path, "two")
    assert files.read_text(spark, path) == "one"
    files.write_text(spark, path, "three é")
    assert files.read_text(spark, path) == "three é" and files.names(spark, f"file://{tmp_path}/none") == []
