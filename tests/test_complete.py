"""Roots over several batches, replays and late corrections."""

import json

from pyspark.sql import Row

from plumbline.sources import versions
from plumbline.streaming import complete

SCHEMA = "root_span_id string, name string, score double, at bigint"


def test_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, mark = f"file://{tmp_path}/t", f"{tmp_path}/mark"

    def arrive(n, rows):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("root_span_id", "name", "score", "at"), r, strict=True))) for r in rows))

    def run(checkpoint=mark):
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        complete.into_table(complete.complete_roots(stream, ["a", "b"]), path, checkpoint).awaitTermination()
        return {r.root_span_id: dict(zip(r.names, r.scores, strict=True)) for r in versions.read(spark, path).collect()} if versions.versions(spark, path) else {}

    arrive(1, [("x", "a", 1.0, 1), ("y", "b", 2.0, 2), ("z", "c", 9.0, 3)])
    assert run() == {}
    arrive(2, [("x", "b", None, 5), ("x", "a", 0.5, 4), ("y", "b", 3.0, 1)])
    assert run() == {"x": {"a": 0.5, "b": None}}
    arrive(3, [("y", "a", 7.0, 9), ("x", "a", 0.1, 2), ("z", "a", 1.0, 4)])
    assert run() == {"x": {"a": 0.5, "b": None}, "y": {"a": 7.0, "b": 2.0}}
    arrive(4, [("x", "c", 4.0, 12)])
    want = {"x": {"a": 0.5, "b": None, "c": 4.0}, "y": {"a": 7.0, "b": 2.0}}
    assert run() == want
    before = versions.versions(spark, path)
    assert run() == want and versions.versions(spark, path) == before  # nothing new: nothing written
    assert run(f"{tmp_path}/other") == want  # everything again, from the start: the same rows


def test_state_is_read_and_written_once():
    """A root's state is one value, whatever the number of its spans."""
    calls = []

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return Held()

    one = complete.Completing(["a", "b"])
    one.init(Handle())
    spans = lambda *rows: iter([Row(root_span_id="x", name=n, score=s, at=at) for n, s, at in rows])
    assert list(one.handleInputRows(("x",), spans(("a", 1.0, 1), ("a", 2.0, 3), ("c", 5.0, 2)), None)) == []
    assert list(one.handleInputRows(("x",), spans(("b", None, 4), ("a", 0.0, 2)), None)) == [Row(root_span_id="x", names=["a", "b", "c"], scores=[2.0, None, 5.0])]
    assert calls == ["update", "get", "update"]
