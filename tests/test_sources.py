import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import analyze, build_facts
from plumbline.operators import records
from plumbline.sources import adapters, readers, versions, writers
from plumbline.streaming import ingest


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": "x"}\n{broken\n')
    good, bad = readers.checked_jsonl(spark, str(p), "a int")
    assert [r.a for r in good.collect() if r.a is not None] == [1] and bad.count() >= 1
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), "a int").collect()
    assert {r.split for r in readers.release(spark, str(tmp_path), "a int").collect()} == {"a"}
    assert [r.line_no for r in readers.numbered_lines(spark, str(p)).collect()] == [0, 2, 3]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("CIK1.json", json.dumps({"cik": 1}))
        z.writestr("CIK2.json", json.dumps({"x": 2}))
        z.writestr("big.json", json.dumps({"cik": "x" * 500}))
        z.writestr("n.txt", "no")
    got = {r.member: r.too_large for r in readers.zipped_json(spark, str(tmp_path / "b.zip"), need="cik", limit=200).collect()}
    assert got == {"CIK1.json": False, "big.json": True}
    assert readers.zipped_json(spark, str(tmp_path / "b.zip"), members=["CIK2.json"]).count() == 1


def test_parallel_arrays_and_filter(spark):
    df = spark.createDataFrame([("c", (["8-K", "8-K", "10-K"], ["5.02,9.01", "15.02", "5.02"], ["2026-07-01", "2026-07-02", "2026-07-03"]))], "cik string, recent struct<form:array<string>,items:array<string>,filing_date:array<string>>")
    rows = readers.parallel_arrays(df, "recent", ["form", "items", "filing_date"]).withColumn("filing_date", F.col("filing_date").cast("date"))
    assert rows.count() == 3 and readers.item_filings(rows, "8-K", "5.02", "2026-07-01", "2026-07-01").count() == 1
    bad = spark.createDataFrame([("c", (["8-K"], [], []))], df.schema)
    with pytest.raises(Exception):
        readers.parallel_arrays(bad, "recent", ["form", "items", "filing_date"]).collect()


XML = "<ownershipDocument><documentType>3</documentType><periodOfReport><value>2026-07-06-05:00</value></periodOfReport><issuer><issuerCik>12</issuerCik><issuerName>Acme</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik><rptOwnerName>Cole Amanda</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>true</isOfficer><isDirector>0</isDirector><officerTitle>{}</officerTitle></reportingOwnerRelationship></reportingOwner></ownershipDocument>"


def test_ownership(spark):
    r = readers.ownership(spark.createDataFrame([(XML.format("CEO"),)], "xml string")).first()
    assert (r.issuer_cik, r.owner_cik, str(r.period_of_report), r.is_officer, r.is_director, r.officer_title) == ("0000000012", "0000000007", "2026-07-06", True, False, "CEO")
    with pytest.raises(Exception):
        readers.ownership(spark.createDataFrame([(XML.format(" "),)], "xml string")).collect()


def test_feeds(spark):
    m = spark.createDataFrame([("m", True, [(1, 1, 0, 0), (2, 1, 2, 1)]), ("n", False, [(1, 1, 0, 0)])], "id string, finished boolean, results array<struct<order:int,type:int,home:int,away:int>>")
    assert [(r.id, r.home_score, r.away_score) for r in readers.finished_matches(m).collect()] == [("m", 2, 1)]
    rev = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("z", 1, "q")], "k string, n int, body string")
    assert [(r.k, r.after, r.before) for r in readers.last_two(rev, "k", "n", "body").collect()] == [("k", "c", "b")]


def test_adapters(spark):
    section = "array<struct<url:string,title:string,description:string,snippets:array<string>,highlights:array<string>,page_age:string>>"
    item = lambda u: (u, "t", "d", ["s"], None, "2024-01-01")
    df = spark.createDataFrame([(1, [item("w1"), item("w2"), item("w3")], [item("n1")])], f"row_id int, web {section}, news {section}")
    got = adapters.sectioned_results(df).first().results
    assert [(r.rank, r.url) for r in got] == [(1, "w1"), (2, "n1"), (3, "w2"), (4, "w3")] and got[1].date_semantics == "publication" and got[0].snippet == "s"
    assert adapters.sectioned_results(df).select(adapters.rendered(F.col("results")).alias("t")).first().t.startswith("[1] t\nw1")
    acts = spark.createDataFrame([(1, [("search", "q", ["u1", "u2"]), ("open_page", None, None), ("find", None, None)], [("u1", ""), ("u1", "Title")])], "row_id int, actions array<struct<type:string,query:string,sources:array<string>>>, citations array<struct<url:string,title:string>>")
    r = adapters.action_searches(acts).first()
    assert (r.searches, r.opened, r.found) == (1, 1, 1) and [x.title for x in r.trajectory[0].results] == ["Title", ""]
    b = spark.createDataFrame([(1, [("server_tool_use", "i1", None, "q", None, None), ("web_search_tool_result", None, "i1", None, "max_uses", None)])], "row_id int, blocks array<struct<type:string,id:string,tool_use_id:string,query:string,error:string,results:array<string>>>")
    assert [(x.query, x.error, x.results) for x in adapters.block_searches(b).collect()] == [("q", "max_uses", None)]


def test_spans(spark):
    roots = spark.createDataFrame([("r1", ("dataset", "o", "d1"), {"start": 1.0, "cost": 1.0}, None), ("r2", ("dataset", "o", "d2"), {}, None), ("r3", ("log", "o", "d3"), {}, None)], "root_span_id string, origin struct<object_type:string,object_id:string,id:string>, metrics map<string,double>, scores map<string,double>")
    scorers = spark.createDataFrame([("r1", {"a": 1.0}, 1), ("r1", {"a": None, "b": 2.0}, 2), ("r2", {"a": 1.0}, 3), ("r3", {"a": 1.0, "b": 1.0}, 4)], "root_span_id string, scores map<string,double>, line_no int")
    tasks = spark.createDataFrame([("r1", {"cost": 5.0})], "root_span_id string, metrics map<string,double>")
    got = records.export_roots(roots, scorers, tasks, ["a", "b"]).collect()
    assert len(got) == 1 and got[0].scores == {"a": None, "b": 2.0} and got[0].metrics == {"start": 1.0, "cost": 5.0}
    with pytest.raises(Exception):
        records.export_roots(roots, scorers, tasks.union(tasks), ["a", "b"]).collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for f in (lambda: records.unique_or_fail(df, ["k"]), lambda: records.single_valued(df, "v"), lambda: records.one_to_one(df, df, ["k"])):
        with pytest.raises(Exception):
            f().collect()
    assert records.error_summary(spark.createDataFrame([], "error string")).first().rate == 1.0
    problems = records.audit_release(df.withColumn("answer", F.lit("https://x")), "k", ["v"], [], ["k"]).collect()
    assert {p.problem for p in problems} == {"url in answer", "repeated k", "banned column answer"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "z int, a string")
    writers.sorted_jsonl(df.unionByName(spark.createDataFrame([(3, None)], df.schema)), str(tmp_path / "j"), "a")
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("*.json")))
    assert text == '{"a":null,"z":3}\n{"a":"a","z":2}\n{"a":"b","z":1}\n'
    writers.manifest(spark, f"file://{tmp_path}/m.json", {"a": "b"}, {"c": 1}, {})
    assert json.loads((tmp_path / "m.json").read_text())["counts"] == {"c": 1}
    none = spark.createDataFrame([], "problem string, n int")
    writers.audited_parquet(df, none, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        writers.audited_parquet(df, spark.createDataFrame([("x", 1)], none.schema), str(tmp_path / "p"))


def test_analyze(spark, tmp_path):
    rows = [{"condition": c, "scores": {"s": (t * k) % 3 / 2}, "metadata": {"task_key": f"t{t}"}, "metrics": {"total_cost_usd": k}} for t in range(30) for k, c in enumerate(["a", "b"])]
    report = analyze(spark, lines(tmp_path / "e.jsonl", rows), "s", "a", None, 200)
    assert "| b - a | 30 |" in report


def test_build_facts(spark, tmp_path):
    e = {"entity_id": "E", "entity_name": "Acme", "entity_type": "c", "attribute": "ceo_of", "new_value": "Alex Example", "effective_ts": "2026-07-29T00:00:00Z", "observed_ts": "2026-07-30T00:00:00Z", "source_url": "https://a.b/", "source_type": "t", "resolver_id": "r1", "authority_family": "sec", "compliance_source_id": "s", "distribution_rights_confirmed": True, "aliases": []}
    path = lines(tmp_path / "f.jsonl", [e, e | {"resolver_id": "r2", "authority_family": "publisher:x"}, e | {"entity_id": "F"}])
    build_facts(spark, path, str(tmp_path / "out"), "f", "dev")
    assert spark.read.json(str(tmp_path / "out/rows")).count() == 1 and spark.read.json(str(tmp_path / "out/rejections")).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "condition string, root_span_id string, score double, at timestamp"
    lines(tmp_path / "in/1.jsonl", [{"condition": "a", "root_span_id": "x", "score": 1.0, "at": "2024-01-01T00:00:00Z"}, {"condition": "b", "root_span_id": "y", "score": 2.0, "at": "2024-01-01T00:00:00Z"}])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest.upsert_stream(ingest.records_stream(spark, str(tmp_path / "in"), schema), out, mark).awaitTermination()
    lines(tmp_path / "in/2.jsonl", [{"condition": "a", "root_span_id": "x", "score": 5.0, "at": "2024-01-01T00:10:00Z"}, {"condition": "a", "root_span_id": "z", "score": 3.0, "at": "2024-01-01T00:10:00Z"}])
    ingest.upsert_stream(ingest.records_stream(spark, str(tmp_path / "in"), schema), out, mark).awaitTermination()
    assert sorted((r.condition, r.root_span_id, r.score) for r in versions.read(spark, out).collect()) == [("a", "x", 5.0), ("a", "z", 3.0), ("b", "y", 2.0)]
