from datetime import date

from plumbline.llm.urlfilter import intervals, judge_urls

EVENTS = "kind string, entry string, action string, day date, seq int"
D = lambda m, d=1: date(2024, m, d)
LIST = [
    ("domain", "bad.org", "add", D(2), 1), ("domain", "bad.org", "remove", D(4), 2), ("domain", "bad.org", "add", D(6), 3), ("domain", "bad.org", "add", D(7), 4),
    ("domain", "Day.net", "add", D(3), 5), ("domain", "day.net", "remove", D(3), 6), ("prefix", "ok.com/a/b", "add", D(1), 7), ("domain", None, "add", D(1), 8), ("domain", "x.y", "add", None, 9), ("domain", "gone.io", "remove", D(1), 10),
]


def test_intervals(spark):
    got = sorted((r.entry, r.since, r.until) for r in intervals(spark.createDataFrame(LIST, EVENTS)).collect())
    assert got == [("bad.org", D(2), D(4)), ("bad.org", D(6), None), ("ok.com/a/b", D(1), None)]


CASES = [
    ("http://bad.org/", D(2), False), ("http://bad.org/", D(1, 31), True), ("http://u:p@x.BAD.org:80/q?z#f", D(3, 31), False), ("http://bad.org", D(4), True), ("http://bad.org", D(5), True), ("http://bad.org", D(8), False), ("http://xbad.org/", D(8), True),
    ("https://day.net/", D(3), True), ("https://ok.com/a/b", D(5), False), ("https://ok.com/A/b/c.html", D(5), False), ("https://ok.com/a/bc", D(5), True), ("https://sub.ok.com/a/b", D(5), True), ("https://ok.com/a", D(5), True),
    (None, D(5), True), ("", D(5), True), ("not a url bad.org", D(8), True), ("http://bad.org/", None, True), ("http://bad.org/" + "x/" * 3000, D(8), False), ("http://bad.org/", D(8), False), ("http://bad.org/", D(8), False),
]


def test_captures(spark):
    df = spark.createDataFrame([(n, u, f, "c", "c") for n, (u, f, _) in enumerate(CASES)] + [(None, "http://bad.org", D(8), "c", "c")], "page_id bigint, url string, fetched date, key string, host string")
    got = {r.page_id: r for r in judge_urls(df, spark.createDataFrame(LIST, EVENTS)).collect()}
    assert [got[n].allowed for n in range(len(CASES))] == [ok for _, _, ok in CASES]
    assert got[None].entry == "domain:bad.org" and got[9].entry == "prefix:ok.com/a/b"
    assert all(r.allowed for r in judge_urls(df, spark.createDataFrame([], EVENTS)).collect())
    assert judge_urls(df.limit(0), spark.createDataFrame(LIST, EVENTS)).collect() == []


FORMS = [
    ("prefix", "whole.com", "http://whole.com/any/x", True), ("prefix", "whole.com", "http://www.whole.com/", False), ("prefix", "slash.com/en/", "http://slash.com/en", True), ("prefix", "slash.com/en/", "http://slash.com/english", False),
    ("domain", "dot.org.", "http://dot.org/", True), ("domain", "*.star.org", "http://a.star.org/", True), ("domain", ".lead.org", "http://lead.org./", True), ("prefix", "https://u@port.net:8080/a//b?q#f", "http://port.net/a/b/c", True),
    ("domain", "port.io:80", "http://port.io/", True), ("domain", "[::1]", "http://[::1]/x", True), ("domain", "[::1]", "http://[::1]:80/x", True), ("prefix", "[::2]/a", "http://[::2]/a/b", True), ("domain", "org", "http://any.org/", True), ("domain", "", "http://x.de/", False), ("prefix", "/only", "http://x.de/only", False), ("other", "y.de", "http://y.de/", False),
]


def test_forms_of_entries(spark):
    from pyspark.sql import functions as F

    from plumbline.llm.urlfilter import normal_entry

    rows = spark.createDataFrame(FORMS, "kind string, entry string, url string, match boolean")
    entries = [r.e for r in rows.select(normal_entry(F.col("kind"), F.col("entry")).alias("e")).collect()]
    assert entries[:4] == ["whole.com", "whole.com", "slash.com/en", "slash.com/en"] and entries[7] == "port.net/a/b"
    # forms of different hosts do not meet, so one list serves all
    events = spark.createDataFrame([(k, e, "add", D(1), n) for n, (k, e, _, _) in enumerate(FORMS) if e != "org"], EVENTS)
    captures = spark.createDataFrame([(n, u, D(5)) for n, (_, _, u, _) in enumerate(FORMS)], "page_id bigint, url string, fetched date")
    got = {r.page_id: not r.allowed for r in judge_urls(captures, events).collect()}
    assert [got[n] for n in range(len(FORMS))] == [m and e != "org" for _, e, _, m in FORMS]
    assert not judge_urls(captures, spark.createDataFrame([("domain", "org", "add", D(1), 1)], EVENTS)).where("page_id = 12").first().allowed
