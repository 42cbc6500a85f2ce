import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scorers as S
from plumbline.functions import text as T

RESULT = "struct<rank:int,url:string,title:string,snippet:string,published_date:string,date_semantics:string,source:string,oracle_snippet_gold:boolean>"
SCHEMA = f"row_id int, expected array<string>, output struct<final_answer:string,decision_surface:string,used_searches:int,used_clicks:int,trajectory:array<struct<type:string,tokens:double,results:array<{RESULT}>>>>, metadata struct<link:string,articles:array<struct<url:string,link:string>>,event_date:string,date:string,search_budget:int,answer_aliases:array<string>>"


def result(rank=1, url="https://www.a.com/x", snippet="", date=None, semantics=None, source="web", gold=None):
    return (rank, url, "", snippet, date, semantics, source, gold)


def row(n, expected=("Ada Lovelace",), answer="ada", surface=None, searches=1, steps=(), link=None, event=None, aliases=None, budget=None):
    return (n, list(expected), (answer, surface, searches, 0, [("search", 1000.0, list(r)) for r in steps]), (link, None, event, None, budget, aliases))


def scored(spark, rows, *names):
    return {r.row_id: r for r in S.score(spark.createDataFrame(rows, SCHEMA), list(names)).collect()}


def test_answers(spark):
    rows = [
        row(1, ["The Straße"], "STRASSE"), row(2, ["5"], "born 1958"), row(3, ["5"], "it is 5, yes"), row(4, [], "x"), row(5, ["1,000"], "1000 items"),
        row(6, ["x"], "I could not find this."), row(7, ["I could not find this"], "I could not find this."), row(8, ["Steven Oroho Jr"], "Steve Oroho", aliases=["Steve Oroho"]), row(9, ["a b"], ""), row(10, ["the"], "the"),
    ]
    got = scored(spark, rows, "qa_answer_match")
    assert [got[n].qa_answer_match for n in range(1, 11)] == [1.0, 0.0, 1.0, None, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]


def test_surfaces_gate_scores(spark):
    step = [[result(snippet="ada lovelace wrote", date="2024-01-02", semantics="publication"), result(2, "https://b.org/y", "nothing", "2023-12-01", "publication")]]
    rows = [row(n, surface=s, steps=step, link="https://c.net", event="2024-01-01") for n, s in enumerate(["full", "no_snippet", "urls_only", "none", None])]
    got = scored(spark, rows, "leakage_guard", "budget_economy", "dealbreaker_gate", "temporal_grounding", "snippet_sufficiency", "evidence_precision", "token_discounted_gain", "domain_entropy", "compression_redundancy")
    have = lambda c: [got[n][c] is not None for n in range(5)]
    assert have("leakage_guard") == have("budget_economy") == have("domain_entropy") == [True, True, True, False, True]
    assert have("temporal_grounding") == [True, True, False, False, True]
    assert have("snippet_sufficiency") == have("evidence_precision") == have("token_discounted_gain") == [True, False, False, False, True]
    assert have("compression_redundancy") == [False] * 5
    assert got[0].temporal_grounding == 0.5 and got[0].evidence_precision == 0.5
    assert got[0].token_discounted_gain == pytest.approx(math.exp(-500 / 4000)) and got[0].domain_entropy == pytest.approx(1.0)


def test_leakage_and_budget(spark):
    rows = [
        row(1, steps=[[result(url="https://news.src.com/a")]], link="https://www.src.com/z"), row(2, steps=[[result(url="https://xsrc.com/a")]], link="https://src.com"), row(3, steps=[[result(url="https://web.archive.org/a")]], link="https://src.com"),
        row(4, steps=[[]], surface="full", link="https://src.com"), row(5, steps=[[result()]]), row(6, steps=[[result()]], searches=6), row(7, steps=[[result()]], searches=6, budget=9), row(8, steps=[], searches=0),
    ]
    got = scored(spark, rows, "leakage_guard", "budget_economy", "dealbreaker_gate", "gated_answer_match")
    assert [got[n].leakage_guard for n in range(1, 9)] == [0.0, 1.0, 0.0, None, None, None, None, None]
    assert [got[n].budget_economy for n in range(1, 9)] == [1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, None]
    assert got[6].gated_answer_match == 0.0 and got[8].gated_answer_match == 0.0


def test_oracle_label_wins(spark):
    rows = [row(1, steps=[[result(snippet="ada lovelace", gold=False)], [result(3, gold=True), result(2, gold=True)]], surface="full")]
    df = spark.createDataFrame(rows, SCHEMA)
    r = df.select(S.best_gold().alias("b"), S.snippet_sufficiency().alias("s"), S.evidence_precision().alias("p"), S.token_discounted_gain().alias("g")).first()
    assert (r.b.rank, r.b.round, r.s) == (2, 2, 1.0) and r.p == pytest.approx(2 / 3) and r.g == pytest.approx(math.exp(-1500 / 4000))


@pytest.mark.parametrize(("ballots", "grade"), [([], None), (["CORRECT", "CORRECT", "INCORRECT"], "CORRECT"), (["CORRECT", "INCORRECT"], "INCORRECT"), (["NOT_ATTEMPTED", "INCORRECT"], "NOT_ATTEMPTED"), (["CORRECT", "NOT_ATTEMPTED", "INCORRECT", "CORRECT"], "NOT_ATTEMPTED")])
def test_jury(spark, ballots, grade):
    df = spark.createDataFrame([(ballots,)], "b array<string>")
    assert df.select(S.jury(F.col("b"))).first()[0] == grade


def test_registry(spark):
    S.register("answer_length", lambda: F.length("output.final_answer").cast("double"))
    try:
        assert scored(spark, [row(1, answer="abc")], "answer_length")[1].answer_length == 3
    finally:
        S.SCORERS.pop("answer_length")


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


@pytest.mark.parametrize(("title", "office"), [("President & CEO", "ceo_of"), ("Interim CEO", None), ("Co-Chief Executive Officer", None), ("Vice Chairman", None), ("Chairman of the Board of Directors", "chairperson_of"), ("EVP, CFO & Treasurer", "cfo_of"), ("CEO of Acme Europe", None), ("President & CEO, Retail Division", None), ("Chief Operating Officer", "coo_of"), ("", None), (None, None)])
def test_offices(spark, title, office):
    assert one(spark, T.office_of(F.col("t")), t=title) == office


def test_names(spark):
    assert one(spark, T.natural_name(F.col("t")), t="Smith Jr John") == "John Smith Jr"
    assert one(spark, T.natural_name(F.col("t")), t="Cole, Amanda Marie") == "Amanda Marie Cole"
    assert one(spark, T.names_agree(F.col("a"), F.col("b")), a="Amanda M. Cole", b="Cole Amanda Marie") is True
    assert one(spark, T.names_agree(F.col("a"), F.col("b")), a="Cole", b="Cole Amanda") is False
    assert one(spark, T.entity_tokens(F.col("t")), t="OmniAb, Inc.") == ["omniab"]


def test_hosts_and_dates(spark):
    assert one(spark, T.host(F.col("u")), u="https://WWW.Example.com:8080/x") == "example.com"
    assert one(spark, T.host(F.col("u")), u="::bad::") == ""
    assert one(spark, T.authority(F.col("u")), u="https://www.u@b.com:81/x") in ("u@b.com:81", "www.u@b.com:81")
    assert one(spark, F.date_format(T.parsed_time(F.col("d")), "yyyy-MM-dd HH:mm"), d="2024-05-06T01:00:00Z") == "2024-05-06 01:00"
    assert one(spark, T.parsed_time(F.col("d")), d="2024-13-40") is None
    assert one(spark, T.canonical_value(F.col("d")), d=" V1,234  X ") == "1234 x"
    assert one(spark, T.operator_counts(F.col("q")), q='site:a.com "exact phrase" AND well-known -x') == (1, 3)
