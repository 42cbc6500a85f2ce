import hashlib
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import corroborate as C
from plumbline.operators import facts, models, paired, records
from plumbline.plans import control

EVENT = "entity_id string, entity_name string, entity_type string, attribute string, old_value string, new_value string, effective_ts timestamp, observed_ts timestamp, source_url string, source_type string, resolver_id string, attester_id string, authority_family string, compliance_source_id string, aliases array<string>, distribution_rights_confirmed boolean, line_no int"
DAY = datetime(2026, 7, 29)


def event(n, entity="E1", value="Alex Example", old="Old", resolver="r1", attester="a1", family="sec", effective=DAY, attribute="ceo_of"):
    return (entity, "Acme", "company", attribute, old, value, effective, datetime(2026, 7, 30, n), f"https://x{n}.org/", "t", resolver, attester, family, "s", [" A. Example "], True, n)


def test_build_rows(spark):
    events = [event(1), event(2, resolver="r2", attester="a2", family="pub", value="alex example"), event(3, "E2"), event(4, "E3"), event(5, "E3", resolver="r2", attester="a2", old=None), event(6, "E4", attribute="zz"), event(7, "E4", attribute="zz", resolver="r2", attester="a2", effective=datetime(2027, 1, 1))]
    df = spark.createDataFrame(events, EVENT)
    rows, rejected = facts.build_rows(df, "f", "dev", F.lit("2026-07-30 16:00:00").cast("timestamp"))
    got = rows.collect()
    assert len(got) == 1 and got[0].question == "Who is the CEO of Acme?" and got[0].recency_rung == "24h_72h" and got[0].authority_families == ["pub", "sec"] and got[0].answer_aliases == ["A. Example", "alex example"]
    reasons = {r.agreement_key[0]: r.reasons for r in rejected.collect()}
    assert reasons == {"e2": ["insufficient_resolvers", "insufficient_attesters"], "e3": ["old_value_disagreement"], "e4": ["unsupported_attribute", "effective_ts_disagreement"]}
    assert spark.createDataFrame([event(1, value="old ")], EVENT).transform(facts.invalid_reasons).first().invalid == ["no_transition"]


@pytest.mark.parametrize("bins", [None, 59])
def test_pair_within(spark, bins):
    left = spark.createDataFrame([("c", date(2026, 7, 1), "f1"), ("c", date(2026, 7, 20), "f2"), ("d", date(2026, 7, 1), "g")], "cik string, day date, f string")
    right = spark.createDataFrame([("c", date(2026, 6, 17), "r1"), ("c", date(2026, 6, 16), "r2"), ("c", date(2026, 8, 15), "r3"), ("c", date(2026, 8, 16), "r4"), ("x", date(2026, 7, 1), "r5")], "cik string, day date, r string")
    got = {x.r: x.paired for x in facts.pair_within(left, right, "cik", "day", "day", "f", "r", bin_days=bins).collect()}
    assert got == {"r1": ["f1"], "r3": ["f1", "f2"], "r4": ["f2"]}


def test_reconcile(spark):
    t = lambda h: datetime(2026, 5, 1, h)
    cands = spark.createDataFrame([("a", "1", "fa", "soccer", t(10), t(14), 2, 1), ("b", "1", "fb", "soccer", t(11), t(15), 1, 2), ("a", "2", "fa", "soccer", t(10), t(14), 0, 0), ("b", "2", "fb", "soccer", t(18), t(20), 1, 0)], "resolver_id string, source_event_id string, authority_family string, sport string, event_start_ts timestamp, observed_ts timestamp, home_score int, away_score int")
    decisions = spark.createDataFrame([("d1", True, t(13), [("a", "1", False), ("b", "1", True)]), ("d2", True, t(13), [("a", "2", False), ("b", "2", False)]), ("d3", False, t(13), [])], "decision_id string, approved boolean, effective_ts timestamp, observations array<struct<resolver_id:string,source_event_id:string,reverse_teams:boolean>>")
    got = {r.decision_id: (r.final_score, r.reasons) for r in facts.reconcile_results(decisions, cands).collect()}
    assert got["d1"] == ("2-1", []) and got["d2"][1] == ["start_spread", "effective_outside", "score_disagreement"] and "d3" not in got


TEXTS = {
    "On June 29, 2026, the Board appointed Stephen R. Curley as Chief Executive Officer of the Company, effective July 6, 2026.": None,
    "The Company thanks its people.": "name_not_found",
    "By: /s/ Stephen Curley Title: Chief Executive Officer Date: July 6, 2026": "signature_block_only",
    "Stephen Curley was present on July 6, 2026.": "role_phrase_absent",
    "Effective July 6, 2026, Stephen Curley was appointed as Chief Financial Officer of the Company.": "another_office_is_closer",
    "Stephen Curley is Chief Executive Officer. Pay was agreed on July 6, 2026.": "appointment_not_described",
    "The Board appointed Stephen Curley as Chief Executive Officer last week.": "date_not_stated",
    "Stephen Curley was appointed as Chief Executive Officer, commencing August 24, 2026. He signed on July 6, 2026.": "commences_after_event_date",
    "Effective July 6, 2026, Stephen Curley was appointed as Chief Executive Officer of Inflection Point.": "role_phrase_absent",
    "The Board appointed Stephen Curley as Interim Chief Executive Officer, effective July 6, 2026.": "role_phrase_absent",
}


MORE = [  # text, owner, role, reason, basis, spelling
    ("On 6 July 2026 the Board named Mr. Curley, Stephen as Chair.", "Curley Stephen", "chairperson_of", None, "appointment_cue", None),
    ("Stephen Curley retired. Ann Lee was appointed Chief Executive Officer, effective 2026-07-06.", "Curley Stephen", "ceo_of", "role_phrase_absent", None, None),
    ("Stephen Curley was appointed Chief Executive Officer of our subsidiary on 07/06/2026.", "Curley Stephen", "ceo_of", "role_phrase_absent", None, None),
    ("Stephen Curley, Chief Executive Officer, was elected. " + "x" * 300 + " It rained on July 6, 2026. " + "y" * 300, "Curley Stephen", "ceo_of", "date_not_marked_effective", None, None),
    ("STEPHEN É. CURLEY was hired as C.F.O. of the Bank, with effect from July 06, 2026", "Curley Stephen É.", "cfo_of", None, "effective_cue", "STEPHEN É. CURLEY"),
    ("Chief Operating Officer Stephen Curley joined on July 6, 2026.", "Curley Stephen", "coo_of", None, "appointment_cue", "Stephen Curley"),
    ("Chief Operating Officer Stephen Curley joined on July 6, 2026.", "Curley Stephen", "president_of", "unsupported_attribute", None, None),
    ("Chief Operating Officer Stephen Curley joined on July 6, 2026.", "Curley", "coo_of", "name_not_found", None, None),
    ("Curley and, in the words of a long account of the meeting of the board, Stephen", "Curley Stephen", "ceo_of", "name_not_found", None, None),
    (None, "Curley Stephen", "ceo_of", "name_not_found", None, None),
    ("Vice Chair Stephen Curley was elected on July 6, 2026.", "Curley Stephen", "chairperson_of", "role_phrase_absent", None, None),
    ("Stephen Curley was named Chief Executive Officer. He was made Chief Financial Officer as of August 1, 2026. This is as of July 6, 2026.", "Curley Stephen", "ceo_of", None, "effective_cue", "Stephen Curley"),
]


def test_confirmations(spark):
    rows = [(n, t, "Curley Stephen Russell", "ceo_of", date(2026, 7, 6), "Eagle Bancorp Inc") for n, t in enumerate(TEXTS)]
    rows += [(100 + n, t, o, r, date(2026, 7, 6), "Eagle Bancorp Inc") for n, (t, o, r, *_) in enumerate(MORE)]
    got = {r.n: r.confirmation for r in C.corroborate(spark.createDataFrame(rows, "n int, text string, owner string, role string, day date, issuer string")).collect()}
    assert [got[n].reason for n in range(len(TEXTS))] == list(TEXTS.values())
    assert [(got[100 + n].reason, got[100 + n].date_basis, got[100 + n].spelling) for n in range(len(MORE))] == [tuple(m[3:]) for m in MORE]
    assert all(got[n].ok == (got[n].reason is None) for n in got)
    first, text = got[0], list(TEXTS)[0]
    assert first.evidence_sha256 == hashlib.sha256(text[first.evidence_start : first.evidence_end].encode()).hexdigest() and first.date_form == "July 6, 2026"


def test_spans(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab. ;AÉ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.spans(F.col("t"), "[ab]+").alias("s"), *[F.struct(*C.sentence(F.col("t"), F.lit(at))).alias(f"at{at}") for at in (0, 7, 30)]).collect()
    for r in out:
        assert [(s.start, s.end, s.hit) for s in r.s] == [(*m.span(), m.group()) for m in re.finditer("[ab]+", r.t)]
        ends = [m.span() for m in re.finditer(C.SENTENCE_END, r.t)]
        for at in (0, 7, 30):
            if at < len(r.t):
                want = max([b for _, b in ends if b <= at], default=0), min([a + 1 for a, _ in ends if a >= at], default=len(r.t))
                assert tuple(r[f"at{at}"]) == want, (r.t, at)


def test_corroborate_and_ledger(spark):
    rows = [(f"k{n // 2}", n, t, "Curley Stephen Russell", "ceo_of", date(2026, 7, 6), "Eagle Bancorp") for n, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "k string, n int, text string, owner string, role string, day date, issuer string")
    confirmed, rest = C.ledger(C.corroborate(df), "k", "n")
    assert [r.k for r in confirmed.collect()] == ["k0"]
    assert {r.k: (r.reason, r.furthest_reason) for r in rest.collect()}["k1"] == ("signature_block_only", "role_phrase_absent")


def test_models_match_closed_forms(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    g = np.repeat(np.arange(60), rng.integers(3, 9, 60))
    x = rng.normal(size=len(g))
    y = 1 + 2 * x + rng.normal(0, 1.5, 60)[g] + rng.normal(size=len(g))
    b = (rng.random(len(g)) < 1 / (1 + np.exp(-(0.3 + x)))).astype(int)
    df = spark.createDataFrame([(int(a), float(c), float(d), int(e)) for a, c, d, e in zip(g, x, y, b)], "g int, x double, y double, b int").repartition(3)
    X = np.stack([np.ones_like(x), x], 1)
    fit = models.ols(df, "y", ["intercept", "x"], "g")
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert fit.beta == pytest.approx(beta)
    u = y - X @ beta
    s = np.array([X[g == k].T @ u[g == k] for k in range(60)])
    inv = np.linalg.inv(X.T @ X)
    assert fit.cov == pytest.approx(inv @ (s.T @ s) @ inv * 60 / 59 * (len(g) - 1) / (len(g) - 2))
    mixed = models.lmm(df, "y", ["intercept", "x"], "g")
    V = np.eye(len(g)) * mixed.extra["sigma2"] + (g[:, None] == g[None]) * mixed.extra["tau2"]
    Vi = np.linalg.inv(V)
    assert mixed.beta == pytest.approx(np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y), rel=1e-6)
    assert 1.0 < mixed.extra["tau2"] < 4.5 and 0.7 < mixed.extra["sigma2"] < 1.4
    logit = models.logistic(df, "b", ["intercept", "x"])
    mu = 1 / (1 + np.exp(-X @ logit.beta))
    assert X.T @ (b - mu) == pytest.approx(np.zeros(2), abs=1e-6)
    gee = models.gee_logit(df, "b", ["intercept", "x"], "g")
    assert gee.beta == pytest.approx(logit.beta, abs=0.1) and abs(gee.extra["rho"]) < 0.2
    assert models.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and models.chi2_sf(30.0, 4) == pytest.approx(4.894e-6, rel=1e-3)


def test_reversal_swaps_wins(spark):
    d = spark.createDataFrame([("a", n, "c", float(v)) for n, v in enumerate([1, 1, 0, -1, 2])], "contrast string, task_key int, category string, diff double")
    e = paired.reversed_effects(paired.paired_effects(d)).first()
    assert (e.effect, e.wins, e.ties, e.losses) == (-0.6, 1, 1, 3)


def test_merged_scores_null_overrides(spark):
    rows = spark.createDataFrame([("c", "r1"), ("c", "r2")], "condition string, root_span_id string")
    m = [spark.createDataFrame([("c", "r1", v)], "condition string, root_span_id string, scores map<string,double>") for v in ({"qa": 1.0, "x": 2.0}, {"qa": None})]
    got = {r.root_span_id: (r.qa, r.x) for r in records.merged_scores(rows, m, ["condition", "root_span_id"], ["qa", "x"]).collect()}
    assert got == {"r1": (None, 2.0), "r2": (None, None)}


def test_normalize_records(spark):
    raw = [("m::none", None, None, None, "true", '{"qa": 0.5}', '{"task_key": "t1", "benchmark_category": ""}', "{}", '{"final_answer": "two words"}', "{}", 1), (None, "k2", None, None, "null", '{"qa": 0.25}', '{"model": "m", "search_mode": "none"}', '{"total_cost_usd": 2}', "{}", "{}", 2), ("c", "k3", None, None, '"0.7"', "{}", "{}", "{}", "{}", "{}", 3)]
    df = spark.createDataFrame(raw, "condition string, task_key string, dataset_record_id string, dataset_row_id string, score string, scores string, metadata string, metrics string, output string, input string, line_no int")
    for c in ("score", "scores", "metadata", "metrics", "output", "input"):
        df = df.withColumn(c, F.parse_json(c))
    got = {r.line_no: r for r in records.normalize_records(df, "qa").collect()}
    assert set(got) == {1, 2} and got[1].score == 1.0 and got[1].task_key == "t1" and got[1].answer_words == 2 and got[1].category == "uncategorized"
    assert got[2].condition == "m::no_search" and got[2].total_cost_usd == 2.0 and got[2].task_key == "k2"


def test_control():
    plan = control.matrix([("v1", "m1"), ("v2", "m2")], ["normalized", "wide"], {"v2"})
    assert [c.label for c in plan] == ["m1::none", "m1::normalized", "m1::wide", "m2::none", "m2::normalized", "m2::wide", "m2::native"]
    assert sorted(control.seeded_order(plan, "s"), key=str) == sorted(plan, key=str) and control.seeded_order(plan, "s") == control.seeded_order(plan[::-1], "s")
    assert control.next_condition(plan, [plan[1]]).label == "m2::none"
    assert control.fingerprint(plan, {"max_concurrency": 1}) == control.fingerprint(plan, {"max_concurrency": 2})
