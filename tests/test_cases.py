"""Text functions on cases whose results follow from their definition."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scorers as S
from plumbline.functions import text as T
from plumbline.operators import facts
from plumbline.sources import adapters

CASES = {}


def fixture(name, ddl, outputs, cases):
    CASES[name] = ddl, outputs, cases


col = F.col
joined = lambda c: F.array_join(c, "|")
day = lambda c: F.date_format(c, "yyyy-MM-dd")

# F32, F33, F34, F48
fixture("person_names", "name string, other string", {
    "natural_name": ("VARCHAR", lambda: T.natural_name(col("name"))), "agreement_key": ("VARCHAR", lambda: joined(T.name_key(col("name")))), "agrees": ("BOOLEAN", lambda: T.names_agree(col("name"), col("other"))),
    "surname": ("VARCHAR", lambda: T.name_tokens(col("name"))["surname"]), "given": ("VARCHAR", lambda: joined(T.name_tokens(col("name"))["given"])),
}, [
    (("Cole, Amanda Jr.", "Amanda Cole"), ("Amanda Cole Jr.", "amanda|cole", True, "cole", "amanda")),
    (("CURLEY STEPHEN RUSSELL", "Stephen Curley"), ("STEPHEN RUSSELL CURLEY", "curley|russell|stephen", True, "curley", "stephen|russell")),
    (("Smith John", "John Smythe"), ("John Smith", "john|smith", False, "smith", "john")),
    (("Madonna", "Madonna"), ("Madonna", "madonna", False, "", "")),
    (("O'Neil, Mary K. III", "Mary O'Neil"), ("Mary K. O'Neil III", "mary|neil", True, "neil", "mary")),
    (("Müller Jörg", "Jörg Peter Müller"), ("Jörg Müller", "jörg|müller", True, "müller", "jörg")),
])

# F35, F36
fixture("officer_roles", "title string", {"office": ("VARCHAR", lambda: T.office_of(col("title"))), "below_issuer": ("BOOLEAN", lambda: T.scoped_below(col("title")))}, [
    (("Chief Executive Officer",), ("ceo_of", False)), (("interim CEO",), (None, False)), (("Co-CEO",), (None, False)), (("former CFO",), (None, False)),
    (("Vice Chairman",), (None, False)), (("Chairman of the Board",), ("chairperson_of", False)), (("CFO of the Company",), ("cfo_of", False)), (("Chief Operating Officer of Europe",), (None, True)),
    (("President",), (None, False)), (("CEO, Europe Division",), (None, True)), (("Chief  Operations Officer",), ("coo_of", False)), (("Deputy Chief Financial Officer",), (None, False)),
    (("Chairman and Chief Executive Officer",), ("ceo_of", False)), (("CFO and COO",), ("cfo_of", False)), (("",), (None, False)),
])

# F37, F38, F39, F40
OFFICIAL = {"sec.gov": "sec"}
fixture("ownership_fields", "flag string, period string, cik string, accession string, document string, url string", {
    "is_set": ("BOOLEAN", lambda: T.is_true_flag(col("flag"))), "period": ("VARCHAR", lambda: day(T.period_date(col("period")))),
    "document_url": ("VARCHAR", lambda: T.document_url(col("cik"), col("accession"), col("document"), "https://archive.example/data/")), "family": ("VARCHAR", lambda: T.authority_family(col("url"), OFFICIAL)),
}, [
    (("1", "2026-07-06-05:00", "0000012345", "0001-26-000007", "xslF345X05/form4.xml", "https://www.sec.gov/x"), (True, "2026-07-06", "https://archive.example/data/12345/000126000007/form4.xml", "sec")),
    ((" Y ", "2026-07-06", "7", "1-2-3", "a.xml", "https://data.sec.gov/"), (True, "2026-07-06", "https://archive.example/data/7/123/a.xml", "sec")),
    (("yes", "July 6", "0100", "1", "p/q/r.xml", "https://News.example.org/a"), (False, None, "https://archive.example/data/100/1/r.xml", "publisher:news.example.org")),
    ((None, None, "5", "9-9", "b.xml", "https://sec.gov.example/"), (False, None, "https://archive.example/data/5/99/b.xml", "publisher:sec.gov.example")),
    (("TRUE", " 2025-12-31Z", "5", "9-9", "b.xml", "http://xsec.gov/"), (True, "2025-12-31", "https://archive.example/data/5/99/b.xml", "publisher:xsec.gov")),
])

# F5, F45, F46, F54, F44
epoch = lambda c: F.unix_seconds(c)
fixture("parsed_times", "told string, wait string, on_day string", {
    "parsed": ("BIGINT", lambda: epoch(T.parsed_time(col("told")))), "zoned": ("BIGINT", lambda: epoch(T.zoned_time(col("told")))),
    "wait_s": ("DOUBLE", lambda: T.retry_seconds(col("wait"), F.lit("2025-01-01 00:00:00").cast("timestamp"))), "midnight": ("BIGINT", lambda: epoch(T.midnight(col("on_day")))),
}, [
    (("2024-05-01", "120", "2024-05-01"), (1714521600, None, 120.0, 1714521600)),
    (("2024-05-01T10:00:00Z", "Wed, 01 Jan 2025 00:01:00 GMT", "1970-01-02"), (1714557600, 1714557600, 60.0, 86400)),
    (("2024-05-01T10:00:00+02:00", "Tue, 31 Dec 2024 00:00:00 GMT", "2000-02-29"), (1714550400, 1714550400, 0.0, 951782400)),
    (("2024-05-01 and more", "-5", None), (1714521600, None, 0.0, None)),
    (("no date", "soon", "2024-01-01"), (None, None, None, 1704067200)),
    ((None, None, "2024-01-01"), (None, None, None, 1704067200)),
])

# F41, F42, F43, F52, F28, F29, F30, F31
fixture("claims_and_runs", "claim string, refs array<struct<P854:array<string>>>, ids array<string>, status int, error string, explicit string, row string, question string, kind string", {
    "claim_value": ("VARCHAR", lambda: adapters.claim_value(col("claim"))), "urls": ("VARCHAR", lambda: joined(adapters.reference_urls(col("refs")))), "entity_ids": ("VARCHAR", lambda: joined(adapters.claim_ids(col("ids")))),
    "code": ("VARCHAR", lambda: adapters.error_code(col("status"), col("error"))), "as_of": ("VARCHAR", lambda: adapters.as_of(col("explicit"), col("row"), "2024-02-02")),
    "dated": ("VARCHAR", lambda: adapters.dated_question(col("question"), F.lit("2024-02-02"))), "setup": ("VARCHAR", lambda: T.search_range(col("kind"), F.lit("2024-03-03").cast("date"))), "label": ("VARCHAR", lambda: adapters.experiment_label(col("kind"))),
}, [
    (('{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}}', [(["https://b/", "https://a/"],), (["https://a/"],)], ["Q1", "x", "P2"], 429, "RateLimit", "2023-01-01", "r", "Who? ", "day"), ("Q5", "https://a/|https://b/", "Q1|P2", "429", "2023-01-01", "Who? (as of 2024-02-02)", "2024-03-03to2024-03-03", "row_day")),
    (('{"mainsnak":{"datavalue":{"value":{"amount":"+12"}}}}', [], [], None, "Timeout", "", "q-2023-05-06-1", "What", "week"), ("+12", "", "", "Timeout", "2023-05-06", "What (as of 2024-02-02)", "2024-02-26to2024-03-03", "row_week")),
    (('{"mainsnak":{"datavalue":{"value":{"time":"+2026-01-01T00:00:00Z"}}}}', [(None,)], ["L3"], 500, None, None, "plain", "W", "none"), ("+2026-01-01T00:00:00Z", "", "", "500", "2024-02-02", "W (as of 2024-02-02)", None, "none")),
    (("{}", [([None],)], ["Q"], None, None, None, "", "", None), (None, "", "Q", None, "2024-02-02", " (as of 2024-02-02)", None, None)),
])

# F47, F49
fixture("entity_words", "name string, told string, on_day string", {
    "words": ("VARCHAR", lambda: joined(T.entity_tokens(col("name")))), "says_date": ("BOOLEAN", lambda: F.regexp_like(col("told"), T.date_spellings(col("on_day").cast("date")))),
}, [
    (("Eagle Bancorp, Inc.", "on July 6, 2026 they", "2026-07-06"), ("eagle|bancorp", True)), (("The Group of Holdings", "6 July 2026", "2026-07-06"), ("", True)), (("AT&T Co", "2026-07-06", "2026-07-06"), ("", True)),
    (("Acme Acme Robotics", "7/06/2026", "2026-07-06"), ("acme|robotics", True)), (("", "July 6", "2026-07-06"), ("", False)), (("Zeta", "JULY 06 2026", "2026-07-06"), ("zeta", True)), (("Zeta", "July 16, 2026", "2026-07-06"), ("zeta", False)),
])

# F26, F27, F50, F51, F59, F21, P20
fixture("condition_labels", "vendor string, model string, mode string, arm string, attempt int, title string, number double, argv array<string>, query string", {
    "label": ("VARCHAR", lambda: T.condition_label(col("vendor"), col("model"), col("mode"), col("arm"))), "experiment": ("VARCHAR", lambda: T.experiment_name(F.lit("Study 1"), T.condition_label(col("vendor"), col("model"), col("mode"), col("arm")), col("attempt"))),
    "slug": ("VARCHAR", lambda: T.slug(col("title"))), "shown": ("VARCHAR", lambda: T.or_dash(col("number"), 3)), "value": ("VARCHAR", lambda: T.flag_value(col("argv"), "--model")),
    "prefixes": ("INTEGER", lambda: T.operator_counts(col("query"))["prefixes"]), "arm_suffix": ("VARCHAR", lambda: F.substring_index(T.condition_label(col("vendor"), col("model"), col("mode"), col("arm")), "::", -1)),
}, [
    (("v", "m-1", "none", None, 1, "GPT-5.6 Terra", 1.23456, ["x", "--model", "m"], "site:a.org before:2024 plain"), ("v:m-1::no_search", "study-1-v-m-1-no_search", "gpt_5_6_terra", "1.235", "m", 2, "no_search")),
    (("v", "a/b", "native", None, 2, "  Wide (10) ", None, ["--model"], "nothing here"), ("v:a/b::native", "study-1-v-a-b-native-r02", "wide_10", "—", None, 0, "native")),
    (("w", "m", "harness", "wide", 12, "__", 0.0, [], "intitle:\"two words\""), ("w:m::wide", "study-1-w-m-wide-r12", "", "0.000", None, 1, "wide")),
])

# R12, A19, R13
fixture("jury_grades", "ballots array<string>, reply string", {"grade": ("VARCHAR", lambda: S.jury(col("ballots"))), "parsed": ("VARCHAR", lambda: S.parsed_grade(col("reply")))}, [
    ((["CORRECT", "CORRECT", "INCORRECT"], " correct "), ("CORRECT", "CORRECT")), ((["CORRECT", "INCORRECT"], "Not sure"), ("INCORRECT", "INCORRECT")), ((["INCORRECT", "NOT_ATTEMPTED"], "NOT_ATTEMPTED"), ("INCORRECT", "NOT_ATTEMPTED")),
    (([], ""), (None, "INCORRECT")), ((["NOT_ATTEMPTED", "NOT_ATTEMPTED", "CORRECT"], "INCORRECT"), ("NOT_ATTEMPTED", "INCORRECT")), ((["CORRECT", "CORRECT", "INCORRECT", "NOT_ATTEMPTED"], "incorrect"), ("INCORRECT", "INCORRECT")),
])

# C3, C4, C20, F15
fixture("fact_fields", "attester_id string, authority_family string, old_value string, attribute string, entity string, domains array<string>", {
    "accountable": ("VARCHAR", lambda: facts.attester()), "answer_class": ("VARCHAR", lambda: facts.answer_class(col("old_value"))), "question": ("VARCHAR", lambda: T.question_text(col("attribute"), col("entity"))), "tier": ("VARCHAR", lambda: T.coverage_tier(col("domains"))),
}, [
    (("a1", "sec", "Old", "ceo_of", "Acme", None), ("a1", "changed", "Who is the CEO of Acme?", "unmeasured")), ((" ", "sec", None, "final_score", "A v B", []), ("sec", "post_cutoff_novel", "What was the final score of A v B?", "uncovered")),
    ((None, "publisher:x", "", "other", "Z", ["a.org", "A.org"]), ("publisher:x", "changed", None, "tail")), (("b", "sec", None, "kev_status", "CVE-1", ["a", "b", "c"]), ("b", "post_cutoff_novel", "Is CVE-1 currently in CISA's Known Exploited Vulnerabilities catalog?", "torso")),
    (("b", "sec", None, "cfo_of", "N", ["a", "b", "c", "d", "e", "f"]), ("b", "post_cutoff_novel", "Who is the CFO of N?", "head")),
])


@pytest.mark.parametrize("name", list(CASES))
def test_cases(spark, name):
    ddl, outputs, cases = CASES[name]
    rows = spark.createDataFrame([(n, *c) for n, (c, _) in enumerate(cases)], f"case_no int, {ddl}")
    got = rows.select("case_no", *(f().alias(c) for c, (_, f) in outputs.items())).orderBy("case_no").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(o) for _, o in cases]
