"""Text functions on strings made from the driver's tables, each beside SQL that applies the same rule to the same strings.

Inputs are written once, in SQL that both engines read alike; the rules are written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers as S
from ..functions import text as T
from ..functions.udfs import folded
from ..operators import facts
from ..sources import adapters
from .bindings import bound, read

col = F.col
joined = lambda c: F.array_join(c, "|")
day = lambda c: F.date_format(c, "yyyy-MM-dd")
epoch = F.unix_seconds

#: One text for both engines, or a pair where they differ.
Input = str | tuple[str, str]


def listed(*items: str) -> Input:
    return f"array({', '.join(items)})", f"[{', '.join(items)}]"


def derived(name: str, table: str, key: str, inputs: dict[str, Input], outputs: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """Registers outputs (operator, SQL) over ``inputs``, made from a table's columns."""
    both = {c: (e, e) if isinstance(e, str) else e for c, e in inputs.items()}

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = read(spark, d, table).select(key, *[F.expr(e).alias(c) for c, (e, _) in both.items()])
        return rows.select(key, *[f().alias(c) for c, (f, _) in outputs.items()])

    made = ", ".join(f"{e} AS {c}" for c, (_, e) in both.items())
    bound(name, f"WITH x AS (SELECT {key}, {made} FROM {table}) SELECT {key}, {', '.join(f'{e} AS {c}' for c, (_, e) in outputs.items())} FROM x")(run)


# --- persons ------------------------------------------------------------------------------------------------
_SUFFIXES = "(" + ", ".join(f"'{s}'" for s in T.NAME_SUFFIXES) + ")"
_PARTS = "list_filter(string_split(replace({0}, ',', ' '), ' '), lambda t: t != '')"
_TOKENS = "list_filter(string_split(lower(regexp_replace({0}, '[^\\w\\s]', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN " + _SUFFIXES + ")"
_SUFFIX = "rtrim(lower({0}), '.') IN " + _SUFFIXES
_CORE = f"list_filter({_PARTS.format('name')}, lambda t: NOT ({_SUFFIX.format('t')}))"
_ENDS = f"list_filter({_PARTS.format('name')}, lambda t: {_SUFFIX.format('t')})"
_KEY, _OTHER = (f"list_sort({_TOKENS.format(c)})" for c in ("name", "other"))
_ENOUGH = "len(list_distinct({0})) >= 2"

# F32, F33, F34, F48
derived("person_names", "part", "p_partkey", {
    "name": "concat(CASE p_partkey % 5 WHEN 0 THEN concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1)) WHEN 1 THEN upper(concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' ', p_type)) WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' K.') WHEN 3 THEN split_part(p_name, ' ', 1) ELSE p_name END, CASE p_size % 4 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' ELSE '' END)",
    "other": "CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(split_part(p_name, ' ', 1), ' X. ', lower(p_type)) ELSE concat('Other, ', p_name) END",
}, {
    "natural_name": (lambda: T.natural_name(col("name")), f"array_to_string(CASE WHEN len({_CORE}) < 2 THEN {_PARTS.format('name')} ELSE list_concat(list_concat({_CORE}[2:], {_CORE}[1:1]), {_ENDS}) END, ' ')"),
    "agreement_key": (lambda: joined(T.name_key(col("name"))), f"array_to_string({_KEY}, '|')"),
    "agrees": (lambda: T.names_agree(col("name"), col("other")), f"{_ENOUGH.format(_KEY)} AND {_ENOUGH.format(_OTHER)} AND (list_has_all({_KEY}, {_OTHER}) OR list_has_all({_OTHER}, {_KEY}))"),
    "surname": (lambda: T.name_tokens(col("name"))["surname"], f"CASE WHEN len({_TOKENS.format('name')}) >= 2 THEN {_TOKENS.format('name')}[1] ELSE '' END"),
    "given": (lambda: joined(T.name_tokens(col("name"))["given"]), f"CASE WHEN len({_TOKENS.format('name')}) >= 2 THEN array_to_string({_TOKENS.format('name')}[2:], '|') ELSE '' END"),
})

# the SQL decides by what the title was made of
_RANK, _SEAT, _SCOPE = "p_size % 7", "p_partkey % 6", "(p_partkey // 6) % 5"
derived("officer_roles", "part", "p_partkey", {
    "title": (
        f"concat(CASE {_RANK} WHEN 0 THEN '' WHEN 1 THEN 'Interim ' WHEN 2 THEN 'Vice ' WHEN 3 THEN 'Former ' WHEN 4 THEN 'Deputy  ' WHEN 5 THEN 'Co-' ELSE 'Global ' END, CASE {_SEAT} WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'C.E.O.' WHEN 2 THEN 'Chairwoman' WHEN 3 THEN 'Chief  Financial Officer' WHEN 4 THEN 'President' ELSE 'COO' END, CASE {_SCOPE.replace('//', 'DIV')} WHEN 1 THEN ' of the Company' WHEN 2 THEN concat(' of ', p_type) WHEN 3 THEN concat(', ', p_type, ' Division') WHEN 4 THEN ' of the Board' ELSE '' END)",
        "''",
    ),
    "rank": _RANK, "seat": _SEAT, "scope": (_SCOPE.replace("//", "DIV"), _SCOPE),
}, {
    "office": (lambda: T.office_of(col("title")), "CASE WHEN rank IN (1, 3, 5) OR scope IN (2, 3) OR rank IN (2, 4) THEN NULL ELSE CASE seat WHEN 0 THEN 'ceo_of' WHEN 1 THEN 'ceo_of' WHEN 2 THEN 'chairperson_of' WHEN 3 THEN 'cfo_of' WHEN 5 THEN 'coo_of' END END"),
    "below_issuer": (lambda: T.scoped_below(col("title")), "scope IN (2, 3)"),
})

# F37, F38, F39, F40
_ISO = "concat('2024-', lpad(CAST(p_size % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'))"
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)), '^www\\.', '')"
derived("ownership_fields", "part", "p_partkey", {
    "flag": "CASE p_size % 6 WHEN 0 THEN '1' WHEN 1 THEN ' Y ' WHEN 2 THEN 'yes' WHEN 3 THEN 'TRUE' WHEN 4 THEN p_type END",
    "period": f"CASE p_partkey % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN concat({_ISO}, '-05:00') WHEN 2 THEN concat(' ', {_ISO}, 'Z') ELSE concat('on ', {_ISO}) END",
    "cik": "lpad(CAST(p_partkey + 1 AS STRING), 10, '0')", "accession": "concat(lpad(CAST(p_size AS STRING), 4, '0'), '-24-', CAST(p_partkey AS STRING))",
    "document": "concat(CASE p_size % 2 WHEN 0 THEN 'view/x5/' ELSE '' END, replace(p_name, ' ', '_'), '.xml')",
    "url": "concat('https://', CASE p_partkey % 5 WHEN 0 THEN 'www.SEC.gov' WHEN 1 THEN 'data.sec.gov' WHEN 2 THEN 'notsec.gov' WHEN 3 THEN concat(replace(p_name, ' ', '-'), '.example.org') ELSE concat('www.', lower(p_type), '.example.net') END, '/x?y=z')",
}, {
    "is_set": (lambda: T.is_true_flag(col("flag")), "coalesce(trim(flag) IN ('1', 'true', 'TRUE', 'True', 'Y', 'y'), FALSE)"),
    "period_day": (lambda: day(T.period_date(col("period"))), "nullif(regexp_extract(period, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1), '')"),
    "document_url": (lambda: T.document_url(col("cik"), col("accession"), col("document"), "https://archive.example/data/"), "concat('https://archive.example/data/', ltrim(cik, '0'), '/', replace(accession, '-', ''), '/', list_last(string_split(document, '/')))"),
    "family": (lambda: T.authority_family(col("url"), {"sec.gov": "sec"}), f"CASE WHEN {_HOST} = 'sec.gov' OR ends_with({_HOST}, '.sec.gov') THEN 'sec' ELSE concat('publisher:', {_HOST}) END"),
})

# the SQL adds up the seconds of a time's parts
_AT = "epoch(strptime(substr(told, 1, 10), '%Y-%m-%d'))::BIGINT"
_CLOCK = "substr(told, 12, 2)::BIGINT * 3600 + substr(told, 15, 2)::BIGINT * 60 + substr(told, 18, 2)::BIGINT"
derived("parsed_times", "part", "p_partkey", {
    "form": "p_partkey % 6",
    "told": f"CASE p_partkey % 6 WHEN 0 THEN {_ISO} WHEN 1 THEN concat({_ISO}, 'T10:', lpad(CAST(p_size AS STRING), 2, '0'), ':07Z') WHEN 2 THEN concat({_ISO}, 'T23:', lpad(CAST(p_size AS STRING), 2, '0'), ':59+02:00') WHEN 3 THEN concat({_ISO}, ' and ', p_name) WHEN 4 THEN p_name ELSE concat({_ISO}, 'T00:', lpad(CAST(p_size AS STRING), 2, '0'), ':00') END",
    "wait": "CASE p_size % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat('-', CAST(p_size AS STRING)) WHEN 2 THEN p_name ELSE concat('Wed, 01 Jan 2025 00:00:', lpad(CAST(p_partkey % 60 AS STRING), 2, '0'), ' GMT') END",
    "size": "p_size", "on_day": _ISO,
}, {
    "parsed": (lambda: epoch(T.parsed_time(col("told"))), f"CASE WHEN form = 4 THEN NULL WHEN form IN (0, 3) THEN {_AT} ELSE {_AT} + {_CLOCK} - CASE WHEN form = 2 THEN 7200 ELSE 0 END END"),
    "zoned": (lambda: epoch(T.zoned_time(col("told"))), f"CASE WHEN form IN (1, 2) THEN {_AT} + {_CLOCK} - CASE WHEN form = 2 THEN 7200 ELSE 0 END END"),
    "wait_s": (lambda: T.retry_seconds(col("wait"), F.lit("2025-01-01 00:00:10").cast("timestamp")), "CASE size % 4 WHEN 0 THEN wait::DOUBLE WHEN 1 THEN 0.0 WHEN 3 THEN greatest(0, regexp_extract(wait, ':(\\d\\d) GMT', 1)::INT - 10)::DOUBLE END::DOUBLE"),
    "midnight": (lambda: epoch(T.midnight(col("on_day"))), "epoch(strptime(on_day, '%Y-%m-%d'))::BIGINT"),
})

# F47, F49
_WORDS = "list_filter(string_split(lower(regexp_replace(name, '[^\\w\\s]', ' ', 'g')), ' '), lambda t: length(t) > 2 AND t NOT IN (" + ", ".join(f"'{s}'" for s in T.ENTITY_STOPWORDS) + "))"
derived("entity_words", "part", "p_partkey", {
    "name": "concat(CASE p_size % 3 WHEN 0 THEN 'The ' WHEN 1 THEN concat(split_part(p_name, ' ', 1), ' ') ELSE '' END, upper(p_name), CASE p_partkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings' WHEN 2 THEN ' & Co' WHEN 3 THEN concat(' ', p_type, ' Group') ELSE '' END)",
    "told": (
        "concat('it was ', CASE p_partkey % 5 WHEN 0 THEN date_format(date_add(date '2024-01-01', p_size), 'MMMM d, yyyy') WHEN 1 THEN upper(date_format(date_add(date '2024-01-01', p_size), 'd MMMM yyyy')) WHEN 2 THEN date_format(date_add(date '2024-01-01', p_size), 'yyyy-MM-dd') WHEN 3 THEN date_format(date_add(date '2024-01-01', p_size), 'MM/dd/yyyy') ELSE date_format(date_add(date '2024-01-01', p_size), 'MMMM d') END, ' that')",
        "''",
    ),
    "form": "p_partkey % 5", "days": "p_size", "asked": "CASE WHEN p_partkey % 3 = 0 THEN p_size + 10 ELSE p_size END",
}, {
    "words": (lambda: joined(T.entity_tokens(col("name"))), f"array_to_string(list_filter({_WORDS}, lambda t, i: list_position({_WORDS}, t) = i), '|')"),
    "says_date": (lambda: F.regexp_like(col("told"), T.date_spellings(F.date_add(F.lit("2024-01-01").cast("date"), col("asked").cast("int")))), "form < 4 AND days = asked"),
})

# --- runs and questions -------------------------------------------------------------------------------------
# F21, F26, F27, F50, F51, F59, P20
_MODE = "CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'native' ELSE 'harness' END"
_LABEL = "concat(vendor, ':', model, '::', CASE mode WHEN 'none' THEN 'no_search' WHEN 'native' THEN 'native' ELSE arm END)"
derived("condition_labels", "part", "p_partkey", {
    "vendor": "lower(p_brand)", "model": "p_name", "mode": _MODE, "arm": "lower(p_type)", "attempt": "p_size % 13", "title": "concat('  ', p_name, ' (', p_brand, ') ')",
    "price": "CASE WHEN p_size % 4 > 0 THEN p_retailprice / 1000 - floor(p_retailprice / 1000) END",
    "argv": listed("'run'", "CASE WHEN p_size % 2 = 0 THEN '--model' ELSE '--mode' END", "p_name"),
    "query": "concat(CASE p_partkey % 3 WHEN 0 THEN 'site:a.org ' WHEN 1 THEN 'website:a.org ' ELSE '' END, p_name, CASE p_size % 3 WHEN 0 THEN ' BEFORE:2024' WHEN 1 THEN ' intitle: x' ELSE concat(' filetype:\"', p_type, ' x\"') END)",
    "k": "p_partkey % 3", "size": "p_size",
}, {
    "label": (lambda: T.condition_label(col("vendor"), col("model"), col("mode"), col("arm")), _LABEL),
    "experiment": (lambda: T.experiment_name(F.lit("Study 1"), T.condition_label(col("vendor"), col("model"), col("mode"), col("arm")), col("attempt")), f"concat(regexp_replace(lower(concat('Study 1-', {_LABEL})), '[^a-z0-9._-]+', '-', 'g'), CASE WHEN attempt > 1 THEN concat('-r', lpad(attempt::VARCHAR, 2, '0')) ELSE '' END)"),
    "slug": (lambda: T.slug(col("title")), "trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_')"),
    "shown": (lambda: T.or_dash(F.round(col("price"), 2), 2), "coalesce(format('{:.2f}', round(price, 2)), '—')"),
    "value": (lambda: T.flag_value(col("argv"), "--model"), "CASE WHEN argv[2] = '--model' THEN argv[3] END"),
    "prefixes": (lambda: T.operator_counts(col("query"))["prefixes"], "((k = 0)::INT + (size % 3 != 1)::INT)::INT"),
    "arm_suffix": (lambda: F.substring_index(T.condition_label(col("vendor"), col("model"), col("mode"), col("arm")), "::", -1), f"list_last(string_split({_LABEL}, '::'))"),
})

# F28 to F31, F41 to F43, F52
_REFS = ("array(named_struct('P854', array(concat('https://b/', p_name), 'https://a/')), named_struct('P854', CASE WHEN p_size % 2 = 0 THEN array('https://a/', concat('https://c/', p_type)) END))", "CASE WHEN p_size % 2 = 0 THEN [concat('https://b/', p_name), 'https://a/', 'https://a/', concat('https://c/', p_type)] ELSE [concat('https://b/', p_name), 'https://a/'] END")
derived("claims_and_runs", "part", "p_partkey", {
    "claim": "CASE p_partkey % 4 WHEN 0 THEN concat('{\"mainsnak\":{\"datavalue\":{\"value\":{\"id\":\"Q', CAST(p_partkey AS STRING), '\"}}}}') WHEN 1 THEN concat('{\"mainsnak\":{\"datavalue\":{\"value\":{\"amount\":\"+', CAST(p_size AS STRING), '\"}}}}') WHEN 2 THEN concat('{\"mainsnak\":{\"datavalue\":{\"value\":{\"time\":\"', p_name, '\"}}}}') ELSE '{}' END",
    "refs": _REFS, "ids": listed("concat('Q', CAST(p_size AS STRING))", "p_name", "concat('P', CAST(p_partkey AS STRING))", "concat('L', p_type)"),
    "status": "CASE WHEN p_size % 3 > 0 THEN 400 + p_size END", "error": "p_type", "explicit": f"CASE p_partkey % 3 WHEN 0 THEN {_ISO} WHEN 1 THEN '' END", "row_name": f"CASE WHEN p_size % 2 = 0 THEN concat('q-', {_ISO}, '-', p_type) ELSE p_name END",
    "question": "concat('Who made the ', p_name, '?', CASE WHEN p_size % 2 = 0 THEN '  ' ELSE '' END)", "kind": "CASE p_size % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'none' END",
    "on_date": ("date_add(date '2024-03-01', CAST(p_partkey % 40 AS INT))", "DATE '2024-03-01' + (p_partkey % 40)::INT"),
}, {
    "claim_value": (lambda: adapters.claim_value(col("claim")), "coalesce(json_extract_string(claim, '$.mainsnak.datavalue.value.id'), json_extract_string(claim, '$.mainsnak.datavalue.value.amount'), json_extract_string(claim, '$.mainsnak.datavalue.value.time'))"),
    "urls": (lambda: joined(adapters.reference_urls(col("refs"))), "array_to_string(list_sort(list_distinct(refs)), '|')"),
    "entity_ids": (lambda: joined(adapters.claim_ids(col("ids"))), "array_to_string(list_filter(ids, lambda v: v[1] IN ('Q', 'P')), '|')"),
    "code": (lambda: adapters.error_code(col("status"), col("error")), "coalesce(status::VARCHAR, error)"),
    "as_of": (lambda: adapters.as_of(col("explicit"), col("row_name"), "2024-02-02"), "coalesce(nullif(explicit, ''), nullif(regexp_extract(row_name, '\\d{4}-\\d{2}-\\d{2}'), ''), '2024-02-02')"),
    "dated": (lambda: adapters.dated_question(col("question"), F.lit("2024-02-02")), "concat(rtrim(question), ' (as of 2024-02-02)')"),
    "setup": (lambda: T.search_range(col("kind"), col("on_date")), "CASE kind WHEN 'day' THEN concat(strftime(on_date, '%Y-%m-%d'), 'to', strftime(on_date, '%Y-%m-%d')) WHEN 'week' THEN concat(strftime(on_date - 6, '%Y-%m-%d'), 'to', strftime(on_date, '%Y-%m-%d')) END"),
    "label": (lambda: adapters.experiment_label(col("kind")), "CASE WHEN kind IN ('day', 'week') THEN concat('row_', kind) ELSE kind END"),
})

# --- grades and facts ---------------------------------------------------------------------------------------
# A19, R12, R13
_GRADE = "CASE ({0}) % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' ELSE 'NOT_ATTEMPTED' END"
_VOTES = [_GRADE.format(e) for e in ("p_size", "p_partkey", "p_partkey + p_size + 1", "p_size * 2", "p_partkey * 2 + 1")]
_COUNT = "len(list_filter(ballots, lambda b: b = '{0}'))"
_BEST = "(SELECT g FROM (SELECT unnest(ballots) AS g, unnest(range(1, len(ballots) + 1)) AS i) {0} GROUP BY g ORDER BY count(*) DESC, min(i) LIMIT 1)"
derived("jury_grades", "part", "p_partkey", {
    "ballots": (f"slice(array({', '.join(_VOTES)}), 1, CAST(p_size % 6 AS INT))", f"[{', '.join(_VOTES)}][1:p_size % 6]"),
    "reply": f"CASE p_size % 4 WHEN 0 THEN concat(' ', lower({_VOTES[1]}), ' ') WHEN 1 THEN {_VOTES[1]} WHEN 2 THEN concat('grade: ', {_VOTES[1]}) ELSE p_name END",
}, {
    "grade": (lambda: S.jury(col("ballots")), f"CASE WHEN len(ballots) = 0 THEN NULL WHEN {_BEST.format('')} = 'CORRECT' AND 2 * {_COUNT.format('CORRECT')} <= len(ballots) THEN coalesce({_BEST.format(' WHERE g != ' + chr(39) + 'CORRECT' + chr(39))}, 'INCORRECT') ELSE {_BEST.format('')} END"),
    "parsed": (lambda: S.parsed_grade(col("reply")), "CASE WHEN upper(trim(reply)) IN ('CORRECT', 'INCORRECT', 'NOT_ATTEMPTED') THEN upper(trim(reply)) ELSE 'INCORRECT' END"),
})

# C3, C4, C20, F15
_ATTRIBUTE = "CASE p_partkey % 10 " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in enumerate(T.QUESTIONS)) + " ELSE p_type END"
_ASK = " ".join("WHEN '{}' THEN concat('{}', entity, '{}')".format(a, *(t.replace("'", "''") for t in q.split("{entity_name}"))) for a, q in T.QUESTIONS.items())
derived("fact_fields", "part", "p_partkey", {
    "attester_id": "CASE p_size % 3 WHEN 0 THEN concat(' ', p_brand, ' ') WHEN 1 THEN '  ' END", "authority_family": "lower(p_type)", "old_value": "CASE WHEN p_size % 2 = 0 THEN p_name END",
    "attribute": _ATTRIBUTE, "entity": "p_name",
    "domains": ("CASE WHEN p_size % 8 < 7 THEN slice(array('a.org', 'A.ORG', concat(lower(p_type), '.net'), 'b.org', concat(p_type, '.NET'), 'c.org', 'd.org', 'e.org', 'f.org'), 1, CAST((p_size % 8) * 3 % 10 AS INT)) END", "CASE WHEN p_size % 8 < 7 THEN ['a.org', 'A.ORG', concat(lower(p_type), '.net'), 'b.org', concat(p_type, '.NET'), 'c.org', 'd.org', 'e.org', 'f.org'][1:(p_size % 8) * 3 % 10] END"),
}, {
    "accountable": (lambda: facts.attester(), "coalesce(nullif(trim(attester_id), ''), authority_family)"),
    "answer_class": (lambda: facts.answer_class(col("old_value")), "CASE WHEN old_value IS NULL THEN 'post_cutoff_novel' ELSE 'changed' END"),
    "question": (lambda: T.question_text(col("attribute"), col("entity")), f"CASE attribute {_ASK} END"),
    "tier": (lambda: T.coverage_tier(col("domains")), "CASE WHEN domains IS NULL THEN 'unmeasured' ELSE CASE len(list_distinct(list_transform(domains, lambda d: lower(d)))) WHEN 0 THEN 'uncovered' WHEN 1 THEN 'tail' WHEN 2 THEN 'tail' WHEN 3 THEN 'torso' WHEN 4 THEN 'torso' WHEN 5 THEN 'torso' ELSE 'head' END END"),
})


# --- answers ------------------------------------------------------------------------------------------------
# A word of a document is the gold, a part of the document the answer; labels gate
def _plain(x: str) -> str:
    return f"array_to_string(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


_ASCII = "regexp_extract_all(text, '[a-zA-Z]+')"
_ANSWERS = f"""a AS (SELECT doc_id, CASE WHEN len(w) > 6 THEN CASE WHEN doc_id % 7 = 0 THEN w[3] || ' ' || w[4] ELSE w[3] END END AS gold,
  CASE doc_id % 5 WHEN 0 THEN coalesce(w[3], '') || '!' WHEN 1 THEN 'The ' || array_to_string(w[1:6], ', ') WHEN 2 THEN array_to_string(w[1:2], ' ') WHEN 3 THEN '' ELSE upper(array_to_string(w[2:4], '-')) END AS answer FROM (SELECT doc_id, {_ASCII} AS w FROM documents)),
 m AS (SELECT doc_id, CASE WHEN gold IS NULL THEN NULL WHEN {_plain('answer')} = '' THEN 0.0 WHEN {_plain('gold')} != '' AND contains(' ' || {_plain('answer')} || ' ', ' ' || {_plain('gold')} || ' ') THEN 1.0 ELSE 0.0 END::DOUBLE AS qa_answer_match FROM a)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))
    rows = read(spark, d, "documents").select("doc_id", w.alias("w"))
    some = lambda a, n, by: F.array_join(F.slice("w", a, n), by)
    gold = F.when(F.size("w") > 6, F.when(col("doc_id") % 7 == 0, some(3, 2, " ")).otherwise(some(3, 1, "")))
    k = col("doc_id") % 5
    answer = F.when(k == 0, F.concat(some(3, 1, ""), F.lit("!"))).when(k == 1, F.concat(F.lit("The "), some(1, 6, ", "))).when(k == 2, some(1, 2, " ")).when(k == 3, "").otherwise(F.upper(some(2, 3, "-")))
    fold = folded()
    made = rows.select("doc_id", F.array_compact(F.array(fold(gold))).alias("folded_golds"), fold(answer).alias("folded_answer"))
    return made.withColumn("qa_answer_match", S.qa_answer_match()).select("doc_id", "qa_answer_match")


@bound("score_answer_match", f"WITH {_ANSWERS} SELECT * FROM m")
def q_answer_match(spark, d):
    """R1."""
    return answers(spark, d)


@bound("score_gated_answer_match", f"WITH {_ANSWERS} SELECT doc_id, CASE WHEN qa_answer_match IS NULL THEN NULL WHEN toxic = 1 THEN 0.0 ELSE qa_answer_match END::DOUBLE AS gated_answer_match FROM m LEFT JOIN labels USING (doc_id)")
def q_gated(spark, d):
    """R2: toxic documents fail the gate, unlabelled ones have none."""
    gate = read(spark, d, "labels").select("doc_id", (1 - col("toxic")).alias("dealbreaker_gate"))
    return answers(spark, d).join(gate, "doc_id", "left").select("doc_id", S.gated_answer_match().alias("gated_answer_match"))
