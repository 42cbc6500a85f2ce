"""Scalar text functions as Column builders: hosts, dates, answers, names, identifiers.

Everything runs inside the JVM; the exceptions (NFKC, casefold, HTML entities, gzip) are Arrow UDFs in ``udfs``.
Java's regular expressions need ``(?U)`` for Unicode classes; patterns here carry it where the meaning needs it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------
#: Fixed: the archive hosts that count as leaking a source.
ARCHIVE_HOSTS = ["web.archive.org", "archive.org", "archive.is", "archive.ph", "archive.today", "cachedview.nl", "timetravel.mementoweb.org"]
#: Fixed: terms that mark a question as quantitative in the variable analysis.
QUANTITATIVE_ANALYSIS = ["how many", "how much", "by how many", "difference", "percentage", "percent", "combined value", "approximately how", "what was the total", "what were the", "how long", "elapsed", "additional years"]
#: Fixed: the other, shorter list that the release table uses.
QUANTITATIVE_RELEASE = ["how many", "difference", "total", "combined", "sum", "percent", "ratio"]
#: Fixed: name suffixes.
NAME_SUFFIXES = ["jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "v", "md", "phd", "esq"]
#: Fixed: words of an issuer's name that do not tell it from others.
ENTITY_STOPWORDS = ["inc", "inc.", "incorporated", "corp", "corp.", "corporation", "co", "co.", "company", "llc", "l.l.c.", "lp", "l.p.", "ltd", "ltd.", "limited", "plc", "holding", "holdings", "group", "the", "and", "of", "sa", "nv", "ag", "trust", "partners", "capital", "international", "industries", "technologies"]
#: Fixed: search operators with their terms, and the other forbidden forms.
SEARCH_OPERATOR = r"(?<!\w)(?:site|inurl|intitle|intext|inanchor|filetype|ext|allintitle|allinurl|allintext|allinanchor|related|cache|define|author|before|after|source|loc|location|language|num|filter|safe|sort|date|info|link|blogurl):(?:\"[^\"]*\"|\S+)"
SEARCH_SYNTAX = r'(?<!\S)[+-](?=\S)\S+|\b(?:AND|OR|NOT)\b|"(?:[^"\\]|\\.)+"'
#: Fixed: officer titles, in the order in which they are tried.
OFFICES = [
    ("ceo_of", r"(?<!\bdeputy\s)(?<!\bvice\s)(?<!\bassistant\s)\b(?:chief\s+executive\s+officer|chief\s+executive|c\.?e\.?o\.?)\b"),
    ("chairperson_of", r"(?<!\bvice\s)(?<!\bdeputy\s)(?<!\bassistant\s)\b(?:chair(?:person|man|woman)?)\b(?:\s+of\s+the\s+board)?"),
    ("cfo_of", r"(?<!\bdeputy\s)(?<!\bvice\s)(?<!\bassistant\s)\b(?:chief\s+financial\s+officer|c\.?f\.?o\.?)\b"),
    ("coo_of", r"(?<!\bdeputy\s)(?<!\bvice\s)(?<!\bassistant\s)\b(?:chief\s+operat(?:ing|ions)\s+officer|c\.?o\.?o\.?)\b"),
]
UNSETTLED_OFFICE = r"\b(?:interim|acting|co[- ]|former|outgoing)\b"
OWN_SCOPE = r"\bof\s+(?:the\s+)?(?:board(?:\s+of\s+directors)?|directors|company|issuer|registrant|corporation)\b"
UNIT_SCOPE = r"[,\-]\s*[\w&.\- ]*\b(?:division|segment|subsidiary|group|unit|region|bank|holdings?)\b"
#: Fixed: question wording by attribute.
QUESTIONS = {
    "ceo_of": "Who is the CEO of {entity_name}?",
    "chairperson_of": "Who is the chairperson of {entity_name}?",
    "cfo_of": "Who is the CFO of {entity_name}?",
    "coo_of": "Who is the COO of {entity_name}?",
    "head_coach_of": "Who is the head coach of {entity_name}?",
    "latest_stable_version": "What is the latest stable release of {entity_name}?",
    "cvss_score": "What is the current CVSS score for {entity_name}?",
    "kev_status": "Is {entity_name} currently in CISA's Known Exploited Vulnerabilities catalog?",
    "final_score": "What was the final score of {entity_name}?",
}
# ------------------------------------------------------------------------------------------------------------



def any_of(text: Column, terms: list[str]) -> Column:
    """Whether ``text`` holds one of ``terms``."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


# --- hosts and URLs -----------------------------------------------------------------------------------------
def host(url: Column) -> Column:
    """Lower-cased host without one leading ``www.``; empty for what is no URL (F1, F2)."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def authority(url: Column) -> Column:
    """Lower-cased authority, with user info and port, without ``www.``."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", ""), F.lit(""))


def under_domain(name: Column, domain: Column) -> Column:
    """A host is the domain or lies below it."""
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def host_allowed(name: Column, domains: Column) -> Column:
    """under one of an array of domains."""
    return F.exists(domains, lambda d: under_domain(name, d))


def host_suffixes(name: Column) -> Column:
    """The host and all its parent domains, to join on instead of comparing endings."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def authority_family(url: Column, official: dict[str, str]) -> Column:
    """A named family for official hosts, else publisher:host."""
    name = host(url)
    out = F.concat(F.lit("publisher:"), name)
    for domain, family in official.items():
        out = F.when(under_domain(name, F.lit(domain)), F.lit(family)).otherwise(out)
    return out


# --- dates --------------------------------------------------------------------------------------------------
def parsed_time(text: Column) -> Column:
    """ISO time, else a leading ISO date; no zone means UTC; what is neither gives null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)))


def zoned_time(text: Column) -> Column:
    """As ``parsed_time``, but null without an explicit offset."""
    return F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def period_date(text: Column) -> Column:
    """The first ten characters as a date; an offset behind them is dropped."""
    return F.to_date(F.nullif(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def midnight(day: Column) -> Column:
    """F54."""
    return day.cast("date").cast("timestamp")


def retry_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or an HTTP date less now, never negative."""
    at = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))  # GMT alone: sessions are in UTC
    wait = F.coalesce(value.try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0)))


def search_range(kind: Column, day: Column) -> Column:
    """Absolute range of a day or the week up to it."""
    end = F.date_format(day, "yyyy-MM-dd")
    start = F.when(kind == "day", end).when(kind == "week", F.date_format(F.date_sub(day, 6), "yyyy-MM-dd"))
    return F.concat(start, F.lit("to"), end)


def recency_rung(effective: Column, as_of: Column) -> Column:
    """strict upper bounds."""
    hours = (as_of.cast("double") - effective.cast("double")) / 3600.0
    return F.when(hours < 0, "future").when(hours < 24, "lt_24h").when(hours < 72, "24h_72h").when(hours < 168, "3d_7d").when(hours < 720, "7d_30d").when(hours >= 720, "gte_30d")


# --- answers ------------------------------------------------------------------------------------------------
def without_thousands(text: Column) -> Column:
    """Commas between a digit and three digits that end a number."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}\b)", "")


def normalized_answer(folded: Column) -> Column:
    """The rest of answer normalisation, after NFKC and casefold."""
    words = F.split(F.trim(F.regexp_replace(without_thousands(folded), r"(?U)[^\w]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the", "")), " ")


def aliases(golds: Column) -> Column:
    """Spellings of each gold answer for containment tests, of three characters or more."""
    low = lambda g: F.lower(g)
    variants = F.flatten(F.transform(golds, lambda g: F.array(g, low(g), F.regexp_replace(low(g), r"(?U)[^\w\s]", ""), F.trim(F.regexp_replace(low(g), r"(?U)\s+", " ")), low(without_thousands(g)))))
    return F.filter(F.array_distinct(variants), lambda a: F.length(a) >= 3)


def contains_gold(title: Column, snippet: Column, alias: Column) -> Column:
    """Some alias is within title and snippet, as they are or with punctuation blanked (F8)."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    blank = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    return F.exists(alias, lambda a: F.contains(text, a) | F.contains(blank, a))


def canonical_value(text: Column) -> Column:
    """F13; null is empty."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(without_thousands(F.regexp_replace(low, r"^v(?=\d)", "")), r"(?U)\s+", " ")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def question_type(question: Column, terms: list[str] | None = None) -> Column:
    """Two term lists, never to be merged."""
    return F.when(any_of(F.lower(F.coalesce(question, F.lit(""))), terms or QUANTITATIVE_ANALYSIS), "Quantitative / composed").otherwise("Other factual")


# --- identifiers --------------------------------------------------------------------------------------------
def short_hash(text: Column) -> Column:
    """16 hex digits of sha256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def row_id(task: Column, condition: Column, row: Column) -> Column:
    """F18."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return short_hash(F.concat_ws("|", part(task), part(condition), part(row)))


def json_id(*parts: Column) -> Column:
    """sha256 of the compact JSON array of strings."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def slug(text: Column) -> Column:
    """F50."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def question_key(task_key: Column, fallbacks: list[Column], question: Column) -> Column:
    """First non-empty key, else a hash of the question."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(some(task_key), *map(some, fallbacks), short_hash(question))


def condition_label(vendor: Column, model: Column, mode: Column, arm: Column) -> Column:
    """vendor:model::mode or ::arm of a harness run."""
    return F.concat(vendor, F.lit(":"), model, F.lit("::"), F.when(mode == "none", F.lit("no_search")).when(mode == "native", F.lit("native")).otherwise(arm))


def experiment_name(study: Column, label: Column, attempt: Column) -> Column:
    """Slug of study and label, with a two-digit retry suffix from the second attempt on."""
    base = F.regexp_replace(F.lower(F.concat_ws("-", study, label)), r"[^a-z0-9._-]+", "-")
    return F.when(attempt > 1, F.concat(base, F.lit("-r"), F.lpad(attempt.cast("string"), 2, "0"))).otherwise(base)


def flag_value(arguments: Column, flag: str) -> Column:
    """The argument after ``flag``."""
    at = F.array_position(arguments, flag)
    return F.when(at > 0, F.try_element_at(arguments, (at + 1).cast("int")))


def or_dash(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, an em dash for null."""
    return F.coalesce(F.format_number(value, digits), F.lit("—"))


# --- persons and offices ------------------------------------------------------------------------------------
def _words(text: Column, pattern: str = r"(?U)\s+") -> Column:
    return F.filter(F.split(F.trim(text), pattern), lambda t: t != "")


def _is_suffix(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"\.+$", "").isin(*NAME_SUFFIXES)


def natural_name(name: Column) -> Column:
    """Surname-first to natural order, suffixes last (F32)."""
    parts = _words(F.regexp_replace(name, ",", " "))
    core = F.filter(parts, lambda p: ~_is_suffix(p))
    turned = F.concat(F.slice(core, 2, F.greatest(F.size(core) - 1, F.lit(0))), F.slice(core, 1, 1), F.filter(parts, _is_suffix))
    return F.array_join(F.when(F.size(core) < 2, parts).otherwise(turned), " ")


def name_key(name: Column) -> Column:
    """Sorted tokens without suffixes and initials."""
    return F.array_sort(F.filter(_words(F.lower(F.regexp_replace(name, r"(?U)[^\w\s]", " "))), lambda t: ~_is_suffix(t) & (F.length(t) > 1)))


def names_agree(left: Column, right: Column) -> Column:
    """One token set within the other, two tokens at least in each."""
    a, b = F.array_distinct(name_key(left)), F.array_distinct(name_key(right))
    return (F.size(a) >= 2) & (F.size(b) >= 2) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def name_tokens(name: Column) -> Column:
    """Surname and given names of a surname-first name; empty with less than two tokens."""
    tokens = F.filter(_words(F.lower(F.regexp_replace(name, r"(?U)[^\w\s]", " "))), lambda t: (F.length(t) > 1) & ~_is_suffix(t))
    enough = F.size(tokens) >= 2
    return F.struct(F.when(enough, F.get(tokens, F.lit(0))).otherwise("").alias("surname"), F.when(enough, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("given"))


def entity_tokens(name: Column) -> Column:
    """Distinctive words of an issuer's name."""
    return F.array_distinct(F.filter(_words(F.lower(F.regexp_replace(name, r"(?U)[^\w\s]", " "))), lambda t: (F.length(t) > 2) & ~t.isin(*ENTITY_STOPWORDS)))


def scoped_below(title: Column) -> Column:
    """An office of a unit, not of the issuer."""
    return F.regexp_replace(title, "(?i)" + OWN_SCOPE, " ").rlike(r"(?i)\bof\s+\S") | title.rlike("(?i)" + UNIT_SCOPE)


def office_of(title: Column) -> Column:
    """The office that a title names, or null."""
    text = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    refused = text.isNull() | (text == "") | text.rlike("(?i)" + UNSETTLED_OFFICE) | scoped_below(text)
    out = F.when(refused, F.lit(None).cast("string"))
    for attribute, pattern in OFFICES:
        out = out.when(text.rlike("(?i)" + pattern), attribute)
    return out


def is_true_flag(value: Column) -> Column:
    """F37."""
    return F.coalesce(F.trim(value).isin("1", "true", "TRUE", "True", "Y", "y"), F.lit(False))


def document_url(cik: Column, accession: Column, document: Column, base: str) -> Column:
    """Archive address of the raw document; a rendering folder before its name is dropped."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"), F.substring_index(document, "/", -1))


def question_text(attribute: Column, entity: Column, templates: dict[str, str] | None = None) -> Column:
    """C20; null for an unknown attribute."""
    out = F.lit(None).cast("string")
    for name, template in (templates or QUESTIONS).items():
        out = F.when(attribute == name, F.replace(F.lit(template), F.lit("{entity_name}"), entity)).otherwise(out)
    return out


def coverage_tier(domains: Column) -> Column:
    """by distinct lower-cased domains; null is unmeasured."""
    n = F.size(F.array_distinct(F.transform(domains, F.lower)))
    return F.when(domains.isNull(), "unmeasured").when(n == 0, "uncovered").when(n <= 2, "tail").when(n <= 5, "torso").otherwise("head")


def date_spellings(day: Column) -> Column:
    """A pattern of the four spellings of a date, the year in all of them."""
    month, d, y = F.date_format(day, "MMMM"), F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    return F.concat(F.lit("(?i)"), month, F.lit(r"\s+0?"), d, F.lit(r"\s*,?\s*"), y, F.lit("|0?"), d, F.lit(r"\s+"), month, F.lit(r"\s+"), y, F.lit("|"), F.date_format(day, "yyyy-MM-dd"), F.lit("|0?"), F.month(day).cast("string"), F.lit("/0?"), d, F.lit("/"), y)


# --- search operators ---------------------------------------------------------------------------------------
def operator_counts(query: Column) -> Column:
    """How many prefix operators, and how many other forbidden forms, a query holds (F21, without overlaps)."""
    rest = F.regexp_replace(query, "(?i)" + SEARCH_OPERATOR, " ")
    return F.struct(F.regexp_count(query, F.lit("(?i)" + SEARCH_OPERATOR)).alias("prefixes"), F.regexp_count(rest, F.lit(SEARCH_SYNTAX)).alias("syntax"))


# --- cost ---------------------------------------------------------------------------------------------------
#: Fixed: price of a harness search, and of a native one by vendor, with the dearer rate of other models.
HARNESS_SEARCH_USD, NATIVE_SEARCH_USD, OTHER_NATIVE_USD = 0.005, {"openai": 0.010, "anthropic": 0.010}, 0.025
#: Fixed: model names whose native searches cost the standard rate.
REASONING_PREFIXES = ["gpt-5", "o1", "o3", "o4"]


def cached_multiplier(model: Column) -> Column:
    """F24."""
    return F.when(F.contains(model, F.lit("/")), 1.0).otherwise(0.1)


def model_cost(input_price: Column, output_price: Column, model: Column, prompt: Column, completion: Column, cached: Column) -> Column:
    """Dollars from prices by million tokens; null without a price."""
    hit = F.greatest(F.lit(0), F.least(cached, prompt))
    return ((prompt - hit) * input_price + hit * input_price * cached_multiplier(model) + completion * output_price) / 1e6


def native_search_rate(vendor: Column, model: Column) -> Column:
    """(usd, confirmed) of one native search."""
    known = F.lit(False)
    for p in REASONING_PREFIXES:
        known = known | F.startswith(model, F.lit(p))
    rate = F.lit(0.0)
    for name, usd in NATIVE_SEARCH_USD.items():
        rate = F.when(vendor == name, usd).otherwise(rate)
    other = (vendor == "openai") & ~known
    return F.struct(F.when(other, OTHER_NATIVE_USD).otherwise(rate).alias("usd"), (~other).alias("confirmed"))
