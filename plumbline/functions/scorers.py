"""Row scorers over nested trajectories.

A row holds ``expected`` (array of strings), ``output`` (struct with final_answer, decision_surface, used_searches,
used_clicks and trajectory) and ``metadata`` (struct).  Every scorer is one Column, built from higher-order
functions over the row's own arrays, so scoring a table is a projection: no explode, no shuffle, no Python but for
Unicode folding and gzip.  A score is null whenever the row's surface cannot show what it measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .udfs import folded, gzip_ratio

#: Fixed: which surfaces show URLs, dates and snippets.
URL_SURFACES, DATE_SURFACES, SNIPPET_SURFACES = ["full", "no_snippet", "urls_only"], ["full", "no_snippet"], ["full"]
SURFACES = [*URL_SURFACES, "none"]
#: Fixed: an answer that declines.
REFUSAL = "i could not find this"
SEARCH_CAP, CLICK_CAP, TAU, NO_RANK = 5, 5, 4000.0, 99



def surface() -> Column:
    """Declared surface, else full with a trajectory and none without."""
    declared = F.col("output.decision_surface")
    return F.when(declared.isin(*SURFACES), declared).when(F.size(F.coalesce("output.trajectory", _empty_like("output.trajectory"))) > 0, "full").otherwise("none")


def _empty_like(name: str) -> Column:
    return F.filter(F.col(name), lambda _: F.lit(False))


def steps() -> Column:
    return F.col("output.trajectory")


def searches() -> Column:
    return F.filter(steps(), lambda s: s["type"] == "search")


def results() -> Column:
    """All results of all searches, in order."""
    return F.flatten(F.transform(searches(), lambda s: F.coalesce(s["results"], _none_of())))


def _none_of() -> Column:
    return F.expr("filter(get(output.trajectory, 0).results, x -> false)")


def golds() -> Column:
    """Trimmed acceptable answers without blanks."""
    return F.filter(F.transform(F.coalesce("expected", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda g: g != "")


def curated() -> Column:
    return F.filter(F.coalesce("metadata.answer_aliases", F.array().cast("array<string>")), lambda a: F.trim(a) != "")


def _alias() -> Column:
    return T.aliases(F.concat(golds(), curated()))


def is_gold(result: Column, alias: Column) -> Column:
    """A result's own label decides if there is one, else its text."""
    return F.coalesce(result["oracle_snippet_gold"], T.contains_gold(result["title"], result["snippet"], alias))


def answer() -> Column:
    return F.coalesce(F.col("output.final_answer"), F.lit(""))


def qa_answer_match() -> Column:
    """R1.  Golds and prediction are folded beforehand (``folded_golds``, ``folded_answer``)."""
    norm = F.transform("folded_golds", T.normalized_answer)
    pred = T.normalized_answer(F.col("folded_answer"))
    refused = F.contains(pred, F.lit(REFUSAL))
    hit = F.exists(norm, lambda g: (g != "") & ((g == pred) | F.contains(F.concat(F.lit(" "), pred, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" ")))))
    return F.when(F.size("folded_golds") == 0, F.lit(None).cast("double")).when(F.array_contains(norm, REFUSAL) & refused, 1.0).when((pred == "") | refused, 0.0).otherwise(F.when(hit, 1.0).otherwise(0.0))


def source_hosts() -> Column:
    """Distinct hosts of the row's own source articles."""
    link = F.array(F.col("metadata.link"))
    articles = F.transform(F.coalesce("metadata.articles", _empty_like("metadata.articles")), lambda a: F.coalesce(F.nullif(a["link"], F.lit("")), a["url"]))
    urls = F.array_compact(F.concat(link, F.coalesce(articles, F.array().cast("array<string>"))))
    return F.filter(F.array_distinct(F.transform(urls, T.host)), lambda h: h != "")


def leaked_urls() -> Column:
    """Result URLs on a source's or an archive's host (first ten of them are reported)."""
    banned = F.concat(source_hosts(), F.array(*map(F.lit, T.ARCHIVE_HOSTS)))
    return F.filter(F.transform(results(), lambda r: r["url"]), lambda u: T.host_allowed(T.host(u), banned))


def leakage_guard() -> Column:
    """R3."""
    unseen = (F.coalesce("output.used_searches", F.lit(0)) > 0) & (F.size(results()) == 0)
    return F.when((surface() == "none") | (F.size(source_hosts()) == 0) | unseen, F.lit(None).cast("double")).when(F.size(leaked_urls()) == 0, 1.0).otherwise(0.0)


def budget_economy() -> Column:
    """R4."""
    within = (F.coalesce("output.used_searches", F.lit(0)) <= F.coalesce("metadata.search_budget", F.lit(SEARCH_CAP))) & (F.coalesce("output.used_clicks", F.lit(0)) <= CLICK_CAP)
    return F.when(surface() != "none", F.when(within, 1.0).otherwise(0.0))


def dealbreaker_gate() -> Column:
    """The least of the two that can be measured."""
    return F.least(leakage_guard(), budget_economy())


def gated_answer_match() -> Column:
    """R2, of the columns qa_answer_match and dealbreaker_gate."""
    return F.when(F.col("qa_answer_match").isNull(), F.lit(None).cast("double")).when(F.col("dealbreaker_gate") == 0, 0.0).otherwise(F.col("qa_answer_match"))


def _lags() -> Column:
    """Days from event to publication of each dated result that counts as a publication, sorted."""
    event = T.parsed_time(F.coalesce("metadata.event_date", "metadata.date"))
    counted = F.filter(results(), lambda r: (r["date_semantics"] == "publication") | (r["date_semantics"].isNull() & (r["source"] == "news")))
    return F.array_sort(F.filter(F.transform(counted, lambda r: (T.parsed_time(r["published_date"]).cast("double") - event.cast("double")) / 86400.0), lambda x: x.isNotNull()))


def temporal_grounding() -> Column:
    """Share of dated results that were not published before the event."""
    lags = _lags()
    early = F.size(F.filter(lags, lambda x: x < 0))
    return F.when(surface().isin(*DATE_SURFACES) & (F.size(lags) > 0), 1.0 - early / F.size(lags))


def median_lag_days() -> Column:
    """The upper median of the lags."""
    lags = _lags()
    return F.when(F.size(lags) > 0, F.element_at(lags, (F.floor(F.size(lags) / 2) + 1).cast("int")))


def _snippets(score: Column) -> Column:
    return F.when(surface().isin(*SNIPPET_SURFACES) & (F.size(golds()) > 0), score)


def snippet_sufficiency() -> Column:
    """R7."""
    alias = _alias()
    return _snippets(F.when(F.exists(results(), lambda r: is_gold(r, alias)), 1.0).otherwise(0.0))


def best_gold() -> Column:
    """(rank, round) of the best-ranked gold result, the earliest of equals."""
    alias = _alias()
    ranked = F.flatten(F.transform(searches(), lambda s, i: F.transform(F.filter(s["results"], lambda r: is_gold(r, alias)), lambda r: F.struct(F.coalesce(r["rank"], F.lit(NO_RANK)).alias("rank"), (i + 1).alias("round")))))
    return F.array_min(ranked)


def evidence_precision() -> Column:
    """R8."""
    alias = _alias()
    return _snippets(F.when(F.size(results()) > 0, F.size(F.filter(results(), lambda r: is_gold(r, alias))) / F.size(results())))


def token_discounted_gain(tau: float = TAU) -> Column:
    """exp(-tokens read up to the first gold result / tau); each result costs its share of its step."""
    alias = _alias()
    start = F.struct(F.lit(0.0).alias("read"), F.lit(None).cast("double").alias("found"))

    def step(acc, s):
        share = F.coalesce(s["tokens"], F.lit(0.0)) / F.greatest(F.size(F.coalesce(s["results"], _none_of())), F.lit(1))
        by_rank = F.array_sort(F.transform(F.coalesce(s["results"], _none_of()), lambda r, i: F.struct(F.coalesce(r["rank"], F.lit(NO_RANK)).alias("k"), i.alias("i"), is_gold(r, alias).alias("g"))))
        first = F.array_position(F.transform(by_rank, lambda x: x["g"]), True)
        return F.struct((acc["read"] + F.coalesce(s["tokens"], F.lit(0.0))).alias("read"), F.coalesce(acc["found"], F.when((s["type"] == "search") & (first > 0), acc["read"] + share * first)).alias("found"))

    found = F.aggregate(steps(), start, step)["found"]
    return _snippets(F.when(F.size(results()) > 0, F.coalesce(F.exp(-found / tau), F.lit(0.0))))


def snippet_text() -> Column:
    """All results' title and snippet, blank ones left out, by line."""
    lines = F.transform(results(), lambda r: F.trim(F.concat_ws(" ", r["title"], r["snippet"])))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def compression_redundancy() -> Column:
    """Gzip ratio, rescaled to 0..1; null below 200 bytes."""
    ratio = gzip_ratio()(snippet_text())  # NaN where there is too little text
    return F.when(surface().isin(*SNIPPET_SURFACES) & ratio.isNotNull() & ~F.isnan(ratio), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio - 0.05) / 0.55)))


def domain_entropy() -> Column:
    """Entropy of the results' hosts over its maximum."""
    hosts = F.filter(F.transform(results(), lambda r: T.host(r["url"])), lambda h: h != "")
    n = F.size(hosts).cast("double")
    share = F.transform(F.array_distinct(hosts), lambda d: F.size(F.filter(hosts, lambda h: h == d)) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log(p))
    return F.when(surface().isin(*URL_SURFACES) & (n >= 2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), bits / F.log(n))))


def surfaced_domains() -> Column:
    """A14."""
    return F.size(F.array_distinct(F.filter(F.transform(results(), lambda r: T.host(r["url"])), lambda h: h != "")))


def parsed_grade(reply: Column) -> Column:
    """The verdict in a judge's reply; anything else is INCORRECT."""
    word = F.upper(F.trim(reply))
    return F.when(word.isin("CORRECT", "INCORRECT", "NOT_ATTEMPTED"), word).otherwise("INCORRECT")


def jury(ballots: Column) -> Column:
    """R12 over an array of grades in order: a strict majority for CORRECT, else the most common other grade, the
    first of equals; null without ballots."""
    votes = lambda g: F.size(F.filter(ballots, lambda b: b == g))
    ranked = F.array_sort(F.transform(F.array_distinct(ballots), lambda g: F.struct((-votes(g)).alias("n"), F.array_position(ballots, g).alias("at"), g.alias("grade"))))
    top = F.get(ranked, F.lit(0))["grade"]
    other = F.get(F.filter(ranked, lambda x: x["grade"] != "CORRECT"), F.lit(0))["grade"]
    weak = (top == "CORRECT") & (2 * votes(F.lit("CORRECT")) <= F.size(ballots))
    return F.when(F.size(ballots) > 0, F.when(weak, F.coalesce(other, F.lit("INCORRECT"))).otherwise(top))


#: The scorers in order; each gives one column.
SCORERS: dict[str, Callable[[], Column]] = {
    "qa_answer_match": qa_answer_match,
    "leakage_guard": leakage_guard,
    "budget_economy": budget_economy,
    "dealbreaker_gate": dealbreaker_gate,
    "gated_answer_match": gated_answer_match,
    "temporal_grounding": temporal_grounding,
    "snippet_sufficiency": snippet_sufficiency,
    "evidence_precision": evidence_precision,
    "token_discounted_gain": token_discounted_gain,
    "compression_redundancy": compression_redundancy,
    "domain_entropy": domain_entropy,
}


def register(name: str, scorer: Callable[[], Column]) -> None:
    """Add a scorer: a function without arguments that returns a Column over a trajectory row."""
    SCORERS[name] = scorer


def score(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``rows`` with a column for each named scorer."""
    names = names or list(SCORERS)
    fold = folded()
    out = rows
    if {"qa_answer_match", "gated_answer_match"} & set(names):
        # one folding pass over golds and answer together
        marked = F.concat(golds(), F.transform(curated(), lambda x: F.trim(x)))
        out = out.withColumn("__marked", fold(F.concat_ws("\u0001", F.concat(F.array(answer()), marked))))
        parts = F.split("__marked", "\u0001")
        out = out.withColumn("folded_answer", F.get(parts, F.lit(0))).withColumn("folded_golds", F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))))
    for name in SCORERS:
        if name in names or name in ("qa_answer_match", "dealbreaker_gate") and "gated_answer_match" in names:
            out = out.withColumn(name, SCORERS[name]())
    return out.drop("__marked", "folded_answer", "folded_golds")
