"""Fact resolution: agreement groups with independence gates, pairing by date, promotions, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def _sorted_set(column: Column) -> Column:
    return F.array_sort(F.collect_set(column))


def attester(attester_id: str = "attester_id", family: str = "authority_family") -> Column:
    """Who answers for an observation."""
    return F.coalesce(F.nullif(F.trim(attester_id), F.lit("")), F.col(family))


def answer_class(old_value: Column) -> Column:
    """C4."""
    return F.when(old_value.isNotNull(), "changed").otherwise("post_cutoff_novel")


def invalid_reasons(events: DataFrame) -> DataFrame:
    """Q2: events with the invariants that they break (array ``invalid``, empty if sound)."""
    required = ["entity_id", "entity_name", "entity_type", "attribute", "new_value", "source_type", "resolver_id", "authority_family", "compliance_source_id"]
    blank = [(f"blank_{c}", F.coalesce(F.trim(c), F.lit("")) == "") for c in required]
    same = F.col("old_value").isNotNull() & (T.canonical_value(F.col("old_value")) == T.canonical_value(F.col("new_value")))
    more = [("no_transition", same), ("missing_time", F.col("effective_ts").isNull() | F.col("observed_ts").isNull()), ("rights_not_confirmed", ~F.coalesce("distribution_rights_confirmed", F.lit(False)))]
    return events.withColumn("invalid", _reasons(blank + more))


def agreement_groups(events: DataFrame, order: str = "line_no") -> DataFrame:
    """One row for each (entity, attribute, canonical value): who observed it, the earliest observation, disagreements.

    A single aggregate on the agreement key; observers are sets, so a fact seen a million times stays small.
    """
    key = events.select("*", F.lower("entity_id").alias("k_entity"), F.lower("attribute").alias("k_attribute"), T.canonical_value(F.col("new_value")).alias("k_value"), attester().alias("accountable"))
    first = F.struct("entity_id", "entity_name", "entity_type", "attribute", "old_value", "new_value", "effective_ts")
    return key.groupBy("k_entity", "k_attribute", "k_value").agg(
        F.min_by(first, F.struct("observed_ts", order)).alias("exemplar"),
        _sorted_set(F.col("resolver_id")).alias("resolvers"),
        _sorted_set(F.col("accountable")).alias("attesters"),
        _sorted_set(F.col("authority_family")).alias("authorities"),
        _sorted_set(F.col("source_url")).alias("source_urls"),
        _sorted_set(F.col("compliance_source_id")).alias("compliance_source_ids"),
        F.collect_set("new_value").alias("spellings"),
        F.array_distinct(F.flatten(F.collect_set("aliases"))).alias("aliases"),
        F.size(F.collect_set(T.canonical_value(F.col("old_value")))).alias("__old_all"),
        F.size(F.collect_set(F.when(F.col("old_value").isNotNull(), T.canonical_value(F.col("old_value"))))).alias("old_values"),
        F.size(F.collect_set(F.col("old_value").isNotNull())).alias("old_presence"),
        F.size(F.collect_set("effective_ts")).alias("effective_times"),
        F.max("observed_ts").alias("observed_ts"),
        F.count("*").alias("observations"),
    ).drop("__old_all")


def build_rows(events: DataFrame, freeze_id: str, split: str, as_of: Column | None = None, coverage: DataFrame | None = None, min_resolvers: int = 2, min_attesters: int = 2, min_authorities: int = 1, templates: dict[str, str] | None = None, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Facts that enough independent parties assert, and a ledger of the others with ordered reasons.

    ``coverage`` (entity_id, attribute, new_value, answer_bearing_domains) is looked up by agreement key (J11).
    """
    templates = templates or T.QUESTIONS
    e = lambda c: F.col(f"exemplar.{c}")
    judged = agreement_groups(events, order).withColumn(
        "reasons",
        _reasons(
            [
                ("insufficient_resolvers", F.size("resolvers") < min_resolvers),
                ("insufficient_attesters", F.size("attesters") < min_attesters),
                ("insufficient_authorities", F.size("authorities") < min_authorities),
                ("unsupported_attribute", ~e("attribute").isin(*templates)),
                ("not_yet_effective", e("effective_ts") > as_of if as_of is not None else F.lit(False)),
                ("old_value_disagreement", (F.col("old_values") > 1) | (F.col("old_presence") > 1)),
                ("effective_ts_disagreement", F.col("effective_times") > 1),
            ]
        ),
    )
    rejected = judged.where(F.size("reasons") > 0).select(F.array("k_entity", "k_attribute", "k_value").alias("agreement_key"), "reasons", F.col("resolvers").alias("resolver_ids"), F.col("attesters").alias("attester_ids"), F.col("authorities").alias("authority_families"), F.col("observations").alias("observation_count"))
    kept = judged.where(F.size("reasons") == 0)
    if coverage is not None:
        looked = coverage.select(F.lower("entity_id").alias("k_entity"), F.lower("attribute").alias("k_attribute"), T.canonical_value(F.col("new_value")).alias("k_value"), "answer_bearing_domains")
        kept = kept.join(looked, ["k_entity", "k_attribute", "k_value"], "left")
    else:
        kept = kept.withColumn("answer_bearing_domains", F.lit(None).cast("array<string>"))
    iso = F.date_format(e("effective_ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    other = F.filter(F.col("spellings"), lambda s: s != e("new_value"))
    alias = F.array_sort(F.array_distinct(F.concat(F.filter(F.transform("aliases", lambda x: F.trim(x)), lambda a: a != ""), other)))
    rows = kept.select(
        T.json_id(F.lit(freeze_id), e("entity_id"), e("attribute"), F.col("k_value"), iso).alias("id"),
        T.question_text(e("attribute"), e("entity_name"), templates).alias("question"),
        e("new_value").alias("expected"),
        F.lit(split).alias("split"),
        e("entity_id").alias("entity_id"),
        e("attribute").alias("attribute"),
        answer_class(e("old_value")).alias("answer_class"),
        (T.recency_rung(e("effective_ts"), as_of) if as_of is not None else F.lit("unmeasured")).alias("recency_rung"),
        T.coverage_tier(F.col("answer_bearing_domains")).alias("coverage_tier"),
        alias.alias("answer_aliases"),
        F.col("resolvers").alias("resolver_ids"),
        F.col("attesters").alias("attester_ids"),
        F.col("authorities").alias("authority_families"),
        "source_urls",
        "observed_ts",
        iso.alias("effective_ts"),
    )
    return rows, rejected


def build_traps(observations: DataFrame, run_end: Column, buffer_days: int = 7, min_resolvers: int = 2, min_attesters: int = 2, min_authorities: int = 1, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Questions that resolve safely after the run, and a ledger of the others."""
    groups = observations.withColumn("accountable", attester()).groupBy("trap_id").agg(
        F.min_by(F.struct("question", "attribute", "scheduled_resolution_ts"), F.struct("observed_ts", order)).alias("exemplar"),
        _sorted_set(F.col("resolver_id")).alias("resolver_ids"),
        _sorted_set(F.col("accountable")).alias("attester_ids"),
        _sorted_set(F.col("authority_family")).alias("authority_families"),
        F.size(F.collect_set("question")).alias("questions"),
        F.size(F.collect_set("scheduled_resolution_ts")).alias("times"),
    )
    limit = run_end + F.make_dt_interval(F.lit(buffer_days))
    judged = groups.withColumn(
        "reasons",
        _reasons(
            [
                ("insufficient_resolvers", F.size("resolver_ids") < min_resolvers),
                ("insufficient_attesters", F.size("attester_ids") < min_attesters),
                ("insufficient_authorities", F.size("authority_families") < min_authorities),
                ("question_disagreement", F.col("questions") != 1),
                ("resolution_time_disagreement", F.col("times") != 1),
                ("resolves_inside_safety_window", F.col("exemplar.scheduled_resolution_ts") <= limit),
            ]
        ),
    )
    rows = judged.where(F.size("reasons") == 0).select("trap_id", "exemplar.*", "resolver_ids", "attester_ids", "authority_families", F.lit("I could not find this.").alias("expected"))
    return rows, judged.where(F.size("reasons") > 0).select("trap_id", "reasons")


def pair_within(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, left_id: str, right_id: str, before: int = 14, after: int = 45, bin_days: int | None = None) -> DataFrame:
    """For each right row the left rows of its key whose window [day - before, day + after] holds its day.

    (right id, sorted left ids).  With ``bin_days`` both sides are dealt by key and period too, a left row to each
    period that its window touches, so that one key with very many rows is no single task's work.
    """
    a = left.select(F.col(key).alias("k"), F.col(left_day).cast("date").alias("d"), F.col(left_id).alias("l"))
    b = right.select(F.col(key).alias("k"), F.col(right_day).cast("date").alias("e"), F.col(right_id).alias("r"))
    on = ["k"]
    if bin_days:
        number = lambda c: F.floor(F.unix_date(c) / bin_days)
        a = a.withColumn("bin", F.explode(F.sequence(number(F.date_sub("d", before)), number(F.date_add("d", after)))))
        b = b.withColumn("bin", number(F.col("e")))
        on = ["k", "bin"]
    hit = a.join(b, on).where(F.col("e").between(F.date_sub("d", before), F.date_add("d", after)))
    return hit.groupBy("r").agg(F.array_sort(F.collect_set("l")).alias("paired")).withColumnRenamed("r", right_id)


def promotions(filings: DataFrame, keys: list[str], day: str, role: str) -> DataFrame:
    """The latest strictly earlier filing of the same keys, where its role differs."""
    daily = filings.groupBy(*keys, day).agg(F.max(role).alias(role))
    w = Window.partitionBy(*keys).orderBy(day)
    return daily.withColumn("previous", F.lag(role).over(w)).withColumn("previous_day", F.lag(day).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(role)))


def claim_changes(before: Column, after: Column) -> Column:
    """Single replacements between two sets of claims: (added, removed); null unless one is added and one at most
    removed (U3, C17)."""
    added, removed = F.array_except(after, before), F.array_except(before, after)
    return F.when((F.size(added) == 1) & (F.size(removed) <= 1), F.struct(F.get(added, F.lit(0)).alias("added"), F.get(removed, F.lit(0)).alias("removed")))


def reconcile_results(decisions: DataFrame, candidates: DataFrame, spread_hours: int = 6) -> DataFrame:
    """Each approved decision with its agreed score, or the reasons against it.

    Decisions name observations (resolver_id, source_event_id, reverse_teams); two resolvers and two authorities must
    agree on one sport and one score, starts lie within ``spread_hours``, and the effective time between the
    last start and the first observation; no candidate serves two decisions.
    """
    refs = decisions.where("approved").select("decision_id", "effective_ts", F.explode("observations").alias("o")).select("decision_id", "effective_ts", "o.*")
    uses = refs.groupBy("resolver_id", "source_event_id").agg(F.count("*").alias("uses"))
    seen = refs.join(uses, ["resolver_id", "source_event_id"]).join(candidates, ["resolver_id", "source_event_id"], "left")
    score = F.when(F.col("reverse_teams"), F.struct(F.col("away_score").alias("h"), F.col("home_score").alias("a"))).otherwise(F.struct(F.col("home_score").alias("h"), F.col("away_score").alias("a")))
    g = seen.groupBy("decision_id").agg(
        F.countDistinct("resolver_id").alias("resolvers"),
        F.countDistinct("authority_family").alias("authorities"),
        F.countDistinct("sport").alias("sports"),
        F.count_if(F.col("sport").isNull()).alias("missing"),
        F.max("uses").alias("uses"),
        F.min("event_start_ts").alias("lo"),
        F.max("event_start_ts").alias("hi"),
        F.min("observed_ts").alias("seen"),
        F.max("effective_ts").alias("effective_ts"),
        F.size(F.collect_set(score)).alias("scores"),
        F.min(score).alias("score"),
    )
    return g.select(
        "decision_id",
        F.concat_ws("-", "score.h", "score.a").alias("final_score"),
        _reasons(
            [
                ("missing_candidate", F.col("missing") > 0),
                ("candidate_reused", F.col("uses") > 1),
                ("insufficient_resolvers", F.col("resolvers") < 2),
                ("insufficient_authorities", F.col("authorities") < 2),
                ("sport_disagreement", F.col("sports") != 1),
                ("start_spread", F.col("hi").cast("double") - F.col("lo").cast("double") > spread_hours * 3600),
                ("effective_outside", (F.col("effective_ts") < F.col("hi")) | (F.col("effective_ts") > F.col("seen"))),
                ("score_disagreement", F.col("scores") != 1),
            ]
        ).alias("reasons"),
    )


def reason_histogram(rejected: DataFrame, reasons: str = "reasons") -> DataFrame:
    """A16."""
    return rejected.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def unapproved_sources(used: DataFrame, policy: DataFrame, today: Column) -> DataFrame:
    """Sources that no policy approves today (Q6): unknown ones, those not approved, and those past their date."""
    sound = policy.where((F.col("status") == "approved") & (F.col("expires") >= today)).select("source_id")
    return used.select("source_id").distinct().join(sound, "source_id", "left_anti")
