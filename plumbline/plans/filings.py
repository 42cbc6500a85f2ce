"""Filings written from ``part``, and whether they confirm an appointment.

A part's name is a person's, its other columns say what the filing states: who did what, which office, of whom, on which day.
The SQL decides by these columns; the operator has the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corroborate
from .bindings import bound, read

col = F.col


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Five kinds of filing: an appointment, a signature block, thanks, one that names nobody, one with two sentences."""
    p = read(spark, d, "part")
    k, brand = col("p_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    given, surname = (F.initcap(F.split("p_name", " ")[n]) for n in (0, 1))
    person = F.concat(given, F.lit(" "), F.when(k % 2 == 0, "Q. ").otherwise(""), surname)
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int"))
    stated = F.date_add(day, F.when(col("p_size") % 3 == 0, 0).when(col("p_size") % 3 == 1, -40).otherwise(40))
    written = F.when(k % 4 == 0, F.date_format(stated, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(stated, "d MMMM yyyy")).otherwise(F.date_format(stated, "MMMM d, yyyy"))
    title = F.when(col("p_type") == "ECONOMY", "Chief Executive Officer").when(col("p_type") == "SMALL", "Chief Financial Officer").otherwise("President")
    of = F.when(brand % 4 == 1, F.concat(given, F.lit(" Ventures Europe"))).when(brand % 4 == 2, "the Company").otherwise("our division")
    plain = F.concat(F.lit("The Board "), F.when(brand % 2 == 0, "appointed ").otherwise("thanked "), person, F.lit(" as "), title, F.when(brand % 4 == 0, "").otherwise(F.concat(F.lit(" of "), of)), F.when(k % 5 < 3, ", effective ").otherwise(" on "), written, F.lit("."))
    two = F.concat(F.lit("We met "), person, F.lit(". A "), title, F.lit(" was named on "), written, F.lit("."))
    text = F.when(col("p_size") % 7 == 0, F.concat(F.lit("By: /s/ "), person, F.lit(", Chief Executive Officer, appointed "), written)).when(col("p_size") % 11 == 0, "The Company thanks its people.").when(col("p_size") % 13 == 0, two).otherwise(plain)
    return p.select("p_partkey", text.alias("text"), F.concat(surname, F.lit(" "), given).alias("owner"), F.when(k % 17 == 0, "president_of").otherwise("ceo_of").alias("role"), day.alias("day"), F.lit("Acme Corp").alias("issuer"))


_FILED = """f AS (SELECT *, regexp_extract(p_brand, '(\\d+)', 1)::INT AS brand, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN -40 ELSE 40 END AS off, p_partkey % 5 < 3 AS effective,
  DATE '2026-01-01' + (p_partkey % 300)::INT AS day FROM part),
 o AS (SELECT *, brand % 4 IN (0, 2) AS own, CASE p_type WHEN 'ECONOMY' THEN 'ceo_of' WHEN 'SMALL' THEN 'cfo_of' END AS office FROM f),
 v AS (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN 'unsupported_attribute' WHEN p_size % 7 = 0 THEN 'signature_block_only' WHEN p_size % 11 = 0 THEN 'name_not_found' WHEN p_size % 13 = 0 THEN 'role_phrase_absent'
   WHEN own AND office = 'ceo_of' AND effective AND off > 0 AND p_partkey % 4 > 1 THEN 'commences_after_event_date'
   WHEN NOT own OR office IS NULL THEN 'role_phrase_absent' WHEN office != 'ceo_of' THEN 'another_office_is_closer' WHEN brand % 2 != 0 THEN 'appointment_not_described' WHEN off != 0 THEN 'date_not_stated' END AS reason FROM o)"""


@bound("corroboration", f"""WITH {_FILED} SELECT p_partkey, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN CASE WHEN effective THEN 'effective_cue' ELSE 'appointment_cue' END END AS date_basis,
 CASE WHEN reason IS NULL THEN CASE p_partkey % 4 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%-d %B %Y') ELSE strftime(day, '%B %-d, %Y') END END AS date_form FROM v""")
def q_corroboration(spark, d):
    """C5 to C12, T5."""
    return corroborate.corroborate(filings(spark, d)).select("p_partkey", "confirmation.ok", "confirmation.reason", "confirmation.date_basis", "confirmation.date_form")


_STEP = "list_position([" + ", ".join(f"'{r}'" for r in corroborate.PROGRESS) + "], reason)"


@bound("corroboration_ledger", f"WITH {_FILED} SELECT p_partkey % 700 AS fact, bool_or(reason IS NULL) AS confirmed, CASE WHEN NOT bool_or(reason IS NULL) THEN arg_min(reason, p_partkey) END AS reason, CASE WHEN NOT bool_or(reason IS NULL) THEN max(coalesce({_STEP}, 0)) END::INTEGER AS furthest FROM v GROUP BY 1")
def q_ledger(spark, d):
    """Parts whose keys agree modulo 700 are attempts at one fact, in order of their keys."""
    done, rest = corroborate.ledger(corroborate.corroborate(filings(spark, d)).withColumn("fact", col("p_partkey") % 700), "fact", "p_partkey")
    step = F.array_position(F.array(*map(F.lit, corroborate.PROGRESS)), col("furthest_reason")).cast("int")
    none = F.lit(None)
    return done.select("fact", F.lit(True).alias("confirmed"), none.cast("string").alias("reason"), none.cast("int").alias("furthest")).unionByName(rest.select("fact", F.lit(False).alias("confirmed"), "reason", step.alias("furthest")))
