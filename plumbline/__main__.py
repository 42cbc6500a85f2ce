"""python -m plumbline analyze | facts | plan"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def analyze(spark: SparkSession, path: str, score: str, baseline: str, study: str | None, rounds: int) -> str:
    """Report of an export of JSON lines."""
    from .operators.records import normalize_records
    from .plans.reports import paired_report
    from .sources.readers import numbered_lines

    if rounds < 100:
        raise ValueError("fewer than 100 bootstrap rounds")
    # filters on what is parsed may run before the one on blank lines
    raw = numbered_lines(spark, path).select("line_no", F.parse_json(F.when(F.trim("value") != "", F.col("value"))).alias("v"))
    part = lambda c: F.try_variant_get("v", f"$.{c}", "variant").alias(c)
    text = lambda c: F.try_variant_get("v", f"$.{c}", "string").alias(c)
    rows = normalize_records(raw.select("line_no", *[part(c) for c in ("score", "scores", "metadata", "metrics", "output", "input")], *[text(c) for c in ("condition", "task_key", "dataset_record_id", "dataset_row_id")]), score)
    if study:
        rows = rows.where(F.col("study_id") == study)
    return paired_report(rows, baseline, rounds)


def build_facts(spark: SparkSession, path: str, out: str, freeze: str, split: str) -> None:
    """Rows and rejections of fact events, as sorted JSON lines."""
    from .operators.facts import build_rows, invalid_reasons
    from .schemas import FACT_EVENT
    from .sources.readers import checked_jsonl
    from .sources.writers import sorted_jsonl

    events, broken = checked_jsonl(spark, path, FACT_EVENT)
    if not broken.isEmpty():
        raise ValueError(f"broken line: {broken.first().line[:200]}")
    sound = invalid_reasons(events)
    bad = sound.where(F.size("invalid") > 0).first()
    if bad:
        raise ValueError(f"{bad.entity_id}: {', '.join(bad.invalid)}")
    rows, rejected = build_rows(sound.drop("invalid"), freeze, split)
    sorted_jsonl(rows, f"{out}/rows", "id")
    sorted_jsonl(rejected, f"{out}/rejections")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--score", default="gated_answer_match")
    a.add_argument("--baseline", required=True)
    a.add_argument("--study")
    a.add_argument("--rounds", type=int, default=5000)
    f = sub.add_parser("facts")
    f.add_argument("path")
    f.add_argument("--out", required=True)
    f.add_argument("--freeze", required=True)
    f.add_argument("--split", default="dev")
    args = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "analyze":
        print(analyze(spark, args.path, args.score, args.baseline, args.study, args.rounds))
    else:
        build_facts(spark, args.path, args.out, args.freeze, args.split)


if __name__ == "__main__":
    main()
