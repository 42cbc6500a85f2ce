"""Scans: JSON lines, CSV, release folders, archives of JSON, parallel arrays, ownership XML, captured responses.

Readers take explicit schemas; nothing is inferred.  Archives are read member by member on the executors.
"""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives

MEMBER_LIMIT = 100 << 20


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that is no record of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and broken lines with their file; blank lines are skipped."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).where("trim(value) != ''")
    rows = raw.withColumn("r", F.from_json("value", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    return rows.where("r.__bad is null").select("r.*").drop("__bad"), rows.where("r.__bad is not null").select("file", F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) in file order: whole files, so for manifests and exports of one file each."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("trim(value) != ''")


def release(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All *.jsonl of a folder, the file's stem as split."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; empty and NaN become null."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema.fields])


def zipped_json(spark: SparkSession, path: str, members: list[str] | None = None, need: str | None = None, limit: int = MEMBER_LIMIT) -> DataFrame:
    """(archive, member, doc, too_large) of JSON members, without unpacking the archive.

    ``members`` names those wanted, ``need`` a key that a document must have; members above ``limit`` bytes are reported
    with a null doc instead of being read.  Members are read by their ranges; where a store is known to Spark alone, a task reads
    whole archives.
    """
    if archives.supported(path):
        return archives.zip_members(spark, path, members, need, limit)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    wanted = set(members) if members is not None else None

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir() and i.filename.endswith(".json") and (wanted is None or i.filename in wanted)]
                    for i in infos:
                        doc = z.read(i).decode("utf-8", "replace") if i.file_size <= limit else None
                        if doc is None or need is None or need in json.loads(doc):
                            yield pd.DataFrame({"archive": [name], "member": [i.filename], "doc": [doc], "too_large": [doc is None]})

    return files.mapInPandas(run, "archive string, member string, doc string, too_large boolean")


def parallel_arrays(docs: DataFrame, block: str, fields: list[str]) -> DataFrame:
    """Rows from a struct of equally long arrays; unequal lengths are an error."""
    sizes = [F.size(f"{block}.{f}") for f in fields]
    same = F.greatest(*sizes) == F.least(*sizes)
    zipped = F.when(same, F.arrays_zip(*[F.col(f"{block}.{f}").alias(f) for f in fields])).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return docs.select(*[c for c in docs.columns if c != block], F.inline(zipped))


def item_filings(rows: DataFrame, form: str, item: str, since: str, until: str) -> DataFrame:
    """Filings of a form with an exact item code, filed within two days inclusive."""
    codes = F.transform(F.split("items", ","), lambda x: F.trim(x))
    return rows.where((F.col("form") == form) & F.array_contains(codes, item) & F.col("filing_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def xml_text(xml: Column, path: str) -> Column:
    """An element's text, or that of its ``value`` child; blank is null."""
    text = lambda p: F.nullif(F.trim(F.xpath_string(xml, F.lit(p))), F.lit(""))
    return F.coalesce(text(f"{path}/value"), text(path))


def ownership(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Fields of an ownership document; an officer without a title is an error."""
    from ..functions.text import is_true_flag, period_date

    x = lambda p: xml_text(F.col(xml), f"/ownershipDocument/{p}")
    owner = "reportingOwner[1]/reportingOwnerRelationship"
    officer = is_true_flag(x(f"{owner}/isOfficer"))
    title = x(f"{owner}/officerTitle")
    return docs.select(
        *[c for c in docs.columns if c != xml],
        x("documentType").alias("form_type"),
        F.lpad(x("issuer/issuerCik"), 10, "0").alias("issuer_cik"),
        x("issuer/issuerName").alias("issuer_name"),
        F.lpad(x("reportingOwner[1]/reportingOwnerId/rptOwnerCik"), 10, "0").alias("owner_cik"),
        x("reportingOwner[1]/reportingOwnerId/rptOwnerName").alias("owner_name"),
        period_date(x("periodOfReport")).alias("period_of_report"),
        officer.alias("is_officer"),
        is_true_flag(x(f"{owner}/isDirector")).alias("is_director"),
        F.when(officer & title.isNull(), F.raise_error(F.lit("officer without title"))).otherwise(title).alias("officer_title"),
    )


def revision_candidates(docs: DataFrame) -> DataFrame:
    """From (title, sections array<struct<level,line>>, externallinks array<string>): level 2 and 3 titles and distinct
    external URLs in order (S25)."""
    titles = F.transform(F.filter("sections", lambda s: s["level"].isin("2", "3")), lambda s: s["line"])
    links = F.array_sort(F.array_distinct(F.filter("externallinks", lambda u: u.rlike("^https?://"))))
    return docs.select(*[c for c in docs.columns if c not in ("sections", "externallinks")], titles.alias("section_titles"), links.alias("external_urls"))


def finished_matches(docs: DataFrame) -> DataFrame:
    """Finished matches with the result of the highest (order, type)."""
    best = F.array_max(F.transform("results", lambda r: F.struct(r["order"].alias("order"), r["type"].alias("type"), r["home"].alias("home"), r["away"].alias("away"))))
    return docs.where("finished and size(results) > 0").select(*[c for c in docs.columns if c not in ("results", "finished")], best["home"].alias("home_score"), best["away"].alias("away_score"))


def completed_events(docs: DataFrame) -> DataFrame:
    """Events with both scores, both teams and a time."""
    full = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("home_score", "away_score", "home_team", "away_team", "timestamp")]
    keep = full[0]
    for c in full[1:]:
        keep = keep & c
    return docs.where(keep).withColumn("home_score", F.col("home_score").try_cast("int")).withColumn("away_score", F.col("away_score").try_cast("int"))


def last_two(revisions: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """The newest and the one before, of keys that have both."""
    newest = F.slice(F.sort_array(F.collect_list(F.struct(order, payload)), asc=False), 1, 2)
    return revisions.groupBy(key).agg(newest.alias("__r")).where(F.size("__r") == 2).select(key, F.get("__r", F.lit(0))[payload].alias("after"), F.get("__r", F.lit(1))[payload].alias("before"))


def current_claims(claims: DataFrame, ended: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Claims without an end time, with a reference where there is one."""
    return claims.join(ended.select(key).distinct(), key, "left_anti").join(references, key, "left")


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Names of ids from a label table."""
    names = labels.select(F.col("id").alias(column), F.col("label").alias(f"{column}_label"))
    return rows.join(names, column, "left")
