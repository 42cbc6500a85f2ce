"""Every operator and stage on input whose columns have names that operators use themselves."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import conversations, debruijn, fingerprints, importance, jaccard, langid, linefreq, mixing, ordinal, packing, scratch, simhash, toxicity, urlfilter
from tests_llm_util import INTERNAL, documents_dir

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = documents_dir(spark, tmp_path_factory.mktemp("clash"))
    plain = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 40")
    wide = plain.select("*", *(F.lit(f"own {n}").alias(n) for n in INTERNAL if n not in plain.columns), F.lit(1).alias("a.dot `tick"))
    return plain, wide, spark.read.parquet(f"{d}/labels.parquet")


OPERATORS = {
    "packing": lambda d, _: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
    "mixing": lambda d, _: mixing.mix(d),
    "linefreq": lambda d, _: linefreq.judge(d),
    "langid": lambda d, _: langid.identify(d, public_tokenizers.path("piece_bpe_32k.model"), most=5),
    "toxicity": lambda d, l: toxicity.score(d, l),
    "fingerprints": lambda d, _: fingerprints.compare_neighbours(d),
    "conversations": lambda d, _: conversations.repaired(conversations.damaged(d.withColumns({"conv_id": F.col("doc_id"), "turn": F.col("doc_id"), "role": F.lit("user")}).withColumn("conv_id", F.explode(F.array("conv_id", F.lit(-1)))))),
    "importance": lambda d, _: importance.resample(d, d.limit(3)),
    "simhash": lambda d, _: simhash.near_duplicates(d),
}
#: Operators that return the columns of their input; near duplicates and repeated spans come from the same code as their digests.
ROWS = {
    "deduplicated": lambda d, _: jaccard.deduplicated(d),
    "spans removed": lambda d, _: debruijn.cleaned(d),
    "lines removed": lambda d, _: linefreq.cleaned(d, limit=5),
    "mixed": lambda d, _: mixing.repeated(d),
    "accepted": lambda d, l: ordinal.accepted(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_depend_on_other_columns(tables, name):
    plain, wide, labels = tables
    assert sorted(map(str, OPERATORS[name](wide, labels).collect())) == sorted(map(str, OPERATORS[name](plain, labels).collect()))


@pytest.mark.parametrize("name", ROWS)
def test_other_columns_stay(tables, name):
    plain, wide, labels = tables
    out = ROWS[name](wide, labels)
    assert out.columns == wide.columns
    got, want = out.collect(), ROWS[name](plain, labels).collect()
    assert got and sorted(str(r[: len(plain.columns)]) for r in got) == sorted(str(tuple(r)) for r in want)
    fixed = {str(r[len(plain.columns) :]) for r in wide.collect()}
    assert {str(r[len(plain.columns) :]) for r in got} == fixed


def test_rate_and_urls(spark, tables):
    plain, wide, labels = tables
    out = ordinal.rate(wide, labels)
    assert set(out.columns) == set(wide.columns) and out.where("selected").count() == ordinal.accepted(plain, labels).count()
    pages = wide.select("*", F.col("doc_id").alias("page_id"), F.lit("http://h.org/x").alias("url"), F.lit("2024-05-05").cast("date").alias("fetched"))
    events = spark.createDataFrame([("domain", "h.org", "add", 1)], "kind string, entry string, action string, seq int").withColumn("day", F.lit("2024-01-01").cast("date"))
    assert {r.allowed for r in urlfilter.judge_urls(pages, events).collect()} == {False}


@pytest.mark.parametrize("name", [*OPERATORS, *ROWS])
def test_null_texts_and_ids(spark, name):
    rows = [(None, None, None, None, None), (None, "a b c " * 20, "en", None, 3), (3, None, None, "s", None), (3, "a b c " * 20, "en", "s", 3), (3, "a b c " * 20, "en", "s", 3), (4, "", "de", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(None, 1, 0), (3, None, None), (4, 1, 1)], LABELS)
    out = (OPERATORS | ROWS)[name](docs, labels).collect()
    assert len(out) >= (6 if name in OPERATORS and name != "conversations" else 0)


def test_tables_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_ROOT", {})

    class Context:
        applicationId, master = "other", "spark://far:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext, conf = Context(), spark.conf

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.folder(Session())


def test_hot_keys_are_joined_once(spark):
    from plumbline.llm.frames import join_hot

    left = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("last")).where("k != 'k3'")
    got = join_hot(left, right, ["k"], "rows", 6000)
    assert sorted(map(tuple, got.select("id", "k", "last").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "k", "last").collect()))
    assert join_hot(left, right.limit(0), ["k"], "rows", 6000).collect() == []
