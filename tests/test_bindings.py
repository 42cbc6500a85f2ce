import random

from plumbline.operators import paired
from plumbline.plans.bindings import QUERIES, event_rows


def pages(spark, path, rows):
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_compression_reads_whole_pages(spark, tmp_path):
    rng = random.Random(3)
    head, noise = "same words " * 30, lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    rows = [(n, f"https://h.example/{n}", f"<p>{head}</p>" + (noise() if 150 <= n < 300 else head * 9)) for n in range(450)]
    got = {r.row_id: r.compression_redundancy for r in QUERIES["score_compression_redundancy"](spark, pages(spark, tmp_path, rows)).collect()}
    # what follows character 200 tells them apart, and six pages make a row; row 0 shows no snippets
    assert set(got) == set(range(75)) and got[0] is None and abs(got[1] - got[30]) > 0.5
    assert got[1] == got[2] and all(got[n] is None for n in range(0, 75, 7))


def test_cluster_bootstrap_has_the_operators_rounds(spark):
    d = "/root/testdata/sf0.001"
    want = paired.cluster_bootstrap(event_rows(spark, d), ["condition"], "score", "task_key").collect()
    assert sorted(QUERIES["cluster_bootstrap"](spark, d).collect()) == sorted(want)


def test_release_audit_shows_long_texts(spark, tmp_path):
    d = pages(spark, tmp_path, [(1, "https://h.example/" + "x" * 150, ""), (2, "https://h.example/", "")])
    got = {r.problem: r.n for r in QUERIES["release_audit"](spark, d).collect()}
    assert got == {"url in url": 2, "long text in url": 1}
