"""Each stage against the brute-force version of its operator."""

import hashlib

import corpus_pipeline
from test_debruijn import expected as brute_spans
from test_jaccard import expected as brute_components
from test_mixing import brute_targets
from tests_llm_util import documents_dir


def test_stages_and_run(spark, tmp_path):
    d = documents_dir(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {"start": [r.asDict() for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [r.asDict() for r in docs.collect()]
    texts = {name: sorted((r["doc_id"], r["text"]) for r in rows) for name, rows in seen.items()}
    # quality: junk goes, all else stays
    assert {i for i, _ in texts["quality"]} == set(range(60))
    # near duplicates: the smallest id of each component
    assert [i for i, _ in texts["near_duplicates"]] == [i for i, n, c in sorted(brute_components(texts["quality"])) if i == c or not n]
    # repeated spans: what brute force keeps
    kept = {i: h for i, _, gone, h in brute_spans(texts["near_duplicates"]) if gone}
    before = dict(texts["near_duplicates"])
    for i, t in texts["repeated_spans"]:
        assert hashlib.sha256(t.encode()).hexdigest() == kept[i] if i in kept else t == before[i]
    assert kept and all(r["n_chars"] == len(r["text"]) for r in seen["repeated_spans"])
    # mixture: whole copies near each source's target
    sizes, took = {}, {}
    for name, into in (("repeated_spans", sizes), ("mixture", took)):
        for r in seen[name]:
            into[r["source"]] = into.get(r["source"], 0) + len(r["text"].split())
    for s, goal in brute_targets(sizes).items():
        assert abs(took.get(s, 0) - goal) <= max(len(r["text"].split()) for r in seen["repeated_spans"] if r["source"] == s)
    # packing: every token once
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts["mixture"]}
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)
