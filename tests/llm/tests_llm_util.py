"""A small corpus for tests of whole runs."""

import random

#: Two words that no polynomial hash modulo 2**64 tells apart, whatever its base.
THUE_MORSE = ["".join(letters[n.bit_count() & 1] for n in range(2048)) for letters in ("ab", "ba")]

#: Names that operators use for columns of their own.
INTERNAL = "id key kept row rows bucket block range extra start edges source_start words host line check lost gone times alike size place prefix shared node component group token selected tail_probability expected_grade grade rank __id __key __kept __times __copy __gone __tail __expected n_frequent_words".split()


def documents_dir(spark, tmp_path):
    rng = random.Random(11)
    words = [f"term{n}" for n in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(80), " ".join(f"passage{n}" for n in range(50))
    rows = [(0, base), (1, base), (2, base + " end")]
    rows += [(n, text(30) + "\n" + passage + " " + text(60)) for n in range(3, 9)]
    rows += [(n, text(rng.randint(20, 200))) for n in range(9, 60)]
    rows += [(n, "### junk ### " * 10) for n in range(60, 80)]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows]
    out = str(tmp_path / "tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out
