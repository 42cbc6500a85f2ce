import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import wordblocks as W
from plumbline.llm.bpe import ByteBpe
from plumbline.llm.packing import Plan, best_fill, pack

from tests_llm_util import THUE_MORSE

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  two  spaces ", "it's I'll 'tis don''t", "\n\n x\n y \t\tz\r\n", "naïve Ünïcode 漢字 かな 123abc４５", "a\xa0b  c\x85d 　", "!!?? ## $$a$$ -- 'x", "é \U0001f600\U0001f600 ‍ x", " lead", "trail \n", "x" * 3000, "\x00\x1c \x1d\x1e", "٣٤ ½ ² Ⅷ", "<|endoftext|> a"]


def test_ids_equal_the_tokenizer():
    rng = random.Random(3)
    alphabet = "abcXYZ  \n\t'.,!#é漢½²٣\xa0 ​\x85"
    texts = ODD + THUE_MORSE + [" ".join(THUE_MORSE)] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    whole = Tokenizer.from_file(PATH)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    bpe = ByteBpe.load(PATH)
    for lo in range(0, len(texts), 500):
        ids, begin = bpe.encode(*W.utf8(pa.array(texts[lo : lo + 500])))
        for n, expect in enumerate(want[lo : lo + 500]):
            assert ids[begin[n] : begin[n + 1]].tolist() == expect, texts[lo + n]


def test_best_fill_is_best():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(0, 3) for _ in range(4)}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        used = best_fill(counts, room)
        assert all(n <= counts[x] for x, n in used.items())
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("counts", [{}, {64: 3}, {40: 5}, {40: 1000, 3: 2}, {63: 10, 62: 9, 1: 1}, {x: (x * 7) % 5 for x in range(1, 65)}])
def test_plan_uses_every_piece_once(counts):
    plan = Plan(counts, 64)
    filled, seen = {}, {}
    for layer, length, rank, count, at, size, sequence, offset in plan.entries:
        for k in range(count):
            filled.setdefault(sequence + k, []).append((offset, size))
            seen.setdefault((length, rank + k), []).append((at, size))
    assert set(seen) == {(x, r) for x, n in counts.items() for r in range(n)}
    for (length, _), parts in seen.items():
        assert np.cumsum([0] + [s for _, s in sorted(parts)]).tolist() == [a for a, _ in sorted(parts)] + [length]
    for parts in filled.values():
        ends = np.cumsum([0] + [s for _, s in sorted(parts)]).tolist()
        assert ends[:-1] == [o for o, _ in sorted(parts)]
        assert ends[-1] in (1, 2, 4, 8, 16, 32, 64)
    assert set(filled) == set(range(plan.sequences))


def test_pack(spark):
    rng = random.Random(2)
    texts = ODD + THUE_MORSE + [None, "word " * 5000] + ["same text " * 700] * 30 + [" ".join(rng.choice(["alpha", "beta", "γ", "12"]) for _ in range(rng.randint(0, 4000))) for _ in range(40)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(3, ODD[3]), (None, "no id"), (5, "other text of an id")]
    df = spark.createDataFrame([(d, t, 7, "clash", 1, "c") for d, t in rows], "doc_id bigint, text string, start bigint, key string, length int, rank string")
    out = [r.asDict() for r in pack(df, PATH).collect()]
    whole = Tokenizer.from_file(PATH)
    ids = sorted(((d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in rows), key=lambda x: (str(x[0]), len(x[1])))
    assert sum(r["length"] for r in out) == sum(len(i) for _, i in ids)
    by_doc = {}
    for d, i in ids:
        by_doc.setdefault((d, len(i)), []).append(i)
    for r in out:
        assert any(zlib.crc32(i[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for i in by_doc[r["doc_id"], r["doc_tokens"]])
    for (d, n), copies in by_doc.items():
        parts = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == d and r["doc_tokens"] == n)
        covered = np.zeros(n, int)
        for s, m in parts:
            covered[s : s + m] += 1
        assert (covered == len(copies)).all()
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([0] + [m for _, m in sorted(parts)]).tolist()
        assert ends[:-1] == [o for o, _ in sorted(parts)] and ends[-1] <= 2048 and ends[-1] & ends[-1] - 1 == 0


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
