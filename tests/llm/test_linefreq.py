import re
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm.linefreq import _again, cleaned, judge
from tests_llm_util import THUE_MORSE

SCHEMA = "doc_id bigint, text string, source string, host string, lines string, key string"


def expected(rows, limit):
    texts = defaultdict(set)
    norm = lambda line: tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                texts[host, norm(line)].add(text)
    out = []
    for doc, text, host in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeat = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if norm(x)]
        lost = sum(len(norm(x)) for x in lines if len(texts[host, norm(x)]) > limit)
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed, lost, not failed and 100 * lost <= 50 * len(words)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    body = lambda n: " ".join(f"wörd{n}x{k}" for k in range(30))
    rows = [(n, f"Menu  Home\n{body(n)}\n\nMENU home\nend{n % 3}\r", f"s{n % 2}") for n in range(20)]
    rows += [(100 + n, "\n".join(["Menu home about us now", "other line of the site here", f"x{n}"] * 1), "s1") for n in range(12)]
    rows += [(50, None, "s0"), (51, "", None), (52, "\n\n \n", "s0"), (53, "### a | <b> $ " * 40, None), (54, "a b c d e f " * 30, "s0"), (None, body(1), "s0"), (3, body(2), "s0"), (3, body(2), "s0"), (55, " ".join(f"k{n}" for n in range(30000)), "s1"), (56, "\x85  x y " + body(7), "s1")]
    rows += [(60, "\n".join(THUE_MORSE), "s0"), (61, " ".join(f"{w} b c d e" for w in THUE_MORSE), "s0")] + [(62 + n, f"{THUE_MORSE[n // 4]} line\n{body(60 + n)}", "s2") for n in range(8)]
    df = spark.createDataFrame([(a, b, c, "z", "z", "z") for a, b, c in rows], SCHEMA)
    out = judge(df, limit=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept")
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(rows, 5)


def test_empty(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frequent_lines_are_cut(spark):
    body = lambda n: " ".join(f"wörd{n}x{k}" for k in range(30))
    rows = [(n, f"Menu  Home\n{body(n)}\n\nMENU home\nend{n % 3}\r", f"s{n % 2}") for n in range(20)]
    rows += [(100 + n, "\n".join(["Menu home about us now", "other line of the site here", f"x{n}"]), "s1") for n in range(12)]
    rows += [(50, None, "s0"), (51, "menu home\n" + body(50), None), (52, body(51) + "\nmenu home", "s0"), (None, body(1), "s0"), (3, body(2) + "\n", "s0"), (3, body(2) + "\n", "s0")]
    norm = lambda line: " ".join(line.lower().split())
    texts = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            texts[host, norm(line)].add(text)
    kept = {e[0]: e[-1] for e in expected(rows[:-2], 5)} | {3: True}
    want = [(i, "\n".join(x for x in (t or "").split("\n") if not norm(x) or len(texts[h, norm(x)]) <= 5), h) for i, t, h in rows if kept[i]]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id bigint, text string, source string, n_chars bigint")
    out = cleaned(df, limit=5).collect()
    assert sorted((tuple(r)[:3] for r in out), key=str) == sorted(want, key=str)
    assert out and all(r.n_chars == len(r.text) for r in out) and not any("home" in r.text.lower() for r in out if r.source)


def test_hashes_that_collide_are_told_apart():
    values = np.array([1, 2, 1, 2, 3])
    hashed = lambda seed: np.zeros(5, np.uint64) if seed == 0 else values.astype(np.uint64)
    twice, before = _again(np.zeros(5, int), hashed, lambda a, b: values[a] == values[b])
    assert twice.tolist() == [True, True, True, True, False] and before.tolist() == [False, False, True, True, False]
