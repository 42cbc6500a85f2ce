import random
import re
from itertools import combinations

import pytest

from plumbline.llm.jaccard import deduplicated, near_duplicates

from tests_llm_util import THUE_MORSE

SCHEMA = "doc_id bigint, text string, n bigint, node string, component string"


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, len(sets[n]), least.get(find(n))) for n, (i, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for n in range(40):
        base = text(rng.randint(6, 120))
        rows.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy[rng.randint(0, 6) :])
    hot = text(100)
    for n in range(60):
        copy = list(hot)
        copy[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append(copy)
        rows.append(passage + text(rng.randint(4, 30)))
    return [(1000 - n, " ".join(r)) for n, r in enumerate(rows)]


CASES = {
    "empty table": [],
    "small": [(3, None), (4, ""), (5, " \n"), (6, "A b"), (7, "a B"), (8, "a b c d e"), (9, "Ä x"), (2, "ä x"), (10, "A B C D E"), (None, "a b c d e"), (10, "zz")] + [(20 + n, f"{w} x y z w") for n, w in enumerate(THUE_MORSE)],
    "corpus": corpus(),
    "long": [(1, " ".join(f"w{n}" for n in range(20000))), (2, " ".join(f"w{n}" for n in range(1000, 20000))), (3, " ".join(f"w{n}" for n in range(9000)))],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(d, t, 1, "clash", "clash") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == expected(rows)


def test_links_between_members_of_one_group(spark):
    """Texts a, b and c have one size and prefix, and no other text has its shingles; a and b alone are similar."""
    rows, want = [], {}
    for f in range(8):
        words = lambda name, n: [f"{f}{name}{k}" for k in range(n)]  # noqa: B023, E731
        rare, most = words("rare", 11), words("most", 24)
        rows += [(100 * f + 1, rare + most + words("a", 5)), (100 * f + 2, rare + most + words("b", 5)), (100 * f + 3, rare + words("c", 29))]
        # long texts without links, so that all but the rare words are frequent
        rows += [(100 * f + n, most + words("a", 5) + words("b", 5) + words("c", 29) + words(f"own{n}x", 60)) for n in range(4, 8)]
        want |= {100 * f + n: 100 * f + (1 if n == 2 else n) for n in range(1, 8)}
    df = spark.createDataFrame([(d, " ".join(t), 1, "clash", "clash") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, k=1).collect()}
    assert got == want


def test_components_that_share_an_id_keep_a_row_each(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, text("a")), (2, text("a")), (1, text("b")), (3, text("b")), (5, text("c")), (5, text("d"))]
    df = spark.createDataFrame([(d, t, 1, "clash", "clash") for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in deduplicated(df).collect())
    assert got == [(1, text("a")), (1, text("b")), (5, text("c")), (5, text("d"))]
