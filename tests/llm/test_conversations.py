import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from plumbline.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, conv string, segment int"
SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    """The result for one conversation's (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts=0):
        """Least (cost, audit, lines) from row i on; state is what was last kept."""
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        turn = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[turn]
        if inserts < 2:
            c, a, lines = best(i, turn, inserts + 1)
            found.append((c + 2, "I" + a, (f"{name}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, state)
            found.append((c + 3, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if role[:1] == turn or role[:1] == "s" and not state:
                    c, a, lines = best(i + 1, role[0])
                    found.append((c + late, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(i + 1, turn)
                found.append((c + late + 2, "R" + a, (f"{name}:{text}", *lines)))
        return min(found, default=(10**6, "", ()))

    cost, audit, lines = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(n, longest, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "u", "ask"]
    texts = ["Fine.", "No end", "", " \t", None, "Ends! \n", "é", "zwei\x85", "x" * 300 + "?"]
    rows = []
    for c in [None, *range(-1, n)]:
        size = rng.randint(1, longest)
        for t in range(size):
            turn = None if rng.random() < 0.03 else t * rng.choice([1, 1, 1, 2]) - rng.choice([0, 0, 5])
            role = ("system" if t == 0 else ["assistant", "user"][t % 2]) if rng.random() < 0.6 else rng.choice(roles)
            rows.append((c, turn, role, f"Row {t}{rng.choice(['.', ' '])}" if rng.random() < 0.6 else rng.choice(texts)))
    return rows


@pytest.mark.parametrize("bits, n, longest", [(12, 60, 9), (0, 8, 12), (2, 20, 40)])
def test_audited(spark, monkeypatch, bits, n, longest):
    """Conversations in one segment, and as chains of segments."""
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)
    rows = conversations(n, longest, bits)
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in C.audited(df).collect()}
    want = {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_repaired(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Ho"), (1, 1, "user", "Ho"), (2, 3, "system", "S."), (2, 4, "user", "Q?"), (2, 5, "assistant", "A."), (2, 6, "user", ""), (3, 0, "user", " ")]
    out = C.repaired(spark.createDataFrame([(*r, "", "", 1) for r in rows], SCHEMA)).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.role, r.text) for r in out] == [(1, "user", ""), (1, "assistant", "Hi."), (2, "system", "S."), (2, "user", "Q?"), (2, "assistant", "A.")]


def test_long_signatures():
    rng = random.Random(1)
    long = "".join(rng.choice("suaxSUAX1234uauaua") for _ in range(20000))
    words, cost, last = C.edits(long, C.END, 0)
    words = words.split(",")
    assert len(words) == 20000 and {w[-1] for w in words} == set("kuad")
    least, more = C.costs(long, C.END)
    assert cost + C.END[last] == least + more[0]


def test_damage(spark):
    rows = [(c, t, r, "One. Two!") for c in [None, *range(30)] for t, r in [(None, "user"), (0, None), (1, "assistant"), (2, "user")]]
    out = [tuple(r) for r in C.damaged(spark.createDataFrame([(*r, "", "", 1) for r in rows], SCHEMA)).collect()]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else r or " ", {1: "", 2: "One Two"}.get(kind, x))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(str, out)) == sorted(map(str, want)) and len(set(map(len, [out, want]))) == 1


def test_conversations_without_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.", "", "", 1)], SCHEMA)
    ids = spark.createDataFrame([(1,), (None,), (7,), (7,)], "conv_id bigint")
    out = {r.conv_id: tuple(r)[1:] for r in C.with_all(ids, C.audited(rows)).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == {1: brute([(0, "user", "A.")]), None: empty, 7: empty}
    assert C.audited(rows.limit(0)).collect() == []
