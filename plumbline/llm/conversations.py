"""Repairs the structure of conversations: the cheapest edits that make roles alternate, by signature.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Edits of a row: Keep (free, if its initial is the next one),
Rerole to user or assistant (2), Delete (3; required for blank rows and for duplicates), and Insert of a user or assistant without
text before it or at the end (2); a truncated row that is not deleted adds 1.  The cheapest edits are unique by their
audit, the initials of the edits in order, of which the least in ASCII is taken; the state of the pattern then tells all roles.

1. Rows are dealt by ranges of (conversation, turn, role, hash of the text) and sorted, so a conversation of any size is spread over
   partitions; a row's place is its partition and its number in it.  Duplicates are those whose place is after the
   first of their conversation, role and text; firsts are counts and minima, joined back with hot groups by broadcast.
2. Each row becomes a character, of its initial and fault.  Those of a conversation within 4,096 places make a segment, and a
   segment's characters its signature.  Nearly all conversations have one segment; signatures repeat, as they hold no text.
3. Each distinct signature is solved once, by a memoised recursion on its halves: the costs from each of the four states of
   the pattern to the end, then the edits.  Audits are joined back to the segments, hot signatures by broadcast.
4. A conversation of several segments is a chain: the costs of a segment as a matrix from states to states, solved once for each
   signature, are multiplied from the end (a row a segment, so one in 4,096 of its rows); then its segments are solved with the
   costs of what follows, and states carried on from the front.
5. Edits are replayed: an audit's pieces go to rows by their place, a key that no two rows share.

Defined results: null roles and texts are one space, a null conversation is one of its own, null turns come first; rows
equal in turn are in the order of role and md5 of the text; roles that are empty or have another initial than s, u, a can only
be reroled or deleted; a blank row is no duplicate, and neither is truncated; an empty table gives an empty result.  Only the four named columns
are read, so further ones do no harm.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import join_hot
from .scratch import prepare, table

#: A segment is a conversation's rows within so many places, as a power of two.
SEGMENT_BITS = 12
SPACE = "[\\x20\\x09-\\x0D]"

#: A row's character: its initial, in upper case if truncated; a digit if it must go.
SOUND, TRUNCATED, GONE = "suax", "SUAX", "1234"
#: States of the pattern: nothing yet, after s, after u, after a.  What a kept initial leads to, and what an insert or rerole does.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT, MADE = (2, 2, 3, 2), "uuau"
REROLE = INSERT = 2
DELETE = 3
#: Costs from each state when no row is left, and what is then inserted.
END, CLOSING = (0, 4, 2, 0), ("", "UA", "A", "")
NEVER = 10**9

Costs = tuple[int, ...]


def _row_costs(code: str, state: int, after: Costs) -> tuple[int, int, int]:
    """Of the edits Delete, Keep, Rerole of a row in this state, with what follows."""
    delete = DELETE + after[state]
    if code in GONE:
        return delete, NEVER, NEVER
    late = int(code in TRUNCATED)
    to = KEPT[state].get(code.lower())
    return delete, NEVER if to is None else late + after[to], REROLE + late + after[NEXT[state]]


def _level(costs: Costs) -> tuple[int, Costs]:
    least = min(costs)
    return least, tuple(min(c - least, NEVER) for c in costs)


@lru_cache(1 << 16)
def costs(piece: str, after: Costs) -> tuple[int, Costs]:
    """The cost from each state before ``piece`` to the end, where ``after`` are those behind it: the least, and how much more."""
    if len(piece) > 1:
        half = len(piece) // 2
        behind, middle = costs(piece[half:], after)
        before, first = costs(piece[:half], middle)
        return behind + before, first
    plain = [min(_row_costs(piece, state, after)) for state in range(4)]
    # an insert leads to the state after u or a, and two of them back; so one or two are enough
    u, a = min(plain[2], INSERT + plain[3]), min(plain[3], INSERT + plain[2])
    return _level((min(plain[0], INSERT + u), min(plain[1], INSERT + u), u, a))


@lru_cache(1 << 16)
def edits(piece: str, after: Costs, state: int) -> tuple[str, int, int]:
    """The cheapest edits of ``piece`` from a state on, the least by their audit: a word for each row, joined by commas; their cost; the
    state behind it.  A word has U or A for inserts, then k, u, a or d for what becomes of the row."""
    if len(piece) > 1:
        half = len(piece) // 2
        front, paid, middle = edits(piece[:half], costs(piece[half:], after)[1], state)
        back, more, last = edits(piece[half:], after, middle)
        return f"{front},{back}", paid + more, last
    least, here = costs(piece, after)
    here = [least + c for c in here]
    word, paid = "", 0
    while True:
        delete, keep, rerole = _row_costs(piece, state, after)
        if delete == here[state]:  # D, I, K, R in this order
            return word + "d", paid + DELETE, state
        if here[state] == INSERT + here[NEXT[state]]:
            word, paid, state = word + MADE[state].upper(), paid + INSERT, NEXT[state]
        elif keep == here[state]:
            to = KEPT[state][piece.lower()]
            return word + "k", paid + keep - after[to], to
        else:
            return word + MADE[state], paid + rerole - after[NEXT[state]], NEXT[state]


def breaks(signature: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    plain = signature.translate(str.maketrans(TRUNCATED + GONE, SOUND + SOUND))
    return sum(plain[n : n + 2] not in ("su", "ua", "au") for n in range(len(plain) - 1))


def _solved(batches):
    """(signature, after, state) with the words of its edits, their cost, the state behind it, and its breaks."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            words, paid, last = edits(r["signature"], tuple(r["after"]), r["state"])
            rows.append({"signature": r["signature"], "after": r["after"], "state": r["state"], "held": r["held"], "words": words, "cost": paid, "last": last, "breaks": breaks(r["signature"])})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("signature", pa.string()), ("after", pa.list_(pa.int32())), ("state", pa.int32()), ("held", pa.int64()), ("words", pa.string()), ("cost", pa.int64()), ("last", pa.int32()), ("breaks", pa.int64())]))


_SOLVED = "signature string, after array<int>, state int, held bigint, words string, cost bigint, last int, breaks bigint"


def solutions(segments: DataFrame) -> DataFrame:
    """``segments`` (signature, after, state, and more) with words, cost, last and breaks: each distinct one solved once."""
    on = ["signature", "after", "state"]
    asked = table(segments.groupBy(*on).agg(F.count("*").alias("held")), "asked")
    total = asked.agg(F.sum("held")).first()[0] or 0
    return join_hot(segments, table(asked.mapInArrow(_solved, _SOLVED), "solved"), on, "held", total)


def _matrix(signature: str) -> list[int]:
    """The cost from each state before a segment to each behind it; by the state behind, then the one before."""
    out = []
    for last in range(4):
        least, more = costs(signature, tuple(0 if s == last else NEVER for s in range(4)))
        out += [min(least + c, NEVER) for c in more]
    return out


def _matrices(batches):
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(list(map(_matrix, signatures)), pa.list_(pa.int64()))], names=["signature", "matrix"])


def _behind(rows: pd.DataFrame) -> pd.DataFrame:
    """For each segment of a conversation the costs behind it, without what all states have in common."""
    rows = rows.sort_values("segment")
    after, found = END, []
    for matrix in rows["matrix"].iloc[::-1]:
        found.append(list(after))
        after = _level(tuple(min(int(matrix[4 * b + a]) + after[b] for b in range(4)) for a in range(4)))[1]
    return pd.DataFrame({"conv": rows["conv"], "segment": rows["segment"], "after": found[::-1]})


def _entered(rows: pd.DataFrame) -> pd.DataFrame:
    """For each segment of a conversation the state before it."""
    rows = rows.sort_values("segment")
    state, found = 0, []
    for lasts in rows["lasts"]:
        found.append(state)
        state = int(lasts[state])
    return pd.DataFrame({"conv": rows["conv"], "segment": rows["segment"], "state": found})


def chained(segments: DataFrame) -> DataFrame:
    """Segments (conv, segment, signature) of conversations with several, with after and state."""
    signatures = segments.select("signature").distinct()
    matrices = signatures.mapInArrow(_matrices, "signature string, matrix array<bigint>")
    after = segments.join(matrices, "signature").select("conv", "segment", "matrix").groupBy("conv").applyInPandas(_behind, "conv string, segment bigint, after array<int>")
    following = table(segments.join(after, ["conv", "segment"]), "following")
    every = following.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("state"))
    lasts = F.transform(F.sort_array(F.collect_list(F.struct("state", "last"))), lambda x: x["last"]).alias("lasts")
    ends = solutions(every).groupBy("conv", "segment").agg(lasts)
    state = ends.groupBy("conv").applyInPandas(_entered, "conv string, segment bigint, state int")
    return following.join(state, ["conv", "segment"])


def _initial(role: Column, sets: str) -> Column:
    """The character of ``sets`` for a role's initial."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", sets[0]).when(first == "u", sets[1]).when(first == "a", sets[2]).otherwise(sets[3])


def placed(rows: DataFrame) -> DataFrame:
    """conv (the id as text, empty for null), turn, role, text, digest (md5 of the text), and place, in the order of conversation and
    turn."""
    texts = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # a number tells equal rows apart, so that a range can end between them
    order = ["conv", "turn", "role", "digest", "salt"]
    dealt = texts.withColumn("digest", F.md5("text")).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return table(dealt.drop("salt").withColumn("place", F.monotonically_increasing_id()), "placed")


def faults(at: DataFrame) -> DataFrame:
    """From ``placed``: conv, turn, place, role, blank, duplicate, truncated (of each row the first that holds alone)."""
    alike = ["conv", "role", "digest"]
    firsts = table(at.groupBy(*alike).agg(F.min("place").alias("first"), F.count("*").alias("held")).where("held > 1"), "firsts")
    total = firsts.agg(F.sum("held")).first()[0] or 0
    repeats = join_hot(at.select(*alike, "place"), firsts, alike, "held", total).where("place > first").select("place", F.lit(True).alias("again"))
    blank = F.regexp_replace("text", SPACE, "") == ""
    open_end = ~F.col("text").rlike(f"[.!?]{SPACE}*\\z")
    marked = at.select("conv", "turn", "place", "role", blank.alias("blank"), open_end.alias("open")).join(repeats, "place", "left")
    again = F.coalesce("again", F.lit(False))
    return marked.select("conv", "turn", "place", "role", "blank", (~F.col("blank") & again).alias("duplicate"), (~F.col("blank") & ~again & F.col("open")).alias("truncated"))


def audits(found: DataFrame) -> DataFrame:
    """From ``faults``: the segments of each conversation, solved: conv, segment, first (place), signature, words, cost, breaks."""
    code = F.when(F.col("blank") | F.col("duplicate"), _initial(F.col("role"), GONE)).when(F.col("truncated"), _initial(F.col("role"), TRUNCATED)).otherwise(_initial(F.col("role"), SOUND))
    held = F.sort_array(F.collect_list(F.struct("place", code.alias("code"))))
    segments = found.groupBy("conv", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(F.min("place").alias("first"), F.array_join(F.transform(held, lambda x: x["code"]), "").alias("signature"))
    segments = table(segments, "segments")
    several = table(segments.groupBy("conv").agg(F.count("*").alias("n"), F.max("segment").alias("final")).where("n > 1").drop("n"), "several")
    alone = segments.join(several, "conv", "left_anti").withColumns({"after": F.array(*map(F.lit, END)), "state": F.lit(0), "final": F.col("segment")})
    many = segments.join(several, "conv", "left_semi")
    if not several.isEmpty():
        alone = alone.unionByName(chained(many).join(several, "conv"))
    solved = solutions(table(alone, "asking"))
    closing = F.when(F.col("segment") == F.col("final"), F.element_at(F.array(*map(F.lit, CLOSING)), F.col("last") + 1)).otherwise("")
    return table(solved.select("conv", "segment", "first", "signature", F.concat("words", closing).alias("words"), (F.col("cost") + INSERT * F.length(closing)).alias("cost"), "breaks"), "audits")


def replayed(at: DataFrame, solved: DataFrame) -> DataFrame:
    """From ``placed`` and ``audits``: the rows after repair, conv, place, step, role, text, in the order of place and step."""
    words = solved.select("first", F.posexplode(F.split("words", ",")).alias("n", "word")).select((F.col("first") + F.col("n")).alias("place"), "word")
    steps = at.select("conv", "place", "role", "text").join(words, "place").select("conv", "place", "role", "text", F.posexplode(F.split("word", "")).alias("step", "edit")).where("edit not in ('', 'd')")
    made = F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role"))
    return steps.select("conv", "place", "step", made.alias("role"), F.when(F.col("edit").isin("U", "A"), "").otherwise(F.col("text")).alias("text"))


def repaired(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after repair: conv_id, position (rising within a conversation, with gaps), role, text."""
    prepare(rows.sparkSession)
    at = placed(rows)
    out = replayed(at, audits(table(faults(at), "faults")))
    return out.select(_id(F.col("conv")).alias("conv_id"), F.struct("place", "step").alias("position"), "role", "text")


def _id(conv: Column) -> Column:
    return F.when(conv != "", conv).cast("bigint")


def _digests(batches):
    """A conversation's hash, line by line: it is made in order, and needs no more than a line at a time."""
    conv, digest = None, None
    for batch in batches:
        out = []
        for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if own != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.string()) for n in (0, 1)], names=["conv", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])


def audited(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of its lines
    ``role:text`` after repair, joined by newlines; a hash is made in order, so each one is one task's stream)."""
    prepare(rows.sparkSession)
    at = placed(rows)
    found = table(faults(at), "faults")
    solved = audits(found)
    count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    turns = found.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    # neighbours in different segments: the last and first characters of these
    plain = F.translate("signature", TRUNCATED + GONE, SOUND + SOUND)
    parts = F.sort_array(F.collect_list(F.struct("segment", F.translate("words", "UAkuad,", "IIKRRD").alias("audit"), F.concat(F.substring(plain, 1, 1), F.substring(plain, -1, 1)).alias("ends"))))
    whole = solved.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("breaks").alias("breaks"), parts.alias("parts"))
    seams = F.expr("size(filter(sequence(1, size(parts)), i -> i < size(parts) and concat(substring(parts[i - 1].ends, 2, 1), substring(element_at(parts, least(i + 1, size(parts))).ends, 1, 1)) not in ('su', 'ua', 'au')))")
    whole = whole.select("conv", "cost", (F.col("breaks") + seams).alias("illegal"), F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"))
    lines = replayed(at, solved).repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "role", "text")
    digests = lines.mapInArrow(_digests, "conv string, sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return turns.join(whole, "conv").join(digests, "conv", "left").select(_id(F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


def with_all(ids: DataFrame, result: DataFrame) -> DataFrame:
    """``result`` of ``audited``, and for those conversations of ``ids`` (conv_id) that have no rows what an empty one has."""
    key = lambda df: df.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    every = key(ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct())
    joined = every.join(key(result).drop("conv_id"), "conv", "left").drop("conv")
    blanks = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.withColumns(blanks | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` with faults that crc32(``conv_id:turn``) modulo 20 tells: 0 drops a row, 1 empties its text, 2
    removes the ends of sentences, 3 repeats it, 4 makes it the user's.  Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
