"""Near-duplicate groups by word-shingle Jaccard similarity: a grouped prefix join.

Two documents link when their sets of distinct 5-word shingles have similarity of 0.75 or more.  The join finds
all components of links; only the order of shingles, not the result, depends on statistics.

1. ``exchange``: every shingle goes, as a hash, to its bucket, which counts the documents that hold it.
   Shingles that only one document holds cannot link it to others; the rest come back with their counts.
2. Rare shingles first, a document's prefix is its first ``n - ceil(0.75 n) + 1`` shingles: linked
   documents share one of these.  Documents without a shared shingle in the prefix are done.
3. Documents with equal sets form one node; nodes with the same size and prefix form one group, and only
   groups send their prefix, a row a shingle, to the join.
4. First each node is paired, in two rounds, with the head of the most central group alone among those of other
   components that it shares a shingle with, and verified; links make components.  So a group of thousands of near
   copies costs pairs in proportion to its size.
5. Then the groups join on their prefix shingles.  A pair of groups is dropped if their sizes are too far apart, if what
   follows the shingle is too little, or if all their members lie in one component already; each pair that is left counts
   once, is expanded to its members of different components, and these are verified by their whole sets.  So no
   link between components is lost.
6. Components follow from links by the large-star, small-star algorithm, in Spark joins alone.

Shingles are compared by 64-bit hashes (see ``wordblocks``): two given documents of ten thousand words each have one
pair of different shingles with equal hashes once in 10**11 cases, and are then misjudged only at the very limit.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; with
fewer than five words the whole sequence is one shingle; only A-Z is lower-cased; rows that repeat an id are
documents of their own, which may link; an empty table gives an empty result; further columns, of any name, stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import wordblocks as W
from .frames import beside, join_hot, own
from .scratch import drop, prepare, table

_NODES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("unique", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])
_NODES_DDL = "doc_id bigint, key bigint, n bigint, node binary, unique bigint, prefix array<bigint>, shared array<bigint>"

#: Rounds of pairing nodes with centres alone before all open pairs are tried.
STAR_ROUNDS = 2


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingles(data: np.ndarray, where: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, rising, and where each text's begin."""
    data = W.LOWER[data]
    starts, ends, first = W.words(data, where)
    hashes = W.span_hashes(data, starts, ends)
    grams, begin = W.gram_hashes(hashes, first, k)
    sets = []
    for n in range(len(where) - 1):
        if begin[n] < begin[n + 1]:
            sets.append(np.unique(grams[begin[n] : begin[n + 1]]))
        elif first[n] < first[n + 1]:
            few = hashes[first[n] : first[n + 1]]
            sets.append(W.gram_hashes(few, np.array([0, len(few)]), len(few))[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def _sets_of(k: int, bits: int):
    """A block's distinct shingles by bucket (a: places, b: hashes, c: documents beyond the first that hold them), and a
    row, with a bucket beyond the others, about its documents (d, e: places of shingles that occur again in it)."""

    def run(batches):
        count = 0
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            ids = batch.column("doc_id")
            valid, ids, keys = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.asarray(batch.column("key"))
            for lo, hi, part, at in W.blocks(data, where, X.block_bytes(bits)):
                flat, begin = shingles(part, at, k)
                block = X.block_number(count)
                count += 1
                raw = flat.tobytes()
                nodes = b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(begin[:-1], begin[1:], strict=True))
                first, times, again, lead = X.merged(flat)
                about = X.pack(np.where(valid[lo:hi], ids[lo:hi], -1)), X.pack(begin, True), nodes + valid[lo:hi].tobytes() + X.pack(keys[lo:hi])
                rows = [{"bucket": X.about_bucket(block, bits), "block": block, "a": about[0], "b": about[1], "c": about[2], "d": X.pack(again, True), "e": X.pack(again - lead)}]
                for n, some in X.by_bucket(flat[first], bits):
                    rows.append({"bucket": n, "block": block, "a": X.pack(first[some], True), "b": X.pack_hashes(flat[first[some]]), "c": X.pack(times[some] - 1), "d": None, "e": None})
                yield X.rows_of(X.MOVED, rows)

    return run


def _frequent(bits: int):
    """For each bucket and block: the shingles that two documents or more hold, and how many hold them."""

    def run(batches):
        for bucket, rows in X.grouped(batches, "bucket"):
            if bucket >= 1 << bits:
                yield X.rows_of(X.MOVED, rows)
                continue
            parts = [X.unpack_hashes(r.pop("b"), bucket, bits) for r in rows]
            h, times = np.concatenate(parts), np.concatenate([X.unpack(r.pop("c")) for r in rows]) + 1
            order = np.argsort(h)
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(np.concatenate([[False], h[order][1:] != h[order][:-1]]))
            held = np.bincount(group, times).astype(np.int64)[group]
            at = 0
            for row, part in zip(rows, parts, strict=True):
                told = held[at : at + len(part)]
                at += len(part)
                more = np.flatnonzero(told > 1)
                if len(more):
                    places = X.unpack(row["a"], True)
                    yield X.rows_of(X.MOVED, [{"bucket": bucket, "block": row["block"], "a": X.pack(places[more], True), "b": X.pack_hashes(part[more]), "c": X.pack(told[more]), "d": None, "e": None}])

    return run


def _prefixes(num: int, den: int, bits: int):
    """For each block, a row a document; prefix and shared are null where no other document can link."""

    def run(batches):
        for _, rows in X.grouped(batches, "block"):
            about = rows[-1]
            begin = X.unpack(about["b"], True)
            size = np.diff(begin)
            docs = len(size)
            nodes, valid, keys = about["c"][: 16 * docs], np.frombuffer(about["c"][16 * docs : 17 * docs], bool), X.unpack(about["c"][17 * docs :])
            # the hash of each shingle that others hold, and by how many it is held, at its place
            h, held = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.int64)
            for r in rows[:-1]:
                place = X.unpack(r["a"], True)
                h[place], held[place] = X.unpack_hashes(r["b"], r["bucket"], bits).view(np.int64), X.unpack(r["c"])
            again = X.unpack(about["d"], True)
            lead = again - X.unpack(about["e"])
            h[again], held[again] = h[lead], held[lead]
            place = np.flatnonzero(held)
            doc = np.searchsorted(begin, place, "right") - 1
            order = np.lexsort((h[place], held[place], doc))
            h, bounds = h[place[order]], np.searchsorted(doc[order], np.arange(docs + 1))
            unique = size - np.diff(bounds)
            # linked sets have at least num/den of the size in common, so one of so many first ones
            prefix = size - (num * size + den - 1) // den + 1
            some = np.where(size > 0, np.maximum(prefix - unique, 0), 0)
            lists = [[], []]
            for n in range(docs):
                own = h[bounds[n] : bounds[n + 1]]
                lists[0].append(own[: some[n]] if some[n] else None)
                lists[1].append(own if some[n] else None)
            ids = X.unpack(about["a"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(keys), pa.array(size), pa.array([nodes[16 * n : 16 * n + 16] for n in range(docs)], pa.binary()), pa.array(unique), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], schema=_NODES)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): the least node that links reach.

    Large-star and small-star steps alternate until only stars are left.  The least neighbour is found by an
    aggregate and joined back, so that a node with very many neighbours is not one task's work.
    """
    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table, so that both sides of the join are plain shuffles, of which a node with very many rows can be split
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, edges = edges, table(small.select("e.*").where("u != v").distinct(), "edges")
        drop(before, least)
        # done when all are stars: each node has one edge to a lesser one, or edges from greater ones alone
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets are similar enough."""
    have = nodes.select("node", "n", "shared")
    x = have.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("of_a"))
    y = have.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(x, "a").join(y, "b").where((num + den) * common >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _labelled(member: DataFrame, found: DataFrame) -> DataFrame:
    """Each node with its component, itself where it has none yet."""
    return member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _spokes(posted: DataFrame, groups: DataFrame, member: DataFrame, found: DataFrame, num: int, den: int, own_head: bool) -> DataFrame:
    """One pair for each node: with the head of the most central group, in another component, that it shares a
    shingle with; at first also with the head of its own group."""
    head = _labelled(groups.select("group", F.col("head").alias("node")), found)
    rank = F.struct((F.col("unique") / F.col("n")).alias("r"), "n", "group", "component", "node")
    listed = posted.select("token", "group", "n", "unique").join(head, "group")
    best = listed.groupBy("token").agg(F.min(rank).alias("c"))
    second = listed.join(best.select("token", F.col("c.component").alias("taken")), "token").where("component != taken").groupBy("token").agg(F.min(rank).alias("c2"))
    centres = best.join(second, "token")
    labelled = _labelled(member, found)
    parts = labelled.select("group", "component").distinct()
    chosen = F.when(F.col("component") != F.col("c.component"), F.col("c")).otherwise(F.col("c2"))
    asked = posted.select("token", "group", "n").join(parts, "group").join(centres, "token").withColumn("x", chosen).where(f"{den} * least(n, x.n) >= {num} * greatest(n, x.n)")
    star = asked.groupBy("group", "component").agg(F.min("x").alias("x")).select("group", "component", F.col("x.node").alias("b"))
    pairs = labelled.join(star, ["group", "component"]).select(F.col("node").alias("a"), "b")
    if own_head:
        pairs = pairs.unionByName(member.join(groups.where("members > 1").select("group", F.col("head").alias("b")), "group").select(F.col("node").alias("a"), "b"))
    return pairs.where("a != b").distinct()


def _open_pairs(posted: DataFrame, labelled: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose groups share a prefix shingle, or that are of one group."""
    ends = labelled.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = posted.select("token", "group", "n", "pos").join(ends, "group")
    spread = rows.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("k")).where("l != h and k > 1").select("token")
    rows = table(rows.join(spread, "token", "left_semi"), "open")
    x, y = rows.alias("x"), rows.alias("y")
    # of a pair's common shingles the first has nothing common before it, so what follows bounds the overlap
    near = F.expr(f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and {num + den} * least(x.n - x.pos, y.n - y.pos) >= {num} * (x.n + y.n)")
    apart = F.expr("x.group < y.group and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
    groups = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & near).select(F.col("x.group").alias("g"), F.col("y.group").alias("h")).distinct()
    same = ends.where("lo != hi").select(F.col("group").alias("g"), F.col("group").alias("h"))
    of = lambda side, group: labelled.select(F.col("group").alias(group), F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    pairs = groups.unionByName(same).join(of("a", "g"), "g").join(of("b", "h"), "h").where("of_a != of_b and (g != h or a < b)")
    return pairs.select("a", "b")


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """Per row of ``documents``: doc_id, key (hash of the text), n_shingles, component_id, the smallest id
    that links reach, and component, its node hash (null where nothing can link)."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _key().alias("key"))
    bits = X.bits_for(docs)
    moved = docs.mapInArrow(_sets_of(k, bits), X.MOVED_DDL)
    told = X.to_buckets(moved, bits).mapInArrow(_frequent(bits), X.MOVED_DDL)
    per_doc = table(X.to_blocks(told).mapInArrow(_prefixes(num, den, bits), _NODES_DDL), "sets")

    alone = per_doc.where("prefix is null")
    some = per_doc.where("prefix is not null")
    nodes = table(some.dropDuplicates(["node"]).select("node", "n", "unique", "prefix", "shared", F.concat_ws("-", F.xxhash64("n", "unique", "prefix"), F.hash("n", "unique", "prefix")).alias("group")), "nodes")

    lone = alone.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    if nodes.isEmpty():
        return lone
    # groups: nodes of one size with one prefix
    groups = nodes.groupBy("group").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    heads = nodes.join(groups.select(F.col("head").alias("node")), "node", "left_semi")
    posted = heads.select("group", "n", "unique", F.posexplode("prefix").alias("pos", "token"))
    # a shingle in one group's prefix alone pairs it with no other
    often = posted.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    posted = posted.select("group", "n", "unique", "token", (F.col("pos") + F.col("unique")).alias("pos"))
    posted = table(posted.join(often, "token", "left_semi"), "posted")

    member = nodes.select("node", "group")
    found, links = member.select("node", F.col("node").alias("component")).limit(0), None
    for _ in range(STAR_ROUNDS):
        pairs = _spokes(posted, groups, member, found, num, den, own_head=links is None)
        new = table(_verified(pairs, nodes, num, den), "links")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        found = table(components(links), "components")

    # then whatever lies in different components still
    labelled = table(_labelled(member, found), "labelled")
    last = table(_verified(_open_pairs(posted, labelled, num, den), nodes, num, den), "links")
    if not last.isEmpty():
        found = table(components(last if links is None else links.unionByName(last)), "components")

    # the least id of each component, from the least of each node; a component of very many nodes is joined by broadcast
    placed = _labelled(some.groupBy("node").agg(F.min("doc_id").alias("least")), found)
    least = table(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "least")
    known = join_hot(placed.select("node", "component"), least, ["component"], "nodes", nodes.count())
    linked = some.select("doc_id", "key", "n", "node").join(known, "node").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "component")
    return lone.unionByName(linked)


def deduplicated(documents: DataFrame, k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """``documents`` with one row of each component, that of the smallest id (and text hash) in it; rows without
    an id or without words are kept."""
    found = table(near_duplicates(documents, k, num, den), "found")
    linked = found.where("doc_id is not null and component is not null")
    keep = linked.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("k")).select("k.*")
    marked, names = beside(documents, id=F.col("doc_id").cast("bigint"), key=_key())
    on = [names["id"], names["key"]]
    named = lambda df: df.select(F.col("doc_id").alias(on[0]), F.col("key").alias(on[1]))
    gone = named(linked).distinct().join(named(keep), on, "left_anti")
    left = marked.join(gone, on, "left_anti")
    # rows that are equal in id and text: the first of them
    twice = named(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "key").count().where("count > 1"))
    if not twice.isEmpty():
        left = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates(on))
    return left.select(*own(documents))
