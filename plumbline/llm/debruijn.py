"""Removal of long spans that occur again: de Bruijn compaction of token k-mers.

Every run of ``k`` consecutive words is an edge of the de Bruijn graph, and an edge leads to the next where it is followed
by it in a document.  The steps:

1. ``exchange``: each edge goes, as a hash, to its bucket, where the repeated edges and their first place
   (smallest document id, then smallest start), their source, are found; all their occurrences are told it.
2. In each document neighbouring repeated edges whose sources are neighbours too form a run (start, edges, source
   document, source start).  An edge that the document itself has before takes that place as its source, so that words
   which repeat at once, as in lists of one word, form one run.  Where two sources follow one another in a document but
   are no neighbours, the graph has an arc between them.
3. Sources that lie side by side are the graph's other arcs, so that a row a run, not a row an edge, holds it.  In and out
   degrees follow from both kinds; runs of sources are cut into pieces where an arc leaves or enters within, and pieces
   with one arc out and one in between them are compacted to paths by pointer doubling, in Spark joins.
4. Documents' runs are told the pieces and paths that they lie on; neighbouring parts of one path become one span.
5. A Spark join on the source coordinates compares the words of each part with those at its source.  Where they differ, by
   a collision of edge hashes, all windows with such a hash are assigned to their true sources by their own words.
6. The words that spans cover go.

The exchange moves about 10 bytes a word, whatever the repetition; a passage that a third of all documents
share adds one row a document.  Texts are read again, and shuffled, only of documents that lose words or are sources.

Defined results: null text has no words; texts under ``k`` words have no edges; null ids sort last, by a hash of their
text; rows equal in id and text are one document, so that equal places in them are not "earlier".  An empty table gives
an empty result.  Further columns, of any name, stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import wordblocks as W
from .frames import FEW, beside, few, fresh, join_hot, own
from .scratch import drop, prepare, table

#: Parts of spans end at places of the source that this divides; so the number of different parts that documents can ask
#: a source for is in proportion to its length, however they cite it.
STRETCH = 64
#: Ids that stand for null ones begin here.
NO_ID = 1 << 62

_LISTS = ["start", "edges", "source", "source_start", "from_doc", "from_end", "to_doc", "to_at"]
_RUNS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), *((c, pa.list_(pa.int64())) for c in _LISTS)])
_RUNS_DDL = "id bigint, key bigint, n_words bigint, sha string, " + ", ".join(f"{c} array<bigint>" for c in _LISTS)


def _edges_of(k: int, bits: int, mask: int):
    """A block's distinct edges by bucket (a: which document of the block, b: its id, c: start, d: hash, e: how often the edge
    occurs again), and a row, with a bucket beyond the others, about its documents and edges that occur again in it."""

    def run(batches):
        count = 0
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            data, where = W.utf8(batch.column("text"))
            ids, keys = (np.asarray(batch.column(c)) for c in ("id", "key"))
            for lo, hi, part, at in W.blocks(data, where, X.block_bytes(bits)):
                starts, ends, first = W.words(part, at)
                grams, begin = W.gram_hashes(W.span_hashes(part, starts, ends), first, k)
                grams &= np.uint64(mask)
                block = X.block_number(count)
                count += 1
                sha = b"".join(hashlib.sha256(t).digest() for t in W.rejoined(part, starts, ends, first, np.ones(len(starts), bool)))
                lead, times, again, of = X.merged(grams)
                about = b"".join(len(x).to_bytes(4, "little") + x for x in (X.pack(ids[lo:hi], True), X.pack(keys[lo:hi]), X.pack(begin, True), X.pack(first, True)))
                rows = [{"bucket": X.about_bucket(block, bits), "block": block, "a": about, "b": X.pack(again, True), "c": X.pack(again - of), "d": sha, "e": None}]
                doc = np.searchsorted(begin, lead, "right") - 1
                place, doc_id = lead - begin[doc], ids[lo:hi][doc]
                for n, some in X.by_bucket(grams[lead], bits):
                    rows.append({"bucket": n, "block": block, "a": X.pack(doc[some], True), "b": X.pack(doc_id[some], True), "c": X.pack(place[some]), "d": X.pack_hashes(grams[lead[some]]), "e": X.pack(times[some] - 1)})
                yield X.rows_of(X.MOVED, rows)

    return run


def _sources(bits: int):
    """For each bucket: the source of every edge that occurs twice or more, to all blocks that have it."""

    def run(batches):
        for bucket, rows in X.grouped(batches, "bucket"):
            if bucket >= 1 << bits:
                yield X.rows_of(X.MOVED, rows)
                continue
            parts = [X.unpack_hashes(r.pop("d"), bucket, bits) for r in rows]
            h = np.concatenate(parts)
            doc, place, times = (np.concatenate([X.unpack(r.pop(c), c == "b") for r in rows]) for c in "bce")
            order = np.lexsort((place, doc, h))
            head = np.concatenate([np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]])
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(head) - 1
            source = order[head]
            repeated = np.bincount(group, times + 1)[group] > 1
            at = 0
            for row, part in zip(rows, parts, strict=True):
                some = np.flatnonzero(repeated[at : at + len(part)])
                if len(some):
                    mine, of = at + some, source[group[at + some]]
                    yield X.rows_of(X.MOVED, [{"bucket": bucket, "block": row["block"], "a": X.pack(X.unpack(row["a"], True)[some], True), "b": X.pack(place[mine]), "c": X.pack(doc[of]), "d": X.pack(place[of] - place[mine]), "e": None}])
                at += len(part)

    return run


def _runs(batches):
    """For each block: its documents with their runs of repeated edges."""
    for _, rows in X.grouped(batches, "block"):
        about, raw, held = rows[-1], rows[-1]["a"], []
        while raw:
            size = int.from_bytes(raw[:4], "little")
            held.append(raw[4 : 4 + size])
            raw = raw[4 + size :]
        ids, keys, begin, first = (X.unpack(x, n != 1) for n, x in enumerate(held))
        # the source of each edge that was told, at its place
        source, off, told = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.int64), np.zeros(begin[-1], bool)
        for r in rows[:-1]:
            place = X.unpack(r["b"])
            at = begin[X.unpack(r["a"], True)] + place
            source[at], off[at], told[at] = X.unpack(r["c"]), X.unpack(r["d"]) + place, True
        again = X.unpack(about["b"], True)
        lead = again - X.unpack(about["c"])
        source[again], off[again], told[again] = source[lead], off[lead], told[lead]
        flat = np.flatnonzero(told)
        doc = np.searchsorted(begin, flat, "right") - 1
        start, source, off = flat - begin[doc], source[flat], off[flat]
        follows = (np.diff(flat) == 1) & (np.diff(doc) == 0)
        # arcs: from behind one source to another, each once a document
        jump = np.flatnonzero(follows & ((source[1:] != source[:-1]) | (np.diff(off) != 1)))
        arcs = np.unique(np.stack([doc[jump], source[jump], off[jump] + 1, source[jump + 1], off[jump + 1]]), axis=1) if len(jump) else np.zeros((5, 0), np.int64)
        # what the document has before is its source
        order = np.lexsort((start, off, source, doc))
        again = np.flatnonzero((np.diff(doc[order]) == 0) & (np.diff(source[order]) == 0) & (np.diff(off[order]) == 0))
        later, before = order[again + 1], start[order[again]]
        source[later], off[later] = ids[doc[later]], before
        turn = np.ones(len(flat), bool)
        turn[1:] = ~(follows & (source[1:] == source[:-1]) & (np.diff(off) == 1))
        head = np.flatnonzero(turn)
        lists = [(doc[head], x) for x in (start[head], np.diff(np.append(head, len(flat))), source[head], off[head])] + [(arcs[0], x) for x in arcs[1:]]
        sha = about["d"].hex()
        columns = [pa.array(ids), pa.array(keys), pa.array(np.diff(first)), pa.array([sha[64 * n : 64 * n + 64] for n in range(len(ids))], pa.string())]
        for of, x in lists:
            bounds = np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.asarray(x, np.int64))))
        yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)


def _keyed() -> tuple[Column, Column]:
    """A row's id, of null ids one from the text's hash, and the text's hash, whose last bit tells null ids."""
    text, null = F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("bigint").isNull()
    return F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(text, 2).bitwiseOR(F.lit(NO_ID))), text.bitwiseAND(F.lit(-2)).bitwiseOR(null.cast("bigint"))


def _with_key(documents: DataFrame) -> DataFrame:
    id_, key = _keyed()
    return documents.select(id_.alias("id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))


def runs(documents: DataFrame, k: int = 20, hash_bits: int = 64) -> DataFrame:
    """Per document: id, key (hash of its text), n_words, sha (of all its words) and its runs of repeated edges, those whose
    source is the run itself too.  ``hash_bits``: fewer, in tests, make edges collide."""
    prepare(documents.sparkSession)
    docs = _with_key(documents)
    bits = X.bits_for(docs)
    moved = docs.mapInArrow(_edges_of(k, bits, (1 << 64) - (1 << 64 - hash_bits)), X.MOVED_DDL)
    told = X.to_buckets(moved, bits).mapInArrow(_sources(bits), X.MOVED_DDL)
    return table(X.to_blocks(told).mapInArrow(_runs, _RUNS_DDL), "runs")


def _heads(arcs: DataFrame) -> DataFrame:
    """From arcs (to, of, steps), at most one into and one out of each piece: piece, head (the first of its path) and
    steps from there.  Rings have no first piece; theirs are no part of the result."""
    at, left = table(arcs.select(F.col("to").alias("piece"), F.col("of").alias("up"), "steps", F.lit(False).alias("done")), "up"), None
    while True:
        # a piece whose upper one has no upper one has reached its head
        upper = at.select(F.col("piece").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        step = at.join(upper, "up", "left").select("piece", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("up2").isNull().alias("done"))
        before, at = at, table(step, "up")
        drop(before)
        last, left = left, at.where("not done").count()
        if not left or left == last:  # no fewer than before: only rings are left
            return at.where("done").select("piece", F.col("up").alias("head"), "steps")


def _each(found: DataFrame, *names: str) -> DataFrame:
    """Rows of list columns of ``runs``; rows equal in id and text are one document."""
    return found.where(F.size(names[0]) > 0).dropDuplicates(["id", "key"]).select("id", "key", F.explode(F.arrays_zip(*names)).alias("r")).select("id", "key", "r.*")


def compacted(found: DataFrame, each: DataFrame) -> DataFrame:
    """From all documents' arcs (``found``) and runs (``each``): the pieces of sources, each with the nonbranching path it
    lies on.  Columns doc, at, edges, path (the doc and place of its first piece) and shift (the edges of the path before
    it)."""
    place = lambda doc, at: F.struct(doc.alias("doc"), at.alias("at"))
    sources = each.where("id = source and start = source_start").select(F.col("id").alias("doc"), F.col("start").alias("at"), (F.col("start") + F.col("edges")).alias("stop")).distinct()
    arcs = _each(found, "from_doc", "from_end", "to_doc", "to_at")
    jumps = table(arcs.select(place(F.col("from_doc"), F.col("from_end")).alias("of"), place(F.col("to_doc"), F.col("to_at")).alias("to")).distinct(), "jumps")
    # pieces: runs of sources, cut behind the edge that an arc leaves and before the one that it enters
    cuts = jumps.select("of.*").unionByName(jumps.select("to.*")).withColumn("stop", F.lit(None).cast("bigint"))
    along = Window.partitionBy("doc").orderBy("at")
    marks = sources.unionByName(cuts).groupBy("doc", "at").agg(F.max("stop").alias("stop"))
    marks = marks.withColumn("stop", F.last("stop", ignorenulls=True).over(along)).withColumn("end", F.least("stop", F.lead("at").over(along)))
    pieces = table(marks.where("at < stop").select("doc", "at", (F.col("end") - F.col("at")).alias("edges"), (F.col("end") < F.col("stop")).alias("goes_on")), "pieces")
    # all arcs between pieces: those that jump, and from one piece to the next of its run
    straight = pieces.where("goes_on").select(place(F.col("doc"), F.col("at") + F.col("edges")).alias("of"), place(F.col("doc"), F.col("at") + F.col("edges")).alias("to"))
    ends = pieces.select(place(F.col("doc"), F.col("at") + F.col("edges")).alias("of"), place(F.col("doc"), F.col("at")).alias("piece"), "edges")
    arcs = jumps.unionByName(straight)
    out = arcs.groupBy("of").agg(F.count("*").alias("out"), F.min("to").alias("to")).where("out = 1").select("of", "to")
    into = arcs.groupBy("to").agg(F.count("*").alias("into")).where("into = 1").select("to")
    single = out.join(into, "to", "left_semi").join(ends, "of").where("piece != to")
    heads = _heads(single.select("to", F.col("piece").alias("of"), F.col("edges").alias("steps")))
    told = pieces.select("doc", "at", "edges", place(F.col("doc"), F.col("at")).alias("piece")).join(heads, "piece", "left")
    return told.select("doc", "at", "edges", F.coalesce("head", "piece").alias("path"), F.coalesce("steps", F.lit(0)).cast("bigint").alias("shift"))


def spans(found: DataFrame) -> DataFrame:
    """The parts of documents' paths that have an earlier source: id, key, start, edges, source, source_start, and the path,
    shift in it and number (``span``) of the maximal repeated span that a part belongs to."""
    each = table(_each(found, "start", "edges", "source", "source_start"), "each")
    pieces = table(compacted(found, each), "paths")
    stretch = lambda at, size: F.explode(F.sequence(F.floor(at / STRETCH), F.floor((at + size - 1) / STRETCH))).alias("stretch")
    first, last = F.col("stretch") * STRETCH, (F.col("stretch") + 1) * STRETCH
    # distinct before the join: a passage that very many documents share is one row
    asked, on = each.where("id != source"), ["source", "source_start", "edges"]
    p = pieces.select(F.col("doc").alias("source"), "at", F.col("edges").alias("size"), "path", "shift", stretch(F.col("at"), F.col("edges")))
    told = asked.groupBy(*on).agg(F.count("*").alias("times")).select("*", stretch(F.col("source_start"), F.col("edges"))).join(p, ["source", "stretch"])
    lo, hi = F.greatest("source_start", "at", first), F.least(F.col("source_start") + F.col("edges"), F.col("at") + F.col("size"), last)
    parts = told.where(lo < hi).select(*on, "times", (lo - F.col("source_start")).alias("skip"), (hi - lo).alias("part"), "path", (F.col("shift") + lo - F.col("at")).alias("shift"))
    told = join_hot(asked, parts, on, "times", each.count())
    # what a document has from itself lies on a path of its own
    lo, hi = F.greatest("source_start", first), F.least(F.col("source_start") + F.col("edges"), last)
    same = each.where("id = source and start != source_start").select("*", stretch(F.col("source_start"), F.col("edges")))
    same = same.select("id", "key", "start", "edges", "source", "source_start", (lo - F.col("source_start")).alias("skip"), (hi - lo).alias("part"), F.struct(F.col("source").alias("doc"), F.col("source_start").alias("at")).alias("path"), (lo - F.col("source_start")).alias("shift"))
    told = told.select(*same.columns).unionByName(same)
    own_parts = told.select("id", "key", (F.col("start") + F.col("skip")).alias("start"), F.col("part").alias("edges"), "source", (F.col("source_start") + F.col("skip")).alias("source_start"), "path", "shift")
    # parts that follow one another in the document and on their path are one span
    along = Window.partitionBy("id", "key").orderBy("start")
    before = F.lag(F.struct((F.col("start") + F.col("edges")).alias("start"), "path", (F.col("shift") + F.col("edges")).alias("shift"))).over(along)
    opens = F.coalesce(before != F.struct("start", "path", "shift"), F.lit(True))
    return own_parts.withColumn("opens", opens).withColumn("span", F.sum(F.col("opens").cast("int")).over(along)).drop("opens")


_CUT = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("source", pa.int64()), ("source_start", pa.int64()), ("start", pa.int64()), ("edges", pa.int64()), ("words", pa.binary())])
_CUT_DDL = "kind int, id bigint, key bigint, n_words bigint, n_removed bigint, kept string, source bigint, source_start bigint, start bigint, edges bigint, words binary"
#: Kinds of rows: a document without its spans, a part's words, a source's words.
KEPT, CLAIM, TRUTH = 0, 1, 2


def _digests(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Digests of runs of words, each word with a space after it."""
    at = W.gathered(begin, size)
    width = (ends - starts)[at] + 1
    source = W.gathered(starts[at], width)
    source[np.cumsum(width) - 1] = 0
    out = part[source] if len(source) else np.zeros(0, np.uint8)
    out[np.cumsum(width) - 1] = 0x20
    raw, bounds = out.tobytes(), np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])].tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _cut(k: int):
    """Each document's own words without its spans; digests of its parts' words and of those that others name as their
    source."""

    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            for lo, hi, part, at in W.blocks(data, where):
                rows = batch.slice(lo, hi - lo)
                starts, ends, first = W.words(part, at)
                ids, keys = np.asarray(rows.column("id")), np.asarray(rows.column("key"))
                mine = _listed(rows, "start", "edges", "source", "source_start")
                doc, begin, span = mine["owner"], first[mine["owner"]] + mine["start"], mine["edges"] + k - 1
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + span, -1)
                keep = np.cumsum(cover)[:-1] == 0
                gone = np.diff(np.concatenate([[0], np.cumsum(~keep)])[first])
                has = np.flatnonzero(gone)
                kept = W.rejoined(part, starts, ends, first, keep)
                none = pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), KEPT, np.int32)), pa.array(ids[has]), pa.array(keys[has]), pa.array(np.diff(first)[has]), pa.array(gone[has]), pa.array([kept[n].decode("utf-8", "replace") for n in has], pa.string()), none, none, none, none, pa.nulls(len(has), pa.binary())], schema=_CUT)
                asked = _listed(rows, "asked_start", "asked_edges")
                of = asked["owner"]
                for kind, owners, source, source_start, start, edges in ((CLAIM, doc, mine["source"], mine["source_start"], mine["start"], mine["edges"]), (TRUTH, of, ids[of], asked["asked_start"], asked["asked_start"], asked["asked_edges"])):
                    fits = start + edges + k - 1 <= np.diff(first)[owners]
                    n = int(fits.sum())
                    if n:
                        words = _digests(part, starts, ends, (first[owners] + start)[fits], (edges + k - 1)[fits])
                        none = pa.nulls(n, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(ids[owners[fits]]), pa.array(keys[owners[fits]]), none, none, pa.nulls(n, pa.string()), pa.array(source[fits]), pa.array(source_start[fits]), pa.array(start[fits]), pa.array(edges[fits]), pa.array(words, pa.binary())], schema=_CUT)

    return run


def _listed(rows: pa.RecordBatch, *names: str) -> dict[str, np.ndarray]:
    """List columns laid flat, and the row that each item belongs to."""
    out = {c: np.asarray(rows.column(c).flatten()) for c in names}
    return out | {"owner": W.owner(np.concatenate([[0], np.cumsum(np.asarray(rows.column(names[0]).value_lengths().fill_null(0)))]))}


def _cut_texts(texts: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """``_cut`` of the documents that have ``parts`` or are the source of some."""
    mine = parts.groupBy("id").agg(F.collect_list(F.struct("key", "start", "edges", "source", "source_start")).alias("own"))
    # no more rows than a document has words, twice: equal ones were made one, and longer ones are cut at pieces
    each = parts.select(F.col("source").alias("id"), "source_start", "edges").distinct()
    asked = each.groupBy("id").agg(F.collect_list("source_start").alias("asked_start"), F.collect_list("edges").alias("asked_edges"))
    need = mine.select("id").unionByName(each.select("id")).distinct()
    if few(need):  # a list of ids keeps the other texts out of the shuffle
        texts = texts.join(F.broadcast(need), "id", "left_semi")
    told = texts.join(mine.join(asked, "id", "full"), "id").withColumn("mine", F.filter("own", lambda x: x["key"] == F.col("key")))
    empty = F.array().cast("array<bigint>")
    lists = [F.coalesce(f"mine.{c}", empty).alias(c) for c in ("start", "edges", "source", "source_start")] + [F.coalesce(c, empty).alias(c) for c in ("asked_start", "asked_edges")]
    return told.select("id", "key", "text", *lists).mapInArrow(_cut(k), _CUT_DDL)


def _false(done: DataFrame) -> DataFrame:
    """Parts (id, key, start) whose words are not those at their source."""
    on = ["source", "source_start", "edges", "words"]
    # distinct before the join: a passage that very many documents share is one row on either side
    said, true = (done.where(f"kind = {kind}").select(*on).distinct() for kind in (CLAIM, TRUTH))
    false = said.join(true, on, "left_anti")
    return done.where(f"kind = {CLAIM}").join(false, on).select("id", "key", "start").distinct()


def _hashes(k: int, mask: int):
    """The hashes of the windows of documents' parts."""

    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            for lo, hi, part, at in W.blocks(data, where):
                starts, ends, first = W.words(part, at)
                grams, begin = W.gram_hashes(W.span_hashes(part, starts, ends), first, k)
                mine = _listed(batch.slice(lo, hi - lo), "start", "edges")
                own = grams[W.gathered(begin[mine["owner"]] + mine["start"], mine["edges"])] & np.uint64(mask)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(own).view(np.int64))], names=["hash"])

    return run


def _windows(k: int, mask: int, wanted: np.ndarray):
    """All windows whose hash is ``wanted`` (rising), with a digest of their words."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            for lo, hi, part, at in W.blocks(data, where):
                rows = batch.slice(lo, hi - lo)
                starts, ends, first = W.words(part, at)
                grams, begin = W.gram_hashes(W.span_hashes(part, starts, ends), first, k)
                hit = np.flatnonzero(np.isin(grams & np.uint64(mask), wanted))
                doc = np.searchsorted(begin, hit, "right") - 1
                start = hit - begin[doc]
                words = _digests(part, starts, ends, first[doc] + start, np.full(len(hit), k))
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(doc)), rows.column("key").take(pa.array(doc)), pa.array(start), pa.array(words, pa.binary())], schema=schema)

    return run


def _reassigned(texts: DataFrame, parts: DataFrame, wrong: DataFrame, k: int, hash_bits: int) -> DataFrame:
    """``parts`` without those in ``wrong``; in their place parts of one edge each, for every window that has the hash of a
    window of theirs, with the first one of the same words as its source.  The texts are read once more for each ``FEW``
    such hashes."""
    mask, names = (1 << 64) - (1 << 64 - hash_bits), ["id", "key", "start", "edges", "source", "source_start"]
    out = parts.join(wrong, ["id", "key", "start"], "left_anti").select(*names)
    lists = parts.join(wrong, ["id", "key", "start"]).groupBy("id", "key").agg(F.collect_list("start").alias("start"), F.collect_list("edges").alias("edges"))
    found = texts.join(lists, ["id", "key"]).select("text", "start", "edges").mapInArrow(_hashes(k, mask), "hash bigint")
    hashes = table(found.distinct(), "hashes")
    shares = -(-hashes.count() // FEW)
    for n in range(shares):
        share = hashes.where(F.pmod("hash", F.lit(shares)) == n).toArrow().column("hash").to_numpy()
        wanted = np.sort(share.view(np.uint64))
        seen = table(texts.mapInArrow(_windows(k, mask, wanted), "id bigint, key bigint, start bigint, words binary"), "windows")
        first = seen.groupBy("words").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("times")).select("words", F.col("first.id").alias("source"), F.col("first.start").alias("source_start"), "times")
        again = join_hot(seen, table(first, "first"), ["words"], "times", seen.count()).where("id != source or start != source_start")
        out = out.unionByName(again.select("id", "key", "start", F.lit(1).cast("bigint").alias("edges"), "source", "source_start").distinct())
    return out


def remove_repeats(documents: DataFrame, k: int = 20, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Remove every word that a ``k``-word edge with an earlier source covers.

    Two tables: all documents' ``runs``; and of the documents that lose words id, key, n_words, n_removed
    and kept (the words left, joined by one space).  Both have a row for each row of ``documents``.
    """
    found, texts = runs(documents, k, hash_bits), _with_key(documents)
    if found.where(F.size("start") > 0).isEmpty():
        return found, texts.sparkSession.createDataFrame([], _CUT_DDL).select("id", "key", "n_words", "n_removed", "kept")
    parts = table(spans(found), "parts")
    done = table(_cut_texts(texts, parts, k), "cut")
    wrong = table(_false(done), "wrong")
    if not wrong.isEmpty():
        parts = table(_reassigned(texts, parts, wrong, k, hash_bits), "parts")
        done = table(_cut_texts(texts, parts, k), "cut")
    return found, done.where(f"kind = {KEPT}").select("id", "key", "n_words", "n_removed", "kept")


def without_repeats(documents: DataFrame, k: int = 20, hash_bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    found, changed = remove_repeats(documents, k, hash_bits)
    lost = changed.select("id", "key", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
    same = found.join(changed.select("id", "key").distinct(), ["id", "key"], "left_anti").select("id", "key", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return same.unionByName(lost).select(F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cleaned(documents: DataFrame, k: int = 20) -> DataFrame:
    """``documents`` with repeated spans removed from text and n_chars (where there is one) set to its length.

    A text that loses words is what it keeps, joined by one space; the others stay as they are.  Documents
    that lose all their words go.
    """
    _, changed = remove_repeats(documents, k)
    id_, key = _keyed()
    keyed, names = beside(documents, id=id_, key=key)
    lost = changed.dropDuplicates(["id", "key"]).select(F.col("id").alias(names["id"]), F.col("key").alias(names["key"]), F.col("kept").alias(left := fresh(keyed, "__kept")))
    out = keyed.join(lost, [names["id"], names["key"]], "left")
    out = out.where(F.col(left).isNull() | (F.col(left) != "")).withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*own(documents))
