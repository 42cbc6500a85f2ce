"""Toxicity by a convolutional text classifier.

A word (a run of ASCII letters and non-ASCII characters, lower-cased) is the sum of three rows of one hashed
embedding table: of itself and of its first four and five bytes, so that unseen forms of a known stem are
near it.  Filters of widths 1, 2 and 3 slide over the words; each filter's maximum over the whole text
feeds a logistic output.  Trained on all labelled documents: texts and labels are dealt once, by id, to shards of some
``SHARD``; in each epoch every shard runs Adam in numpy over its documents from the common model, and the changes are averaged over
shards, those of an embedding row over the shards that moved it.  What the model starts from (log odds of rows by class) and
the word frequencies of languages are counts over all labelled documents too.

Calibration: on labelled documents left out of the fit, one in ``spare``, each language gets the threshold that agrees best with
the labels, from counts of all their logits in steps of 1/``STEPS``; logits are shifted so that every threshold falls on the
score ``decide``.  The language used is guessed from the text alone, by word frequencies of the labelled documents.

Scoring reads each text whole, once, in blocks of bounded size; nothing is shuffled.

Defined results: null texts and texts without words are scored as an empty sequence; without labels of both
classes every score is the share of toxic labels, 0 if there are none; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordblocks as W
from .frames import FEW
from .scratch import drop, prepare, table

ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
PREFIXES = (4, 5)
BLOCK = 1 << 20
#: Labelled documents of a shard; documents and words of a step at most; steps of a logit, which counts up to ``FAR`` either way.
SHARD, STEP, STEP_WORDS, STEPS, FAR = 2000, 64, 1 << 18, 1024, 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_rows(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three embedding rows (from 1 on) of each word, and each text's first word."""
    data = W.LOWER[data]
    starts, ends, first = W.runs(_LETTER[data], where)
    rows = [W.span_hashes(data, starts, ends)]
    rows += [W.span_hashes(data, starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in PREFIXES]
    return np.stack([(r % np.uint64(ROWS - 1)).astype(np.int32) + 1 for r in rows], axis=1), first


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with empty ones (row 0) after each text, so that no window reaches into the next; where each text
    begins, and how many windows it has (one at least)."""
    pad, count = max(WIDTHS), np.diff(first)
    begin = first[:-1] + pad * np.arange(len(count))
    out = np.zeros((len(rows) + pad * len(count), rows.shape[1]), np.int32)
    out[np.arange(len(rows)) + pad * W.owner(first)] = rows
    return out, begin, np.maximum(count, 1)


@dataclass
class Cnn:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    guess: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, 1), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Of each filter at each position."""
        return self.convolved(self.embedded(rows), len(rows))

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Words as vectors, and empty ones behind them."""
        x = np.zeros((len(rows) + max(WIDTHS), DIM), self.table.dtype)
        for k in range(rows.shape[1]):
            x[: len(rows)] += np.take(self.table, rows[:, k], axis=0)
        return x

    def convolved(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([sum(x[o : o + n] @ f[o * DIM : (o + 1) * DIM] for o in range(w)) for w, f in zip(WIDTHS, self.filters, strict=True)], axis=1)

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        flat, begin, count = padded(rows, first)
        ends = np.stack([begin, begin + count], axis=1).ravel()
        top = np.maximum.reduceat(self.responses(flat), ends, axis=0)[::2]
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def languages(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, self.guess.shape[1])), np.cumsum(self.guess[rows[:, 0]], axis=0, dtype=np.float64)])
        return np.diff(total[first], axis=0).argmax(1)

    def scores(self, data: np.ndarray, where: np.ndarray) -> np.ndarray:
        rows, first = word_rows(data, where)
        z = self.logits(rows, first) + self.shift[self.languages(rows, first)]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def initial(held: np.ndarray, n: np.ndarray, seed: int = 1) -> Cnn:
    """A model to start from; ``held`` counts the texts of each class (of ``n``) that hold each row."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
    # one coordinate starts as the smoothed log odds of texts that hold the row
    table[:, 0] = 0.3 * np.log((held[1] + 0.5) / (n[1] + 1) / ((held[0] + 0.5) / (n[0] + 1)))
    table[0] = 0
    filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, : FILTERS // 2] += 1
    total = FILTERS * len(WIDTHS)
    return Cnn(table, filters, np.zeros(total, np.float32), rng.normal(0.2, 0.1, total).astype(np.float32), -1.0)


class Adam:
    """Steps on the log loss that change a model in place."""

    def __init__(self, model: Cnn, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.params = [model.table, *model.filters, model.bias, model.out]
        self.m1, self.m2 = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.b1 = self.b2 = 0.0

    def take(self, rows: list[np.ndarray], toxic: np.ndarray) -> None:
        grads, g = gradients(self.model, rows, toxic)
        self.step += 1
        n, rate = self.step, self.rate
        for p, d, a, b in zip(self.params, grads, self.m1, self.m2, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            p -= rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)
        self.b1, self.b2 = self.b1 + 0.1 * (g - self.b1), self.b2 + 0.001 * (g * g - self.b2)
        self.model.out_bias -= rate * (self.b1 / (1 - 0.9**n)) / (np.sqrt(self.b2 / (1 - 0.999**n)) + 1e-8)


def fit(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 8, batch: int = STEP, rate: float = 0.01, seed: int = 1) -> Cnn:
    """Adam on the log loss of texts in one place; the gradient runs through each filter's maximum alone."""
    rng = np.random.default_rng(seed)
    held = np.zeros((2, ROWS))
    for r, y in zip(rows, toxic, strict=True):
        held[int(y), np.unique(r)] += 1
    adam = Adam(initial(held, np.bincount(toxic.astype(int), minlength=2), seed), rate)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            adam.take([rows[i] for i in some], toxic[some])
    return adam.model


def gradients(model: Cnn, rows: list[np.ndarray], toxic: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the mean log loss of these texts, by table, filters, bias, out, and by out_bias."""
    params = [model.table, *model.filters, model.bias, model.out]
    total = len(model.bias)
    flat, begin, count = padded(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    x = model.embedded(flat)
    response = model.convolved(x, len(flat))
    at = np.stack([begin[k] + response[begin[k] : begin[k] + count[k]].argmax(0) for k in range(len(rows))])
    top = response[at, np.arange(total)] + model.bias
    active = np.maximum(top, 0)
    error = (1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30))) - toxic) / len(rows)
    d_top = error[:, None] * model.out * (top > 0)
    grads = [np.zeros_like(p) for p in params]
    flat = np.concatenate([flat, np.zeros((max(WIDTHS), flat.shape[1]), np.int32)])
    for k, w in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        for o in range(w):
            where, g = at[:, part] + o, d_top[:, part]
            grads[1 + k][o * DIM : (o + 1) * DIM] += np.einsum("dfe,df->ef", x[where], g)
            push = (g[:, :, None] * model.filters[k][o * DIM : (o + 1) * DIM].T[None]).reshape(-1, DIM)
            for j in range(flat.shape[1]):
                np.add.at(grads[0], flat[where, j].ravel(), push)
    grads[0][0] = 0
    grads[-2][:] = d_top.sum(0)
    grads[-1][:] = active.T @ error
    return grads, float(error.sum())


def threshold(logits: np.ndarray, toxic: np.ndarray, slack: float = 0.02, of: np.ndarray | None = None) -> float:
    """A cut between two neighbouring logits: of those with an F1 within ``slack`` of the best, the one nearest 0,
    where the fit itself would cut; 0 where a class is missing.  With ``of``, a logit stands for so many texts, ``toxic`` of which are."""
    of = np.ones(len(logits)) if of is None else of
    if not toxic.any() or toxic.sum() == of.sum():
        return 0.0
    order = np.argsort(-logits)
    ranked, hits = logits[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(of[order]) + toxic.sum())
    low = np.append(ranked[1:], ranked[-1] - 1)
    good = np.flatnonzero(f1 >= f1.max() - slack)
    # within a gap any cut is as good: 0 itself where it lies in one
    cuts = np.clip(0.0, low[good] + 0.25 * (ranked[good] - low[good]), ranked[good] - 0.25 * (ranked[good] - low[good]))
    return float(cuts[np.abs(cuts).argmin()])


def _rows(batches):
    """Each text's embedding rows, as unsigned 16-bit numbers."""
    schema = pa.schema([("shard", pa.int32()), ("rank", pa.int64()), ("toxic", pa.int32()), ("lang", pa.string()), ("spared", pa.bool_()), ("rows", pa.binary())])
    for batch in batches:
        data, where = W.utf8(batch.column("text"))
        for lo, hi, part, at in W.blocks(data, where, BLOCK):
            rows, first = word_rows(part, at)
            held = [rows[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in schema.names[:-1]), pa.array(held, pa.binary())], schema=schema)


def _held(batch) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32) for v in batch.column("rows").to_pylist()]


def _named(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(arrays), pa.string()), pa.array([a.tobytes() for a in arrays.values()], pa.binary())], names=["name", "held"])


def _add(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, held in zip(batch.column("name").to_pylist(), batch.column("held").to_pylist(), strict=True):
            total[name] = total.get(name, 0) + np.frombuffer(held, np.float32).astype(np.float64)
    for name, array in total.items():
        yield _named({name: array})


def added(texts: DataFrame, arrays) -> dict[str, np.ndarray]:
    """Arrays by name that ``arrays`` makes of each partition, added up on the executors: the driver gets one of each name."""
    parts = texts.mapInArrow(arrays, "name string, held binary").repartition("name").mapInArrow(_add, "name string, held binary").toArrow()
    return {n: np.frombuffer(h, np.float64) for n, h in zip(parts.column("name").to_pylist(), parts.column("held").to_pylist(), strict=True)}


def _counts(batches):
    """Texts of a class that hold each row (of those the model is fitted on), and each language's words."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, toxic, lang, fitted in zip(_held(batch), *(batch.column(c).to_pylist() for c in ("toxic", "lang", "fitted")), strict=True):
            if fitted:
                total.setdefault(f"class {toxic}", np.zeros(ROWS))[np.unique(rows)] += 1
            if lang is not None:
                total.setdefault(f"lang {lang}", np.zeros(ROWS))[:] += np.bincount(rows[:, 0], minlength=ROWS)
    for name, array in total.items():
        yield _named({name: array.astype(np.float32)})


def _steps(batches):
    """A partition's texts, which are in the order of shards, as (shard, rows, toxic) of one step each."""
    shard, rows, toxic, words = None, [], [], 0
    for batch in batches:
        for own, text, y in zip(batch.column("shard").to_pylist(), _held(batch), batch.column("toxic").to_pylist(), strict=True):
            if rows and (own != shard or len(rows) >= STEP or words + len(text) > STEP_WORDS):
                yield shard, rows, np.array(toxic, np.float64)
                rows, toxic, words = [], [], 0
            shard, words = own, words + len(text)
            rows.append(text)
            toxic.append(y)
    if rows:
        yield shard, rows, np.array(toxic, np.float64)


def _flat(model: Cnn) -> dict[str, np.ndarray]:
    return {"table": model.table, **{f"filter {w}": f for w, f in zip(WIDTHS, model.filters, strict=True)}, "bias": model.bias, "out": model.out, "out_bias": np.array([model.out_bias])}


def _epoch(model: Cnn, rate: float):
    """The changes that Adam makes to ``model`` in each shard, and how many shards changed a row, added up over a partition."""

    def run(batches):
        before, total, last, adam = _flat(model), {}, None, None

        def close():
            for name, array in _flat(adam.model).items():
                change = array - before[name]
                moved = (change != 0).any(1) if name == "table" else np.ones(1)
                total[name] = total.get(name, 0) + change
                total[f"shards of {name}"] = total.get(f"shards of {name}", 0) + moved.astype(np.float64)

        for shard, rows, toxic in _steps(batches):
            if shard != last:
                if adam:
                    close()
                last, adam = shard, Adam(Cnn(model.table.copy(), [f.copy() for f in model.filters], model.bias.copy(), model.out.copy(), model.out_bias), rate)
            adam.take(rows, toxic)
        if adam:
            close()
            for name, array in total.items():
                yield _named({name: np.asarray(array, np.float32)})

    return run


def _moved(model: Cnn, rate: float, texts: DataFrame) -> Cnn:
    """``model`` after an epoch."""
    sums = added(texts, _epoch(model, rate))
    new = {}
    for name, array in _flat(model).items():
        change, shards = sums[name].reshape(array.shape), np.maximum(sums[f"shards of {name}"], 1)
        new[name] = (array + change / (shards[:, None] if name == "table" else shards[0])).astype(np.float32)
    return Cnn(new["table"], [new[f"filter {w}"] for w in WIDTHS], new["bias"], new["out"], float(new["out_bias"][0]))


def _logits(model: Cnn):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _held(batch)
            first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            flat = np.concatenate(rows)
            z = np.clip(np.rint(model.logits(flat, first) * STEPS), -FAR * STEPS, FAR * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(model.languages(flat, first).astype(np.int32)), pa.array(z), batch.column("toxic")], names=["lang", "logit", "toxic"])

    return run


def train(documents: DataFrame, labels: DataFrame, decide: float = 0.7, spare: int = 5, epochs: int = 4, rate: float = 0.01) -> Cnn | float:
    """Fit and calibrate on all labelled documents (doc_id, text, lang), of which one in ``spare`` is kept for calibration.  A
    share if a class is missing."""
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    each = labels.where("doc_id is not null and toxic is not null").groupBy(ids).agg(F.max("toxic").cast("int").alias("toxic"))
    n = each.count()
    shards = max(1, -(-n // SHARD))
    marked = each.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("rank"), (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(spare)) == 0).alias("spared"))
    # partitions are the shards, so a text is shuffled once; few labels keep the other texts out of that shuffle
    texts = documents.select(ids, "text", "lang")
    met = texts.join(F.broadcast(marked), "doc_id").repartition(shards, "doc_id") if n <= FEW else texts.repartition(shards, "doc_id").join(marked.repartition(shards, "doc_id"), "doc_id")
    rows = met.select(F.spark_partition_id().alias("shard"), "rank", "toxic", "lang", "spared", "text").mapInArrow(_rows, "shard int, rank bigint, toxic int, lang string, spared boolean, rows binary")
    laid = table(rows.sortWithinPartitions("shard", "rank", "rows"), "labelled")
    # a row a class and language
    seen = laid.groupBy("spared", "toxic", "lang").count().collect()
    count = lambda toxic, *spared: sum(r["count"] for r in seen if r.toxic == toxic and r.spared in spared)
    if not (count(0, True, False) and count(1, True, False)):
        drop(laid)
        return 1.0 if count(1, True, False) else 0.0
    used = (False,) if count(0, False) and count(1, False) else (True, False)
    texts = laid.withColumn("fitted", F.col("spared").isin(*used))
    names = sorted({r.lang for r in seen if r.lang is not None}) or [""]
    sums = added(texts.select("toxic", "lang", "fitted", "rows"), _counts)
    model = initial(np.stack([sums[f"class {k}"] for k in (0, 1)]), np.array([count(k, *used) for k in (0, 1)]))
    for n in range(epochs):
        model = _moved(model, rate * min(1.0, 2 * (1 - n / epochs)), texts.where("fitted").select("shard", "toxic", "rows"))
    counts = np.stack([sums.get(f"lang {x}", np.zeros(ROWS)) for x in names], axis=1) + 0.1
    model.guess = np.log(counts / counts.sum(0)).astype(np.float32)
    calibrating = texts.where("spared") if count(1, True) else texts
    # rows of a language: at most as many as a logit has steps
    got = calibrating.select("toxic", "rows").mapInArrow(_logits(model), "lang int, logit int, toxic int").groupBy("lang", "logit").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).toArrow()
    drop(laid)
    group, logit, toxic, of = (np.asarray(got.column(c).combine_chunks()) for c in ("lang", "logit", "toxic", "n"))
    logit = logit / STEPS
    values, where = np.unique(logit, return_inverse=True)
    target = np.log(decide / (1 - decide))
    model.shift = np.full(len(names), target - threshold(values, np.bincount(where, toxic), of=np.bincount(where, of)))
    for k in range(len(names)):
        own = group == k
        if count(1, True) and toxic[own].sum() >= 10 and (of - toxic)[own].sum() >= 10:
            model.shift[k] = target - threshold(logit[own], toxic[own], of=of[own])
    return model


def _score(model: Cnn | float):
    def run(batches):
        for batch in batches:
            scores = np.full(len(batch), 0.0 if isinstance(model, Cnn) else model)
            if isinstance(model, Cnn):
                data, where = W.utf8(batch.column("text"))
                for lo, hi, part, at in W.blocks(data, where, BLOCK):
                    scores[lo:hi] = model.scores(part, at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), decide: float = 0.7) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score, predicted.

    Labels with crc32(id) mod ``held_out[0]`` = ``held_out[1]`` are never used.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held_out[0])) == held_out[1], F.lit(False))
    # texts that are held out needn't go where labels are
    model = train(docs.where(~fold), labels.where(~fold), decide)
    out = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id bigint, score double")
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= decide).cast("int").alias("predicted"))
