"""Quality by ordinal cumulative-link regression on graded ratings.

Ratings 0 < 1 < ... < K come from one latent quality ``x.w`` with ordered thresholds:
P(grade <= k) = sigmoid(t_k - x.w), with one weight vector for all thresholds.  The features are hashed text: mean
counts of lower-cased words and of word shapes (case, symbols, digits, length, repetition of the last word).
The model is fitted in numpy, in one task, on at most ``most`` labelled documents of at most ``most_words`` words together,
those whose ids hash least; the driver gets the model alone.  Scoring reads every document whole, once, with no shuffle.

Defined results: null texts and texts without words have expected grade 0 and tail probability 0; documents of
an unknown (null) id are scored as any other and never used to fit; repeated labels of an id count by their
lowest quality and highest toxicity; without labels of two grades there is no model and each text with words
has the grade that there is, or the highest.  Further columns, of any name, stay as they are; ``rate`` leaves out columns
called as those that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordblocks as W
from .frames import column, fresh, mapped, named, own
from .scratch import prepare, table

WORDS, SHAPES = 1 << 16, 128

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'\"-"]] = True


def features(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word feature and shape feature (offset by WORDS) of each word, and each text's first word."""
    starts, ends, first = W.words(data, where)
    hashes = W.span_hashes(W.LOWER[data], starts, ends)
    size = ends - starts
    having = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data])])[np.stack([starts, ends])], axis=0)[0]
    symbols, upper = having(_SYMBOL), having(_UPPER)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(again)]] = 0
    shape = np.minimum(size // 4, 3) + 4 * (upper >= np.maximum(2, (size - symbols) // 2)) + 8 * (having(_DIGIT) > 0) + 16 * (symbols > 0) + 32 * (symbols * 2 >= size) + 64 * again
    return (hashes % np.uint64(WORDS)).astype(np.int64), WORDS + shape, first


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -60, 60)))

    def latent(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent quality and number of words of each text."""
        word, shape, first = features(data, where)
        total = np.concatenate([[0.0], np.cumsum(self.weights[word] + self.weights[shape])])
        count = np.diff(first)
        return np.diff(total[first]) / np.maximum(count, 1), count


def thresholds_of(gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then steps that are exponentials."""
    return np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def gradient(w: np.ndarray, gaps: np.ndarray, index: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood of ``grade`` by w and gaps; sparse features ``index``, ``value`` by ``row``."""
    top, t = len(gaps), thresholds_of(gaps)
    latent = np.bincount(row, value * w[index], len(grade))
    edges = np.concatenate([[-1e3], t, [1e3]])
    hi = 1 / (1 + np.exp(np.clip(latent - edges[grade + 1], -60, 60)))
    lo = 1 / (1 + np.exp(np.clip(latent - edges[grade], -60, 60)))
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g_t = np.bincount(np.clip(grade, 0, top - 1), np.where(grade < top, -d_hi, 0), top) + np.bincount(np.clip(grade - 1, 0, top - 1), np.where(grade > 0, d_lo, 0), top)
    g_gaps = np.cumsum(g_t[::-1])[::-1] / len(grade)
    g_gaps[1:] *= np.exp(gaps[1:])
    return np.bincount(index, value * ((d_hi - d_lo) / len(grade))[row], len(w)), g_gaps


def fit(index: np.ndarray, value: np.ndarray, begin: np.ndarray, grade: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-6) -> OrdinalModel:
    """Maximum likelihood by Adam; sparse rows ``index``/``value`` from ``begin`` on."""
    top = int(grade.max())
    row = W.owner(begin)
    w, gaps = np.zeros(WORDS + SHAPES), np.zeros(top)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, gaps)]
    share = np.array([(grade > k).mean() for k in range(top)]).clip(0.01, 0.99)
    start = np.log((1 - share) / share)
    gaps[0], gaps[1:] = start[0], np.log(np.maximum(np.diff(start), 0.05))
    for n in range(1, rounds + 1):
        g_w, g_gaps = gradient(w, gaps, index, value, row, grade)
        g_w += decay * w
        step = rate * min(1.0, 2 * (1 - n / (rounds + 1)))
        for x, g, m, scale in ((w, g_w, moments[0], 1.0), (gaps, g_gaps, moments[1], 0.1)):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x -= step * scale * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.99**n)) + 1e-8)
    return OrdinalModel(w, thresholds_of(gaps))


def _rows(batches):
    """Each document's mean feature counts."""
    schema = pa.schema([("rank", pa.int64()), ("grade", pa.int32()), ("words", pa.int64()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    for batch in batches:
        data, where = W.utf8(batch.column("text"))
        for lo, hi, part, at in W.blocks(data, where):
            word, shape, first = features(part, at)
            index, value = [], []
            for n in range(hi - lo):
                own = np.concatenate([word[first[n] : first[n + 1]], shape[first[n] : first[n + 1]]])
                i, c = np.unique(own, return_counts=True)
                index.append(i.astype(np.int32))
                value.append((2 * c / max(1, len(own))).astype(np.float32))
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([rows.column("rank"), rows.column("grade"), pa.array(np.diff(first)), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], schema=schema)


def _fitted(batches):
    """The model of all rows (one partition of few): its grade if there is only one, weights and thresholds otherwise."""
    grade, size, index, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for batch in batches:
        lists = [batch.column(c) for c in ("index", "value")]
        for held, kind, some in ((grade, np.int64, batch.column("grade")), (size, np.int64, lists[0].value_lengths()), (index, np.int64, lists[0].flatten()), (value, np.float64, lists[1].flatten())):
            held.append(np.asarray(some, kind))
    grade, size, index, value = map(np.concatenate, (grade, size, index, value))
    if not len(grade):
        return
    only = int(grade[0]) if len(np.unique(grade)) < 2 else None
    model = fit(index, value, np.concatenate([[0], np.cumsum(size)]), grade) if only is None else OrdinalModel(np.zeros(0), np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array([only], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds))], names=["only", "weights", "thresholds"])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 good but toxic, 2 good."""
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return each.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))


def train(documents: DataFrame, grades: DataFrame, most: int = 6000, most_words: int = 5_000_000) -> OrdinalModel | int:
    """Fit on the ``most`` graded documents whose ids hash least, as far as they have ``most_words`` words together; a bare
    grade if there is only one."""
    sample = grades.select("*", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("rank", "text", F.col("grade").cast("int").alias("grade"))
    drawn = table(rows.mapInArrow(_rows, "rank bigint, grade int, words bigint, index array<int>, value array<float>"), "sample")
    upto = F.sum("words").over(Window.orderBy("rank", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = drawn.withColumn("upto", upto).where(F.col("upto") <= most_words).select("grade", "index", "value").mapInArrow(_fitted, "only int, weights binary, thresholds binary").collect()
    if not got or got[0].only is not None:
        return got[0].only if got else -1
    return OrdinalModel(np.frombuffer(got[0].weights), np.frombuffer(got[0].thresholds))



def _score(model: OrdinalModel | int, top: int, at_least: int, text_at: int):
    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column(text_at))
            expected, tail = np.zeros(len(batch)), np.zeros(len(batch))
            for lo, hi, part, at in W.blocks(data, where):
                if isinstance(model, OrdinalModel):
                    latent, count = model.latent(part, at)
                    p = model.probabilities(latent) * (count > 0)[:, None]
                    expected[lo:hi] = p.sum(1)
                    tail[lo:hi] = p[:, at_least - 1] if at_least <= p.shape[1] else 0.0
                else:
                    count = np.diff(W.words(part, at)[2])
                    expected[lo:hi] = np.where(count > 0, model if model >= 0 else top, 0)
                    tail[lo:hi] = expected[lo:hi] >= at_least
            yield named([*batch.columns, pa.array(expected), pa.array(tail)])

    return run


def _scored(documents: DataFrame, labels: DataFrame, at_least: int, most: int, held_out: tuple[int, int], top: int) -> tuple[DataFrame, str, str]:
    """``documents`` with expected grade and tail probability, and the names of these, which are new."""
    prepare(documents.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held_out[0]))
    model = train(documents, graded(labels).where(fold != held_out[1]), most)
    expected, tail = fresh(documents, "__expected"), fresh(documents, "__tail")
    schema = T.StructType([*documents.schema.fields, T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType())])
    return mapped(documents, _score(model, top, at_least, documents.columns.index("text")), schema), expected, tail


def rate(documents: DataFrame, labels: DataFrame, at_least: int = 1, tail: float = 0.5, most: int = 6000, held_out: tuple[int, int] = (4, 2), top: int = 2) -> DataFrame:
    """All rows and columns of ``documents`` with expected_grade, tail_probability (of a grade of ``at_least``)
    and selected.  Labels with crc32(id) mod ``held_out[0]`` = ``held_out[1]`` are never used."""
    out, expected, chance = _scored(documents, labels, at_least, most, held_out, top)
    added = [column(expected).alias("expected_grade"), column(chance).alias("tail_probability"), (column(chance) >= tail).alias("selected")]
    return out.select(*(column(c) for c in documents.columns if c.lower() not in ("expected_grade", "tail_probability", "selected")), *added)


def accepted(documents: DataFrame, labels: DataFrame, at_least: int = 1, tail: float = 0.5, most: int = 6000, held_out: tuple[int, int] = (4, 2), top: int = 2) -> DataFrame:
    """The rows of ``documents``, with its own columns alone, that ``rate`` selects."""
    out, _, chance = _scored(documents, labels, at_least, most, held_out, top)
    return out.where(column(chance) >= tail).select(*own(documents))
