"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary: lower-case letters of any number, with or without the mark that begins a
word.  Each language has a probability for every piece, fitted by expectation maximisation over all
segmentations of its words.  A word, a run of letters, has as its probability the sum over all ways to segment it into
pieces, by the forward algorithm, rescaled where it gets small; a text's is the product over its words, all of them.  The
forward algorithm runs over the distinct words of one length of a block at once, one array step for each end and
size of the last piece.

Learning reads a bounded sample: for every language the ``most`` labelled documents whose ids hash least.  Of these, runs
of more than ``FIT_LONGEST`` letters are learned from in parts of so many; scoring takes every run whole.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when nothing was
labelled; characters in no piece have a small fixed probability in all languages; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordblocks as W
from .bpe import LETTER, character_kinds
from .frames import few
from .scratch import prepare

FIT_LONGEST = 32
#: The mark that begins a word in the vocabulary.
MARK = 0x2581
UNKNOWN = 1e-7
#: Distinct words that a worker remembers, with their scores.
KEPT = 100_000
#: Cells of the lattice of a group of words, at most, unless one word has more.
CELLS = 1 << 20
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased; range of every run of letters; its text."""
    lower = [t.lower() for t in texts]
    where = np.concatenate([[0], np.cumsum([len(t) for t in lower], dtype=np.int64)])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends, first = W.runs(character_kinds()[points] == LETTER, where)
    return points, starts, ends, W.owner(first)


def parts_of(starts: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in parts of at most ``longest``, and the run of each part."""
    parts = -(-(ends - starts) // longest)
    of = np.repeat(np.arange(len(starts)), parts)
    begin = starts[of] + longest * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    return begin, np.minimum(begin + longest, ends[of]), of


def _longer(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The hash of pieces that go on with these characters."""
    return W.mix(hashes ^ (points.astype(np.uint64) + np.uint64(1)) * _STEP)


class Pieces:
    """The vocabulary's pieces by hash; the index ``size`` stands for an unknown character."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = set()
        for n in range(model.vocab_size()):
            piece = model.id_to_piece(n)
            letters = piece.lstrip(chr(MARK))
            if letters.isalpha() and letters == letters.lower() and len(piece) - len(letters) <= 1:
                names.add(piece)
        self.names = sorted(names)
        self.size, self.longest = len(self.names), max(map(len, self.names))
        hashes, sizes = np.full(self.size, _SEED), np.array([len(p) for p in self.names])
        points, begin = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes
        for n in range(self.longest):
            more = np.flatnonzero(sizes > n)
            hashes[more] = _longer(hashes[more], points[begin[more] + n])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # the first that a hash with these top bits can be
        self.table = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.depth = int(np.bincount((self.hashes >> np.uint64(46)).astype(np.int64)).max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each hash, or ``size``."""
        at = self.table[(hashes >> np.uint64(46)).astype(np.int64)]
        out = np.full(hashes.shape, self.size, np.int32)
        for n in range(self.depth):
            where = np.minimum(at + n, self.size - 1)
            hit = self.hashes[where] == hashes
            out[hit] = self.order[where[hit]]
        return out


def lattice(pieces: Pieces, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words grouped by length: yields rows, length (with the mark) and for each size of a piece the piece of that size that
    ends with each character, as an array (words, length); ``size`` where there is none."""
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        length = int(sizes[order[a]]) + 1
        step = max(1, CELLS // (length * min(length, pieces.longest)))
        for lo in range(a, b, step):
            own = order[lo : min(lo + step, b)]
            chars = np.empty((len(own), length), np.uint32)
            chars[:, 0] = MARK
            chars[:, 1:] = points[starts[own][:, None] + np.arange(length - 1)]
            cells, hashes = [], np.full(chars.shape, _SEED)
            for size in range(1, min(length, pieces.longest) + 1):
                hashes = _longer(hashes[:, : length - size + 1], chars[:, size - 1 :])
                found = np.full(chars.shape, pieces.size, np.int32)
                found[:, size - 1 :] = pieces.find(hashes)
                cells.append(found if (found < pieces.size).any() or size == 1 else None)
            yield own, length, cells


def forward(cells: list, length: int, prob: np.ndarray, count: int, rescale: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """alpha[end] (words x languages): the summed probability of all segmentations of the first ``end`` characters, and the
    logarithm of what the last ones were divided by (those that the longest piece does not reach may differ)."""
    size, alpha, scale = len(prob) - 1, [np.ones((count, prob.shape[1]))], np.zeros((count, prob.shape[1]))
    for end in range(1, length + 1):
        one = cells[0][:, end - 1]
        total = alpha[end - 1] * np.where((one < size)[:, None], prob[one], UNKNOWN)
        for n in range(2, min(end, len(cells)) + 1):
            if cells[n - 1] is not None:
                piece = cells[n - 1][:, end - 1]
                hit = np.flatnonzero(piece < size)
                if len(hit):
                    total[hit] += alpha[end - n][hit] * prob[piece[hit]]
        alpha.append(total)
        small = total < 1e-150
        if rescale and small.any():
            for n in range(max(0, end - len(cells)), end + 1):
                alpha[n] = np.where(small, alpha[n] * 1e150, alpha[n])
            scale[small] -= 150 * np.log(10)
    return alpha, scale


class LanguageModel:
    """``prob``: pieces (and a last row of zeros for what is none) x languages."""

    def __init__(self, languages: list[str], prob: np.ndarray):
        self.languages, self.prob = languages, prob

    @staticmethod
    def fit(pieces: Pieces, counts: dict[str, dict[str, int]], rounds: int = 3) -> LanguageModel:
        languages = sorted(counts)
        prob = np.zeros((pieces.size + 1, len(languages)))
        for k, language in enumerate(languages):
            words = list(counts[language])
            weight = np.array([counts[language][w] for w in words], float)
            points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            starts = ends - np.array([len(w) for w in words], np.int64)
            lattices = list(lattice(pieces, points, starts, ends)) if words else []
            p = np.full((pieces.size + 1, 1), 1 / pieces.size)
            p[-1] = 0
            for _ in range(rounds):
                expected = np.zeros(pieces.size + 1)
                for rows, length, cells in lattices:
                    alpha, _ = forward(cells, length, p, len(rows), rescale=False)
                    beta = [None] * length + [np.ones(len(rows))]
                    scale = weight[rows] / np.maximum(alpha[length][:, 0], 1e-300)
                    for at in range(length - 1, -1, -1):
                        beta[at] = np.zeros(len(rows))
                        for n in range(1, min(len(cells), length - at) + 1):
                            if cells[n - 1] is None:
                                continue
                            piece = cells[n - 1][:, at + n - 1]
                            step = np.where(piece < pieces.size, p[piece, 0], UNKNOWN if n == 1 else 0.0) * beta[at + n]
                            expected += np.bincount(piece, alpha[at][:, 0] * step * scale, pieces.size + 1)
                            beta[at] += step
                expected[-1] = 0
                p = ((expected + 0.01) / (expected.sum() + 0.01 * pieces.size))[:, None]
                p[-1] = 0
            prob[:, k] = p[:, 0]
        return LanguageModel(languages, prob)

    def word_scores(self, pieces: Pieces, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(word) by language."""
        out = np.zeros((len(starts), len(self.languages)))
        for rows, length, cells in lattice(pieces, points, starts, ends):
            alpha, scale = forward(cells, length, self.prob, len(rows))
            out[rows] = np.log(alpha[length]) + scale
        return out


class Scorer:
    """A model in a worker, with the scores of words that it has met."""

    def __init__(self, path: str, model: LanguageModel):
        self.pieces, self.model = Pieces(path), model
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log P by text and language, and the letters' runs of each text."""
        points, starts, ends, text = letter_runs(texts)
        total, count = np.zeros((len(texts), len(self.model.languages))), np.bincount(text, minlength=len(texts))
        if len(starts):
            code, distinct = pd.factorize(W.span_hashes(points, starts, ends))
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            score = np.empty((len(distinct), total.shape[1]))
            at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
            hit = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
            score[hit] = self.scores[at[hit]]
            new = np.flatnonzero(~hit)
            score[new] = self.model.word_scores(self.pieces, points, starts[first[new]], ends[first[new]])
            if len(self.known) + len(new) <= KEPT:
                known = np.concatenate([self.known, distinct[new]])
                by = np.argsort(known)
                self.known, self.scores = known[by], np.concatenate([self.scores, score[new]])[by]
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(text, score[code, k], len(texts))
        return total, count


def _words(batches):
    """Each labelled document's runs of letters, counted by batch."""
    for batch in batches:
        data, where = W.utf8(batch.column("text"))
        for lo, hi, part, at in W.blocks(data, where):
            points, starts, ends, text = letter_runs(W.strings(part, at))
            starts, ends, of = parts_of(starts, ends, FIT_LONGEST)
            text = text[of]
            language = np.asarray(batch.column("lang").slice(lo, hi - lo).to_pylist(), object)
            raw = points.tobytes()
            words = [raw[4 * a : 4 * b].decode("utf-32-le", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            got = pd.DataFrame({"lang": language[text], "word": words}).value_counts(["lang", "word"]).rename("n").reset_index() if words else pd.DataFrame({"lang": [], "word": [], "n": []})
            yield pa.RecordBatch.from_pandas(got, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]), preserve_index=False)


def _predict(path: str, model: LanguageModel):
    def run(batches):
        scorer = None
        for batch in batches:
            names, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            if model.languages:
                scorer = scorer or Scorer(path, model)
                data, where = W.utf8(batch.column("text"))
                for lo, hi, part, at in W.blocks(data, where):
                    total, count = scorer.texts(W.strings(part, at))
                    best = total.argmax(1)
                    # the evidence of about ten words: a score that tells sure from unsure texts
                    share = np.exp((total - total.max(1, keepdims=True)) / np.maximum(1, count / 10)[:, None])
                    some = count > 0
                    names[lo:hi][some] = np.array(model.languages, object)[best[some]]
                    scores[lo:hi][some] = (1 / share.sum(1))[some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def train(documents: DataFrame, vocabulary: str, most: int = 300) -> LanguageModel:
    """From the (doc_id, text, lang) of ``documents``, ``most`` of each language."""
    # the least hashes of each language: of a frequent one only those below a bound, which some twice as many are, are sorted
    known = documents.where("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("rank")).distinct()
    counts = known.groupBy("lang").agg(F.count("*").alias("count"))
    low = known.join(F.broadcast(counts) if few(counts, 10_000) else counts, "lang").where((F.col("rank") / F.lit(2.0**64) + 0.5) * F.col("count") <= 2 * most + 200)
    sample = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id"))).where(F.col("n") <= most).select("doc_id", "lang")
    rows = documents.join(F.broadcast(sample), ["doc_id", "lang"]).select("text", "lang")
    got = rows.mapInArrow(_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts: dict[str, dict[str, int]] = {}
    for language, word, n in zip(got["lang"], got["word"], got["n"], strict=True):
        counts.setdefault(language, {})[word] = n
    if not counts:
        return LanguageModel([], np.zeros((1, 0)))
    return LanguageModel.fit(Pieces(vocabulary), counts)


def identify(documents: DataFrame, vocabulary: str, most: int = 300, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, lang_pred, score.

    Documents with crc32(id) mod ``held_out[0]`` = ``held_out[1]`` are not learned from.  ``vocabulary``: path of a
    ``sentencepiece`` model that every executor has.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held_out[0])) == held_out[1], F.lit(False))
    model = train(docs.where(~fold), vocabulary, most)
    out = docs.select("doc_id", "text").mapInArrow(_predict(vocabulary, model), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
