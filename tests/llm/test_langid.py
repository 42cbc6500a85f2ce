import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import wordblocks as W
from plumbline.llm.langid import MARK, UNKNOWN, LanguageModel, Pieces, identify, letter_runs

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, score string, held_out int"


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    prob = rng.random((pieces.size + 1, 2)) / 100
    prob[-1] = 0
    index = {p: n for n, p in enumerate(pieces.names)}
    words = ["the", "hello", "ünder", "a", "xq"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    got = LanguageModel(["a", "b"], prob).word_scores(pieces, points, ends - [len(w) for w in words], ends)
    for n, word in enumerate(words):
        chars, total = chr(MARK) + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(chars) - 1):
            bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(chars)]
            p = np.ones(2)
            for a, b in zip(bounds, bounds[1:]):
                piece = chars[a:b]
                p = p * (prob[index[piece]] if piece in index else UNKNOWN if b - a == 1 else 0.0)
            total += p
        assert got[n] == pytest.approx(np.log(total))


def test_every_piece_is_found(pieces):
    assert (pieces.find(pieces.hashes) == pieces.order).all() and pieces.longest > 10
    assert (pieces.find(W.mix(pieces.hashes)) == pieces.size).mean() > 0.999


def test_long_runs_are_summed_whole(pieces):
    """Against a forward pass in logarithms, for runs that a plain one loses to underflow."""
    rng = np.random.default_rng(5)
    prob = rng.random((pieces.size + 1, 2)) / 1e6
    prob[-1] = 0
    index = {p: n for n, p in enumerate(pieces.names)}
    words = ["characteristically" * 20, "q" * 300, "the" * 700 + "ü" * 9]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    got = LanguageModel(["a", "b"], prob).word_scores(pieces, points, ends - [len(w) for w in words], ends)
    for n, word in enumerate(words):
        chars = chr(MARK) + word
        alpha = np.full((len(chars) + 1, 2), -np.inf)
        alpha[0] = 0
        for end in range(1, len(chars) + 1):
            for size in range(1, min(end, pieces.longest) + 1):
                piece = chars[end - size : end]
                if piece in index or size == 1:
                    alpha[end] = np.logaddexp(alpha[end], alpha[end - size] + np.log(prob[index[piece]] if piece in index else UNKNOWN))
        assert got[n] == pytest.approx(alpha[-1], rel=1e-9)


def test_runs():
    texts = ["Ab1c é", "", "x", "123", "日本語 a" + "b" * 50]
    points, starts, ends, text = letter_runs(texts)
    got = [(int(t), points[a:b].tobytes().decode("utf-32-le")) for a, b, t in zip(starts, ends, text)]
    assert got == [(0, "ab"), (0, "c"), (0, "é"), (2, "x"), (4, "日本語"), (4, "a" + "b" * 50)]


def test_identifies_held_out(spark):
    rng = random.Random(2)
    stock = {"aa": ["the", "and", "house", "water", "with", "good"], "bb": ["und", "das", "haus", "wasser", "mit", "gut"], "cc": ["les", "maison", "avec", "pour", "bonne", "eau"]}
    rows = [(n, " ".join(rng.choice(stock[lang]) for _ in range(30)).title(), lang, "c", 1) for n, lang in enumerate(list(stock) * 60)]
    rows += [(900, None, "aa", "c", 1), (901, "12 !!", "aa", "c", 1), (902, "", None, "c", 1), (None, "the water", None, "c", 1), (903, "x" * 100000, None, "c", 1), (4, rows[4][1], "bb", "c", 1)]
    out = identify(spark.createDataFrame(rows, SCHEMA), PATH, most=40).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0)
    held = [r for r in out if r.held_out and r.doc_id < 180]
    assert len(held) > 20 and np.mean([r.lang_pred == list(stock)[r.doc_id % 3] for r in held]) > 0.95


def test_nothing_to_learn(spark):
    assert {r.lang_pred for r in identify(spark.createDataFrame([(1, "a b", None, "c", 1)], SCHEMA), PATH).collect()} == {"und"}
    assert identify(spark.createDataFrame([], SCHEMA), PATH).collect() == []
