"""Ids of a fixed byte-level BPE vocabulary for whole columns of texts.

Every text is cut into the vocabulary's pre-tokens with array operations, each distinct pre-token of a block is
looked up by its bytes or encoded, and the ids are gathered.  Hashes only bring equal pre-tokens of a
block together; that they are equal is checked byte by byte.  Texts with an apostrophe, whose contractions the
array form leaves out, or with the string of a special token are encoded whole.  Ids come from ``tiktoken`` on the ranks
that the ``tokenizers`` file holds; tests compare them with those of ``tokenizers``.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken

from . import wordblocks as W

#: Fixed: how the byte-level vocabularies split text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed: the characters with the Unicode property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, BLANK = 1, 2, 3
#: Pre-tokens that a worker remembers, and the bytes of one that it may remember.
KEPT, KEPT_BYTES = 100_000, 32

_LOADED: dict[str, ByteBpe] = {}


@cache
def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, BLANK or 0 for every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = (ord(every[x]) for x in (m.start(), m.end() - 1))
            kinds[lo : hi + 1] = kind
    kinds[0xD800:0xE000] = 0
    kinds[WHITE] = BLANK
    return kinds


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    """The byte-level BPE of a ``tokenizers`` file whose ids rise in the order of merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        symbol = _bytes_of_symbols()
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(symbol[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.special = sorted(special)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in model.get("added_tokens", [])})
        self.size_of = np.zeros(max(ranks.values()) + 2, np.int64)
        for k, v in ranks.items():
            self.size_of[v] = len(k)
        self.kinds = character_kinds()
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def load(path: str) -> ByteBpe:
        """One for each worker process."""
        if path not in _LOADED:
            _LOADED[path] = ByteBpe(path)
        return _LOADED[path]

    def _odd(self, raw: bytes, data: np.ndarray, where: np.ndarray) -> list[int]:
        """Texts with an apostrophe or the string of a special token."""
        at = [np.flatnonzero(data == ord("'"))]
        for name in self.special:
            found, own = raw.find(name.encode()), []
            while found >= 0:
                own.append(found)
                found = raw.find(name.encode(), found + 1)
            at.append(np.array(own, np.int64))
        return np.unique(np.searchsorted(where, np.concatenate(at), "right") - 1).tolist()

    def encode(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From UTF-8 bytes and where each text begins (one more than texts): all ids in a row, and where each text's
        begin.  Bytes that are no UTF-8 count as the replacement character."""
        raw = data.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [t.encode() for t in W.strings(data, where)]
            raw, where = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            data = np.frombuffer(raw, np.uint8)
        odd = self._odd(raw, data, where)
        whole = {n: np.asarray(self.encoding.encode(raw[where[n] : where[n + 1]].decode(), allowed_special="all"), np.int32) for n in odd}
        if odd:
            size = np.diff(where)
            size[odd] = 0
            data = data[W.gathered(where[:-1], size)]
            raw, where = data.tobytes(), np.concatenate([[0], np.cumsum(size)])
        ids, begin = self._encode_plain(raw, data, where)
        if odd:
            parts = [whole.get(n, ids[begin[n] : begin[n + 1]]) for n in range(len(where) - 1)]
            ids, begin = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, begin

    def _encode_plain(self, raw: bytes, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(where), np.int64)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        byte = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
        starts = byte[self._pre_tokens(points, np.searchsorted(byte, where))]
        ends = np.append(starts[1:], len(raw))
        code, distinct = pd.factorize(W.span_hashes(data, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        lead = first[code]
        differ = np.flatnonzero(~W.same_spans(data, starts, ends, starts[lead], ends[lead]))
        if len(differ):  # hashes that collide: each of these pre-tokens counts as a distinct one
            code[differ] = len(first) + np.arange(len(differ))
            first = np.append(first, differ)
        flat, count = self._ids_of([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        at, size = np.cumsum(count) - count, count[code]
        upto = np.concatenate([[0], np.cumsum(size)])
        return flat[W.gathered(at[code], size)], upto[np.searchsorted(starts, where)]

    def _pre_tokens(self, points: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Where each pre-token begins."""
        n, kind = len(points), self.kinds[points]
        text_start = np.zeros(n + 1, bool)
        text_start[where] = True
        new = text_start.copy()
        new[1:-1] |= kind[1:] != kind[:-1]
        # whether the next character belongs to the same text and is not blank
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = (kind[1:] != BLANK) & ~text_start[1:-1]
        blank, space = kind == BLANK, points == 0x20
        after_space = np.zeros(n, bool)
        after_space[1:] = space[:-1] & ~text_start[1:-1]
        return np.flatnonzero(new[:-1] & (blank | ~after_space) | blank & solid_next)

    def _ids_of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens in a row, and how many each has."""
        known = self.known
        got = list(map(known.get, tokens))
        missing = [n for n, x in enumerate(got) if x is None]
        # pre-tokens that begin with their space can be encoded as one text, as they split again alike
        spaced = [n for n in missing if tokens[n][0] == 32 and not tokens[n].decode().isspace()]
        ids = np.asarray(self.encoding.encode_ordinary(b"".join(tokens[n] for n in spaced).decode()), np.int32)
        bound = np.cumsum([len(tokens[n]) for n in spaced], dtype=np.int64)
        cut = 4 * (np.searchsorted(np.cumsum(self.size_of[ids]), bound, "left") + 1)
        raw, lo = ids.tobytes(), 0
        for n, hi in zip(spaced, cut.tolist(), strict=True):
            got[n], lo = raw[lo:hi], hi
        for n in missing:
            if got[n] is None:
                got[n] = np.asarray(self.encoding.encode_ordinary(tokens[n].decode()), np.int32).tobytes()
            if len(known) < KEPT and len(tokens[n]) <= KEPT_BYTES:
                known[tokens[n]] = got[n]
        return np.frombuffer(b"".join(got), np.int32), np.array(list(map(len, got)), np.int64) // 4
