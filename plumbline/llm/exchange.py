"""An exchange of hash sets in blocks, for corpus-wide questions about every n-gram.

A row per n-gram would cost a shuffle several times the corpus.  Instead each block of texts sends one
binary row per hash range ("bucket") with its distinct n-gram hashes, 7 bytes each; a bucket answers each block
with one row about those hashes that it must know of.  A hash that very many documents hold is sent once by each
block, not once by each document.  The buckets' number follows from the bytes of text, so that one holds about
``BUCKET_BYTES`` of hashes, and blocks grow with it, so that rows do not get too small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordblocks as W

U = np.uint64
BUCKET_BYTES = 16 << 20
#: Of a hash's eight bytes the first is not sent, as the bucket tells it; with over 2**16 buckets rows would be too small.
LEAST_BITS, MOST_BITS = 4, 16
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

MOVED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcde")])
MOVED_DDL = "bucket int, block bigint, a binary, b binary, c binary, d binary, e binary"


def bits_for(documents: DataFrame, text: str = "text") -> int:
    """The buckets, as a power of two: a word has some six bytes and sends one hash of eight."""
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, size * 8 / 6 / BUCKET_BYTES))), LEAST_BITS, MOST_BITS))


def block_bytes(bits: int) -> int:
    """Bytes of text in a block: 1 MB with up to 2**9 buckets, 16 MB with 2**16."""
    return min(16, max(1, 1 << max(0, bits - 9))) * W.BLOCK_BYTES


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as compressed bytes; of rising ones the steps."""
    values = np.ascontiguousarray(values, np.int64)
    if rising and len(values):
        values = np.diff(values, prepend=0)
    small = values.astype(np.int32) if len(values) == 0 or (np.abs(values) < 2**31).all() else values
    small = small.astype(np.uint8) if len(small) and small.min() >= 0 and small.max() < 256 else small
    return bytes([small.dtype.itemsize]) + _PACK.compress(small.tobytes())


def unpack(raw: bytes, rising: bool = False) -> np.ndarray:
    kind = {1: np.uint8, 4: np.int32, 8: np.int64}[raw[0]]
    values = np.frombuffer(_UNPACK.decompress(raw[1:]), kind).astype(np.int64)
    return np.cumsum(values) if rising else values


def pack_hashes(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack_hashes(raw: bytes, bucket: int, bits: int) -> np.ndarray:
    """The hashes of a bucket's row; with fewer than 2**8 buckets, of their first byte what names the bucket."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :7] = low
    return full.view("<u8").ravel().astype(U) | (U(bucket << 8 >> bits) << U(56))


def merged(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct hash first stands (rising), how often it does; where the others stand, and their first."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
    count = np.diff(np.append(head, len(ranked)))
    first = np.minimum.reduceat(order, head) if len(head) else order
    again = np.repeat(first, count)
    other = order != again
    rise, later = np.argsort(first), np.argsort(order[other])
    return first[rise], count[rise], order[other][later], again[other][later]


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that has hashes: its number, and where they stand (rising)."""
    bucket = (hashes >> U(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for n in np.flatnonzero(np.diff(bounds)):
        yield int(n), order[bounds[n] : bounds[n + 1]]


def block_number(count: int) -> int:
    """A number for a block that is the same when a lost task runs again, and unique in its stage."""
    return (TaskContext.get().partitionId() << 32) + count


def about_bucket(block: int, bits: int) -> int:
    """A number beyond the buckets for the row about a block; such rows are spread over all partitions."""
    return (1 << bits) + ((block >> 32) * 40503 + (block & 0xFFFFFFFF)) % (1 << bits)


def to_buckets(moved: DataFrame, bits: int) -> DataFrame:
    """One partition a bucket, its rows in order; rows about blocks (buckets from 2**bits on) are spread over them."""
    return moved.repartitionById(1 << bits, F.expr(f"cast(bucket % {1 << bits} as int)")).sortWithinPartitions("bucket")


def to_blocks(told: DataFrame) -> DataFrame:
    """All rows of a block in one partition, in order."""
    return told.repartition("block").sortWithinPartitions("block", "bucket")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition sorted by ``key``, one list for each value."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def rows_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)
