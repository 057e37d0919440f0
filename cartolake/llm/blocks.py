"""Documents in blocks, and counts of hashed keys over all blocks.

A block is a few MB of documents, dealt by a hash of their ids and texts. Each block sends its distinct
keys once, as sorted arrays for each bucket of keys; buckets are counted and answer each block
in its own order. A key that a third of all rows have is one entry for each block, and no task
holds more than a bucket or a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
#: Bytes that a key takes on its way to its bucket: 40 bits beside the number of the bucket.
KEY_BYTES = 5

_U = np.uint64


def block_rows(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, id, text_hash, text) and the number of blocks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    n_blocks = int(max(1, (size["b"] + 64 * size["n"]) // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(F.pmod(F.xxhash64("id", "text_hash"), F.lit(n_blocks)).cast("int").alias("block"), "id", "text_hash", "text"), n_blocks


def n_buckets(n_blocks: int) -> int:
    return max(4, -(-n_blocks // 4))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and the n + 1 places where texts begin."""
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


class SpanHashes:
    """64-bit hashes of any spans of a byte array: differences of prefix sums, brought to one power."""

    BASE = 0x2545F4914F6CDD1D

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        powers = np.full(n + 1, self.BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * powers[:-1], out=self.sums[1:])
        powers[:] = pow(self.BASE, -1, 1 << 64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.inverse = powers

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket and key, and the buckets + 1 bounds in that order."""
    bucket = (keys % _U(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def packed(keys: np.ndarray, buckets: int) -> bytes:
    rest = ((keys // _U(buckets)) & _U((1 << 8 * KEY_BYTES) - 1)).astype("<u8")
    return rest.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // KEY_BYTES
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(n, KEY_BYTES)
    return out.view("<u8").reshape(n)


Keys = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def key_counts(rows: DataFrame, keys: Keys, buckets: int) -> DataFrame:
    """(block, bucket, counts): for each distinct key of a block, in the order of in_buckets, how many documents have it in all.

    keys gives the distinct keys of a block and in how many of its documents each is.
    counts: zlib of little-endian 32-bit numbers.
    """

    def send(block: tuple, t: pa.Table) -> pa.Table:
        found, n = keys(t)
        order, bounds = in_buckets(found, buckets)
        found, n = found[order], n[order].astype("<u4")
        parts = [(b, packed(found[x:y], buckets), zlib.compress(n[x:y].tobytes(), 1)) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
        number = block[0].as_py()
        return pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "block": pa.array([number] * len(parts), pa.int32()), "keys": pa.array([p[1] for p in parts], pa.binary()), "n": pa.array([p[2] for p in parts], pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py()) for x in t.column("keys")]
        n = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), dtype="<u4") for x in t.column("n")])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.minimum(np.bincount(at, weights=n), 2**32 - 1).astype("<u4")[at]
        ends = np.cumsum([len(p) for p in parts])
        answers = [zlib.compress(x.tobytes(), 1) for x in np.split(total, ends[:-1])]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "counts": pa.array(answers, pa.binary())})

    sent = rows.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, n binary")
    return sent.groupBy("bucket").applyInArrow(count, "block int, bucket int, counts binary")


def counts_of(keys: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """The counts of a block's distinct keys, in their own order, from the rows that key_counts has for the block."""
    order, bounds = in_buckets(keys, buckets)
    out = np.zeros(len(keys), dtype=np.int64)
    for bucket, counts in zip(answers.column("bucket").to_pylist(), answers.column("counts"), strict=True):
        out[order[bounds[bucket] : bounds[bucket + 1]]] = np.frombuffer(zlib.decompress(counts.as_py()), dtype="<u4")
    return out
