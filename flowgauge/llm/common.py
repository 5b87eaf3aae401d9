"""Shared helpers: intermediate tables, byte-level words and hashes, bounded bitmaps."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.session import shared_folder

#: Bytes of text that a task works on at a time; a longer single text is taken alone.
SLICE_BYTES = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs
    nothing, and the shuffle files of the finished step can go. ``batch_bytes``: what an Arrow batch
    holds on its way to Python, and one row more; else it may be 256 MB, twice that outside the heap."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column | str) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- text as bytes, inside tasks -------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ .
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column end to end, and the n + 1 offsets; null counts as empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that the texts of each piece have about ``size`` bytes at most."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield (
                batch.slice(row, end - row),
                data[offsets[row] : offsets[end]],
                offsets[row : end + 1] - offsets[row],
            )
            row = end


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Batches of packed texts in parts of a few rows, so that few are unpacked at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and text number of every maximal run of ``kind`` bytes within a text."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = kind[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64, endpoint=False)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64; each process makes its own."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n, SLICE_BYTES) + 1
            self.up = self._of(_MULTIPLIER, size)
            self.down = self._of(pow(_MULTIPLIER, -1, 2**64), size)

    @staticmethod
    def _of(m: int, size: int) -> np.ndarray:
        out = np.full(size, m, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer words are hashed one by one.
_LONG_WORD = 2048
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes at a time, each mixed with all before it:
    different words of up to eight bytes and one length never collide, and no pattern of bytes makes
    longer ones collide as it does in sums of powers."""
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * np.uint64(_MULTIPLIER))
        # Every eight bytes of the data as a number, wherever they begin.
        eight = np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
        row = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
        at, left = starts[row], size[row]
        while len(row):
            out[row] = mix(out[row] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
            more = left > 8
            row, at, left = row[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], by differences of one running sum."""
    _powers.reach(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers.up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers.down[starts])


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of the ``width`` bytes at every place."""
    _powers.reach(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers.up[: len(data)], out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= _powers.down[: len(out)]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


# ---- a set of longs in bounded space ---------------------------------------------------------

#: Bits of a membership bitmap: 16 MB, whatever the size of the set.
BITMAP_BITS = 1 << 27


def membership_bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits set at (hash mod BITMAP_BITS) of every value. Never misses a member; others pass in
    proportion to the bits set, so it may only spare work, never decide a result."""
    position = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    parts = (
        values.groupBy(F.bitmap_bucket_number(position).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits"))
        .collect()  # at most 4,097 rows of 4 KB
    )
    bits = np.zeros(BITMAP_BITS // 8 + 8192, np.uint8)
    for part, block in parts:
        start = (part - 1) * 4096 if part > 0 else 0
        own = np.frombuffer(block, np.uint8)
        bits[start : start + len(own)] |= own
    return bits


def maybe_in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each long: may it be a member?"""
    at = np.mod(values, BITMAP_BITS)
    # Buckets count from 1: position p is bit (p - 1) mod 32768 of bucket 1 + (p - 1) div 32768,
    # and position 0 is bit 0 of bucket 0, which shares the first block here.
    at = np.where(at > 0, at - 1, 0)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
