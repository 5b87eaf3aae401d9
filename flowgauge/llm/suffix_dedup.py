"""Removal of repeated byte strings by bucket-pointer refinement.

Sorting the suffixes of a corpus to a fixed depth puts equal strings of that length into one
bucket. Buckets start from q-grams and are refined by the buckets of later offsets: the bucket of
2q bytes is named by the pair of q-byte buckets at offsets 0 and q, that of 4q bytes by the pair of
2q-byte buckets, and so on, each round reusing the names of the one before. Names are hashes of
such pairs, so executors agree on them without exchanging ranks.

Almost all suffixes stand alone in their first bucket and need no refinement. To find the others
cheaply, each string is filed under its least q-gram; texts are packed into shards, each shard
sends its least q-grams once, and only strings whose least q-gram occurs twice are refined. Strings
that follow each other under one q-gram form a stretch: where whole stretches are equal, one name
stands for all their strings, and only stretches that differ within one q-gram are refined. Strings with
their least q-gram at about the same offset share a core of most of their bytes; cores are the buckets of
the next round, and only strings whose core another shard has as well are refined string by string. Names
are sorted, and every string but the first of its bucket marks its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import (
    as_long, in_parts, mix, slices, span_hashes, window_hashes, written,
)

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 1_000_000
_NO_ID = 2**63 - 1
#: Cores of the strings around a q-gram.
CORES = 4


def _keyed(texts: DataFrame) -> DataFrame:
    """(id, key, n_bytes, body): key tells texts apart, body is the packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch, data, offsets in slices(batches):
            view = memoryview(np.ascontiguousarray(data))
            texts = [view[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"),
                 pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                 pa.array(np.diff(offsets)),
                 pa.array([packer.compress(t) for t in texts], pa.binary())],
                ["id", "key", "n_bytes", "body"])

    return texts.mapInArrow(run, "id long, key binary, n_bytes long, body binary")


def _shards(kept: DataFrame) -> DataFrame:
    """(shard, ids, keys, ends, body): texts in the order of their ids, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 24
        ids, keys, texts, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]),
                 pa.array([b"".join(keys)]), pa.array([ends.astype(np.int64).tobytes()]),
                 pa.array([packer.compress(b"".join(texts))])],
                ["shard", "ids", "keys", "ends", "body"])

        for batch in in_parts(batches):
            for i, key, body in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "body"))):
                text = unpacker.decompress(body)
                if texts and size + len(text) > SHARD_BYTES:
                    yield shard()
                    number += 1
                    ids, keys, texts, size = [], [], [], 0
                ids.append(i)
                keys.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield shard()

    # Repeated rows are one document; this also brings them together, whatever the join above did.
    copy = F.row_number().over(Window.partitionBy("id", "key").orderBy("n_bytes"))
    single = kept.select("id", "key", "body", copy.alias("copy")).where("copy = 1").drop("copy")
    ordered = single.sortWithinPartitions("id", "key")
    return ordered.mapInArrow(run, "shard long, ids binary, keys binary, ends binary, body binary")


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of ``width`` values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def first_buckets(data: np.ndarray, ends: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Name of the q-gram at every position, and of the least q-gram of the string of ``length``
    bytes at every position (0 where the string would leave its text)."""
    grams = window_hashes(data, q) | np.uint64(1)
    least = _sliding(grams, length - q + 1, np.minimum)
    starts = np.concatenate([[0], ends[:-1]])
    open_at = np.zeros(len(least) + 1, np.int32)
    inside = ends - starts >= length
    np.add.at(open_at, starts[inside], 1)
    np.add.at(open_at, ends[inside] - length + 1, -1)
    least[np.cumsum(open_at[:-1]) == 0] = 0
    return grams, least


def _least_places(grams: np.ndarray, least: np.ndarray, length: int, q: int) -> np.ndarray:
    """Places of the q-grams that are least in some string: those around which no string has a lesser one."""
    width = length - q + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(grams == _sliding(padded, width, np.maximum)[: len(grams)])


def core_starts(grams: np.ndarray, least: np.ndarray, places: np.ndarray, length: int, q: int) -> tuple[np.ndarray, int]:
    """Where the core of each string begins, and the length of all cores. A core lies within its string, at
    a place that follows from the first of its least q-grams, so equal strings have equal cores; strings
    at ``length`` - q + 1 places in a row share CORES of them."""
    step = -(-(length - q + 1) // CORES)
    used = _least_places(grams, least, length, q)
    names, rank = np.unique(grams[used], return_inverse=True)
    span = len(grams) + 1
    keys = np.sort(rank * span + used)
    row = np.searchsorted(names, least[places]) * span
    first = keys[np.searchsorted(keys, row + places)] - row
    return first - (first - places) // step * step, length - step + 1


def refine(grams: np.ndarray, positions: np.ndarray, q: int, length: int) -> np.ndarray:
    """Names of the buckets of ``length`` bytes at the positions, refined from q-gram buckets: in
    each round the name at a position is paired with the name at a later offset."""

    def name(at: np.ndarray, size: int) -> np.ndarray:
        if size == q:
            return grams[at]
        half = max(q, -(-size // 2))
        left, right = name(at, half), name(at + (size - half), half)
        return mix(left * np.uint64(0x9FB21C651E98DF25) + mix(right + np.uint64(size)))

    return name(positions, length)


def _least_grams(shards: DataFrame, length: int, q: int) -> DataFrame:
    """(gram, shard, many): the least q-grams of each shard once; ``many``: several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in in_parts(batches, 1):
            for shard, ends, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "ends", "body"))):
                data = np.frombuffer(unpacker.decompress(body), np.uint8)
                grams, least = first_buckets(data, np.frombuffer(ends, np.int64), length, q)
                found, count = np.unique(grams[_least_places(grams, least, length, q)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(found)), pa.array(np.full(len(found), shard, np.int64)),
                     pa.array(count > 1)], ["gram", "shard", "many"])

    return shards.select("shard", "ends", "body").mapInArrow(run, "gram long, shard long, many boolean")


def _segments(filed: DataFrame, length: int, q: int) -> DataFrame:
    """(gram, name, id, shard, at, run): stretches of ``run`` strings one after the other that are
    filed under one q-gram, named by their bytes. Of stretches with one name only the first of the
    shard is sent. Strings that the shard itself has before are repeats in any case; they come as
    stretches without a q-gram, under names of their own, and a stretch that has no others is not
    sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for shard, ids, ends, body, wanted in zip(
                *(batch.column(c) for c in ("shard", "ids", "ends", "body", "grams"))
            ):
                data = np.frombuffer(unpacker.decompress(body.as_py()), np.uint8)
                ends = np.frombuffer(ends.as_py(), np.int64)
                ids = np.frombuffer(ids.as_py(), np.int64)
                wanted = np.sort(np.ascontiguousarray(wanted.values.to_numpy()).view(np.uint64))
                grams, least = first_buckets(data, ends, length, q)
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                size = np.diff(np.append(first, len(least)))
                at = np.searchsorted(wanted, least[first])
                at[at == len(wanted)] = 0
                hit = wanted[at] == least[first]
                first, size = first[hit], size[hit]
                places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                is_first = _first_of_name(refine(grams, places, q, length))
                fresh = np.add.reduceat(is_first, np.cumsum(size) - size) > 0 if len(size) else np.empty(0, bool)
                names = span_hashes(data, first, first + size + length - 1)
                sent = fresh & _first_of_name(names)
                again = places[~is_first]
                cut = np.flatnonzero(np.append(True, np.diff(again) > 1)) if len(again) else again
                runs = np.diff(np.append(cut, len(again)))
                starts = again[cut]
                number = np.uint64((shard.as_py() << 32) % 2**64)
                own = np.concatenate([first[sent], starts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(as_long(least[first[sent]]), np.zeros(len(starts), np.int64)),
                              mask=np.arange(len(own)) >= int(sent.sum())),
                     pa.array(as_long(np.concatenate([names[sent], mix(starts.astype(np.uint64) + number)]))),
                     pa.array(ids[np.searchsorted(ends, own, "right")]),
                     pa.array(np.full(len(own), shard.as_py(), np.int64)), pa.array(own.astype(np.int32)),
                     pa.array(np.concatenate([size[sent], runs]).astype(np.int32))],
                    ["gram", "name", "id", "shard", "at", "run"])

    return filed.mapInArrow(run, "gram long, name long, id long, shard long, at int, run int")


def _first_of_name(names: np.ndarray) -> np.ndarray:
    """Whether each place is the first with its name."""
    first = np.zeros(len(names), bool)
    if len(names):
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        first[order[np.append(True, ordered[1:] != ordered[:-1])]] = True
    return first


def _contested_strings(row: dict, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Of a shard: its q-grams, the places of the strings in the given stretches, and the name of the core
    of each."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"].as_py()), np.uint8)
    pairs = row["stretches"].values
    first, size = (pairs.field(f).to_numpy().astype(np.int64) for f in ("at", "run"))
    order = np.argsort(first)
    first, size = first[order], size[order]
    places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    grams, least = first_buckets(data, np.frombuffer(row["ends"].as_py(), np.int64), length, q)
    starts, size = core_starts(grams, least, places, length, q)
    cores, core_of = np.unique(starts, return_inverse=True)
    return grams, places, refine(grams, cores, q, size)[core_of]


def _cores(contested: DataFrame, length: int, q: int) -> DataFrame:
    """(core, shard): the cores of the strings in the given stretches, each once in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                _, _, cores = _contested_strings(row, length, q)
                found = np.unique(cores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(found)), pa.array(np.full(len(found), row["shard"].as_py(), np.int64))],
                    ["core", "shard"])

    return contested.mapInArrow(run, "core long, shard long")


def _strings(contested: DataFrame, length: int, q: int) -> DataFrame:
    """(name, id, shard, at) of the strings in the given stretches whose core is wanted, the first of each
    name in the shard; its other places are known as repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                grams, places, cores = _contested_strings(row, length, q)
                wanted = np.ascontiguousarray(row["cores"].values.to_numpy()).view(np.uint64)
                places = places[np.isin(cores, wanted)]
                names = refine(grams, places, q, length)
                own = _first_of_name(names)
                ids, ends = (np.frombuffer(row[c].as_py(), np.int64) for c in ("ids", "ends"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(names[own])), pa.array(ids[np.searchsorted(ends, places[own], "right")]),
                     pa.array(np.full(int(own.sum()), row["shard"].as_py(), np.int64)),
                     pa.array(places[own].astype(np.int32))],
                    ["name", "id", "shard", "at"])

    return contested.mapInArrow(run, "name long, id long, shard long, at int")


def _covered(repeats: DataFrame, length: int) -> DataFrame:
    """(shard, spans): byte ranges that repeated strings cover, overlaps merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, at, size = (batch.column(c).to_numpy() for c in ("shard", "at", "run"))
            if not len(shard):
                continue
            at = at.astype(np.int64)
            end = at + size + length - 1
            cuts = np.flatnonzero(np.diff(shard)) + 1
            out, spans = [], []
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(shard))):
                reach = np.maximum.accumulate(end[a:b])
                new = np.flatnonzero(at[a + 1 : b] > reach[:-1]) + 1
                out.append(shard[a])
                spans.append(np.stack([at[a:b][np.append(0, new)], reach[np.append(new - 1, b - a - 1)]], 1)
                             .tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(spans, pa.binary())],
                                             ["shard", "spans"])

    ordered = repeats.repartition("shard").sortWithinPartitions("shard", "at")
    parts = ordered.mapInArrow(run, "shard long, spans binary")
    return parts.groupBy("shard").agg(F.collect_list("spans").alias("spans"))


def _document_spans(shards: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, key, spans): the ranges within each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, keys, ends, parts in zip(*(batch.column(c).to_pylist() for c in ("ids", "keys", "ends", "spans"))):
                ids, ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                pieces = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts])
                merged = merge_spans(pieces)
                # Ranges never cross texts, but those of neighbours touch where texts go as a whole.
                doc = np.searchsorted(ends, merged[:, 0], "right")
                last = np.searchsorted(ends, merged[:, 1] - 1, "right")
                for d in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(doc, last)])):
                    own = np.clip(merged, starts[d], ends[d]) - starts[d]
                    own = own[own[:, 1] > own[:, 0]]
                    if len(own):
                        rows.append((int(ids[d]), keys[16 * d : 16 * d + 16], own.ravel().tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                    ["id", "key", "spans"])

    joined = shards.select("shard", "ids", "keys", "ends").join(covered, "shard").drop("shard")
    return joined.mapInArrow(run, "id long, key binary, spans array<long>")


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) ranges; touching ones become one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(spans[1:, 0] > reach[:-1]) + 1
    return np.stack([spans[np.append(0, new), 0], reach[np.append(new - 1, len(spans) - 1)]], 1)


def _cut(keyed: DataFrame, as_text: bool) -> DataFrame:
    """Texts without their ranges; as text, without the bytes of characters cut in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in in_parts(batches):
            kept, removed, number = [], [], []
            columns = (batch.column(c) for c in ("body", "copy", "spans"))
            for body, copy, spans in zip(*columns):
                text = unpacker.decompress(body.as_py())
                spans = [0, len(text)] if copy.as_py() else spans.as_py() or []
                parts, at = [], 0
                for start, end in zip(spans[::2], spans[1::2]):
                    parts.append(text[at:start])
                    at = end
                parts.append(text[at:])
                kept.append(b"".join(parts))
                number.append(len(spans) // 2)
                removed.append(len(text) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()),
                 pa.array(number, pa.int64()),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text
                 else pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = "string" if as_text else "binary"
    return keyed.mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept {kind}")


def remove_repeats(
    documents: DataFrame, length: int = 100, *, id_col: str = "doc_id", text_col: str = "text",
    as_text: bool = False,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes, or
    ``as_text`` as a string, without what is left of a character that was cut in two).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a text with a
    smaller id, or before it in the same text. Null and empty texts have no bytes. Rows without
    an id come last in the order and keep their null. Repeated rows (same id and text) are one
    document and get the same result; rows that share an id but not the text are ordered among
    themselves in some fixed way. An empty table gives an empty result; other columns are not
    read. Strings are told apart by 64-bit names.
    """
    if length < 4:
        raise ValueError("the length must be 4 bytes at least")
    q = length // 4
    numbered = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    texts = documents.select(numbered.alias("id"), F.col(text_col).alias("text"))
    keyed = _keyed(texts)
    long_enough = keyed.where(F.col("n_bytes") >= length)
    docs = written(long_enough.select("id", "key").distinct())
    first = docs.groupBy("key").agg(F.min("id").alias("id"))
    copies = docs.join(first.withColumnRenamed("id", "first"), "key").where("id > first").select("id", "key")
    shards = written(_shards(long_enough.join(first, ["id", "key"], "left_semi")))

    grams = _least_grams(shards, length, q)
    same = Window.partitionBy("gram").orderBy("shard")
    filed = grams.select(
        "gram", "shard",
        (F.col("many") | F.lag("shard").over(same).isNotNull() | F.lead("shard").over(same).isNotNull())
        .alias("twice"),
    ).where("twice").groupBy("shard").agg(F.collect_list("gram").alias("grams"))
    filed = written(filed)
    packed = shards.drop("keys")
    segments = _segments(packed.join(filed, "shard"), length, q)
    stretch = Window.partitionBy("name").orderBy(F.col("gram").isNull(), "id", "shard", "at")
    judged = written(segments.withColumn("later", F.lag("at").over(stretch).isNotNull()))
    # A stretch that was there before is a repeat as a whole. The first of its name may still hold
    # repeated strings, if there are other stretches of the same q-gram.
    firsts = judged.where("gram IS NOT NULL AND NOT later")
    several = firsts.groupBy("gram").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    contested = firsts.join(several, "gram", "left_semi").groupBy("shard").agg(
        F.collect_list(F.struct("at", "run")).alias("stretches"))
    contested = written(contested)
    # Strings that a shard has several times are known; others repeat only if another shard has their core.
    around = Window.partitionBy("core").orderBy("shard")
    shared = _cores(packed.drop("ids").join(contested, "shard"), length, q).select(
        "core", "shard",
        (F.lag("shard").over(around).isNotNull() | F.lead("shard").over(around).isNotNull()).alias("twice"),
    ).where("twice").groupBy("shard").agg(F.collect_list("core").alias("cores"))
    wanted = contested.join(written(shared), "shard")
    strings = _strings(packed.join(wanted, "shard"), length, q)
    bucket = Window.partitionBy("name").orderBy("id", "shard", "at")
    repeats = strings.select(
        "shard", "at", F.lit(1).alias("run"), F.lag("at").over(bucket).isNotNull().alias("later")
    ).where("later").drop("later").unionByName(
        judged.where("later OR gram IS NULL").select("shard", "at", "run")
    )
    covered = written(_covered(repeats, length))
    marked = _document_spans(shards, covered).withColumn("copy", F.lit(False)).unionByName(
        copies.withColumn("copy", F.lit(True)), allowMissingColumns=True
    )
    marked = written(marked)
    out = _cut(
        keyed.join(marked, ["id", "key"], "left").select(
            "id", "n_bytes", "body", F.coalesce("copy", F.lit(False)).alias("copy"), "spans"),
        as_text,
    )
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
