"""Language-model scores from a log-frequency Bloom filter.

The filter holds each n-gram of the training texts with its quantised count: a count of level q is
entered q times, under the levels 1 to q, and is found by probing level after level until one is
missing. It grows with what it holds.

Texts are packed into batches. Each batch sends its distinct n-grams, in order and as small
differences, to slices of the name space, once: there counts are summed, the slice's part of the
filter is built and probed. Answers need no names, as they come back in the order of the question:
exact counts of words, for the base score, and levels. As long as the filter has a size fit for it, it
is gathered and broadcast to the workers, which probe it themselves; beyond it the levels that the
slices found are taken. Both give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import (
    LOWER, NOT_SPACE, as_unsigned, mix, slices, word_hashes, text_bytes, words, written,
)

#: Names of the start and the end of a text.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Bits of a chunk of the filter; all probes of an n-gram fall into one chunk.
CHUNK_BITS = 1 << 19
PROBES = 3
#: Bytes of text in a batch; a longer text is a batch of its own.
BATCH_BYTES = 4_000_000
#: Bytes of text to a slice of the name space: what one task sums up at a time.
SLICE_TEXT = 16_000_000
#: N-grams that are entered or probed at a time.
PIECE = 1 << 18
#: Bytes of an Arrow batch of questions, or of answers and texts.
ARROW_BYTES = 8_000_000


@dataclass(frozen=True)
class LogBloom:
    """``base``: step of the count levels. ``bits_per_entry``: size of the filter by what it holds,
    at least. ``max_bytes``: largest filter that is broadcast; a larger one stays in its slices. The
    scores are the same. ``min_pairs``: pairs of words seen less often are not in the model (1: all
    are). ``prior``: weight of the single-word model in the smoothing."""

    base: float = 2.0
    bits_per_entry: int = 12
    max_bytes: int = 1 << 26
    min_pairs: int = 1
    prior: float = 50.0

    def __post_init__(self) -> None:
        if self.base <= 1 or self.bits_per_entry < 1 or self.min_pairs < 1 or self.prior <= 0:
            raise ValueError("impossible filter parameters")
        if self.max_bytes * 8 < CHUNK_BITS:
            raise ValueError("the filter needs a chunk at least")

    def level(self, count: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(count) / np.log(self.base) + 1e-9).astype(np.int64)

    def count(self, level: np.ndarray) -> np.ndarray:
        """Middle of the counts of a level; 0 for level 0."""
        low = self.base ** (level - 1.0)
        return np.where(level > 0, (low + np.maximum(np.ceil(low * self.base) - 1, low)) / 2, 0.0)


def token_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens with START before and END behind each text; the text of each."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    out = np.empty(len(starts) + 2 * n, np.uint64)
    out[np.arange(len(starts)) + 2 * doc + 1] = word_hashes(data, starts, ends)
    out[first[:-1] + 2 * np.arange(n)] = START
    out[first[1:] + 2 * np.arange(n) + 1] = END
    return out, np.repeat(np.arange(n), np.diff(first) + 2)


def pair_names(tokens: np.ndarray) -> np.ndarray:
    """Name of (previous, this) for every token but the first."""
    return mix(tokens[:-1] * np.uint64(0xA0761D6478BD642F) + tokens[1:])


def probe_bits(grams: np.ndarray, level: np.ndarray | int) -> list[np.ndarray]:
    """Bit positions within the chunk for an n-gram at a level."""
    x = mix(grams + np.asarray(level, np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return [((x >> np.uint64(19 * k)) & np.uint64(CHUNK_BITS - 1)).astype(np.int64) for k in range(PROBES)]


def slice_of(grams: np.ndarray, n_slices: int) -> np.ndarray:
    """Slices are ranges of names, so that names in order are in order of slices."""
    return (((grams >> np.uint64(32)) * np.uint64(n_slices)) >> np.uint64(32)).astype(np.int64)


def chunk_of(grams: np.ndarray, chunks: np.ndarray | int) -> np.ndarray:
    """The chunk within a slice of ``chunks``, by the half of the name that does not say the slice."""
    low = grams & np.uint64(0xFFFFFFFF)
    return ((low * np.asarray(chunks, np.uint64)) >> np.uint64(32)).astype(np.int64)


def lookup(bits: np.ndarray, base: np.ndarray | int, grams: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Level of each n-gram, whose chunk begins at bit ``base``: probe level after level until one
    is missing; no n-gram has a level above ``most``."""
    base, most = np.broadcast_to(base, len(grams)), np.broadcast_to(most, len(grams))
    if len(grams) > PIECE:
        cuts = [slice(k, k + PIECE) for k in range(0, len(grams), PIECE)]
        return np.concatenate([lookup(bits, base[c], grams[c], most[c]) for c in cuts])
    level = np.zeros(len(grams), np.int64)
    alive = np.flatnonzero(most)
    while len(alive):
        there = np.ones(len(alive), bool)
        for at in probe_bits(grams[alive], level[alive] + 1):
            at = at + base[alive]
            there &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        alive = alive[there]
        level[alive] += 1
        alive = alive[level[alive] < most[alive]]
    return level


def enter(bits: np.ndarray, base: np.ndarray | int, grams: np.ndarray, level: np.ndarray) -> None:
    """Set the bits of n-grams whose chunk begins at bit ``base``; a byte for each bit."""
    base = np.broadcast_to(base, len(grams))
    for k in range(1, int(level.max(initial=0)) + 1):
        every = np.flatnonzero(level >= k)
        for own in (every[start : start + PIECE] for start in range(0, len(every), PIECE)):
            for at in probe_bits(grams[own], k):
                bits[at + base[own]] = 1


# ---- numbers as bytes ------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    rows = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + rows[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def pack_names(names: np.ndarray) -> bytes:
    """Ascending names by their first and the differences that follow."""
    return names[:1].tobytes() + pack(np.diff(names))


def unpack_names(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, np.uint64, 1)
    return np.cumsum(np.concatenate([first, unpack(data[8:])]), dtype=np.uint64)


# ---- batches ---------------------------------------------------------------------------------


def _packed(texts: DataFrame) -> DataFrame:
    """(batch, ids, held_out, texts, n_bytes): texts in the order in which they are found. Written,
    as a batch must be the same texts each time it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, _ in slices(batches, size=BATCH_BYTES):
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.ListArray.from_arrays(one, batch.column(c)) for c in ("id", "held_out", "text")),
                 pa.array([len(data)])], ["ids", "held_out", "texts", "n_bytes"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"ids array<{kind}>, held_out array<boolean>, texts array<string>, n_bytes long")
    return written(rows.select(F.monotonically_increasing_id().alias("batch"), "*"))


def _grams(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a packed row: tokens, the text of each, the names of all pairs but those over the border
    of two texts, and for every text whether it is learnt from."""
    data, offsets = text_bytes(row.column("texts").flatten())
    tokens, doc = token_rows(data, offsets)
    learnt = ~row.column("held_out").flatten().to_numpy(zero_copy_only=False)
    return tokens, doc, pair_names(tokens)[tokens[:-1] != END], learnt


def _questions(packed: DataFrame, n_slices: int) -> DataFrame:
    """(slice, batch, size, names, counts): the distinct n-grams of each batch, and how often each
    occurs in its training texts; size 1 for words, start and end, 2 for pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                tokens, doc, pairs, learnt = _grams(row)
                for size, grams, owner in ((1, tokens, doc), (2, pairs, doc[1:][tokens[:-1] != END])):
                    names, place = np.unique(grams, return_inverse=True)
                    counts = np.bincount(place, learnt[owner], len(names)).astype(np.uint64)
                    yield from parts(row.column("batch")[0].as_py(), size, names, counts)

    def parts(number: int, size: int, names: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, first = np.unique(slice_of(names, n_slices), return_index=True)
        ends = [*first[1:].tolist(), len(names)]
        spans = list(zip(first.tolist(), ends, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(np.full(len(own), number)), pa.array(np.full(len(own), size)),
             pa.array([pack_names(names[a:b]) for a, b in spans], pa.binary()),
             pa.array([pack(counts[a:b]) for a, b in spans], pa.binary())],
            ["slice", "batch", "size", "names", "counts"])

    return packed.select("batch", "held_out", "texts").mapInArrow(
        run, "slice long, batch long, size long, names binary, counts binary")


# ---- slices ----------------------------------------------------------------------------------


class Slice:
    """All questions of one slice of the name space, summed up."""

    def __init__(self, batches: list[int], sizes: list[int], names: list[bytes], counts: list[bytes]):
        self.asked = {}
        for size in (1, 2):
            own = [k for k, s in enumerate(sizes) if s == size]
            parts = [unpack_names(names[k]) for k in own]
            every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            grams, place = np.unique(every, return_inverse=True)
            # Sums of whole numbers below 2**53 are exact.
            n = np.bincount(place, np.concatenate([unpack(counts[k]) for k in own]) if own else None, len(grams))
            places = np.split(place, np.cumsum([len(p) for p in parts])[:-1]) if own else []
            self.asked[size] = (grams, n.astype(np.int64), places, [batches[k] for k in own])

    def entered(self, model: LogBloom) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of the model and their levels."""
        grams, levels = [], []
        for size, least in ((1, 1), (2, model.min_pairs)):
            names, n, _, _ = self.asked[size]
            grams.append(names[n >= least])
            levels.append(model.level(n[n >= least]))
        return np.concatenate(grams), np.concatenate(levels)

    def part(self, model: LogBloom) -> tuple[dict[str, int], np.ndarray]:
        """This slice's part of the filter, and what must be known of it: training tokens and distinct
        ones among its names, its chunks, largest level and bits set."""
        names, n, _, _ = self.asked[1]
        own = n[names != START]
        grams, levels = self.entered(model)
        chunks = max(1, -(-int(levels.sum()) * model.bits_per_entry // CHUNK_BITS))
        bits = np.zeros(chunks * CHUNK_BITS, np.uint8)
        enter(bits, chunk_of(grams, chunks) * CHUNK_BITS, grams, levels)
        facts = {
            "total": int(own.sum()), "distinct": int((own > 0).sum()), "chunks": chunks,
            "most": int(levels.max(initial=0)), "ones": int(bits.sum(dtype=np.int64)),
        }
        return facts, np.packbits(bits, bitorder="little")

    def answers(self, facts: dict[str, int], bits: np.ndarray) -> Iterator[tuple[int, int, bytes | None, bytes]]:
        """(batch, size, counts, levels) to each question, in its order: exact counts of words, and the
        levels that probing finds."""
        for size in (1, 2):
            grams, n, places, batches = self.asked[size]
            base = chunk_of(grams, facts["chunks"]) * CHUNK_BITS
            levels = lookup(bits, base, grams, facts["most"]).astype(np.uint8)
            for place, batch in zip(places, batches, strict=True):
                counts = pack(n[place].astype(np.uint64)) if size == 1 else None
                yield batch, size, counts, levels[place].tobytes()


_ANSWER = (
    "batch long, slice long, size long, counts binary, levels binary, "
    "total long, distinct long, chunks long, most long, ones long, bits binary"
)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _answered(questions: DataFrame, model: LogBloom) -> DataFrame:
    """Answers to all questions, and for each slice a row without a batch: its facts and its part of
    the filter. Questions meet in the task of their slice, which holds one slice at a time."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _ANSWER.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("batch", "size", "names", "counts")]
            own = batch.column("slice").to_numpy()
            for start in [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()] if len(own) else []:
                if own[start] != number:
                    if held:
                        yield from rows(number, held)
                    number, held = int(own[start]), []
                end = start + int(np.searchsorted(own[start:], number, "right"))
                held.append([c.slice(start, end - start).to_pylist() for c in columns])
        if held:
            yield from rows(number, held)

    def rows(number: int, held: list) -> Iterator[pa.RecordBatch]:
        whole = Slice(*([x for part in held for x in part[k]] for k in range(4)))
        held.clear()
        facts, bits = whole.part(model)
        out = [{"slice": number, **facts, "bits": bits.tobytes()}]
        out += [
            {"batch": batch, "slice": number, "size": size, "counts": counts, "levels": levels}
            for batch, size, counts, levels in whole.answers(facts, bits)
        ]
        yield pa.RecordBatch.from_pylist(out, shape)

    dealt = questions.repartition("slice").sortWithinPartitions("slice", "size", "batch")
    return written(dealt.mapInArrow(run, _ANSWER), ARROW_BYTES)


@dataclass(frozen=True)
class Filter:
    """The whole filter: the bits of all slices end to end, and by slice where they begin, how many
    chunks they are and the largest level."""

    bits: np.ndarray
    first: np.ndarray
    chunks: np.ndarray
    most: np.ndarray

    def levels(self, names: np.ndarray) -> np.ndarray:
        own = slice_of(names, len(self.first))
        base = (self.first[own] + chunk_of(names, self.chunks[own])) * CHUNK_BITS
        return lookup(self.bits, base, names, self.most[own])


def _gathered(parts: DataFrame, n_slices: int) -> Filter:
    """The filter on the driver, once; it was found to be small enough."""
    held = {r.slice: r for r in parts.select("slice", "chunks", "most", "bits").toLocalIterator()}
    chunks = np.array([held[k].chunks if k in held else 0 for k in range(n_slices)], np.int64)
    most = np.array([held[k].most if k in held else 0 for k in range(n_slices)], np.int64)
    bits = np.frombuffer(b"".join(held[k].bits for k in sorted(held)), np.uint8)
    return Filter(bits, np.cumsum(chunks) - chunks, chunks, most)


# ---- scores ----------------------------------------------------------------------------------

_SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(packed: DataFrame, answers: DataFrame, whole: Filter | None, total: int, distinct: int,
            model: LogBloom) -> DataFrame:
    """Each batch meets its answers, which come first and in the order of its n-grams. With the
    ``whole`` filter its levels are probed here. Written, as the size of Arrow batches holds only then."""
    shared = packed.sparkSession.sparkContext.broadcast(whole and tuple(vars(whole).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[bytes]] = {}
        for batch in batches:
            asked = batch.column("texts").is_null().to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if not asked[k]:
                    yield scores(row, held)
                    held = {}
                    continue
                size = row.column("size")[0].as_py()
                for what in ("counts", "levels"):
                    if (data := row.column(what)[0].as_py()) is not None:
                        held.setdefault((size, what), []).append(data)

    def levels_of(names: np.ndarray, size: int, held: dict) -> np.ndarray:
        if shared.value is not None:
            return Filter(*shared.value).levels(names)
        return np.frombuffer(b"".join(held[size, "levels"]), np.uint8).astype(np.int64)

    def scores(row: pa.RecordBatch, held: dict) -> pa.RecordBatch:
        tokens, doc, pairs, learnt = _grams(row)
        n = len(learnt)
        single, place = np.unique(tokens, return_inverse=True)
        count = np.concatenate([unpack(part) for part in held[1, "counts"]]).astype(np.float64)
        one = model.count(levels_of(single, 1, held))
        scored = tokens != START
        here, owner = place[scored], doc[scored]
        before = one[place[:-1]][tokens[:-1] != END]
        word = (one[here] + 1) / (total + distinct + 1)
        names, pair_place = np.unique(pairs, return_inverse=True)
        both = np.minimum(model.count(levels_of(names, 2, held))[pair_place], before)
        log_p = np.log10((both + model.prior * word) / (before + model.prior))
        log_one = np.log10((count + 1) / (total + distinct + 1))[here]
        return pa.RecordBatch.from_arrays(
            [row.column("ids").flatten(), pa.array(~learnt), pa.array(np.bincount(owner, minlength=n)),
             pa.array(np.bincount(owner, count[here] > 0, n).astype(np.int64)),
             pa.array(np.bincount(owner, log_one, n)), pa.array(np.bincount(owner, log_p, n))],
            ["id", *_names(_SCORES)])

    kind = packed.schema["ids"].dataType.elementType.simpleString()
    # The texts come after all slices and sizes.
    last = packed.select("batch", F.lit(1).alias("texts_after"), F.lit(None).cast("long").alias("size"),
                         F.lit(None).cast("long").alias("slice"), F.lit(None).cast("binary").alias("counts"),
                         F.lit(None).cast("binary").alias("levels"), "ids", "held_out", "texts")
    levels = F.lit(None).cast("binary").alias("levels") if whole else F.col("levels")
    first = answers.where("batch IS NOT NULL").select(
        "batch", F.lit(0).alias("texts_after"), "size", "slice", "counts", levels,
        *(F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in ("ids", "held_out", "texts")))
    met = last.unionByName(first).repartition("batch").sortWithinPartitions("batch", "texts_after", "size", "slice")
    return written(met.mapInArrow(run, f"id {kind}, {_SCORES}"), ARROW_BYTES)


def score_texts(
    documents: DataFrame,
    held_out: Column,
    model: LogBloom | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (add-one over single tokens), score (the model's log10 probability) and
    false_rate (chance that the filter answers yes for an n-gram it does not hold).

    Rows where ``held_out`` is true are scored but not learnt from; a null condition counts as
    false. Null and empty texts are one end token. Null ids and repeated rows are kept and counted.
    An empty table gives an empty result; a table with nothing to learn from is scored by an empty
    model. Other columns are not read. Words are told apart by 64-bit names.
    """
    model = model or LogBloom()
    texts = documents.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    packed = _packed(texts)
    size = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_slices = 1 << max(0, (-(-size // SLICE_TEXT) - 1).bit_length())
    answers = _answered(_questions(packed, n_slices), model)
    parts = answers.where("batch IS NULL")
    total, distinct, chunks, ones = (
        int(x or 0) for x in parts.agg(*(F.sum(c) for c in ("total", "distinct", "chunks", "ones"))).first())
    false_rate = float((ones / max(chunks * CHUNK_BITS, 1)) ** PROBES)
    whole = _gathered(parts, n_slices) if chunks * CHUNK_BITS <= model.max_bytes * 8 else None
    scored = _scored(packed, answers, whole, total, distinct, model)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.lit(false_rate).alias("false_rate"),
    )
