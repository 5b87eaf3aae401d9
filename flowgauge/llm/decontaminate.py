"""Benchmark decontamination by an FM-index for each shard of the corpus.

The words of a shard are numbered by the words of the benchmark; all others, and the borders of
texts, part the sequence. The shard's FM-index is searched backward for every window of every
item, occurrences are located through sampled suffix positions, and the words they cover are merged
into removal spans. The corpus is only scanned; the benchmark is dealt to it in blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import ALNUM, LOWER, slices, word_hashes, text_bytes, words
from flowgauge.llm.fm_index import FmIndex

#: Bytes of benchmark text that are broadcast at a time; more comes in further blocks.
BLOCK_BYTES = 4_000_000


@dataclass(frozen=True)
class Phrases:
    """The distinct windows of a block of items, and the items of each."""

    vocabulary: np.ndarray  # sorted hashes of the words
    symbols: np.ndarray  # windows as rows of word numbers from 1, right-aligned
    lengths: np.ndarray
    item_start: np.ndarray  # items of window k: items[item_start[k]:item_start[k + 1]]
    items: np.ndarray
    names: list[str]


def phrases_of(rows: list[tuple[object, str | None]], width: int) -> Phrases | None:
    """Windows of ``width`` words, whole items where they are shorter; None without any word."""
    data, offsets = text_bytes(pa.array([text for _, text in rows], pa.string()))
    data = LOWER[data]
    starts, ends, item = words(data, offsets, ALNUM)
    if not len(starts):
        return None
    hashes = word_hashes(data, starts, ends)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    names = ["null" if i is None else str(i) for i, _ in rows]
    ids = {name: k for k, name in enumerate(sorted(set(names)))}
    owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
    number = number + 1
    for k in range(len(rows)):
        own = number[np.searchsorted(item, k) : np.searchsorted(item, k, "right")].tolist()
        for a in range(max(len(own) - width, 0) + 1 if own else 0):
            owners[tuple(own[a : a + width])].add(ids[names[k]])
    symbols = np.zeros((len(owners), width), np.int64)
    for k, window in enumerate(owners):
        symbols[k, width - len(window) :] = window
    return Phrases(
        vocabulary, symbols, np.array([len(w) for w in owners]),
        np.cumsum([0, *(len(o) for o in owners.values())]),
        np.array([i for o in owners.values() for i in sorted(o)]), sorted(ids, key=ids.get),
    )


def occurrences(
    hashes: np.ndarray, doc: np.ndarray, phrases: Phrases
) -> tuple[np.ndarray, np.ndarray]:
    """(word, window) of each occurrence of a window among the words of a shard."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(hashes):
        return none
    at = np.searchsorted(phrases.vocabulary, hashes)
    at[at == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[at] == hashes
    # Runs of known words of one text; those shorter than every window can't hold one.
    opens = known.copy()
    opens[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(opens)
    if not len(first):
        return none
    closes = known.copy()
    closes[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
    last = np.flatnonzero(closes) + 1
    enough = last - first >= phrases.lengths.min()
    first, last = first[enough], last[enough]
    if not len(first):
        return none
    size = last - first + 1  # each run is followed by a 0
    ends = np.cumsum(size)
    word = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
    symbols = np.empty(ends[-1], np.int64)
    border = np.zeros(ends[-1], bool)
    border[ends - 1] = True
    symbols[~border] = at[word[~border]] + 1
    symbols[border] = 0
    index = FmIndex(symbols, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    count = hi - lo
    window = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[window]
    return word[index.locate(rows)], window


_HITS = "n_words long, hits array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def _scan(texts: DataFrame, phrases: Phrases) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(tuple(vars(phrases).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Phrases(*shared.value)
        for batch, data, offsets in slices(batches):
            data = LOWER[data]
            starts, ends, doc = words(data, offsets, ALNUM)
            hashes = word_hashes(data, starts, ends)
            word, window = occurrences(hashes, doc, block)
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            if len(word):
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, word, 1)
                np.add.at(depth, word + block.lengths[window], -1)
                hit = np.cumsum(depth[:-1]) > 0
                opens, closes = hit.copy(), hit.copy()
                opens[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
                closes[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
                base = np.searchsorted(doc, np.arange(batch.num_rows))
                for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist()):
                    d = int(doc[a])
                    hits[d].append({
                        "first": a - int(base[d]), "last": b - int(base[d]),
                        "start": int(starts[a] - offsets[d]), "end": int(ends[b] - offsets[d]),
                    })
                for d, w in np.unique(np.stack([doc[word], window], 1), axis=0).tolist():
                    items[d] += [block.names[i] for i in block.items[block.item_start[w] : block.item_start[w + 1]]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"),
                 pa.array(np.bincount(doc, minlength=batch.num_rows)),
                 pa.array(hits, pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))),
                 pa.array([sorted(set(i)) for i in items], pa.list_(pa.string()))],
                ["id", "text_hash", "n_words", "hits", "items"])

    return texts.mapInArrow(run, f"id long, text_hash long, {_HITS}")


def _merged(hits: list[dict]) -> list[dict]:
    """Runs of hit words from several blocks as one list without overlaps."""
    out: list[dict] = []
    for hit in sorted(hits, key=lambda h: (h["first"], h["last"])):
        if out and hit["first"] <= out[-1]["last"] + 1:
            if hit["last"] > out[-1]["last"]:
                out[-1] |= {"last": hit["last"], "end": hit["end"]}
        else:
            out.append(dict(hit))
    return out


def _merge_blocks(found: DataFrame, blocks: int) -> DataFrame:
    """One row per document from its rows of all blocks."""
    together = found.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [_merged(h) for h in batch.column("hits").to_pylist()]
            yield batch.set_column(
                batch.schema.get_field_index("hits"), "hits", pa.array(hits, batch.schema.field("hits").type))

    schema = f"id long, text_hash long, {_HITS}, copies int"
    merged = together.mapInArrow(run, schema)
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``documents``: id, n_words, ``hits`` (maximal runs of hit words: first and
    last word, start and end byte), ``items`` (names of the items with occurring windows, sorted).

    Null and empty texts have no words; items without words have no windows; an item without an
    id is named ``null``; rows that share an item id are one item. Null document ids and repeated
    rows are kept. An empty corpus gives an empty result, an empty benchmark no hits. Other columns
    are not read. The benchmark is read in blocks of about ``block_bytes`` of text, each broadcast
    on its own; with one block there is no shuffle, with more one by document.
    """
    texts = documents.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    found = _find(texts, items, width, block_bytes)
    return found.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def _find(texts: DataFrame, items: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """(id, text_hash, n_words, hits, items) of each row of ``texts`` (id, text, text_hash)."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    if blocks > 1:
        items = items.distinct()
    # By the text too, so that many rows of one item are spread; items are made distinct later.
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    scans = []
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(dealt == k).collect()]
        phrases = phrases_of(rows, width)
        scans.append(_scan(texts, phrases or _no_phrases(width)))
    found = reduce(DataFrame.unionByName, scans)
    return _merge_blocks(found, blocks) if blocks > 1 else found


def remove_contamination(
    documents: DataFrame, benchmark: DataFrame, width: int = 10, *, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``documents`` with each run of hit words replaced by one space; other columns as they are.

    What goes depends on a row's text alone: rows that share an id, or have none, are cleaned each by
    its own text, and there are as many rows after as before. Hits are joined back by the text's
    SHA-256, from one row for each distinct text that has any.
    """
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    # The two halves of 128 bits take the places of id and hash in the scan.
    halves = [F.conv(F.substring(key, at, 15), 16, 10).cast("long") for at in (1, 16)]
    texts = documents.select(halves[0].alias("id"), F.col(text_col).alias("text"), halves[1].alias("text_hash"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    hits = _find(texts, items, width, block_bytes).where(F.size("hits") > 0).groupBy("id", "text_hash").agg(
        F.any_value("hits").alias("_hits"))
    hits = hits.withColumnsRenamed({"id": "_hit_a", "text_hash": "_hit_b"})
    raw = F.col(text_col).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("_hits.end"))
    ends = F.concat(F.col("_hits.start"), F.array(F.octet_length(text_col).cast("long")))
    # Runs begin and end with words, so what is left between them is whole characters.
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    joined = documents.join(hits, (halves[0] == F.col("_hit_a")) & (halves[1] == F.col("_hit_b")), "left")
    cleaned = F.when(F.col("_hits").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, " "))
    return joined.withColumn(text_col, cleaned).select(documents.columns)


def _no_phrases(width: int) -> Phrases:
    return Phrases(np.zeros(1, np.uint64), np.zeros((1, width), np.int64), np.array([2**31]),
                   np.array([0, 0]), np.empty(0, np.int64), [])
