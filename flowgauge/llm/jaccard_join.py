"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The product of the incidence matrix with its transpose holds the overlaps of all pairs. Only cells
that can reach the threshold are ever touched:

1. Documents with equal n-gram sets are one row of the matrix.
2. Columns are ordered from rare to common (by a bounded table of counts, ties by hash). Two sets
   that link share some columns among the rarest of each; how many follows from their sizes.
   Only these incidences are shuffled, by column.
3. Columns with few rows yield pairs within the size bounds; those that meet in enough columns
   are candidates, whose overlaps are counted. Pairs may meet in columns with many rows as well: as
   many as the one of the two that has fewer of these columns. Only sets that could link by such
   columns alone stay in them, and columns that are left with few rows yield pairs in their turn. The
   rows of those that still have many are gathered into families; a family is cut into
   blocks of similar sizes, and the product runs block by block: overlaps are accumulated over
   slices of columns, and a pair is discarded as soon as what it has and what is left lie below
   its bound. A block returns a spanning forest of its links, never all pairs.
4. Links are contracted to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import (
    LOWER, NOT_SPACE, as_long, maybe_in, membership_bitmap, mix, slices, word_hashes,
    words, written,
)
from flowgauge.llm.components import components

#: Cells of the table of column counts (4 MB), which only orders columns.
COUNT_CELLS = 1 << 20
_CHUNK = 1 << 14
#: A column with more rows than this among the rarest goes to the blocked product.
FEW_ROWS = 16
#: How often sets are taken out of columns with many rows before what is left of these makes families.
ROUNDS = 2
#: Documents in a block, and columns multiplied at a time.
BLOCK_ROWS, BLOCK_COLUMNS = 256, 2048


@dataclass(frozen=True)
class Similarity:
    """Link when ``den * overlap >= num * union`` of sets of ``width``-word shingles."""

    num: int = 85
    den: int = 100
    width: int = 4

    def __post_init__(self) -> None:
        if not 0 < self.num <= self.den or self.width < 1:
            raise ValueError("the threshold must be in (0, 1] and the width positive")

    def common(self, n: int) -> int:
        """How many of the rarest columns a set of this size has in common with any larger set it
        links with: more than one, so that a chance meeting in one column is no candidate."""
        return min(1 + n // 32, -(-self.num * n // self.den))

    def alone(self, n: int) -> bool:
        """Whether a set of this size is too small to link with any other."""
        return self.den * n < self.num * (n + 1)

    def probe_length(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + self.common(n)

    def index_length(self, n: int) -> int:
        """For the smaller set of a pair."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + self.common(n)

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of sets of these sizes."""
        total = (a + b).astype(np.int64) * self.num
        return -(-total // (self.num + self.den))


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text. Fewer words than ``width``: the whole
    sequence is the one shingle; no words: empty."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets, NOT_SPACE)
    one = word_hashes(data, starts, ends)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    grams = np.zeros(max(len(one) - width + 1, 0), np.uint64)
    for k in range(width):
        grams += one[k : k + len(grams)] * np.uint64(2 * (0xA24BAED4963EE407 + 77 * k**3) % 2**63 + 1)
        grams ^= grams >> np.uint64(29)
    grams = mix(grams)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            found = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            code = np.array([b - a], np.uint64)
            for k in range(a, b):
                code = mix(code * np.uint64(0xD6E8FEB86659FD93) + one[k : k + 1])
            yield code
        else:
            yield np.empty(0, np.uint64)


def set_code(grams: np.ndarray) -> int:
    """A 63-bit code of a set."""
    total = mix(grams).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(grams)))[0] >> np.uint64(1))


def _survey(texts: DataFrame, like: Similarity) -> DataFrame:
    """Per document its set's code and size, and per task the column counts in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_CELLS, np.int32)
        names = ["id", "code", "n", "chunk", "counts"]
        for batch, data, offsets in slices(batches):
            codes, sizes = [], []
            for grams in gram_sets(data, offsets, like.width):
                codes.append(set_code(grams))
                sizes.append(len(grams))
                np.add.at(counts, (grams >> np.uint64(44)).astype(np.int64), 1)
            n = len(codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(codes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        chunks = [k for k in range(COUNT_CELLS // _CHUNK) if counts[k * _CHUNK : (k + 1) * _CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(chunks), pa.int64()), pa.nulls(len(chunks), pa.int64()),
             pa.nulls(len(chunks), pa.int64()), pa.array(chunks, pa.int32()),
             pa.array([counts[k * _CHUNK : (k + 1) * _CHUNK].tobytes() for k in chunks], pa.binary())],
            names)

    return texts.mapInArrow(run, "id long, code long, n long, chunk int, counts binary")


def _column_counts(survey: DataFrame) -> np.ndarray:
    """The sum of all tasks' tables: 64 rows reach the driver, 8 MB in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "counts"))):
                own = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()],
                      pa.binary())], ["chunk", "counts"])

    parts = survey.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    counts = np.zeros(COUNT_CELLS, np.int32)
    for chunk, block in parts.mapInArrow(add, "chunk int, counts binary").collect():
        counts[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(block, np.int32)
    return counts


def _incidences(texts: DataFrame, counts: np.ndarray, like: Similarity) -> DataFrame:
    """(gram, code, n, core) of the rarest columns of each set that can link; ``core``: rare enough
    for a smaller partner. A set that a task has seen already is left out there."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = shared.value, set()
        for _, data, offsets in slices(batches):
            out, codes, sizes, core = [], [], [], []
            for grams in gram_sets(data, offsets, like.width):
                n = len(grams)
                if like.alone(n) or (code := set_code(grams)) in seen:
                    continue
                seen.add(code)
                key = cells[(grams >> np.uint64(44)).astype(np.int64)]
                rare = grams[np.argsort(key, kind="stable")[: like.probe_length(n)]]
                out.append(rare)
                codes.append(np.full(len(rare), code, np.int64))
                sizes.append(np.full(len(rare), n, np.int64))
                core.append(np.arange(len(rare)) < like.index_length(n))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(out))), pa.array(np.concatenate(codes)),
                     pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(core))],
                    ["gram", "code", "n", "core"])

    return texts.select("text").mapInArrow(run, "gram long, code long, n int, core boolean")


def _column_pairs(incidences: DataFrame, like: Similarity) -> DataFrame:
    """(a, b, many, columns, n, core): pairs of rows of columns with few of them, in how many of these
    they meet, with the smaller size; for columns with many the incidences (gram, code) themselves.
    Rows come sorted by column and size; a task keeps at most FEW_ROWS + 1 of them from one batch to
    the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        hot: int | None = None  # column with many rows that is still open
        names = ("gram", "code", "n", "core")

        def emit(columns: list[np.ndarray], last: bool) -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal kept, hot
            gram, code, n, core = columns
            fresh = np.ones(len(gram), bool)  # a set that several tasks have sent counts once
            fresh[1:] = (gram[1:] != gram[:-1]) | (code[1:] != code[:-1])
            gram, code, n, core = (c[fresh] for c in (gram, code, n, core))
            edges = np.flatnonzero(np.diff(gram)) + 1
            first = np.concatenate([[0], edges])
            size = np.diff(np.concatenate([first, [len(gram)]]))
            open_end = first[-1] if not last else len(gram)
            run_of = np.repeat(np.arange(len(first)), size)
            many = (size > FEW_ROWS)[run_of]
            if hot is not None and gram[0] == hot:
                many |= run_of == 0
            yield gram[many], code[many], np.ones(int(many.sum()), bool), n[many], core[many]
            closed = ~many & (np.arange(len(gram)) < open_end)
            for d in range(1, FEW_ROWS):
                left = np.flatnonzero(closed[:-d] & (run_of[:-d] == run_of[d:])) if len(gram) > d else []
                if not len(left):
                    break
                right = left + d
                ok = core[left] & (like.den * n[left].astype(np.int64) >= like.num * n[right].astype(np.int64))
                a, b = code[left[ok]], code[right[ok]]
                no = np.zeros(len(a), bool)
                yield np.minimum(a, b), np.maximum(a, b), no, n[left[ok]], no
            if last:
                kept = hot = None
            elif many[-1]:
                hot, kept = int(gram[-1]), [c[-1:] for c in (gram, code, n, core)]
            else:
                hot, kept = None, [c[open_end:] for c in (gram, code, n, core)]

        def rows(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if len(part[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["a", "b", "many", "n", "core"])

        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
                if kept is not None:
                    columns = [np.concatenate(pair) for pair in zip(kept, columns)]
                yield from rows(emit(columns, False))
        if kept is not None:
            yield from rows(emit(kept, True))

    ordered = incidences.repartition("gram").sortWithinPartitions("gram", "n", "code")
    return ordered.mapInArrow(run, "a long, b long, many boolean, n int, core boolean").groupBy("a", "b", "many").agg(
        F.count(F.lit(1)).alias("columns"), F.max("n").alias("n"), F.max("core").alias("core"))


def _hot(found: DataFrame) -> DataFrame:
    """(gram, code, n, core): the incidences in columns with many rows."""
    return found.where("many").select(F.col("a").alias("gram"), F.col("b").alias("code"), "n", "core")


def _common(like: Similarity, n: str) -> Column:
    """``Similarity.common`` of a column of sizes."""
    return F.expr(f"least(1 + ({n}) div 32, (({n}) * {like.num}L + {like.den - 1}) div {like.den})")


def _candidates(found: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the pairs that may link, and (code, family) of the sets of which any two of a family may.
    ``found``: what ``_column_pairs`` makes of all incidences.

    Two sets that link meet in as many columns as ``like.common`` says. If one of these has few rows,
    they are a pair, and the others are at most the columns with many rows that either of them has. If
    none has, each of them has so many columns with many rows, and stays in these in every round.
    """
    hot, few = _hot(found), found.where("NOT many").drop("core")
    slack = written(hot.groupBy("code").agg(F.count(F.lit(1)).alias("slack")))
    enough = F.col("columns") >= _common(like, "n")
    lifted = (
        few.where(~enough)
        .join(slack.select(F.col("code").alias("a"), F.col("slack").alias("of_a")), "a")
        .join(slack.select(F.col("code").alias("b"), F.col("slack").alias("of_b")), "b")
        .where(F.col("columns") + F.least("of_a", "of_b") >= _common(like, "n"))
    )
    least_partner = f"(n * {like.num}L + {like.den - 1}) div {like.den}"
    late = []
    for _ in range(ROUNDS):
        own = hot.groupBy("code").agg(F.count(F.lit(1)).alias("columns"), F.max("n").alias("n"))
        able = written(own.where(F.col("columns") >= _common(like, least_partner)).select("code"))
        again = written(_column_pairs(hot.join(able, "code", "left_semi"), like))
        late.append(again.where("NOT many").select("a", "b", "columns", "n"))
        hot = _hot(again)
    met = reduce(DataFrame.unionByName, late).groupBy("a", "b").agg(
        F.sum("columns").alias("columns"), F.max("n").alias("n")).where(enough)
    first = hot.groupBy("gram").agg(F.min("code").alias("a"))
    family = written(
        components(hot.join(first, "gram").select("a", F.col("code").alias("b")))
        .select(F.col("node").alias("code"), F.col("component").alias("family"))
    )
    pairs = (
        few.where(enough).select("a", "b").unionByName(lifted.select("a", "b"))
        .unionByName(met.select("a", "b")).distinct()
        .join(family.select(F.col("code").alias("a"), F.col("family").alias("fa")), "a", "left")
        .join(family.select(F.col("code").alias("b"), F.col("family").alias("fb")), "b", "left")
        .where("NOT (fa <=> fb) OR fa IS NULL").select("a", "b")
    )
    return written(pairs), family


def _sets(texts: DataFrame, codes: DataFrame, like: Similarity) -> DataFrame:
    """(code, n, grams) of the wanted sets. A bitmap spares most others the shuffle; the join
    decides."""
    shared = texts.sparkSession.sparkContext.broadcast(membership_bitmap(codes, "code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for _, data, offsets in slices(batches):
            found = []
            for grams in gram_sets(data, offsets, like.width):
                code = set_code(grams)
                if len(grams) and code not in seen and maybe_in(bits, np.array([code]))[0]:
                    seen.add(code)
                    found.append((code, len(grams), grams.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))],
                    ["code", "n", "grams"])

    sets = texts.select("text").mapInArrow(run, "code long, n int, grams binary")
    return sets.join(codes, "code", "left_semi").dropDuplicates(["code"])


def _pair_links(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Those of the candidate pairs (a, b) that link, by counting their overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                overlap = int((large[at] == small).sum())
                linked.append(like.den * overlap >= like.num * (len(x) + len(y) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("code").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("code").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(
    codes: list[np.ndarray], sets: list[list[np.ndarray]], like: Similarity
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the linking pairs of two blocks, or within one if only one is given.

    Overlaps are accumulated over slices of the columns; a slice whose rest can lift no pair to
    its bound ends the product.
    """
    rows, cols = sets[0], sets[-1]
    same = len(sets) == 1
    n_rows = np.array([len(s) for s in rows], np.int64)
    n_cols = np.array([len(s) for s in cols], np.int64)
    needed = like.needed(n_rows[:, None], n_cols[None, :])
    possible = (like.den * np.minimum(n_rows[:, None], n_cols) >= like.num * np.maximum(n_rows[:, None], n_cols))
    if same:
        possible &= np.triu(np.ones(possible.shape, bool), 1)
    all_r, all_c = np.concatenate(rows), np.concatenate(cols)
    owner_r, owner_c = np.repeat(np.arange(len(rows)), n_rows), np.repeat(np.arange(len(cols)), n_cols)
    shared, count = np.unique(all_r, return_counts=True) if same else (np.intersect1d(all_r, all_c), None)
    if same:
        shared = shared[count > 1]

    def places(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(shared):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(shared, grams)
        at[at == len(shared)] = 0
        hit = shared[at] == grams
        return at[hit], owner[hit]

    at_r, own_r = places(all_r, owner_r)
    at_c, own_c = (at_r, own_r) if same else places(all_c, owner_c)
    left_r, left_c = np.bincount(own_r, minlength=len(rows)), np.bincount(own_c, minlength=len(cols))
    overlap = np.zeros(possible.shape, np.float32)
    for start in range(0, len(shared), BLOCK_COLUMNS):
        part = []
        for at, own, n, left in ((at_r, own_r, len(rows), left_r), (at_c, own_c, len(cols), left_c)):
            inside = (at >= start) & (at < start + BLOCK_COLUMNS)
            dense = np.zeros((n, BLOCK_COLUMNS), np.float32)
            dense[own[inside], at[inside] - start] = 1
            part.append(dense)
            left -= np.bincount(own[inside], minlength=n)
        overlap += part[0] @ part[1].T
        possible &= overlap + np.minimum(left_r[:, None], left_c) >= needed
        if not possible.any():
            break
    return np.nonzero(possible & (overlap >= needed))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that hold the same nodes together as all the given ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _family_links(members: DataFrame, like: Similarity) -> DataFrame:
    """Links (a, b) that span the components within each family, and per set its number of links
    (a, null, links). ``members``: (family, code, n, grams).

    A family is cut by size class, a factor of the threshold wide, so that linking sets lie in
    the same or neighbouring classes, and each class by hash into blocks; two blocks meet in one
    task.
    """
    step = math.log(like.den / like.num) if like.num < like.den else math.log(2)
    placed = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    blocks = placed.groupBy("family", "class").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")
    )
    above = blocks.select("family", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = blocks.select("family", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    around = blocks.join(above, ["family", "class"], "left").join(below, ["family", "class"], "left")
    mine = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    sized = placed.join(around, ["family", "class"]).withColumn("mine", mine)

    def meeting(low_class, low, high_class, high, side):
        return F.struct(low_class.alias("c1"), low.alias("b1"), high_class.alias("c2"),
                        high.alias("b2"), F.lit(side).alias("side"))

    c, m = F.col("class"), F.col("mine")

    def numbers(name: str):
        return F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(name), F.lit(0)) - 1, F.lit(0)))

    def all_of(name: str, make):
        return F.when(F.col(name) > 0, F.transform(numbers(name), make)).otherwise(F.array().cast(
            "array<struct<c1:int,b1:int,c2:int,b2:int,side:int>>"))

    meetings = F.concat(
        F.transform(numbers("blocks"), lambda k: F.when(k >= m, meeting(c, m, c, k, 0)).otherwise(
            meeting(c, k, c, m, 1))),
        all_of("above", lambda k: meeting(c, m, c + 1, k, 0)),
        all_of("below", lambda k: meeting(c - 1, k, c, m, 1)),
    )
    dealt = sized.select("family", "code", "grams", F.explode(meetings).alias("at")).select(
        "family", "at.*", "code", "grams"
    )

    def product(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, c1, b1, c2, b2 = (k.as_py() for k in key)
        codes, sets = [], []
        for side in (0, 1):
            own = table.filter(pc.equal(table.column("side"), side))
            codes.append(own.column("code").to_numpy())
            sets.append([np.frombuffer(g.as_buffer(), np.uint64) for g in own.column("grams")])
        same = (c1, b1) == (c2, b2)
        empty = not len(codes[0]) or not (same or len(codes[1]))
        if empty:
            rows = cols = np.empty(0, np.int64)
        else:
            rows, cols = block_links(codes, sets[:1] if same else sets, like)
        a, b = codes[0][rows], codes[0 if same else 1][cols]
        links, number = np.unique(np.concatenate([a, b]), return_counts=True)
        forest = _forest(a, b)
        return pa.table({
            "a": pa.array([x for x, _ in forest] + links.tolist(), pa.int64()),
            "b": pa.array([y for _, y in forest] + [None] * len(links), pa.int64()),
            "links": pa.array([None] * len(forest) + number.tolist(), pa.int64()),
        })

    keys = ["family", "c1", "b1", "c2", "b2"]
    return dealt.groupBy(*keys).applyInArrow(product, "a long, b long, links long")


def jaccard_components(
    documents: DataFrame,
    like: Similarity | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` (size of its set), ``component_id`` (smallest id
    reachable by links, itself included) and ``n_links`` (different sets that its set links with).

    Null, empty and blank texts have an empty set, link with nothing and are their own component,
    also if several rows share the id. A null id gives a null component unless a linked row has
    an id. Repeated rows are equal sets and so one component. An empty table gives an empty
    result; other columns are not read. Sets and shingles are told apart by 64-bit hashes.
    """
    like = like or Similarity()
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    survey = written(_survey(texts, like))
    docs = survey.where("chunk IS NULL").select("id", "code", "n")
    counts = _column_counts(survey)
    found = written(_column_pairs(_incidences(texts, counts, like), like))
    pairs, family = _candidates(found, like)
    wanted = (
        pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code")))
        .unionByName(family.select("code")).distinct()
    )
    wanted = written(wanted)
    sets = written(_sets(texts, wanted, like))
    members = sets.join(family, "code")
    linked = written(
        _family_links(members, like).unionByName(
            _pair_links(pairs, sets, like).withColumn("links", F.lit(0).cast("long"))
        )
    )
    component = components(linked.where("b IS NOT NULL").select("a", "b"))
    single = linked.where("b IS NOT NULL AND links = 0")
    links = (
        linked.where("b IS NULL").select(F.col("a").alias("code"), "links")
        .unionByName(single.select(F.col("a").alias("code"), F.lit(1).cast("long").alias("links")))
        .unionByName(single.select(F.col("b").alias("code"), F.lit(1).cast("long").alias("links")))
        .groupBy("code").agg(F.sum("links").alias("n_links"))
    )
    least = docs.where("n > 0").groupBy("code").agg(F.min("id").alias("least"))
    reached = component.withColumnRenamed("node", "code").join(least, "code")
    smallest = reached.groupBy("component").agg(F.min("least").alias("smallest"))
    of_set = least.join(
        reached.join(smallest, "component").select("code", "smallest").join(links, "code"),
        "code", "left",
    )
    # Written, so that the documents' side, in which a set may hold most rows, can be split.
    return docs.join(written(of_set), "code", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("smallest", "least")).otherwise(F.col("id"))
        .alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def one_per_component(documents: DataFrame, like: Similarity, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` without near duplicates: of each component only the document with
    the smallest id stays. Rows that share an id are one document, of which one row stays; rows
    without an id can't be named and stay."""
    found = jaccard_components(documents, like, id_col=id_col, text_col=text_col)
    first = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = documents.join(first, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(documents.columns).unionByName(documents.where(F.col(id_col).isNull()))
