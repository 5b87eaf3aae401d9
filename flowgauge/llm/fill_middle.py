"""Fill-in-middle rows by rotating blocks in place.

The text lies in one bytearray as prefix, middle, suffix; a scan of the code points finds the cuts,
the sentinels are inserted there, and neighbouring segments change places by three reversals each.
Restoring finds the sentinels (a text that holds one stays plain, so they are the inserted ones),
runs the same rotations back and takes the sentinels out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import slices

#: Bytes that a reversal holds beside the buffer.
SCRATCH_BYTES = 1 << 16


@dataclass(frozen=True)
class FillMiddle:
    """``seed`` goes before the id in the hash that draws cuts and form; of 100 rows about
    ``plain_percent`` stay plain, and of the others ``spm_percent`` in 100 begin with the suffix."""

    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    seed: str = "1"
    plain_percent: int = 10
    spm_percent: int = 20

    def __post_init__(self) -> None:
        marks = self.marks
        if not all(m.isascii() and len(m) > 1 for m in marks):
            raise ValueError("marks are ASCII strings of two characters or more")
        # A mark must begin where its first character stands and nowhere else, or a text that
        # ends in the beginning of a mark could be read wrongly.
        if len(set(marks)) < 3 or any(set(m[1:]) & {n[0] for n in marks} for m in marks):
            raise ValueError("a mark's first character may not occur inside any mark")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.middle_mark, self.suffix_mark


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverse buffer[start:end] in place, by exchanging blocks from both ends."""
    while end - start > 1:
        size = min(SCRATCH_BYTES, (end - start) // 2)
        left = buffer[start : start + size].copy()
        buffer[start : start + size] = buffer[end - size : end][::-1]
        buffer[end - size : end] = left[::-1]
        start, end = start + size, end - size


def exchange(buffer: np.ndarray, start: int, border: int, end: int) -> None:
    """Let [start:border] and [border:end] change places: reverse both, then the whole."""
    reverse(buffer, start, border)
    reverse(buffer, border, end)
    reverse(buffer, start, end)


def byte_cuts(data: np.ndarray, first: int, second: int) -> tuple[int, int]:
    """Where the code points number ``first`` and ``second`` begin, or the end of the bytes."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.append(begins, len(data))
    return int(at[first]), int(at[second])


def rearrange(text: bytes, first: int, second: int, form: str, how: FillMiddle) -> bytes:
    """The text with its middle (code points ``first`` to ``second``) at the end."""
    if form == "plain":
        return text
    a, b = byte_cuts(np.frombuffer(text, np.uint8), first, second)
    p, m, s = (mark.encode() for mark in how.marks)
    line = bytearray(text)
    line[b:b] = s
    line[a:a] = m
    line[0:0] = p
    a, b = a + len(p), b + len(p) + len(m)
    buffer = np.frombuffer(line, np.uint8)  # a view: what follows works within the bytearray
    exchange(buffer, a, b, len(line))  # prefix, suffix, middle
    if form == "spm":
        exchange(buffer, 0, a, a + len(line) - b)
    return bytes(line)


def restore(output: bytes, form: str, how: FillMiddle) -> bytes:
    """The text that ``rearrange`` began with, from its output and form alone."""
    if form == "plain":
        return output
    p, m, s = (mark.encode() for mark in how.marks)
    line = bytearray(output)
    middle = line.index(m)
    if form == "spm":
        prefix = line.index(p)
        # The suffix stands first: exchange it with the prefix again.
        exchange(np.frombuffer(line, np.uint8), 0, prefix, middle)
        suffix = middle - prefix
    else:
        suffix = line.index(s)
    exchange(np.frombuffer(line, np.uint8), suffix, middle, len(line))
    tail = suffix + len(line) - middle  # prefix, middle, suffix: the suffix mark stands here
    del line[tail : tail + len(s)]
    del line[suffix : suffix + len(m)]
    del line[: len(p)]
    return bytes(line)


def _draw(digest: Column, group: int) -> Column:
    """An 8-digit group of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_middle(
    documents: DataFrame, how: FillMiddle | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n (code points), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output.

    Cuts and form come from the hash of seed and id, so repeated rows are treated alike and a lost
    task gives the same rows again. A null id is hashed as an empty one. Null and empty texts are
    plain and empty, as are texts that hold a mark. Texts are never cut short; a task holds about a
    megabyte of texts, or one longer text, three times over. An empty table gives an empty result; other columns are
    not read. No shuffle.
    """
    how = how or FillMiddle()
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = documents.select(F.col(id_col).alias("id"), text.alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    units = F.char_length("text").cast("long")
    cuts = read.withColumn("digest", digest).select(
        "id", "text", units.alias("n"),
        *(F.pmod(_draw(F.col("digest"), g), units + 1).alias(f"cut{g}") for g in (0, 1)),
        *((_draw(F.col("digest"), g) % 100).alias(f"percent{g}") for g in (2, 3)),
    )
    holds_mark = F.greatest(*(F.contains("text", F.lit(mark)) for mark in how.marks))
    form = (
        F.when((F.col("n") == 0) | holds_mark | (F.col("percent2") >= 100 - how.plain_percent), "plain")
        .when(F.col("percent3") < how.spm_percent, "spm").otherwise("psm")
    )
    planned = cuts.select(
        "id", "n", form.alias("form"), F.least("cut0", "cut1").alias("first"),
        F.greatest("cut0", "cut1").alias("second"), "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            forms = batch.column("form").to_pylist()
            first, second = (batch.column(c).to_pylist() for c in ("first", "second"))
            out = [
                rearrange(data[offsets[k] : offsets[k + 1]].tobytes(), first[k], second[k], forms[k], how)
                for k in range(batch.num_rows)
            ]
            kept = [batch.column(c) for c in ("id", "n", "form", "first", "second")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(out, pa.binary()).cast(pa.string())],
                ["id", "n", "form", "first", "second", "output"])

    kind = read.schema["id"].dataType.simpleString()
    made = planned.mapInArrow(run, f"id {kind}, n long, form string, first long, second long, output string")
    shaped = F.col("form") != "plain"
    return made.select(
        F.col("id").alias(id_col), "n", "form", F.when(shaped, F.col("first")).alias("prefix_chars"),
        F.when(shaped, F.col("second") - F.col("first")).alias("middle_chars"), "output",
    )


def restore_texts(rows: DataFrame, how: FillMiddle | None = None) -> DataFrame:
    """``rows`` (with the columns output and form) and ``restored``, the text that each output was
    made from. Needs nothing else of the row. A null output or form is an empty or plain one."""
    how = how or FillMiddle()
    if "restored" in rows.columns:
        raise ValueError("rows already have a column 'restored'")
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "output"):
            forms = batch.column("form").to_pylist()
            out = [
                restore(data[offsets[k] : offsets[k + 1]].tobytes(), forms[k] or "plain", how)
                for k in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], [*fields.names, "restored"])

    return rows.mapInArrow(run, type(fields)([*fields.fields]).add("restored", "string"))
