"""Sketches of distinct values, which can be merged: kept per day, rolled up to longer periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registers of a sketch: 2 ** LOG_REGISTERS, of 4 KB at most.
LOG_REGISTERS = 12


def relative_error(log_registers: int = LOG_REGISTERS) -> float:
    """Standard error of an estimate. Counts up to some hundreds are exact but for equal hashes."""
    return 1.04 / 2 ** (log_registers / 2)


def distinct_sketch(column: Column) -> Column:
    """Sketch of the distinct values. The aggregate skips input of no bytes, while the empty string is
    a value as in exact counts: it goes in as a byte that no UTF-8 text holds."""
    text = column.cast("string")
    empty = F.when(text == "", F.lit(b"\xff"))
    return F.hll_sketch_agg(empty.otherwise(text.cast("binary")), LOG_REGISTERS)
