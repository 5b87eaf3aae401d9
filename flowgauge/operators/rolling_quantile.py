"""Quantiles of a sliding window, from an ordered list that is carried along the rows."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions that run in tasks travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class SlidingQuantile:
    """The values of a window in order of time and in order of size. A row enters and the ones that
    fall out of the frame leave, each by a search; nothing is sorted anew."""

    def __init__(self, days: int, share: float, by_rows: bool, include_current: bool, needed: int):
        self.days, self.share, self.by_rows = days, share, by_rows
        self.include_current, self.needed = include_current, needed
        self.window: deque[tuple[int, float]] = deque()
        self.ordered: list[float] = []

    def restart(self) -> None:
        self.window.clear()
        self.ordered.clear()

    def of(self, day: int, value: float) -> float | None:
        """The quantile for the next row, by linear interpolation; None while the window holds too
        few rows."""
        if self.include_current:
            self._enter(day, value)
        self._leave(day)
        found = self._quantile()
        if not self.include_current:
            self._enter(day, value)
        return found

    def _enter(self, day: int, value: float) -> None:
        self.window.append((day, value))
        insort(self.ordered, value)

    def _leave(self, day: int) -> None:
        first = day - self.days + (1 if self.include_current else 0)
        while self.window and (
            len(self.window) > self.days if self.by_rows else self.window[0][0] < first
        ):
            _, value = self.window.popleft()
            del self.ordered[bisect_left(self.ordered, value)]

    def _quantile(self) -> float | None:
        n = len(self.ordered)
        if n < self.needed or not n:
            return None
        place = self.share * (n - 1)
        low = min(int(place), n - 1)
        high = min(low + 1, n - 1)
        return self.ordered[low] + (self.ordered[high] - self.ordered[low]) * (place - low)


def with_rolling_quantile(
    daily: DataFrame, keys: Sequence[str], name: str, *, days: int, share: float,
    frame: str, include_current: bool, needed: int,
) -> DataFrame:
    """``daily`` (keys, day, quantity: one row per entity and day, no nulls) with the quantile
    ``name``, null until the window holds ``needed`` rows. Entities are dealt out whole and read in
    order of days, one window in memory at a time."""
    if days < 1:
        raise ValueError("the window must span at least one day")
    if frame not in ("rows", "days"):
        raise ValueError(f"unknown frame '{frame}'; use rows or days")
    keys, by_rows = list(keys), frame == "rows"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliding = SlidingQuantile(days, share, by_rows, include_current, needed)
        entity: tuple | None = None
        for batch in batches:
            entities = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            numbers = batch.column("day").cast(pa.int32()).to_pylist()
            found = []
            for own, day, value in zip(entities, numbers, batch.column("quantity").to_pylist(), strict=True):
                if own != entity:
                    sliding.restart()
                    entity = own
                found.append(sliding.of(day, value))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    ordered = daily.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "day")
    return ordered.mapInArrow(run, T.StructType([*daily.schema.fields]).add(name, "double"))
