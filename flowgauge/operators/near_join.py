"""Joins on days that lie near each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], days: tuple[str, str],
    before: int = 0, after: int = 0, *, extra: Column | None = None, how: str = "inner",
) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` that have equal keys (pairs of names in ``on``) and a
    day from ``before`` days before the left one to ``after`` days after it; ``extra`` is a further
    condition over both sides. ``how`` is inner or left_semi. The names of both sides must differ.

    Time is cut into bins as long as the window, so that a window touches two bins at most. One
    side's rows are sent to the bins of their windows, the other's to their own bin, and keys and bin
    are joined as equal; the exact days decide among what meets. So no row meets a whole key's
    history, a key with most of the rows is spread over its bins, and every pair is found once. The
    copies are those of the left side in an inner join, of the right side in a semi join, where a
    left row must stay one row. Null keys and days match nothing.
    """
    if before < 0 or after < 0:
        raise ValueError("a window can't be shorter than its day")
    if how not in ("inner", "left_semi"):
        raise ValueError(f"unknown join '{how}'; use inner or left_semi")
    if shared := sorted(set(left.columns) & set(right.columns)):
        raise ValueError(f"both sides have columns named {', '.join(shared)}")
    width = before + after + 1
    here, there = (F.unix_date(F.to_date(d)) for d in days)

    def touched(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))

    near = (F.col("__left_bin") == F.col("__right_bin")) & there.between(here - before, here + after)
    for a, b in on:
        near = near & (F.col(a) == F.col(b))
    if extra is not None:
        near = near & extra
    if how == "inner":
        left = left.withColumn("__left_bin", touched(here - before, here + after))
        right = right.withColumn("__right_bin", F.floor(there / width))
    else:
        left = left.withColumn("__left_bin", F.floor(here / width))
        right = right.withColumn("__right_bin", touched(there - after, there + before))
    return left.join(right, near, how).drop("__left_bin", "__right_bin")
