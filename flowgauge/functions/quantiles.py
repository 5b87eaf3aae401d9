"""Exact quantiles of a column that may hold any number of distinct values.

Spark's ``median`` / ``percentile`` keep every distinct value of a group in one object. Here a
sketch (``percentile_approx``, combined on the map side) brackets each wanted rank, the rows below
and inside the bracket are counted, and only the values inside are shuffled and put in order. If a
rank should lie outside its bracket, the bracket is the whole column: nothing is approximated, the
sketch only says where to look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch; a bracket reaches two of its rank errors to both sides.
_ACCURACY = 10_000
# Equal-width slices of a bracket.
_SLICES = 4096


def exact_quantiles(
    rows: DataFrame, value: Column, probabilities: list[float], *, mean: bool = False
) -> DataFrame:
    """One row with columns ``q0``, ``q1``, ...: the linearly interpolated quantiles of the
    non-null values; all null when there is no value. ``mean`` adds their mean, which the first pass
    yields as well."""
    values = rows.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    sketch = _sketch(values, probabilities)
    brackets = _brackets(values, sketch, probabilities)
    # The brackets are one row, whatever the column holds.
    held = F.filter("brackets", lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"]))
    inside = values.withColumn("brackets", brackets.select("brackets").scalar()).select(
        "v", F.explode(held).alias("b")
    )
    counts = inside.groupBy("b.i", "v").agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b"))
    sliced = counts.withColumn("slice", _slice(F.col("v"), F.col("b.low"), F.col("b.high")))
    slices = _ranked(
        sliced.groupBy("i", "slice").agg(F.sum("n").alias("n"), F.first("b").alias("b")),
        Window.partitionBy("i").orderBy("slice"), F.col("b.below"),
    )
    found = _hit(slices).select("i", "slice", F.col("first").alias("base"))
    ranked = _ranked(
        sliced.join(found, ["i", "slice"]), Window.partitionBy("i", "slice").orderBy("v"), F.col("base")
    )
    hits = _hit(ranked).select(
        "i", "v", F.explode("ranks").alias("rank"), F.col("b.ranks").alias("wanted"),
        F.col("b.weight").alias("weight"),
    )
    found = hits.agg(*[_interpolated(i).alias(f"q{i}") for i in range(len(probabilities))])
    # The same subquery as for the brackets, so it runs once.
    return found.withColumn("mean", sketch.scalar()["mean"]) if mean else found


def _sketch(values: DataFrame, probabilities: list[float]) -> DataFrame:
    """One row and column, from one pass: bracket edges, smallest and largest value, mean."""
    margin = 2 / _ACCURACY
    edges = [min(max(p + side * margin, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    return values.agg(
        F.percentile_approx("v", F.array(*map(F.lit, edges)), _ACCURACY).alias("edges"),
        F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"),
    ).select(F.struct("*"))


def _brackets(values: DataFrame, sketch: DataFrame, probabilities: list[float]) -> DataFrame:
    """One row: for each probability the bracket, the rows below it, the two neighbouring ranks
    (from 0) and how far the quantile lies between them."""
    measured = values.withColumn("sketch", sketch.scalar()).agg(
        F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch"),
        *[F.count_if(F.col("v") < F.col("sketch.edges")[2 * i]).alias(f"below{i}")
          for i in range(len(probabilities))],
        *[F.count_if(F.col("v") <= F.col("sketch.edges")[2 * i + 1]).alias(f"upto{i}")
          for i in range(len(probabilities))],
    )
    items = []
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        sure = (F.col(f"below{i}") <= low) & (high < F.col(f"upto{i}"))
        items.append(F.struct(
            F.lit(i).alias("i"),
            F.when(sure, F.col("sketch.edges")[2 * i]).otherwise(F.col("sketch.least")).alias("low"),
            F.when(sure, F.col("sketch.edges")[2 * i + 1]).otherwise(F.col("sketch.most")).alias("high"),
            F.when(sure, F.col(f"below{i}")).otherwise(0).alias("below"),
            F.array(low, high).alias("ranks"),
            (position - low).alias("weight"),
        ))
    return measured.select(F.array(*items).alias("brackets"))


def _slice(v: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.floor((v - low) / (high - low) * _SLICES)).otherwise(0)


def _ranked(parts: DataFrame, window, base: Column) -> DataFrame:
    """Add the rank of the first value of each part."""
    before = F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("first", base + before)


def _hit(parts: DataFrame) -> DataFrame:
    """The parts that hold wanted ranks, each with those only."""
    end = F.col("first") + F.col("n")
    held = F.filter("b.ranks", lambda rank: (rank >= F.col("first")) & (rank < end))
    return parts.withColumn("ranks", held).where(F.size("ranks") > 0)


def _interpolated(i: int) -> Column:
    here = F.col("i") == i
    low = F.max(F.when(here & (F.col("rank") == F.col("wanted")[0]), F.col("v")))
    high = F.max(F.when(here & (F.col("rank") == F.col("wanted")[1]), F.col("v")))
    return low + (high - low) * F.max(F.when(here, F.col("weight")))
