from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rows import dicts
from flowgauge.functions import stats
from flowgauge.functions import quantiles
from flowgauge.functions.quantiles import exact_quantiles


def closed_form_p(t: float, df: int) -> float:
    """Abramowitz & Stegun 26.7.3 and 26.7.4: P(|T| >= t) for whole degrees of freedom."""
    angle = math.atan(abs(t) / math.sqrt(df))
    sin, cos = math.sin(angle), math.cos(angle)
    if df % 2:
        term, total = cos, (cos if df > 1 else 0.0)
        for k in range(3, df - 1, 2):
            term *= cos * cos * (k - 1) / k
            total += term
        return 1 - 2 / math.pi * (angle + sin * total)
    term = total = 1.0
    for k in range(2, df - 1, 2):
        term *= cos * cos * (k - 1) / k
        total += term
    return 1 - sin * total


def p_values(spark, pairs):
    """By the columns that the analyses use, in one query."""
    df = spark.createDataFrame([(float(t), n) for t, n in pairs], "t DOUBLE, df BIGINT")
    return [r.p for r in df.select(stats.p_value(F.col("t"), F.col("df")).alias("p")).collect()]


def test_p_value_matches_closed_form(spark):
    draw = random.Random(7)
    pairs = [(draw.uniform(0, 6), draw.randint(1, 400)) for _ in range(400)]
    pairs += [(t, df) for t in (1e-9, 1e-3, 1.0, 1.9) for df in (1, 2, 3, 4, 5, 10, 400, 9999)]
    for (t, df), p in zip(pairs, p_values(spark, pairs), strict=True):
        assert p == pytest.approx(closed_form_p(t, df), abs=1e-12), (t, df)


def test_p_value_known_points(spark):
    p = p_values(spark, [(2.228, 10), (0.0, 5), (-2.0, 8), (12.706, 1)])
    assert p == pytest.approx([0.05, 1.0, 0.08052, 0.05], abs=2e-5)


def test_small_p_values_keep_their_size(spark):
    p = p_values(spark, [(40.0, 30), (400.0, 30)])
    assert 0 < p[1] < p[0] < 1e-25


def test_p_value_of_many_periods(spark):
    # Near the normal distribution: 0.0455 beyond two deviations.
    assert p_values(spark, [(2.0, 1_000_000)]) == pytest.approx([0.0455], abs=1e-4)


def test_p_value_of_missing_is_missing(spark):
    df = spark.createDataFrame([(None, 5), (1.0, None), (1.0, 0)], "t DOUBLE, df BIGINT")
    assert [r.p for r in df.select(stats.p_value(F.col("t"), F.col("df")).alias("p")).collect()] == [None] * 3


def test_pearson_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x DOUBLE, y DOUBLE")
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None


@pytest.mark.parametrize("values", [
    [5.0],
    [1.0, 2.0],
    [0.0, -0.0, -1.5, -1e9, 1e9, 3.0],
    [7.0] * 50 + [1.0],
    [1000 + i * 1e-9 for i in range(500)],
    [float(10 ** (i % 12)) * (-1) ** i for i in range(200)],
    [1.0] * 3 + [5 + i * 1e-13 for i in range(400)] + [1e15, -1e15, 2e15],
    list(np.random.default_rng(1).lognormal(8, 3, 3000).tolist()),
    list(np.random.default_rng(2).normal(0, 1, 3001).tolist()),
])
def test_exact_quantiles(spark, values):
    probabilities = [0.0, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    row = exact_quantiles(df, F.col("v"), probabilities).first()
    assert list(row) == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


def test_exact_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,)], "v DOUBLE")
    assert exact_quantiles(df, F.col("v"), [0.5]).first()[0] is None


def test_quantile_outside_its_bracket_is_still_exact(spark, monkeypatch):
    """With a poor sketch ranks lie outside; then the whole column is the bracket."""
    monkeypatch.setattr(quantiles, "_ACCURACY", 2)
    values = np.random.default_rng(5).normal(0, 1, 4000)
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").repartition(8)
    row = exact_quantiles(df, F.col("v"), [0.1, 0.5, 0.77]).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.77])), rel=1e-12)


def test_labels(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (0.1,), (None,)], "v DOUBLE")
    label = stats.label_above(F.col("v"), stats.CORRELATION_STRENGTH, "Very Weak")
    assert [r["x"] for r in dicts(df.select(label.alias("x")))] == [
        "Very Strong", "Strong", "Very Weak", None
    ]
