import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.functions import numeric as N
from worksight.functions.display import bar_width, number_text, percent_text

TIES = [0.625, 2.675, 1.005, 1.25, 0.15, 0.125, 2.5, 0.005, 1.015, 99.995, 0.35, 4.35]


def _values():
    rng = random.Random(7)
    values = TIES + [-x for x in TIES] + [0.0, 1e-9, 1e9 + 0.125, 123456.785]
    values += [rng.randint(0, 10**6) / 1000 for _ in range(1500)]
    values += [rng.uniform(-500, 500) for _ in range(1500)]
    values += [rng.randint(-800, 800) / 16 for _ in range(500)]
    return values


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(x,) for x in _values()], "x double")


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_rounding_agrees_with_python_and_numpy(numbers, digits):
    x = F.col("x")
    rows = numbers.select(
        "x",
        N.round_exact(x, digits).alias("exact"),
        N.round_scaled(x, digits).alias("scaled"),
        N.fixed_text(x, digits).alias("text"),
        number_text(x, digits).alias("away"),
    ).collect()
    for row in rows:
        assert row.exact == round(row.x, digits), row
        assert row.scaled == float(np.round(row.x, digits)), row
        assert row.text == f"{row.x:.{digits}f}", row
        step = Decimal(1).scaleb(-digits)
        away = Decimal(row.x).quantize(step, rounding=ROUND_HALF_UP)
        sign = "-" if row.x < 0 else ""
        assert row.away == sign + str(abs(away)), row


def test_texts_of_special_values(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (None,), (math.nan,)], "x double")
    x = F.col("x")
    rows = df.select(
        N.fixed_text(N.no_nan(x), 1), number_text(x), percent_text(x), bar_width(x)
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("inf", "Infinity", "Infinity%", 100.0),
        ("-inf", "-Infinity", "-Infinity%", 0.0),
        (None, "-", "-", 0.0),
        (None, "-", "-", 0.0),
    ]


def test_ratio_over_zero(spark):
    df = spark.createDataFrame(
        [(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0), (1.0, None)],
        "part double, whole double",
    )
    values = [r[0] for r in df.select(N.ratio_pct(F.col("part"), F.col("whole"))).collect()]
    assert values == [math.inf, -math.inf, None, 25.0, None, None]


def test_linear_score(spark):
    values = [None, -1.0, 0.0, 0.005, 1.25, 30.0, 59.99, 60.0, math.inf]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    scores = [r[0] for r in df.select(N.linear_score(F.col("x"), 60, 30)).collect()]
    assert scores == [0, 0, 0, 0, 0.62, 15.0, round(59.99 / 60 * 30, 2), 30.0, 30.0]
    similar = [(x,) for x in (0.0, 79.99, 80.0, 86.58, 90.0, 99.99, 100.0)]
    df = spark.createDataFrame(similar, "x double")
    scores = [r[0] for r in df.select(N.linear_score(F.col("x"), 100, 20, 80)).collect()]
    assert scores == [0, 0, 0, 6.58, 10.0, 19.99, 20.0]
