"""Shape, first rows and numeric profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.numeric import no_nan, round_scaled
from worksight.sources.scratch import stored

# Profiled columns and quantiles.
PROFILE_COLUMNS = [
    "estimated_cost_lakh",
    "sanctioned_amount_lakh",
    "expenditure_lakh",
    "physical_progress_pct",
    "planned_duration_days",
    "elapsed_days",
]
# An approximate quantile may be off by one in so many ranks.
ACCURACY = 10_000
QUARTILES = {"25%": 0.25, "50%": 0.50, "75%": 0.75}


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns and the column names."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def head(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, x: every number of the columns, NaN as missing."""
    cells = [
        F.struct(F.lit(c).alias("metric"), no_nan(F.col(c)).cast("double").alias("x")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


def _facts(numbers: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """One row for each metric: moments, and ends that bracket each quantile.

    An approximate quantile is off by n / ACCURACY ranks at most, so the ends lie around
    the exact one, or one rank beside it in a small column.
    """
    margin = 2 / ACCURACY
    shares = [
        share for q in quantiles.values() for share in (max(0.0, q - margin), min(1.0, q + margin))
    ]
    x = F.col("x")
    return numbers.groupBy("metric").agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.percentile_approx(x, shares, ACCURACY).alias("ends"),
    )


def _counted(numbers: DataFrame, facts: DataFrame, n_quantiles: int) -> DataFrame:
    """metric, low, high, n: values inside a bracket one by one, all others by stretch.

    Tasks count before anything is sent, so a stretch between brackets is one row a task.
    """
    x = F.col("x")
    ends = [(F.get("ends", F.lit(2 * k)), F.get("ends", F.lit(2 * k + 1))) for k in range(n_quantiles)]
    inside, stretch = F.lit(False), F.lit(0)
    for low, high in ends:
        inside = inside | ((x >= low) & (x <= high))
        stretch = stretch + (x > high).cast("int")
    known = F.broadcast(facts.select("metric", "ends"))  # one row for each metric
    placed = numbers.where(x.isNotNull()).join(known, "metric")
    keys = [F.col("metric"), F.when(~inside, stretch).alias("stretch"), F.when(inside, x).alias("value")]
    counted = placed.groupBy(*keys).agg(
        F.min(x).alias("low"), F.max(x).alias("high"), F.count("*").alias("n")
    )
    return counted.select("metric", "low", "high", "n")


def _ranked(counted: DataFrame) -> DataFrame:
    """``counted`` with end, the rank behind each row's last value in its metric.

    Rows are dealt out by a range of values, and each part starts at the sum of the parts
    before it, so no task sees more than its share of a bracket.
    """
    dealt = counted.repartitionByRange("metric", "low").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "profile-counts")
    parts = dealt.groupBy("metric", "part").agg(F.sum("n").alias("in_part"))
    before = W.partitionBy("metric").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        "metric", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("start")
    )
    up_to = W.partitionBy("metric", "part").orderBy("low").rowsBetween(W.unboundedPreceding, 0)
    return dealt.withColumn("end", F.sum("n").over(up_to)).join(
        F.broadcast(starts), ["metric", "part"]  # one row for each metric and part
    ).select("metric", "low", "high", "n", (F.col("start") + F.col("end")).alias("end"))


def _quantiles(numbers: DataFrame, facts: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    wanted = [
        F.struct(F.lit(stat).alias("stat"), (F.lit(q) * (F.col("count") - 1)).alias("at"))
        for stat, q in quantiles.items()
    ]
    # one row for each metric and quantile
    asked = facts.select("metric", F.inline(F.array(*wanted)))
    ranked = _ranked(_counted(numbers, facts, len(quantiles)))
    met = ranked.join(F.broadcast(asked.where("at >= 0")), "metric")
    first = F.col("end") - F.col("n")

    def at_rank(rank: Column) -> Column:
        value = (
            F.when(F.col("low") == F.col("high"), F.col("low"))
            .when(rank == first, F.col("low"))
            .when(rank == F.col("end") - 1, F.col("high"))
            .otherwise(F.raise_error(F.lit("a quantile outside its bracket")).cast("double"))
        )
        return F.max(F.when((rank >= first) & (rank < F.col("end")), value))

    found = met.groupBy("metric", "stat", "at").agg(
        at_rank(F.floor("at")).alias("lower"), at_rank(F.ceil("at")).alias("upper")
    )
    share = F.col("at") - F.floor("at")
    return found.select(
        "metric", "stat", (F.col("lower") + (F.col("upper") - F.col("lower")) * share).alias("value")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles (linear between neighbours): metric, stat, value; none without numbers.

    Two scans. The first brackets each quantile by approximate ones; the second counts values
    inside a bracket one by one and all others by stretch, and ranks follow from the counts.
    Neither a shuffle nor a task holds a whole column, as the built-in ``percentile`` would.
    """
    numbers = _long(df, columns)
    facts = stored(_facts(numbers, quantiles), "profile-facts")
    return _quantiles(numbers, facts, quantiles)


def numeric_profile(
    df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS, digits: int = 2
) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per statistic, rounded.

    The moments come out of the scan that brackets the quartiles.
    """
    numbers = _long(df, columns)
    facts = stored(_facts(numbers, QUARTILES), "profile-facts")
    moments = [
        F.struct(F.lit(stat).alias("stat"), F.col(stat).cast("double").alias("value"))
        for stat in ("count", "mean", "std", "min", "max")
    ]
    long = facts.select("metric", F.inline(F.array(*moments))).unionByName(
        _quantiles(numbers, facts, QUARTILES)
    )
    wide = long.groupBy("stat").pivot("metric", list(columns)).agg(F.first("value"))
    return wide.select("stat", *(round_scaled(F.col(c), digits).alias(c) for c in columns))
