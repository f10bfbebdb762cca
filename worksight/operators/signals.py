"""Cost, delay and spending signals of single projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.config import DEFAULT, ScreeningConfig
from worksight.functions.numeric import is_true, no_nan, ratio_pct
from worksight.operators.keyed_join import attach
from worksight.sources.schema import SPENDING_COLUMNS, require_columns


def _number(name: str) -> Column:
    return no_nan(F.col(name))


def overrun_pct() -> Column:
    spent, sanctioned = _number("expenditure_lakh"), _number("sanctioned_amount_lakh")
    return ratio_pct(spent - sanctioned, sanctioned)


def estimate_deviation_pct() -> Column:
    spent, estimated = _number("expenditure_lakh"), _number("estimated_cost_lakh")
    return ratio_pct(spent - estimated, estimated)


def delay_days() -> Column:
    return F.col("elapsed_days") - F.col("planned_duration_days")


def delay_pct() -> Column:
    return ratio_pct(delay_days(), F.col("planned_duration_days"))


def with_cost_signal(projects: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    return projects.withColumns(
        {
            "sanction_overrun_pct": overrun_pct(),
            "estimate_deviation_pct": estimate_deviation_pct(),
        }
    ).withColumn(
        "cost_anomaly",
        is_true(F.col("sanction_overrun_pct") > config.overrun_flag_pct)
        | is_true(F.col("estimate_deviation_pct") > config.estimate_flag_pct),
    )


def with_delay_signal(projects: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    return projects.withColumns(
        {"delay_days": delay_days(), "delay_pct": delay_pct()}
    ).withColumn(
        "delay_anomaly",
        is_true(F.col("delay_pct") > config.delay_flag_pct)
        | is_true(F.lower("current_status") == config.delayed_status),
    )


def category_spending(projects: DataFrame) -> DataFrame:
    """Mean and sample deviation of spending, one row per category.

    Partial sums leave each task, never the rows, so a category with a third of all
    projects costs its reducer one small row per task.
    """
    spent = _number("expenditure_lakh")
    return (
        projects.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.avg(spent).alias("category_avg_expenditure_lakh"),
            F.stddev_samp(spent).alias("category_std_expenditure_lakh"),
            F.count("*").alias("category_rows"),
        )
    )


def with_spending_signal(
    projects: DataFrame,
    config: ScreeningConfig = DEFAULT,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Category mean, deviation and z-score of spending beside each project.

    No category, one project or no variation give a missing z-score and no flag. Nothing
    runs while the plan is built: the few categories are grouped and joined back. For very
    many categories pass ``stats``, a stored ``category_spending``, whose hot categories
    are then spread.
    """
    require_columns(projects, ["project_id", "category", "expenditure_lakh"], "Table")
    mean = F.col("category_avg_expenditure_lakh")
    deviation = F.nullif(F.col("category_std_expenditure_lakh"), F.lit(0.0))
    z_score = (_number("expenditure_lakh") - mean) / deviation
    if stats is None:
        beside = projects.join(category_spending(projects), "category", "left")
    else:
        beside = attach(projects, stats, ["category"], "category_rows", spread_by="project_id")
    return (
        beside.withColumn("spending_zscore", z_score)
        .withColumn(
            "spending_anomaly", is_true(F.col("spending_zscore") >= config.zscore_flag)
        )
        .select(*projects.columns, *SPENDING_COLUMNS)
    )
