"""Report tables and one-line texts of the single detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksight.functions.numeric import fixed_text, round_scaled

# Columns of the reports and the unit mark of amounts.
COST_REPORT = [
    "project_id",
    "category",
    "estimated_cost_lakh",
    "sanctioned_amount_lakh",
    "expenditure_lakh",
    "sanction_overrun_pct",
    "estimate_deviation_pct",
    "cost_anomaly",
]
DELAY_REPORT = [
    "project_id",
    "current_status",
    "planned_duration_days",
    "elapsed_days",
    "delay_days",
    "delay_pct",
    "delay_anomaly",
]
SPENDING_REPORT = [
    "project_id",
    "category",
    "expenditure_lakh",
    "category_avg_expenditure_lakh",
    "category_std_expenditure_lakh",
    "spending_zscore",
    "spending_anomaly",
]


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """All floating-point columns rounded for display."""
    return df.select(
        *(
            round_scaled(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType | T.FloatType)
            else F.col(f.name)
            for f in df.schema
        )
    )


def _shown(value: Column | str, digits: int | None = None) -> Column:
    """Text of a value; a missing one reads ``nan``."""
    if digits is None:
        return F.coalesce(F.col(value).cast("string"), F.lit("nan"))
    return F.coalesce(fixed_text(F.col(value).cast("double"), digits), F.lit("nan"))


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("line")


def cost_lines(costs: DataFrame) -> DataFrame:
    """One text per flagged project."""
    return costs.where("cost_anomaly").select(
        "project_id",
        _line(
            _shown("project_id"), " | ", _shown("category"),
            " | Expenditure: ₹", _shown("expenditure_lakh", 2),
            "L | Sanction overrun: ", _shown("sanction_overrun_pct", 1),
            "% | Estimate deviation: ", _shown("estimate_deviation_pct", 1), "%",
        ),
    )


def delay_lines(delays: DataFrame) -> DataFrame:
    return delays.where("delay_anomaly").select(
        "project_id",
        _line(
            _shown("project_id"), " | Status: ", _shown("current_status"),
            " | Delay: ", _shown("delay_days", 0),
            " days | Delay: ", _shown("delay_pct", 1), "%",
        ),
    )


def spending_lines(spending: DataFrame) -> DataFrame:
    return spending.where("spending_anomaly").select(
        "project_id",
        _line(
            _shown("project_id"), " | ", _shown("category"),
            " | Expenditure: ₹", _shown("expenditure_lakh", 2),
            "L | Category average: ₹", _shown("category_avg_expenditure_lakh", 2),
            "L | Z-score: ", _shown("spending_zscore", 2),
        ),
    )
