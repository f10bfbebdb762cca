"""Table layouts and the checks made on incoming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}


def _schema(columns: str) -> T.StructType:
    """StructType of ``name type, ...``, made without a Spark session."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# The columns of a project table and their order.
PROJECT_SCHEMA = _schema(
    """
    project_id string, mp_name string, state string, district string,
    category string, work_description string,
    estimated_cost_lakh double, sanctioned_amount_lakh double, expenditure_lakh double,
    physical_progress_pct double, planned_duration_days int, elapsed_days int,
    start_date date, expected_completion_date date, current_status string,
    latitude double, longitude double, implementing_agency string
    """
)
PAIR_SCHEMA = _schema(
    """
    project_1 string, project_2 string, category string, similarity_pct double,
    description_1 string, description_2 string
    """
)
SIGNAL_SCHEMA = _schema(
    """
    project_id string, max_similarity_pct double, similar_project_count long,
    duplicate_signal boolean
    """
)
SPENDING_COLUMNS = [
    "category_avg_expenditure_lakh",
    "category_std_expenditure_lakh",
    "spending_zscore",
    "spending_anomaly",
]
SPENDING_SCHEMA = _schema(
    """
    project_id string, category_avg_expenditure_lakh double,
    category_std_expenditure_lakh double, spending_zscore double,
    spending_anomaly boolean
    """
)

# What scoring cannot do without.
SCORING_COLUMNS = [
    "project_id",
    "category",
    "estimated_cost_lakh",
    "sanctioned_amount_lakh",
    "expenditure_lakh",
    "planned_duration_days",
    "elapsed_days",
    "current_status",
]

# Derived columns of the risk table, behind the input columns.
RISK_COLUMNS = [
    "sanction_overrun_pct",
    "delay_days",
    "delay_pct",
    "max_similarity_pct",
    "similar_project_count",
    "duplicate_signal",
    *SPENDING_COLUMNS,
    "cost_score",
    "delay_score",
    "duplicate_score",
    "spending_score",
    "risk_score",
    "risk_level",
    "risk_reasons",
]


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """The frame itself, or a ValueError that names every missing column."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    )
