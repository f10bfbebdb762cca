"""Read queries over the risk table: summary, lists, lookup and top reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.config import RISK_LEVELS
from worksight.sources.tables import CATEGORY_KEY, ID_KEY

MAX_LIMIT = 500


def _public(risk: DataFrame) -> DataFrame:
    return risk.drop(CATEGORY_KEY, ID_KEY)


def _category_key(risk: DataFrame) -> Column:
    """Lower-case category: the stored key where the table has one, else computed."""
    if CATEGORY_KEY in risk.columns:
        return F.col(CATEGORY_KEY)
    return F.lower("category")


def _id_key(risk: DataFrame) -> Column:
    return F.col(ID_KEY) if ID_KEY in risk.columns else F.upper("project_id")


def _checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def canonical_level(level: str) -> str:
    """The level's usual spelling, matched without regard to case."""
    by_lower = {known.lower(): known for known in RISK_LEVELS}
    if level.lower() not in by_lower:
        raise ValueError(f"unknown level {level!r}, use one of {RISK_LEVELS}")
    return by_lower[level.lower()]


def _highest_first(risk: DataFrame, limit: int) -> DataFrame:
    return risk.orderBy(F.desc_nulls_last("risk_score"), "project_id").limit(limit)


def projects(
    risk: DataFrame,
    risk_level: str | None = None,
    category: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Projects by falling score, filtered by level and category (any case)."""
    _checked_limit(limit)
    if risk_level:
        risk = risk.where(F.col("risk_level") == canonical_level(risk_level))
    if category:
        risk = risk.where(_category_key(risk) == category.lower())
    return _public(_highest_first(risk, limit))


def high_risk(risk: DataFrame, limit: int = 50) -> DataFrame:
    """Projects that need review first."""
    return projects(risk, risk_level="High", limit=limit)


def project(risk: DataFrame, project_id: str) -> DataFrame:
    """The project with this id in any case, as at most one row."""
    match = risk.where(_id_key(risk) == project_id.upper())
    return _public(match.orderBy("project_id").limit(1))


def project_row(risk: DataFrame, project_id: str) -> dict:
    """The project as a dict; LookupError when there is none."""
    row = project(risk, project_id).first()
    if row is None:
        raise LookupError(f"no project has the id {project_id!r}")
    return row.asDict()


def summary(risk: DataFrame) -> DataFrame:
    """One row with the number of projects in total and by level."""
    counts = [F.count("*").alias("total_projects")] + [
        F.count_if(F.col("risk_level") == level).alias(f"{level.lower()}_risk")
        for level in reversed(RISK_LEVELS)
    ]
    return risk.agg(*counts)


def distribution(risk: DataFrame) -> DataFrame:
    """Number of projects by level, highest first, levels without projects as 0."""
    counts = risk.agg(
        *(F.count_if(F.col("risk_level") == level).alias(level) for level in RISK_LEVELS)
    )
    rows = [
        F.struct(F.lit(place).alias("place"), F.lit(level).alias("risk_level"),
                 F.col(level).alias("n_projects"))
        for place, level in enumerate(reversed(RISK_LEVELS), start=1)
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy("place")


def category_counts(table: DataFrame) -> DataFrame:
    """Number of rows by category, largest first; rows without one are left out."""
    return (
        table.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count("*").alias("n_projects"))
        .orderBy(F.desc("n_projects"), "category")
    )


def top_risks(risk: DataFrame, k: int = 10) -> DataFrame:
    """The k projects with the highest score, with their reasons."""
    return _highest_first(risk, k).select(
        "project_id", "category", "risk_score", "risk_level", "risk_reasons"
    )


def top_spending(spending: DataFrame, k: int = 20) -> DataFrame:
    """The k projects with the highest spending z-score; those without one come last."""
    return (
        spending.orderBy(F.desc_nulls_last("spending_zscore"), "project_id")
        .limit(k)
        .select(
            "project_id",
            "category",
            "expenditure_lakh",
            "category_avg_expenditure_lakh",
            "category_std_expenditure_lakh",
            "spending_zscore",
            "spending_anomaly",
        )
    )
