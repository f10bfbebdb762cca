"""Review views: the numbered queue of high-risk projects and the case view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.config import DEFAULT, ScreeningConfig
from worksight.functions.display import (
    NO_DESCRIPTION,
    NOT_A_NUMBER,
    UNKNOWN_ID,
    bar_width,
    first_of,
    location_text,
    number_text,
    percent_text,
    shown_reasons,
)
from worksight.functions.numeric import no_nan
from worksight.plans.reads import high_risk


def _heading(df: DataFrame) -> list[Column]:
    score = first_of(df, "risk_score", F.lit(0.0))
    return [
        first_of(df, "project_id", F.lit(UNKNOWN_ID)).alias("project_id"),
        first_of(df, "work_description", F.lit(NO_DESCRIPTION)).alias("description"),
        location_text(df).alias("location"),
        number_text(score).alias("score_text"),
        first_of(df, "risk_level", F.lit("High")).alias("risk_level"),
    ]


def review_queue(risk: DataFrame, limit: int = 50) -> DataFrame:
    """High-risk projects by falling score with their two-digit place in the queue."""
    queue = high_risk(risk, limit)  # at most 500 rows, so one window is enough
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("risk_score"), "project_id"))
    text = place.cast("string")
    number = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return queue.select(number.alias("place"), *_heading(queue))


def investigation_view(risk: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Case columns: heading, scores with bars, money, execution, similarity, reasons."""
    weights = {
        "cost": config.cost_weight,
        "delay": config.delay_weight,
        "duplicate": config.duplicate_weight,
        "spending": config.spending_weight,
    }
    scores = []
    for name, weight in weights.items():
        score = F.col(f"{name}_score")
        scores += [
            number_text(score).alias(f"{name}_score_text"),
            bar_width(score).alias(f"{name}_bar"),
            (no_nan(score) / weight * 100).alias(f"{name}_share_pct"),
        ]

    def amount(name: str) -> Column:
        return F.concat(F.lit("₹"), number_text(F.col(name)), F.lit(" L"))

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(NOT_A_NUMBER))

    return risk.select(
        *_heading(risk),
        *scores,
        amount("estimated_cost_lakh").alias("estimated_text"),
        amount("sanctioned_amount_lakh").alias("sanctioned_text"),
        amount("expenditure_lakh").alias("expenditure_text"),
        percent_text(F.col("sanction_overrun_pct")).alias("overrun_text"),
        percent_text(F.col("physical_progress_pct")).alias("progress_text"),
        plain("current_status").alias("status_text"),
        F.concat(plain("delay_days"), F.lit(" days")).alias("delay_text"),
        percent_text(F.col("delay_pct")).alias("delay_pct_text"),
        percent_text(F.col("max_similarity_pct")).alias("similarity_text"),
        plain("similar_project_count").alias("similar_projects_text"),
        shown_reasons(risk).alias("reasons"),
    )
