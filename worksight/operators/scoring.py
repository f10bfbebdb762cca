"""Component scores, the 0-100 risk score, its level and the written reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.config import DEFAULT, NO_SIGNAL_REASON, RISK_LEVELS, ScreeningConfig
from worksight.functions.numeric import clamp, fixed_text, linear_score, round_scaled

REASON_SEPARATOR = " | "


def cost_score(config: ScreeningConfig = DEFAULT) -> Column:
    overrun = F.col("sanction_overrun_pct")
    return linear_score(overrun, config.overrun_full_pct, config.cost_weight)


def delay_score(config: ScreeningConfig = DEFAULT) -> Column:
    return linear_score(F.col("delay_pct"), config.delay_full_pct, config.delay_weight)


def duplicate_score(config: ScreeningConfig = DEFAULT) -> Column:
    return linear_score(
        F.col("max_similarity_pct"),
        config.similarity_full_pct,
        config.duplicate_weight,
        zero_at=config.similarity_zero_pct,
    )


def spending_score(config: ScreeningConfig = DEFAULT) -> Column:
    z_score = F.col("spending_zscore")
    return linear_score(z_score, config.zscore_full, config.spending_weight)


def risk_score() -> Column:
    parts = ["cost_score", "delay_score", "duplicate_score", "spending_score"]
    return clamp(round_scaled(sum(map(F.col, parts[1:]), F.col(parts[0])), 2), 0, 100)


def risk_level(config: ScreeningConfig = DEFAULT) -> Column:
    low, medium, high = RISK_LEVELS
    score = F.col("risk_score")
    return (
        F.when(score >= config.high_from, high)
        .when(score >= config.medium_from, medium)
        .otherwise(low)
    )


def reason_list() -> Column:
    """Texts of the components that scored, as an array."""

    def text(score: str, *parts: str | Column) -> Column:
        parts = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.when(F.col(score) > 0, F.concat(*parts))

    # The wording and number formats of the reasons.
    reasons = F.array_compact(
        F.array(
            text(
                "cost_score",
                "Cost overrun of ",
                fixed_text(F.col("sanction_overrun_pct"), 1),
                "% above sanctioned amount",
            ),
            text(
                "delay_score",
                "Project duration exceeds plan by ",
                fixed_text(F.col("delay_pct"), 1),
                "%",
            ),
            text(
                "duplicate_score",
                "Similar work description detected (",
                fixed_text(F.col("max_similarity_pct"), 1),
                "% similarity)",
            ),
            text(
                "spending_score",
                "Expenditure is unusually high for the ",
                F.col("category"),
                " category (z-score: ",
                fixed_text(F.col("spending_zscore"), 2),
                ")",
            ),
        )
    )
    return reasons


def risk_reasons() -> Column:
    joined = F.array_join(reason_list(), REASON_SEPARATOR)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_SIGNAL_REASON))


def with_scores(signals: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Scores, level and reasons behind the columns of a table with all four signals."""
    return (
        signals.withColumns(
            {
                "cost_score": cost_score(config),
                "delay_score": delay_score(config),
                "duplicate_score": duplicate_score(config),
                "spending_score": spending_score(config),
            }
        )
        .withColumn("risk_score", risk_score())
        .withColumn("risk_level", risk_level(config))
        .withColumn("risk_reasons", risk_reasons())
    )
