"""Column arithmetic with the null, infinity and rounding rules of the screening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
_SPLIT = 134217729.0  # 2**27 + 1: halves a double's 53 bits


def no_nan(x: Column) -> Column:
    """NaN as NULL, so that comparisons with a missing value are never true."""
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def ratio_pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; over zero it is +/-Infinity by the sign of part, NULL for 0/0."""
    part, whole = part.cast("double"), whole.cast("double")
    return (
        F.when(whole != 0, part / F.nullif(whole, F.lit(0.0)) * 100)
        .when((whole == 0) & (part > 0), F.lit(INFINITY))
        .when((whole == 0) & (part < 0), F.lit(-INFINITY))
    )


def is_true(condition: Column) -> Column:
    """Condition with missing operands counted as false."""
    return F.coalesce(condition, F.lit(False))


def round_scaled(x: Column, digits: int) -> Column:
    """Half-even on ``x * 10**digits`` as it is in floating point (array rounding)."""
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def _scaled_tie(x: Column, digits: int) -> tuple[Column, Column, Column]:
    """Scaled value, whether it looks like a tie, and the exact error of the scaling.

    The product error is recovered with the splitting of Dekker (1971), so a tie
    made by floating point (2.675 * 100) is told from a real one (0.625 * 100).
    """
    scale = 10.0**digits
    scaled = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - scaled) + (x - high) * scale
    tie = F.abs(scaled - F.rint(scaled)) == 0.5
    return scaled, tie, error


def round_exact(x: Column, digits: int) -> Column:
    """Half-even on the exact binary value, as Python's ``round`` and ``%.nf`` do."""
    scaled, tie, error = _scaled_tie(x, digits)
    whole = (
        F.when(tie & (error > 0), scaled + 0.5)
        .when(tie & (error < 0), scaled - 0.5)
        .otherwise(F.rint(scaled))
    )
    return whole / 10.0**digits


def round_fixed(x: Column, digits: int) -> Column:
    """Nearest on the exact binary value, real ties away from zero (``toFixed``)."""
    scaled, tie, error = _scaled_tie(x, digits)
    away = F.signum(x)
    whole = (
        F.when(tie & (error * away >= 0), scaled + away * 0.5)
        .when(tie, scaled - away * 0.5)
        .otherwise(F.rint(scaled))
    )
    return whole / 10.0**digits


def linear_score(
    x: Column, full_at: float, weight: float, zero_at: float = 0.0
) -> Column:
    """0 up to ``zero_at``, ``weight`` from ``full_at`` on, linear and rounded in between."""
    share = (x - zero_at) / (full_at - zero_at) if zero_at else x / full_at
    return (
        F.when(x >= full_at, F.lit(float(weight)))
        .when(x > zero_at, round_exact(share * weight, 2))
        .otherwise(F.lit(0.0))
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def fixed_text(x: Column, digits: int) -> Column:
    """``x`` with a fixed number of decimals; NULL stays NULL, infinity reads ``inf``."""
    return (
        F.when(x == INFINITY, F.lit("inf"))
        .when(x == -INFINITY, F.lit("-inf"))
        .when(x.isNotNull(), F.format_string(f"%.{digits}f", round_exact(x, digits)))
    )
