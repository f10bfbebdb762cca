"""Texts and shares shown to a reviewer, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksight.functions.numeric import clamp, no_nan, round_fixed

# Texts shown for missing data and for flags without written reasons.
NOT_A_NUMBER = "-"
UNKNOWN_ID = "Unknown"
NO_DESCRIPTION = "Project description unavailable"
NO_LOCATION = "Location unavailable"
GENERAL_REASON = "Multiple risk signals require review."
FLAG_REASONS = {
    "cost": "Potential cost anomaly",
    "delay": "Potential execution delay",
    "duplicate": "Potentially similar or duplicate work",
    "spending": "Unusual spending pattern",
}

# Names under which a value may be found, first match wins.
ALIASES = {
    "project_id": ["project_id", "id", "Project_ID"],
    "risk_score": ["risk_score", "score", "Risk_Score"],
    "risk_level": ["risk_level", "risk", "Risk_Level"],
    "work_description": [
        "work_description",
        "description",
        "work_name",
        "work",
        "Work_Description",
    ],
    "district": ["district", "District"],
    "state": ["state", "State"],
}
LOCATION_ALIASES = ["location", "Location"]


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the names that are columns of df, spelled exactly so."""
    return [name for name in names if name in df.columns]


def first_of(df: DataFrame, field: str, default: Column) -> Column:
    """First value that is not missing among the field's aliases."""
    return F.coalesce(*(F.col(n) for n in _present(df, ALIASES[field])), default)


def number_text(x: Column, digits: int = 2, suffix: str = "") -> Column:
    """Fixed decimals, ``-`` when there is no number."""
    number = no_nan(x)
    infinite = F.when(number > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))
    # no negative zero: -0.001 shows as -0.00, but a zero itself never has a sign
    plain = F.when(number == 0, F.lit(0.0)).otherwise(round_fixed(number, digits))
    finite = F.format_string(f"%.{digits}f", plain)
    text = F.when(F.abs(number) == float("inf"), infinite).otherwise(finite)
    return F.when(number.isNotNull(), F.concat(text, F.lit(suffix))).otherwise(
        F.lit(NOT_A_NUMBER)
    )


def percent_text(x: Column) -> Column:
    return number_text(x, 2, "%")


def bar_width(x: Column) -> Column:
    """Share of a bar in percent, within 0 and 100, 0 when missing."""
    return clamp(F.coalesce(no_nan(x), F.lit(0.0)), 0, 100)


def location_text(df: DataFrame) -> Column:
    def filled(column: Column) -> Column:
        return F.nullif(column, F.lit(""))

    district = filled(first_of(df, "district", F.lit(None).cast("string")))
    state = filled(first_of(df, "state", F.lit(None).cast("string")))
    joined = filled(F.concat_ws(", ", district, state))
    others = [filled(F.col(n)) for n in _present(df, LOCATION_ALIASES)]
    return F.coalesce(joined, *others, F.lit(NO_LOCATION))


def split_reasons(text: Column) -> Column:
    """Reasons of a joined text, trimmed, without empty ones."""
    return F.filter(
        F.transform(F.split(text, r"\|"), lambda reason: F.trim(reason)),
        lambda reason: reason != "",
    )


def flag_reasons(df: DataFrame) -> Column:
    """Reasons from the flag columns a table has, or the general one."""
    found = []
    for signal, text in FLAG_REASONS.items():
        conditions = [
            F.col(name) == value
            for name, value in ((f"{signal}_risk", "High"), (f"{signal}_anomaly", True))
            if name in df.columns
        ]
        for_signal = F.lit(False)
        for condition in conditions:
            for_signal = for_signal | F.coalesce(condition, F.lit(False))
        found.append(F.when(for_signal, F.lit(text)))
    reasons = F.array_compact(F.array(*found))
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(GENERAL_REASON)))


def shown_reasons(df: DataFrame) -> Column:
    """Reasons as an array: written ones if the table has them, else from the flags."""
    choices = []
    for name in _present(df, ["risk_reasons", "reasons", "alerts"]):
        is_array = isinstance(df.schema[name].dataType, T.ArrayType)
        if is_array:
            choices.append(F.col(name))
        elif name == "risk_reasons":
            choices.append(split_reasons(F.col(name)))
    return F.coalesce(*choices, flag_reasons(df))
