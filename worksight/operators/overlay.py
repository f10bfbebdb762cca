"""Keyed overwrite of rows, near-duplicate injection and union of project tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.operators.keyed_join import fits_broadcast
from worksight.sources.schema import PROJECT_SCHEMA, require_columns


def apply_overlay(
    df: DataFrame, overlay: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """``df`` with ``columns`` taken from the overlay row of the same key, if there is one.

    Overlay keys that ``df`` lacks are skipped. The overlay has one row per key.
    """
    fresh = overlay.select(
        key, F.struct(*columns).alias("_new"), F.lit(True).alias("_hit")
    )
    if fits_broadcast(overlay.select(key, *columns)):
        fresh = F.broadcast(fresh)
    merged = df.join(fresh, key, "left")
    return merged.select(
        *(
            F.when(F.col("_hit"), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        )
    )


def near_duplicate_overlay(specs: DataFrame) -> DataFrame:
    """Two projects per spec row (id_1, id_2, category, place) with nearly the same text."""
    # The two wordings.
    ends = F.array(
        F.struct(F.col("id_1").alias("project_id"), F.lit(" at ").alias("link")),
        F.struct(F.col("id_2").alias("project_id"), F.lit(" in ").alias("link")),
    )
    text = F.concat(
        F.lit("Construction of "), F.lower("category"), F.col("link"), F.col("place")
    )
    return specs.select("category", "place", F.inline(ends)).select(
        "project_id", "category", text.alias("work_description")
    )


def append_projects(original: DataFrame, added: DataFrame) -> DataFrame:
    """Both tables' rows in the columns of the first, which must have all project columns."""
    missing = sorted(set(PROJECT_SCHEMA.names) - set(original.columns))
    if missing:
        raise ValueError(f"no column {missing} in the table to append to")
    require_columns(added, original.columns, "appended table")
    return original.unionByName(added.select(*original.columns))
