"""Project-shaped views over the sample star schema (part or supplier grain).

Amounts are conditional sums over all order lines of the part or supplier; the other
project columns are taken from the key and the attributes of the part or supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions.numeric import round_scaled
from worksight.sources.schema import PROJECT_SCHEMA


def _amounts(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """One row per key; partial sums are made before the shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def total(value: str, flag: str, is_value: str) -> Column:
        return F.sum(F.when(F.col(flag) == is_value, F.col(value)))

    return lines.groupBy(F.col(key).alias("key")).agg(
        total("l_quantity", "l_linestatus", "F").alias("done_quantity"),
        total("l_extendedprice", "l_returnflag", "N").alias("sanctioned"),
        total("l_extendedprice", "l_returnflag", "A").alias("spent"),
    )


def _dated(key: Column, size: Column) -> dict[str, Column]:
    planned = (F.lit(120) + F.pmod(key, F.lit(201))).cast("int")
    elapsed = (F.lit(60) + F.pmod(key * 7919, F.lit(341))).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(key, F.lit(951)).cast("int"))
    return {
        "planned_duration_days": planned,
        "elapsed_days": elapsed,
        "start_date": start,
        "expected_completion_date": F.date_add(start, planned),
        "current_status": F.when(size > 45, "Delayed")
        .when(size > 25, "In Progress")
        .otherwise("Completed"),
        "latitude": F.lit(8.0) + F.pmod(key, F.lit(200)) / 10,
        "longitude": F.lit(70.0) + F.pmod(key, F.lit(150)) / 10,
    }


def part_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per part; category is the part type. ``row_seq`` orders the rows."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size")
    words = F.split("p_name", " ")
    columns = {
        "project_id": key.cast("string"),
        "mp_name": F.col("p_brand"),
        "state": F.when(size % 5 != 0, F.element_at(words, 1)).otherwise(""),
        "district": F.when(size % 7 != 0, F.element_at(words, -1)),
        "category": F.col("p_type"),
        "work_description": F.concat_ws(" ", "p_name", "p_brand"),
        "estimated_cost_lakh": round_scaled(
            F.col("p_retailprice") * F.col("done_quantity"), 2
        ),
        "sanctioned_amount_lakh": round_scaled(F.col("sanctioned"), 2),
        "expenditure_lakh": round_scaled(F.col("spent"), 2),
        "physical_progress_pct": F.least(F.lit(100.0), size * 2.5),
        **_dated(key, size),
        "implementing_agency": F.concat(F.lit("Agency "), (size % 4).cast("string")),
    }
    amounts = _amounts(spark, sf_dir, "l_partkey")
    return part.join(amounts, key == F.col("key"), "left").select(
        *(columns[name].alias(name) for name in PROJECT_SCHEMA.names),
        key.alias("row_seq"),
    )


def supplier_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per supplier; category is the region of its nation."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    supplier = (
        read("supplier")
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("s_suppkey")
    size = F.pmod(key, F.lit(50)).cast("int")
    columns = {
        "project_id": F.concat(F.lit("S"), key.cast("string")),
        "mp_name": F.col("s_name"),
        "state": F.col("n_name"),
        "district": F.col("r_name"),
        "category": F.col("r_name"),
        "work_description": F.concat(F.lit("Supply works of "), F.lower("n_name")),
        "estimated_cost_lakh": round_scaled(F.col("done_quantity") * 1000, 2),
        "sanctioned_amount_lakh": round_scaled(F.col("sanctioned"), 2),
        "expenditure_lakh": round_scaled(F.col("spent"), 2),
        "physical_progress_pct": F.least(F.lit(100.0), size * 2.5),
        **_dated(key, size),
        "implementing_agency": F.concat(F.lit("Agency "), (size % 4).cast("string")),
    }
    amounts = _amounts(spark, sf_dir, "l_suppkey")
    return supplier.join(amounts, key == F.col("key"), "left").select(
        *(columns[name].alias(name) for name in PROJECT_SCHEMA.names)
    )
