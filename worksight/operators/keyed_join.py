"""Join with a table of one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table up to these bounds, over all columns that are sent, is broadcast whole.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 * 1024 * 1024
# A key with more rows than this is spread over as many tasks as it needs ...
TASK_ROWS = 1_000_000
# ... but at most this many keys are; what is left is for Spark's skew join.
HOT_KEYS = 10_000
SPREAD = 1 << 16


def fits_broadcast(table: DataFrame) -> bool:
    """Measured size of the table, all its columns, against the bounds (one small job)."""
    flat = table.select(F.to_json(F.struct(*table.columns)).alias("row"))
    size = flat.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.octet_length("row")), F.lit(0)).alias("bytes"),
    ).first()
    return size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: str,
    how: str = "left",
    small: bool | None = None,
    hashed: bool = False,
) -> DataFrame:
    """``rows`` with the other columns of ``table`` for their key.

    Rows whose key is not in the table get NULL (``left``) or are left out (``inner``).

    ``table`` holds one row per key and should be stored, as it is read more than
    once; ``weight`` is its column with the number of rows a key has. When the table
    is too large to broadcast, a key of more than ``TASK_ROWS`` rows is cut into that many
    parts: its table row is repeated for each part, and each of ``rows`` falls into one by
    ``spread_by``. The join stays a plain one, so an inner join can drop rows before the
    shuffle by a Bloom filter of the keys. ``hashed`` builds hash maps of the table's
    partitions, so that far more rows than the table has need no sort.
    """
    keys = list(keys)
    if fits_broadcast(table) if small is None else small:
        return rows.join(F.broadcast(table), keys, how)

    values = [c for c in table.columns if c not in keys]
    parts = F.ceil(F.col(weight) / TASK_ROWS).cast("int").alias("_parts")
    hot = table.where(F.col(weight) > TASK_ROWS).orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = hot.select(*keys, parts)
    spread = F.xxhash64(spread_by)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    part = F.pmod(spread, F.coalesce("_parts", F.lit(1)).cast("bigint"))
    if how == "left":  # a missing key matches nothing and may lie anywhere
        part = F.when(missing, -1 - F.pmod(spread, F.lit(SPREAD))).otherwise(part)
    cut = (
        table.join(F.broadcast(hot), keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .withColumn("_part", F.col("_part").cast("bigint"))
        .select(*keys, "_part", *values)
    )
    if hashed:
        cut = cut.hint("shuffle_hash")
    placed = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", part)
    return placed.join(cut, [*keys, "_part"], how).select(*rows.columns, *values)
