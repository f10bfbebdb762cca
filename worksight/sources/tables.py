"""Reading and writing of the project, signal and risk tables."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksight.functions.numeric import no_nan
from worksight.operators.keyed_join import attach
from worksight.sources.schema import PROJECT_SCHEMA, RISK_COLUMNS, require_columns
from worksight.sources.scratch import stored

# CSV cells that stand for a missing value.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Lookup keys stored beside the risk table, so that reads push a plain equality.
CATEGORY_KEY = "category_key"
ID_KEY = "project_id_key"


def _whole_number(text: Column, kind: str) -> Column:
    """Text such as ``180`` or ``180.0`` as a whole number; a fraction is an error, not lost.

    Digits are read as they stand, so large numbers keep their last one; other spellings
    must be exact as a double.
    """
    number = text.cast("double")
    exact = (number == F.floor(number)) & (F.abs(number) < float(1 << 53))
    problem = F.concat(F.lit(f"not a whole number ({kind}): "), text)
    return (
        F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.cast(kind))
        .when(exact, number.cast("bigint").cast(kind))
        .when(number.isNotNull(), F.raise_error(problem).cast(kind))
    )


def _present(name: str) -> Column:
    """The cell's text, NULL where it stands for a missing value."""
    text = F.col(f"`{name}`")
    return F.when(~text.isin(MISSING_CELLS), text)


def _typed_cell(field: T.StructField, as_double: bool) -> Column:
    present = _present(field.name)
    if as_double:
        return present.cast("double").alias(field.name)
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        return _whole_number(present, field.dataType.simpleString()).alias(field.name)
    return present.cast(field.dataType).alias(field.name)


# What an extra column may turn out to be, the narrowest first: the type and the pattern
# that all its cells match. Other columns are text.
_KINDS = {
    "boolean": r"^(True|False|TRUE|FALSE|true|false)$",
    "bigint": r"^\s*[+-]?[0-9]{1,18}\s*$",
    "double": r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$",
}


def infer_types(cells: DataFrame, names: Collection[str]) -> dict[str, str]:
    """The type of each column of text cells, by one vote of all its rows.

    boolean, bigint or double if every present cell reads so, else string; a column without
    a present cell is string, too. One aggregate over all columns; its single row of counts
    is what the driver receives.
    """
    names = list(names)
    if not names:
        return {}
    votes = [F.count(_present(name)).alias(f"{k} present") for k, name in enumerate(names)]
    votes += [
        F.count_if(_present(name).rlike(pattern)).alias(f"{k} {kind}")
        for k, name in enumerate(names)
        for kind, pattern in _KINDS.items()
    ]
    row = cells.agg(*votes).first()

    def elected(k: int) -> str:
        present = row[f"{k} present"]
        fits = (kind for kind in _KINDS if present and row[f"{k} {kind}"] == present)
        return next(fits, "string")

    return {name: elected(k) for k, name in enumerate(names)}


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with row_seq, from 0 without gaps by file path and place in the file.

    A task reads a split in order, so a row's place in its split is the difference of two
    task-wise ids, and the splits before it are counted; the rows themselves stay where they
    are. They are stored first, so that both see the same ids.
    """
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed, "csv-rows")
    splits = placed.groupBy("_path", "_start").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows")
    )
    files = splits.groupBy("_path").agg(F.sum("_rows").alias("in_file"))
    in_files = F.sum("in_file").over(W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("_path", F.coalesce(in_files, F.lit(0)).alias("before_file"))
    earlier = W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    in_file = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    offsets = splits.withColumn("before", in_file).join(files, "_path")
    offsets = offsets.select(
        "_path", "_start", "_rows", (F.col("before_file") + F.col("before") - F.col("_first")).alias("_offset")
    )
    # one row for each split of the scan
    found = attach(
        placed, stored(offsets, "csv-splits"), ["_path", "_start"], "_rows", "_id", "inner"
    )
    return found.withColumn("row_seq", F.col("_id") + F.col("_offset")).select(
        *(c for c in rows.columns if c not in ("_path", "_start")), "row_seq"
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PROJECT_SCHEMA,
    with_row_seq: bool = False,
    multi_line: bool = False,
    doubles: Collection[str] = (),
    extras: bool = True,
) -> DataFrame:
    """CSV with a header, cells typed by ``schema`` and matched to it by header name.

    Columns that ``schema`` doesn't name follow behind, typed by what all their cells are
    (``infer_types``, one more scan), unless ``extras`` is off.

    ``doubles`` names whole-number columns to read as double, for tables with fractional
    days; a fraction is an error elsewhere.

    ``with_row_seq`` adds ``row_seq``, numbering the rows of a file or of all files of a
    folder in the order of their paths, from 0 without gaps, however Spark splits them; the
    rows are stored for it.
    ``multi_line`` accepts line breaks inside quoted cells; Spark then cannot split a
    file, so large inputs of that kind should come as many files.
    """
    cells = spark.read.csv(
        path, header=True, quote='"', escape='"', multiLine=multi_line, nullValue=""
    )
    require_columns(cells, schema.names, f"Table at {path}")
    typed = [_typed_cell(field, field.name in doubles) for field in schema]
    if extras:
        others = infer_types(cells, [c for c in cells.columns if c not in schema.names])
        typed += [_present(name).cast(kind).alias(name) for name, kind in others.items()]
    if not with_row_seq:
        return cells.select(*typed)
    split = [
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    ]
    return _numbered(cells.select(*typed, *split))


@dataclass(frozen=True)
class CheckedTable:
    """rows: the sound rows, typed. faults: file, record (its text) and reason of all others."""

    rows: DataFrame
    faults: DataFrame


_RECORD = "_malformed_record"


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PROJECT_SCHEMA,
    key: str | None = "project_id",
    multi_line: bool = False,
) -> CheckedTable:
    """CSV as in ``read_csv``, with rows that can't be read set apart and not repaired.

    A row is at fault if it has too few or too many cells, if a cell is not of its column's
    type, or if ``key`` is missing; the first such fault in this order, by column, is named.
    Both frames come from one stored read.
    """
    names = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line).columns
    missing = [name for name in schema.names if name not in names]
    if missing:
        raise ValueError(f"Table at {path} lacks {missing}")
    layout = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _RECORD]])
    cells = (
        spark.read.schema(layout)
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)  # cells can only be counted if all are read
        .csv(path, header=True, quote='"', escape='"', multiLine=multi_line, nullValue="")
    )

    def fault(field: T.StructField) -> Column:
        present, kind = _present(field.name), field.dataType.simpleString()
        if kind == "string":
            return F.lit(None).cast("string")
        number = present.try_cast("double")
        sound = present.try_cast(field.dataType).isNotNull()
        if kind in ("int", "bigint"):
            limit = float(1 << (31 if kind == "int" else 53))
            whole = (number == F.floor(number)) & (F.abs(number) < limit)
            sound = F.when(present.rlike(r"^\s*[+-]?[0-9]+\s*$"), sound).otherwise(F.coalesce(whole, F.lit(False)))
        text = F.concat(F.lit(f"not {kind}: {field.name} = "), present)
        return F.when(present.isNotNull() & ~sound, text)

    reasons = [F.when(F.col(_RECORD).isNotNull(), "wrong number of cells")]
    reasons += [fault(field) for field in schema]
    if key is not None:
        reasons.append(F.when(_present(key).isNull(), f"no {key}"))
    checked = stored(
        cells.select(
            "*", F.coalesce(*reasons).alias("_reason"), F.col("_metadata.file_path").alias("_path")
        ),
        "checked-csv",
    )
    sound = checked.where("_reason is null")
    record = F.coalesce(_RECORD, F.concat_ws(",", *(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names)))
    return CheckedTable(
        rows=sound.select(*(_typed_cell(field, False) for field in schema)),
        faults=checked.where("_reason is not null").select(
            F.col("_path").alias("file"), record.alias("record"), F.col("_reason").alias("reason")
        ),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table with NaN read as NULL in its floating-point columns."""
    table = spark.read.parquet(path)
    floating = (T.DoubleType, T.FloatType)
    return table.select(
        *(
            no_nan(F.col(field.name)).alias(field.name)
            if isinstance(field.dataType, floating)
            else F.col(field.name)
            for field in table.schema
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_risk_table(risk: DataFrame, path: str) -> None:
    """Risk table partitioned by level, each file ordered by id, for the read queries.

    The rows of a level are brought together before the write, in files of Spark's advisory
    size, however many tasks made them. Within a file the order lets the column index skip
    all pages but one on a lookup, and a Bloom filter on the id skips the other files.
    """
    (
        risk.withColumn(CATEGORY_KEY, F.lower("category"))
        .withColumn(ID_KEY, F.upper("project_id"))
        .hint("rebalance", F.col("risk_level"))
        .sortWithinPartitions("risk_level", ID_KEY)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{ID_KEY}", "true")
        .partitionBy("risk_level")
        .parquet(path)
    )


def load_risk_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored risk table, lookup keys last."""
    stored = spark.read.parquet(path)
    keys = [CATEGORY_KEY, ID_KEY]
    inputs = [c for c in stored.columns if c not in [*RISK_COLUMNS, *keys]]
    return stored.select(*inputs, *RISK_COLUMNS, *keys)
