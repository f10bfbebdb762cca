"""Extra columns, row numbers, rows at fault and versions of tables."""

import pytest
from pyspark.sql import functions as F

from fixtures import sample_projects
from worksight.functions.display import first_of, location_text
from worksight.sources import schema, snapshots, tables


def test_extra_columns_come_back_typed(spark, tmp_path):
    rows = [
        ("1", " 7", "1e3", "True", "x", "", "5", "nan"),
        ("22", "NA", ".5", "False", "1,5", None, "1.0", "2"),
        ("-3", "8", "-4.", "true", "2 ", "", "6", "3"),
    ]
    names = ["n", "gap", "real", "flag", "words", "void", "mixed", "hole"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    df = sample_projects(spark).limit(3).withColumn("k", F.row_number().over(_by_id())).join(
        df.withColumn("k", F.monotonically_increasing_id() * 0 + F.row_number().over(_by_n())), "k"
    )
    path = str(tmp_path / "extra")
    tables.write_csv(df.drop("k"), path)
    back = tables.read_csv(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in back.schema}
    assert [c for c in back.columns if c not in schema.PROJECT_SCHEMA.names] == names
    expected = ["bigint", "bigint", "double", "boolean", "string", "string", "double", "bigint"]
    assert [kinds[c] for c in names] == expected
    got = {r.n: r for r in back.collect()}
    assert got[1].gap == 7 and got[22].gap is None and got[22].real == 0.5
    assert got[-3].flag is True and got[22].words == "1,5" and got[1].void is None
    assert got[22].mixed == 1.0 and got[1].hole is None
    assert tables.read_csv(spark, path, extras=False).columns == schema.PROJECT_SCHEMA.names


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("project_id")


def _by_n():
    from pyspark.sql import Window

    return Window.orderBy("n")


def test_aliases_and_location_arrive_from_csv(spark, tmp_path):
    names = schema.PROJECT_SCHEMA.names
    cells = dict.fromkeys(names, "") | {"project_id": "P1"}
    lines = [",".join([*names, "location", "risk"]), ",".join([*cells.values(), "Ward 4", "Hall"])]
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n")
    df = tables.read_csv(spark, str(tmp_path / "one.csv"))
    row = df.select(location_text(df).alias("at"), first_of(df, "risk_level", F.lit("none")).alias("name"))
    assert tuple(row.first()) == ("Ward 4", "Hall")


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_row_numbers_over_many_files(spark, tmp_path, split):
    names = schema.SIGNAL_SCHEMA.names
    number = 0
    for file, n in [("b.csv", 150), ("a.csv", 3), ("c.csv", 0), ("d.csv", 61)]:
        lines = [",".join(names)] + [f"{file}{i},81.5,{i},True" for i in range(n)]
        (tmp_path / file).write_text("\n".join(lines) + "\n")
        number += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = tables.read_csv(spark, str(tmp_path), schema.SIGNAL_SCHEMA, with_row_seq=True)
        rows = got.orderBy("row_seq").select("row_seq", "project_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [f"{f}{i}" for f, n in [("a.csv", 3), ("b.csv", 150), ("d.csv", 61)] for i in range(n)]
    assert [tuple(r) for r in rows] == list(enumerate(expected))


def test_rows_at_fault_are_set_apart(spark, tmp_path):
    names = schema.SIGNAL_SCHEMA.names
    lines = [
        ",".join(names),
        "P1,80.5,2,True",
        "P2,80.5,2",
        "P3,80.5,2,True,more",
        "P4,high,2,True",
        "P5,80.5,2.5,True",
        "P6,,2.0,",
        ",80.5,2,True",
        "P8,1e2,99999999999999999999,True",
    ]
    path = tmp_path / "signals.csv"
    path.write_text("\n".join(lines) + "\n")
    checked = tables.read_csv_checked(spark, str(path), schema.SIGNAL_SCHEMA)
    assert [tuple(r) for r in checked.rows.orderBy("project_id").collect()] == [
        ("P1", 80.5, 2, True),
        ("P6", None, 2, None),
    ]
    faults = {r.record.split(",")[0]: r.reason for r in checked.faults.collect()}
    assert faults == {
        "P2": "wrong number of cells",
        "P3": "wrong number of cells",
        "P4": "not double: max_similarity_pct = high",
        "P5": "not bigint: similar_project_count = 2.5",
        "": "no project_id",
        "P8": "not bigint: similar_project_count = 99999999999999999999",
    }
    assert checked.faults.select("file").distinct().count() == 1
    with pytest.raises(ValueError, match="lacks"):
        tables.read_csv_checked(spark, str(path))


def test_versions_under_readers(spark, tmp_path):
    path = str(tmp_path / "risk")
    with pytest.raises(LookupError):
        snapshots.load(spark, path)
    assert snapshots.publish(spark.range(3), path) == 1
    old = snapshots.load(spark, path)

    def slow(df, folder):  # a reader comes while the next version is half written
        df.write.parquet(folder)
        assert snapshots.load(spark, path).count() == 3

    assert snapshots.publish(spark.range(5), path, slow) == 2
    assert (old.count(), snapshots.load(spark, path).count()) == (3, 5)
    assert snapshots.load(spark, path, 1).count() == 3

    def fails(df, folder):
        raise OSError("disk")

    with pytest.raises(OSError):
        snapshots.publish(spark.range(9), path, fails)
    assert snapshots.load(spark, path).count() == 5
    assert snapshots.publish(spark.range(7), path) == 4  # the failed one keeps its number
    assert snapshots.expire(spark, path, keep=2) == [1]
    assert snapshots.versions(spark, path) == [2, 4]
    with pytest.raises(LookupError):
        snapshots.load(spark, path, 1)
