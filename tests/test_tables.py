import math
import time

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures import projects, sample_projects
from worksight.functions.display import first_of, flag_reasons, location_text, shown_reasons
from worksight.operators import overlay, profile
from worksight.plans import reads
from worksight.sources import schema, scratch, tables


def test_csv_round_trip(spark, tmp_path):
    df = sample_projects(spark)
    path = str(tmp_path / "new" / "projects")
    tables.write_csv(df, path)
    back = tables.read_csv(spark, path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_csv_cells(spark, tmp_path):
    names = schema.PROJECT_SCHEMA.names
    cells = dict.fromkeys(names, "")
    cells |= {"project_id": "P1", "category": "N/A", "expenditure_lakh": "NaN",
              "planned_duration_days": "180.0", "work_description": '"a ""b"", c"'}
    path = tmp_path / "one.csv"
    lines = [",".join(names), ",".join(cells.values())]
    lines.append(",".join((cells | {"project_id": "P2"}).values()))
    path.write_text("\n".join(lines) + "\n")
    rows = tables.read_csv(spark, str(path), with_row_seq=True).orderBy("row_seq").collect()
    assert [r.project_id for r in rows] == ["P1", "P2"]
    row = rows[0]
    assert row.category is None and row.expenditure_lakh is None
    assert row.planned_duration_days == 180 and row.work_description == 'a "b", c'
    path.write_text("\n".join(lines).replace("180.0", "180.5"))
    with pytest.raises(Exception, match="not a whole number"):
        tables.read_csv(spark, str(path)).collect()
    path.write_text("project_id,category\nP1,Road\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_csv(spark, str(path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, str(tmp_path / "absent.csv"))


def test_signal_csv(spark, tmp_path):
    path = tmp_path / "signals.csv"
    path.write_text(
        "project_id,max_similarity_pct,similar_project_count,duplicate_signal\n"
        "P1,100.0,2,True\nP2,81.5,1.0,True\n"
    )
    rows = tables.read_csv(spark, str(path), schema.SIGNAL_SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("P1", 100.0, 2, True), ("P2", 81.5, 1, True)]


def test_whole_numbers_of_any_size(spark, tmp_path):
    path = str(tmp_path / "cells")
    big = (1 << 53) + 1
    lines = ["n,d", f"{big},1.5", "-7.0,2", "1e3,n/a", ",3"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    schema = T.StructType().add("n", "long").add("d", "integer")
    got = tables.read_csv(spark, path, schema, doubles=["d"]).collect()
    assert {tuple(r) for r in got} == {(big, 1.5), (-7, 2.0), (1000, None), (None, 3.0)}
    with pytest.raises(Exception, match="not a whole number"):
        tables.read_csv(spark, path, schema).collect()
    for cell in ("2.7", "9007199254740993.0"):
        spark.createDataFrame([("n,d",), (f"{cell},1",)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(path)
        with pytest.raises(Exception, match="not a whole number"):
            tables.read_csv(spark, path, schema).collect()


def test_risk_table_has_few_files(spark, tmp_path):
    """Rows of a level come together, from however many tasks; the id has a Bloom filter."""
    path = str(tmp_path / "risk")
    rows = [(f"p{i}", "Road", ("Low", "Medium", "High")[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "project_id string, category string, risk_level string")
    tables.write_risk_table(df.repartition(40), path)
    for level in ("Low", "Medium", "High"):
        files = list((tmp_path / "risk" / f"risk_level={level}").glob("*.parquet"))
        assert 1 <= len(files) <= 2
        meta = pq.ParquetFile(files[0]).metadata
        assert meta.num_rows + sum(pq.ParquetFile(f).metadata.num_rows for f in files[1:]) == 200
    assert spark.read.parquet(path).where("project_id_key = 'P42'").count() == 1


def test_nan_is_read_as_null(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(projects(spark, {"expenditure_lakh": math.nan}), path)
    assert tables.read_table(spark, path).first().expenditure_lakh is None


def test_duplicate_keys(spark):
    df = projects(spark, {"project_id": "A"}, {"project_id": "B"}, {"project_id": "A"})
    assert [tuple(r) for r in schema.duplicate_keys(df, "project_id").collect()] == [("A", 2)]


def test_stored_frames_are_released(spark):
    scratch.release(spark)
    frame = scratch.stored(spark.range(3), "numbers")
    assert frame.count() == 3
    assert scratch.release(spark) == 1


def test_some_items_are_released(spark):
    first = scratch.stored(spark.range(3), "numbers")
    before = scratch.kept(spark)
    scratch.stored(spark.range(4), "more")
    later = [x for x in scratch.kept(spark) if not any(x is item for item in before)]
    assert len(later) == 1 and scratch.release(spark, later) == 1
    assert first.count() == 3 and scratch.release(spark) >= 1


def test_without_a_shared_folder_frames_are_persisted(spark, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: None)
    frame = scratch.stored(spark.range(3), "numbers")
    assert frame.storageLevel.useDisk and frame.storageLevel.useMemory
    assert frame.count() == 3
    assert scratch.release(spark) == 1


def test_profile_agrees_with_pandas(spark):
    df = sample_projects(spark)
    got = profile.numeric_profile(df).toPandas().set_index("stat")
    numbers = df.toPandas()[profile.PROFILE_COLUMNS]
    expected = numbers.describe().round(2)
    pd.testing.assert_frame_equal(
        got.loc[expected.index].astype(float), expected, check_names=False
    )


def test_quantiles_of_many_spans_and_hot_values(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(1) * 100).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("y"),
        F.lit(None).cast("double").alias("none"),
    )
    df = df.cache()
    got = {
        (r.metric, r.stat): r.value
        for r in profile.exact_quantiles(df, ["x", "y", "none"], {"a": 0.1, "b": 0.995}).collect()
    }
    numbers = df.toPandas()
    for stat, q in {"a": 0.1, "b": 0.995}.items():
        for metric in ("x", "y"):
            assert got[metric, stat] == pytest.approx(numbers[metric].quantile(q))
    assert len(got) == 4


def test_quantiles_of_few_values(spark):
    for n in range(1, 12):
        values = [float((7 * i) % n - (i % 3)) for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
        stats = {str(q): q for q in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)}
        got = {r.stat: r.value for r in profile.exact_quantiles(df, ["x"], stats).collect()}
        expected = pd.Series(values)
        assert got == {s: pytest.approx(expected.quantile(q)) for s, q in stats.items()}


def test_shape_and_head(spark):
    df = sample_projects(spark)
    row = profile.shape(df).first()
    assert (row.n_rows, row.n_columns) == (15, 18)
    assert row.column_names.startswith("project_id, mp_name")
    head = [r.project_id for r in profile.head(df, "project_id").collect()]
    assert head == ["P1001", "P1002", "P1003", "P1004", "P1005"]


def test_overlay_and_union(spark):
    df = projects(spark, *({"project_id": f"P{i}"} for i in range(1, 5)))
    specs = spark.createDataFrame(
        [("P2", "P3", "Bus Shelter", "Main Stop"), ("P9", "P4", "Library", "Town")],
        "id_1 string, id_2 string, category string, place string",
    )
    changed = overlay.apply_overlay(
        df, overlay.near_duplicate_overlay(specs), "project_id",
        ["category", "work_description"],
    )
    assert changed.columns == df.columns
    got = {r.project_id: (r.category, r.work_description) for r in changed.collect()}
    assert got == {
        "P1": ("Road", "road"),
        "P2": ("Bus Shelter", "Construction of bus shelter at Main Stop"),
        "P3": ("Bus Shelter", "Construction of bus shelter in Main Stop"),
        "P4": ("Library", "Construction of library in Town"),
    }
    both = overlay.append_projects(df, changed.select(*reversed(df.columns)))
    assert both.columns == df.columns and both.count() == 8
    counts = [tuple(r) for r in reads.category_counts(both).collect()]
    assert counts == [("Road", 5), ("Bus Shelter", 2), ("Library", 1)]
    with pytest.raises(ValueError, match=r"\['category', 'state'\]"):
        overlay.append_projects(df.drop("state", "category"), df)


def test_display_fallbacks(spark):
    df = spark.createDataFrame(
        [
            ("d", "s", "a | b ||c ", True, None),
            ("d", "", None, None, "x"),
            (None, "s", "", False, "x"),
            ("", None, None, None, "here"),
            (None, None, None, None, ""),
        ],
        "district string, state string, risk_reasons string, cost_anomaly boolean, "
        "location string",
    )
    rows = df.select(location_text(df), shown_reasons(df)).collect()
    general = ["Multiple risk signals require review."]
    assert [tuple(r) for r in rows] == [
        ("d, s", ["a", "b", "c"]),
        ("d", general),
        ("s", []),
        ("here", general),
        ("Location unavailable", general),
    ]
    flags = spark.createDataFrame(
        [("High", True, None, None), ("Low", None, True, True)],
        "cost_risk string, delay_anomaly boolean, duplicate_anomaly boolean, "
        "spending_anomaly boolean",
    )
    assert [r[0] for r in flags.select(flag_reasons(flags)).collect()] == [
        ["Potential cost anomaly", "Potential execution delay"],
        ["Potentially similar or duplicate work", "Unusual spending pattern"],
    ]
    named = spark.createDataFrame([("n", None)], "work string, description string")
    assert named.select(first_of(named, "work_description", F.lit("?"))).first()[0] == "n"
    assert named.select(first_of(named, "risk_level", F.lit("High"))).first()[0] == "High"


def test_stored_frames_leave_no_shuffle_files(spark, monkeypatch):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    before = spark.conf.get(scratch.SHUFFLE_CLEANUP)

    def files():
        return {name for name in disk.getAllBlocks().mkString(" ").split() if name.startswith("shuffle_")}

    earlier = files()
    frame = spark.range(5000).selectExpr("id % 70 AS k", "id").groupBy("k").count().orderBy("count", "k")
    found = scratch.stored(frame, "counts")
    limit = time.time() + 20
    while files() - earlier and time.time() < limit:  # executors remove them on their own
        time.sleep(0.2)
    assert not files() - earlier
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == before
    assert found.count() == 70
