import pytest
from pyspark.sql import functions as F

from fixtures import SAMPLE_RESULTS, projects, sample_projects
from worksight.operators.scoring import with_scores
from worksight.operators.signals import with_spending_signal
from worksight.operators.similarity import find_similar_works, project_signals
from worksight.plans import investigation, reads, risk
from worksight.sources import schema
from worksight.sources.schema import PROJECT_SCHEMA, RISK_COLUMNS
from worksight.sources.tables import load_risk_table, write_risk_table

SCORES = ["cost_score", "delay_score", "duplicate_score", "spending_score"]


@pytest.fixture(scope="module")
def sample_risk(spark):
    return risk.score_projects(sample_projects(spark)).cache()


def test_sample_scores(sample_risk):
    assert sample_risk.columns == PROJECT_SCHEMA.names + RISK_COLUMNS
    rows = {r.project_id: r for r in sample_risk.collect()}
    for key, expected in SAMPLE_RESULTS.items():
        row = rows[key]
        assert [row[c] for c in SCORES] == pytest.approx(expected[4:8])
        assert row.risk_score == pytest.approx(expected[8])
        assert row.risk_level == expected[9]
    assert rows["P1004"].risk_reasons == (
        "Cost overrun of 61.1% above sanctioned amount | "
        "Project duration exceeds plan by 75.0% | "
        "Similar work description detected (86.6% similarity) | "
        "Expenditure is unusually high for the Community Hall category (z-score: 1.00)"
    )
    assert rows["P1002"].risk_reasons == "No major anomaly signals detected"
    alone = rows["P1010"]
    assert alone.spending_zscore == 0 and alone.category_std_expenditure_lakh is None


def test_merge_of_stored_signals_is_the_same(spark, sample_risk):
    df = sample_projects(spark)
    merged = risk.merge_signals(
        df, project_signals(find_similar_works(df)), with_spending_signal(df)
    )
    assert merged.columns == sample_risk.columns
    assert sorted(merged.collect(), key=str) == sorted(sample_risk.collect(), key=str)


def test_missing_columns_are_named(spark):
    df = sample_projects(spark)
    with pytest.raises(ValueError, match="category.*elapsed_days"):
        risk.score_projects(df.drop("elapsed_days", "category"))
    with pytest.raises(ValueError, match="duplicate_signal"):
        risk.merge_signals(
            df,
            spark.createDataFrame(
                [], "project_id string, max_similarity_pct double, similar_project_count long"
            ),
            with_spending_signal(df),
        )


def _scored(spark, overrun=None, delay=None, similarity=0.0, z=0.0):
    df = spark.createDataFrame(
        [("Road", overrun, delay, similarity, z)],
        "category string, sanction_overrun_pct double, delay_pct double, "
        "max_similarity_pct double, spending_zscore double",
    )
    return with_scores(df).first()


def test_score_edges(spark):
    row = _scored(spark, overrun=float("inf"), delay=1.25)
    assert (row.cost_score, row.delay_score, row.risk_score) == (30.0, 0.62, 30.62)
    assert row.risk_reasons == (
        "Cost overrun of inf% above sanctioned amount | "
        "Project duration exceeds plan by 1.2%"
    )
    row = _scored(spark, overrun=0.005)
    assert row.cost_score == 0 and row.risk_reasons.startswith("No major")
    assert _scored(spark, z=2.0).spending_score == 10.0
    assert _scored(spark, similarity=80.0).risk_reasons.startswith("No major")
    levels = [
        (_scored(spark, overrun=60.0, similarity=89.99), 39.99, "Low"),
        (_scored(spark, overrun=60.0, similarity=90.0), 40.0, "Medium"),
        (_scored(spark, overrun=60.0, delay=60.0, similarity=89.99), 69.99, "Medium"),
        (_scored(spark, overrun=60.0, delay=60.0, similarity=90.0), 70.0, "High"),
        (_scored(spark, overrun=99.0, delay=99.0, similarity=100.0, z=9.0), 100.0, "High"),
    ]
    for row, score, level in levels:
        assert (row.risk_score, row.risk_level) == (score, level)


def test_no_category_is_still_scored(spark):
    df = projects(spark, {"category": None, "elapsed_days": 160}, {"project_id": "B"})
    rows = {r.project_id: r for r in risk.score_projects(df).collect()}
    assert rows["A1"].delay_score == 30.0 and rows["A1"].spending_zscore == 0
    assert rows["A1"].duplicate_signal is False


@pytest.fixture(scope="module")
def stored_risk(spark, sample_risk, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("risk") / "table")
    write_risk_table(sample_risk, path)
    return load_risk_table(spark, path)


def test_read_queries(stored_risk, sample_risk):
    for table in (stored_risk, sample_risk):
        assert reads.summary(table).first().asDict() == {
            "total_projects": 15, "high_risk": 1, "medium_risk": 2, "low_risk": 12,
        }
        levels = [(r.risk_level, r.n_projects) for r in reads.distribution(table).collect()]
        assert levels == [("High", 1), ("Medium", 2), ("Low", 12)]
        listed = reads.projects(table, risk_level="mEdium").collect()
        assert [r.project_id for r in listed] == ["P1013", "P1007"]
        listed = reads.projects(table, "", "ROAD", limit=2)
        assert listed.columns == sample_risk.columns
        assert [r.project_id for r in listed.collect()] == ["P1009", "P1005"]
        assert [r.project_id for r in reads.high_risk(table).collect()] == ["P1004"]
        assert reads.project_row(table, "p1004")["risk_score"] == pytest.approx(71.56)
        top = reads.top_risks(table, 3).collect()
        assert [r.project_id for r in top] == ["P1004", "P1013", "P1007"]
        counts = [tuple(r) for r in reads.category_counts(table).collect()]
        assert counts[0] == ("Community Hall", 5) and counts[-1] == ("Health Facility", 1)


def test_read_errors(stored_risk):
    with pytest.raises(ValueError, match="unknown level"):
        reads.projects(stored_risk, risk_level="x")
    for limit in (0, 501):
        with pytest.raises(ValueError, match="limit"):
            reads.high_risk(stored_risk, limit)
    with pytest.raises(LookupError, match="P9"):
        reads.project_row(stored_risk, "P9")
    assert reads.projects(stored_risk, category="no such").collect() == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_plans_prune(stored_risk):
    """Level by partition, category and id by pushed equality, top-k without a full sort."""
    plan = _plan(reads.projects(stored_risk, "High", "Road"))
    assert "TakeOrderedAndProject" in plan
    assert "PartitionFilters: [isnotnull(risk_level" in plan
    assert "EqualTo(category_key,road)" in plan
    assert "EqualTo(project_id_key,P1)" in _plan(reads.project(stored_risk, "p1"))
    summary = _plan(reads.summary(stored_risk))
    assert "ReadSchema: struct<>" in summary


def test_investigation(spark, sample_risk):
    view = investigation.investigation_view(sample_risk)
    row = view.where("project_id = 'P1004'").first()
    assert row.location == "Location unavailable"
    assert row.score_text == "71.56" and row.cost_bar == 30.0
    assert row.cost_share_pct == 100.0
    assert row.expenditure_text == "₹43.50 L" and row.overrun_text == "61.11%"
    assert row.delay_text == "180 days" and row.delay_pct_text == "75.00%"
    assert row.similarity_text == "86.58%" and row.similar_projects_text == "1"
    assert len(row.reasons) == 4
    queue = investigation.review_queue(sample_risk).collect()
    assert [(r.place, r.project_id) for r in queue] == [("01", "P1004")]


def test_queue_numbers_beyond_99(spark, sample_risk):
    many = sample_risk.where("risk_level = 'High'").crossJoin(
        spark.range(120).withColumnRenamed("id", "n")
    )
    many = many.withColumn("project_id", F.format_string("Q%03d", "n")).drop("n")
    places = [r.place for r in investigation.review_queue(many, 500).collect()]
    assert places[:2] == ["01", "02"] and places[99] == "100" and len(places) == 120


def test_merge_refuses_repeated_keys(spark):
    """Counts of the pass itself tell; the exact check only names the keys."""
    projects_ = sample_projects(spark)
    spending = with_spending_signal(projects_)
    ids = [r.project_id for r in projects_.orderBy("project_id").limit(2).collect()]
    once = [(ids[0], 90.0, 1, True), ("other", 80.0, 1, True), ("other", 80.0, 1, True)]
    sound = risk.checked_merge(projects_, spark.createDataFrame(once, schema.SIGNAL_SCHEMA), spending)
    sound.table.collect()
    n = projects_.count()
    figures = sound.verify()
    assert figures == {
        "n_projects": n, "n_with_signals": n, "n_with_spending": n, "null_keys": 0, "nan_cells": 0
    }
    twice = spark.createDataFrame([*once, once[0]], schema.SIGNAL_SCHEMA)
    faulty = risk.checked_merge(projects_, twice, spending)
    faulty.table.collect()
    with pytest.raises(ValueError, match=f"signal table repeats project_id, such as .*{ids[0]}"):
        faulty.verify()
    faulty = risk.checked_merge(projects_, twice.limit(0), spending.unionByName(spending.limit(1)))
    faulty.table.collect()
    with pytest.raises(ValueError, match="spending table repeats"):
        faulty.verify()
