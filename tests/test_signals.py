import math

import pytest

from fixtures import SAMPLE_RESULTS, projects, sample_projects
from worksight.operators import keyed_join
from worksight.operators.signals import (
    category_spending,
    with_cost_signal,
    with_delay_signal,
    with_spending_signal,
)
from worksight.plans import reports
from worksight.sources.scratch import stored


def _by_id(df, *columns):
    return {r.project_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_sample_cost_and_delay(spark):
    df = with_delay_signal(with_cost_signal(sample_projects(spark)))
    got = _by_id(
        df, "sanction_overrun_pct", "estimate_deviation_pct", "delay_pct",
        "cost_anomaly", "delay_anomaly",
    )
    for key, expected in SAMPLE_RESULTS.items():
        assert got[key][:3] == pytest.approx(expected[:3], abs=5e-5)
        flagged = key in ("P1004", "P1007", "P1013")
        assert got[key][3:] == (flagged, flagged)


def test_cost_edges(spark):
    df = projects(
        spark,
        {"project_id": "zero", "sanctioned_amount_lakh": 0.0},
        {"project_id": "none", "sanctioned_amount_lakh": 0.0, "expenditure_lakh": 0.0},
        {"project_id": "at20", "expenditure_lakh": 12.0},
        {"project_id": "at25", "expenditure_lakh": 12.5, "sanctioned_amount_lakh": 12.5},
        {"project_id": "over25", "expenditure_lakh": 12.51, "sanctioned_amount_lakh": 12.5},
        {"project_id": "null", "expenditure_lakh": None},
        {"project_id": "nan", "expenditure_lakh": math.nan},
        {"project_id": "half", "expenditure_lakh": 30.0, "sanctioned_amount_lakh": None},
    )
    got = _by_id(with_cost_signal(df), "sanction_overrun_pct", "cost_anomaly")
    assert got["zero"] == (math.inf, True)
    assert got["none"][0] is None and got["none"][1] is False
    assert got["at20"] == (20.0, False)
    assert got["at25"][1] is False
    assert got["over25"][1] is True
    assert got["null"] == (None, False)
    assert got["nan"] == (None, False)
    assert got["half"] == (None, True)


def test_delay_edges(spark):
    df = projects(
        spark,
        {"project_id": "at20", "elapsed_days": 120},
        {"project_id": "status", "current_status": "DELAYED"},
        {"project_id": "spaces", "current_status": " delayed "},
        {"project_id": "noplan", "planned_duration_days": 0},
        {"project_id": "null", "elapsed_days": None, "current_status": None},
    )
    got = _by_id(with_delay_signal(df), "delay_days", "delay_pct", "delay_anomaly")
    assert got["at20"] == (20, 20.0, False)
    assert got["status"] == (0, 0.0, True)
    assert got["spaces"] == (0, 0.0, False)
    assert got["noplan"] == (100, math.inf, True)
    assert got["null"] == (None, None, False)


def _spending_rows():
    rows = [{"project_id": f"r{i}", "expenditure_lakh": 10.0} for i in range(5)]
    rows += [
        {"project_id": "alone", "category": "Library"},
        {"project_id": "nocat", "category": None, "expenditure_lakh": 900.0},
        {"project_id": "nospend", "category": "Hall", "expenditure_lakh": None},
        {"project_id": "h1", "category": "Hall", "expenditure_lakh": 1.0},
        {"project_id": "h2", "category": "Hall", "expenditure_lakh": 3.0},
    ]
    # four at 0 and one at 5: mean 1, sample deviation sqrt(5), z of the last 4/sqrt(5)
    rows += [
        {"project_id": f"z{i}", "category": "Z", "expenditure_lakh": 5.0 * (i == 4)}
        for i in range(5)
    ]
    # z exactly 2: six at -1 and two at 3 scaled so that (x - mean) / std = 2
    return rows


@pytest.mark.parametrize("task_rows", [None, 1_000_000, 3, 1])
def test_spending(spark, monkeypatch, task_rows):
    """The same results by a plain join and by the spread of hot categories."""
    df = projects(spark, *_spending_rows())
    stats = None
    if task_rows:
        monkeypatch.setattr(keyed_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(keyed_join, "TASK_ROWS", task_rows)
        stats = stored(category_spending(df), "category-spending")
    out = with_spending_signal(df, stats=stats)
    assert out.columns == df.columns + reports.SPENDING_REPORT[3:]
    got = _by_id(out, *reports.SPENDING_REPORT[3:])
    assert len(got) == df.count()
    assert got["r0"] == (10.0, 0.0, None, False)
    assert got["alone"] == (10.0, None, None, False)
    assert got["nocat"] == (None, None, None, False)
    assert got["nospend"] == (2.0, pytest.approx(math.sqrt(2)), None, False)
    assert got["h2"][2] == pytest.approx(1 / math.sqrt(2))
    assert got["z4"][2] == pytest.approx(4 / math.sqrt(5))


def test_spending_plan_starts_no_job(spark):
    df = sample_projects(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spending-plan", "plan only")
    with_spending_signal(df)
    assert list(tracker.getJobIdsForGroup("spending-plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_inner_attach_is_an_inner_join(spark, monkeypatch):
    """Rows without a key in the table can be dropped before the shuffle, by a Bloom filter."""
    monkeypatch.setattr(keyed_join, "TASK_ROWS", 5)
    rows = spark.range(400).selectExpr("id", "id % 40 AS k").filter("id % 3 < 2")
    table = stored(spark.range(7).selectExpr("id AS k", "10L AS n", "id * 2 AS v"), "small")
    joined = keyed_join.attach(rows, table, ["k"], "n", "id", "inner", small=False)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan
    expected = {(r, r % 40, r % 40 * 2) for r in range(400) if r % 3 < 2 and r % 40 < 7}
    assert {(r.id, r.k, r.v) for r in joined.collect()} == expected


def test_sample_zscores(spark):
    got = _by_id(with_spending_signal(sample_projects(spark)), "spending_zscore")
    for key, expected in SAMPLE_RESULTS.items():
        if expected[3] is None:
            assert got[key] == (None,)
        else:
            assert got[key][0] == pytest.approx(expected[3], abs=5e-5)


def test_report_lines(spark):
    df = with_delay_signal(with_cost_signal(sample_projects(spark)))
    costs = {r.line for r in reports.cost_lines(df).collect()}
    assert (
        "P1004 | Community Hall | Expenditure: ₹43.50L | Sanction overrun: 61.1% | "
        "Estimate deviation: 67.3%"
    ) in costs
    delays = {r.line for r in reports.delay_lines(df).collect()}
    assert "P1007 | Status: Delayed | Delay: 150 days | Delay: 62.5%" in delays
    assert len(costs) == len(delays) == 3
