
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from importlib.util import find_spec

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import worksight_sql  # noqa: E402
from worksight.functions.display import flag_reasons  # noqa: E402
from worksight.functions.numeric import round_scaled  # noqa: E402
from worksight.operators import overlay, profile, signals, similarity  # noqa: E402
from worksight.plans import investigation, reads, reports, risk  # noqa: E402
from worksight.plans.sample_views import part_projects, supplier_projects  # noqa: E402
from worksight.sources import schema, scratch, snapshots, tables  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"

# Batch results that several read queries share, as they would in production: one
# stored table per application and data folder.
_batch: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _batch:
        _batch[key] = make()
    return _batch[key]


def _ordered_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project table with its row order, derived from the raw tables once."""

    return _once(
        spark,
        sf_dir,
        "projects",
        lambda: scratch.stored(part_projects(spark, sf_dir), "projects"),
    )


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered_projects(spark, sf_dir).drop("row_seq")


def _similar_parts(spark: SparkSession, sf_dir: str) -> similarity.SimilarWorks:
    return _once(
        spark,
        sf_dir,
        "similar-parts",
        lambda: similarity.find_similar_works(
            _ordered_projects(spark, sf_dir), order_col="row_seq"
        ),
    )


def _similar_documents(spark: SparkSession, sf_dir: str) -> similarity.SimilarWorks:
    return _once(
        spark,
        sf_dir,
        "similar-documents",
        lambda: similarity.find_similar_works(
            _documents(spark, sf_dir), id_col="doc_id", group_col="source", text_col="text"
        ),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk table, scored and written once, then read back."""

    def write() -> str:
        scored = risk.score_projects(
            _projects(spark, sf_dir), similar=_similar_parts(spark, sf_dir)
        )
        path = scratch.output_path(spark, "risk-table")
        tables.write_risk_table(scored, path)
        return path

    return tables.load_risk_table(spark, _once(spark, sf_dir, "risk", write))


def _rounded_stats(df: DataFrame) -> DataFrame:
    """Statistics whose last bits depend on the order of summation, rounded."""
    stats = {
        "category_avg_expenditure_lakh": 4,
        "category_std_expenditure_lakh": 4,
        "spending_zscore": 6,
    }
    return df.withColumns({c: round_scaled(F.col(c), n) for c, n in stats.items()})


# --- tables and checks -------------------------------------------------------------


def project_table(spark, sf_dir):
    return part_projects(spark, sf_dir).drop("row_seq")


def dataset_shape(spark, sf_dir):
    return profile.shape(_projects(spark, sf_dir))


def dataset_head(spark, sf_dir):
    return profile.head(_ordered_projects(spark, sf_dir), "row_seq").drop("row_seq")


def numeric_profile(spark, sf_dir):
    return profile.numeric_profile(_projects(spark, sf_dir))


def repeated_line_keys(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return schema.duplicate_keys(lines, "l_orderkey", "l_linenumber")


def csv_round_trip(spark, sf_dir):
    path = scratch.output_path(spark, "projects-csv")
    tables.write_csv(_projects(spark, sf_dir), path)
    return tables.read_csv(spark, path)


def _surveyed(spark, sf_dir):
    """Projects with columns of another survey, which no layout names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    survey = part.select(
        F.col("p_partkey").cast("string").alias("project_id"),
        F.col("p_size").alias("site_size"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("site_price"),
        (F.col("p_size") > 25).alias("large_site"),
        F.concat("p_name", F.lit(", "), "p_brand").alias("location"),
    )
    return _projects(spark, sf_dir).join(survey, "project_id")


def csv_extra_columns(spark, sf_dir):
    path = scratch.output_path(spark, "surveyed-csv")
    tables.write_csv(_surveyed(spark, sf_dir), path)
    return tables.read_csv(spark, path)


def csv_row_numbers(spark, sf_dir):
    """Rows of a folder of files, numbered in the order of the files."""
    path = scratch.output_path(spark, "ordered-csv")
    ordered = _ordered_projects(spark, sf_dir).repartitionByRange(5, "row_seq")
    tables.write_csv(ordered.sortWithinPartitions("row_seq").drop("row_seq"), path)
    return tables.read_csv(spark, path, with_row_seq=True).select("project_id", "row_seq")


def _faulty_csv(spark, sf_dir):
    """Signals as CSV lines of which some lack a cell, have one too many or a wrong one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    line = F.concat_ws(",", key, F.col("p_size") + 50, F.col("p_size") % 9)
    line = F.when(key % 11 == 0, line).otherwise(F.concat(line, F.lit(",True")))
    line = F.when(key % 13 == 0, F.concat(line, F.lit(",?"))).otherwise(line)
    line = F.when(key % 17 == 0, F.regexp_replace(line, ",", ",n")).otherwise(line)
    path = scratch.output_path(spark, "faulty-csv")
    whole = part.select(line.alias(",".join(schema.SIGNAL_SCHEMA.names)))
    whole.write.option("header", True).option("sep", "\x01").csv(path)
    return tables.read_csv_checked(spark, path, schema.SIGNAL_SCHEMA)


def csv_sound_rows(spark, sf_dir):
    return _once(spark, sf_dir, "faulty", lambda: _faulty_csv(spark, sf_dir)).rows


def csv_faults(spark, sf_dir):
    checked = _once(spark, sf_dir, "faulty", lambda: _faulty_csv(spark, sf_dir))
    return checked.faults.select("record", "reason")


def signal_csv_round_trip(spark, sf_dir):
    path = scratch.output_path(spark, "signals-csv")
    tables.write_csv(part_duplicate_signals(spark, sf_dir), path)
    return tables.read_csv(spark, path, schema.SIGNAL_SCHEMA)


def table_versions(spark, sf_dir):
    """Two versions of a table, read while the newer one is there: rows and sums of each."""
    path = scratch.output_path(spark, "versions")
    projects = _projects(spark, sf_dir)
    snapshots.publish(projects.where("planned_duration_days < 200"), path)
    old = snapshots.load(spark, path)
    snapshots.publish(projects, path)

    def figures(df, version):
        return df.agg(
            F.lit(version).cast("long").alias("version"),
            F.count("*").alias("n_rows"),
            F.sum("elapsed_days").alias("elapsed_days"),
        )

    return figures(old, 1).unionByName(figures(snapshots.load(spark, path), 2))


def overlay_update(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    key = F.col("n_nationkey")
    specs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (key * 30 + 1).cast("string").alias("id_1"),
        (key * 30 + 2).cast("string").alias("id_2"),
        F.col("r_name").alias("category"),
        F.col("n_name").alias("place"),
    )
    return overlay.apply_overlay(
        _projects(spark, sf_dir),
        overlay.near_duplicate_overlay(specs),
        "project_id",
        ["category", "work_description"],
    ).select("project_id", "category", "work_description", "expenditure_lakh")


def appended_projects(spark, sf_dir):
    return overlay.append_projects(
        _projects(spark, sf_dir), supplier_projects(spark, sf_dir)
    )


def appended_category_counts(spark, sf_dir):
    return reads.category_counts(appended_projects(spark, sf_dir))


# --- detectors ---------------------------------------------------------------------


def _costs(spark, sf_dir):
    return signals.with_cost_signal(_projects(spark, sf_dir)).select(*reports.COST_REPORT)


def cost_anomalies(spark, sf_dir):
    return reports.rounded(_costs(spark, sf_dir))


def cost_report_lines(spark, sf_dir):
    return reports.cost_lines(_costs(spark, sf_dir))


def _delays(spark, sf_dir):
    return signals.with_delay_signal(_projects(spark, sf_dir)).select(
        *reports.DELAY_REPORT
    )


def delay_anomalies(spark, sf_dir):
    return reports.rounded(_delays(spark, sf_dir))


def delay_report_lines(spark, sf_dir):
    return reports.delay_lines(_delays(spark, sf_dir))


def _spending(spark, sf_dir):
    return signals.with_spending_signal(_projects(spark, sf_dir)).select(
        *reports.SPENDING_REPORT
    )


def spending_zscores(spark, sf_dir):
    return _rounded_stats(_spending(spark, sf_dir))


def spending_top20(spark, sf_dir):
    return reports.rounded(reads.top_spending(_spending(spark, sf_dir)))


def spending_report_lines(spark, sf_dir):
    return reports.spending_lines(_spending(spark, sf_dir))


# --- similar work ------------------------------------------------------------------


def _work_pairs(similar: similarity.SimilarWorks) -> DataFrame:
    return similar.pairs.select(
        F.col("work_1").alias("project_1"),
        F.col("work_2").alias("project_2"),
        "category",
        "similarity_pct",
        F.col("n_1").alias("projects_1"),
        F.col("n_2").alias("projects_2"),
        (F.col("n_1") * F.col("n_2")).alias("n_pairs"),
    )


def similar_part_works(spark, sf_dir):
    return _work_pairs(_similar_parts(spark, sf_dir))


def similar_document_works(spark, sf_dir):
    return _work_pairs(_similar_documents(spark, sf_dir))


def similar_part_classes(spark, sf_dir):
    return similarity.similar_classes(_similar_parts(spark, sf_dir))


def similar_document_classes(spark, sf_dir):
    return similarity.similar_classes(_similar_documents(spark, sf_dir))


def part_copy_groups(spark, sf_dir):
    return similarity.copy_groups(_similar_parts(spark, sf_dir))


def document_copy_groups(spark, sf_dir):
    return similarity.copy_groups(_similar_documents(spark, sf_dir))


def part_pair_count(spark, sf_dir):
    return similarity.pair_count(_similar_parts(spark, sf_dir))


def document_pair_count(spark, sf_dir):
    return similarity.pair_count(_similar_documents(spark, sf_dir))


def top_similar_parts(spark, sf_dir):
    return similarity.top_pairs(
        _similar_parts(spark, sf_dir), _projects(spark, sf_dir)
    )


def top_similar_documents(spark, sf_dir):
    return similarity.top_pairs(
        _similar_documents(spark, sf_dir),
        _documents(spark, sf_dir),
        id_col="doc_id",
        text_col="text",
    )


def described_part_pairs(spark, sf_dir):
    return similarity.described_pairs(_similar_parts(spark, sf_dir), _projects(spark, sf_dir))


def part_duplicate_signals(spark, sf_dir):
    return similarity.project_signals(_similar_parts(spark, sf_dir))


def document_duplicate_signals(spark, sf_dir):
    return similarity.project_signals(_similar_documents(spark, sf_dir))


def pairs_of_no_category(spark, sf_dir):
    """Projects without a category take no part: a typed result without rows."""
    none = _ordered_projects(spark, sf_dir).where(F.col("category").isNull())
    return _work_pairs(similarity.find_similar_works(none, order_col="row_seq"))


def blanked_document_signals(spark, sf_dir):
    """Signals where the texts of one language are empty and those of another missing."""
    lang = F.col("lang")
    text = F.when(lang == "de", "").when(lang == "fr", None).otherwise(F.col("text"))
    similar = similarity.find_similar_works(
        _documents(spark, sf_dir).withColumn("text", text),
        id_col="doc_id",
        group_col="source",
        text_col="text",
    )
    return similarity.project_signals(similar)


def signals_of_pairs(spark, sf_dir):
    """Signals from a whole pair table, here the pairs of different works of documents."""
    pairs = _similar_documents(spark, sf_dir).pairs
    return similarity.pair_signals(
        pairs.withColumnsRenamed({"work_1": "project_1", "work_2": "project_2"})
    )


# --- risk --------------------------------------------------------------------------


def risk_scores(spark, sf_dir):
    scored = risk.score_projects(
        _projects(spark, sf_dir), similar=_similar_parts(spark, sf_dir)
    )
    return _rounded_stats(scored)


def risk_from_stored_signals(spark, sf_dir):
    merged = risk.merge_signals(
        _projects(spark, sf_dir),
        similarity.project_signals(_similar_parts(spark, sf_dir)),
        signals.with_spending_signal(_projects(spark, sf_dir)),
    )
    return _rounded_stats(merged)


def observed_merge(spark, sf_dir):
    """What the pass that wrote merged signals counted, its keys found unique."""
    merged = risk.checked_merge(
        _projects(spark, sf_dir),
        similarity.project_signals(_similar_parts(spark, sf_dir)),
        signals.with_spending_signal(_projects(spark, sf_dir)),
    )
    tables.write_risk_table(merged.table, scratch.output_path(spark, "merged-risk"))
    row = spark.range(1)
    counts = {name: F.lit(n).cast("long") for name, n in merged.verify().items()}
    return row.select(*(value.alias(name) for name, value in counts.items()))


def risk_summary(spark, sf_dir):
    return reads.summary(_risk(spark, sf_dir))


def risk_distribution(spark, sf_dir):
    return reads.distribution(_risk(spark, sf_dir))


def category_counts(spark, sf_dir):
    return reads.category_counts(_risk(spark, sf_dir))


def top10_risks(spark, sf_dir):
    return reads.top_risks(_risk(spark, sf_dir))


def projects_listed(spark, sf_dir):
    return _rounded_stats(reads.projects(_risk(spark, sf_dir)))


def projects_filtered(spark, sf_dir):
    listed = reads.projects(_risk(spark, sf_dir), "mEdIuM", "promo", limit=500)
    return _rounded_stats(listed)


def high_risk_projects(spark, sf_dir):
    return _rounded_stats(reads.high_risk(_risk(spark, sf_dir)))


def project_lookup(spark, sf_dir):
    return _rounded_stats(reads.project(_risk(spark, sf_dir), "42"))


def review_queue(spark, sf_dir):
    return investigation.review_queue(_risk(spark, sf_dir))


def investigation_view(spark, sf_dir):
    view = investigation.investigation_view(_risk(spark, sf_dir))
    return view.withColumn("reasons", F.array_join("reasons", "; "))


def aliased_investigation_view(spark, sf_dir):
    """The case view of a table with other column names, a place instead of district and state."""
    table = (
        _risk(spark, sf_dir)
        .drop("district", "state")
        .withColumn("location", F.concat("category", F.lit(" works")))
        .withColumnsRenamed(
            {
                "project_id": "id",
                "risk_score": "score",
                "risk_level": "risk",
                "work_description": "work_name",
            }
        )
    )
    view = investigation.investigation_view(table)
    return view.withColumn("reasons", F.array_join("reasons", "; "))


def flag_reason_texts(spark, sf_dir):
    flagged = signals.with_delay_signal(
        signals.with_cost_signal(signals.with_spending_signal(_projects(spark, sf_dir)))
    )
    reasons = F.array_join(flag_reasons(flagged), "; ")
    return flagged.select("project_id", reasons.alias("reasons"))


def entry(spark: SparkSession) -> DataFrame:
    """The ten riskiest projects with their reasons, scored from the raw tables."""
    return top10_risks(spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries by name; each takes (spark, sf_dir)."""
    registered = [
        project_table,
        dataset_shape,
        dataset_head,
        numeric_profile,
        repeated_line_keys,
        csv_round_trip,
        csv_extra_columns,
        csv_row_numbers,
        csv_sound_rows,
        csv_faults,
        signal_csv_round_trip,
        table_versions,
        overlay_update,
        appended_projects,
        appended_category_counts,
        cost_anomalies,
        cost_report_lines,
        delay_anomalies,
        delay_report_lines,
        spending_zscores,
        spending_top20,
        spending_report_lines,
        similar_part_works,
        similar_part_classes,
        part_copy_groups,
        part_pair_count,
        top_similar_parts,
        described_part_pairs,
        part_duplicate_signals,
        pairs_of_no_category,
        blanked_document_signals,
        signals_of_pairs,
        similar_document_works,
        similar_document_classes,
        document_copy_groups,
        document_pair_count,
        top_similar_documents,
        document_duplicate_signals,
        risk_scores,
        risk_from_stored_signals,
        observed_merge,
        risk_summary,
        risk_distribution,
        category_counts,
        top10_risks,
        projects_listed,
        projects_filtered,
        high_risk_projects,
        project_lookup,
        review_queue,
        investigation_view,
        aliased_investigation_view,
        flag_reason_texts,
    ]
    return {query.__name__: query for query in registered} | _llm_queries()


def oracle_sql() -> dict[str, str]:
    """The same results as SQL over the same tables."""
    return worksight_sql.statements() | _llm_sql()


# --- training-data operators, present only with their subpackage --------------------


def _llm_here() -> bool:
    """Whether both the subpackage and the pipeline are there; their own errors show."""
    return all(find_spec(name) is not None for name in ("corpus_pipeline", "worksight.llm"))


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not _llm_here():
        return {}
    import corpus_pipeline
    from worksight.llm import queries as llm_queries

    return llm_queries.queries() | {"pipeline": corpus_pipeline.run}


def _llm_sql() -> dict[str, str]:
    if not _llm_here():
        return {}
    import corpus_pipeline
    from worksight.llm import queries as llm_queries

    sql = corpus_pipeline.ORACLE_SQL
    return llm_queries.oracle_sql() | ({"pipeline": sql} if sql else {})
