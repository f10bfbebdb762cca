"""SQL counterparts of the registered queries, for comparison in DuckDB.

Written from the definitions, not from the Spark plans: windows instead of joined
statistics, plain all-term joins instead of the pruned ones, text formatting instead of
rounding arithmetic.
"""

from __future__ import annotations

from worksight.functions.text import STOP_WORDS, TOKEN_PATTERN
from worksight.sources.schema import PROJECT_SCHEMA, RISK_COLUMNS

# --- expressions -------------------------------------------------------------------


def _scaled(x: str, digits: int = 2) -> str:
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def _text(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


def _pct(part: str, whole: str) -> str:
    part, whole = f"({part})::DOUBLE", f"({whole})::DOUBLE"
    return (
        f"CASE WHEN {whole} <> 0 THEN {part} / {whole} * 100"
        f" WHEN {whole} = 0 AND {part} > 0 THEN 'inf'::DOUBLE"
        f" WHEN {whole} = 0 AND {part} < 0 THEN '-inf'::DOUBLE END"
    )


def _score(x: str, top: float, weight: float) -> str:
    rounded = f"printf('%.2f', {x} / {top}::DOUBLE * {weight})::DOUBLE"
    return (
        f"CASE WHEN {x} >= {top} THEN {weight}::DOUBLE"
        f" WHEN {x} > 0 THEN {rounded} ELSE 0::DOUBLE END"
    )


def _fixed(x: str) -> str:
    """Two decimals, ties of the exact binary value away from zero."""
    x = f"({x})::DOUBLE"
    tie = f"{x} * 8 = floor({x} * 8) AND abs({x} * 200) % 2 = 1"
    return (
        f"CASE WHEN {x} IS NULL THEN '-' WHEN {tie}"
        f" THEN printf('%.2f', {x} + sign({x}) * 0.001) ELSE printf('%.2f', {x}) END"
    )


def _percent(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN '-' ELSE {_fixed(x)} || '%' END"


def _bar(x: str) -> str:
    return f"greatest(0::DOUBLE, least(100::DOUBLE, coalesce({x}, 0)))"


# --- project views -----------------------------------------------------------------


def _dated(key: str, size: str) -> str:
    return f"""
        (120 + {key} % 201)::INTEGER AS planned_duration_days,
        (60 + ({key} * 7919) % 341)::INTEGER AS elapsed_days,
        (DATE '2024-01-01' + ({key} % 951)::INTEGER)::DATE AS start_date,
        (DATE '2024-01-01' + ({key} % 951)::INTEGER + (120 + {key} % 201)::INTEGER)::DATE
            AS expected_completion_date,
        CASE WHEN {size} > 45 THEN 'Delayed' WHEN {size} > 25 THEN 'In Progress'
             ELSE 'Completed' END AS current_status,
        8e0 + ({key} % 200) / 10e0 AS latitude,
        70e0 + ({key} % 150) / 10e0 AS longitude,
        'Agency ' || ({size} % 4)::VARCHAR AS implementing_agency"""


def _amounts(key: str) -> str:
    return f"""(
        SELECT {key} AS k,
            sum(l_quantity) FILTER (l_linestatus = 'F') AS done_quantity,
            sum(l_extendedprice) FILTER (l_returnflag = 'N') AS sanctioned,
            sum(l_extendedprice) FILTER (l_returnflag = 'A') AS spent
        FROM lineitem GROUP BY 1)"""


PROJ = f"""proj AS (
    SELECT p_partkey::VARCHAR AS project_id, p_brand AS mp_name,
        CASE WHEN p_size % 5 <> 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS state,
        CASE WHEN p_size % 7 <> 0 THEN split_part(p_name, ' ', -1) END AS district,
        p_type AS category, p_name || ' ' || p_brand AS work_description,
        {_scaled("p_retailprice * done_quantity")} AS estimated_cost_lakh,
        {_scaled("sanctioned")} AS sanctioned_amount_lakh,
        {_scaled("spent")} AS expenditure_lakh,
        least(100::DOUBLE, p_size * 2.5e0) AS physical_progress_pct,
        {_dated("p_partkey", "p_size")},
        p_partkey AS row_seq
    FROM part LEFT JOIN {_amounts("l_partkey")} ON k = p_partkey)"""

SUPP = f"""supp AS (
    SELECT 'S' || s_suppkey::VARCHAR AS project_id, s_name AS mp_name,
        n_name AS state, r_name AS district, r_name AS category,
        'Supply works of ' || lower(n_name) AS work_description,
        {_scaled("done_quantity * 1000")} AS estimated_cost_lakh,
        {_scaled("sanctioned")} AS sanctioned_amount_lakh,
        {_scaled("spent")} AS expenditure_lakh,
        least(100::DOUBLE, (s_suppkey % 50) * 2.5e0) AS physical_progress_pct,
        {_dated("s_suppkey", "(s_suppkey % 50)")}
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN {_amounts("l_suppkey")} ON k = s_suppkey)"""

COLUMNS = PROJECT_SCHEMA.names
ALL_COLUMNS = ", ".join(COLUMNS)

COST = f"""cost AS (
    SELECT *,
        coalesce(sanction_overrun_pct > 20, false)
            OR coalesce(estimate_deviation_pct > 25, false) AS cost_anomaly
    FROM (SELECT *,
        {_pct("expenditure_lakh - sanctioned_amount_lakh", "sanctioned_amount_lakh")}
            AS sanction_overrun_pct,
        {_pct("expenditure_lakh - estimated_cost_lakh", "estimated_cost_lakh")}
            AS estimate_deviation_pct
        FROM proj))"""

DELAY = f"""delay AS (
    SELECT *, coalesce(delay_pct > 20, false)
        OR coalesce(lower(current_status) = 'delayed', false) AS delay_anomaly
    FROM (SELECT *, elapsed_days - planned_duration_days AS delay_days,
        {_pct("elapsed_days - planned_duration_days", "planned_duration_days")}
            AS delay_pct
        FROM cost))"""

SPEND = """spend AS (
    SELECT *, coalesce(spending_zscore >= 2, false) AS spending_anomaly
    FROM (SELECT *,
        (expenditure_lakh - category_avg_expenditure_lakh)
            / nullif(category_std_expenditure_lakh, 0) AS spending_zscore
        FROM (SELECT *,
            avg(expenditure_lakh) OVER w AS category_avg_expenditure_lakh,
            stddev_samp(expenditure_lakh) OVER w AS category_std_expenditure_lakh
            FROM delay WINDOW w AS (PARTITION BY category))))"""

ROUNDED = f"""REPLACE (
    {_scaled("category_avg_expenditure_lakh", 4)} AS category_avg_expenditure_lakh,
    {_scaled("category_std_expenditure_lakh", 4)} AS category_std_expenditure_lakh,
    {_scaled("spending_zscore", 6)} AS spending_zscore)"""

DETECTORS = ", ".join([PROJ, COST, DELAY, SPEND])


# --- similarity --------------------------------------------------------------------


def _similarity(source: str) -> str:
    """CTEs tok, sim (project pairs), works from docs(id, seq, cat, txt) as ``source``."""
    stops = ", ".join(f"'{word}'" for word in STOP_WORDS)
    return f"""docs AS ({source}),
    tok AS MATERIALIZED (
        SELECT id, seq, cat, list_filter(
            regexp_extract_all(lower(coalesce(txt, '')), '{TOKEN_PATTERN}'),
            lambda w: w NOT IN ({stops})) AS words
        FROM docs WHERE cat IS NOT NULL),
    occ AS MATERIALIZED (
        SELECT id, seq, cat, term, count(*) AS tf FROM (
            SELECT id, seq, cat, unnest(list_concat(words, list_transform(
                range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term
            FROM tok) GROUP BY ALL),
    raw AS (
        SELECT id, seq, cat, term,
            tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x
        FROM occ JOIN (SELECT cat, count(*) AS n FROM tok GROUP BY 1) USING (cat)
            JOIN (SELECT cat, term, count(*) AS df FROM occ GROUP BY 1, 2)
            USING (cat, term)),
    unit AS MATERIALIZED (
        SELECT id, seq, cat, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x
        FROM raw),
    sim AS MATERIALIZED (
        SELECT a.id AS id_1, b.id AS id_2, a.seq AS seq_1, b.seq AS seq_2, a.cat AS cat,
            {_scaled("sum(a.x * b.x) * 100")} AS similarity_pct
        FROM unit a JOIN unit b ON a.cat = b.cat AND a.term = b.term AND a.seq < b.seq
        GROUP BY a.id, b.id, a.seq, b.seq, a.cat HAVING sum(a.x * b.x) >= 0.8e0),
    works AS (
        SELECT cat, array_to_string(words, ' ') AS words, arg_min(id, seq) AS first_id,
            count(*) AS n_projects
        FROM tok WHERE len(words) > 0 GROUP BY 1, 2),
    signals AS (
        SELECT id AS project_id, max(similarity_pct) AS max_similarity_pct,
            count(*) AS similar_project_count, true AS duplicate_signal
        FROM (SELECT id_1 AS id, similarity_pct FROM sim
            UNION ALL SELECT id_2, similarity_pct FROM sim) GROUP BY 1)"""


PART_DOCS = "SELECT project_id AS id, row_seq AS seq, category AS cat, work_description AS txt FROM proj"
TEXT_DOCS = "SELECT doc_id AS id, doc_id AS seq, source AS cat, text AS txt FROM documents"

BLANKED_DOCS = """SELECT doc_id AS id, doc_id AS seq, source AS cat,
    CASE lang WHEN 'de' THEN '' WHEN 'fr' THEN NULL ELSE text END AS txt FROM documents"""

WORK_PAIRS = """SELECT id_1 AS project_1, id_2 AS project_2, sim.cat AS category,
        similarity_pct, a.n_projects AS projects_1, b.n_projects AS projects_2,
        a.n_projects * b.n_projects AS n_pairs
    FROM sim JOIN works a ON a.first_id = id_1 JOIN works b ON b.first_id = id_2"""
COPY_GROUPS = """SELECT first_id AS first_project, cat AS category, n_projects,
        n_projects * (n_projects - 1) // 2 AS n_pairs, 100::DOUBLE AS similarity_pct
    FROM works WHERE n_projects > 1"""
CLASSES = """SELECT min_by(t.cat, t.seq) AS category, min_by(t.id, t.seq) AS class_id,
        count(DISTINCT t.words) AS n_works, count(*) AS n_projects,
        any_value(n_links) AS n_links, any_value(strongest_pct) AS strongest_pct
    FROM tok t
        JOIN (WITH RECURSIVE edges AS MATERIALIZED (
                SELECT seq_1 AS a, seq_2 AS b FROM sim UNION SELECT seq_2, seq_1 FROM sim),
            reach AS (SELECT a, b FROM edges
                UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
            SELECT a AS seq, min(b) AS root FROM reach GROUP BY 1) USING (seq)
        JOIN (WITH RECURSIVE edges AS MATERIALIZED (
                SELECT seq_1 AS a, seq_2 AS b FROM sim UNION SELECT seq_2, seq_1 FROM sim),
            reach AS (SELECT a, b FROM edges
                UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
            SELECT root, count(*) AS n_links, max(similarity_pct) AS strongest_pct
            FROM sim JOIN (SELECT a, min(b) AS root FROM reach GROUP BY 1) ON a = seq_1
            GROUP BY 1) USING (root)
    GROUP BY root"""
PAIR_COUNT = "SELECT count(*) AS n_pairs FROM sim"
TOP_20 = """SELECT id_1 AS project_1, id_2 AS project_2, sim.cat AS category,
        similarity_pct, a.txt AS description_1, b.txt AS description_2
    FROM sim JOIN docs a ON a.id = id_1 JOIN docs b ON b.id = id_2
    ORDER BY similarity_pct DESC, sim.cat, seq_1, seq_2 LIMIT 20"""
DESCRIBED_PAIRS = """SELECT id_1 AS project_1, id_2 AS project_2, sim.cat AS category,
        similarity_pct, x.txt AS description_1, y.txt AS description_2
    FROM sim JOIN works a ON a.first_id = id_1 JOIN works b ON b.first_id = id_2
        JOIN docs x ON x.id = id_1 JOIN docs y ON y.id = id_2"""
SIGNALS = "SELECT * FROM signals"
PAIR_SIGNALS = f"""SELECT id AS project_id, max(similarity_pct) AS max_similarity_pct,
        count(*) AS similar_project_count, true AS duplicate_signal
    FROM (SELECT unnest([project_1, project_2]) AS id, similarity_pct FROM ({WORK_PAIRS}))
    GROUP BY 1"""


# --- risk --------------------------------------------------------------------------

ALL_RISK = ", ".join(COLUMNS + list(RISK_COLUMNS))

RISK = f"""merged AS (
    SELECT spend.* REPLACE (coalesce(spending_zscore, 0) AS spending_zscore),
        coalesce(max_similarity_pct, 0) AS max_similarity_pct,
        coalesce(similar_project_count, 0) AS similar_project_count,
        coalesce(duplicate_signal, false) AS duplicate_signal
    FROM spend LEFT JOIN signals USING (project_id)),
    scored AS (
    SELECT *, {_score("sanction_overrun_pct", 60, 30)} AS cost_score,
        {_score("delay_pct", 60, 30)} AS delay_score,
        {_score("(max_similarity_pct - 80)", 20, 20)} AS duplicate_score,
        {_score("spending_zscore", 4, 20)} AS spending_score
    FROM merged),
    totalled AS (
    SELECT *, greatest(0, least(100, {_scaled(
        "cost_score + delay_score + duplicate_score + spending_score")})) AS risk_score
    FROM scored),
    risk AS MATERIALIZED (
    SELECT *, CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium'
            ELSE 'Low' END AS risk_level,
        coalesce(nullif(concat_ws(' | ',
            CASE WHEN cost_score > 0 THEN 'Cost overrun of '
                || {_text("sanction_overrun_pct", 1)} || '% above sanctioned amount' END,
            CASE WHEN delay_score > 0 THEN 'Project duration exceeds plan by '
                || {_text("delay_pct", 1)} || '%' END,
            CASE WHEN duplicate_score > 0 THEN 'Similar work description detected ('
                || {_text("max_similarity_pct", 1)} || '% similarity)' END,
            CASE WHEN spending_score > 0 THEN 'Expenditure is unusually high for the '
                || category || ' category (z-score: '
                || {_text("spending_zscore", 2)} || ')' END), ''),
            'No major anomaly signals detected') AS risk_reasons
    FROM totalled)"""

TOP_ORDER = "ORDER BY risk_score DESC NULLS LAST, project_id"

LOCATION = """coalesce(nullif(concat_ws(', ', nullif(district, ''), nullif(state, '')), ''),
    'Location unavailable')"""


def _case_columns() -> str:
    parts = []
    for name, weight in {"cost": 30, "delay": 30, "duplicate": 20, "spending": 20}.items():
        score = f"{name}_score"
        parts += [
            f"{_fixed(score)} AS {name}_score_text",
            f"{_bar(score)} AS {name}_bar",
            f"{score} / {weight}::DOUBLE * 100 AS {name}_share_pct",
        ]
    for name, column in {
        "estimated": "estimated_cost_lakh",
        "sanctioned": "sanctioned_amount_lakh",
        "expenditure": "expenditure_lakh",
    }.items():
        parts.append(f"'₹' || {_fixed(column)} || ' L' AS {name}_text")
    for name, column in {
        "overrun": "sanction_overrun_pct",
        "progress": "physical_progress_pct",
        "delay_pct": "delay_pct",
        "similarity": "max_similarity_pct",
    }.items():
        parts.append(f"{_percent(column)} AS {name}_text")
    parts += [
        "coalesce(current_status, '-') AS status_text",
        "coalesce(delay_days::VARCHAR, '-') || ' days' AS delay_text",
        "coalesce(similar_project_count::VARCHAR, '-') AS similar_projects_text",
        "replace(risk_reasons, ' | ', '; ') AS reasons",
    ]
    return ",\n".join(parts)


HEADING = f"""project_id, work_description AS description, {LOCATION} AS location,
    {_fixed("risk_score")} AS score_text, risk_level"""


def _profile() -> str:
    columns = COLUMNS[6:12]
    stats = {
        "count": "count({c})::DOUBLE",
        "mean": "avg({c})",
        "std": "stddev_samp({c})",
        "min": "min({c})::DOUBLE",
        "25%": "quantile_cont({c}::DOUBLE, 0.25)",
        "50%": "quantile_cont({c}::DOUBLE, 0.5)",
        "75%": "quantile_cont({c}::DOUBLE, 0.75)",
        "max": "max({c})::DOUBLE",
    }
    rows = [
        f"SELECT '{name}' AS stat, "
        + ", ".join(f"{_scaled(form.format(c=c))} AS {c}" for c in columns)
        + " FROM proj"
        for name, form in stats.items()
    ]
    return f"WITH {PROJ} " + " UNION ALL ".join(rows)


def statements() -> dict[str, str]:
    detectors = f"WITH {DETECTORS} "
    parts = f"WITH {PROJ}, {_similarity(PART_DOCS)} "
    texts = f"WITH {_similarity(TEXT_DOCS)} "
    risk = f"WITH {DETECTORS}, {_similarity(PART_DOCS)}, {RISK} "
    risk_rows = f"SELECT {ALL_RISK} FROM risk"
    rounded_rows = f"SELECT * {ROUNDED} FROM ({{rows}})"
    cost_report = (
        "project_id, category, estimated_cost_lakh, sanctioned_amount_lakh, "
        "expenditure_lakh"
    )
    spending_report = """project_id, category, expenditure_lakh,
        category_avg_expenditure_lakh, category_std_expenditure_lakh, spending_zscore,
        spending_anomaly"""
    return {
        "project_table": f"WITH {PROJ} SELECT {ALL_COLUMNS} FROM proj",
        "dataset_shape": f"""WITH {PROJ} SELECT count(*) AS n_rows,
            {len(COLUMNS)}::BIGINT AS n_columns, '{ALL_COLUMNS}' AS column_names
            FROM proj""",
        "dataset_head": f"WITH {PROJ} SELECT {ALL_COLUMNS} FROM proj ORDER BY row_seq LIMIT 5",
        "numeric_profile": _profile(),
        "repeated_line_keys": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows
            FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
        "csv_round_trip": f"""WITH {PROJ}
            SELECT {ALL_COLUMNS.replace(" state,", " nullif(state, '') AS state,")}
            FROM proj""",
        "csv_extra_columns": f"""WITH {PROJ}
            SELECT {ALL_COLUMNS.replace(" state,", " nullif(state, '') AS state,")},
                p_size::BIGINT AS site_size,
                CASE WHEN p_size % 7 != 0 THEN p_retailprice END AS site_price,
                p_size > 25 AS large_site, p_name || ', ' || p_brand AS location
            FROM proj JOIN part ON project_id = p_partkey::VARCHAR""",
        "csv_row_numbers": f"""WITH {PROJ} SELECT project_id,
            row_number() OVER (ORDER BY row_seq) - 1 AS row_seq FROM proj""",
        "csv_sound_rows": """SELECT p_partkey::VARCHAR AS project_id,
                (p_size + 50)::DOUBLE AS max_similarity_pct,
                (p_size % 9)::BIGINT AS similar_project_count, true AS duplicate_signal
            FROM part WHERE p_partkey % 11 != 0 AND p_partkey % 13 != 0
                AND p_partkey % 17 != 0""",
        "csv_faults": """SELECT * FROM (SELECT p_partkey || sep || p_size + 50 || sep || p_size % 9
                    || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE sep || 'True' END
                    || CASE WHEN p_partkey % 13 = 0 THEN sep || '?' ELSE '' END AS record,
                CASE WHEN (p_partkey % 11 = 0) != (p_partkey % 13 = 0)
                        THEN 'wrong number of cells'
                    WHEN p_partkey % 17 = 0
                        THEN 'not double: max_similarity_pct = n' || p_size + 50
                    WHEN p_partkey % 143 = 0 THEN 'not boolean: duplicate_signal = ?'
                END AS reason
            FROM (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN ',n' ELSE ',' END AS sep
                FROM part)) WHERE reason IS NOT NULL""",
        "signal_csv_round_trip": parts + SIGNALS,
        "table_versions": f"""WITH {PROJ} SELECT 1::BIGINT AS version, count(*) AS n_rows,
                sum(elapsed_days)::BIGINT AS elapsed_days
            FROM proj WHERE planned_duration_days < 200
            UNION ALL SELECT 2, count(*), sum(elapsed_days)::BIGINT FROM proj""",
        "described_part_pairs": parts + DESCRIBED_PAIRS,
        "observed_merge": f"""WITH {PROJ} SELECT count(*) AS n_projects,
                count(*) AS n_with_signals, count(*) AS n_with_spending,
                count(*) FILTER (project_id IS NULL) AS null_keys, 0::BIGINT AS nan_cells
            FROM proj""",
        "overlay_update": f"""WITH {PROJ}, specs AS (
            SELECT unnest([n_nationkey * 30 + 1, n_nationkey * 30 + 2])::VARCHAR AS id,
                unnest([' at ', ' in ']) AS link, r_name, n_name
            FROM nation JOIN region ON n_regionkey = r_regionkey)
            SELECT project_id, coalesce(r_name, category) AS category,
                coalesce('Construction of ' || lower(r_name) || link || n_name,
                    work_description) AS work_description, expenditure_lakh
            FROM proj LEFT JOIN specs ON id = project_id""",
        "appended_projects": f"""WITH {PROJ}, {SUPP} SELECT {ALL_COLUMNS} FROM proj
            UNION ALL SELECT {ALL_COLUMNS} FROM supp""",
        "appended_category_counts": f"""WITH {PROJ}, {SUPP}
            SELECT category, count(*) AS n_projects FROM (
                SELECT category FROM proj UNION ALL SELECT category FROM supp)
            WHERE category IS NOT NULL GROUP BY 1""",
        "cost_anomalies": detectors
        + f"""SELECT {cost_report},
            {_scaled("sanction_overrun_pct")} AS sanction_overrun_pct,
            {_scaled("estimate_deviation_pct")} AS estimate_deviation_pct, cost_anomaly
            FROM cost""",
        "cost_report_lines": detectors
        + f"""SELECT project_id, project_id || ' | ' || category || ' | Expenditure: ₹'
            || {_text("expenditure_lakh", 2)} || 'L | Sanction overrun: '
            || coalesce({_text("sanction_overrun_pct", 1)}, 'nan')
            || '% | Estimate deviation: '
            || coalesce({_text("estimate_deviation_pct", 1)}, 'nan') || '%' AS line
            FROM cost WHERE cost_anomaly""",
        "delay_anomalies": detectors
        + f"""SELECT project_id, current_status, planned_duration_days, elapsed_days,
            delay_days, {_scaled("delay_pct")} AS delay_pct, delay_anomaly FROM delay""",
        "delay_report_lines": detectors
        + f"""SELECT project_id, project_id || ' | Status: ' || current_status
            || ' | Delay: ' || delay_days || ' days | Delay: '
            || {_text("delay_pct", 1)} || '%' AS line FROM delay WHERE delay_anomaly""",
        "spending_zscores": detectors
        + rounded_rows.format(rows=f"SELECT {spending_report} FROM spend"),
        "spending_top20": detectors
        + f"""SELECT project_id, category, {_scaled("expenditure_lakh")} AS expenditure_lakh,
            {_scaled("category_avg_expenditure_lakh")} AS category_avg_expenditure_lakh,
            {_scaled("category_std_expenditure_lakh")} AS category_std_expenditure_lakh,
            {_scaled("spending_zscore")} AS spending_zscore, spending_anomaly
            FROM (SELECT * FROM spend
                ORDER BY spending_zscore DESC NULLS LAST, project_id LIMIT 20)""",
        "spending_report_lines": detectors
        + f"""SELECT project_id, project_id || ' | ' || category || ' | Expenditure: ₹'
            || {_text("expenditure_lakh", 2)} || 'L | Category average: ₹'
            || {_text("category_avg_expenditure_lakh", 2)} || 'L | Z-score: '
            || {_text("spending_zscore", 2)} AS line FROM spend WHERE spending_anomaly""",
        "similar_part_works": parts + WORK_PAIRS,
        "part_copy_groups": parts + COPY_GROUPS,
        "part_pair_count": parts + PAIR_COUNT,
        "similar_part_classes": parts + CLASSES,
        "top_similar_parts": parts + TOP_20,
        "part_duplicate_signals": parts + SIGNALS,
        "signals_of_pairs": texts + PAIR_SIGNALS,
        "similar_document_works": texts + WORK_PAIRS,
        "document_copy_groups": texts + COPY_GROUPS,
        "pairs_of_no_category": parts + WORK_PAIRS + " WHERE sim.cat IS NULL",
        "blanked_document_signals": f"WITH {_similarity(BLANKED_DOCS)} " + SIGNALS,
        "document_pair_count": texts + PAIR_COUNT,
        "similar_document_classes": texts + CLASSES,
        "top_similar_documents": texts + TOP_20,
        "document_duplicate_signals": texts + SIGNALS,
        "risk_scores": risk + rounded_rows.format(rows=risk_rows),
        "risk_from_stored_signals": risk + rounded_rows.format(rows=risk_rows),
        "risk_summary": risk
        + """SELECT count(*) AS total_projects,
            count(*) FILTER (risk_level = 'High') AS high_risk,
            count(*) FILTER (risk_level = 'Medium') AS medium_risk,
            count(*) FILTER (risk_level = 'Low') AS low_risk FROM risk""",
        "risk_distribution": risk
        + """SELECT place::INTEGER AS place, lvl AS risk_level, count(project_id) AS n_projects
            FROM (VALUES (1, 'High'), (2, 'Medium'), (3, 'Low')) levels(place, lvl)
            LEFT JOIN risk ON risk_level = lvl GROUP BY 1, 2""",
        "category_counts": f"""WITH {PROJ} SELECT category, count(*) AS n_projects
            FROM proj WHERE category IS NOT NULL GROUP BY 1""",
        "top10_risks": risk
        + f"""SELECT project_id, category, risk_score, risk_level, risk_reasons
            FROM risk {TOP_ORDER} LIMIT 10""",
        "projects_listed": risk
        + rounded_rows.format(rows=f"{risk_rows} {TOP_ORDER} LIMIT 100"),
        "projects_filtered": risk
        + rounded_rows.format(
            rows=f"""{risk_rows} WHERE risk_level = 'Medium'
                AND lower(category) = 'promo' {TOP_ORDER} LIMIT 500"""
        ),
        "high_risk_projects": risk
        + rounded_rows.format(
            rows=f"{risk_rows} WHERE risk_level = 'High' {TOP_ORDER} LIMIT 50"
        ),
        "project_lookup": risk
        + rounded_rows.format(rows=f"{risk_rows} WHERE upper(project_id) = '42'"),
        "review_queue": risk
        + f"""SELECT CASE WHEN place < 10 THEN '0' ELSE '' END || place AS place, {HEADING}
            FROM (SELECT *, row_number() OVER ({TOP_ORDER}) AS place FROM risk
                WHERE risk_level = 'High') WHERE place <= 50""",
        "investigation_view": risk + f"SELECT {HEADING}, {_case_columns()} FROM risk",
        "aliased_investigation_view": risk
        + f"""SELECT {HEADING.replace(LOCATION, "category || ' works'")}, {_case_columns()}
            FROM risk""",
        "flag_reason_texts": detectors
        + """SELECT project_id, coalesce(nullif(concat_ws('; ',
            CASE WHEN cost_anomaly THEN 'Potential cost anomaly' END,
            CASE WHEN delay_anomaly THEN 'Potential execution delay' END,
            CASE WHEN spending_anomaly THEN 'Unusual spending pattern' END), ''),
            'Multiple risk signals require review.') AS reasons FROM spend""",
    }
