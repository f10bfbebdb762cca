"""Small project tables with known results."""

from __future__ import annotations

import datetime
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.operators import similarity
from worksight.sources.schema import PROJECT_SCHEMA

# A sample of 15 projects (id, category, description, estimated,
# sanctioned, spent, progress, planned days, elapsed days, status).
SAMPLE = [
    ("P1001", "Community Hall", "Construction of community hall at Ward 4",
     24.0, 25.0, 23.5, 95.0, 180, 170, "Completed"),
    ("P1002", "Road", "Construction of internal road at Village North",
     28.0, 30.0, 17.0, 58.0, 210, 190, "In Progress"),
    ("P1003", "School Building", "Construction of additional classrooms at Government School",
     22.0, 22.0, 20.5, 88.0, 200, 185, "In Progress"),
    ("P1004", "Community Hall", "Construction of community hall in Ward 12",
     26.0, 27.0, 43.5, 42.0, 240, 420, "Delayed"),
    ("P1005", "Road", "Construction of village road near Primary Health Centre",
     31.0, 32.0, 29.0, 91.0, 210, 200, "In Progress"),
    ("P1006", "Drinking Water", "Installation of drinking water pipeline for Village East",
     18.0, 19.0, 18.2, 96.0, 150, 145, "Completed"),
    ("P1007", "Community Hall", "Community hall construction at Ward No 12",
     25.0, 26.0, 38.0, 35.0, 240, 390, "Delayed"),
    ("P1008", "School Building", "Construction of two classrooms at Government High School",
     21.0, 21.5, 20.0, 90.0, 180, 175, "In Progress"),
    ("P1009", "Road", "Construction of approach road to agricultural market",
     29.0, 30.0, 31.5, 72.0, 210, 250, "In Progress"),
    ("P1010", "Health Facility", "Upgradation of primary health sub-centre",
     34.0, 35.0, 33.0, 87.0, 240, 230, "In Progress"),
    ("P1011", "Community Hall", "Construction of multipurpose community hall at Ward 12",
     24.0, 25.0, 24.2, 89.0, 180, 175, "In Progress"),
    ("P1012", "Road", "Construction of internal village road",
     27.0, 28.0, 26.5, 92.0, 180, 178, "In Progress"),
    ("P1013", "Community Hall", "Construction of community hall at Ward 12 near market",
     25.0, 26.0, 41.0, 38.0, 210, 400, "Delayed"),
    ("P1014", "Drinking Water", "Drinking water pipeline extension to rural settlement",
     17.0, 18.0, 16.9, 94.0, 150, 148, "In Progress"),
    ("P1015", "School Building", "Government school classroom block extension",
     23.0, 24.0, 22.0, 86.0, 210, 205, "In Progress"),
]

# id: overrun %, estimate deviation %, delay %, z-score, cost, delay, duplicate and
# spending score, risk, level
SAMPLE_RESULTS = {
    "P1001": (-6.0, -2.0833, -5.5556, -1.1087, 0, 0, 6.58, 0, 6.58, "Low"),
    "P1002": (-43.3333, -39.2857, -9.5238, -1.4201, 0, 0, 0, 0, 0, "Low"),
    "P1003": (-6.8182, -6.8182, -7.5, -0.3203, 0, 0, 0, 0, 0, "Low"),
    "P1004": (61.1111, 67.3077, 75.0, 0.9951, 30, 30, 6.58, 4.98, 71.56, "High"),
    "P1005": (-9.375, -6.4516, -4.7619, 0.4734, 0, 0, 0, 2.37, 2.37, "Low"),
    "P1006": (-4.2105, 1.1111, -3.3333, 0.7071, 0, 0, 0, 3.54, 3.54, "Low"),
    "P1007": (46.1538, 52.0, 62.5, 0.4165, 23.08, 30, 0, 2.08, 55.16, "Medium"),
    "P1008": (-6.9767, -4.7619, -2.7778, -0.8006, 0, 0, 0, 0, 0, "Low"),
    "P1009": (5.0, 8.6207, 19.0476, 0.8678, 2.5, 9.52, 0, 4.34, 16.36, "Low"),
    "P1010": (-5.7143, -2.9412, -4.1667, None, 0, 0, 0, 0, 0, "Low"),
    "P1011": (-3.2, 0.8333, -2.7778, -1.035, 0, 0, 0, 0, 0, "Low"),
    "P1012": (-5.3571, -1.8519, -1.1111, 0.0789, 0, 0, 0, 0.39, 0.39, "Low"),
    "P1013": (57.6923, 64.0, 90.4762, 0.7321, 28.85, 30, 0, 3.66, 62.51, "Medium"),
    "P1014": (-6.1111, -0.5882, -1.3333, -0.7071, 0, 0, 0, 0, 0, "Low"),
    "P1015": (-8.3333, -4.3478, -2.381, 1.1209, 0, 0, 0, 5.6, 5.6, "Low"),
}


def project(**values) -> tuple:
    """One row of the project layout from the values that matter to a test."""
    row = {
        "project_id": "A1",
        "category": "Road",
        "work_description": "road",
        "estimated_cost_lakh": 10.0,
        "sanctioned_amount_lakh": 10.0,
        "expenditure_lakh": 10.0,
        "physical_progress_pct": 50.0,
        "planned_duration_days": 100,
        "elapsed_days": 100,
        "start_date": datetime.date(2024, 1, 1),
        "current_status": "In Progress",
    } | values
    return tuple(row.get(name) for name in PROJECT_SCHEMA.names)


def projects(spark: SparkSession, *rows: dict) -> DataFrame:
    return spark.createDataFrame([project(**row) for row in rows], PROJECT_SCHEMA)


def sample_projects(spark: SparkSession) -> DataFrame:
    names = (
        "project_id category work_description estimated_cost_lakh "
        "sanctioned_amount_lakh expenditure_lakh physical_progress_pct "
        "planned_duration_days elapsed_days current_status"
    ).split()
    return projects(spark, *(dict(zip(names, row, strict=True)) for row in SAMPLE))


def similar_by_brute_force(
    rows: list[tuple], stop_words: list[str], threshold: float = 0.8
) -> dict[tuple, float]:
    """{(id_1, id_2): similarity in percent} of rows (id, group, text), by definition."""
    groups = defaultdict(list)
    for number, group, text in rows:
        if group is None:
            continue
        words = [
            word
            for word in re.findall(r"\b\w\w+\b", (text or "").lower())
            if word not in stop_words
        ]
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        groups[group].append((number, Counter(words + pairs)))
    found = {}
    for members in groups.values():
        df = Counter(term for _, counts in members for term in counts)
        vectors = []
        for number, counts in members:
            raw = {
                term: tf * (math.log((1 + len(members)) / (1 + df[term])) + 1)
                for term, tf in counts.items()
            }
            norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            vectors.append((number, {term: x / norm for term, x in raw.items()}))
        for i, (id_1, one) in enumerate(vectors):
            for id_2, two in vectors[i + 1 :]:
                cosine = sum(x * two.get(term, 0.0) for term, x in one.items())
                if cosine >= threshold:
                    found[id_1, id_2] = round(cosine * 100, 2)
    return found


def list_pairs(similar, table, id_col="project_id", text_col="work_description"):
    """Every similar project pair as a row, quadratic in a group of copies."""
    keyed = similar.works.select("category", "words_key", "work_id")
    members = similar.members.join(keyed, ["category", "words_key"]).select(
        "work_id", F.struct("seq", "project_id").alias("member")
    )
    entries = similar.pairs.select("category", "similarity_pct", "work_1", "work_2").unionByName(
        similar.works.where("n_projects > 1").select(
            "category",
            F.lit(100.0).alias("similarity_pct"),
            F.col("work_id").alias("work_1"),
            F.col("work_id").alias("work_2"),
        )
    )
    met = (
        entries.join(members.toDF("work_1", "p"), "work_1")
        .join(members.toDF("work_2", "q"), "work_2")
        .where((F.col("work_1") != F.col("work_2")) | (F.col("p") < F.col("q")))
    )
    described = similarity._described(similarity._oriented_pairs(met), table, id_col, text_col)
    return described.orderBy(*similarity._report_order()).drop("seq_1", "seq_2")
