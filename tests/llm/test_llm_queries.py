"""The registered queries run on the smallest sample tables with the columns of their contracts."""

import os

import pytest

import __spark_entry__ as entry
from worksight.llm import queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out n_tokens n_known train_tokens base_score score",
    2: "page_id url text n_chars",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    4: "doc_id n_bytes n_removed n_spans kept_sha256",
    5: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    6: "doc_id held_out score predicted",
    7: "doc_id n_shingles component_id kept",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "page_id payload_bytes payload_digest record_type refers_to",
    10: "query_id rank vec_id score",
    11: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    12: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    13: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


def test_registered():
    names = set(queries.queries())
    assert {int(name[2:].split("_")[0]) for name in names} == set(COLUMNS)
    assert names | {"pipeline"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_columns_and_rows(spark, name):
    number = int(name[2:].split("_")[0])
    got = queries.queries()[name](spark, SF_DIR)
    assert set(COLUMNS[number].split()) <= set(got.columns)
    rows = got.count()
    source = "pages" if number in (2, 9) else "documents"
    if number == 3:
        assert got.select("doc_id").distinct().count() == 200
    elif number == 10:
        assert rows == 50
    elif number == 13:
        conversations = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
        assert rows == conversations.select("conv_id").distinct().count()
    else:
        assert rows == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()
