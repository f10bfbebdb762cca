"""The corpus pipeline: documents without toxic texts, near copies and repeated passages, packed.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all
rows its predecessor kept and returns a frame, which is written as Parquet and read again
for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.llm import minhash, packing, substrings, toxicity
from worksight.llm.common import ship_code, table
from worksight.sources import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not take for toxic."""
    labels = table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels, folds=5)
    # columns of the table that are named like the machine's keep their values
    aside = {c: f"{c} of the table" for c in ("score", "predicted") if c in docs.columns}
    scored = toxicity.score(docs.withColumnsRenamed(aside), machine)
    kept = scored.where(F.col("predicted") == 0).drop("score", "predicted")
    return kept.withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    ship_code(spark)
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    dropped = found.where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that an earlier one has.

    The cut is by bytes; what is left of a character that is cut through goes too. n_chars
    becomes the code points that are left. A document that loses all its bytes stays, empty.
    """
    ship_code(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substrings.remove_repeats(docs, threshold=50, carry=others, as_text=True)
    cut = cut.select("doc_id", F.col("kept").alias("text"), "extra.*")
    if "n_chars" in others:
        counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", counted)
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of token ids of power-of-two length."""
    ship_code(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


# What the latest stage of an application stored on its way.
_on_the_way: dict[str, list] = {}


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage, which first gives back what the stage before it stored on its way.

    The result of that stage has been written by then; its intermediates would otherwise
    lie beside those of all later stages.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        scratch.release(spark, _on_the_way.pop(application, []))
        before = scratch.kept(spark)
        result = stage(spark, docs, sf_dir)
        _on_the_way[application] = [
            x for x in scratch.kept(spark) if not any(x is item for item in before)
        ]
        return result

    return run_stage


STAGES = [
    ("toxicity", _tidy(drop_toxic)),
    ("minhash_near_dedup", _tidy(drop_near_copies)),
    ("suffix_array_dedup", _tidy(drop_repeats)),
    ("packing", _tidy(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch.new_table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained model, shingle links and byte-exact passages have no SQL counterpart.
ORACLE_SQL = None
