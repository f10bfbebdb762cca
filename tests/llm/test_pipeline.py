"""The pipeline against plain versions of its decisions, on a small corpus with planted cases."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_minhash import brute_force as near_classes
from test_substrings import brute_force as repeats
from worksight.llm import toxicity


def corpus():
    choose = random.Random(12)
    words = [f"wörd{i}" for i in range(2000)]

    def prose(n):
        return " ".join(choose.choice(words) for _ in range(n))

    rows = [(i, prose(choose.randint(30, 120))) for i in range(160)]
    passage = prose(70)
    for i in (5, 25, 45, 65):
        rows[i] = (i, prose(60) + " " + passage + " " + prose(60))
    rows += [(200, rows[3][1]), (201, rows[8][1] + " end"), (202, rows[8][1].upper().lower())]
    rows += [(300 + i, prose(40) + " you awful scum you " + prose(20)) for i in range(60)]
    rows += [(400, None), (401, ""), (402, "short text")]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    table = [(doc_id, text, "en", "s", len(text or "")) for doc_id, text in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(doc_id, 1, int(300 <= doc_id < 400)) for doc_id, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}-{name}"))
    clean, single, cut, packed = ([tuple(r) for r in f.collect()] for f in frames[1:])
    assert all(f.columns == frames[0].columns for f in frames[:4])

    held = {d for d, _ in rows if 300 <= d < 400 and zlib.crc32(str(d).encode()) % 5 == 0}
    assert held and not held & {r[0] for r in clean}
    assert {r[0] for r in clean} == {d for d, _ in rows if not 300 <= d < 400}

    texts = [(r[0], r[1]) for r in clean]
    classes = near_classes(texts, 5, 80)
    assert {r[0] for r in single} == {d for d, root in classes.items() if d == root}
    assert not {200, 201, 202} & {r[0] for r in single}

    expected = {e[0]: e for e in repeats([(r[0], r[1]) for r in single], 50)}
    assert sum(e[2] for e in expected.values()) > 3 * 300
    for doc_id, text, _, _, n_chars in cut:
        before = next(r[1] or "" for r in single if r[0] == doc_id)
        assert len(before.encode()) - len(text.encode()) - expected[doc_id][2] in range(4)
        assert n_chars == len(text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in frames[4].orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).extend(r.input_ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.input_ids, "<u4").tobytes())
    assert pieces == {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2] for r in cut}

    again = corpus_pipeline.run(spark, str(tmp_path))
    key = F.xxhash64("doc_id", "start", "length", "ids_crc32", "doc_tokens").cast("decimal(38,0)")
    assert again.agg(F.sum(key), F.count("*")).first() == frames[4].agg(F.sum(key), F.count("*")).first()


def test_columns_named_like_the_machines(spark, tmp_path):
    rows = [(k, "plain words of a clean text", f"mine {k}", k) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(k, 0) for k in range(8)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == rows


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.MAX_TRAIN_ROWS > 0
