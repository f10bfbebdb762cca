"""Quality statistics against plain loops, and the forest on labelled rows."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.llm import quality

SF_DIR = "/root/testdata/sf0.01"
TEXTS = [
    "a b c d e f a b c d e g h i j k l",
    "x x x x x x y",
    "one two\nthree\none two\n \n\t\none two \nthree",
    "#*$%&|<> price: 5 $ & more | <b> text </b>",
    "Ünï cödé 日本語 a b c\x1cd e\x0bf",
    " \t\n\r\x0b\x0c ",
    "same five words in here and same five words in here too, then others follow on",
    "word " * 4000,
    "",
    None,
]


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            repeated |= set(range(i, i + 5))
    return [
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(repeated),
    ]


@pytest.mark.parametrize("slice_bytes", [100, 2 << 20])
def test_counts_equal_plain_loops(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(quality, "SLICE_BYTES", slice_bytes)
    rows = [(k, t, True) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], False), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.judge(docs, none).collect()
    assert len(got) == len(rows)
    for row in got:
        text = "a" if row["doc_id"] is None else TEXTS[row["doc_id"]]
        counts = plain(text)
        assert [row[c] for c in quality.COUNTS] == counts
        assert row["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert row["kept"] == (not row["base_failed"])  # without labels only the rules hold


def test_random_texts_equal_plain_loops():
    random = np.random.default_rng(3)
    texts = [
        "".join(random.choice(list("ab c\n\td$"), int(random.integers(0, 120)))) for _ in range(400)
    ]
    found = quality.statistics([t.encode() for t in texts])
    assert found.counts.tolist() == [plain(t) for t in texts]


def test_paths_are_the_naive_ones():
    random = np.random.default_rng(4)
    rows = random.random((500, len(quality.SHARES)))
    forest = quality.Forest.fit(rows, rows.min(axis=0), rows.max(axis=0))
    for row, score in zip(rows[:20], forest.scores(rows[:20]), strict=True):
        paths = []
        for node in forest.roots:
            while forest.below[node] != node:
                under = row[forest.share[node]] < forest.cut[node]
                node = forest.below[node] if under else forest.above[node]
            paths.append(forest.path[node])
        mean = quality._mean_path(quality.ROWS_PER_TREE)
        assert score == pytest.approx(2 ** (-np.mean(paths) / mean))


def test_threshold():
    forest = quality.Forest.fit(np.empty((0, 4)), np.zeros(4), np.zeros(4))
    forest.calibrate(np.array([0.9, 0.8, 0.4, 0.3]), np.array([False, False, True, True]))
    assert forest.threshold == pytest.approx(0.6)
    forest.calibrate(np.array([0.9, 0.8]), np.array([True, True]))
    assert forest.threshold == np.inf


def test_clashing_and_repeated_labels(spark):
    docs = spark.createDataFrame(
        [(1, "a b " * 3, 5), (1, "c", 6), (2, None, 7)], "doc_id long, text string, label int"
    )
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (None, 1), (2, None), (9, 0)], "doc_id long, quality int"
    )
    assert quality.train(docs, labels).threshold == np.inf
    none = docs.limit(0)
    assert quality.judge(none, quality.train(none, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR.replace("0.01", "0.1")), reason="no sample tables")
def test_held_out_labels(spark):
    sf_dir = SF_DIR.replace("0.01", "0.1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    forest = quality.train(docs, labels.where(~fold))
    judged = quality.judge(docs, forest).join(labels.where(fold), "doc_id")
    shares = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {row["quality"]: row["kept"] for row in shares.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.05
