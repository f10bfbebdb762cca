"""Quality rules by an isolation forest over rule statistics.

Each text gets the counts that quality rules look at (words, their characters, symbols,
repeated lines, repeated windows of words) and shares made from them. Isolation trees cut
the space of shares at random: a cut is drawn evenly over what is left of the range that
labelled rows span, so a text in a stretch where good texts are rare is alone after few
cuts. The mean path length over all trees is its score, and the score from which a text is
rejected is the one that tells the labelled rows apart best.

Fixed rules come first: texts of very few words or of mostly repeated windows fail whatever
the forest says. Statistics are made slice by slice in one pass, without a shuffle.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import Numbering, in_slices, text_or_empty

SYMBOLS = b"#*$%&|<>"  # fixed value
WINDOW = 5  # words
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
# Bound of the labelled rows, those of the lowest hashes of their ids, that the forest is
# fitted on and its threshold set by.
MAX_TRAIN_ROWS = 20_000
TREES = 100
ROWS_PER_TREE = 256
DEPTH = 12
SLICE_BYTES = 2 << 20
SHARES = ["mean_word_chars", "symbol_share", "same_as_before_share", "other_share"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_CHARACTER = np.ones(256, bool)  # first bytes of characters
_CHARACTER[128:192] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_OTHER = ~_WHITE  # ASCII characters of words that are no letters
_OTHER[128:] = False
_OTHER[[*range(65, 91), *range(97, 123)]] = False


class Statistics(NamedTuple):
    counts: np.ndarray  # one row a text, as in COUNTS
    shares: np.ndarray  # as in SHARES; of a text without words all are 0

    def base_failed(self) -> np.ndarray:
        words, repeated = self.counts[:, 0], self.counts[:, 4]
        return (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * words)


def _repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _in_repeated_windows(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word stands in a window of WINDOW words that its text has twice or more.

    Windows are numbered by doubling: two windows are equal where both halves are.
    """
    covered = np.zeros(len(words), bool)
    if len(words) < WINDOW:
        return covered
    numbers, width = words, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        pair = numbers[:-step] * (int(numbers.max()) + 1) + numbers[step:]
        numbers = np.unique(pair, return_inverse=True)[1]
        width += step
    starts = np.flatnonzero(text[: len(numbers)] == text[WINDOW - 1 :])
    keys = text[starts] * (int(numbers.max()) + 1) + numbers[starts]
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = starts[times[place] > 1]
    for k in range(WINDOW):
        covered[again + k] = True
    return covered


def statistics(texts: list[bytes]) -> Statistics:
    """The statistics of whole UTF-8 texts; words are split at ASCII white space."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)

    def per_text(chosen: np.ndarray) -> np.ndarray:
        until = np.concatenate(([0], np.cumsum(chosen)))
        return until[ends] - until[ends - lengths]

    inside = ~_WHITE[data]
    word_chars = per_text(inside & _CHARACTER[data])
    split = [text.split() for text in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(texts))
    number = Numbering()
    words = np.fromiter(
        map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n_words.sum())
    )
    text = np.repeat(np.arange(len(texts)), n_words)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])

    def of_words(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(text[chosen], minlength=len(texts))

    symbols = per_text(_SYMBOL[data])
    counts = np.stack(
        [
            n_words,
            word_chars,
            symbols,
            np.fromiter(map(_repeated_lines, texts), np.int64, len(texts)),
            of_words(_in_repeated_windows(words, text)),
        ],
        axis=1,
    )
    some, characters = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    shares = [word_chars / some, symbols / characters, of_words(same) / some]
    shares.append(per_text(_OTHER[data]) / characters)
    return Statistics(counts, np.stack(shares, axis=1))


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of a failed search among n points, which a leaf of n points adds."""
    n = np.asarray(n, float)
    more = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, 0.0)


class Forest:
    """Trees in flat arrays: share and value of each cut, the two nodes behind it, path length."""

    def __init__(self, share, cut, below, above, path, roots, rows_per_tree, threshold=np.inf):
        self.share, self.cut, self.below, self.above = share, cut, below, above
        self.path, self.roots = path, roots
        self.rows_per_tree, self.threshold = rows_per_tree, threshold

    @classmethod
    def fit(cls, good: np.ndarray, low: np.ndarray, high: np.ndarray) -> Forest:
        """Trees over samples of ``good`` rows; cuts span ``low`` to ``high`` of all rows."""
        random = np.random.default_rng(17)
        size = min(ROWS_PER_TREE, len(good))
        nodes: list[list[float]] = []  # share, cut, below, above, path
        roots = []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            here = len(nodes)
            nodes.append([0, np.inf, here, here, depth + float(_mean_path(len(rows)))])
            wide = np.flatnonzero(high > low)
            if depth == DEPTH or len(rows) <= 1 or not len(wide):
                return here
            k = int(random.choice(wide))
            cut = float(random.uniform(low[k], high[k]))
            left, right = high.copy(), low.copy()
            left[k] = right[k] = cut
            under = rows[:, k] < cut
            below = grow(rows[under], low, left, depth + 1)
            above = grow(rows[~under], right, high, depth + 1)
            nodes[here][:4] = k, cut, below, above
            return here

        for _ in range(TREES if size else 0):
            chosen = good[random.choice(len(good), size, replace=False)]
            roots.append(grow(chosen, low.copy(), high.copy(), 0))
        share, cut, below, above, path = np.array(nodes or np.empty((0, 5))).T
        whole = [part.astype(np.int32) for part in (share, below, above)]
        return cls(
            whole[0], cut, whole[1], whole[2], path, np.array(roots, np.int32), max(size, 2)
        )

    def scores(self, shares: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: 2 to the power of minus path length over its mean."""
        if not len(self.roots):
            return np.zeros(len(shares))
        out = np.empty(len(shares))
        for start in range(0, len(shares), 2_000):
            some = shares[start : start + 2_000]
            node = np.broadcast_to(self.roots, (len(some), len(self.roots)))
            row = np.arange(len(some))[:, None]
            for _ in range(DEPTH):
                under = some[row, self.share[node]] < self.cut[node]
                node = np.where(under, self.below[node], self.above[node])
            path = self.path[node].mean(axis=1)
            out[start : start + 2_000] = np.exp2(-path / float(_mean_path(self.rows_per_tree)))
        return out

    def calibrate(self, scores: np.ndarray, good: np.ndarray) -> None:
        """Reject from the score on that has the best mean of both labels' shares right.

        Of equally good ones the highest, halfway to the next lower score; without rows of
        both labels nothing is rejected.
        """
        if good.all() or not good.any():
            self.threshold = np.inf
            return
        order = np.argsort(-scores, kind="stable")
        scores, good = scores[order], good[order]
        caught = np.cumsum(~good) / (~good).sum()
        lost = np.cumsum(good) / good.sum()
        last = np.append(scores[1:] < scores[:-1], True)  # of equal scores the last counts
        best = int(np.argmax(np.where(last, caught - lost, -np.inf)))
        if caught[best] <= lost[best]:
            self.threshold = np.inf
        elif best + 1 < len(scores):
            self.threshold = float((scores[best] + scores[best + 1]) / 2)
        else:
            self.threshold = float(scores[best])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(F.col(text_col)).cast("binary")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
) -> Forest:
    """A forest fitted on at most ``max_rows`` labelled rows (1 good, 0 not), with a threshold.

    Trees are grown on good rows; the threshold is set by all labelled rows that pass the
    fixed rules. Of several labels of a document the largest counts, and of several texts of
    one id one takes part; rows without an id or a label are left out. The driver receives
    only the shares of these rows, a few numbers each.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    sample = _texts(docs, id_col, text_col).join(F.broadcast(known), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, size=SLICE_BYTES):
            found = statistics(batch.column("text").to_pylist())
            columns = [batch.column("id"), batch.column("label"), pa.array(~found.base_failed())]
            columns += [pa.array(share) for share in found.shares.T]
            names = ["id", "label", "passed", *SHARES]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = sample.schema["id"].dataType.simpleString()
    schema = f"id {kind}, label int, passed boolean, " + ", ".join(f"{s} double" for s in SHARES)
    every = ["label", *SHARES]
    measured = sample.mapInArrow(measure, schema).where("passed").groupBy("id")
    rows = measured.agg(F.min(F.struct(*every)).alias("row")).select("id", "row.*")
    table = rows.orderBy("id").toArrow()  # at most max_rows rows
    shares = np.stack([table.column(s).to_numpy() for s in SHARES], axis=1)
    good = table.column("label").to_numpy() >= 1
    if not len(shares):
        none = np.zeros(len(SHARES))
        return Forest.fit(shares, none, none)
    forest = Forest.fit(shares[good], shares.min(axis=0), shares.max(axis=0))
    forest.calibrate(forest.scores(shares), good)
    return forest


def judge(
    docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's counts and verdict.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, anomaly, and the shares. ``kept`` is false where the fixed rules fail
    or the anomaly reaches the forest's threshold. A null text counts as empty and fails the
    fixed rules; repeated rows are judged alike, an empty table gives an empty one, whole
    texts are read whatever their length, and other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)  # TREES and ROWS_PER_TREE bound it
    names = ["id", *COUNTS, "base_failed", "kept", "anomaly", *SHARES]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        gc.freeze()
        for batch in in_slices(batches, size=SLICE_BYTES):
            found = statistics(batch.column(1).to_pylist())
            failed, anomaly = found.base_failed(), forest.scores(found.shares)
            columns = [batch.column(0), *(pa.array(count) for count in found.counts.T)]
            columns += [pa.array(failed), pa.array(~failed & (anomaly < forest.threshold))]
            columns += [pa.array(anomaly), *(pa.array(share) for share in found.shares.T)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    shares = ", ".join(f"{s} double" for s in SHARES)
    schema = f"id {kind}, {counts}, base_failed boolean, kept boolean, anomaly double, {shares}"
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)
