"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-cased words without outer punctuation, and
the first letters of longer words, which catch inflected forms. The machine scores
b + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, so a pair such as an insult and
a mention of a group has a weight of its own that additive weights lack, also where each
of the two words tells nothing alone.

It is fitted on a bounded sample of labelled rows, in one task; every text is then scored
whole, without a shuffle of texts.
"""

from __future__ import annotations

import functools
import gc
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from xxhash import xxh3_64_intdigest as _hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import BoundedCache, crc_fold, in_slices, take_worker, text_or_empty

BITS = 20  # 2**20 hashed terms
_MASK = (1 << BITS) - 1
FACTORS = 4
PREFIXES = (4, 5)  # letters of a word's prefix terms
# Bound of the sample that the machine is fitted on: rows of the lowest hashes of doc_id.
MAX_TRAIN_ROWS = 24_000
EPOCHS = 5
BATCH = 64
RATE = 0.2
FACTOR_RATE = 0.02
L1 = 2.0
L2 = 0.1
PAIR_ROWS = 12  # training rows from which a term has factors, whatever its weight
PAIR_EPOCHS = 4
PAIR_RATE = 0.1
PAIR_DECAY = 0.05
PAIR_FLOOR = 0.25  # length of a term's factors below which they are dropped
CHECKED = 10  # every tenth training row only decides whether such factors stay
CACHED_WORDS = 200_000
_OUTER = b"\"'!?.,;:()[]{}<>*_-%&$#|~"


class Terms(BoundedCache):
    """Term numbers of lower-cased words: the word and its prefixes, packed in one integer.

    With ``active`` terms given, a word that has none of them is -1.
    """

    def __init__(self, active: np.ndarray | None = None):
        super().__init__(CACHED_WORDS)
        self.active = active

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_OUTER)
        packed = _hash(bare) & _MASK
        letters = bare if bare.isascii() else bare.decode("utf-8", "ignore")
        for n in PREFIXES:
            prefix = letters[:n]
            part = _hash(prefix, n) if letters is bare else _hash(prefix.encode(), n)
            packed = packed << BITS | part & _MASK
        if self.active is not None and not any(
            self.active[packed >> BITS * k & _MASK] for k in range(1 + len(PREFIXES))
        ):
            packed = -1
        self[word] = packed
        return packed


def terms_of(texts: list[str], known: Terms) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text in order, behind one another, and their counts."""
    known.room_for(1)
    words = [set(text.encode().lower().split()) for text in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    packed = np.fromiter(
        map(known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum())
    )
    text = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, n)
    text, packed = text[packed >= 0], packed[packed >= 0]
    pairs = [text | packed >> BITS * k & _MASK for k in range(1 + len(PREFIXES))]
    distinct = np.unique(np.concatenate(pairs))
    return distinct & _MASK, np.bincount(distinct >> BITS, minlength=len(texts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for a text without terms."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    if len(values):
        starts = np.cumsum(counts) - counts
        filled = counts > 0
        out[filled] = np.add.reduceat(values, starts[filled], axis=0)
    return out


def _batches(terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, random):
    """Terms, their text's number in the batch and labels, BATCH rows at a time, shuffled."""
    starts = np.cumsum(counts) - counts
    batches = max(1, len(labels) // BATCH)
    for rows in np.array_split(random.permutation(len(labels)), batches):
        n = counts[rows]
        ends = np.cumsum(n)
        at = np.repeat(starts[rows] - ends + n, n) + np.arange(ends[-1])
        yield terms[at], np.repeat(np.arange(len(rows)), n), labels[rows]


class Machine:
    """Bias, one weight and FACTORS factors for each hashed term; most are zero."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def untrained(cls, share: float) -> Machine:
        size = 1 << BITS
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (4.0 if share else -4.0)
        return cls(bias, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))

    def active(self) -> np.ndarray:
        """Which terms have a weight or factors."""
        return (self.weights != 0) | self.factors.any(axis=1)

    def score(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the label for texts given by ``terms_of``."""
        text = np.repeat(np.arange(len(counts)), counts)
        linear = _sums(self.weights[terms].astype(np.float64), counts)
        chosen = self.factors[terms].astype(np.float64)
        paired = chosen.any(axis=1)
        chosen, text = chosen[paired], text[paired]
        n = np.bincount(text, minlength=len(counts))
        total, squares = _sums(chosen, n), _sums((chosen * chosen).sum(1), n)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares)

    def fit(self, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> None:
        """Log loss in small batches, rows in a fixed shuffled order.

        First weights, and factors of the terms that have a weight; then factors of all
        other terms of PAIR_ROWS rows or more, for pairs of words that are neutral alone.
        """
        random = np.random.default_rng(11)
        first = random.normal(0, 0.05, self.factors.shape).astype(np.float32)
        self._fit_weighted(terms, counts, labels, first, random)
        self._fit_neutral(terms, counts, labels, first, random)

    def _fit_weighted(self, terms, counts, labels, first, random) -> None:
        """Weights follow the regularized leader with an L1 term, so that the many terms
        which tell nothing stay exactly zero and long texts gather no noise from them.
        Factors are learned by AdaGrad for the terms that have a weight.
        """
        leader = np.zeros(len(self.weights))
        power = np.zeros(len(self.weights))
        power_v = np.full(self.factors.shape, 1.0, np.float32)
        power_b = 1.0
        for _ in range(EPOCHS):
            for x, text, truth in _batches(terms, counts, labels, random):
                slope = self._slope(x, text, truth)
                used, where = np.unique(x, return_inverse=True)
                grad = np.bincount(where, slope[text], len(used))
                step = np.sqrt(power[used] + grad * grad)
                leader[used] += grad - (step - np.sqrt(power[used])) / RATE * self.weights[used]
                power[used] += grad * grad
                pull = leader[used]
                moved = np.sign(pull) * L1 - pull
                before = self.weights[used] != 0
                now = np.abs(pull) > L1
                self.weights[used] = np.where(now, moved / ((1 + step) / RATE + L2), 0)
                self.factors[used[now & ~before]] = first[used[now & ~before]]
                self.factors[used[~now]] = 0
                learned = (before & now)[where]
                self._move_factors(x, text, slope, learned, power_v, FACTOR_RATE, L2)
                grad_b = float(slope.sum())
                power_b += grad_b * grad_b
                self.bias -= RATE * grad_b / power_b**0.5

    def _fit_neutral(self, terms, counts, labels, first, random) -> None:
        """Factors of frequent terms, whatever their weight, for what is left unexplained.

        They start small; those that stay short are dropped for the check after each epoch.
        The factors of the epoch with the least log loss on the checked rows stay, which
        may be those from before. The checked rows took part in the first fit, which
        makes this choice a cautious one.
        """
        rows = np.arange(len(labels)) % CHECKED == 0
        if rows.all() or not rows.any():
            return
        at = np.repeat(rows, counts)
        checked = terms[at], counts[rows], labels[rows]
        terms, counts, labels = terms[~at], counts[~rows], labels[~rows]
        old = self.factors.any(axis=1)
        new = (np.bincount(terms, minlength=len(old)) >= PAIR_ROWS) & ~old
        best, least = self.factors.copy(), self._loss(*checked)
        trained = best.copy()
        trained[new] = first[new] * np.float32(0.4)
        power_v = np.full(self.factors.shape, 1.0, np.float32)
        learned = new | old
        for _ in range(PAIR_EPOCHS):
            self.factors = trained
            for x, text, truth in _batches(terms, counts, labels, random):
                slope = self._slope(x, text, truth)
                self._move_factors(x, text, slope, learned[x], power_v, PAIR_RATE, PAIR_DECAY)
            self.factors = trained.copy()
            self.factors[new & ((trained * trained).sum(1) < PAIR_FLOOR**2)] = 0
            loss = self._loss(*checked)
            if loss < least:
                best, least = self.factors, loss
        self.factors = best

    def _slope(self, x: np.ndarray, text: np.ndarray, truth: np.ndarray) -> np.ndarray:
        z = np.clip(self.score(x, np.bincount(text, minlength=len(truth))), -30, 30)
        return 1 / (1 + np.exp(-z)) - truth

    def _loss(self, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> float:
        z = np.clip(self.score(terms, counts), -30, 30)
        return float(np.mean(np.log1p(np.exp(np.where(labels > 0.5, -z, z)))))

    def _move_factors(self, x, text, slope, learned, power_v, rate, decay) -> None:
        """One AdaGrad step for the factors of the ``learned`` places of a batch."""
        x, text = x[learned], text[learned]
        if not len(x):
            return
        n = np.bincount(text, minlength=len(slope))
        chosen = self.factors[x].astype(np.float64)
        rest = (_sums(chosen, n)[text] - chosen) * slope[text][:, None]
        used, where = np.unique(x, return_inverse=True)
        grad_v = np.stack([np.bincount(where, rest[:, f], len(used)) for f in range(FACTORS)], 1)
        grad_v += decay * self.factors[used]
        power_v[used] += grad_v * grad_v
        self.factors[used] -= rate * grad_v / np.sqrt(power_v[used])

    def to_bytes(self) -> bytes:
        """The active terms, with their weights and factors."""
        used = np.flatnonzero(self.active())
        head = np.array([self.bias], "<f8").tobytes()
        body = np.column_stack((self.weights[used], self.factors[used])).astype("<f4")
        return head + np.int64(len(used)).tobytes() + used.astype("<i8").tobytes() + body.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Machine:
        machine = cls.untrained(0.5)
        n = int(np.frombuffer(data, "<i8", 1, 8)[0])
        used = np.frombuffer(data, "<i8", n, 16)
        body = np.frombuffer(data, "<f4", offset=16 + 8 * n).reshape(n, 1 + FACTORS)
        machine.bias = float(np.frombuffer(data, "<f8", 1)[0])
        machine.weights[used], machine.factors[used] = body[:, 0], body[:, 1:]
        return machine


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
) -> Machine:
    """A machine fitted on at most ``max_rows`` labelled rows outside fold 0.

    Of several labels of a document the largest counts; rows without an id or a label are
    left out. Without any labelled row the machine gives every text the same low score.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"))
        .where("id is not null and label is not null")
        .where(crc_fold(F.col("id"), folds) != 0)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    sample = rows.join(F.broadcast(known), "id").select("id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("toxicity", _load.cache_clear)
        known = Terms()
        for batch in in_slices(batches, rows=1_000, size=2 << 20):
            terms, counts = terms_of(batch.column(2).to_pylist(), known)
            bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(terms, pa.int32()))
            columns = [batch.column(0), batch.column(1), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "terms"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [frame for frame in frames if len(frame)]
        if not parts:
            return
        frame = pd.concat(parts, ignore_index=True)
        truth = frame["label"].to_numpy(np.float32)
        counts = np.fromiter(map(len, frame["terms"]), np.int64, len(frame))
        machine = Machine.untrained(float(truth.mean()))
        machine.fit(np.concatenate(frame["terms"].to_list()).astype(np.int64), counts, truth)
        yield pd.DataFrame({"model": [machine.to_bytes()]})

    kind = rows.schema["id"].dataType.simpleString()
    extracted = sample.mapInArrow(extract, f"id {kind}, label double, terms array<int>")
    # max_rows rows at most, so one task can hold them
    ordered = extracted.repartition(1).sortWithinPartitions("id", F.xxhash64("terms"))
    model = ordered.mapInPandas(fit, "model binary").first()
    return Machine.from_bytes(bytes(model["model"])) if model else Machine.untrained(0.0)


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score (0 to 1) and predicted (1 from 0.5 on) beside all columns of ``docs``.

    A null text counts as empty and has the score of the bias; repeated rows are scored
    alike. Columns of ``docs`` named score or predicted are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine.to_bytes())  # BITS bounds it

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_worker("toxicity", _load.cache_clear)
        machine, known = _load(model.value)
        for texts in batches:
            scores = []
            for start in range(0, len(texts), 1_000):
                z = machine.score(*terms_of(texts.iloc[start : start + 1_000].to_list(), known))
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    kept = docs.drop("score", "predicted")
    scored = kept.withColumn("score", toxic(text_or_empty(F.col(text_col))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@functools.lru_cache(maxsize=1)
def _load(data: bytes) -> tuple[Machine, Terms]:
    machine = Machine.from_bytes(data)
    gc.freeze()
    return machine, Terms(machine.active())
