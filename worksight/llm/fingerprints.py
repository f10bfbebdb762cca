"""Document fingerprints from prefix polynomial hashes.

The prefix arrays of a text hold, for two moduli, the polynomial hash of its first i code
points. The difference of two entries is the hash of the span between them, so any two
spans are compared in constant time and the longest common extension of two positions is
found by binary search. A fingerprint holds the length, the hash of the whole text and a
sketch: the hashes of all spans of a fixed width fall into bins and each bin keeps its
smallest. Equal texts have equal fingerprints; the share of equal bins tells the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.llm.common import in_slices, text_or_empty
from worksight.sources.scratch import stored

MODULI = ((1 << 31) - 1, (1 << 31) - 19)  # primes: products fit 64 bits
BASES = (911_382_323, 972_663_749)
SPAN = 20  # code points of a sketched span
BINS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of both bases, as long as the longest text seen."""

    def __init__(self):
        self.of = [np.ones(1, np.uint64) for _ in MODULI]

    def up_to(self, n: int) -> list[np.ndarray]:
        while len(self.of[0]) <= n:
            for k, (p, base) in enumerate(zip(MODULI, BASES, strict=True)):
                known = self.of[k]
                step = np.uint64(pow(base, len(known), p))
                self.of[k] = np.concatenate((known, known * step % np.uint64(p)))
        return self.of


_powers = Powers()


class PrefixHashes:
    """Prefix arrays of one text, over its code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        powers = _powers.up_to(self.n)
        self.upto = []
        for p, power in zip(MODULI, powers, strict=True):
            p = np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * power[: self.n] % p, out=sums[1:])
            self.upto.append(sums % p)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hashes of the code points from ``start`` to ``end``, wherever they stand."""
        found = []
        for p, base, upto in zip(MODULI, BASES, self.upto, strict=True):
            moved = (int(upto[end]) - int(upto[start])) % p
            found.append(moved * pow(base, -start, p) % p)
        return tuple(found)

    def same(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        """Whether two spans of one length are equal."""
        for p, upto, theirs, power in zip(
            MODULI, self.upto, other.upto, _powers.of, strict=True
        ):
            left = (int(upto[start + length]) - int(upto[start])) % p
            right = (int(theirs[other_start + length]) - int(theirs[other_start])) % p
            if start < other_start:
                left = left * int(power[other_start - start]) % p
            else:
                right = right * int(power[start - other_start]) % p
            if left != right:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common span that starts at the two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def sketch(self) -> np.ndarray:
        """The lowest byte of the smallest mixed hash of each bin; -1 for an empty bin."""
        width = min(SPAN, self.n)
        p = np.uint64(MODULI[0])
        upto, power = self.upto[0], _powers.of[0]
        starts = self.n - width + 1 if width else 0
        out = np.full(BINS, -1, np.int64)
        if not starts:
            return out
        span = (upto[width:] + p - upto[:starts]) % p
        # brought to one exponent, whatever the length of the text: times base**(last - i),
        # then divided by base**last
        last = starts - 1
        span = span * power[last::-1] % p
        undo = np.uint64(pow(BASES[0], -last, MODULI[0]))
        mixed = (span * undo % p + np.uint64(1)) * _MIX >> np.uint64(24)
        bins = (mixed & np.uint64(BINS - 1)).astype(np.intp)
        least = np.full(BINS, np.uint64(1) << np.uint64(63), np.uint64)
        np.minimum.at(least, bins, mixed)
        filled = least < np.uint64(1) << np.uint64(63)
        out[filled] = (least[filled] * _MIX >> np.uint64(40) & np.uint64(255)).astype(np.int64)
        return out

    def fingerprint(self) -> str:
        """Length, hash of the whole text and sketch, as text."""
        whole = "".join(f"{int(upto[-1]):08x}" for upto in self.upto)
        bins = "".join("--" if x < 0 else f"{x:02x}" for x in self.sketch().tolist())
        return f"{self.n:x}.{whole}.{bins}"


def likeness(left: str, right: str) -> float:
    """Estimated share of two texts' spans that both have, from their fingerprints alone.

    1 for equal fingerprints, about 0.5 when half of two equally long texts agrees.
    """
    if left == right:
        return 1.0
    a, b = left.rsplit(".", 1)[1], right.rsplit(".", 1)[1]
    equal = used = 0
    for k in range(0, 2 * BINS, 2):
        x, y = a[k : k + 2], b[k : k + 2]
        if x != "--" or y != "--":
            used += 1
            equal += x == y
    if not used:
        return 0.0
    jaccard = max(0.0, (equal / used - 1 / 256) / (1 - 1 / 256))  # less chance matches
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Texts:
    """The fingerprint of a text, kept from its turn as next document to its own."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.hashes = PrefixHashes(text)
        self.fingerprint = self.hashes.fingerprint()

    def row(self, following: _Texts) -> tuple:
        changed = edited(self.text, following.text)
        hashes = PrefixHashes(changed)
        fingerprint = hashes.fingerprint()
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(changed.encode()).hexdigest(),
            self.fingerprint,
            fingerprint,
            likeness(self.fingerprint, fingerprint),
            likeness(self.fingerprint, following.fingerprint),
            self.hashes.common_extension(0, hashes, 0),
            self.hashes.common_extension(0, following.hashes, 0),
        )


_RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited bigint, common_next bigint"
)
_TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 2]


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (1 + len(_TYPES))
    arrays = [pa.array(c, t) for c, t in zip(columns, [id_type, *_TYPES], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The next document follows in the order of id and text, nulls first; after the last
    comes the first, a single document follows itself. A null text counts as empty. Rows
    are range-partitioned by id once; each task walks its span in order and holds two
    texts at a time. Between spans only the first and last row of each are joined.
    common_edited and common_next are the code points at the start that a text shares with
    its edited text and with the next document.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [part.split()[0] for part in _RESULT.split(", ")]
    all_names = ["id", *names]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = last = None

        def part(rows: list[tuple], role: str | None, texts: list[str | None]):
            done = _batch(rows, id_type, all_names)
            n = done.num_rows
            arrays = [
                *done.columns,
                pa.array([task] * n, pa.int32()),
                pa.array([role] * n, pa.string()),
                pa.array(texts if role else [None] * n, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=[*all_names, "task", "role", "text"])

        id_type = pa.int64()
        for batch in in_slices(batches):
            id_type = batch.column(0).type
            done = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                this = _Texts(doc_id, text)
                if last is None:
                    first = this
                else:
                    done.append(last.row(this))
                last = this
            yield part(done, None, [])
        for role, edge in (("first", first), ("last", last)):
            if edge is not None:
                yield part([(edge.doc_id, *[None] * len(_TYPES))], role, [edge.text])

    spans = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    walked = stored(
        spans.mapInArrow(walk, f"id {kind}, {_RESULT}, task int, role string, text string"),
        "fingerprints",
    )

    # one row for each task: its number and that of the next task that has rows
    firsts = walked.where("role = 'first'").select("task", F.col("text").alias("next_text"))
    tasks = firsts.select("task")
    order = W.orderBy("task")
    following = tasks.select(
        "task",
        F.coalesce(
            F.lead("task").over(order),
            F.first("task").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("next_task"),
    )
    edges = (
        walked.where("role = 'last'")
        .select("task", "id", "text")
        .join(following, "task")
        .join(firsts.withColumnRenamed("task", "next_task"), "next_task")
        .select("id", "text", "next_text")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, rows=64):
            done = []
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for doc_id, text, next_text in zip(*columns, strict=True):
                done.append(_Texts(doc_id, text).row(_Texts(None, next_text)))
            yield _batch(done, batch.column(0).type, all_names)

    closed = edges.mapInArrow(close, f"id {kind}, {_RESULT}")
    inner = walked.where("role is null").select(*all_names)
    return inner.unionByName(closed).withColumnRenamed("id", id_col)
