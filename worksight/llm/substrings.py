"""Removal of repeated byte strings by distributed prefix doubling.

A rank tells which byte strings of one length are equal. Ranks of 16 bytes are doubled up
to the threshold from pairs of ranks at growing offsets; after each step Spark brings equal
ranks together, sorts them, and tells every holder whether its rank also stands in another
or in an earlier document. Positions whose rank is unique drop out at once, and positions
past the threshold are settled.

Positions are thinned without losing a match: of the 16-byte strings inside every string of
the threshold's length the one of the smallest hash is its anchor, so two equal strings have
the same anchor at the same place. The steps are

1. ranks of 16 bytes at the anchors;
2. ranks of 33 bytes to the right and to the left of an anchor, one of which lies inside
   every string of 50 bytes with this anchor, and ranks of the strings from an anchor to a
   later one that reach the threshold: one of these in an earlier document settles all of
   its bytes;
3. which anchors the strings still open have, so that others send only theirs;
4. ranks of the whole threshold for the strings still open, and for those of the same anchors
   that no single span of an earlier document holds.

The texts are written once, in id order, as blocks of a bucketed table, with their anchors
(two small numbers for each). A step reads the blocks beside the answers of the earlier
steps, without a shuffle of texts; only distinct ranks of a block are sent, split by value over equal buckets, and one bit for each comes
back. A rank is a hash of 63 bits, so a false match among n ranks has the odds n**2 / 2**64.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import give_back, in_slices, take_worker, text_or_empty
from worksight.sources.scratch import keep_path, new_table_path, stored

BLOCK_BYTES = 4 << 20  # of text in a block; a longer text is a block of its own
BUCKET_BYTES = 16 << 20  # of text for each bucket of ranks
CHUNK = 1 << 18  # positions that are hashed in one go
GRAM = 16
STEPS = 4
_POSITION_BITS = 28
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xD6E8FEB86659FD93)
# the kinds of ranks, in the order of the steps
ANCHOR, RIGHT, LEFT, SPAN, WANTED, WHOLE = (_U(k) for k in range(1, 7))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _MIX
    return x ^ x >> _U(29)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a number; a view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _gram_keys(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every position."""
    words = _words(data).astype(_U)
    return _mixed(words[:-8] * _BASE + words[8:])


def _hashes_at(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes at some positions of the bytes that ``words`` views."""
    return _mixed((_mixed(words[positions] + _BASE) * _BASE) ^ words[positions + 8])


def _chained(kind: np.uint64, parts: list[np.ndarray]) -> np.ndarray:
    """One rank for several hashes in order; the lowest bit stays free for a mark."""
    out = np.full(len(parts[0]), kind, _U)
    for part in parts:
        out = _mixed((out ^ part) * _MIX + _U(0x632BE59BD9B4E019))
    return out & ~_U(1)


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


class Ranks:
    """Distinct ranks of a block in order, and for each entry its place among them."""

    def __init__(self, ranks: np.ndarray, docs: np.ndarray):
        order = np.argsort(ranks, kind="stable")  # documents stay in order
        ranks, docs = ranks[order], docs[order]
        new = np.ones(len(ranks), bool)
        new[1:] = ranks[1:] >> _U(1) != ranks[:-1] >> _U(1)
        starts = np.flatnonzero(new)
        ends = np.concatenate((starts[1:], [len(ranks)])) if len(starts) else starts
        self.place = np.empty(len(ranks), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.first = docs[starts]
        self.several = docs[ends - 1] != self.first
        marks = np.zeros(len(starts), _U)
        if len(starts):
            marks = np.bitwise_or.reduceat(ranks & _U(1), starts)
        self.distinct = ranks[starts] & ~_U(1) | marks


class Answer:
    """Bits that came back for the distinct ranks of a block."""

    def __init__(self, parts: list[dict], n: int):
        parts = sorted(parts, key=lambda part: part["bucket"])

        def plane(name: str) -> np.ndarray:
            bits = [
                np.unpackbits(np.frombuffer(part[name], np.uint8), count=part["n"])
                for part in parts
            ]
            found = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
            if len(found) != n:
                raise RuntimeError("answers do not fit the ranks of the block")
            return found

        self.shared, self.earlier, self.wanted = map(plane, ("shared", "earlier", "wanted"))


class Block:
    """Texts in id order, and what the steps so far tell about them."""

    def __init__(
        self, ids: list, lengths: list[int], data: bytes, threshold: int, anchors: bytes | None = None
    ):
        self.ids, self.threshold = ids, threshold
        self.data = np.frombuffer(data, np.uint8)
        self.words = _words(self.data)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        # repeated ids are one document
        number, numbers = -1, []
        for k, doc_id in enumerate(ids):
            number += k == 0 or doc_id != ids[k - 1]
            numbers.append(number)
        self.doc_of_row = np.array(numbers, np.int64)
        self._place(self.anchors() if anchors is None else anchors)

    @classmethod
    def of(cls, row: dict, threshold: int) -> Block:
        return cls(row["ids"], row["lengths"], row["data"], threshold, row["anchors"])

    def _segments(self) -> Iterator[tuple[int, int]]:
        """Stretches of the texts that hold about CHUNK positions where strings start."""
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            last = end - self.threshold
            for at in range(start, last + 1, CHUNK):
                yield at, min(at + CHUNK, last + 1) + self.threshold - 1

    def _anchored_strings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of all strings of the threshold's length, and of their anchors."""
        group: list[tuple[int, int]] = []
        size = 0
        for segment in self._segments():
            group.append(segment)
            size += segment[1] - segment[0]
            if size >= CHUNK:
                yield self._anchored(group)
                group, size = [], 0
        if group:
            yield self._anchored(group)

    def _anchored(self, group: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.concatenate([self.data[a:b] for a, b in group])
        sizes = np.array([b - a for a, b in group], np.int64)
        within = np.cumsum(sizes) - sizes  # where each segment starts in ``joined``
        shift = np.array([a for a, _ in group], np.int64) - within
        keys = _gram_keys(joined) >> _U(_POSITION_BITS) << _U(_POSITION_BITS)
        keys |= np.arange(len(keys), dtype=_U)
        least = _window_least(keys, self.threshold - GRAM + 1)
        # strings that lie in one segment
        starts = sizes - self.threshold + 1
        at = np.repeat(within - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
        anchors = (least[at] & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        move = np.repeat(shift, starts)
        return at + move, anchors + move

    def anchors(self) -> bytes:
        """For each anchor, how many strings in a row have it and its place in the first of them.

        From string to string the anchor stays or moves on, so that these tell all.
        """
        found, firsts, n = [], [], 0
        last = -1
        for at, anchors in self._anchored_strings():
            new = np.ones(len(anchors), bool)
            new[1:] = anchors[1:] != anchors[:-1]
            new[0] = anchors[0] != last
            last = int(anchors[-1])
            found.append((anchors - at)[new])
            firsts.append(np.flatnonzero(new) + n)
            n += len(at)
        if not found:
            return b""
        times = np.diff(np.concatenate([*firsts, [n]]))
        return np.stack((times, np.concatenate(found))).astype(self._narrow()).tobytes()

    def _narrow(self) -> type:
        """Of numbers up to the threshold."""
        return np.uint8 if self.threshold < 1 << 8 else np.uint32

    def _place(self, anchors: bytes) -> None:
        self.times, within = np.frombuffer(anchors, self._narrow()).reshape(2, -1).astype(np.int64)
        # strings are numbered through all texts; ``from_at`` is where those of an anchor begin
        strings = np.maximum(self.lengths - self.threshold + 1, 0)
        until = np.cumsum(strings)
        first = np.cumsum(self.times) - self.times
        self.row = np.searchsorted(until, first, side="right")
        self.from_at = first + (self.starts - (until - strings))[self.row]
        self.at = self.from_at + within
        self.doc = self.doc_of_row[self.row]
        self.hash = _hashes_at(self.words, self.at)

    def strings(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the strings that have wanted anchors, and numbers of their anchors."""
        chosen = np.flatnonzero(wanted)
        sizes = np.cumsum(self.times[chosen])
        cuts = np.searchsorted(sizes, np.arange(CHUNK, int(sizes[-1]) if len(sizes) else 0, CHUNK))
        for part in np.split(chosen, cuts):
            times = self.times[part]
            before = np.cumsum(times) - times
            at = np.repeat(self.from_at[part] - before, times) + np.arange(times.sum())
            yield at, np.repeat(part, times)

    # --- the steps: ranks to send, and what an answer to them means -------------------

    def ranks(self, answers: list[list[dict]]) -> Ranks:
        """The ranks of the step that follows the answered ones."""
        step, told = Ranks(_chained(ANCHOR, [self.hash]), self.doc), None
        steps = [self._after_anchors, self._after_spans, self._after_wanted]
        for parts, following in zip(answers, steps, strict=False):
            told = Answer(parts, len(step.distinct))
            step = following(step, told)
        return step

    def _after_anchors(self, step: Ranks, told: Answer) -> Ranks:
        shared = (told.shared | step.several)[step.place]
        self.chosen = np.flatnonzero(shared)
        at, row = self.at[self.chosen], self.row[self.chosen]
        half = (self.threshold - GRAM + 1) // 2  # bytes beside the anchor, at least
        self.half = half
        self.has_right = at + GRAM + half <= self.ends[row]
        self.has_left = at - half >= self.starts[row]
        right = self._rank(RIGHT, at[self.has_right], GRAM + half)
        left = self._rank(LEFT, at[self.has_left] - half, GRAM + half)
        # from a shared anchor over shared anchors to the first that reaches the threshold
        until = np.searchsorted(self.at, at + self.threshold - GRAM)
        inside = until < len(self.at)
        until[~inside] = 0
        total = np.concatenate(([0], np.cumsum(shared)))
        inside &= self.row[until] == row
        inside &= total[until + 1] - total[self.chosen] == until + 1 - self.chosen
        self.span_from = at[inside]
        self.span_to = self.at[until[inside]] + GRAM
        span = self._rank(SPAN, self.span_from, self.span_to - self.span_from)
        doc = self.doc[self.chosen]
        self.sent = np.concatenate((doc[self.has_right], doc[self.has_left], doc[inside]))
        return Ranks(np.concatenate((right, left, span)), self.sent)

    def _after_spans(self, step: Ranks, told: Answer) -> Ranks:
        shared = (told.shared | step.several)[step.place]
        earlier = told.earlier[step.place] | (self.sent > step.first[step.place])
        n_right, n_left = int(self.has_right.sum()), int(self.has_left.sum())
        settled = earlier[n_right + n_left :]
        edges = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edges, self.span_from[settled], 1)
        np.add.at(edges, self.span_to[settled], -1)
        self.removed = np.cumsum(edges[:-1]) > 0
        # how far a single settled span that starts no later than here reaches
        self.reach = np.zeros(len(self.data) + 1, np.int32)
        np.maximum.at(self.reach, self.span_from[settled], self.span_to[settled])
        np.maximum.accumulate(self.reach, out=self.reach)

        def by_anchor(flags: np.ndarray, which: np.ndarray) -> np.ndarray:
            out = np.zeros(len(self.at), bool)
            out[self.chosen[which]] = flags
            return out

        right, left = slice(0, n_right), slice(n_right, n_right + n_left)
        self.right_shared = by_anchor(shared[right], self.has_right)
        self.right_earlier = by_anchor(earlier[right], self.has_right)
        self.left_shared = by_anchor(shared[left], self.has_left)
        self.left_earlier = by_anchor(earlier[left], self.has_left)
        asked = np.zeros(len(self.at), bool)
        for _, anchor, open_strings, _ in self._open_strings():
            asked[anchor[open_strings]] = True
        self.known = np.flatnonzero(self.right_shared | self.left_shared)
        ranks = _chained(WANTED, [self.hash[self.known]]) | asked[self.known].astype(_U)
        return Ranks(ranks, self.doc[self.known])

    def _open_strings(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Strings that are open or may answer: position, anchor, whether open, whether shared.

        Open ones are not settled and may stand in an earlier document; shared ones may be
        what others have open. Only a string inside a single settled span can't answer, for
        it stands in an earlier document together with the span. One whose bytes several
        spans settle may stand here first.
        """
        settled = np.concatenate(([0], np.cumsum(self.removed)))
        either = self.right_shared | self.left_shared
        for at, anchor in self.strings(either):
            to_right = at + self.threshold - self.at[anchor] - GRAM >= self.half
            shared = np.where(to_right, self.right_shared[anchor], self.left_shared[anchor])
            earlier = np.where(to_right, self.right_earlier[anchor], self.left_earlier[anchor])
            left_over = settled[at + self.threshold] - settled[at] < self.threshold
            keep = np.flatnonzero(shared & (self.reach[at] < at + self.threshold))
            yield at[keep], anchor[keep], (earlier & left_over)[keep], shared[keep]

    def _after_wanted(self, step: Ranks, told: Answer) -> Ranks:
        wanted = np.zeros(len(self.at), bool)
        wanted[self.known] = told.wanted[step.place]
        positions, asking = [], []
        for at, anchor, is_open, _ in self._open_strings():
            keep = is_open | wanted[anchor]
            positions.append(at[keep])
            asking.append(is_open[keep])
        none = np.empty(0, np.int64)
        self.open_at = np.concatenate([none, *positions])
        self.open = np.concatenate([none.astype(bool), *asking])
        row = np.searchsorted(self.ends, self.open_at, side="right")
        self.sent = self.doc_of_row[row]
        return Ranks(self._rank(WHOLE, self.open_at, self.threshold), self.sent)

    def finish(self, answers: list[list[dict]]) -> np.ndarray:
        """Which bytes of the block go, after all four answers."""
        step = self.ranks(answers[:3])
        told = Answer(answers[3], len(step.distinct))
        earlier = told.earlier[step.place] | (self.sent > step.first[step.place])
        gone = self.open_at[earlier & self.open]
        edges = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + self.threshold, -1)
        return self.removed | (np.cumsum(edges[:-1]) > 0)

    def _rank(self, kind: np.uint64, at: np.ndarray, length) -> np.ndarray:
        """Ranks of strings from pairs of 16-byte ranks at growing offsets."""
        length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
        longest = int(length.max()) if len(at) else GRAM
        parts = [
            _hashes_at(self.words, at + np.minimum(offset, length - GRAM))
            for offset in range(0, longest, GRAM)
        ]
        return _chained(kind, [length.astype(_U), *parts])


def _blocks(
    rows: DataFrame, n_parts: int, block_bytes: int, threshold: int, name: str
) -> DataFrame:
    """Blocks of texts in id order, with their anchors, as a table bucketed by ``block``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("substrings", lambda: None)
        task = TaskContext.get().partitionId()
        number, ids, texts, size = 0, [], [], 0

        def block() -> pa.RecordBatch:
            lengths, data = [len(t) for t in texts], b"".join(texts)
            anchors = Block(ids, lengths, data, threshold).anchors()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | number], pa.int64()),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                    pa.array([anchors], pa.binary()),
                    pa.array([extras], pa.list_(extra_type)),
                ],
                names=["block", "ids", "lengths", "data", "anchors", "extras"],
            )

        id_type = extra_type = None
        extras: list = []
        for batch in in_slices(batches):
            id_type, extra_type = batch.column(0).type, batch.column(2).type
            columns = (batch.column(k).to_pylist() for k in range(3))
            for doc_id, text, extra in zip(*columns, strict=True):
                data = text.encode()
                if ids and size + len(data) > block_bytes and doc_id != ids[-1]:
                    yield block()
                    number, ids, texts, extras, size = number + 1, [], [], [], 0
                ids.append(doc_id)
                texts.append(data)
                extras.append(extra)
                size += len(data)
        if ids:
            yield block()

    kind = rows.schema["id"].dataType.simpleString()
    spark = rows.sparkSession
    extra = rows.schema["extra"].dataType.simpleString()
    schema = (
        f"block bigint, ids array<{kind}>, lengths array<bigint>, data binary, "
        f"anchors binary, extras array<{extra}>"
    )
    path = new_table_path(spark, "text-blocks")
    keep_path(spark, path)
    ordered = rows.repartitionByRange(n_parts, "id").sortWithinPartitions("id", "text")
    (
        ordered.mapInArrow(cut, schema)
        .write.bucketBy(n_parts, "block")
        .option("path", path)
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files stay where they are
    return blocks


_ANSWER = "struct<step:int,bucket:int,n:int,shared:binary,earlier:binary,wanted:binary>"


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Each block beside the answers it got so far; the blocks are not shuffled."""
    blocks = blocks.drop("extras") if len(answers) < STEPS else blocks
    if not answers:
        return blocks.withColumn("answers", F.lit(None).cast(f"array<{_ANSWER}>"))
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    by_block = every.groupBy("block").agg(
        F.collect_list(F.struct("step", "bucket", "n", "shared", "earlier", "wanted")).alias(
            "answers"
        )
    )
    return blocks.join(by_block, "block", "left")


def _by_step(parts: list[dict] | None, n: int) -> list[list[dict]]:
    return [[part for part in parts or [] if part["step"] == step] for step in range(n)]


def _exchange(blocks: DataFrame, answers: list[DataFrame], threshold: int, buckets: int):
    """The answers to the next step's ranks, one row for each block and bucket."""
    step = len(answers)
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], _U)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("substrings", lambda: None)
        for batch in in_slices(batches, rows=1):
            (row,) = batch.to_pylist()
            block = Block.of(row, threshold)
            ranks = block.ranks(_by_step(row["answers"], step)).distinct
            parts = np.split(ranks, np.searchsorted(ranks, bounds))
            sent = [(k, part) for k, part in enumerate(parts) if len(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in sent], pa.int32()),
                    pa.array([row["block"]] * len(sent), pa.int64()),
                    pa.array([part.tobytes() for _, part in sent], pa.binary()),
                ],
                names=["bucket", "block", "ranks"],
            )
            give_back()

    def answer(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("block")
        lists = [np.frombuffer(x, _U) for x in bucket.column("ranks").to_pylist()]
        sizes = [len(x) for x in lists]
        ranks = np.concatenate(lists)
        order = np.argsort(ranks >> _U(1), kind="stable")  # earlier blocks first
        ranks = ranks[order]
        new = np.ones(len(ranks), bool)
        new[1:] = ranks[1:] >> _U(1) != ranks[:-1] >> _U(1)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        marked = np.bitwise_or.reduceat(ranks & _U(1), starts).astype(bool)
        several = np.diff(np.concatenate((starts, [len(ranks)]))) > 1
        planes = []
        for in_order in (several[group], ~new, marked[group]):
            bits = np.empty(len(ranks), bool)
            bits[order] = in_order
            cuts = np.split(bits, np.cumsum(sizes)[:-1])
            planes.append(pa.array([np.packbits(part).tobytes() for part in cuts], pa.binary()))
        n = len(sizes)
        return pa.table(
            [
                bucket.column("block"),
                pa.array([step] * n, pa.int32()),
                bucket.column("bucket"),
                pa.array(sizes, pa.int32()),
                *planes,
            ],
            names=["block", "step", "bucket", "n", "shared", "earlier", "wanted"],
        )

    schema = "block bigint, step int, bucket int, n int, shared binary, earlier binary, wanted binary"
    sent = _with_answers(blocks, answers).mapInArrow(
        send, "bucket int, block bigint, ranks binary"
    )
    return stored(sent.groupBy("bucket").applyInArrow(answer, schema), f"answers-{step}")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = 50,
    carry: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
    as_text: bool = False,
) -> DataFrame:
    """Every text without the bytes that an earlier document has in a string of ``threshold``.

    Columns: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept
    (the remaining bytes; ``as_text``, the text they are without what is left of characters
    that were cut through) and extra, a struct of the columns to ``carry`` along. A byte goes
    when a string of ``threshold`` bytes that covers it also starts in a document with a smaller id; strings are judged on the input. A null
    text counts as empty. Rows that repeat an id are one document and don't remove from one
    another; rows without an id are kept whole and remove nothing. ``threshold`` is at least
    2 * 16 + 1.
    """
    if threshold <= 2 * GRAM:
        raise ValueError(f"threshold must be above {2 * GRAM}")
    carried = [F.col(c) for c in carry] or [F.lit(True).alias("none")]
    rows = docs.select(
        F.col(id_col).alias("id"),
        text_or_empty(F.col(text_col)).alias("text"),
        F.struct(*carried).alias("extra"),
    )
    named = rows.where("id is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, math.ceil(size / block_bytes))
    blocks = _blocks(named, n_parts, block_bytes, threshold, f"text_blocks_{uuid.uuid4().hex}")
    buckets = max(1, math.ceil(size / (BUCKET_BYTES // BLOCK_BYTES * block_bytes)))
    answers: list[DataFrame] = []
    for _ in range(STEPS):
        answers.append(_exchange(blocks, answers, threshold, buckets))

    names = "id n_bytes n_removed n_spans kept_sha256 kept extra".split()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, rows=1):
            (row,) = batch.select(["ids", "lengths", "data", "anchors", "answers"]).to_pylist()
            block = Block.of(row, threshold)
            gone = block.finish(_by_step(row["answers"], STEPS))
            removed, spans, digests, kept = [], [], [], []
            for start, end in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
                part = gone[start:end]
                rest = block.data[start:end][~part].tobytes()
                removed.append(int(part.sum()))
                spans.append(int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids")[0].values,
                    pa.array(block.lengths, long),
                    pa.array(removed, long),
                    pa.array(spans, long),
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.string() if as_text else pa.binary()),
                    batch.column("extras")[0].values,
                ],
                names=names,
            )
            give_back()

    kind = rows.schema["id"].dataType.simpleString()
    kept_type = "string" if as_text else "binary"
    schema = (
        f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        f"kept {kept_type}, extra {rows.schema['extra'].dataType.simpleString()}"
    )
    done = _with_answers(blocks, answers).mapInArrow(finish, schema)
    data = F.col("text").cast("binary")
    unnamed = rows.where("id is null").select(
        "id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(data, 256).alias("kept_sha256"),
        data.cast(kept_type).alias("kept"),
        "extra",
    )
    return done.unionByName(unnamed).withColumnRenamed("id", id_col)


def whole_characters(kept: str) -> Column:
    """Bytes as text, without what is left of characters that were cut through."""

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    return decode(kept)
