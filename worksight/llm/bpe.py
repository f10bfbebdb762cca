"""Byte-level BPE encoding and decoding by merge replay.

A block of texts is cut into its pieces, and every distinct piece of the block takes part
in one replay: an inverted index leads from each rank to the positions of the pairs that
merge into it, the ranks are applied in ascending order to all their positions at once,
and after each merge only the two touched neighbours enter the index anew. Texts are then
put together from the ids of their pieces.

The blocks are Arrow slices, so a task holds one slice, its distinct pieces and a bounded
cache, whatever the size of the corpus; nothing is shuffled and a lost task is run again.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import Numbering, in_slices, text_or_empty

# White space of the rank files' pattern: Unicode White_Space, unlike Python's wider \s.
_WHITE = r"\t-\r \x85\xa0  -     　"
_OTHER_WHITE = re.compile(rf"(?![ \n])[{_WHITE}]").search
# Chunks whose ids a worker keeps between blocks, about 250 bytes each.
CACHED_CHUNKS = 600_000


class Ragged(NamedTuple):
    """Lists of ids behind one another."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def pick(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of these numbers, one after the other."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(total)]

    def extended(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Ragged:
        return Ragged(
            np.concatenate((self.flat, flat)),
            np.concatenate((self.starts, starts + len(self.flat))),
            np.concatenate((self.lengths, lengths)),
        )

    def lists(self) -> Iterator[list[int]]:
        for start, length in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            yield self.flat[start : start + length].tolist()


class Ranks:
    """The merge ranks of a vocabulary file, and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            rank = {
                base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)
            }
        self.rank = rank
        self.token = [b""] * (max(rank.values()) + 1)
        for token, number in rank.items():
            self.token[number] = token
        self.decimal = [str(i) for i in range(len(self.token))]
        self._single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        # every pair of tokens that forms a token, and the rank of that token
        pairs = {
            rank[token[:cut]] << 32 | rank[token[cut:]]: number
            for token, number in rank.items()
            for cut in range(1, len(token))
            if token[:cut] in rank and token[cut:] in rank
        }
        self._keys = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[key] for key in self._keys.tolist()], np.int64)
        # tokens that can be part of a merge of a lower rank than their own
        self._can_fall = np.zeros(len(self.token), bool)
        for part in (self._keys >> 32, self._keys & 0xFFFFFFFF):
            self._can_fall[part[self._merged < part]] = True
        inside = pattern.replace(r"[^\s", rf"[^{_WHITE}")
        inside = inside.replace(r"\S", rf"[^{_WHITE}]").replace(r"\s", rf"[{_WHITE}]")
        self.pieces_of = regex.compile(inside).findall
        self._forget()

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of tokens form, -1 where they form none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        return np.where(self._keys[at] == wanted, self._merged[at], -1)

    def replay(self, words: list[bytes]) -> Ragged:
        """The ids of each word, all words merged together in rank order.

        Pairs of one rank that overlap merge from left to right. Where a merge can form a
        pair of a lower rank than its own, a word gets one merge at a time, so that the
        lower rank comes first.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbols = self._single[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, len(symbols) + 1)
        before = np.arange(-1, len(symbols) - 1)
        after[ends[lengths > 0] - 1] = -1
        before[starts[lengths > 0]] = -1

        # the index: positions of the left symbol of each pair, by the rank it merges into
        lefts = np.flatnonzero(after >= 0)
        ranks = self.merged(symbols[lefts], symbols[lefts + 1])
        lefts, ranks = lefts[ranks >= 0], ranks[ranks >= 0]
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def post(ranks: np.ndarray, positions: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            heads = ranks[np.concatenate(([0], cuts))].tolist()
            for rank, part in zip(heads, np.split(positions, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heappush(queue, rank)

        if len(lefts):
            post(ranks, lefts)
        while queue:
            rank = heappop(queue)
            at = np.sort(np.concatenate(index.pop(rank)))
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            right = after[at]
            live = (symbols[at] >= 0) & (right >= 0)
            at, right = at[live], right[live]
            live = self.merged(symbols[at], symbols[right]) == rank
            at, right = at[live], right[live]
            if len(at) > 1:
                overlaps = np.concatenate(([False], right[:-1] == at[1:]))
                if overlaps.any():  # of a run of overlapping pairs every second one merges
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(overlaps, 0, place))
                    keep = (place - run) % 2 == 0
                    at, right = at[keep], right[keep]
                if self._can_fall[rank]:
                    word = np.searchsorted(ends, at, side="right")
                    first = np.concatenate(([True], word[1:] != word[:-1]))
                    if not first.all():
                        index[rank] = [at[~first]]
                        heappush(queue, rank)
                        at, right = at[first], right[first]
            if not len(at):
                continue
            beyond = after[right]
            symbols[at], symbols[right] = rank, -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            # only the two neighbours of a merge form new pairs
            left = before[at]
            inside = left >= 0
            lefts = np.concatenate((at[inner], left[inside]))
            if len(lefts):
                new = self.merged(symbols[lefts], symbols[after[lefts]])
                found = new >= 0
                if found.any():
                    post(new[found], lefts[found])
        alive = symbols >= 0
        until = np.concatenate(([0], np.cumsum(alive)))
        return Ragged(symbols[alive], until[starts], until[ends] - until[starts])

    def _cut(self, text: str) -> list[str]:
        """The text in chunks that no piece crosses.

        Where spaces and line feeds stand alone between other characters, a piece always
        begins at a space, and a line feed is a piece of its own.
        """
        if (
            "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or text[:1] in ("", " ", "\n")
            or text[-1] in " \n"
            or _OTHER_WHITE(text)
        ):
            return self.pieces_of(text)
        chunks: list[str] = []
        for line in text.split("\n"):
            if chunks:
                chunks.append("\n")
            first, *rest = line.split(" ")
            chunks.append(first)
            chunks += [" " + word for word in rest]
        return chunks

    def _learn(self, chunks: list[str]) -> None:
        """Append the ids of chunks not seen before, all merged in one replay."""
        letters, word_number = str.isalpha, Numbering()
        numbers, counts = [], []
        for chunk in chunks:
            if letters(chunk[1:] if chunk[:1] == " " else chunk):
                numbers.append(word_number[chunk])
                counts.append(1)
            else:
                pieces = self.pieces_of(chunk)
                numbers += [word_number[piece] for piece in pieces]
                counts.append(len(pieces))
        words = self.replay([word.encode() for word in word_number])
        per_word = words.pick(np.array(numbers, np.int64))
        ends = np.cumsum(np.array(counts, np.int64))
        tokens_until = np.concatenate(([0], np.cumsum(words.lengths[numbers])))
        starts = tokens_until[ends - counts]
        self._known = self._known.extended(per_word, starts, tokens_until[ends] - starts)

    def encode(self, texts: list[str]) -> Ragged:
        """The ids of each text, as greedy merging by rank within each piece gives them.

        One replay serves all chunks of the block that no earlier block has had.
        """
        if len(self._number) > CACHED_CHUNKS:
            self._forget()
        known = len(self._number)
        cut = [self._cut(text) for text in texts]
        chunks = np.fromiter(map(len, cut), np.int64, len(cut))
        number = self._number.__getitem__
        numbers = np.fromiter(
            map(number, itertools.chain.from_iterable(cut)), np.int64, int(chunks.sum())
        )
        if len(self._number) > known:
            self._learn(list(itertools.islice(self._number, known, None)))
        until = np.concatenate(([0], np.cumsum(self._known.lengths[numbers])))
        ends = np.cumsum(chunks)
        starts = until[ends - chunks]
        return Ragged(self._known.pick(numbers), starts, until[ends] - starts)

    def _forget(self) -> None:
        self._number = Numbering()
        none = np.empty(0, np.int64)
        self._known = Ragged(none, none, none)

    def decode(self, ids: Iterable[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load_ranks(path: str, pattern: str) -> Ranks:
    """Once per worker process."""
    ranks = Ranks(path, pattern)
    gc.freeze()  # the tables stay; the collector need not walk them again and again
    return ranks


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id column and ``ids`` (array of int) of every row; a null text counts as empty.

    Other columns are left out, repeated rows give repeated rows, and an empty table gives
    an empty one. Long texts are encoded whole.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        for batch in in_slices(batches):
            ids = list(ranks.encode(batch.column(1).to_pylist()).lists())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"]
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"id {kind}, ids array<int>")
    return encoded.select(F.col("id").alias(id_col), "ids")


def decode_ids(
    encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Id column and ``decoded`` (binary) of every row of ids; a null list counts as empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        for batch in in_slices(batches):
            lists = batch.column(1).to_pylist()
            data = [ranks.decode(ids or ()) for ids in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary())], names=["id", "decoded"]
            )

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    decoded = rows.mapInArrow(decode, f"id {kind}, decoded binary")
    return decoded.select(F.col("id").alias(id_col), "decoded")


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every text in one pass and keep the digests of both.

    Returns the id column, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes). Nulls, empty and long texts as in
    ``encode_texts``.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        decimal = ranks.decimal
        for batch in in_slices(batches):
            counts, of_ids, of_bytes = [], [], []
            for ids in ranks.encode(batch.column(1).to_pylist()).lists():
                counts.append(len(ids))
                joined = ",".join([decimal[i] for i in ids])
                of_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(ranks.decode(ids)).hexdigest())
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(of_ids, pa.string()),
                pa.array(of_bytes, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    digests = rows.mapInArrow(digest, schema)
    return digests.withColumnRenamed("id", id_col)
