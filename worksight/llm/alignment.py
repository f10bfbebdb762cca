"""Alignment of two tokenizers over the same texts, and how their ids correspond in a corpus.

A is a byte-level BPE, B a sentencepiece model. Both give the bytes of a text in tokens, so
each has a rising list of byte offsets where its tokens end. Merging the two lists finds the
offsets where tokens of both end; these cut a text into groups, and the two tokens that end
at such an offset are a link.

The lists of all texts of a slice are merged along the merge path: binary searches on equally
spaced diagonals divide the merge into independent pieces of equal work, whatever the lengths
of the texts. Each piece emits the offsets both of its parts have; an offset whose two tokens
fall on the two sides of a cut is found when the pieces are stitched, and groups that run
across pieces close there.

Texts are encoded once. Per text a task stores digests and the numbers of its links among the
distinct id pairs of its block of texts; only the distinct pairs of a block, not the links,
meet the corpus-wide counts, and they come back block by block.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worksight.llm.common import in_slices, text_or_empty
from worksight.operators.keyed_join import attach
from worksight.sources.scratch import stored

PIECE = 8192  # steps of the merge in one piece
SLICE_BYTES = 2 << 20  # bytes of the texts of a block, or one longer text
# The pattern that byte-level tokenizers of this kind cut texts by: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The fast encoder's pattern engine has a bounded stack; longer runs take the plain encoder.
_LONG_WHITE = re.compile(r"\s{2000}").search
SPACE_MARK = "▁"  # fixed value: stands for a space in sentencepiece pieces


class Encoded(NamedTuple):
    """Token ids of several texts behind one another, and the number of each text's tokens."""

    ids: np.ndarray
    counts: np.ndarray


def _encoded(lists: list[list[int]]) -> Encoded:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [np.array(ids, np.int32) for ids in lists]
    return Encoded(np.concatenate(flat) if flat else np.empty(0, np.int32), counts)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: the byte itself, or 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids and token bytes of a byte-level BPE given as a tokenizer file.

    Where the merges of the file stand in the order of the ids they form, which is checked,
    merging by lowest id is the same as merging by the file, and a faster encoder does it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._path, self._library = path, None
        alphabet = _byte_alphabet()
        special = {token["id"] for token in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if number not in special:
                self.token[number] = bytes(alphabet[letter] for letter in token)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        formed = [vocabulary[left + right] for left, right in merges]
        cutter = spec["pre_tokenizer"] or {}
        ordered = (
            formed == sorted(set(formed))
            and formed[:1] > [max(vocabulary[letter] for letter in alphabet)]
            and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
            and spec["normalizer"] is None
            and not spec["model"].get("ignore_merges")
        )
        self._fast = None
        if ordered:
            ranks = {token: number for number, token in enumerate(self.token) if token}
            self._fast = tiktoken.Encoding(
                "a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary

    def _plain(self, text: str) -> list[int]:
        if self._library is None:  # large, and seldom needed
            self._library = Tokenizer.from_file(self._path)
            self._library.encode_special_tokens = True  # in a text they are ordinary text
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self._fast(text)
            if self._fast and (len(text) < 2000 or not _LONG_WHITE(text))
            else self._plain(text)
            for text in texts
        ]


class Pieces:
    """Ids and token bytes of a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token = []
        for number in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(number)
            if self._model.is_byte(number):
                self.token.append(bytes([int(piece[3:5], 16)]))
            else:
                self.token.append(piece.replace(SPACE_MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How much of ``a`` and of ``b`` lies before each cut of their merge into equal pieces.

    Cut k falls after k * piece steps; of equal values that of ``a`` comes first. All cuts
    are searched at once: on a diagonal, a[i] <= b[d - i - 1] holds up to one i.
    """
    steps = np.append(np.arange(0, len(a) + len(b), piece, dtype=np.int64), len(a) + len(b))
    low, high = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low, steps - low
        middle = (low + high) >> 1
        before = np.zeros(len(steps), bool)
        before[open_] = a[middle[open_]] <= b[steps[open_] - middle[open_] - 1]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)


def _overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising lists of the values that both have."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b, a)
    found = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return found, at[found]


def common_ends(
    a: np.ndarray, b: np.ndarray, piece: int = PIECE
) -> tuple[np.ndarray, np.ndarray]:
    """Places in the rising lists ``a`` and ``b`` of all values that both have, piece by piece."""
    in_a, in_b = diagonals(a, b, piece)
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(len(in_a) - 1):
        start_a, start_b = in_a[k], in_b[k]
        # of a value that is cut through, a's lies before the cut and b's right behind it
        if k and start_a and start_b < len(b) and a[start_a - 1] == b[start_b]:
            lefts.append(np.array([start_a - 1]))
            rights.append(np.array([start_b]))
        left, right = _overlaps(a[start_a : in_a[k + 1]], b[start_b : in_b[k + 1]])
        lefts.append(left + start_a)
        rights.append(right + start_b)
    return np.concatenate(lefts), np.concatenate(rights)


class Aligned(NamedTuple):
    """The tokens of several texts, and the last token of each of their groups on both sides.

    ``groups`` counts the groups of each text; texts that don't align have no tokens.
    """

    a: Encoded
    b: Encoded
    last_a: np.ndarray
    last_b: np.ndarray
    groups: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.length_a = np.fromiter(map(len, self.a.token), np.int64, len(self.a.token))
        self.length_b = np.fromiter(map(len, self.b.token), np.int64, len(self.b.token))
        # decimal ids followed by what comes next: more of the run, the other side, a new group
        self.shown = [f"{i}{mark}" for mark in ",|" for i in range(len(self.a.token))]
        self.shown_b = len(self.shown)
        self.shown += [f"{i}{mark}" for mark in ",;" for i in range(len(self.b.token))]

    def align(self, texts: list[str]) -> Aligned:
        spaced = [" " + text for text in texts]
        of_a, of_b = self.a.encode(spaced), self.b.encode(texts)
        for k, text in enumerate(spaced):
            data = text.encode()
            same = len(text) > 1 and all(
                b"".join(map(side.token.__getitem__, ids)) == data
                for side, ids in ((self.a, of_a[k]), (self.b, of_b[k]))
            )
            if not same:
                of_a[k] = of_b[k] = []
        a, b = _encoded(of_a), _encoded(of_b)
        # offsets go on from text to text, as both sides have the same bytes of each
        ends_a, ends_b = np.cumsum(self.length_a[a.ids]), np.cumsum(self.length_b[b.ids])
        last_a, last_b = common_ends(ends_a, ends_b)
        until = np.cumsum(a.counts)
        groups = np.diff(np.searchsorted(last_a, until), prepend=0)
        return Aligned(a, b, last_a, last_b, groups)

    def digests(self, found: Aligned) -> list[str]:
        """sha256 of a text's groups as ``a1,a2|b1;a3|b2,b3``; an empty text without tokens."""
        n_a, n_b = len(found.a.ids), len(found.b.ids)
        group_a = np.searchsorted(found.last_a, np.arange(n_a))
        group_b = np.searchsorted(found.last_b, np.arange(n_b))
        shown_a = found.a.ids.astype(np.int64)
        shown_a[found.last_a] += len(self.a.token)
        shown_b = found.b.ids.astype(np.int64) + self.shown_b
        shown_b[found.last_b] += len(self.b.token)
        before_b = np.concatenate(([0], found.last_b + 1))  # tokens of b before a group
        order = np.empty(n_a + n_b, np.int64)
        order[np.arange(n_a) + before_b[group_a]] = shown_a
        order[np.arange(n_b) + found.last_a[group_b] + 1] = shown_b
        ends = np.cumsum(found.a.counts + found.b.counts).tolist()
        out, start = [], 0
        for end in ends:
            if end == start:
                out.append("")
                continue
            joined = "".join(map(self.shown.__getitem__, order[start:end].tolist()))
            out.append(hashlib.sha256(joined[:-1].encode()).hexdigest())
            start = end
        return out


@functools.lru_cache(maxsize=1)
def load_aligner(path_a: str, path_b: str) -> Aligner:
    """Once per worker process."""
    aligner = Aligner(path_a, path_b)
    gc.freeze()
    return aligner


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def align_texts(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The tokens and groups of every row.

    Columns: the id, a_ids and b_ids (arrays of int), a_until and b_until (for each group,
    the number of tokens of the text up to its end). A text that is null, empty, or whose
    tokens of one side don't give back a space and the text, has empty arrays. Repeated rows
    give repeated rows, an empty table an empty one; other columns are left out. Texts are
    taken whole; a text longer than a slice is a slice of its own.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        for batch in in_slices(batches, size=SLICE_BYTES):
            found = aligner.align(batch.column(1).to_pylist())
            group_text = np.repeat(np.arange(len(found.groups)), found.groups)
            starts = [np.cumsum(side.counts) - side.counts for side in (found.a, found.b)]
            columns = [
                batch.column(0),
                _lists(found.a.ids, found.a.counts, pa.int32()),
                _lists(found.b.ids, found.b.counts, pa.int32()),
                _lists(found.last_a + 1 - starts[0][group_text], found.groups, pa.int32()),
                _lists(found.last_b + 1 - starts[1][group_text], found.groups, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows, kind = _texts(docs, id_col, text_col)
    names = "id a_ids b_ids a_until b_until".split()
    schema = f"id {kind}, " + ", ".join(f"{name} array<int>" for name in names[1:])
    return rows.mapInArrow(align, schema).withColumnRenamed("id", id_col)


def _blocks(rows: DataFrame, kind: str, path_a: str, path_b: str) -> DataFrame:
    """Encoded blocks of texts: a row for each text, and one for the id pairs of the block.

    ``links`` numbers the pairs of a text's links among the distinct ``pairs`` of the block,
    which ``counts`` counts; a pair is a_id << 32 | b_id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in in_slices(batches, size=SLICE_BYTES):
            found = aligner.align(batch.column(1).to_pylist())
            linked = found.a.ids[found.last_a].astype(np.int64) << 32 | found.b.ids[found.last_b]
            pairs, place, counts = np.unique(linked, return_inverse=True, return_counts=True)
            n = batch.num_rows
            columns = [
                pa.array(np.full(n, block), pa.int64()),
                batch.column(0),
                pa.array(found.a.counts),
                pa.array(found.b.counts),
                pa.array(found.groups, pa.int64()),
                pa.array(aligner.digests(found), pa.string()),
                _lists(place, found.groups, pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())),
                pa.nulls(n, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            columns = [
                pa.array([block], pa.int64()),
                *(pa.nulls(1, column.type) for column in columns[1:7]),
                _lists(pairs, np.array([len(pairs)]), pa.int64()),
                _lists(counts, np.array([len(pairs)]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            block += 1

    names = "block id n_a n_b n_groups groups_sha256 links pairs counts".split()
    schema = (
        f"block bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, "
        "groups_sha256 string, links array<int>, pairs array<bigint>, counts array<bigint>"
    )
    return rows.mapInArrow(encode, schema)


def _counted(blocks: DataFrame) -> DataFrame:
    """pair, n (links that hold it), n_blocks, best (no pair of its b id has more)."""
    held = blocks.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "counts")))
    totals = held.groupBy(F.col("pairs").alias("pair")).agg(
        F.sum("counts").alias("n"), F.count("*").alias("n_blocks")
    )
    totals = stored(totals, "pair-counts")
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # one row for each id of b, so the vocabulary bounds it
    highest = totals.groupBy(of_b.alias("b_id")).agg(F.max("n").alias("highest"))
    return (
        totals.withColumn("b_id", of_b)
        .join(F.broadcast(highest), "b_id")
        .select("pair", "n", "n_blocks", (F.col("n") == F.col("highest")).alias("best"))
    )


def pair_counts(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """a_id, b_id, n (links of the whole corpus) and best (highest of its b id, ties included)."""
    rows, kind = _texts(docs, id_col, text_col)
    counted = _counted(stored(_blocks(rows, kind, path_a, path_b), "aligned-blocks"))
    return counted.select(
        F.shiftright("pair", 32).cast("int").alias("a_id"),
        F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"),
        "n",
        "best",
    )


def alignment_statistics(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens, groups and links of every row, its links weighed by the whole corpus.

    Columns: the id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest
    count of its b id, ties included), count_sum (the counts of the pairs of all links) and
    groups_sha256 (of the groups as ``a1,a2|b1;a3|b2,b3``). Rows without tokens, as in
    ``align_texts``, have zeros and an empty digest. Repeated rows count as often as they
    stand there, and a null id is kept.
    """
    rows, kind = _texts(docs, id_col, text_col)
    blocks = stored(_blocks(rows, kind, path_a, path_b), "aligned-blocks")
    counted = stored(_counted(blocks), "known-pairs")
    wanted = blocks.where("pairs is not null").select(
        "block", F.posexplode("pairs").alias("place", "pair")
    )
    known = attach(wanted, counted, ["pair"], "n_blocks", spread_by="block", how="inner")
    of_block = known.select(F.col("block").alias("of"), "place", "n", "best")
    names = "id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()

    def weigh(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        n = np.zeros(pairs.num_rows, np.int64)
        best = np.zeros(pairs.num_rows, np.int64)
        place = pairs.column("place").to_numpy()
        n[place] = pairs.column("n").to_numpy()
        best[place] = pairs.column("best").to_numpy()
        links = texts.column("links").combine_chunks()
        groups = texts.column("n_groups").to_numpy()
        flat = links.flatten().to_numpy()
        until = np.concatenate(([0], np.cumsum(groups)))

        def summed(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(values[flat])))
            return sums[until[1:]] - sums[until[:-1]]

        columns = [texts.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_groups")]
        columns += [pa.array(summed(best)), pa.array(summed(n)), texts.column("groups_sha256")]
        return pa.table(columns, names=names)

    texts = blocks.where("pairs is null").drop("pairs", "counts")
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"
    weighed = texts.groupBy("block").cogroup(of_block.groupBy("of")).applyInArrow(weigh, schema)
    return weighed.withColumnRenamed("id", id_col)
