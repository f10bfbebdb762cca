"""Packing of tokenised documents by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are the powers of two of its length
(whole sequences first, then the binary digits of the rest). Every piece is a sequence of
its own and equal lengths form one bucket, so no sequence crosses documents and none needs
padding: batches are drawn from one bucket at a time.

One pass encodes and cuts the documents, without a shuffle of texts or ids. Sequences are
numbered by bucket from the counts per task and length.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worksight.llm.common import Numbering, in_slices, take_worker, text_or_empty
from worksight.llm.words import Numbered, WordNumbers, behind_one_another
from worksight.sources.scratch import stored

MAX_TOKENS = 4096
WORD_END = "</w>"  # fixed value: marks the last token of a word
PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"  # ASCII, without quotes and backslash
# Words whose ids a worker keeps between batches, about 100 bytes each.
CACHED_WORDS = 400_000


class WordIds:
    """Ids of texts by a lower-casing tokenizer that splits at white space and drops it.

    Such a tokenizer treats each word alone, so every distinct word is encoded once. Words of
    ASCII alone count as one whatever their case; others keep it, since the tokenizer composes
    characters before it lower-cases them. A run of letters followed by ASCII punctuation is
    encoded as these two, as the tokenizer's pattern does; runs of letters are encoded many at
    a time and told apart by their last token, which carries the word end. Special tokens that
    stand in a text are found as the tokenizer finds them. A file of another kind is refused.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if (
            [step["type"] for step in steps] != ["NFC", "Replace", "Lowercase"]
            or (steps[1]["pattern"], steps[1]["content"]) != ({"Regex": r"\s+"}, " ")
            or (cut.get("type"), cut.get("behavior"), cut.get("invert")) != ("Split", "Removed", True)
            or spec["post_processor"]
            or spec["model"].get("end_of_word_suffix") != WORD_END
            or any(re.search(r"\s", token["content"]) for token in spec["added_tokens"])
        ):
            raise ValueError(f"{path} is no lower-casing tokenizer that treats words alone")
        # the first letters of special tokens, whose case matters
        self.special = {token["content"][:2] for token in spec["added_tokens"]}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends_word[number] = token.endswith(WORD_END)
        self.numbers = WordNumbers(CACHED_WORDS)
        self.ids = np.zeros(0, "<u4")  # of all known words, one behind the other
        self.starts = np.zeros(1, np.int64)  # where those of each word start, and the end

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one behind the other, and how many each has."""
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        lists = [found.ids for found in encoded]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), "<u4", int(lengths.sum())), lengths

    def _runs_of_letters(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        for start in range(0, len(runs), 5_000):
            some = runs[start : start + 5_000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                parts.append((ids, np.diff(ends, prepend=0)))
            else:  # lower-casing made something else of a letter
                parts.append(self._one_by_one(some))
        ids, lengths = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one behind the other, and how many each has."""
        texts = b"\n".join(words).decode().split("\n")
        letters = [text.rstrip(PUNCTUATION) for text in texts]
        # some capitals become a letter and a mark, which joins what follows
        plain = [x.isalpha() and (x.isascii() or x.lower().isalpha()) for x in letters]
        runs = list(itertools.compress(letters, plain))
        # what follows the run, or a word of another kind as a whole; no text stands for nothing
        others = Numbering({"": 0})
        rest = [
            others[text[len(run) :] if is_plain else text]
            for text, run, is_plain in zip(texts, letters, plain, strict=True)
        ]
        run_ids, run_lengths = self._runs_of_letters(runs)
        other_ids, other_lengths = self._one_by_one(list(others))
        lengths = np.zeros((len(texts), 2), np.int64)
        lengths[plain, 0] = run_lengths
        lengths[:, 1] = other_lengths[rest]
        starts = np.zeros((len(texts), 2), np.int64)
        starts[plain, 0] = np.cumsum(run_lengths) - run_lengths
        starts[:, 1] = (np.cumsum(other_lengths) - other_lengths)[rest] + len(run_ids)
        values = np.concatenate((run_ids, other_ids))
        return behind_one_another(values, starts.ravel(), lengths.ravel()), lengths.sum(1)

    def _keep(self, found: Numbered) -> None:
        """The ids by word as the numbers now are."""
        lengths, known = np.diff(self.starts), self.ids
        if found.kept is not None:
            lengths = lengths[found.kept]
            known = behind_one_another(self.ids, self.starts[found.kept], lengths)
        ids, new_lengths = self._learn(found.new)
        self.ids = np.concatenate((known, ids))
        self.starts = np.concatenate(([0], np.cumsum(lengths), known.size + np.cumsum(new_lengths)))

    def _lowered(self, text: str, data: bytes) -> bytes:
        return data if any(start in text for start in self.special) else data.lower()

    def encode(self, texts: list[str], end_id: int) -> Iterator[bytes]:
        """The little-endian 32-bit ids of each text and the end id."""
        originals = [text.encode() for text in texts]
        lowered = list(map(self._lowered, texts, originals))
        found = self.numbers.of(lowered, originals)
        if found.new:
            self._keep(found)
        starts = self.starts[found.numbers]
        lengths = self.starts[found.numbers + 1] - starts
        behind = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(found.counts)]
        ids = np.insert(behind_one_another(self.ids, starts, lengths), behind, np.uint32(end_id))
        bounds = [0, *(4 * (behind + np.arange(1, len(texts) + 1))).tolist()]
        data = ids.tobytes()
        for start, end in itertools.pairwise(bounds):
            yield data[start:end]


@functools.lru_cache(maxsize=2)
def load_words(path: str) -> WordIds:
    words = WordIds(path)
    gc.freeze()
    return words


def piece_lengths(n_tokens: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Powers of two that add up to ``n_tokens``, none above ``max_tokens``, largest first."""
    whole, rest = divmod(n_tokens, max_tokens)
    digits = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    return [max_tokens] * whole + digits


def cut_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    max_tokens: int = MAX_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of every document.

    Columns: the id, start, length, ids_crc32, doc_tokens, input_ids (null unless
    ``with_ids``), and task and place, the task that cut the piece and its number among
    that task's pieces of this length. A null or empty text is the end id alone, one piece.
    ``max_tokens`` is a power of two.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packing", load_words.cache_clear)
        words = load_words(path)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in in_slices(batches, size=2 << 20):
            rows, starts, lengths, crcs, totals, places, ids = [], [], [], [], [], [], []
            encoded = words.encode(batch.column(1).to_pylist(), end_id)
            for row, data in enumerate(encoded):
                start, total = 0, len(data) // 4
                for length in piece_lengths(total, max_tokens):
                    piece = data[4 * start : 4 * (start + length)]
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
                    places.append(place)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
                    start += length
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int32())),
                    pa.array(starts, long),
                    pa.array(lengths, long),
                    pa.array(crcs, long),
                    pa.array(totals, long),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(places, long),
                    pa.array(ids if with_ids else [None] * len(rows), pa.list_(pa.int32())),
                ],
                names=names,
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "task int, place bigint, input_ids array<int>"
    )
    names = "id start length ids_crc32 doc_tokens task place input_ids".split()
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of task and place.

    Sequences are numbered from 0 without gaps, longest bucket first; the table must be a
    stored one. The counts are one row for each task and length, at most 13 a task.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    longer = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    in_bucket = counts.withColumn("in_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n"))  # one row for each length
    buckets = buckets.select(
        "length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("before_bucket")
    )
    first = in_bucket.join(F.broadcast(buckets), "length").select(
        "length", "task", (F.col("before_bucket") + F.col("in_bucket")).alias("first")
    )
    return (
        pieces.join(first, ["length", "task"])
        .withColumn("sequence_id", F.col("first") + F.col("place"))
        .withColumn("offset", F.lit(0).cast("bigint"))
        .drop("first", "task", "place")
    )


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    max_tokens: int = MAX_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """All documents as sequences of power-of-two length, one row for each piece.

    Columns: the id, start, length, ids_crc32, doc_tokens, input_ids, sequence_id, offset.
    A sequence is one piece, so offset is always 0 and no sequence is padded. Repeated rows
    are packed once each; an empty table gives an empty one; other columns are left out.
    """
    pieces = cut_documents(docs, path, end_id, max_tokens, id_col, text_col, with_ids)
    columns = f"{id_col} start length ids_crc32 doc_tokens input_ids sequence_id offset"
    return numbered(stored(pieces, "pieces")).select(*columns.split())


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("length").parquet(path)
