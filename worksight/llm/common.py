"""Helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.sources.workers import ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def in_slices(
    batches: Iterable[pa.RecordBatch], rows: int = 10_000, size: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes.

    A task so holds few texts at once; a single longer text is a batch of its own.
    """
    for batch in batches:
        parts = max(1, -(-batch.nbytes // size), -(-batch.num_rows // rows))
        step = max(1, -(-batch.num_rows // parts))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


# The operator that this Python worker last worked for, and what drops its caches.
_worker: dict[str, object] = {"owner": None, "clear": None}


def give_back() -> None:
    """Give freed memory of this process back to the system, where its C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def take_worker(owner: str, clear: Callable[[], None]) -> None:
    """To be called where a task of ``owner`` begins in a Python worker.

    Workers outlive jobs; what another operator keeps in this one is dropped, and its memory
    given back to the system, so that caches of successive stages don't add up.
    """
    if _worker["owner"] == owner:
        return
    if _worker["clear"] is not None:
        _worker["clear"]()
        gc.unfreeze()
        gc.collect()
        give_back()
    _worker.update(owner=owner, clear=clear)


class BoundedCache(dict):
    """Results by key for repeated keys; emptied once it holds ``limit`` of them."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room_for(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()


class Numbering(dict):
    """Consecutive numbers for keys, given at the first lookup."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of two rows or more from batches sorted by ``keys``."""
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not rest.num_rows:
            continue
        rest = rest.combine_chunks()
        columns = [rest.column(k).to_numpy() for k in keys]
        new = np.zeros(rest.num_rows, bool)
        new[0] = True
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        ends = np.concatenate((starts[1:], [rest.num_rows]))
        if batch is not None:  # the last group may go on in the next batch
            starts, ends, tail = starts[:-1], ends[:-1], int(starts[-1])
        else:
            tail = rest.num_rows
        whole = rest.to_batches()[0]
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start > 1:
                yield whole.slice(start, end - start)
        rest = rest.slice(tail)
