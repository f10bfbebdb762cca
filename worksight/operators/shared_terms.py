"""Terms that two or more works have, and the works that consist of such terms enough.

Each work sends every one of its distinct terms once, as packed arrays of codes: a slice of
works makes one row per bucket of codes. A bucket holds all works of its codes, so it counts
works and projects of each term and adds up, per work, the squared weights of shared terms
against those of the others. Only these sums go back, one short number per work and bucket.
Every task gets one bucket, and a bucket hears of a slice's works that have terms in it alone,
so what a task holds follows its terms, however many works and tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.sources.workers import ship_code

# A slice of works ends at about so many terms, counted with repeats, or so many works.
SLICE_TERMS = 1_000_000
SLICE_WORKS = 10_000
# A task weighs the terms of about so many characters of words.
TASK_CHARACTERS = 16_000_000
# A bucket's number has two bytes in a slice of works.
MAX_BUCKETS = 1 << 16
# The bound on the sums has this slack; as 2-byte floats they go back rounded up.
SUM_SLACK = 1e-6
_HALF_RANGE = 60_000.0

_PACKED = (
    "slice long, bucket int, keys binary, works int, places binary, n_docs binary, "
    "n_projects binary, counts binary, code binary, check binary, tf binary"
)
_WEIGHED = (
    "slice long, keys binary, sums binary, "
    "code long, check short, n_works long, df long, clashes boolean"
)


def weighed_terms(hashed: DataFrame, least: float) -> DataFrame:
    """Two kinds of rows: shared terms (``terms_of``) and sums of works (``keys_of``).

    ``hashed`` has key, n_projects, n_docs, n_characters, code and check (arrays of equal
    length); terms are equal if code and check are.
    """
    ship_code(hashed.sparkSession)
    size = hashed.agg(F.coalesce(F.sum("n_characters"), F.lit(0))).first()[0]
    least_tasks = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(max(least_tasks, -(-size // TASK_CHARACTERS)), MAX_BUCKETS)
    labels = _labels(hashed.sparkSession, tasks)
    packed = hashed.select("key", "n_projects", "n_docs", "code", "check").mapInArrow(
        lambda batches: _packed(batches, labels), _PACKED
    )
    dealt = packed.repartition(tasks, "bucket")
    return dealt.mapInArrow(lambda batches: _weighed(batches, least), _WEIGHED)


def _labels(spark: SparkSession, tasks: int) -> np.ndarray:
    """A number for each bucket, of which Spark's hash deals every task one."""
    labels, tried, step = np.full(tasks, -1, np.int32), 0, 16 * tasks + 64
    while (labels < 0).any():
        some = spark.range(tried, tried + step, 1, 1).select(F.col("id").cast("int").alias("label"))
        dealt = some.groupBy(F.pmod(F.hash("label"), F.lit(tasks)).alias("task"))
        for row in dealt.agg(F.min("label").alias("label")).collect():  # one row for each task
            if labels[row["task"]] < 0:
                labels[row["task"]] = row["label"]
        tried += step
    return labels


def terms_of(weighed: DataFrame) -> DataFrame:
    """code, check, n_works, df (projects) and clashes (whether other terms have the code)."""
    return weighed.where("code is not null").select("code", "check", "n_works", "df", "clashes")


def keys_of(weighed: DataFrame) -> DataFrame:
    """key of the works whose shared terms make up ``least`` of their squared norm.

    Works that miss it by little may be among them, none that reach it are absent.
    """
    sums = weighed.where("slice is not null").select("slice", "keys", "sums")
    return sums.groupBy("slice").applyInArrow(_kept_keys, "key long")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work_id, code, check, tf: one row per distinct term of a work, from arrays of them."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1_000):
            works = batch.slice(a, 1_000)
            lengths = works["code"].value_lengths().to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(works.num_rows, dtype=np.uint16), lengths)
            code, check, place, tf = _distinct(_flat(works["code"]), _flat(works["check"]), place)
            yield pa.RecordBatch.from_arrays(
                [works["work_id"].take(pa.array(place)), *map(pa.array, (code, check, tf))],
                names=["work_id", "code", "check", "tf"],
            )


def _distinct(code: np.ndarray, check: np.ndarray, row: np.ndarray, *first_by: np.ndarray) -> tuple:
    """Distinct terms of each row, ordered by ``first_by``, row and term, and their counts."""
    by = np.lexsort((check, code, row, *first_by))
    code, check, row = code[by], check[by], row[by]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (check[1:] != check[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(first, append=len(code)).astype(np.int32)
    return code[first], check[first], row[first], tf, *(k[by][first] for k in first_by)


def _planes(values: np.ndarray) -> bytes:
    """Small numbers byte plane by byte plane, which compress to less."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]


def _packed(batches: Iterator[pa.RecordBatch], labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    n_slice = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths = batch["code"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_TERMS, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_WORKS, batch.num_rows)
            yield _slice(batch.slice(start, stop - start), lengths[start:stop], n_slice, labels)
            n_slice += 1
            start = stop


def _slice(
    works: pa.RecordBatch, lengths: np.ndarray, n_slice: int, labels: np.ndarray
) -> pa.RecordBatch:
    """One row per bucket: distinct terms by work, with their counts."""
    facts = {c: works[c].to_numpy(zero_copy_only=False) for c in ("key", "n_docs", "n_projects")}
    order = np.lexsort((facts["n_projects"], facts["n_docs"]))  # equal numbers lie together
    place = np.empty(len(order), np.uint16)
    place[order] = np.arange(len(order), dtype=np.uint16)
    row = np.repeat(place, lengths)
    code, check = _flat(works["code"]), _flat(works["check"])
    mixed = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    bucket = (mixed % np.uint64(len(labels))).astype(np.uint16)
    code, check, row, tf, bucket = _distinct(code, check, row, bucket)
    used, begin = np.unique(bucket, return_index=True)
    end = np.append(begin[1:], len(code))
    facts = {c: facts[c][order] for c in facts}
    places, counts = [], []
    for a, b in zip(begin, end):
        there = np.bincount(row[a:b])
        places.append(np.flatnonzero(there).astype(np.uint16))
        counts.append(_planes(there[places[-1]]))

    def cut(values: np.ndarray) -> pa.Array:
        return pa.array([values[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())

    # the keys go along once
    keys = [facts["key"].tobytes(), *[None] * (len(used) - 1)][: len(used)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(used), n_slice, np.int64)),
            pa.array(labels[used].astype(np.int32)),
            pa.array(keys, pa.binary()),
            pa.array(np.full(len(used), len(order), np.int32)),
            pa.array([p.tobytes() for p in places], pa.binary()),
            pa.array([facts["n_docs"][p].tobytes() for p in places], pa.binary()),
            pa.array([facts["n_projects"][p].tobytes() for p in places], pa.binary()),
            pa.array(counts, pa.binary()),
            cut(code),
            cut(check),
            pa.array([_planes(tf[a:b]) for a, b in zip(begin, end)], pa.binary()),
        ],
        names=[c.split()[0] for c in _PACKED.split(", ")],
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list, dict[str, np.ndarray]]:
    """What the rows say, work by work and term by term; each row's slice, keys and works."""
    rows, found = [], {c: [] for c in ("code", "check", "tf", "work", "n_docs", "n_projects")}
    n_works = 0
    kinds = {"code": np.int64, "check": np.int16}
    sent = (*kinds, "tf", "counts", "places", "n_docs", "n_projects")
    for batch in batches:
        for i in range(batch.num_rows):
            value = {c: batch[c][i].as_buffer() for c in sent}
            for c, kind in kinds.items():
                found[c].append(np.frombuffer(value[c], kind).copy())
            for c in ("n_docs", "n_projects"):
                found[c].append(np.frombuffer(value[c], np.int64).copy())
            found["tf"].append(_from_planes(value["tf"]))
            counts = _from_planes(value["counts"])
            works = np.arange(n_works, n_works + len(counts), dtype=np.uint32)
            found["work"].append(np.repeat(works, counts))
            places = np.frombuffer(value["places"], np.uint16).copy()
            facts = (batch[c][i].as_py() for c in ("slice", "keys", "works"))
            rows.append((*facts, places, n_works))
            n_works += len(counts)
    return rows, {c: np.concatenate(found.pop(c)) for c in list(found)} if rows else {}


def _weighed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    rows, found = _gathered(batches)
    if not rows:
        return
    code, check = found.pop("code"), found.pop("check")
    by = np.argsort(code, kind="stable")
    code, check = code[by], check[by]
    same = code[1:] == code[:-1]
    if (same & (check[1:] != check[:-1])).any():
        again = np.lexsort((check, code))
        by, code, check = by[again], code[again], check[again]
        same = code[1:] == code[:-1]
    new = np.ones(len(code), bool)
    new[1:] = ~(same & (check[1:] == check[:-1]))
    first = np.flatnonzero(new)
    n_works = np.diff(first, append=len(code))
    work = found.pop("work")[by]
    df = np.add.reduceat(found["n_projects"][work], first)
    # squared weight of each term of a work, as in terms.work_vectors
    weight = np.log1p(found["n_docs"].astype(np.float64))[work] + 1.0
    weight -= np.repeat(np.log1p(df.astype(np.float64)), n_works)
    weight *= found.pop("tf")[by]
    weight *= weight
    weight *= np.repeat((n_works > 1) - max(least - SUM_SLACK, 0.0), n_works)
    sums = np.bincount(work, weights=weight, minlength=len(found["n_docs"]))
    del by, work, weight, same, new
    yield from _sum_rows(rows, sums)

    code, check = code[first], check[first]
    shared = np.flatnonzero(n_works > 1)
    code, check, n_works, df = code[shared], check[shared], n_works[shared], df[shared]
    equal = code[1:] == code[:-1]
    clashes = np.zeros(len(code), bool)
    clashes[1:] |= equal
    clashes[:-1] |= equal
    for a in range(0, len(code), 100_000):
        part = slice(a, a + 100_000)
        yield _rows(
            code=pa.array(code[part]),
            check=pa.array(check[part]),
            n_works=pa.array(n_works[part].astype(np.int64)),
            df=pa.array(df[part].astype(np.int64)),
            clashes=pa.array(clashes[part]),
        )


def _halves(sums: np.ndarray) -> bytes:
    """The greatest of the numbers and, in its scale, all of them as 2-byte floats rounded up."""
    scale = max(float(np.abs(sums).max(initial=0.0)) / _HALF_RANGE, 1e-30)
    whole = sums / scale
    short = whole.astype(np.float16)
    low = short < whole
    short[low] = np.nextafter(short[low], np.float16(np.inf))
    return np.float64(scale).tobytes() + short.tobytes()


def _from_halves(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float16, offset=8) * np.frombuffer(data, np.float64, 1)


def _sum_rows(rows: list, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per slice: the sums of its works over all buckets of this task."""
    keys, total = {}, {}
    for n_slice, of_works, n, places, a in rows:
        if n_slice not in total:
            total[n_slice] = np.zeros(n, np.float64)
        total[n_slice][places] += sums[a : a + len(places)]
        keys[n_slice] = of_works or keys.get(n_slice)
    yield _rows(
        slice=pa.array(list(total), pa.int64()),
        keys=pa.array([keys[s] for s in total], pa.binary()),
        sums=pa.array([_halves(v) for v in total.values()], pa.binary()),
    )


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {
        "slice": pa.int64(), "keys": pa.binary(), "sums": pa.binary(), "code": pa.int64(),
        "check": pa.int16(), "n_works": pa.int64(), "df": pa.int64(), "clashes": pa.bool_(),
    }
    arrays = [columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _kept_keys(table: pa.Table) -> pa.Table:
    sums = sum(map(_from_halves, table["sums"].to_pylist()))
    keys = next(k for k in table["keys"].to_pylist() if k is not None)
    return pa.table({"key": np.frombuffer(keys, np.int64)[sums >= 0.0]})
