"""Works that no pair can hold go no further, and what is sent stays small."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from worksight.operators import shared_terms, terms
from worksight.operators.shared_terms import keys_of, terms_of, weighed_terms

SCHEMA = (
    "key long, n_projects long, n_docs long, n_characters long, code array<long>, check array<short>"
)


def _works(n=60):
    """Works over few codes of which some clash, every third with terms of its own."""
    rows = []
    for i in range(n):
        code = [(i * k) % 17 for k in range(1, 9)] + ([1000 + i] * 3 if i % 3 == 0 else [])
        check = [c % 2 if c < 17 else 0 for c in code]
        check[0] = i % 2
        rows.append((i, 1 + i % 4, 500, 40, code, check))
    return rows


def _expected(rows, least):
    works, df = defaultdict(set), defaultdict(int)
    for key, n_projects, _, _, code, check in rows:
        for term in set(zip(code, check)):
            works[term].add(key)
            df[term] += n_projects
    kept = set()
    for key, _, n_docs, _, code, check in rows:
        square = {
            t: (tf * (math.log((1 + n_docs) / (1 + df[t])) + 1)) ** 2
            for t, tf in Counter(zip(code, check)).items()
        }
        shared = sum(v for t, v in square.items() if len(works[t]) > 1)
        if shared >= least * sum(square.values()):
            kept.add(key)
    return {t: (len(w), df[t]) for t, w in works.items() if len(w) > 1}, kept


@pytest.mark.parametrize("slice_terms", [1, 50, 1_000_000])
def test_terms_and_kept_works_by_brute_force(spark, monkeypatch, slice_terms):
    monkeypatch.setattr(shared_terms, "SLICE_TERMS", slice_terms)
    rows = _works()
    hashed = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weighed = weighed_terms(hashed, 0.64)
    known, kept = _expected(rows, 0.64)
    found = terms_of(weighed).collect()
    assert {(r.code, r.check): (r.n_works, r.df) for r in found} == known
    codes = Counter(r.code for r in found)
    assert {r.code for r in found if r.clashes} == {c for c, n in codes.items() if n > 1}
    got = [r.key for r in keys_of(weighed).collect()]
    assert sorted(got) == sorted(kept) and 0 < len(kept) < len(rows)


def test_no_works(spark):
    weighed = weighed_terms(spark.createDataFrame([], SCHEMA), 0.64)
    assert terms_of(weighed).count() == 0 and keys_of(weighed).count() == 0


def test_works_without_partners_send_no_postings(spark, monkeypatch):
    """Only works that can have a partner meet the dictionary: two near copies of 200 works."""
    written = {}
    stored = terms.stored

    def counting(df, name):
        written[name] = stored(df, name)
        return written[name]

    monkeypatch.setattr(terms, "stored", counting)
    texts = [" ".join(f"own{i}x{j}" for j in range(30)) + " common" for i in range(198)]
    near = " ".join(f"both{j}" for j in range(40))
    rows = [("A", f"w{i}", 1, 200, t) for i, t in enumerate([*texts, near, f"{near} common"])]
    works = spark.createDataFrame(
        rows, "category string, work_id string, n_projects long, n_docs long, words string"
    )
    assert {r.work_id for r in terms.work_vectors(works, 0.64).collect()} == {"w198", "w199"}
    assert {r.work_id for r in written["kept-works"].collect()} == {"w198", "w199"}


def test_numbers_by_byte_planes():
    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    data = pa.py_buffer(shared_terms._planes(values))
    assert shared_terms._from_planes(data).tolist() == values.tolist()


def test_a_bucket_hears_only_of_works_with_its_terms():
    n, buckets = 500, 64
    works = pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(n)),
            pa.array([1] * n),
            pa.array([n] * n),
            pa.array([[7 * i, 7 * i + 1] for i in range(n)], pa.list_(pa.int64())),
            pa.array([[0, 0]] * n, pa.list_(pa.int16())),
        ],
        names=["key", "n_projects", "n_docs", "code", "check"],
    )
    rows = shared_terms._slice(works, np.full(n, 2), 0, np.arange(buckets, dtype=np.int32))
    assert len(rows) == buckets
    # once for each of 1,000 terms at most, not once for each work in each bucket
    assert sum(len(x) for x in rows["n_docs"].to_pylist()) <= 8 * 2 * n


def test_every_task_gets_one_bucket(spark):
    labels = shared_terms._labels(spark, 37)
    dealt = spark.createDataFrame([(int(x),) for x in labels], "bucket int").repartition(37, "bucket")
    sizes = dealt.rdd.glom().map(len).collect()
    assert sizes == [1] * 37


def test_sums_are_never_rounded_down():
    random = np.random.default_rng(2)
    sums = random.normal(size=1000) * 10.0 ** random.integers(-3, 9, 1000)
    back = shared_terms._from_halves(shared_terms._halves(sums))
    assert (back >= sums).all() and (back - sums).max() <= np.abs(sums).max() * 1e-3
    assert shared_terms._from_halves(shared_terms._halves(np.zeros(3))).tolist() == [0, 0, 0]
