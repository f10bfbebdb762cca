import hashlib
import random

from worksight.llm import fingerprints as fp


def test_spans_and_common_extensions():
    choose = random.Random(5)
    for _ in range(60):
        a = "".join(choose.choice("abé👍") for _ in range(choose.randint(0, 40)))
        b = a[choose.randint(0, 5) :] + "".join(choose.choice("ab") for _ in range(5))
        ha, hb = fp.PrefixHashes(a), fp.PrefixHashes(b)
        for _ in range(20):
            i, j = choose.randint(0, len(a)), choose.randint(0, len(b))
            n = choose.randint(0, min(len(a) - i, len(b) - j))
            assert ha.same(i, hb, j, n) == (a[i : i + n] == b[j : j + n])
            assert (ha.span(i, i + n) == hb.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
            common = 0
            while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
                common += 1
            assert ha.common_extension(i, hb, j) == common


def test_likeness():
    choose = random.Random(6)
    text = "".join(choose.choice("abcdefgh ") for _ in range(4000))
    other = "".join(choose.choice("abcdefgh ") for _ in range(4000))
    mark = fp.PrefixHashes(text).fingerprint()
    assert fp.likeness(mark, fp.PrefixHashes(text).fingerprint()) == 1
    assert fp.likeness(mark, fp.PrefixHashes(other).fingerprint()) < 0.1
    assert 0.25 < fp.likeness(mark, fp.PrefixHashes(fp.edited(text, other)).fingerprint()) < 0.75
    moved = fp.PrefixHashes("x" + text).fingerprint()
    assert 0.8 < fp.likeness(mark, moved) < 1 or mark != moved


def test_documents(spark):
    rows = [(i, f"document {i} has a text of its own, number {i * i}" * (i % 4), "z") for i in range(60)]
    rows += [(60, None, "z"), (61, "", "z"), (62, "é👍" * 4000, "z"), (None, "no id", "z"), (5, rows[5][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    got = fp.fingerprint_documents(docs).collect()
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = {}
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        changed = fp.edited(text, following)
        expected.setdefault(doc_id, []).append(
            (len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.PrefixHashes(text).fingerprint(),
             fp.PrefixHashes(changed).fingerprint())
        )
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    (row,) = fp.fingerprint_documents(docs).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert fp.fingerprint_documents(docs.limit(0)).count() == 0
