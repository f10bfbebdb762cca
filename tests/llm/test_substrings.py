import hashlib
import random

import pytest

from worksight.llm import substrings


def brute_force(rows, threshold):
    """By id order; rows of one id don't count against one another."""
    seen, out = set(), []
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    i = 0
    while i < len(named):
        same = [r for r in named if r[0] == named[i][0]]
        fresh = set()
        for doc_id, text in same:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for at in range(len(data) - threshold + 1):
                piece = data[at : at + threshold]
                fresh.add(piece)
                if piece in seen:
                    gone[at : at + threshold] = b"\1" * threshold
            kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
            spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
            out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        seen |= fresh
        i += len(same)
    for _, text in (r for r in rows if r[0] is None):
        data = (text or "").encode()
        out.append((None, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str
    )


@pytest.fixture(scope="module")
def rows():
    choose = random.Random(4)
    syllables = "the an in er on th at or é ó ti is en".split()

    def prose(n):
        return "".join(choose.choice(syllables) + choose.choice(["", "", " "]) for _ in range(n))

    passages = [prose(60) for _ in range(6)]
    rows = []
    for i in range(90):
        text = prose(choose.randint(0, 250))
        for _ in range(choose.randint(0, 3)):
            cut = choose.randint(0, len(text))
            piece = choose.choice(passages)
            a = choose.randint(0, 20)
            text = text[:cut] + piece[a : a + choose.randint(30, 120)] + text[cut:]
        rows.append((i * 2, text))
    near = list(rows[10][1])
    near[len(near) // 2] = "#"
    rows += [(300, rows[10][1]), (301, "".join(near)), (302, "a" * 400), (303, "a" * 49), (304, "ba" * 100),
             (305, "a" * 60), (306, None), (307, ""), (20, rows[11][1]), (308, prose(3000) * 2),
             (None, rows[10][1]), (None, None)]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 22, 3000])
def test_same_bytes_as_brute_force(spark, rows, block_bytes):
    data = [(*r, 1, "x") for r in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, block int, data string")
    got = substrings.remove_repeats(docs.repartition(3), carry=["block", "data"], block_bytes=block_bytes)
    assert {tuple(r.extra) for r in got.select("extra").collect()} == {(1, "x")}
    assert found(got) == brute_force(rows, 50)


def test_other_thresholds(spark, rows):
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string")
    got = substrings.remove_repeats(docs, threshold=77, block_bytes=2000)
    assert found(got) == brute_force(rows[:40], 77)
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, threshold=20)


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "x" * 80), ("a", "x" * 80)], "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got == {"a": 0, "b": 80}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_cut_characters_are_dropped(spark):
    kept = spark.createDataFrame([("é".encode()[:1] + b"ok" + "é".encode(),)], "kept binary")
    assert kept.select(substrings.whole_characters("kept")).first()[0] == "oké"
    # a repeated string that begins within a character takes the rest of it along
    passage = "é" + "".join(chr(0x100 + k) for k in range(40))
    rows = [(1, passage), (2, "è" + passage[1:] + "!"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    as_bytes = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(docs).collect()}
    as_text = {r.doc_id: r.kept for r in substrings.remove_repeats(docs, as_text=True).collect()}
    assert as_text == {k: data.decode("utf-8", "ignore") for k, data in as_bytes.items()}
    assert as_text[2] == "è!" and as_text[None] == passage


@pytest.mark.parametrize("block_bytes", [1 << 22, 100])
def test_settled_strings_answer_later_documents(spark, block_bytes):
    # spans of two earlier documents settle a string that stands in neither
    choose = random.Random(7)
    rows = []
    for _ in range(25):
        text = "".join(choose.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(220))
        rows += [text[:130], text[90:220], text, text[82:137]]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substrings.remove_repeats(docs, block_bytes=block_bytes)) == brute_force(rows, 50)


@pytest.mark.parametrize("threshold", [50, 400])
def test_steps_take_the_anchors_that_are_stored(monkeypatch, threshold):
    choose = random.Random(5)
    texts = ["".join(choose.choice("ab ") for _ in range(n)).encode() for n in (0, 49, 50, 700, 3, 900, 1200)]
    texts += [b"x" * 600, "é".encode() * 300]
    parts = list(range(len(texts))), [len(t) for t in texts], b"".join(texts), threshold
    monkeypatch.setattr(substrings, "CHUNK", 130)
    first = substrings.Block(*parts)
    stored = first.anchors()
    right = {}
    for at, anchors in first._anchored_strings():
        right.update(zip(at.tolist(), anchors.tolist(), strict=True))
    monkeypatch.setattr(substrings.Block, "_anchored_strings", None)  # no step hashes all strings anew
    again = substrings.Block(*parts, stored)
    found = {}
    for at, numbers in again.strings(again.times > 0):
        found.update(zip(at.tolist(), again.at[numbers].tolist(), strict=True))
    assert found == right and len(right) == sum(max(0, len(t) - threshold + 1) for t in texts)
    assert again.ranks([]).distinct.tolist() == first.ranks([]).distinct.tolist()
