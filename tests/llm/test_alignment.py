"""Alignment of two tokenizers against the plain libraries and sets of offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worksight.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it's 12,345 metres away!",
    "Ünïcode naïve façade 日本語 😀 и ещё",
    "two  spaces\n\nand\ttabs \r\n at the end   ",
    "<|endoftext|> and <s></s> <0x41> stay text",
    "already ▁ a mark",  # B shows a space there, so it doesn't give the text back
    "a\x00b\x1f\u0085　z",
    "same words same words same words",
    "same words same words same words",
    " " * 5000 + "x",
    "word " * 3000,
    "",
    " ",
    None,
]


def plain(texts):
    """The contract's columns by the libraries' own calls, offsets in sets."""
    of_a = Tokenizer.from_file(A)
    of_a.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_of = {letter: b for letter, b in alignment._byte_alphabet().items()}
    assert bytes([bytes_of[c] for c in of_a.id_to_token(220)]) == b" "

    def piece(i):
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:5], 16)])
        return model.id_to_piece(i).replace("▁", " ").encode()

    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = of_a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        sides = [
            [(i, bytes(bytes_of[c] for c in of_a.id_to_token(i))) for i in a],
            [(i, piece(i)) for i in b],
        ]
        if not text or any(b"".join(t for _, t in side) != whole for side in sides):
            found.append(([], [], []))
            continue
        ends = []
        for side in sides:
            at, here = 0, {}
            for number, (i, token) in enumerate(side):
                at += len(token)
                here[at] = (number, i)
            ends.append(here)
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][at][1], ends[1][at][1]) for at in common]
        groups, x, y = [], 0, 0
        for at in common:
            to_a, to_b = ends[0][at][0] + 1, ends[1][at][0] + 1
            groups.append(",".join(map(str, a[x:to_a])) + "|" + ",".join(map(str, b[y:to_b])))
            x, y = to_a, to_b
        found.append((sides, links, groups))
    counts = Counter(link for _, links, _ in found for link in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = []
    for sides, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append(
            (
                *((len(side) for side in sides) if sides else (0, 0)),
                len(groups),
                len(links),
                sum(counts[link] == highest[link[1]] for link in links),
                sum(counts[link] for link in links),
                digest,
            )
        )
    return rows, counts, highest


@pytest.mark.parametrize("slice_bytes", [200, 4 << 20])
def test_statistics_equal_the_plain_libraries(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    rows = [(k, text, "mine") for k, text in enumerate(TEXTS)] + [(None, TEXTS[0], "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(3)
    got = alignment.alignment_statistics(docs, A, B)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    expected, _, _ = plain([*TEXTS, TEXTS[0]])
    found = {row["doc_id"]: tuple(row)[1:] for row in got.collect()}
    assert found == dict(zip([*range(len(TEXTS)), None], expected, strict=True))
    assert found[4] == (0, 0, 0, 0, 0, 0, "")


def test_pair_counts_and_groups(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    _, counts, highest = plain(TEXTS)
    got = alignment.pair_counts(docs, A, B).collect()
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in got} == {
        pair: (n, n == highest[pair[1]]) for pair, n in counts.items()
    }
    groups = alignment.align_texts(docs, A, B).where(F.col("doc_id") == 0).first()
    assert groups["a_until"][-1] == len(groups["a_ids"])
    assert groups["b_until"][-1] == len(groups["b_ids"])
    assert len(groups["a_until"]) == len(groups["b_until"])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_statistics(none, A, B).count() == 0
    assert alignment.pair_counts(none, A, B).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_of_the_merge_path(piece):
    random = np.random.default_rng(5)
    for _ in range(60):
        high = int(random.integers(1, 60))
        a = np.flatnonzero(random.random(high) < random.random())
        b = np.flatnonzero(random.random(high) < random.random())
        in_a, in_b = alignment.diagonals(a, b, piece)
        sizes = np.diff(in_a + in_b)
        assert (sizes[:-1] == piece).all() and (sizes <= piece).all()
        for x, y in zip(in_a, in_b, strict=True):  # everything before a cut is at most what follows
            assert not x or y == len(b) or a[x - 1] <= b[y]
            assert not y or x == len(a) or b[y - 1] < a[x]
        left, right = alignment.common_ends(a, b, piece)
        assert a[left].tolist() == b[right].tolist() == np.intersect1d(a, b).tolist()
