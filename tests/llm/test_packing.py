import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from worksight.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's 12 o'clock", None, "", "Été İ, naïve ΣΣ x 中文 <|endoftext|>",
         "word " * 9000, "Hello, World! it's 12 o'clock", "é, ñ."]


def ids_of(text):
    tokenizer = Tokenizer.from_file(PATH)  # the plain call, which finds special tokens
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_of_single_words():
    words = packing.load_words(PATH)
    for text, data in zip(TEXTS, words.encode([t or "" for t in TEXTS], 2), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(text)


def test_ids_of_random_texts():
    """Decomposed and odd capitals, marks after anything, special tokens, odd white space."""
    pool = list("abcTJWHIS'’.,!?-_ \t\n\x0b\x85\u3000 \x1c") + [chr(c) for c in range(0x300, 0x345)]
    pool += ["İ", "ß", "ẞ", "Σ", "ſ", "Ⅷ", "ﬁ", "日", "É", "É", "٣", "²", "'S", "'s", "ᄀ", "ᅡ", "ᆨ"]
    pool += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "क", "़", "😀"]
    random = np.random.default_rng(5)
    texts = ["".join(random.choice(pool, random.integers(0, 16))) for _ in range(4_000)]
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    for text, data in zip(texts, words.encode(texts, 2), strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, "<u4").tolist() == [*ids, 2]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="no lower-casing tokenizer"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_piece_lengths():
    assert packing.piece_lengths(1) == [1]
    assert packing.piece_lengths(4096) == [4096]
    assert packing.piece_lengths(2 * 4096 + 11) == [4096, 4096, 8, 2, 1]


def test_pack(spark):
    rows = [(i, text, 5, "x") for i, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, task string")
    packed = packing.pack(docs.repartition(3), PATH).collect()
    for doc_id, text, *_ in rows:
        pieces = sorted((r for r in packed if r.doc_id == doc_id), key=lambda r: r.start)
        ids = ids_of(text)
        assert [i for r in pieces for i in r.input_ids] == ids
        assert [r.start for r in pieces] == [
            sum(r.length for r in pieces[:k]) for k in range(len(pieces))
        ]
        for r in pieces:
            assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.input_ids, "<u4").tobytes())
            assert r.doc_tokens == len(ids)
    numbers = sorted(packed, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in numbers] == list(range(len(packed)))
    lengths = [r.length for r in numbers]
    assert lengths == sorted(lengths, reverse=True)  # one bucket after the other


def test_empty_table_and_wrong_size(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, max_tokens=1000)


def test_buckets_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f")], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, PATH), str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").glob("length=*")} == {"length=4", "length=2"}


def test_frequent_words_are_encoded_once(monkeypatch):
    """Words met again outlive the bound of the cache, rare ones make room."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    words, learned = packing.WordIds(PATH), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: learned.extend(new) or learn(new))
    texts = [" ".join(["often", "Seen,", *(f"rare{i}x{k}" for k in range(40))]) for i in range(12)]
    for text in texts:
        (data,) = words.encode([text], 2)
        assert np.frombuffer(data, "<u4").tolist() == ids_of(text)
    assert learned.count(b"often") == learned.count(b"seen,") == 1
