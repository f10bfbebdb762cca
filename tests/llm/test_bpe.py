import hashlib
import random

import public_tokenizers
import tiktoken

from worksight.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def reference():
    ranks = bpe.load_ranks(PATH, PATTERN).rank
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library():
    choose = random.Random(1)
    letters = "ab cd\n\t'sS l  é1² \x1c\x85 中👍🏽ve,.!  "
    texts = ["".join(choose.choice(letters) for _ in range(choose.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n", "a" * 3000, "ab" * 2000, " " * 200, "<|endoftext|>", "x \n y"]
    ranks, own = bpe.load_ranks(PATH, PATTERN), reference()
    found = list(ranks.encode(texts).lists())
    assert found == [own.encode_ordinary(text) for text in texts]
    assert [ranks.decode(ids).decode() for ids in found] == texts


def test_a_merge_of_lower_rank_comes_first():
    ranks, own = bpe.load_ranks(PATH, PATTERN), reference()
    words = ["aaa" * n + "b" * m for n in range(1, 12) for m in range(4)]
    found = list(ranks.replay([word.encode() for word in words]).lists())
    assert found == [own.encode_ordinary(word) for word in words]


def test_forgetting_known_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    ranks, own = bpe.Ranks(PATH, PATTERN), reference()
    for text in ("one two three four", "four five six, seven", "one two"):
        assert list(ranks.encode([text]).lists()) == [own.encode_ordinary(text)]


def test_rows(spark):
    texts = ["Hello, world", None, "", "Hello, world", "long " * 5000]
    rows = [(i if i != 3 else 0, text, 7, "x") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string")
    own = reference()
    got = {
        (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
        for r in bpe.round_trip_digests(docs, PATH, PATTERN).collect()
    }
    expected = set()
    for doc_id, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        joined = ",".join(map(str, ids)).encode()
        plain = hashlib.sha256((text or "").encode()).hexdigest()
        expected.add((doc_id, len(ids), hashlib.sha256(joined).hexdigest(), plain))
    assert got == expected
    encoded = bpe.encode_texts(docs, PATH, PATTERN)
    decoded = bpe.decode_ids(encoded, PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in decoded) == sorted(t or "" for t in texts)
    assert bpe.round_trip_digests(docs.limit(0), PATH, PATTERN).count() == 0
