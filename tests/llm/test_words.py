import numpy as np

from worksight.llm.words import WordNumbers, behind_one_another


def test_words_keep_their_numbers():
    random = np.random.default_rng(3)
    pool = [bytes(random.integers(97, 100, random.integers(1, 40)).tolist()) for _ in range(400)]
    pool += [b"\0", b"a\0", b"a", b"a\0\0", "Été".encode(), b"\x1c", b"x" * 16, b"x" * 17]
    for limit in (10_000, 150, 3):
        words = WordNumbers(limit)
        known: list[bytes] = []
        for _ in range(12):
            lists = [[pool[k] for k in random.integers(0, len(pool), random.integers(0, 30))] for _ in range(5)]
            found = words.of([random.choice([b" ", b"\n", b"\t \r"]).join(x) for x in lists])
            if found.kept is not None:
                known = [known[k] for k in found.kept]
            assert found.first == len(known) and not set(found.new) & set(known)
            known += found.new
            assert len(set(known)) == len(known) == words.size
            assert [known[k] for k in found.numbers] == [w for x in lists for w in x]
            assert found.counts.tolist() == [len(x) for x in lists]
            assert words.size <= max(limit, len({w for x in lists for w in x}))


def test_no_words():
    words = WordNumbers(10)
    for texts in ([], [b""], [b" ", b"\n\n", b""]):
        found = words.of(texts)
        assert not len(found.numbers) and not found.new and found.counts.tolist() == [0] * len(texts)


def test_words_beyond_ascii_are_taken_from_the_originals():
    words = WordNumbers(10)
    originals = [t.encode() for t in ("A É b", "", "ÉA A")]
    found = words.of([t.lower() for t in originals], originals)
    assert [found.new[k].decode() for k in found.numbers] == ["a", "É", "b", "ÉA", "a"]


def test_stretches_behind_one_another():
    got = behind_one_another(np.arange(10), np.array([7, 0, 3, 3]), np.array([2, 0, 3, 1]))
    assert got.tolist() == [7, 8, 3, 4, 5, 3]
