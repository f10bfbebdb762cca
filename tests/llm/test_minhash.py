import random

from worksight.llm import minhash
from worksight.llm.components import components


def brute_force(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - width + 1)
        sets.append({tuple(words[i : i + width]) for i in range(n)} if words and doc_id is not None else set())
    root = {doc_id: doc_id for doc_id, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {doc_id: find(doc_id) for doc_id, _ in rows if doc_id is not None}


def documents(n=220):
    choose = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    base = [[choose.choice(words) for _ in range(choose.randint(40, 160))] for _ in range(25)]
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for i in range(n):
        text = list(base[i % 25] if i % 3 else base[0])  # one large group
        for _ in range(choose.choice([0, 0, 1, 1, 2, 3, 5])):
            text[choose.randrange(len(text))] = choose.choice(words)
        if i % 7 == 0:  # a passage that unrelated texts share
            text = [choose.choice(words) for _ in range(60)] + passage
        rows.append((i * 3, " ".join(text)))
    return rows


def test_same_classes_as_brute_force(spark):
    rows = documents()
    rows += [(1, None), (2, ""), (4, " \n"), (5, "one two"), (7, "ONE\ttwo"), (8, "one"), (0, rows[0][1]),
             (10, "long " * 20_000), (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int")
    for width, percent in ((3, 85), (5, 80)):
        expected = brute_force(rows, width, percent)
        got = minhash.near_duplicates(docs.repartition(4), width=width, percent=percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_ids_of_several_texts_link_them(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []


def test_components_of_chains_and_stars(spark):
    choose = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)]
    pairs += [(choose.randint(200, 260), choose.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for pair in pairs for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    linked = {x for a, b in pairs for x in (a, b) if a != b}
    assert got == {x: find(x) for x in linked}
