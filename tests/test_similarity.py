import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures import list_pairs, projects, sample_projects, similar_by_brute_force
from worksight.functions.text import STOP_WORDS, word_tokens
from worksight.operators import keyed_join, similarity, terms
from worksight.operators.components import components
from worksight.operators.similarity import (
    copy_groups,
    find_similar_works,
    pair_count,
    class_members,
    pair_signals,
    project_signals,
    similar_classes,
    top_pairs,
)
from worksight.operators.terms import work_vectors
from worksight.sources import scratch


def test_stop_words(spark):
    words = STOP_WORDS
    assert len([w for w in words if w.isalpha() and len(w) > 1]) >= 300
    assert {"two", "system", "of", "at"} <= set(words)
    assert not {"did", "just", "near", "construction"} & set(words)


def test_tokens_of_any_script(spark):
    df = spark.createDataFrame([("  Été naïve, at Ward 4 मार्ग_2 x1\n道路工程 A ",)], "t string")
    tokens = df.select(word_tokens(F.col("t"), ["at"])).first()[0]
    assert tokens[:3] == ["été", "naïve", "ward"]
    assert "x1" in tokens and "道路工程" in tokens and "4" not in tokens


def test_vectors_of_shared_terms(spark):
    """Shared terms with their counts, rarest first; the rest only in the norm."""
    works = spark.createDataFrame(
        [
            ("A", "w1", 1, 4, "b a b a b"),
            ("A", "w2", 2, 4, "a b c"),
            ("A", "w3", 1, 4, "a x"),
            ("B", "w4", 1, 1, "a b"),
        ],
        "category string, work_id string, n_projects long, n_docs long, words string",
    )
    rows = {r.work_id: r for r in work_vectors(works, 0.0).collect()}
    assert set(rows) == {"w1", "w2", "w3"}  # w4 shares nothing within its category

    def idf(df):
        return math.log(5 / (1 + df)) + 1

    w1 = rows["w1"]  # b 3, a 2, "a b" 2 are shared, "b a" 2 is not
    assert [e.n_works for e in w1.vector] == [2, 2, 3]
    assert sorted((e.tf, round(e.weight, 9)) for e in w1.vector) == sorted(
        [(3, round(3 * idf(3), 9)), (2, round(2 * idf(3), 9)), (2, round(2 * idf(4), 9))]
    )
    assert w1.alone == 4 and w1.total == pytest.approx(w1.shared + 4 * idf(1) ** 2)
    for row in rows.values():
        order = [(e.n_works, e.code) for e in row.vector]
        assert order == sorted(order)
    assert len({e.code for r in rows.values() for e in r.vector}) == 3


def test_sample_pair(spark):
    df = sample_projects(spark)
    similar = find_similar_works(df)
    rows = list_pairs(similar, df).collect()
    assert [tuple(r) for r in rows] == [
        ("P1001", "P1004", "Community Hall", 86.58,
         "Construction of community hall at Ward 4",
         "Construction of community hall in Ward 12"),
    ]


def _corpus(seed, n=150, vocabulary=14, hot=40):
    """Short texts over few words, with copies, near copies, empty and missing texts."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(vocabulary)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            text = rng.choice(texts)
        elif texts and kind < 0.5:
            text = f"{rng.choice(texts)} {rng.choice(words)}"
        else:
            text = " ".join(rng.choices(words, k=rng.randint(1, 7)))
        texts.append(text)
        rows.append((f"id{i:04d}", rng.choice(["A", "A", "B", None]), text))
    rows += [(f"hot{i:04d}", "A", "Hot  copy, of THE text") for i in range(hot)]
    rows += [("e1", "A", ""), ("e2", "A", None), ("e3", "A", "of the and"), ("e4", "A", "")]
    rows += [("c1", "only", "of the"), ("c2", "only", ""), ("s1", "single", "word1 word2")]
    return rows


def _frame(spark, rows, partitions=3):
    df = projects(
        spark,
        *(
            {"project_id": i, "category": g, "work_description": t}
            for i, g, t in rows
        ),
    )
    return df.repartition(partitions)


SETTINGS = {
    "defaults": {},
    "split": {"CELL_WORKS": 3, "BROADCAST_ROWS": 0, "TASK_ROWS": 2, "BROADCAST_CODES": 0},
    "clashing codes": {"CODE_BITS": 5},
}


@pytest.mark.parametrize(("setting", "seed"), [("defaults", 1), ("split", 2), ("clashing codes", 3)])
def test_complete_against_brute_force(spark, monkeypatch, setting, seed):
    """All pairs and only those, also when every hot path and block split is in use."""
    for name, value in SETTINGS[setting].items():
        module = {"CELL_WORKS": similarity, "CODE_BITS": terms, "BROADCAST_CODES": terms}.get(name, keyed_join)
        monkeypatch.setattr(module, name, value)
    rows = sorted(_corpus(seed))
    expected = similar_by_brute_force(rows, STOP_WORDS)
    df = _frame(spark, rows, partitions=2 + seed)
    similar = find_similar_works(df)

    listed = list_pairs(similar, df)
    got = {(r.project_1, r.project_2): r.similarity_pct for r in listed.collect()}
    assert got == pytest.approx(expected, abs=0.011)
    assert pair_count(similar).first().n_pairs == len(expected)

    # classes: what the listed pairs link, with their number and the strongest
    group_of = {i: g for i, g, _ in rows}
    links = defaultdict(list)
    root = _roots(got)
    for (a, _), percent in got.items():
        links[root[a]].append(percent)
    classes = {r.class_id: r for r in similar_classes(similar).collect()}
    assert {c: (r.n_links, r.strongest_pct, r.category) for c, r in classes.items()} == {
        c: (len(p), max(p), group_of[c]) for c, p in links.items()
    }
    members = {r.project_id: r.class_id for r in class_members(similar).collect()}
    assert members == root
    sizes = defaultdict(int)
    for c in root.values():
        sizes[c] += 1
    assert {c: r.n_projects for c, r in classes.items()} == sizes

    # factored form: the same number of pairs, copies counted by group
    assert copy_groups(similar).agg(F.max("n_projects")).first()[0] >= 40

    by_pairs = {r.project_id: tuple(r) for r in pair_signals(listed).collect()}
    by_works = {r.project_id: tuple(r) for r in project_signals(similar).collect()}
    assert by_works == by_pairs

    order = sorted(
        ((-p, g, a, b) for (a, b), p in got.items() for i, g, _ in rows if i == a)
    )[:20]
    top = top_pairs(similar, df).collect()
    assert [(-r.similarity_pct, r.category, r.project_1, r.project_2) for r in top] == order
    texts = {i: t for i, _, t in rows}
    assert all(
        r.description_1 == texts[r.project_1] and r.description_2 == texts[r.project_2]
        for r in top
    )


def _roots(pairs):
    """The smallest id each id reaches, by plain union."""
    root = {i: i for pair in pairs for i in pair}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in root}


@pytest.mark.parametrize("task_rows", [1_000_000, 2])
def test_components(spark, monkeypatch, task_rows):
    monkeypatch.setattr(keyed_join, "TASK_ROWS", task_rows)
    monkeypatch.setattr(keyed_join, "BROADCAST_ROWS", 100_000 if task_rows > 2 else 0)
    rng = random.Random(task_rows)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(20)]
    star = [("s00", f"s{i:02d}") for i in range(1, 30)]
    others = [(f"r{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(40)]
    links = [*chain, *star, *others, ("r1", "r1"), *star]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, "s01")], "a string, b string").repartition(3)
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == _roots([(a, b) for a, b in links if a != b])
    assert components(df.limit(0), "a", "b").count() == 0


def test_near_copies_of_a_template_stay_linear(spark):
    """Each copy has a word of its own: one shape, no pair is a row, all figures are exact."""
    n = 2_000
    base = " ".join(f"part{i}" for i in range(400))
    rows = [(f"id{i:05d}", "A", f"{base} plot{i:05d}") for i in range(n)]
    rows += [("x1", "A", "supply desks benches boards"), ("x2", "A", f"{base} plot00001")]
    similar = find_similar_works(_frame(spark, rows))
    assert similar.shape_pairs.count() <= 1 and similar.shapes.count() <= 3
    listed = {(r.n_works, r.n_projects, r.n_links) for r in similar_classes(similar).collect()}
    assert listed == {(n, n + 1, n * (n + 1) // 2)}
    assert pair_count(similar).first().n_pairs == n * (n + 1) // 2
    signals = {r.project_id: tuple(r)[1:] for r in project_signals(similar).collect()}
    few = rows[:3] + rows[-1:]
    assert {signals[i][1] for i, _, _ in few} == {n}
    assert signals["id00001"][0] == signals["x2"][0] == 100.0 > signals["id00000"][0] > 80.0
    assert "x1" not in signals
    top = top_pairs(similar, _frame(spark, rows)).collect()
    assert len(top) == 20 and (top[0].project_1, top[0].project_2) == ("id00001", "x2")


def test_orientation_by_given_order(spark):
    df = projects(
        spark,
        {"project_id": "P2", "work_description": "village road repair"},
        {"project_id": "P1", "work_description": "Village ROAD, repair"},
    ).withColumn("row_seq", F.when(F.col("project_id") == "P2", 0).otherwise(1))
    similar = find_similar_works(df, order_col="row_seq")
    pair = list_pairs(similar, df).first()
    assert (pair.project_1, pair.project_2) == ("P2", "P1")


def test_empty_result_keeps_its_columns(spark):
    df = projects(spark, {"work_description": "of the"}, {"project_id": "A2"})
    similar = find_similar_works(df)
    assert list_pairs(similar, df).collect() == []
    assert list_pairs(similar, df).columns == [
        "project_1", "project_2", "category", "similarity_pct",
        "description_1", "description_2",
    ]
    assert project_signals(similar).collect() == []
    assert pair_count(similar).first().n_pairs == 0


def test_threshold_is_a_parameter(spark):
    from worksight.config import ScreeningConfig

    rows = sorted(_corpus(5, n=60, hot=3))
    df = _frame(spark, rows)
    for threshold in (0.3, 0.95):
        expected = similar_by_brute_force(rows, STOP_WORDS, threshold)
        similar = find_similar_works(
            df, config=ScreeningConfig(similarity_threshold=threshold)
        )
        assert pair_count(similar).first().n_pairs == len(expected)
    with pytest.raises(ValueError):
        find_similar_works(df, config=ScreeningConfig(similarity_threshold=0.0))


def test_texts_are_cut_into_tokens_once(spark, monkeypatch):
    """What follows reads the stored tokens."""
    read = []
    stored = similarity.stored

    def counting(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        read.append((name, "rlike" in plan.lower() or "regexp" in plan.lower() or "split" in plan.lower()))
        return stored(df, name)

    monkeypatch.setattr(similarity, "stored", counting)
    rows = [(f"p{i}", "Road", f"repair of bridge {i % 3} in the old town") for i in range(9)]
    frame = spark.createDataFrame(rows, "project_id string, category string, work_description string")
    similarity.find_similar_works(frame)
    cut = {name for name, of_texts in read if of_texts and name in ("tokenised", "members", "works")}
    assert cut == {"tokenised"}


def test_candidates_in_parts_and_what_stays_stored(spark, monkeypatch):
    """Many candidates taken part by part give the same pairs; nothing but the result stays."""
    common = " ".join(f"{a}{b}road" for a in "bcdfghklmnpr" for b in ("a", "e", "i", "o", "u", "ai", "au", "ei", "eu", "oi"))
    places = ["north", "south", "east", "west", "hill", "lake", "mill", "wood", "moor"]
    texts = [f"{common} {places[i % 9]} {places[i % 4]}side" for i in range(80)]
    rows = [(f"p{i:03d}", "Road", text) for i, text in enumerate(texts)]
    projects = spark.createDataFrame(rows, "project_id string, category string, work_description string")

    def pairs():
        found = similarity.find_similar_works(projects)
        return sorted(map(tuple, found.pairs.collect())), found

    whole, _ = pairs()
    before, parts = scratch.kept(spark), []
    monkeypatch.setattr(similarity, "VERIFIED", 3)
    cosines = similarity._cosines
    monkeypatch.setattr(similarity, "_cosines", lambda *x: parts.append(1) or cosines(*x))
    some, found = pairs()
    assert some == whole and len(parts) > 1 and len(whole) > 3
    new = [x for x in scratch.kept(spark) if not any(x is y for y in before)]
    names = sorted(x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in new)
    assert names == ["members", "shape-pairs", "shaped-works", "shapes"]
    assert found.members.count() == 80 and similarity.copy_groups(found).count() > 0
