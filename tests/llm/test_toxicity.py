import random
import zlib

import numpy as np

from worksight.llm import toxicity


def made_up(n, toxic=lambda insult, group: insult and group):
    """Insults are toxic beside a mention of a group only, unless told otherwise."""
    choose = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [choose.choice(plain) for _ in range(choose.randint(5, 60))]
        insult, group = choose.random() < 0.5, choose.random() < 0.5
        words += ["Blockhead!"] * insult + ["strangers"] * group
        choose.shuffle(words)
        rows.append((i, " ".join(words), int(toxic(insult, group))))
    return rows


def test_pairs_of_terms_are_learned():
    rows = made_up(3000)
    truth = np.array([r[2] for r in rows], np.float32)
    terms, counts = toxicity.terms_of([r[1] for r in rows], toxicity.Terms())
    machine = toxicity.Machine.untrained(float(truth[:2000].mean()))
    bound = int(counts[:2000].sum())
    machine.fit(terms[:bound], counts[:2000], truth[:2000])
    again = toxicity.Machine.from_bytes(machine.to_bytes())
    z = again.score(terms[bound:], counts[2000:])
    assert ((z > 0) == truth[2000:]).mean() > 0.97


def fitted(rows, bound):
    """Machine fitted on the first rows, and log odds and labels of the others."""
    truth = np.array([r[2] for r in rows], np.float32)
    terms, counts = toxicity.terms_of([r[1] for r in rows], toxicity.Terms())
    machine = toxicity.Machine.untrained(float(truth[:bound].mean()))
    split = int(counts[:bound].sum())
    machine.fit(terms[:split], counts[:bound], truth[:bound])
    return machine, terms[split:], counts[bound:], truth[bound:]


def test_only_the_pair_tells():
    """Each word alone is as frequent among toxic texts as among others."""
    rows = made_up(6000, toxic=lambda insult, group: insult == group)
    machine, terms, counts, truth = fitted(rows, 4000)
    z = toxicity.Machine.from_bytes(machine.to_bytes()).score(terms, counts)
    assert ((z > 0) == truth).mean() > 0.97


def test_labels_that_nothing_tells_leave_no_neutral_factors():
    choose = random.Random(5)
    rows = [(i, text, choose.randint(0, 1)) for i, text, _ in made_up(1500)]
    machine, *_ = fitted(rows, 1000)
    assert (machine.factors.any(axis=1) <= (machine.weights != 0)).all()


def test_score_is_the_sum_over_pairs():
    rows = made_up(600, toxic=lambda insult, group: insult == group)
    machine, terms, counts, _ = fitted(rows + [(600, "", 0), (601, "word1", 0)], 400)
    got, start = machine.score(terms, counts), 0
    for z, n in zip(got, counts, strict=True):
        of_text, start = terms[start : start + n], start + n
        want = machine.bias + sum(float(machine.weights[t]) for t in of_text)
        for i in range(n):
            for j in range(i):
                want += float(machine.factors[of_text[i]].astype(float) @ machine.factors[of_text[j]])
        assert abs(z - want) < 1e-4


def test_train_and_score(spark):
    rows = [(i, f"{'you awful scum ' if i % 4 == 0 else 'fine day '} w{i % 50} v{i % 7}", "x")
            for i in range(1200)]
    rows += [(None, "nothing", "x"), (1300, None, "x"), (1301, "", "x"), (4, rows[4][1], "x"),
             (1302, "fine day " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = [(i, int(i % 4 == 0)) for i in range(1200)] + [(8, 0), (None, 1), (5, None)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, folds=5)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1200
            and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if not r.text} == {0}
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).first().predicted == 0
