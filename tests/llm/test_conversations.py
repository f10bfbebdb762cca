"""Repair of conversations against a plain search over all cheapest edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from worksight.llm import conversations

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """Dijkstra over (rows done, role initials so far as a state), paths in ASCII order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = WHITE.findall(text)
        if not shown:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("ok" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        new = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*out, f"{name}:")))
        if i == len(rows):
            continue
        _, _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = faults[i] == "truncated"
        if role[:1] and role[:1] in step[state]:
            kept = (*out, f"{role}:{text}")
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], kept))
        changed = (*out, f"{name}:{text}")
        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new, changed))
    turns = {r[1] for r in rows} - {None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(pair not in ("su", "ua", "au") for pair in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def table(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.5 else ["user", "assistant"][turn % 2]
            if draw.random() < 0.1:
                role = draw.choice(["system", "tool", "", None, "u"])
            text = draw.choice(["Yes.", "No", "  ", "Well then!\n", None, f"Row {turn}.", "Ünd\u0085"])
            kept = turn if draw.random() < 0.9 else draw.choice([None, 3])
            rows += [(conv, kept, role, text)] * (2 if draw.random() < 0.05 else 1)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string"
    )


def expected_of(rows):
    by_id = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        by_id[row[0]].append(row)
    return {conv: plain(of) for conv, of in by_id.items()}


@pytest.mark.parametrize(("segment", "seed"), [(192, 1), (3, 2), (1, 3), (7, 4)])
def test_equals_the_plain_search(spark, monkeypatch, segment, seed):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", segment)
    rows = table(seed, 60, 12)
    got = conversations.repair_damaged(frame(spark, rows))
    assert got.columns == ["conv_id", *conversations.RESULT_NAMES]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == expected_of(rows)


def test_a_hot_conversation_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 20)
    rows = [(7, None, "user", "Same.")] * 300 + [(7, t, "user", f"Row {t}") for t in range(150)]
    rows += [(7, 5, "system", "Be kind.")] * 40 + [(8, 1, None, None)]
    got = conversations.repair_damaged(frame(spark, rows))
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == expected_of(rows)


def test_dropped_conversation_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repair_damaged(frame(spark, [(gone, 0, "user", "Hm.")])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert conversations.repair_damaged(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_every_pair_of_ends(seed):
    draw = random.Random(seed)
    for _ in range(150):
        n = draw.randint(0, 6)
        initials = [draw.choice("suax") for _ in range(n)]
        faults = [draw.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        search = conversations.Search(initials, faults, False)
        for start in range(4):
            # every sequence of edits, cheapest and then least first
            heap, found = [(0, "", 0, start)], {}
            done = set()
            while heap:
                cost, path, i, state = heapq.heappop(heap)
                if (i, state) in done:
                    continue
                done.add((i, state))
                if i == n:
                    found[state] = (cost, path)
                    continue
                for edit, more, to, then in search._edits(i, state):
                    heapq.heappush(heap, (cost + more, path + edit, to, then))
            for end in range(4):
                assert search.best(start, end) == found.get(end)
