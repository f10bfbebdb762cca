"""Structure repair of conversations by iterative-deepening A*.

A conversation should read (s?(ua)+)? by the initials of its roles. Its rows, in the order of
their turns, are kept (K), given another role (R) or deleted (D), and empty rows inserted (I).
The search goes depth first through the edits in ASCII order under a bound on the cost, which
rises to the least cost that was out of reach until an accepting path is found: the first
path found is the cheapest and, among those, the least in ASCII order. What it has proved
about the remaining cost of a failed state (rows done, last role) stays in a table, and raises
the estimate of that state from then on.

Conversations of usual length meet by id and are repaired whole. A longer one is cut, by a
sort over all tasks, into segments of bounded rows and bytes. Each segment is searched for
every pair of roles at its two ends, the best of these join up across the segments of the
conversation, and the searches of the chosen ends give the edits. Segments carry the inserts
before each of their rows, so no segment's edits are a prefix of others for the same rows and
ASCII order decides segment by segment. Rows that stand several times at one turn travel as
one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import in_slices
from worksight.operators.keyed_join import attach
from worksight.sources.scratch import stored

# Longer conversations, by rows or UTF-8 bytes, are repaired in segments of at most so many.
SEGMENT_ROWS = 192
SEGMENT_BYTES = 2 << 20
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
OK, BLANK, DUPLICATE, TRUNCATED = range(4)  # the faults of a row; a row's first one counts
WHITE = " \t\n\r\v\f"
STOPS = ".!?"
# Last roles: none yet, system, user, assistant; a conversation may end at these.
STATES = "-sua"
ENDS = (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TURN = {0: 2, 1: 2, 2: 3, 3: 2}  # the one role an inserted or changed row can take
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}


class Search:
    """The cheapest edits of a run of rows, given as role initials and faults.

    ``last`` tells whether the conversation ends with this run; if not, ``best`` wants a
    certain role at its end, and inserts behind the last row belong to the next run.
    """

    def __init__(self, initials: list[str], faults: list[int], last: bool):
        self.initials, self.faults, self.last = initials, faults, last
        n = len(initials)
        self.keepable = [
            "" if fault in (BLANK, DUPLICATE) else initial
            for initial, fault in zip(initials, faults, strict=True)
        ]
        # an estimate that never exceeds the cost: what each fault costs at least, and one
        # for every neighbouring pair of rows that may stay and doesn't fit, since no edit
        # mends more such pairs than it costs beyond the fault
        self.rest = [0] * (n + 1)
        self.first: list[str | None] = [None] * (n + 1)  # of the next row that may stay
        for i in range(n - 1, -1, -1):
            self.rest[i], self.first[i] = self.rest[i + 1], self.first[i + 1]
            if faults[i] in (BLANK, DUPLICATE):
                self.rest[i] += DELETE_COST
                continue
            self.rest[i] += TRUNCATED_COST if faults[i] == TRUNCATED else 0
            behind = self.first[i + 1]
            if behind is None:
                self.rest[i] += last and initials[i] != "a"
            else:
                self.rest[i] += initials[i] + behind not in LEGAL
            self.first[i] = initials[i]

    def estimate(self, i: int, state: int) -> int:
        first = self.first[i]
        if first is not None:
            return self.rest[i] + ((state, first) not in NEXT)
        return self.rest[i] + (self.last and state not in ENDS)

    def _edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edit, cost, rows done and state behind it, in ASCII order."""
        turn = TURN[state]
        if i == len(self.initials):
            if self.last:
                yield INSERT, INSERT_COST, i, turn
            return
        yield DELETE, DELETE_COST, i + 1, state
        yield INSERT, INSERT_COST, i, turn
        fault = self.faults[i]
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = NEXT.get((state, self.initials[i]))
        if kept is not None:
            yield KEEP, extra, i + 1, kept
        yield REROLE, REROLE_COST + extra, i + 1, turn

    def best(self, start: int, end: int | None = None) -> tuple[int, str] | None:
        """Least cost and its ASCII-least edits from state ``start``; None if ``end`` is out of reach.

        ``end`` is the state to reach, or None for any that a conversation may end at.
        """
        n = len(self.initials)
        proved: dict[tuple[int, int], int] = {}

        def estimate(i: int, state: int) -> int:
            if end is None or end > 1:
                return self.estimate(i, state)
            # nothing comes before a system row, so all other rows have to go
            left = DELETE_COST * (n - i)
            if state == end:
                return left
            if state == 0 and "s" in self.keepable[i:]:
                return left - DELETE_COST
            return ceiling + 1

        def least(i: int, state: int) -> int:
            found = proved.get((i, state))
            return estimate(i, state) if found is None else found

        # no row kept, and as many inserted as any end needs
        ceiling = DELETE_COST * n + 3 * INSERT_COST
        bound = least(0, start)
        while bound <= ceiling:
            path: list[str] = []
            # frames: rows done, state, cost still allowed, edits left, least cost out of reach
            frames = [[0, start, bound, self._edits(0, start), None]]
            while frames:
                i, state, allowed, edits, beyond = frames[-1]
                if i == n and (state == end if end is not None else state in ENDS):
                    return bound - allowed, "".join(path)
                for edit, cost, done, then in edits:
                    needed = cost + least(done, then)
                    if needed <= allowed:
                        path.append(edit)
                        frames.append([done, then, allowed - cost, self._edits(done, then), None])
                        break
                    if beyond is None or needed < beyond:
                        frames[-1][4] = beyond = needed
                else:  # failed: at least what was out of reach is needed from here
                    frames.pop()
                    proved[i, state] = max(least(i, state), ceiling + 1 if beyond is None else beyond)
                    if frames:
                        path.pop()
                        cost = frames[-1][2] - allowed
                        needed = cost + proved[i, state]
                        above = frames[-1][4]
                        frames[-1][4] = needed if above is None else min(above, needed)
            bound = proved[0, start]
        return None


class Rows(NamedTuple):
    """Rows of one conversation in order: roles, texts, faults."""

    roles: list[str]
    texts: list[str]
    faults: list[int]

    def search(self, last: bool) -> Search:
        return Search([role[:1] for role in self.roles], self.faults, last)

    def repaired(self, edits: str, state: int) -> Iterator[str]:
        """``role:text`` of every row behind the edits."""
        i = 0
        for edit in edits:
            if edit == KEEP:
                state = NEXT[state, self.roles[i][:1]]
                yield f"{self.roles[i]}:{self.texts[i]}"
            elif edit != DELETE:
                state = TURN[state]
                yield f"{ROLES[state]}:{self.texts[i] if edit == REROLE else ''}"
            i += edit != INSERT

    def illegal(self) -> int:
        pairs = zip(self.roles, self.roles[1:])
        return sum(left[:1] + right[:1] not in LEGAL for left, right in pairs)


def fault_of(text: str, seen_before: bool) -> int:
    bare = text.rstrip(WHITE)
    if not bare:
        return BLANK
    if seen_before:
        return DUPLICATE
    return OK if bare[-1] in STOPS else TRUNCATED


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, " + (
    "cost bigint, audit string, repaired_sha256 string"
)
EMPTY = hashlib.sha256(b"").hexdigest()
RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def damaged(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv, turn, role, text and n (1 or 2): rows damaged by the crc32 of ``id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its stops, 3 doubles it, 4 makes it a user's.
    Nulls are one space in the key, the role and the text.
    """
    space = F.lit(" ")
    key = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), space) for c in (id_col, turn_col))
    )
    damage = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        damage.alias("damage"),
    ).where("damage != 0")
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "")
        .when(F.col("damage") == 2, F.translate("text", STOPS, ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("damage") == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def _bytes() -> Column:
    return F.octet_length("role") + F.octet_length("text") + 16


def _usual(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations of bounded size, each within a task."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out = None, None, []

        def close() -> None:
            if held is None:
                return
            roles, texts, faults, turns, seen = [], [], [], set(), set()
            for turn, role, text, n in held:
                turns.add(turn)
                for _ in range(n):
                    roles.append(role)
                    texts.append(text)
                    faults.append(fault_of(text, (role, text) in seen))
                    seen.add((role, text))
            rows = Rows(roles, texts, faults)
            turns.discard(None)
            cost, audit = rows.search(True).best(0)
            text = "\n".join(rows.repaired(audit, 0))
            out.append(
                {
                    "conv": conv,
                    "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    "blank": faults.count(BLANK),
                    "duplicate": faults.count(DUPLICATE),
                    "truncated": faults.count(TRUNCATED),
                    "illegal": rows.illegal(),
                    "cost": cost,
                    "audit": audit,
                    "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
                }
            )

        schema = None
        for batch in in_slices(batches, rows=20_000):
            schema = schema or pa.schema([batch.schema.field("conv"), *RESULT_FIELDS])
            for one, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if held is None or one != conv:
                    close()
                    conv, held = one, []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ordered = (
        rows.select("conv", "turn", "role", "text", "n")
        .repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
    )
    return ordered.mapInArrow(repair, f"conv {kind}, {RESULT}")


_ARROW = {"bigint": pa.int64(), "string": pa.string()}
RESULT_FIELDS = [pa.field(p.split()[0], _ARROW[p.split()[1]]) for p in RESULT.split(", ")]


def _segments(rows: DataFrame, kind: str) -> DataFrame:
    """Segments of long conversations, in the order of ``part`` and ``place``.

    ``rows`` are distinct rows with n, their number, and first, whether the conversation has
    no such row at an earlier turn. Rows of a count stand behind one another in a segment.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        conv, held, size, schema = None, [], 0, None

        def closed() -> pa.RecordBatch:
            nonlocal place
            roles, texts, faults, copies = (list(x) for x in zip(*held))
            place += 1
            row = {"conv": conv, "part": part, "place": place, "roles": roles}
            row |= {"texts": texts, "faults": faults, "copies": copies}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in in_slices(batches):
            schema = schema or pa.schema([batch.schema.field("conv"), *SEGMENT_FIELDS])
            for one, role, text, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (one != conv or len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                    yield closed()
                    held, size = [], 0
                conv = one
                fault = fault_of(text, not first)
                held.append((role, text, fault, 1))
                size += 4 * len(text)
                if n > 1:  # the rest of the copies: blank or duplicates, to be deleted
                    held.append((role, text, BLANK if fault == BLANK else DUPLICATE, n - 1))
        if held:
            yield closed()

    ordered = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions(
        "conv", "turn", "role", "text"
    )
    chosen = ordered.select("conv", "role", "text", "n", "first")
    schema = (
        f"conv {kind}, part int, place int, roles array<string>, texts array<string>, "
        "faults array<int>, copies array<bigint>"
    )
    return chosen.mapInArrow(cut, schema)


SEGMENT_FIELDS = [
    pa.field("part", pa.int32()),
    pa.field("place", pa.int32()),
    pa.field("roles", pa.list_(pa.string())),
    pa.field("texts", pa.list_(pa.string())),
    pa.field("faults", pa.list_(pa.int32())),
    pa.field("copies", pa.list_(pa.int64())),
]


def _collapsed(rows: Rows, copies: list[int]) -> tuple[Rows, list[int]]:
    """The rows without those that must be deleted, and how many such stand before each.

    A row that must go adds its cost and a D, and leaves the state as it is.
    """
    kept, gone = Rows([], [], []), [0]
    for role, text, fault, n in zip(*rows, copies, strict=True):
        if fault in (BLANK, DUPLICATE):
            gone[-1] += n
        else:
            kept.roles.append(role)
            kept.texts.append(text)
            kept.faults.append(fault)
            gone.append(0)
    return kept, gone


def _with_deleted(edits: str, gone: list[int]) -> str:
    """Edits of the rows that may stay, with the D of those that must go in their places.

    D comes before I in ASCII order, so what must go goes before anything is inserted.
    """
    out, row = [DELETE * gone[0]], 0
    for edit in edits:
        out.append(edit)
        if edit != INSERT:
            row += 1
            out.append(DELETE * gone[row])
    return "".join(out)


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations of any length, segment by segment."""
    digest = F.unhex(
        F.sha2(
            F.concat_ws(
                ":",
                F.coalesce(F.col("conv").cast("string"), F.lit("null")),
                F.isnull("conv").cast("string"),
                F.length("role").cast("string"),
                F.concat("role", "text"),
            ),
            256,
        )
    )
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    distinct = stored(distinct.withColumn("digest", digest), "long-conversations")
    again = distinct.groupBy("digest").agg(
        F.min(F.struct("turn")).alias("first_turn"), F.count("*").alias("times")
    )
    again = stored(again.where(F.col("times") > 1), "repeated-rows")
    marked = attach(distinct, again, ["digest"], "times", spread_by="turn")
    first = F.col("times").isNull() | F.col("turn").eqNullSafe(F.col("first_turn.turn"))
    segments = stored(
        _segments(marked.withColumn("first", first).drop("digest"), kind), "segments"
    )

    # figures of whole conversations, from sums of each task
    turns = distinct.groupBy("conv", "turn").agg(F.count("*").alias("rows"))
    gaps = turns.groupBy("conv").agg(
        F.coalesce(
            F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)
        ).cast("bigint").alias("gaps")
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each segment: fault counts, ends, and cost and rank of every way through it."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = Rows(row["roles"], row["texts"], row["faults"])
                copies = row["copies"]
                kept, gone = _collapsed(rows, copies)
                found = {last: kept.search(last) for last in (False, True)}
                costs, ranks = [], []
                base = DELETE_COST * sum(gone)
                for start in range(len(STATES)):
                    ways = [found[False].best(start, end) for end in range(len(STATES))]
                    ways.append(found[True].best(start))  # the conversation's last segment
                    full = [w and _with_deleted(w[1], gone) for w in ways]
                    order = sorted({w for w in full if w is not None})
                    costs += [w and w[0] + base for w in ways]
                    ranks += [w if w is None else order.index(w) for w in full]
                # copies of a row stand beside it, and their roles' pairs are alike
                inner = rows.illegal() + sum(
                    (n - 1) * (role[:1] * 2 not in LEGAL)
                    for role, n in zip(rows.roles, copies, strict=True)
                )
                count = [
                    sum(n for f, n in zip(rows.faults, copies, strict=True) if f == fault)
                    for fault in (BLANK, DUPLICATE, TRUNCATED)
                ]
                out.append(
                    {
                        "conv": row["conv"],
                        "part": row["part"],
                        "place": row["place"],
                        "counts": [*count, inner],
                        "ends": [rows.roles[0][:1], rows.roles[-1][:1]],
                        "costs": costs,
                        "ranks": ranks,
                    }
                )
            fields = [batch.schema.field("conv"), *SEGMENT_FIELDS[:2]]
            long, names = pa.list_(pa.int64()), ("counts", "costs", "ranks")
            fields += [pa.field(n, long) for n in names] + [pa.field("ends", pa.list_(pa.string()))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    ways = segments.mapInArrow(
        measured,
        f"conv {kind}, part int, place int, counts array<bigint>, costs array<bigint>, "
        "ranks array<bigint>, ends array<string>",
    )

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        """The states at the ends of each segment of a conversation: one small row a segment."""
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        rows = table.select(["costs", "ranks", "ends"]).to_pylist()
        n, width = len(rows), len(STATES) + 1
        best: list[int | None] = [None] * len(STATES)
        chosen = []
        for k in range(n - 1, -1, -1):
            costs, ranks = rows[k]["costs"], rows[k]["ranks"]
            now, through = [], []
            for start in range(len(STATES)):
                options = []
                if k == n - 1:
                    cost = costs[start * width + width - 1]
                    options.append((cost, ranks[start * width + width - 1], -1))
                else:
                    for end in range(len(STATES)):
                        cost = costs[start * width + end]
                        if cost is not None and best[end] is not None:
                            options.append((cost + best[end], ranks[start * width + end], end))
                cost, _, end = min(options, default=(None, None, None))
                now.append(cost)
                through.append(end)
            best = now
            chosen.append(through)
        chosen.reverse()
        starts, ends, state = [], [], 0
        for through in chosen:
            starts.append(state)
            state = through[state]
            ends.append(state)
        across = [
            int(k > 0 and rows[k - 1]["ends"][1] + rows[k]["ends"][0] not in LEGAL)
            for k in range(n)
        ]
        return table.select(["conv", "part", "place", "counts"]).append_column(
            "start", pa.array(starts, pa.int32())
        ).append_column("end", pa.array(ends, pa.int32())).append_column(
            "across", pa.array(across, pa.int64())
        ).append_column("cost", pa.array([best[0]] * n, pa.int64()))

    states = ways.groupBy("conv").applyInArrow(
        joined,
        f"conv {kind}, part int, place int, counts array<bigint>, start int, end int, "
        "across bigint, cost bigint",
    )
    states = stored(states, "segment-ends")
    totals = states.groupBy("conv").agg(
        *(
            F.sum(F.get("counts", F.lit(k))).alias(name)
            for k, name in enumerate(("blank", "duplicate", "truncated"))
        ),
        F.sum(F.get("counts", F.lit(3)) + F.col("across")).alias("illegal"),
        F.any_value("cost").alias("cost"),
    )

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audit and digest of each conversation, its segments taken one after the other."""
        conv, audit, sha, begun, schema = None, None, None, False, None

        def row() -> pa.RecordBatch:
            found = {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
            return pa.RecordBatch.from_pylist([found], schema)

        for batch in in_slices(batches, rows=64):
            schema = schema or pa.schema([batch.schema.field("conv"), *RESULT_FIELDS[-2:]])
            for segment in batch.to_pylist():
                if audit is None or segment["conv"] != conv:
                    if audit is not None:
                        yield row()
                    conv, audit, sha, begun = segment["conv"], [], hashlib.sha256(), False
                rows = Rows(segment["roles"], segment["texts"], segment["faults"])
                kept, gone = _collapsed(rows, segment["copies"])
                start, end = segment["start"], segment["end"]
                last = end < 0
                _, edits = kept.search(last).best(start, None if last else end)
                audit.append(_with_deleted(edits, gone))
                for text in kept.repaired(edits, start):
                    sha.update(f"\n{text}".encode() if begun else text.encode())
                    begun = True
        if audit is not None:
            yield row()

    ends = states.select("part", "place", "start", "end")
    ordered = (
        segments.join(ends, ["part", "place"])
        .select("conv", "part", "place", "roles", "texts", "faults", "copies", "start", "end")
        .repartition("conv")
        .sortWithinPartitions("conv", "part", "place")
    )
    texts = ordered.mapInArrow(edited, f"conv {kind}, audit string, repaired_sha256 string")
    same = [F.col(f"{x}.conv").eqNullSafe(F.col("t.conv")) for x in ("g", "e")]
    found = totals.alias("t").join(gaps.alias("g"), same[0]).join(texts.alias("e"), same[1])
    return found.select("t.conv", *RESULT_NAMES)


def repair_conversations(
    rows: DataFrame, ids: DataFrame, id_col: str = "conv_id"
) -> DataFrame:
    """Faults, least cost and edits of every conversation in ``ids``.

    ``rows`` has conv, turn (whole numbers), role, text and n (how often the row stands there);
    ``ids`` has the ids to return in its first column, repeated ones once, null as an id of
    its own. Rows are taken by turn, nulls first, rows of one turn by role and text. Columns:
    ``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. An id
    without rows has zeros, no edits and the digest of nothing. An empty role fits nowhere and
    is changed or deleted. Texts are taken whole; a single row may exceed SEGMENT_BYTES.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    every = ids.select(F.col(ids.columns[0]).alias("conv")).distinct()
    sizes = rows.groupBy("conv").agg(
        F.sum("n").alias("size"),
        F.sum(_bytes() * F.col("n")).alias("bytes"),
        F.count("*").alias("n_rows"),
    )
    # a null id is a value of its own
    key = [F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("key")]
    key.append(F.isnull("conv").alias("no_conv"))
    beyond = (F.col("size") > SEGMENT_ROWS) | (F.col("bytes") > SEGMENT_BYTES)
    long = stored(sizes.where(beyond).select(*key, "n_rows"), "long-ids")
    if long.isEmpty():
        results = _usual(rows, kind)
    else:
        spread = F.xxhash64("turn", "text").alias("spread")
        split = attach(rows.select("*", *key, spread), long, ["key", "no_conv"], "n_rows", "spread")
        split = split.drop("key", "no_conv", "spread")
        is_long = F.col("n_rows").isNotNull()
        results = _usual(split.where(~is_long), kind).unionByName(
            _long(split.where(is_long).drop("n_rows"), kind)
        )
    found = every.alias("i").join(
        results.alias("r"), F.col("i.conv").eqNullSafe(F.col("r.conv")), "left"
    )
    filled = [
        F.coalesce(F.col(c), F.lit({"audit": "", "repaired_sha256": EMPTY}.get(c, 0))).alias(c)
        for c in RESULT_NAMES
    ]
    return found.select(F.col("i.conv").alias(id_col), *filled)


def repair_damaged(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The conversations damaged row by row and repaired: one row for every id of the table."""
    return repair_conversations(
        damaged(conversations, id_col), conversations.select(id_col), id_col
    )
