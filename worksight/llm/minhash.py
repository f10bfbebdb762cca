"""Near-duplicate documents by MinHash, with an inverted join over signature coordinates.

Every document's set of word shingles gets a signature of COORDINATES minima. Two documents
are candidates when at least ``matches`` coordinates are equal. They are found from postings:
a document is posted under (coordinate, value) pairs, but only under its rarest ones, a
prefix of COORDINATES - matches + 1 in one order of all pairs, since two documents with
that many equal coordinates share one of these. The long lists of common values are so
skipped, never merged; whether enough coordinates are equal is then read off the two
signatures, and the similarity is confirmed on the full sets.

Lists of many documents are not expanded into all pairs. First each document is compared
with two hubs of each of its lists, and linked documents are joined into components. Then
the lists that still hold several components are compared in blocks, on longer sketches;
what comes out is only which components belong to one family, as a forest. Within a family
the full sets are compared, block by block, and again only links that join components come
out. No step leaves out a pair that could join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import BoundedCache, groups, in_slices, take_worker, text_or_empty
from worksight.llm.components import components
from worksight.sources.scratch import stored

COORDINATES = 40
# Standard deviations by which the match threshold lies below the expected number of equal
# coordinates at the wanted similarity; about one pair in 10**5 at that similarity has fewer.
MARGIN = 4.6
# Coordinates of the longer sketches, of 16 bits each, on which candidates are counted.
SKETCHED = 192
SKETCH_MARGIN = 4.6
BLOCK = 4_096  # documents of one list that are compared with one another in one go
FAMILY_BLOCK = 512  # ... and of one family, on their full sets
COLUMNS = 4_096  # shingles that a comparison of full sets lays out at once
CACHED_WORDS = 200_000
_U64 = np.uint64
_random = np.random.default_rng(2024)
_FACTORS = _random.integers(1, 1 << 63, SKETCHED, dtype=np.uint64) * _U64(2) + _U64(1)
_MIX = _U64(0x9E3779B97F4A7C15)


class WordHashes(BoundedCache):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = WordHashes(CACHED_WORDS)


def _forget() -> None:
    _words.clear()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words, A-Z lower-cased.

    A text of fewer words is one shingle; without words the set is empty.
    """
    _words.room_for(1)
    words = text.encode().lower().split()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    mixed = np.full(n, len(hashes) if len(hashes) < width else width, np.uint64)
    for k in range(min(width, len(hashes))):
        mixed = (mixed ^ hashes[k : k + n]) * _MIX
        mixed ^= mixed >> _U64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """The smallest value of each of SKETCHED hashes over the set.

    The first COORDINATES with 32 bits, and all of them with 16.
    """
    out = np.empty(SKETCHED, np.uint64)
    for k in range(SKETCHED):
        out[k] = (shingles * _FACTORS[k]).min()
    out >>= _U64(32)
    return out[:COORDINATES].astype(np.uint32).tobytes(), out.astype(np.uint16).tobytes()


def match_threshold(percent: int, coordinates: int = COORDINATES, margin: float = MARGIN) -> int:
    """Equal coordinates that a pair needs to be a candidate at this similarity."""
    share = percent / 100
    spread = (coordinates * share * (1 - share)) ** 0.5
    return max(1, int(coordinates * share - margin * spread))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, n_shingles, set_key (128 bits that tell equal sets), signature, sketch of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("minhash", _forget)
        for batch in in_slices(batches):
            sizes, keys, signs, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sign, sketch = signature(shingles) if len(shingles) else (None, None)
                signs.append(sign)
                sketches.append(sketch)
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(signs, pa.binary()),
                pa.array(sketches, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["id", "n_shingles", "set_key", "signature", "sketch"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        sign,
        f"id {kind}, n_shingles bigint, set_key binary, signature binary, sketch binary",
    )


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """(coordinate, value) keys in each document's prefix that several documents have.

    ``classes``: id, signature. Keys that only one document has come first in the order,
    then rarer before commoner; a document whose prefix is filled by keys of its own is
    posted nowhere.
    """
    spread = []
    for k in range(COORDINATES):
        value = F.conv(F.hex(F.substring("signature", 4 * k + 1, 4)), 16, 10)
        spread.append(value.cast("bigint") + F.lit(k << 32))
    posted = classes.select("id", F.explode(F.array(*spread)).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    prefix = COORDINATES - matches + 1
    by_document = (
        posted.join(shared, "key")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
        .withColumn("left", F.lit(prefix - COORDINATES) + F.size("keys"))
        .where("left > 0")
    )
    return by_document.select("id", F.explode(F.slice("keys", 1, F.col("left"))).alias("k")).select(
        "id", F.col("k.key").alias("key")
    )


def _sketches(batch: pa.RecordBatch, name: str) -> np.ndarray:
    data = np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16)
    return data.reshape(batch.num_rows, SKETCHED)


def _matching(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be similar by their sizes and the matches of their sketches."""
    enough = match_threshold(percent, SKETCHED, SKETCH_MARGIN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = (_sketches(batch, "sketch_a") == _sketches(batch, "sketch_b")).sum(1) >= enough
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (
        classes.select(
            F.col("id").alias(side),
            F.col("n_shingles").alias(f"n_{side}"),
            F.col("sketch").alias(f"sketch_{side}"),
        )
        for side in ("a", "b")
    )
    joined = pairs.join(left, "a").join(right, "b")
    sized = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(count, f"a {kind}, b {kind}")


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, shingles: the full sets of the wanted ids, stored."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("minhash", _forget)
        for batch in in_slices(batches):
            sets = [shingle_set(text, width).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"]
            )

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.join(wanted, "id", "left_semi").mapInArrow(to_sets, f"id {kind}, shingles binary")
    return stored(found.distinct(), "shingle-sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union.

    The texts of the documents in question are joined in once and become sets; a pair then
    meets the two sets.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, rows=4_000):
            keep = []
            columns = (batch.column("set_a"), batch.column("set_b"))
            for left, right in zip(*(c.to_pylist() for c in columns), strict=True):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    sets = _sets(docs, named, width)
    joined = pairs.join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a"
    ).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    kept = joined.select("a", "b", "set_a", "set_b").mapInArrow(confirm, f"a {kind}, b {kind}")
    return stored(kept.distinct(), "similar")


def _hub_pairs(postings: DataFrame) -> DataFrame:
    """Each posted document beside the smallest and the largest of each of its lists."""
    hubs = postings.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    hubs = hubs.where("low < high")
    beside = postings.join(hubs, "key").select(
        "id", F.explode(F.array("low", "high")).alias("hub")
    )
    return (
        beside.where("id <> hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct()
    )


def _blocked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` beside low, high and mine: every pair of blocks of a key is a group of its own.

    A key has blocks of about ``size`` rows, so no group grows with its key. ``rows`` has
    the columns key, id and n, the rows of its key.
    """
    blocks = F.ceil(F.col("n") / size).cast("int")
    mine = F.pmod(F.xxhash64("id", key), blocks.cast("bigint")).cast("int")
    placed = rows.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    return placed.withColumn("low", F.least("mine", "other")).withColumn(
        "high", F.greatest("mine", "other")
    )


def _forest(labels: np.ndarray, blocks: np.ndarray, close) -> Iterator[tuple[int, int]]:
    """Pairs of rows that join what bears different labels; ``close(i)`` tells who is near i.

    Pairs within one block are left to the group of that block alone.
    """
    labels = labels.copy()
    one_block = bool((blocks == blocks[0]).all())
    for i in range(len(labels) - 1):
        wanted = labels != labels[i]
        if not one_block:
            wanted &= blocks != blocks[i]
        wanted[: i + 1] = False
        if not wanted.any():
            continue
        for j in np.flatnonzero(wanted)[close(i, np.flatnonzero(wanted))].tolist():
            if labels[j] != labels[i]:
                yield i, j
                labels[labels == labels[j]] = labels[i]


def _local(column: pa.Array) -> np.ndarray:
    """Small numbers for the distinct values of a column."""
    return column.dictionary_encode().indices.to_numpy()


def _families(
    postings: DataFrame, linked: DataFrame, classes: DataFrame, percent: int
) -> DataFrame:
    """Components (a, b) of which some documents of one list may be similar, as a forest."""
    enough = match_threshold(percent, SKETCHED, SKETCH_MARGIN)
    placed = postings.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    lists = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    lists = lists.where("low < high").select("key", "n")
    facts = classes.select("id", "n_shingles", "sketch")
    rows = _blocked(placed.join(lists, "key"), "key", BLOCK).join(facts, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "low", "high"]):
            sizes, sketches = group.column("n_shingles").to_numpy(), _sketches(group, "sketch")

            def close(i: int, at: np.ndarray, sizes=sizes, sketches=sketches) -> np.ndarray:
                small = np.minimum(sizes[at], sizes[i])
                fits = 100 * small >= percent * np.maximum(sizes[at], sizes[i])
                fits[fits] = (sketches[at[fits]] == sketches[i]).sum(1) >= enough
                return fits

            components = group.column("component")
            found = list(_forest(_local(components), group.column("mine").to_numpy(), close))
            if found:
                lefts, rights = (pa.array(side) for side in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [components.take(lefts), components.take(rights)], names=["a", "b"]
                )

    kind = postings.schema["id"].dataType.simpleString()
    columns = "key low high mine id component n_shingles sketch".split()
    grouped = rows.select(*columns).repartition("key", "low", "high")
    grouped = grouped.sortWithinPartitions("key", "low", "high")
    return stored(grouped.mapInArrow(compare, f"a {kind}, b {kind}").distinct(), "families")


def _links_in_families(
    families: DataFrame, linked: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links (a, b) between components of one family, from the full sets of its documents."""
    family = components(families, "a", "b").select(
        F.col("node").alias("component"), F.col("component").alias("family")
    )
    members = (
        classes.select("id")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .join(family, "component")
        .distinct()
    )
    members = stored(members, "family-members")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    sets = _sets(docs, members.select("id"), width)
    rows = _blocked(members.join(sizes, "family"), "family", FAMILY_BLOCK).join(sets, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["family", "low", "high"]):
            labels = _local(group.column("component"))
            if (labels == labels[0]).all():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            both = common_shingles(sets)

            def close(i: int, at: np.ndarray, sizes=sizes, both=both) -> np.ndarray:
                common = both[i, at].astype(np.int64)
                return 100 * common >= percent * (sizes[at] + sizes[i] - common)

            ids = group.column("id")
            found = list(_forest(labels, group.column("mine").to_numpy(), close))
            if found:
                lefts, rights = (pa.array(side) for side in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(lefts), ids.take(rights)], names=["a", "b"])

    kind = classes.schema["id"].dataType.simpleString()
    columns = "family low high mine id component shingles".split()
    grouped = rows.select(*columns).repartition("family", "low", "high")
    grouped = grouped.sortWithinPartitions("family", "low", "high")
    return stored(grouped.mapInArrow(compare, f"a {kind}, b {kind}"), "family-links")


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, COLUMNS shingles at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1  # a shingle of one set is in no intersection
    number = np.cumsum(several) - 1
    keep = several[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for start in range(0, int(several.sum()), COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[low:high], column[low:high] - start] = 1
        both += part @ part.T
    return both


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """n_shingles, component_id and kept for every row of ``docs``.

    Two documents are linked when 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; component_id is the smallest id that a document reaches over
    links, kept tells whether that is its own. Documents without words (null, empty or
    white space) are linked with nothing. Rows that repeat an id are one document for the
    links. A row without an id is linked with nothing either; its component_id is null and
    it is kept.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    matches = match_threshold(percent)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    signed = stored(signatures(rows, width), "signatures")
    # equal sets are one class, known by its smallest id
    usable = signed.where("id is not null and n_shingles > 0")
    heads = usable.groupBy("set_key").agg(
        F.min("id").alias("id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch"),
    )
    classes = stored(heads, "set-classes")
    texts = rows.where("id is not null")
    postings = stored(_postings(classes.select("id", "signature"), matches), "postings")

    at_hubs = stored(_matching(_hub_pairs(postings), classes, percent).distinct(), "hub-pairs")
    links = _confirmed(at_hubs, texts, width, percent)
    linked = stored(components(links, "a", "b"), "linked")
    families = _families(postings, linked, classes, percent)
    more = _links_in_families(families, linked, classes, texts, width, percent)
    all_links = links.unionByName(more).unionByName(_repeated_ids(usable, classes))
    reached = components(all_links, "a", "b").withColumnRenamed("node", "id")
    by_class = classes.join(reached, "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component_id")
    )
    return (
        signed.withColumn("linkable", F.expr("id is not null and n_shingles > 0"))
        .join(by_class.withColumn("linkable", F.lit(True)), ["set_key", "linkable"], "left")
        .withColumn("component_id", F.coalesce("component_id", "id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
        .select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")
    )


def _repeated_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of ids that stand for several different sets."""
    sets = usable.select("id", "set_key").withColumn("sign", F.xxhash64("set_key"))
    several = sets.groupBy("id").agg(F.min("sign").alias("low"), F.max("sign").alias("high"))
    several = several.where("low < high").select("id")
    heads = classes.select("set_key", F.col("id").alias("head"))
    return (
        sets.join(several, "id")
        .join(heads, "set_key")
        .select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
        .where("a < b")
    )
