"""Terms of works coded as integers, and each work's vector as an array sorted by rarity.

A term is a word or two neighbouring words, within a category. It is known by two hashes, made
from the hashes of its words, so no term text is built, sorted or shuffled. The first hash is
the term's code; with 16 bits of the second it tells 80 bits of terms apart. A stored dictionary
holds the terms that two or more works have, with the number of works and projects; what stands
in one work only goes no further, and neither do works whose shared terms make up too little of
their norm (``shared_terms``). The order of vectors is by number of works and code, rarest first.
Terms that share a code, which the second hashes show, get codes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.operators.keyed_join import attach
from worksight.operators.shared_terms import counted_terms, keys_of, terms_of, weighed_terms
from worksight.sources.scratch import stored

# Bits of the codes; fewer make them clash, which costs time and changes no result.
CODE_BITS = 64
# A dictionary or a list of keys of up to so many rows, few integers each, is broadcast.
BROADCAST_CODES = 1_000_000


def _hashed(works: DataFrame) -> DataFrame:
    """``works`` with code and check, arrays of the two hashes of all terms in text order."""

    def of_words(seed: int) -> Column:
        return F.transform("tokens", lambda word: F.xxhash64(F.lit(seed), "category", word))

    def with_pairs(name: str, seed: int) -> Column:
        n = F.size(name) - 1
        pairs = F.zip_with(
            F.slice(name, F.lit(1), n),
            F.slice(name, F.lit(2), n),
            lambda left, right: F.xxhash64(F.lit(seed), left, right),
        )
        return F.concat(name, pairs)

    return (
        works.withColumn("tokens", F.split("words", " "))
        .withColumns({"h": of_words(1), "l": of_words(2)})
        .withColumns({"code": with_pairs("h", 1), "check": with_pairs("l", 2)})
        .withColumn("code", F.transform("code", _cut) if CODE_BITS < 64 else F.col("code"))
        .drop("words", "tokens", "h", "l")
    )


def _cut(code: Column) -> Column:
    return F.shiftright(code, 64 - CODE_BITS)


def _short(check: Column) -> Column:
    """The part of the second hash that the dictionary has."""
    return F.shiftright(check, 48).cast("short")


def _squared_counts(terms: Column) -> Column:
    """Sum of the squared term counts of a row, by runs of its sorted terms."""
    long = F.lit(0).cast("long")
    start = F.struct(long.alias("term"), long.alias("run"), long.alias("sum"))

    def step(so_far: Column, term: Column) -> Column:
        # (run + 1)^2 - run^2 = 2 run + 1
        run = F.when(so_far["term"] == term, so_far["run"]).otherwise(long)
        return F.struct(
            term.alias("term"), (run + 1).alias("run"), (so_far["sum"] + run * 2 + 1).alias("sum")
        )

    return F.aggregate(F.sort_array(terms), start, step, lambda end: end["sum"])


def _entries(postings: DataFrame) -> DataFrame:
    """One row per work: entries, an array of n_works, code, tf, df, rarest first."""
    entry = F.struct("n_works", "code", "tf", "df")
    return postings.groupBy("work_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def shared_terms(works: DataFrame, dictionary: DataFrame) -> DataFrame:
    """work_id and entries of the terms each work has in common with others.

    ``dictionary`` has code, check, n_works, df and clashes of such terms. The occurrences of
    a work are counted where its text is; what is shared is brought together once.
    """
    hashed = _hashed(works).withColumn("check", F.transform("check", _short))
    kind = works.schema["work_id"].dataType.simpleString()
    counted = hashed.select("work_id", "code", "check").mapInArrow(
        counted_terms, f"work_id {kind}, code long, check short, tf int"
    )
    own_code = F.when(F.col("clashes"), F.xxhash64("code", "check")).otherwise(F.col("code"))
    postings = (
        attach(
            counted,
            dictionary,
            ["code", "check"],
            "n_works",
            spread_by="work_id",
            how="inner",
            small=dictionary.count() <= BROADCAST_CODES,
            hashed=True,
        )
        .select("work_id", own_code.alias("code"), "tf", "n_works", "df")
        .repartition("work_id")
    )
    return _entries(postings)


def _kept(works: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Works whose shared terms may make up ``least`` of their norm, and the dictionary."""
    keyed = works.withColumn("key", F.xxhash64("category", "words"))
    sized = keyed.withColumn("n_characters", F.length("words"))
    hashed = _hashed(sized).withColumn("check", F.transform("check", _short))
    weighed = stored(weighed_terms(hashed, least), "weighed-terms")
    keys = stored(keys_of(weighed), "kept-keys")
    few = keys.count() <= BROADCAST_CODES
    kept = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi").drop("key")
    return stored(kept, "kept-works"), terms_of(weighed)


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def weight(tf: Column, n_docs: Column, df: Column) -> Column:
    """Weight of a term before normalisation."""
    return tf * _idf(n_docs, df)


def work_vectors(works: DataFrame, least: float) -> DataFrame:
    """One row for each work whose shared terms make up ``least`` of its squared norm or more.

    ``works`` has category, work_id, n_projects, n_docs (projects of its category) and words.
    Columns: category, work_id, n_projects, n_docs, vector (array of n_works, code, tf, df, weight;
    rarest first, weights before normalisation), shared (its squared norm), alone (squared counts of
    the terms no other work has, which all weigh the same per count and add to no dot product)
    and total (the whole squared norm).
    """
    works, dictionary = _kept(works, least)
    lengths = _hashed(works).select(
        "category",
        "work_id",
        "n_projects",
        "n_docs",
        _squared_counts(F.col("check")).alias("squares"),
    )

    def weighed(entry: Column) -> Column:
        return F.struct(
            entry["n_works"].alias("n_works"),
            entry["code"].alias("code"),
            entry["tf"].alias("tf"),
            entry["df"].alias("df"),
            weight(entry["tf"], F.col("n_docs"), entry["df"]).alias("weight"),
        )

    def summed(start: Column, value) -> Column:
        return F.aggregate("vector", start, lambda total, entry: total + value(entry))

    own_idf = _idf(F.col("n_docs"), F.col("n_projects"))
    shared = summed(F.lit(0.0), lambda e: e["weight"] * e["weight"])
    shared_squares = summed(F.lit(0).cast("long"), lambda e: e["tf"].cast("long") * e["tf"])
    facts = F.struct(
        "category",
        "work_id",
        "n_projects",
        "n_docs",
        (F.col("squares") - shared_squares).alias("alone"),
        (own_idf * own_idf).alias("own_square"),
        "vector",
        shared.alias("shared"),
    )
    weighted = lengths.join(shared_terms(works, dictionary), "work_id")
    weighted = weighted.withColumn("vector", F.transform("entries", weighed))
    total = F.col("shared") + F.col("alone") * F.col("own_square")
    # out of an array: Spark would push the filter down as a second evaluation of all of it
    return (
        weighted.select(F.inline(F.array(facts)))
        .withColumn("total", total)
        .where(F.col("shared") >= F.lit(least) * F.col("total"))
        .drop("own_square")
    )
