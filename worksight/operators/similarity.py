"""Near-duplicate work descriptions: exact TF-IDF cosine join within each category.

Two levels of equality keep the join small. Projects of one category whose descriptions have
the same token sequence form one *work*. Works that have the same terms in common with others,
equally often, and the same norm form one *shape*: they differ only in terms nobody else has,
so each has the same similarity to any work outside, and any two of them the same to each
other. Near copies of a template, each with words of its own, are one shape.

Pairs of different shapes come from a join on shared terms, cut down to each shape's rarest
terms by the prefix bound of All-Pairs (Bayardo, Ma and Srikant, 2007), and are then verified
on the whole vectors. Signals, counts and classes follow from shapes, their pairs and their
sizes; neither a group of copies nor a shape is ever expanded into its pairs unless a caller
lists them. The result is complete: no term, partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.config import DEFAULT, ScreeningConfig
from worksight.functions.numeric import round_scaled
from worksight.functions.text import STOP_WORDS, word_tokens
from worksight.operators.components import components
from worksight.operators.keyed_join import attach
from worksight.operators.terms import weight, work_vectors
from worksight.sources.schema import PAIR_SCHEMA, require_columns
from worksight.sources.scratch import kept, release, shared_dir, stored
from worksight.sources.workers import ship_code

# Shapes that share a lead term meet in cells of at most about this many by this many.
CELL_WORKS = 10_000
# A vector is kept as arrays of small numbers, from which its weights follow.
VECTOR = {"term_works": "n_works", "code": "code", "tf": "tf", "df": "df"}
VECTOR_COLUMNS = [*VECTOR, "n_docs", "total"]
# Ids of up to so many shapes are broadcast.
BROADCAST_SHAPES = 1_000_000
# So many candidates are verified at once, about, as each is shuffled beside a whole vector.
VERIFIED = 50_000
# Slack of the bounds for floating-point sums; the threshold itself has none.
SLACK = 1e-9


@dataclass(frozen=True)
class SimilarWorks:
    """Complete result in factored form.

    works: category, words_key, work_id (its first project), work_seq, n_projects, shape_id
        (NULL for a work that is similar to no other)
    shapes: category, shape_id (its first work), shape_seq, n_works, n_projects (of each of
        its works), inner_pct (similarity of any two of its works, NULL below the threshold)
    shape_pairs: category, shape_1, works_1, n_1, shape_2, works_2, n_2, similarity_pct; each
        stands for works_1 * works_2 pairs of works and n_1 * n_2 times as many of projects
    members: project_id, seq, category, words_key; one row per project with tokens
    """

    works: DataFrame
    shapes: DataFrame
    shape_pairs: DataFrame
    members: DataFrame
    stop_words: list[str]

    def key_of(self, text: Column) -> Column:
        """The words_key of a description."""
        return _words_key(_words(text, self.stop_words))

    @property
    def pairs(self) -> DataFrame:
        """All pairs of similar works, listed: as many rows as there are such pairs.

        category, work_1, seq_1, n_1, work_2, seq_2, n_2, similarity_pct, with work_1 before
        work_2; stands for n_1 * n_2 project pairs.
        """
        return _listed_pairs(self.works, self.shape_pairs, self.shapes)


def _listed_pairs(works: DataFrame, shape_pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    work = F.struct("work_seq", "work_id", "n_projects")
    p = works.select(F.col("shape_id").alias("shape_1"), work.alias("p"))
    q = works.select(F.col("shape_id").alias("shape_2"), work.alias("q"))
    within = shapes.where(F.col("inner_pct").isNotNull() & (F.col("n_works") > 1)).select(
        "category",
        F.col("shape_id").alias("shape_1"),
        F.col("shape_id").alias("shape_2"),
        F.col("inner_pct").alias("similarity_pct"),
    )
    linked = shape_pairs.select("category", "shape_1", "shape_2", "similarity_pct")
    once = (F.col("shape_1") != F.col("shape_2")) | (F.col("p") < F.col("q"))
    met = linked.unionByName(within).join(p, "shape_1").join(q, "shape_2").where(once)
    first, second = F.least("p", "q"), F.greatest("p", "q")
    both = met.select("category", "similarity_pct", first.alias("p"), second.alias("q"))
    return both.select(
        "category",
        F.col("p.work_id").alias("work_1"),
        F.col("p.work_seq").alias("seq_1"),
        F.col("p.n_projects").alias("n_1"),
        F.col("q.work_id").alias("work_2"),
        F.col("q.work_seq").alias("seq_2"),
        F.col("q.n_projects").alias("n_2"),
        "similarity_pct",
    )


def _words(text: Column, stop_words: list[str]) -> Column:
    return F.array_join(word_tokens(text, stop_words), " ")


def _words_key(words: Column) -> Column:
    """Digest of a token sequence; NULL for an empty one, which matches nothing."""
    return F.when(words != "", F.unhex(F.sha2(words, 256)))


def _tokenised(
    projects: DataFrame,
    id_col: str,
    group_col: str,
    text_col: str,
    order_col: str,
    stop_words: list[str],
) -> DataFrame:
    return (
        projects.where(F.col(group_col).isNotNull())
        .select(
            F.col(id_col).alias("project_id"),
            F.col(order_col).alias("seq"),
            F.col(group_col).alias("category"),
            _words(F.col(text_col), stop_words).alias("words"),
        )
        .withColumn("words_key", _words_key(F.col("words")))
    )


def _collapsed(tokenised: DataFrame) -> DataFrame:
    """One row per category and token sequence, copies merged before the shuffle."""
    return (
        tokenised.groupBy("words_key", "category")
        .agg(
            F.min(F.struct("seq", "project_id")).alias("first"),
            F.any_value("words").alias("words"),
            F.count("*").alias("n_projects"),
        )
        .select(
            "category",
            "words_key",
            F.col("first.project_id").alias("work_id"),
            F.col("first.seq").alias("work_seq"),
            "n_projects",
            "words",
        )
    )


def _shaped(vectors: DataFrame) -> DataFrame:
    """``vectors`` with shape_key: equal for equal shared terms, counts, norm and copies."""
    terms = F.transform(
        "vector", lambda e: F.concat_ws(":", e["code"].cast("string"), e["tf"].cast("string"))
    )
    facts = F.concat_ws("/", "category", "alone", "n_projects")
    keyed = vectors.withColumn("shape_key", F.unhex(F.sha2(F.concat_ws(",", facts, terms), 256)))
    return keyed.withColumns({c: F.col(f"vector.{field}") for c, field in VECTOR.items()}).drop("vector")


def _unit(prefix: str = "") -> Column:
    """Unit vector, array of n_works, code and weight, of the columns that make it up."""
    n_docs, total = F.col(f"{prefix}n_docs"), F.col(f"{prefix}total")
    return F.transform(
        F.arrays_zip(*(F.col(f"{prefix}{c}").alias(c) for c in VECTOR)),
        lambda e: F.struct(
            e["term_works"].alias("n_works"),
            e["code"].alias("code"),
            (weight(e["tf"], n_docs, e["df"]) / F.sqrt(total)).alias("weight"),
        ),
    )


def _shapes(shaped: DataFrame, works: DataFrame) -> DataFrame:
    """One row per shape, without its vector: that is the vector of its first work."""
    order = works.select("work_id", "work_seq")
    facts = ("category", "n_projects", "shared", "total")
    whole = (
        shaped.select("work_id", "shape_key", *facts)
        .join(order, "work_id")
        .groupBy("shape_key")
        .agg(
            F.min(F.struct("work_seq", "work_id")).alias("first"),
            F.count("*").alias("n_works"),
            *(F.any_value(c).alias(c) for c in facts),
        )
    )
    return whole.select(
        "category",
        "shape_key",
        F.col("first.work_id").alias("shape_id"),
        F.col("first.work_seq").alias("shape_seq"),
        "n_works",
        "n_projects",
        (F.col("shared") / F.col("total")).alias("inner"),
    )


def _with_vectors(shapes: DataFrame, shaped: DataFrame) -> DataFrame:
    """``shapes`` with their vectors, which stay where they are unless there are very many."""
    vectors = shaped.select(F.col("work_id").alias("shape_id"), *VECTOR_COLUMNS)
    few = shapes.count() <= BROADCAST_SHAPES
    return vectors.join(F.broadcast(shapes) if few else shapes, "shape_id")


def _leads(shapes: DataFrame, threshold: float) -> DataFrame:
    """The terms of each shape that can be the first it has in common with a similar one.

    Terms are ordered from rare to common. Let ``rest`` be the norm of the vector behind a
    term. If two shapes reach the threshold, then at their first common term w1 * w2 +
    rest_1 * rest_2 does too (Cauchy-Schwarz), so that term lies in the lead of both: the part
    of the order up to where the remaining norm falls below the threshold.
    """
    ship_code(shapes.sparkSession)
    kind = shapes.schema["shape_id"].dataType.simpleString()
    vectors = shapes.select("shape_id", "code", _unit()["weight"].alias("weight"))
    return vectors.mapInArrow(
        lambda batches: _lead_rows(batches, threshold * threshold - SLACK),
        f"shape_id {kind}, code long, n_terms int, weight double, rest double",
    )


def _lead_rows(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch["code"].value_lengths().to_numpy(zero_copy_only=False)
        parts = []
        for weights in batch["weight"]:
            square = np.square(weights.values.to_numpy(zero_copy_only=False))
            tail = np.cumsum(square[::-1])[::-1]
            parts.append((tail >= least, np.sqrt(np.maximum(tail - square, 0.0))))
        if not parts:
            continue
        lead = pa.array(np.concatenate([p[0] for p in parts]))
        at = np.repeat(np.arange(batch.num_rows), sizes)
        columns = [
            batch["shape_id"].take(pa.array(at)),
            batch["code"].flatten(),
            pa.array(np.repeat(sizes, sizes).astype(np.int32)),
            batch["weight"].flatten(),
            pa.array(np.concatenate([p[1] for p in parts])),
        ]
        names = ["shape_id", "code", "n_terms", "weight", "rest"]
        yield pa.RecordBatch.from_arrays([c.filter(lead) for c in columns], names=names)


def _candidates(leads: DataFrame, threshold: float) -> DataFrame:
    """Pairs of shapes whose bound at a common lead term reaches the threshold.

    A term that leads many shapes has them split into blocks, and each pair of blocks
    meets in a cell of its own, so the comparisons of a hot term spread over many tasks.
    """
    crowded = leads.groupBy("code").agg(F.count("*").alias("n_leads"))
    crowded = stored(crowded.where(F.col("n_leads") > CELL_WORKS), "crowded-terms")
    cells = F.ceil(F.coalesce("n_leads", F.lit(1)) / CELL_WORKS).cast("int")
    placed = (
        attach(leads, crowded, ["code"], "n_leads", spread_by="shape_id")
        .withColumn("blocks", cells)
        .withColumn("block", F.pmod(F.xxhash64("shape_id"), F.col("blocks")).cast("int"))
    )

    def side(name: str, block: str, other: str, others: Column) -> DataFrame:
        facts = {"shape_id": name, "n_terms": f"n_{name}", "weight": f"w_{name}", "rest": f"rest_{name}"}
        renamed = [F.col(old).alias(new) for old, new in facts.items()]
        return placed.select(
            "code", *renamed, F.col("block").alias(block), F.explode(others).alias(other)
        )

    left = side("a", "row", "column", F.sequence("block", F.col("blocks") - 1))
    right = side("b", "column", "row", F.sequence(F.lit(0), "block"))
    bound = F.col("w_a") * F.col("w_b") + F.col("rest_a") * F.col("rest_b")
    once = (F.col("row") < F.col("column")) | (F.col("a") < F.col("b"))
    met = left.join(right, ["code", "row", "column"]).where(
        once & (bound >= threshold - SLACK)
    )
    first_a = F.struct("n_a", "a") < F.struct("n_b", "b")
    return met.select(
        F.when(first_a, F.col("a")).otherwise(F.col("b")).alias("short"),
        F.when(first_a, F.col("b")).otherwise(F.col("a")).alias("long"),
    ).distinct()


def _dot(left: Column, right: Column) -> Column:
    """Dot product of two vectors given as arrays of (n_works, code, weight) in their order.

    Put behind one another they are two sorted runs, which the sort merges in linear time;
    a term that both have then stands twice in a row.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("sum")
    )

    def add(so_far: Column, entry: Column) -> Column:
        product = so_far["weight"] * entry["weight"]
        same = so_far["code"] == entry["code"]
        return F.struct(
            entry["code"].alias("code"),
            entry["weight"].alias("weight"),
            (so_far["sum"] + F.when(same, product).otherwise(0.0)).alias("sum"),
        )

    merged = F.sort_array(F.concat(left, right))
    return F.aggregate(merged, start, add, lambda end: end["sum"])


def _verified(candidates: DataFrame, shaped: DataFrame, threshold: float) -> DataFrame:
    """Candidates with the cosine of their whole vectors, if it reaches the threshold.

    A candidate meets the rows of its two shapes; a shape of very many candidates is spread
    over several tasks on either side. Very many candidates are taken part by part, so that
    what is shuffled beside them at a time stays bounded.
    """
    ends = candidates.select(F.explode(F.array("short", "long")).alias("shape_id"))
    wanted = stored(
        ends.groupBy("shape_id").agg(F.count("*").alias("n_candidates")), "candidate-shapes"
    )
    parts = max(1, -(-candidates.count() // VERIFIED))
    part = F.pmod(F.xxhash64("short", "long"), F.lit(parts))
    found = None
    for number in range(parts):
        some = candidates.where(part == number) if parts > 1 else candidates
        mine = stored(_cosines(some, wanted, shaped, threshold), "cosines")
        found = mine if found is None else found.unionAll(mine)
    return found


def _cosines(
    candidates: DataFrame, wanted: DataFrame, shaped: DataFrame, threshold: float
) -> DataFrame:
    whole = _with_vectors(wanted, shaped).select("shape_id", "n_candidates", *VECTOR_COLUMNS)
    of_short = whole.toDF("short", "n_short", *(f"x_{c}" for c in VECTOR_COLUMNS))
    of_long = whole.toDF("long", "n_long", *(f"y_{c}" for c in VECTOR_COLUMNS))
    beside = attach(candidates, of_short, ["short"], "n_short", "long", "inner", small=False)
    beside = attach(beside, of_long, ["long"], "n_long", "short", "inner", small=False)
    return (
        beside.select("short", "long", _dot(_unit("x_"), _unit("y_")).alias("cosine"))
        .where(F.col("cosine") >= threshold)
    )


def _give_back(spark: SparkSession, earlier: list, *still: list) -> None:
    """Remove what was stored since ``earlier``, but for what is ``still`` read."""
    if not shared_dir(spark):  # persisted frames may not have been computed yet
        return
    read = [x for items in still for x in items]
    release(spark, [x for x in kept(spark) if not any(x is y for y in (*earlier, *read))])


def find_similar_works(
    projects: DataFrame,
    *,
    id_col: str = "project_id",
    group_col: str = "category",
    text_col: str = "work_description",
    order_col: str | None = None,
    stop_words: list[str] | None = None,
    config: ScreeningConfig = DEFAULT,
) -> SimilarWorks:
    """Compare all projects of each category by description.

    ``order_col`` tells which project of a pair comes first; the id does by default.
    Rows without a category take no part, texts without a token match nothing.
    """
    require_columns(projects, [id_col, group_col, text_col], "Table")
    threshold = config.similarity_threshold
    if not 0.0 < threshold <= 1.0:
        raise ValueError("similarity_threshold must be above 0 and at most 1")
    stop_words = STOP_WORDS if stop_words is None else stop_words
    tokenised = _tokenised(projects, id_col, group_col, text_col, order_col or id_col, stop_words)
    has_words = F.col("words_key").isNotNull()
    # what is stored on the way is removed where it is read no more
    spark = projects.sparkSession
    to_stay = kept(spark)

    def stays(df: DataFrame, name: str) -> DataFrame:
        before = kept(spark)
        df = stored(df, name)
        to_stay.extend(x for x in kept(spark) if not any(x is y for y in before))
        return df

    # texts are cut into tokens once
    tokenised = stored(tokenised, "tokenised")
    members = stays(tokenised.drop("words"), "members")
    with_texts = kept(spark)
    works = stored(_collapsed(tokenised), "works")
    of_works = [x for x in kept(spark) if not any(x is y for y in with_texts)]
    _give_back(spark, to_stay, of_works)
    sizes = stored(
        works.groupBy("category").agg(F.sum("n_projects").alias("n_docs")), "sizes"
    )
    sized = attach(
        works.where(has_words), sizes, ["category"], "n_docs", spread_by="work_id"
    )
    with_words = kept(spark)
    vectors = work_vectors(sized, threshold * threshold - SLACK)
    on_the_way = kept(spark)
    vectors = stored(_shaped(vectors), "vectors")
    of_vectors = [x for x in kept(spark) if not any(x is y for y in on_the_way)]
    _give_back(spark, with_words, of_vectors)
    has_shape = vectors.select("work_id", "shape_key")
    shapes = stays(_shapes(vectors, works), "shapes")
    known = attach(
        works.where(has_words).drop("words").join(has_shape, "work_id", "left"),
        shapes.select("shape_key", "shape_id", "n_works"),
        ["shape_key"],
        "n_works",
        spread_by="work_id",
    )
    known = stays(known.drop("shape_key", "n_works"), "shaped-works")
    _give_back(spark, to_stay, of_vectors)
    leads = _leads(_with_vectors(shapes.select("shape_id"), vectors), threshold)
    candidates = stored(_candidates(leads, threshold), "candidates")
    cosines = _verified(candidates, vectors, threshold)

    def percent(cosine: Column) -> Column:
        return round_scaled(cosine * 100, 2)

    facts = shapes.select("shape_id", "category", "shape_seq", "n_works", "n_projects")
    shape = F.struct("shape_seq", "shape_id", "n_works", "n_projects")
    one = facts.select("category", F.col("shape_id").alias("short"), shape.alias("one"))
    two = facts.select(F.col("shape_id").alias("long"), shape.alias("two"))
    both = cosines.join(one, "short").join(two, "long")
    first, second = F.least("one", "two"), F.greatest("one", "two")
    pairs = both.select("category", "cosine", first.alias("p"), second.alias("q")).select(
        "category",
        F.col("p.shape_id").alias("shape_1"),
        F.col("p.n_works").alias("works_1"),
        F.col("p.n_projects").alias("n_1"),
        F.col("q.shape_id").alias("shape_2"),
        F.col("q.n_works").alias("works_2"),
        F.col("q.n_projects").alias("n_2"),
        percent(F.col("cosine")).alias("similarity_pct"),
    )
    inner = F.when(F.col("inner") >= threshold, percent(F.col("inner")))
    pairs = stays(pairs, "shape-pairs")
    _give_back(spark, to_stay)
    return SimilarWorks(
        works=known,
        shapes=shapes.withColumn("inner_pct", inner).drop("shape_key", "inner"),
        shape_pairs=pairs,
        members=members.where(has_words),
        stop_words=stop_words,
    )


def copy_groups(similar: SimilarWorks) -> DataFrame:
    """Works of two or more projects: all their project pairs are 100 % similar."""
    n = F.col("n_projects")
    return similar.works.where(n > 1).select(
        F.col("work_id").alias("first_project"),
        "category",
        "n_projects",
        (n * (n - 1) / 2).cast("long").alias("n_pairs"),
        F.lit(100.0).alias("similarity_pct"),
    )


def pair_count(similar: SimilarWorks) -> DataFrame:
    """Number of similar project pairs, counted without listing them."""
    projects, works = F.col("n_projects"), F.col("n_works")
    within = similar.shapes.where(F.col("inner_pct").isNotNull()).select(
        (works * (works - 1) / 2 * projects * projects).cast("long").alias("n_pairs")
    )
    across = similar.shape_pairs.select(
        (F.col("works_1") * F.col("n_1") * F.col("works_2") * F.col("n_2")).alias("n_pairs")
    )
    counts = copy_groups(similar).select("n_pairs").unionByName(within).unionByName(across)
    return counts.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))


def _shape_partners(similar: SimilarWorks) -> DataFrame:
    """shape_id, similarity_pct, n: works and projects similar to each work of the shape."""
    pairs = similar.shape_pairs

    def side(mine: int, other: int) -> DataFrame:
        return pairs.select(
            F.col(f"shape_{mine}").alias("shape_id"),
            "similarity_pct",
            (F.col(f"works_{other}") * F.col(f"n_{other}")).alias("n"),
        )

    within = similar.shapes.where(F.col("inner_pct").isNotNull() & (F.col("n_works") > 1)).select(
        "shape_id",
        F.col("inner_pct").alias("similarity_pct"),
        ((F.col("n_works") - 1) * F.col("n_projects")).alias("n"),
    )
    return side(1, 2).unionByName(side(2, 1)).unionByName(within)


def work_signals(similar: SimilarWorks) -> DataFrame:
    """Strongest similarity and number of partners of a project, one row per work.

    A project is paired with every other copy of its own work and with every project
    of a similar work. All works of a shape have the same partners outside.
    """
    of_shape = _shape_partners(similar).groupBy("shape_id").agg(
        F.max("similarity_pct").alias("strongest"), F.sum("n").alias("n")
    )
    sizes = similar.shapes.select("shape_id", "n_works")
    of_shape = stored(of_shape.join(sizes, "shape_id"), "shape-signals")
    beside = attach(similar.works, of_shape, ["shape_id"], "n_works", spread_by="work_id")
    copies = F.col("n_projects") - 1
    return beside.where(F.col("strongest").isNotNull() | (copies > 0)).select(
        "category",
        "words_key",
        F.when(copies > 0, 100.0).otherwise(F.col("strongest")).alias("max_similarity_pct"),
        (F.coalesce("n", F.lit(0)) + copies).alias("similar_project_count"),
        F.lit(True).alias("duplicate_signal"),
        "n_projects",
    )


def similar_classes(similar: SimilarWorks) -> DataFrame:
    """Classes of projects that similarity links, directly or through others.

    One row per class: category, class_id (its first project in order), n_works, n_projects,
    n_links (similar project pairs within it) and strongest_pct. A class is grown from shapes
    and their pairs, so its row count and its cost follow the shapes, not the pairs.
    """
    works, projects = F.col("n_works"), F.col("n_projects")
    placed = _class_of_shapes(similar)
    linked = placed.where(F.col("shape_class").isNotNull())
    pairs_of_works = F.when(F.col("inner_pct").isNotNull(), works * (works - 1) / 2).otherwise(0)
    copies = works * projects * (projects - 1) / 2
    within = linked.select(
        "category",
        F.col("shape_class").alias("class"),
        F.struct("shape_seq", "shape_id").alias("first"),
        works.alias("works"),
        (works * projects).alias("projects"),
        (pairs_of_works * projects * projects + copies).cast("long").alias("links"),
        F.when(projects > 1, 100.0)
        .when(works > 1, F.col("inner_pct"))
        .alias("strongest"),
    )
    none = F.lit(None)
    across = similar.shape_pairs.select(
        "category",
        F.col("shape_1").alias("shape_id"),
        (F.col("works_1") * F.col("works_2") * F.col("n_1") * F.col("n_2")).alias("links"),
        F.col("similarity_pct").alias("strongest"),
    ).join(linked.select("shape_id", F.col("shape_class").alias("class")), "shape_id")
    across = across.select(
        "category",
        "class",
        none.cast(within.schema["first"].dataType).alias("first"),
        F.lit(0).cast("long").alias("works"),
        F.lit(0).cast("long").alias("projects"),
        "links",
        "strongest",
    )
    of_shapes = within.unionByName(across).groupBy("category", "class").agg(
        F.min("first").alias("first"),
        *(F.sum(c).alias(c) for c in ("works", "projects", "links")),
        F.max("strongest").alias("strongest"),
    )
    joined = of_shapes.select(
        "category",
        F.col("first.shape_id").alias("class_id"),
        F.col("works").alias("n_works"),
        F.col("projects").alias("n_projects"),
        F.col("links").alias("n_links"),
        F.col("strongest").alias("strongest_pct"),
    )
    alone = _copies_alone(similar, placed).select(
        "category",
        F.col("work_id").alias("class_id"),
        F.lit(1).cast("long").alias("n_works"),
        "n_projects",
        (projects * (projects - 1) / 2).cast("long").alias("n_links"),
        F.lit(100.0).alias("strongest_pct"),
    )
    return joined.unionByName(alone)


def _class_of_shapes(similar: SimilarWorks) -> DataFrame:
    """Shapes with shape_class, the smallest shape they are linked to; NULL if with none.

    All works of a shape lie in one class if they are similar to each other or all similar
    to works of another shape.
    """
    found = components(similar.shape_pairs, "shape_1", "shape_2")
    roots = found.toDF("shape_id", "linked_class")
    itself = F.when(F.col("inner_pct").isNotNull() & (F.col("n_works") > 1), F.col("shape_id"))
    placed = similar.shapes.join(roots, "shape_id", "left")
    return stored(
        placed.withColumn("shape_class", F.coalesce("linked_class", itself)).drop("linked_class"),
        "shape-classes",
    )


def _copies_alone(similar: SimilarWorks, placed: DataFrame) -> DataFrame:
    """Works of two or more projects that are similar to no other work."""
    linked = placed.where(F.col("shape_class").isNotNull()).select("shape_id", "n_works", "shape_class")
    beside = attach(similar.works, linked, ["shape_id"], "n_works", spread_by="work_id")
    return beside.where((F.col("n_projects") > 1) & F.col("shape_class").isNull())


def class_members(similar: SimilarWorks) -> DataFrame:
    """project_id, category, class_id of every project that is similar to another one."""
    placed = _class_of_shapes(similar)
    linked = placed.where(F.col("shape_class").isNotNull())
    first = linked.groupBy("shape_class").agg(F.min(F.struct("shape_seq", "shape_id")).alias("first"))
    ids = linked.join(first, "shape_class").select(
        "shape_id", "n_works", F.col("first.shape_id").alias("class_id")
    )
    beside = attach(similar.works, stored(ids, "class-ids"), ["shape_id"], "n_works", "work_id")
    own = F.when(F.col("n_projects") > 1, F.col("work_id"))
    of_work = beside.withColumn("class_id", F.coalesce("class_id", own)).where("class_id is not null")
    of_work = of_work.select("category", "words_key", "class_id", "n_projects")
    return (
        attach(
            similar.members,
            stored(of_work, "work-classes"),
            ["category", "words_key"],
            "n_projects",
            spread_by="project_id",
            how="inner",
        ).select("project_id", "category", "class_id")
    )


def project_signals(similar: SimilarWorks) -> DataFrame:
    """Signal rows of all projects that have a similar one."""
    signals = stored(work_signals(similar), "work-signals")
    return (
        attach(
            similar.members,
            signals,
            ["category", "words_key"],
            "n_projects",
            spread_by="project_id",
        )
        .where(F.col("duplicate_signal"))
        .select(
            "project_id",
            "max_similarity_pct",
            "similar_project_count",
            "duplicate_signal",
        )
    )


def _work_members(similar: SimilarWorks, works: DataFrame) -> DataFrame:
    """Projects of the given works (category, words_key, work_id, n_projects)."""
    return (
        attach(
            similar.members,
            works,
            ["category", "words_key"],
            "n_projects",
            spread_by="project_id",
        )
        .where(F.col("work_id").isNotNull())
        .select("work_id", "n_projects", "project_id", "seq")
    )


def _described(pairs: DataFrame, projects: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs with the original texts of both projects, by one pass over the projects."""
    ends = pairs.select(
        *pairs.columns,
        F.posexplode(F.array("project_1", "project_2")).alias("side", "project_id"),
    )
    texts = projects.select(
        F.col(id_col).alias("project_id"), F.col(text_col).alias("text")
    )

    def side_text(side: int) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("text")))

    return (
        ends.join(texts, "project_id")
        .groupBy(*pairs.columns)
        .agg(side_text(0).alias("description_1"), side_text(1).alias("description_2"))
    )


def described_pairs(
    similar: SimilarWorks,
    projects: DataFrame,
    *,
    id_col: str = "project_id",
    text_col: str = "work_description",
) -> DataFrame:
    """All pairs of similar works, each by its first projects and with both descriptions.

    Columns as in PAIR_SCHEMA; texts are joined to the pairs found, not to candidates.
    """
    pairs = similar.pairs.select(
        F.col("work_1").alias("project_1"),
        F.col("work_2").alias("project_2"),
        "category",
        "similarity_pct",
    )
    return _described(pairs, projects, id_col, text_col).select(*PAIR_SCHEMA.names)


def _oriented_pairs(met: DataFrame) -> DataFrame:
    """Rows of two projects p and q (struct of seq, project_id), the earlier one first."""
    first, second = F.least("p", "q"), F.greatest("p", "q")
    return met.select(
        first["project_id"].alias("project_1"),
        second["project_id"].alias("project_2"),
        "category",
        "similarity_pct",
        first["seq"].alias("seq_1"),
        second["seq"].alias("seq_2"),
    )


def _report_order() -> list[Column]:
    return [F.desc("similarity_pct"), F.col("category"), F.col("seq_1"), F.col("seq_2")]


def _first_work_pairs(similar: SimilarWorks, k: int) -> DataFrame:
    """Pairs of works that hold the first k of the report order, listed from few works.

    Only pairs at or above the k-th highest similarity can be among them, and of two shapes
    only the first k + 1 works of each: k pairs with an earlier work come before any other.
    """
    inner = F.col("inner_pct").isNotNull() & (F.col("n_works") > 1)
    levels = similar.shape_pairs.select("similarity_pct").unionByName(
        similar.shapes.where(inner).select(F.col("inner_pct").alias("similarity_pct"))
    )
    least = levels.orderBy(F.desc("similarity_pct")).limit(k).agg(F.min("similarity_pct").alias("least"))
    pairs = similar.shape_pairs.join(F.broadcast(least), F.col("similarity_pct") >= F.col("least"))
    shapes = similar.shapes.where(inner).join(F.broadcast(least), F.col("inner_pct") >= F.col("least"))
    wanted = (
        pairs.select(F.explode(F.array("shape_1", "shape_2")).alias("shape_id"))
        .unionByName(shapes.select("shape_id"))
        .distinct()
    )
    by_order = W.partitionBy("shape_id").orderBy("work_seq", "work_id")
    first = (
        similar.works.join(wanted, "shape_id")
        .withColumn("place", F.row_number().over(by_order))
        .where(F.col("place") <= k + 1)
    )
    return _listed_pairs(stored(first, "first-works"), pairs, shapes)


def top_pairs(
    similar: SimilarWorks,
    projects: DataFrame,
    *,
    k: int = 20,
    id_col: str = "project_id",
    text_col: str = "work_description",
) -> DataFrame:
    """The k most similar project pairs, ties by category and project order.

    Exact without listing all pairs: the first k pairs come from the first k groups of
    copies and the first k pairs of works, and use only the first k + 1 projects of each;
    the pairs of works come from the first works of the most similar shapes.
    """
    copies = (
        similar.works.where(F.col("n_projects") > 1)
        .select(
            "category",
            F.col("work_id").alias("work_1"),
            F.col("work_id").alias("work_2"),
            F.lit(100.0).alias("similarity_pct"),
            F.col("work_seq").alias("seq_1"),
            F.col("work_seq").alias("seq_2"),
        )
        .orderBy(*_report_order())
        .limit(k)
    )
    distinct_works = _first_work_pairs(similar, k).select(*copies.columns)
    distinct_works = distinct_works.orderBy(*_report_order()).limit(k)
    entries = copies.unionByName(distinct_works).drop("seq_1", "seq_2")
    entries = stored(entries, "top-entries")  # at most 2 * k rows
    wanted = entries.select(F.explode(F.array("work_1", "work_2")).alias("work_id"))
    works = stored(
        similar.works.join(F.broadcast(wanted.distinct()), "work_id").select(
            "category", "words_key", "work_id", "n_projects"
        ),
        "top-works",
    )
    by_order = W.partitionBy("work_id").orderBy("seq")
    first_members = (
        _work_members(similar, works)
        .withColumn("place", F.row_number().over(by_order))
        .where(F.col("place") <= k + 1)
        .select("work_id", F.struct("seq", "project_id").alias("member"))
    )
    first_members = stored(first_members, "top-members")  # at most 4 * k * (k + 1) rows
    p = first_members.select(F.col("work_id").alias("work_1"), F.col("member").alias("p"))
    q = first_members.select(F.col("work_id").alias("work_2"), F.col("member").alias("q"))
    met = (
        entries.join(p, "work_1")
        .join(q, "work_2")
        .where((F.col("work_1") != F.col("work_2")) | (F.col("p") < F.col("q")))
    )
    top = _oriented_pairs(met).orderBy(*_report_order()).limit(k)
    return (
        _described(F.broadcast(top), projects, id_col, text_col)
        .orderBy(*_report_order())
        .drop("seq_1", "seq_2")
    )


def pair_signals(pairs: DataFrame) -> DataFrame:
    """The same signals from an explicit table of project pairs."""
    ends = pairs.select(
        F.explode(F.array("project_1", "project_2")).alias("project_id"),
        "similarity_pct",
    )
    return ends.groupBy("project_id").agg(
        F.max("similarity_pct").alias("max_similarity_pct"),
        F.count("*").alias("similar_project_count"),
        F.lit(True).alias("duplicate_signal"),
    )
