"""Near-identical titles: an exact similarity join that never pairs up a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultloom.functions.similarity import WordSets, common_length
from resultloom.functions.text import title_words
from resultloom.operators.components import components
from resultloom.operators.letters import letter_matches
from resultloom.operators.skew import lookup
from resultloom.runtime import materialize

# What may match fuzzily, and when.
FUZZY_TYPES = ("news", "social")
MIN_WORDS = 3
THRESHOLD = 0.90
MAX_GAP_DAYS = 7

SCOPE = ("search_id", "source_type")

# A search and type of up to this many word sets is compared within itself: its few comparisons
# cost less than keys and blocks, unless many of its titles are of one length.
SMALL_SCOPE = 8

# Up to this many candidates by words a title, on average, are listed; for more, groups are linked in steps.
LISTED = 64


def admissible(rows: DataFrame) -> DataFrame:
    """Rows whose title may match fuzzily, with their sorted distinct words.

    The word count is that of the title, repeats included.
    """
    spoken = F.size(F.filter(F.split("norm_title", " "), lambda w: w != ""))
    return rows.filter(F.col("source_type").isin(*FUZZY_TYPES) & (spoken >= MIN_WORDS)).withColumn(
        "words", title_words(F.col("norm_title"))
    )


def with_word_key(rows: DataFrame) -> DataFrame:
    """Add a key shared by all titles of a search and type with the same words."""
    key = F.md5(F.concat_ws("\x1f", *SCOPE, F.array_join("words", " ")))
    return rows.withColumn("word_key", key)


def _probes_and_index(titles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Words a title looks others up by, and words it is found under.

    ``titles`` has word_key, scope, words, length. With e = 1 - threshold, a pair can match in two
    ways. By letters: see ``letter_matches``. By words: a side of joined length a is all but contained
    in the other, so its rest (plus a space) is at most 2e/(1+e) of a, and its rarest words
    adding up to more than that, a space each, cannot all be missing. These it probes; ``n``
    is how many titles a word leads to.
    """
    e = 1.0 - threshold + 1e-12
    index = titles.select("word_key", "scope", "length", F.explode("words").alias("word")).select(
        F.xxhash64("scope", "word").alias("key"), "word_key", "length", (F.length("word") + 1).alias("size")
    )
    counts = index.groupBy("key").agg(F.count("*").alias("n"))
    before = Window.partitionBy("word_key").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)
    probes = (
        lookup(index, counts, ["key"])
        .withColumn("taken", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .filter((F.col("n") > 1) & (F.col("taken") <= 2 * e / (1 + e) * F.col("length")))
        .select("key", F.col("word_key").alias("left_key"), "n")
    )
    return materialize(probes, "probes"), index.select("key", F.col("word_key").alias("right_key"))


def _with_sides(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    return pairs.join(_side(titles, "a"), "key_a").join(_side(titles, "b"), ["key_b", *SCOPE])


def _word_pairs(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of titles of which one is found under a word the other probes."""
    return (
        probes.join(index, "key")
        .filter(F.col("left_key") != F.col("right_key"))
        .select(
            F.least("left_key", "right_key").alias("key_a"),
            F.greatest("left_key", "right_key").alias("key_b"),
        )
        .distinct()
    )


def _letter_pairs(titles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of titles that match by their letters."""
    found = letter_matches(titles.withColumnRenamed("title_no", "item"), threshold)
    for end, name in (("a", "key_a"), ("b", "key_b")):
        found = found.join(titles.select(F.col("title_no").alias(end), F.col("word_key").alias(name)), end)
    return found.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))


def _side(titles: DataFrame, name: str) -> DataFrame:
    return titles.select(
        *SCOPE,
        F.col("word_key").alias(f"key_{name}"),
        F.col("words").alias(f"words_{name}"),
        F.col("length").alias(f"length_{name}"),
    )


def _direct_pairs(titles: DataFrame) -> DataFrame:
    """Partners within a search and type of at most ``SMALL_SCOPE`` word sets.

    Comparing costs far more than its input weighs, so the number of tasks is the
    session's own, not one merged down to the size of the input.
    """
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = titles.repartition(tasks, *SCOPE)
    pairs = _side(spread, "a").join(_side(titles, "b"), list(SCOPE))
    return pairs.filter(F.col("key_a") < F.col("key_b"))


def _titles(rows: DataFrame, threshold: float, small_scope: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Distinct word sets of searches and types that have few of them, and of those that have many; none if there are none."""
    if not 0.7 <= threshold <= 1.0:
        raise ValueError("the candidate keys are complete for thresholds of 0.7 to 1.0")
    distinct = materialize(
        rows.groupBy("word_key")
        .agg(
            F.first("search_id").alias("search_id"),
            F.first("source_type").alias("source_type"),
            F.first("words").alias("words"),
        )
        .withColumn("length", F.length(F.array_join("words", " ")))
        .withColumn("scope", F.xxhash64(*SCOPE)),
        "titles",
    )
    sizes = distinct.groupBy(*SCOPE).agg(F.count("*").alias("_size"))
    titles = lookup(distinct, sizes, SCOPE)
    least, most = sizes.agg(F.min("_size"), F.max("_size")).first()
    few = titles.filter(F.col("_size") <= small_scope).drop("_size") if least is None or least <= small_scope else None
    if most is None or most <= small_scope:
        return few, None
    large = titles.filter(F.col("_size") > small_scope).drop("_size")
    large = large.withColumn("text", F.array_join("words", " ")).withColumn("title_no", F.monotonically_increasing_id())
    return few, materialize(large, "large")


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the candidate pairs that score ``threshold`` or more."""
    sets = WordSets(F.col("words_a"), F.col("words_b"))
    cutoff = threshold * 100
    hopeful = pairs.filter(
        WordSets.reachable(
            F.col("words_a"), F.col("words_b"), F.col("length_a"), F.col("length_b")
        )
        >= cutoff
    )
    undecided = ~sets.contained
    common = common_length(F.when(undecided, sets.rest_a), F.when(undecided, sets.rest_b))
    return (
        hopeful.withColumn("common", common)
        .withColumn("score", sets.score(F.col("common")))
        .filter(F.col("score") >= cutoff)
        .select(*SCOPE, "key_a", "key_b", "score")
    )


def title_matches(
    rows: DataFrame, threshold: float = THRESHOLD, *, small_scope: int = SMALL_SCOPE
) -> DataFrame:
    """Pairs of different word sets of one search and type that score ``threshold`` or more.

    ``rows`` carries word_key and words (see ``admissible`` and ``with_word_key``).
    Copies collapse to one row first. Where a search and type has few word sets,
    measured here, each meets the others; elsewhere candidates share a rare word or
    match by their letters. Both find every match, and what word lengths already rule out never
    reaches the character comparison.
    """
    few, many = _titles(rows, threshold, small_scope)
    pairs = [] if few is None else [_direct_pairs(few)]
    if many is not None:
        near = _word_pairs(*_probes_and_index(many, threshold)).unionByName(_letter_pairs(many, threshold)).distinct()
        pairs.append(_with_sides(materialize(near, "near"), many))
    return _scored(reduce(DataFrame.unionByName, pairs), threshold)


def fuzzy_links(
    rows: DataFrame, cells: DataFrame, threshold: float = THRESHOLD, max_gap_days: float = MAX_GAP_DAYS,
    *, small_scope: int = SMALL_SCOPE,
) -> DataFrame:
    """Links (a, b) between time cells that connect the same cells as all matches close in time do.

    Groups need no list of pairs. Within a small search and type all pairs are compared. In a
    large one, matches by letters come from blocks, each of which returns only links that
    connect it. Candidates by words are counted: a few are compared as they are; many, as of
    thousands of titles near each other, in steps. Every cell that a word leads to first meets the least cell
    of that word and time; then, for each two components that share a word, one cell of each
    meets; and only cells that are in different components after both meet all the others of
    the word. The last step makes it exact, the first two leave it little to do.
    """
    few, many = _titles(rows, threshold, small_scope)
    if many is None:
        return materialize(cell_links(cells, _scored(_direct_pairs(few), threshold), max_gap_days), "links")
    gap = int(max_gap_days * 86_400_000_000)
    node = cells.join(many.select("word_key", "scope", "text", "length"), "word_key")
    items = materialize(
        node.select("scope", "cell_key", "text", "length", "first", "last").withColumn("item", F.monotonically_increasing_id()), "items"
    )
    near = letter_matches(items, threshold, gap)
    for end in ("a", "b"):
        near = near.join(items.select(F.col("item").alias(end), F.col("cell_key").alias(f"{end}_key")), end).drop(end)
    near = near.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))

    probes, index = _probes_and_index(many, threshold)
    asked = probes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("left_key")).first()
    listed = asked[0] <= LISTED * asked[1]
    pairs = [] if few is None else [_direct_pairs(few)]
    if listed:
        pairs.append(_with_sides(materialize(_word_pairs(probes, index), "pairs"), many))
    if pairs:
        found = cell_links(cells, _scored(reduce(DataFrame.unionByName, pairs), threshold), max_gap_days)
    else:
        found = _within_set(cells, gap)
    links = materialize(found.unionByName(near).distinct(), "links")
    if listed:
        return links
    node = node.select("word_key", "cell", "cell_key", "first", "last")
    probes, index = probes.drop("n"), index.join(probes.select("key").distinct(), "key", "leftsemi")

    def placed(keys: DataFrame, name: str) -> DataFrame:
        own = keys.withColumnRenamed(name, "word_key")
        return materialize(own.join(node, "word_key").distinct(), name)

    probes, index = placed(probes, "left_key"), placed(index, "right_key")

    def known(frame: DataFrame, found: DataFrame) -> DataFrame:
        labels = components(found).withColumnRenamed("node", "cell_key")
        return lookup(frame, labels, ["cell_key"], how="left").withColumn("component", F.coalesce("component", "cell_key"))

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("word_key", "cell", "cell_key", "first", "last", "component")])

    def met(left: DataFrame, right: DataFrame, *, one_each: bool) -> DataFrame:
        """Links of the cells that share a key, are close in time and in different components."""
        close = (F.col("first_r") - F.col("last_l") <= gap) & (F.col("first_l") - F.col("last_r") <= gap)
        pairs = side(left, "l").join(side(right, "r"), "key").filter(
            (F.col("component_l") != F.col("component_r")) & (F.col("word_key_l") != F.col("word_key_r"))
            & (F.col("cell_l").isNull() | F.col("cell_r").isNull() | close)
        )
        turn = F.col("word_key_l") < F.col("word_key_r")
        pairs = pairs.select(
            F.least("component_l", "component_r").alias("x"), F.greatest("component_l", "component_r").alias("y"),
            F.least("word_key_l", "word_key_r").alias("key_a"), F.greatest("word_key_l", "word_key_r").alias("key_b"),
            F.when(turn, F.col("cell_key_l")).otherwise(F.col("cell_key_r")).alias("a"),
            F.when(turn, F.col("cell_key_r")).otherwise(F.col("cell_key_l")).alias("b"),
        )
        if one_each:
            pairs = pairs.groupBy("x", "y").agg(F.min(F.struct("key_a", "key_b", "a", "b")).alias("p")).select("p.*")
        pairs = materialize(pairs.select("key_a", "key_b", "a", "b").distinct(), "met")
        right_ones = _scored(_with_sides(pairs.select("key_a", "key_b").distinct(), many), threshold)
        return materialize(pairs.join(right_ones.select("key_a", "key_b"), ["key_a", "key_b"]).select("a", "b").distinct(), "links")

    left, right = known(probes, links), known(index, links)
    first = right.groupBy("key", "cell").agg(F.min(F.struct("cell_key", "word_key", "first", "last", "component")).alias("l"))
    links = links.unionByName(met(left, first.select("key", "cell", "l.*"), one_each=False))

    def one_of_each(frame: DataFrame) -> DataFrame:
        best = frame.groupBy("key", "component").agg(F.min(F.struct("cell_key", "word_key", "cell", "first", "last")).alias("l"))
        return best.select("key", "component", "l.*")

    left, right = known(probes, links), known(index, links)
    links = links.unionByName(met(one_of_each(left), one_of_each(right), one_each=True))
    left, right = known(probes, links), known(index, links)
    return links.unionByName(met(left, right, one_each=False))


def spans(rows: DataFrame, max_gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """Fold rows of a word set into time cells as long as the allowed gap.

    Rows of one cell are all close enough in time; two cells of a set or of two
    sets hold a close pair only if they are the same or adjacent and the nearest
    edges are, or if one has no time. So cells carry the rule for every pair of
    rows without naming a pair.
    """
    gap = int(max_gap_days * 86_400_000_000)
    micros = F.unix_micros("published_at")
    return (
        rows.withColumn("cell", F.floor(micros / gap))
        .withColumn("_t", micros)
        .groupBy(*SCOPE, "word_key", "cell")
        .agg(
            F.count("*").alias("n"),
            F.min("_t").alias("first"),
            F.max("_t").alias("last"),
            F.min("node").alias("node"),
        )
        .withColumn("cell_key", F.concat_ws("@", "word_key", F.coalesce(F.col("cell").cast("string"), F.lit("?"))))
    )


def _within_set(cells: DataFrame, gap: int) -> DataFrame:
    """Links between cells of one word set: neighbours in time, and the timeless with all."""
    order = Window.partitionBy("word_key").orderBy(F.col("cell").asc_nulls_last())
    step = cells.select(
        "word_key",
        "cell",
        F.col("cell_key").alias("a"),
        F.lead("cell_key").over(order).alias("b"),
        "last",
        F.lead("first").over(order).alias("next_first"),
        F.lead("cell").over(order).isNull().alias("next_timeless"),
    )
    near = step.filter(
        F.col("b").isNotNull()
        & (F.col("next_timeless") | (F.col("next_first") - F.col("last") <= gap))
    ).select("a", "b")
    timeless = cells.filter(F.col("cell").isNull()).select("word_key", F.col("cell_key").alias("a"))
    others = cells.filter(F.col("cell").isNotNull()).select(
        "word_key", F.col("cell_key").alias("b")
    )
    return near.unionByName(others.join(timeless, "word_key").select("a", "b")).distinct()


def cell_links(
    cells: DataFrame, matches: DataFrame, max_gap_days: float = MAX_GAP_DAYS
) -> DataFrame:
    """Links (a, b) between cells that hold a pair close in title and time."""
    gap = int(max_gap_days * 86_400_000_000)
    left = cells.select(
        F.col("word_key").alias("key_a"),
        F.col("cell").alias("cell_a"),
        F.col("cell_key").alias("a"),
        F.col("first").alias("first_a"),
        F.col("last").alias("last_a"),
    )
    right = cells.select(
        F.col("word_key").alias("key_b"),
        F.col("cell").alias("cell_b"),
        F.col("cell_key").alias("b"),
        F.col("first").alias("first_b"),
        F.col("last").alias("last_b"),
    )
    sided = matches.select("key_a", "key_b").join(left, "key_a")
    timed = (
        sided.filter(F.col("cell_a").isNotNull())
        .withColumn("cell_b", F.explode(F.array(*[F.col("cell_a") + d for d in (-1, 0, 1)])))
        .join(right, ["key_b", "cell_b"])
        .filter(
            (F.col("first_b") - F.col("last_a") <= gap) & (F.col("first_a") - F.col("last_b") <= gap)
        )
        .select("a", "b")
    )
    left_open = (
        sided.filter(F.col("cell_a").isNull()).join(right, "key_b").select("a", "b")
    )
    right_open = (
        sided.filter(F.col("cell_a").isNotNull())
        .join(right.filter(F.col("cell_b").isNull()), "key_b")
        .select("a", "b")
    )
    across = timed.unionByName(left_open).unionByName(right_open)
    return _within_set(cells, gap).unionByName(across).distinct()
