"""Mixing of sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultloom.runtime import materialize

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
# Words of the mix, as a share of all words.
SHARE = 1.5
# Most epochs of one source.
EPOCHS = 2
# Rows of a source that one sorted slice holds on average.
SLICE_ROWS = 2_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality in [0.1, 1]: how much of a text is not signs, digits or white space."""
    signs = F.length(text) - F.length(F.translate(text, "0123456789 \n\t#$%&*@_=+<>|~^{}[]\\/", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - signs / F.nullif(F.length(text), F.lit(0))), F.lit(0.1))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS
) -> DataFrame:
    """(source, source_size, rows, _mean, target): words each source gives to the mix.

    ``sizes`` has one row per source with its size, rows and mean quality. Weights go to the sources by code point, null
    last. A source gives at most ``epochs`` times its size; what that leaves over goes
    to the others by weight, again and again: sources reach their caps in order of
    cap per weight, so one pass in that order finds the same level.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    # Sources without a word give none and hold no weight.
    live = F.when(F.col("source_size") > 0, F.col("_weight")).otherwise(0.0)
    rise = Window.orderBy(
        F.when(F.col("source_size") > 0, F.col("_cap") / F.col("_weight")).asc_nulls_first(), F.col("source").asc_nulls_last()
    )
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = capped.withColumn("_live", live).select(
        "source", "source_size", "rows", "_mean", "_live", "_cap",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        (F.sum("_live").over(whole) - F.coalesce(F.sum("_live").over(before), F.lit(0.0))).alias("_weights"),
    )
    # The first source in the order that its cap does not bind has the level of all later ones too.
    level = F.when(F.col("_live") > 0, F.col("_left") / F.col("_weights"))
    free = F.when((F.col("_live") > 0) & (F.col("_live") * level < F.col("_cap")), level)
    steps = steps.withColumn("_level", F.max(free).over(whole))
    return steps.select(
        "source", "source_size", "rows", "_mean",
        F.when(F.col("_live") > 0, F.least(F.col("_cap"), F.coalesce(F.col("_live") * F.col("_level"), F.col("_cap"))))
        .otherwise(0.0).alias("target"),
    )


def _decided(
    docs: DataFrame, size: Column | None, quality: Column | None, weights: Sequence[float], share: float,
    epochs: float, seed: str, slice_rows: int, keep: Sequence[str] = (),
) -> DataFrame:
    """Sizes, targets and copies of each row, and the columns of ``keep`` as the struct ``row``."""
    size = word_count(F.col("text")) if size is None else size
    quality = letter_share(F.col("text")) if quality is None else quality
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    good = F.when((quality > 1e-6) & ~F.isnan(quality), quality).otherwise(F.lit(1e-6))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.struct(*[docs[c] for c in keep]).alias("row") if keep else F.lit(False).alias("row"),
        size.cast("long").alias("size"), good.alias("_good"), F.xxhash64("text").alias("_text"),
    ).withColumn("_key", -F.log(u) / F.col("_good"))
    if not keep:
        # Narrow rows are written once, so that texts are read and counted once.
        rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.avg("_good").alias("_mean")
    )
    targets = source_targets(sizes, weights, share, epochs)
    rest = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    targets = targets.select(
        F.col("source").alias("_source"), "source_size", "target", "_mean",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_epochs"),
        F.when(F.col("source_size") > 0, rest).otherwise(0.0).alias("_rest"),
        (1 + F.floor(F.col("rows") / slice_rows)).cast("long").alias("_slices"),
    )
    # One row per source: Spark broadcasts it while its measured size is under the threshold.
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        # An exponential key over its mean, as 1 - exp(-key), is spread evenly.
        "_slice", F.floor((1 - F.exp(-F.col("_key") * F.col("_mean"))) * F.col("_slices")).cast("long")
    )
    sums = placed.groupBy("_source", "_slice", "_rest").agg(F.sum("size").alias("_words"))
    up_to = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(up_to), F.lit(0)))
    last = sums.filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
    last = last.select(F.col("_source").alias("_in"), F.col("_slice").alias("_last"), "_before")
    marked = placed.join(last, F.col("_source").eqNullSafe(F.col("_in")), "left")
    # Sources that end in a slice: its rows are sorted; of the others no row is left for the rest.
    ending = F.col("_slice") == F.col("_last")
    order = Window.partitionBy("_source", F.when(ending, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))).orderBy(
        "_key", "doc_id", "size", "_text"
    )
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = (
        F.when(F.col("_last").isNull(), F.lit(0))
        .when(F.col("_slice") < F.col("_last"), F.lit(1))
        .when(ending & (F.col("_before") + F.coalesce(inside, F.lit(0)) + F.col("size") / 2 <= F.col("_rest")), F.lit(1))
        .otherwise(F.lit(0))
    )
    copies = F.when(F.col("size") > 0, F.col("_epochs") + part).otherwise(0).cast("long")
    return marked.select("doc_id", "row", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"))


def mix(
    docs: DataFrame, *, size: Column | None = None, quality: Column | None = None, weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, epochs: float = EPOCHS, seed: str = "mix", slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """How many words of each document the mix takes (Efraimidis and Spirakis, 2006).

    ``docs`` has doc_id, text and source; other columns are ignored. A document's key is
    -ln(u) / quality, with u in (0, 1) drawn from an MD5 of seed and id, so reruns agree. A
    source whose target is k times its size and a rest gives every document k times; for the
    rest its documents are taken in order of key while that brings their words nearer to it.
    Returns doc_id, size, source_size, target, copies and taken, the words of all copies.

    Ties of keys go by id, size and text. Texts that are null or blank have size 0 and are not
    taken, a source of such only has target 0. A null source is a source. Quality below 1e-6,
    null or NaN counts as 1e-6. Only the slice of keys in which a source's budget ends is sorted,
    and a slice holds about ``slice_rows`` rows; all others are decided from slice sums.
    """
    done = _decided(docs, size, quality, weights, share, epochs, seed, slice_rows)
    return done.drop("row").withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its ``mix_epoch`` from 1.

    Options are those of ``mix``. A column mix_epoch of the input is replaced.
    """
    defaults = {"size": None, "quality": None, "weights": WEIGHTS, "share": SHARE, "epochs": EPOCHS, "slice_rows": SLICE_ROWS}
    columns = [c for c in docs.columns if c != "mix_epoch"]
    done = _decided(docs, **{**defaults, **options}, seed=seed, keep=columns).filter("copies > 0")
    done = done.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return done.select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("epoch").alias("mix_epoch"))
