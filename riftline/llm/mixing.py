"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Sizes are words.  A source's target is its weighted share of all words, but at most ``most`` times its size;
what is above is shared again by weight among the others.  Whole copies first: every document is taken
floor(target / source size) times.  The remaining budget is met by a hash threshold: the words of a source are
summed by hash bucket, the cumulated sums show the bucket in which the budget ends, and only that bucket's
documents are split into finer buckets, level by level.  Documents below the threshold are taken once more; no
level sorts documents, and a lower budget's documents are always among a higher one's.

At the last level one hash value is left.  A single document there is taken if that brings the source nearer
to its target; several rows with one hash (repeated rows) share the rest of the budget in proportion to size.

Edge cases: null text has size 0; the null source comes last and is a source like any other; documents of
size 0 take nothing; an empty table gives an empty result; ties are settled by the hash of id and text only,
so reruns agree; a null id stays null and is hashed like any other; only id, text and source are read, so other columns
may have any name (``mixed_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Bits of the hash that each level of histograms looks at; together the thresholds are 48 bits fine.
LEVELS = (12, 12, 12, 12)
WEIGHTS = (1, 2, 3)
#: Tables with a row per source are broadcast up to so many sources; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target.  With one row per source, the windows here are as long as the list of sources.

    Sources reach their limit in the order of limit / weight, so the level at which the rest is shared
    is found from running sums in that order.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (named % len(weights) + 1).cast("int")).cast("double")
    limited = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, from_here, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    leveled = limited.withColumn("level", level)
    shared = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return leveled.withColumn("shared", shared).select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("shared") * F.col("weight"), F.col("limit"))).alias("target"))


def _columns(id_column: str, text_column: str, source_column: str) -> list[Column]:
    """doc_id, source, size and hash of a document, from columns of any name."""
    id_, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    return [id_.alias("doc_id"), F.col(f"`{source_column}`").alias("source"), words(text).alias("size"), F.xxhash64(id_.cast("string"), text).alias("hash")]


def budget_ends(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> tuple[DataFrame, bool]:
    """For each source s: source_size, target, whole copies, and the hash prefix in which the rest ends; whether it is small.

    sizes: settled rows of source, size and hash.
    """
    targets = settled(source_targets(sizes, weights, most))
    small = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda t: t
    budgets = targets.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
    ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))

    # `below`: words of the source under the threshold so far; `prefix`: the bucket in which the budget ends.
    state = budgets.select("s", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    shift = 64
    for bits in LEVELS:
        shift -= bits
        bucket = F.shiftrightunsigned("hash", shift)
        coarser = F.shiftrightunsigned("hash", shift + bits) if shift + bits < 64 else F.lit(0).cast("long")
        inside = sizes.join(small(state), F.col("source").eqNullSafe(F.col("s")) & (coarser == F.col("prefix")))
        sums = inside.groupBy("s", "rest", "below", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        cumulated = sums.withColumn("under", F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        reached = cumulated.where(F.col("under") <= F.col("rest")).groupBy("s", "rest").agg(F.max_by(F.struct(F.col("under").alias("below"), F.col("bucket").alias("prefix"), "words"), "bucket").alias("x"))
        state = settled(reached.select("s", "rest", "x.below", "x.prefix", "x.words"))

    ends = state.select(F.col("s").alias("e"), "below", "prefix", F.col("words").alias("edge_words"))
    single = sizes.join(small(ends), F.col("source").eqNullSafe(F.col("e")) & (F.shiftrightunsigned("hash", shift) == F.col("prefix"))).groupBy("e").agg(F.count("*").alias("edge_rows"))
    threshold = ends.join(single.withColumnRenamed("e", "e2"), F.col("e").eqNullSafe(F.col("e2"))).drop("e2")
    known = settled(budgets.join(threshold, F.col("s").eqNullSafe(F.col("e")), "left"))
    return known, small is F.broadcast


def taken_words(most: int) -> Column:
    """Words taken of a document, given its size, its hash and its source's row of budget_ends."""
    own, left = F.shiftrightunsigned("hash", 64 - sum(LEVELS)), F.col("rest") - F.col("below")
    edge = F.when(F.col("edge_rows") == 1, F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0)).otherwise(
        F.when(F.col("edge_words") > 0, F.floor(F.col("size") * F.least(F.lit(1.0), left / F.col("edge_words")))).otherwise(0)
    )
    more = F.when(own < F.col("prefix"), F.col("size")).when(own == F.col("prefix"), edge).otherwise(0)
    taken = F.col("copies") * F.col("size") + F.when(F.col("copies") < most, F.coalesce(more, F.lit(0))).otherwise(0)
    return taken.cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = settled(docs.select(*_columns(id_column, text_column, source_column)))
    known, small = budget_ends(sizes, weights, most)
    placed = sizes.join(F.broadcast(known) if small else known, F.col("source").eqNullSafe(F.col("s")))
    return placed.select("doc_id", "size", "source_size", "target", taken_words(most).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of ``docs``.

    Whole rows are given until the budget ends, also among repeated rows: of those at the threshold, alike ones are
    counted first and then as many given as the rest of the budget holds.  Rows of size 0 are not given.
    """
    described = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_columns(id_column, text_column, source_column))
    known, small = budget_ends(settled(described.drop("row")), weights, most)
    placed = described.join(F.broadcast(known) if small else known, F.col("source").eqNullSafe(F.col("s"))).where("size > 0")
    at_end = (F.col("edge_rows") > 1) & (F.shiftrightunsigned("hash", 64 - sum(LEVELS)) == F.col("prefix")) & (F.col("copies") < most)
    at_end = F.coalesce(at_end, F.lit(False))
    whole = placed.where(~at_end).select("row", F.floor(taken_words(most) / F.col("size")).cast("int").alias("times"))
    alike = placed.where(at_end).groupBy("s", "row", "size", "copies", (F.col("rest") - F.col("below")).alias("left")).agg(F.count("*").alias("rows"))
    order = Window.partitionBy("s").orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(order), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("rows"), F.round(F.col("left") / F.col("size")) - before))
    some = alike.select("row", (F.col("copies") * F.col("rows") + more).cast("int").alias("times"))
    return whole.unionByName(some).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
