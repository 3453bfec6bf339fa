"""Score cutoffs per group that keep a target fraction, by distributed quickselect.

A round takes medians and further quantiles of each group in each partition, and weighted medians of these as the group's
pivots; counts between the pivots show the stretch that holds the wanted rank, and all others are discarded: only that stretch
is written for the next round, so the rounds together read little more than the first. They repeat until every rank is
isolated. Pivots and ranks are tables of one row per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.scoring import latest_scores as latest_scores
from siftwell.runtime import Scratch

PIVOTS = 31
_CUTS = [k / (PIVOTS + 1) for k in range(1, PIVOTS + 1)]


def partition_medians(values: DataFrame, *more) -> DataFrame:
    """key, pid, quantiles, n: of each group in each partition; further aggregates as given."""
    return values.groupBy("key", F.spark_partition_id().alias("pid")).agg(F.percentile_approx("value", F.array(*map(F.lit, _CUTS)), 1000).alias("quantiles"), F.count(F.lit(1)).alias("n"), *more)


def _pivots(medians: DataFrame) -> DataFrame:
    """key, pivots: weighted medians, quartiles and so on of the partitions' quantiles, in order."""
    each = medians.select("key", "n", F.explode("quantiles").alias("q"))
    upto, whole = Window.partitionBy("key").orderBy("q"), Window.partitionBy("key")
    weighed = each.select("key", "q", F.floor(F.sum("n").over(upto) * F.lit(PIVOTS + 1) / F.sum("n").over(whole)).alias("place"))
    return weighed.groupBy("key", "place").agg(F.min("q").alias("q")).groupBy("key").agg(F.array_sort(F.collect_set("q")).alias("pivots"))


def quickselect(values: DataFrame, ranks: DataFrame, scratch: Scratch, *, medians: DataFrame | None = None, max_rounds: int = 200) -> DataFrame:
    """key, value: the value at position `rank` (from 1) of each key's sorted values.

    values: (key string, value double without null and NaN); ranks: (key, rank) with 1 <= rank <= the key's count; medians:
    partition_medians(values), where they are at hand.
    """
    wanted, alive, found = ranks.select("key", F.col("rank").cast("long").alias("rank")), values.select("key", "value"), None
    for _ in range(max_rounds):
        pivots = _pivots(medians if medians is not None else partition_medians(alive))
        below = F.size(F.filter("pivots", lambda x: x < F.col("value")))
        # Even numbers are the stretches between pivots, odd ones the pivots themselves.
        stretch = (2 * below + F.array_contains("pivots", F.col("value")).cast("int")).alias("stretch")
        sides = alive.join(pivots, "key").select("key", "value", stretch).groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        placed = sides.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(wanted, "key")
        here = placed.filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        picked = scratch.keep(here.select("key", (F.col("rank") - F.col("before")).alias("rank"), "low", "high"), "picked")
        done = picked.filter("low = high").select("key", F.col("low").alias("value"))
        found = done if found is None else found.unionByName(done)
        open_ = picked.filter("low < high")
        if open_.isEmpty():
            return found
        left = scratch.keep(alive.join(open_.select("key", "low", "high"), "key").filter("value between low and high").select("key", "value"), "alive")
        if medians is None:
            scratch.drop(alive)
        wanted, alive, medians = open_.select("key", "rank"), left, None
    raise RuntimeError("ranks were not isolated; raise max_rounds")


def cutoffs(scores: DataFrame, targets: DataFrame, *, fraction_col: str = "keep_fraction", default_fraction: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, items) for scores of latest_scores() and targets (instance, group_name, keep_fraction).

    A group's cutoff is its smallest score that at least the fraction of its items do not exceed; items above it are not
    kept. report: instance, group_name, keep_fraction, items, cutoff, kept, kept_share; targets without items have no
    cutoff. items: the scores with `kept`. Groups without a target, or with a null or NaN fraction, take
    `default_fraction`, and are kept whole without one. Fractions are held to 0..1. Null instances and groups are groups
    of their own; of repeated targets the greatest fraction holds.
    """
    scratch = Scratch(scores.sparkSession, "cutoffs")
    key = F.to_json(F.array(F.coalesce("instance", F.lit("\u0000")), F.coalesce("group_name", F.lit("\u0000"))))
    items = scratch.keep(scores.select("instance", "item_id", "group_name", "score", key.alias("key")), "items")
    fraction = F.col(fraction_col).cast("double")
    wanted = targets.select(F.col("instance").cast("string").alias("instance"), F.col("group_name").cast("string").alias("group_name"), F.when(fraction.isNotNull() & ~F.isnan(fraction), F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))).alias("keep_fraction"))
    wanted = wanted.groupBy("instance", "group_name").agg(F.max("keep_fraction").alias("keep_fraction")).withColumn("key", key)
    medians = scratch.keep(partition_medians(items.withColumnRenamed("score", "value"), F.first("instance").alias("i"), F.first("group_name").alias("g")), "medians")
    sizes = medians.groupBy("key").agg(F.first("i").alias("i"), F.first("g").alias("g"), F.sum("n").alias("items"))
    plan = scratch.keep(
        sizes.join(wanted, "key", "full").select(
            "key", F.coalesce("instance", "i").alias("instance"), F.coalesce("group_name", "g").alias("group_name"),
            F.coalesce("keep_fraction", F.lit(default_fraction).cast("double")).alias("keep_fraction"), F.coalesce("items", F.lit(0)).alias("items"),
        ),
        "plan",
    )
    ranks = plan.filter("items > 0 and keep_fraction is not null").select("key", F.greatest(F.lit(1), F.ceil(F.col("keep_fraction") * F.col("items"))).alias("rank"))
    found = quickselect(items.select("key", F.col("score").alias("value")), ranks, scratch, medians=medians).withColumnRenamed("value", "cutoff")
    judged = items.join(found, "key", "left").withColumn("kept", F.col("cutoff").isNull() | (F.col("score") <= F.col("cutoff")))
    kept = judged.groupBy("key").agg(F.count_if("kept").alias("kept"))
    report = (
        plan.join(found, "key", "left")
        .join(kept, "key", "left")
        .select("instance", "group_name", "keep_fraction", "items", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"), F.when(F.col("items") > 0, F.coalesce("kept", F.lit(0)) / F.col("items")).alias("kept_share"))
    )
    return report, judged.select("instance", "item_id", "group_name", "score", "kept")
