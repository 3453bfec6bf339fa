"""Running totals and exact quotas per group that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.runtime import Scratch


ROWS_A_PARTITION = 4_000_000


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, scratch: Scratch) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of its group that come before it in `order`.

    Rows are range-partitioned by group and order, so a hot group spans many partitions; totals per partition and group
    give each partition its start. `order` must have no ties within a group. Null values count as 0.
    """
    spark = df.sparkSession
    # A partition's rows are sorted in one task: their number follows the data where the session's setting is too small.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_PARTITION))
    ranged = scratch.keep(df.repartitionByRange(parts, *groups, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    amount = F.coalesce(F.col(value), F.lit(0))
    sums = ranged.groupBy("_pid", *groups).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_pid", *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = [F.col("r._pid") == F.col("s._pid"), *(F.col(f"r.{g}").eqNullSafe(F.col(f"s._g{i}")) for i, g in enumerate(groups))]
    joined = local.alias("r").join(starts.alias("s"), same)
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("r._local") + F.col("s._start")).alias(out))


def take_quota(df: DataFrame, groups: list[str], order: list[str], quota: str, scratch: Scratch, place: str | None = None) -> DataFrame:
    """The first `quota` rows of each group in `order`, with their place from 0 if asked for; a null quota takes none."""
    before = place or "_before"
    ranked = running_total(df.withColumn("_one", F.lit(1).cast("long")), groups, order, "_one", before, scratch)
    taken = ranked.filter(F.col(before) < F.coalesce(F.col(quota), F.lit(0))).drop("_one")
    return taken if place else taken.drop(before)
