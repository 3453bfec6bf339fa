"""Pairs within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sides(rows: DataFrame, key: str, count: str, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Both sides of all pairs of blocks (low <= high) into which the rows of groups of `count` rows are cut by a hash of `key`.

    Joined on the group, low and high, and filtered to low < high or an order of keys, they give each pair of a group once;
    no task meets more than two blocks of a group.
    """
    blocks = F.ceil(F.col(count) / block)
    own = rows.withColumn("own", F.pmod(F.xxhash64(key), blocks))
    left = own.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence(F.col("own"), blocks - 1)))
    right = own.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))))
    return left.drop("own"), right.drop("own")
