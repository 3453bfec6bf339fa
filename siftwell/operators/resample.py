"""Permutation tests and bootstraps, drawn by hash so that every replicate can be repeated in any engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.metrics import complete_cases
from siftwell.operators.ordered import running_total
from siftwell.runtime import Scratch


def profile_statistic(rates: DataFrame, by: list[str], row: str, column: str, value: str) -> DataFrame:
    """by, stat: the sum of squares of a table of rates after its row and column means are taken out."""
    at = lambda *keys: F.avg(value).over(Window.partitionBy(*by, *keys))
    inner = F.col(value) - at(row) - at(column) + at()
    return rates.withColumn("_c", inner).groupBy(*by).agg(F.sum(F.col("_c") * F.col("_c")).alias("stat"))


def profile_shift(flags: DataFrame, column: str = "instance", replicates: int = 2000, seed: int = 0) -> dict:
    """stat and p of whether strata's flag profiles differ over `column` (item_id, stratum, column, flagged).

    Under the null the labels of `column` are shuffled within each document. Documents are first reduced to how many of each
    stratum have m flags; a replicate goes through the labels one by one, and of the documents with r flags still to
    place over k labels a binomial number, with chance r / k, puts one on this label. Counts alone come to the driver.
    """
    full = complete_cases(flags, column=column)
    labels = sorted(r[0] for r in full.select(column).distinct().collect())
    if len(labels) < 2:
        return {"stat": None, "p": None}
    rates = full.groupBy("stratum", column).agg(F.avg("flagged").alias("rate"))
    observed = profile_statistic(rates, [], "stratum", column, "rate").first()["stat"]
    vectors = full.groupBy("stratum", "item_id").agg(F.sum("flagged").alias("m")).groupBy("stratum", "m").agg(F.count(F.lit(1)).alias("n")).collect()
    rng = np.random.default_rng(seed)
    k, strata = len(labels), sorted({r.stratum for r in vectors})
    table = np.empty((replicates, len(strata), k))
    for s, stratum in enumerate(strata):
        left = np.zeros((replicates, k + 1), np.int64)  # documents by flags still to place
        for r in vectors:
            if r.stratum == stratum:
                left[:, int(r.m)] += r.n
        size = left[0].sum()
        for c in range(k):
            placed = rng.binomial(left, np.minimum(1.0, np.arange(k + 1) / (k - c)))
            table[:, s, c] = placed.sum(axis=1) / size
            left = left - placed
            left[:, :-1] += placed[:, 1:]
    centred = table - table.mean(1, keepdims=True) - table.mean(2, keepdims=True) + table.mean((1, 2), keepdims=True)
    null = (centred**2).sum((1, 2))
    return {"stat": observed, "p": (1 + int((null >= observed - 1e-12).sum())) / (1 + replicates)}


def label_permutation(values: list[float], same: list[tuple[int, int]], labels: list[str], replicates: int = 5000, seed: int = 0) -> dict:
    """gap and p: the mean value of pairs with equal labels less that of the others, against shuffled labels."""
    v, pairs = np.array(values), np.array(same)

    def gap(own):
        own = np.asarray(own)
        equal = own[pairs[:, 0]] == own[pairs[:, 1]]
        return v[equal].mean() - v[~equal].mean() if equal.any() and not equal.all() else np.nan

    observed, rng = gap(labels), np.random.default_rng(seed)
    null = np.array([gap(rng.permutation(labels)) for _ in range(replicates)])
    return {"gap": float(observed), "p": (1 + int((null >= observed - 1e-12).sum())) / (1 + replicates)}


def draw_index(replicate: Column, slot: Column, n: Column, seed: int = 0) -> Column:
    """A pseudorandom number in 0..n-1 from a replicate and a slot, the same in any engine: MD5 modulo n."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), slot.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), n)


def bootstrap_counts(docs: DataFrame, replicates: int, key: str = "item_id", stratum: str = "stratum", seed: int = 0) -> DataFrame:
    """b, key, times: how often each document is drawn in each replicate, with replacement within its stratum.

    A stratum's documents are numbered by key; each of its n slots draws a number. Replicates are rows, not passes.
    """
    scratch = Scratch(docs.sparkSession, "bootstrap")
    own = scratch.keep(docs.select(F.col(stratum).alias("_s"), F.col(key).alias("_k"), F.lit(1).cast("long").alias("_one")).distinct(), "documents")
    sizes = own.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    numbered = scratch.keep(running_total(own, ["_s"], ["_k"], "_one", "_i", scratch).join(sizes, "_s").select("_s", "_k", "_i", "_n"), "numbered")
    # Spark's size estimates leave out the replicates: the few rows are spread before they grow, and what has grown is not broadcast.
    spread = numbered.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_s", "_i")
    slots = spread.select("_s", "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    draws = slots.select("b", "_s", draw_index(F.col("b"), F.concat_ws("/", "_s", "_i"), F.col("_n"), seed).alias("_i"))
    counted = draws.groupBy("b", "_s", "_i").agg(F.count(F.lit(1)).alias("times"))
    return counted.hint("merge").join(numbered.select("_s", "_i", "_k"), ["_s", "_i"]).select("b", F.col("_k").alias(key), "times")


def bootstrap_cells(doc_table: DataFrame, counts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """b, by, n and the weighted mean of each value in each replicate's cells."""
    rows = doc_table.join(counts.hint("merge"), "item_id")
    n = F.sum("times")
    return rows.groupBy("b", *by).agg(n.alias("n"), *((F.sum(F.col("times") * F.col(v)) / n).alias(v) for v in values))


def bootstrap_coefficients(cells: DataFrame, y: str, numeric: list[str], categories: list[str], name: str) -> DataFrame:
    """b, coef: the least-squares coefficient of `name` in each replicate; its cells are one group, a few hundred rows."""

    def fit(pdf):
        import pandas as pd

        x = [np.ones(len(pdf)), *(pdf[c].to_numpy(float) for c in numeric)]
        for c in categories:
            x += [(pdf[c] == level).to_numpy(float) for level in sorted(pdf[c].dropna().unique())[1:]]
        beta = np.linalg.lstsq(np.column_stack(x), pdf[y].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "coef": [beta[1 + numeric.index(name)]]})

    rows = cells.dropna(subset=[y, *numeric, *categories])
    return rows.groupBy("b").applyInPandas(fit, "b int, coef double")


def interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """low, high: percentiles with linear interpolation over values neither null nor NaN."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value)).agg(q.alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
