"""Thresholds, flags, rates with intervals, agreement, gates and rank statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import CALIBRATION, FLIPPABLE, MIN_AUROC, TARGET_FPR, TRAINED
from siftwell.operators.scoring import mid_ranks

Z = 1.96


def higher_quantile(df: DataFrame, by: list[str], value: str, q: float, out: str, weight: str | None = None) -> DataFrame:
    """by, out: of each group the sorted value at index ceil(q (n - 1)), from 0; a row counts `weight` times.

    Ranks come from the counts of distinct values, so a value repeated by a third of all rows is one row to the sort.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(times.alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    index = F.ceil(F.round(F.lit(q) * (F.sum("_n").over(group) - 1), 9))
    return counts.withColumn("_upto", upto).withColumn("_index", index).filter("_upto > _index").groupBy(*by).agg(F.min(value).alias(out))


def calibrate(scores: DataFrame, fpr: float = TARGET_FPR) -> DataFrame:
    """instance, threshold: the higher quantile of each instance over calibration scores (instance, score)."""
    return higher_quantile(scores, ["instance"], "score", 1 - fpr, "threshold")


def freeze(old: dict[str, float], new: dict[str, float]) -> dict[str, float]:
    """Old thresholds with new instances added; refuses to move one that is frozen."""
    moved = sorted(k for k in new if k in old and not math.isclose(old[k], new[k], rel_tol=1e-5, abs_tol=1e-8))
    if moved:
        raise ValueError(f"frozen thresholds would move: {', '.join(moved)}")
    return new | old


def flag(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores of instances with a threshold, with threshold and flagged (score strictly above it)."""
    return scores.join(thresholds, "instance").withColumn("flagged", (F.col("score") > F.col("threshold")).cast("int"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval."""
    p = k / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return centre - half, centre + half


def rates(flags: DataFrame, by: list[str]) -> DataFrame:
    """by, flagged, n, fpr, fpr_lo, fpr_hi."""
    counts = flags.groupBy(*by).agg(F.sum("flagged").alias("flagged"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("flagged"), F.col("n"))
    return counts.select(*by, "flagged", "n", (F.col("flagged") / F.col("n")).alias("fpr"), low.alias("fpr_lo"), high.alias("fpr_hi"))


def empirical_logit(k: Column, n: Column) -> Column:
    return F.log((k + 0.5) / (n - k + 0.5))


def complete_cases(flags: DataFrame, item: str = "item_id", column: str = "instance") -> DataFrame:
    """Rows of items that have every value of `column`."""
    wanted = flags.select(column).distinct().count()
    full = flags.groupBy(item).agg(F.countDistinct(column).alias("_k")).filter(F.col("_k") == wanted).select(item)
    return flags.join(full, item)


def kappa_pairs(flags: DataFrame) -> DataFrame:
    """a, b, n, kappa: Cohen's kappa of each pair of instances over items that all of them judged.

    Items are first reduced to the vector of their flags, so pairs are counted from the few distinct vectors.
    """
    vectors = complete_cases(flags.select("item_id", "instance", "flagged")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("instance", "flagged"))).alias("v"))
    kinds = vectors.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y.instance > x.instance), lambda y: F.struct(x.instance.alias("a"), y.instance.alias("b"), x.flagged.alias("fa"), y.flagged.alias("fb")))))
    long = kinds.select("n", F.explode(pairs).alias("p")).select("n", "p.*")
    n = F.sum("n")
    sums = long.groupBy("a", "b").agg(n.alias("n"), F.sum(F.when(F.col("fa") == F.col("fb"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.col("fa") * F.col("n")).alias("ka"), F.sum(F.col("fb") * F.col("n")).alias("kb"))
    po, pa, pb = F.col("same") / F.col("n"), F.col("ka") / F.col("n"), F.col("kb") / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    return sums.select("a", "b", "n", F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def auroc(scores: DataFrame) -> DataFrame:
    """instance, auroc, flipped, passed, n_human, n_control from (instance, score, positive).

    Instances of undocumented orientation are flipped below one half.
    """
    ranked = mid_ranks(scores, ["instance"], "score", "rank")
    n1, n0 = F.sum("positive"), F.sum(1 - F.col("positive"))
    raw = (F.sum(F.col("rank") * F.col("positive")) - n1 * (n1 + 1) / 2) / (n1 * n0)
    sums = ranked.groupBy("instance").agg(raw.alias("raw"), n0.alias("n_human"), n1.alias("n_control")).filter("n_human > 0 and n_control > 0")
    flipped = F.split("instance", "@")[0].isin(*FLIPPABLE) & (F.col("raw") < 0.5)
    area = F.when(flipped, 1 - F.col("raw")).otherwise(F.col("raw"))
    return sums.select("instance", area.alias("auroc"), flipped.alias("flipped"), (area >= MIN_AUROC).alias("passed"), "n_human", "n_control")


def apply_flips(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """Scores with 1 - score for flipped instances; the stored scores stay as they are."""
    flips = gate.filter("flipped").select("instance", F.lit(True).alias("_flip"))
    return scores.join(flips, "instance", "left").withColumn("score", F.when(F.col("_flip"), 1 - F.col("score")).otherwise(F.col("score"))).drop("_flip")


def gate_run(scores: DataFrame, own: DataFrame, gated: bool = True) -> DataFrame:
    """instance, item_id, stratum, score, threshold, flagged of the human texts after the gates, in order: area under the
    curve, flips, failed instances dropped, thresholds calibrated on what is left, flags.

    scores: (instance, item_id, group_name, score), with the generated texts in group `control`; own: (item_id, stratum).
    Without `gated` failed instances stay, as in an exploratory rerun. Refused if no instance passes.
    """
    human = scores.filter("group_name <> 'control'").join(own, "item_id")
    calibration = human.filter(F.col("stratum") == CALIBRATION)
    both = calibration.select("instance", "score", F.lit(0).alias("positive")).unionByName(scores.filter("group_name = 'control'").select("instance", "score", F.lit(1).alias("positive")))
    gate = auroc(both)
    left = gate.filter("passed") if gated else gate
    if left.isEmpty():
        raise ValueError("no instance passes the gate")
    kept = apply_flips(human, gate).join(left.select("instance"), "instance", "left_semi")
    thresholds = calibrate(kept.filter(F.col("stratum") == CALIBRATION).select("instance", "score"))
    return flag(kept.select("instance", "item_id", "stratum", "score"), thresholds)


def negative_control(fpr: DataFrame, target: float = TARGET_FPR, margin: float = 0.005) -> DataFrame:
    """instance, fpr, passed on the calibration stratum."""
    return fpr.filter(F.col("stratum") == CALIBRATION).select("instance", "fpr", (F.abs(F.col("fpr") - target) <= margin).alias("passed"))


def length_invariance(flags: DataFrame, margin: float = 0.03) -> DataFrame:
    """instance, fpr_spread, passed: the range of flag rates over quartiles of n_tokens of the given (calibration) flags."""
    cuts = F.broadcast(flags.agg(F.percentile("n_tokens", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    quartile = (F.col("n_tokens") > F.col("q")[0]).cast("int") + (F.col("n_tokens") > F.col("q")[1]).cast("int") + (F.col("n_tokens") > F.col("q")[2]).cast("int")
    by = flags.join(cuts).groupBy("instance", quartile.alias("quartile")).agg(F.avg("flagged").alias("fpr"))
    spread = by.groupBy("instance").agg((F.max("fpr") - F.min("fpr")).alias("fpr_spread"))
    return spread.withColumn("passed", F.col("fpr_spread") <= margin)


def kendall(cells: DataFrame, column: str, unit: str, value: str) -> DataFrame:
    """a, b, tau: Kendall's tau-b of the profiles of each pair of values of `column` over the units they share."""
    x = cells.select(F.col(column).alias("a"), F.col(unit).alias("u"), F.col(value).alias("x"))
    y = cells.select(F.col(column).alias("b"), F.col(unit).alias("u"), F.col(value).alias("y"))
    both = x.join(y, "u").filter("a < b")
    other = both.select("a", "b", F.col("u").alias("u2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    signs = both.join(other, ["a", "b"]).filter("u < u2").select("a", "b", F.signum(F.col("x") - F.col("x2")).alias("sx"), F.signum(F.col("y") - F.col("y2")).alias("sy"))
    sums = signs.groupBy("a", "b").agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    return sums.select("a", "b", (F.col("s") / F.nullif(F.sqrt(F.col("nx") * F.col("ny")), F.lit(0.0))).alias("tau"))


def holm(df: DataFrame, key: str, p: str) -> DataFrame:
    """key, p, p_holm: Holm's step-down adjustment over a table of one row per test."""
    order = Window.orderBy(p, key)
    ranked = df.select(key, p, F.row_number().over(order).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_m"))
    scaled = ranked.withColumn("_s", (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return scaled.select(key, p, F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("p_holm"))


def conformal_rank(n: int, level: float = 0.95) -> int:
    """Index, from 0, of the miss that covers a new case at the level."""
    return min(n - 1, math.ceil(round((n + 1) * level, 9)) - 1)


def family_of(detector: Column) -> Column:
    return F.when(detector.isin(*TRAINED), "trained").otherwise("zero_shot")
