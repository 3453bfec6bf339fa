"""Which component of a score moves a profile of rates: Shapley shares over all mixtures of two sets of components."""

from __future__ import annotations

from math import ceil, factorial, inf, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import CALIBRATION, TARGET_FPR
from siftwell.operators.metrics import higher_quantile
from siftwell.operators.resample import profile_shift
from siftwell.runtime import Scratch


def components(stats: DataFrame) -> DataFrame:
    """doc_id, nll, entropy, var, n from token statistics."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return stats.groupBy("doc_id").agg((-mean("logp")).alias("nll"), (-mean("mu")).alias("entropy"), mean("var").alias("var"), F.count(F.lit(1)).cast("double").alias("n"))


def pair_components(stats: DataFrame) -> DataFrame:
    """doc_id, nll, xent from pair statistics."""
    return stats.groupBy("doc_id").agg(F.avg(F.col("ce").cast("double")).alias("nll"), F.avg(F.col("xent").cast("double")).alias("xent"))


def contrast_score(c: dict[str, Column]) -> Column:
    return F.sqrt(c["n"]) * (c["entropy"] - c["nll"]) / F.sqrt(F.greatest(c["var"], F.lit(1e-8)))


def ratio_score(c: dict[str, Column]) -> Column:
    return -c["nll"] / F.greatest(c["xent"], F.lit(1e-8))


def aligned(base: DataFrame, target: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, stratum and the components of both sets as b_* and t_*, for documents that both have."""
    b = base.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in names))
    t = target.select("doc_id", *(F.col(c).alias(f"t_{c}") for c in names))
    return b.join(t, "doc_id").join(docs.select("doc_id", "stratum"), "doc_id")


def mixture_profiles(rows: DataFrame, names: list[str], score, calibration: str = CALIBRATION, fpr: float = TARGET_FPR, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, mask, stratum, rate: flag rates of every mixture, bit i of the mask taking component i from the target; each
    mixture's threshold is set anew on the calibration stratum. `by` holds replicates, `weight` how often a row counts."""
    w = F.col(weight) if weight else F.lit(1)
    masks = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("mask"))
    taken = {c: F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"t_{c}")).otherwise(F.col(f"b_{c}")) for i, c in enumerate(names)}
    scored = masks.select(*by, "mask", "stratum", score(taken).alias("score"), w.alias("_w"))
    thresholds = higher_quantile(scored.filter(F.col("stratum") == calibration), [*by, "mask"], "score", 1 - fpr, "threshold", "_w")
    flagged = (F.col("score") > F.col("threshold")).cast("int") * F.col("_w")
    return scored.filter(F.col("stratum") != calibration).join(thresholds, [*by, "mask"]).groupBy(*by, "mask", "stratum").agg((F.sum(flagged) / F.sum("_w")).alias("rate"))


def closings(profiles: DataFrame, n_components: int, by: list[str] = ()) -> DataFrame:
    """by, mask, total, v: the distance from base to target, and how much of it each mixture closes."""
    full = (1 << n_components) - 1
    goal = profiles.filter(F.col("mask") == full).select(*by, "stratum", F.col("rate").alias("goal"))
    dist = profiles.join(goal, [*by, "stratum"]).groupBy(*by, "mask").agg(F.sum(F.abs(F.col("rate") - F.col("goal"))).alias("d"))
    total = F.max(F.when(F.col("mask") == 0, F.col("d"))).over(Window.partitionBy(*by))
    return dist.select(*by, "mask", total.alias("total"), (total - F.col("d")).alias("v"))


def weights(n_components: int) -> list[tuple[int, int, float]]:
    """(component, mask, weight): the coefficient of v(mask) in the component's Shapley value."""
    m, out = n_components, []
    for i in range(m):
        for mask in range(1 << m):
            inside = bool(mask >> i & 1)
            others = mask.bit_count() - inside
            w = factorial(others) * factorial(m - others - 1) / factorial(m)
            out.append((i, mask, w if inside else -w))
    return out


def shapley(profiles: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """by, component, share, single_share, total: shares of the closed distance, in the mean over all orders and swapped alone."""
    closed = closings(profiles, len(names), by)
    table = profiles.sparkSession.createDataFrame([(names[i], mask, w, int(mask == 1 << i)) for i, mask, w in weights(len(names))], "component string, mask int, w double, alone int")
    sums = closed.join(table, "mask").groupBy(*by, "component").agg(F.sum(F.col("w") * F.col("v")).alias("phi"), F.sum(F.col("alone") * F.col("v")).alias("single"), F.first("total").alias("total"))
    whole = F.nullif("total", F.lit(0.0))
    return sums.select(*by, "component", (F.col("phi") / whole).alias("share"), (F.col("single") / whole).alias("single_share"), "total")


def mixed_scores(rows: DataFrame, names: list[str], score) -> DataFrame:
    """stratum, s0, s1, ..: a document's score under every mixture, by its mask; NaN, which Spark sorts last, as inf."""
    taken = lambda mask: {c: F.col(f"{'t' if mask >> i & 1 else 'b'}_{c}") for i, c in enumerate(names)}
    return rows.select("stratum", *(F.nanvl(score(taken(mask)).cast("double"), F.lit(inf)).alias(f"s{mask}") for mask in range(1 << len(names))))


def score_vectors(mixed: DataFrame, ends: dict[str, tuple[float, float]]) -> DataFrame:
    """stratum, the scores, n: how many documents share them all, once a score beyond its mixture's ends is -inf or inf.

    Nearly all documents lie beyond the ends in every mixture and are a few rows; of n, about the root of n keep a row of their own.
    """
    cut = [F.when(F.col(c) < low, F.lit(-inf)).when(F.col(c) > high, F.lit(inf)).otherwise(F.col(c)).alias(c) for c, (low, high) in ends.items()]
    return mixed.select("stratum", *cut).groupBy("stratum", *ends).agg(F.count(F.lit(1)).alias("n"))


def _draws(pdf, columns: list[str], replicates: int, seed: list[int]):
    """(scores, per replicate how often each row is drawn): as many draws with replacement as there are documents, counted by row."""
    pdf = pdf.sort_values(["n", *columns])  # the most frequent last: it gets what the other rows leave
    n, rng = pdf["n"].to_numpy(), np.random.default_rng(seed)
    return pdf[columns].to_numpy(float), (rng.multinomial(n.sum(), n / n.sum()) for _ in range(replicates))


SIGMAS, ACCURACY = 8, 10_000


def bootstrap_thresholds(mixed: DataFrame, calibration: str, fpr: float, replicates: int, seed: int = 0, sigmas: float = SIGMAS) -> np.ndarray:
    """replicates x mixtures: each replicate's thresholds, all from one draw of the calibration documents; NaN where none has a score.

    A drawn quantile lies within a few standard deviations of its rank, so only scores about there are told apart. Should a
    threshold lie outside, all are drawn again with ends twice as far apart, at last with none.
    """
    q, columns = 1 - fpr, [c for c in mixed.columns if c != "stratum"]
    own = mixed.filter(F.col("stratum") == calibration)

    def draw(pdf):
        import pandas as pd

        values, draws = _draws(pdf, columns, replicates, [seed])
        sorted_ = [(order := np.argsort(v, kind="stable")[: np.count_nonzero(~np.isnan(v))], v[order]) for v in values.T]
        out = np.full((replicates, len(columns)), np.nan)
        for b, times in enumerate(draws):
            for m, (order, v) in enumerate(sorted_):
                upto = times[order].cumsum()
                if len(upto) and upto[-1]:
                    out[b, m] = v[np.searchsorted(upto, ceil(round(q * (upto[-1] - 1), 9)), side="right")]
        return pd.DataFrame(out, columns=columns).assign(b=range(replicates))

    counts = own.agg(*(F.count(c).alias(c) for c in columns)).first()
    while True:
        levels = {c: (q - w, q + w) for c in columns if counts[c] and (w := sigmas * sqrt(q * fpr / counts[c]) + 1 / counts[c] + 2 / ACCURACY)}
        cuts = own.agg(*(F.percentile_approx(c, [max(0.0, low), min(1.0, high)], ACCURACY).alias(c) for c, (low, high) in levels.items())).first() if levels else {}
        ends = {c: (cuts[c][0] if levels[c][0] > 0 else -inf, cuts[c][1] if levels[c][1] < 1 else inf) if c in levels else (-inf, inf) for c in columns}
        drawn = score_vectors(own, ends).groupBy("stratum").applyInPandas(draw, ", ".join(f"{c} double" for c in columns) + ", b int")
        out = np.array([[r[c] for c in columns] for r in drawn.orderBy("b").collect()], float).reshape(-1, len(columns))
        low, high = (np.array([ends[c][i] for c in columns]) for i in (0, 1))
        if not (((out == -inf) & (low > -inf)) | ((out == inf) & (high < inf))).any():
            return out
        sigmas *= 2


def bootstrap_profiles(rows: DataFrame, names: list[str], score, replicates: int, seed: int = 0, calibration: str = CALIBRATION, fpr: float = TARGET_FPR) -> DataFrame:
    """b, mask, stratum, rate: what mixture_profiles gives for documents, a row each, drawn with replacement within their strata.

    No table has a row per replicate and document. Documents whose scores lie on the same sides of all replicates' thresholds
    are drawn as one row with their number, which leaves the joint distribution of the rates as it is. The driver holds one
    threshold per replicate and mixture.
    """
    mixed = mixed_scores(rows, names, score)
    thresholds = bootstrap_thresholds(mixed, calibration, fpr, replicates, seed)
    columns = [c for c in mixed.columns if c != "stratum"]
    ends = {c: (float(np.nanmin(own)), float(np.nanmax(own))) if (own := thresholds[:, m]).size and not np.isnan(own).all() else (-inf, inf) for m, c in enumerate(columns)}

    def draw(key, pdf):
        import pandas as pd

        values, draws = _draws(pdf, columns, replicates if len(thresholds) else 0, [seed, *key[0].encode()])
        rates = [times @ (values > own) / times.sum() for times, own in zip(draws, thresholds, strict=False)]
        out = pd.DataFrame([(b, m, key[0], r) for b, each in enumerate(rates) for m, r in enumerate(each)], columns=["b", "mask", "stratum", "rate"])
        return out[~np.isnan(thresholds[out["b"].to_numpy(int), out["mask"].to_numpy(int)])] if len(out) else out

    others = score_vectors(mixed.filter(F.col("stratum") != calibration), ends)
    return others.groupBy("stratum").applyInPandas(draw, "b int, mask int, stratum string, rate double")


def bootstrap_shares(rows: DataFrame, names: list[str], score, replicates: int, seed: int = 0) -> DataFrame:
    """b, component, share: shares over documents drawn again within each stratum, base and target alike."""
    profiles = bootstrap_profiles(rows, names, score, replicates, seed)
    return shapley(Scratch(rows.sparkSession, "shares").keep(profiles, "profiles"), names, ["b"]).select("b", "component", "share")


def share_intervals(shares: DataFrame, lead: str | None = None) -> DataFrame:
    """component, low, high: 95 % percentile intervals of the shares, or of `lead`'s share less each other's."""
    if lead:
        own = shares.filter(F.col("component") == lead).select("b", F.col("share").alias("lead"))
        shares = shares.filter(F.col("component") != lead).join(own, "b").withColumn("share", F.col("lead") - F.col("share"))
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.975)))
    return shares.filter(~F.isnan("share")).groupBy("component").agg(q.alias("q")).select("component", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def precondition(flags: DataFrame, column: str = "reference", alpha: float = 0.05, replicates: int = 2000) -> dict:
    """Whether there is a shift to attribute at all: the permutation test of profiles over `column` must reject."""
    shift = profile_shift(flags, column, replicates)
    return shift | {"estimable": shift["p"] is not None and shift["p"] < alpha}


def guarded(shift: dict, verdict: str) -> str:
    """A follow-up's verdict, or that it could not be estimated."""
    return verdict if shift["estimable"] else "NOT ESTIMABLE"


def leading_verdict(share: float, leads: dict[str, tuple[float, float]], equal: float = 0.25) -> str:
    """Confirmed above one half with every lead above zero, rejected at or below an equal split."""
    if share > 0.5 and all(low > 0 for low, _ in leads.values()):
        return "CONFIRMED"
    return "REJECTED" if share <= equal else "PARTIAL"


def contrast_verdict(share: float, low: float, high: float) -> str:
    """Confirmed above one half with the contrast's interval above zero, rejected with it below."""
    return "CONFIRMED" if share > 0.5 and low > 0 else "REJECTED" if high < 0 else "PARTIAL"


def majority_verdict(largest: list[str], component: str, least: int = 6) -> str:
    """Supported if the component has the largest share in at least `least` comparisons."""
    return "SUPPORTED" if largest.count(component) >= least else "NOT SUPPORTED"


def reproduction(components_: DataFrame, scores: DataFrame, score, names: list[str]) -> DataFrame:
    """n, max_diff: how far scores made again from components lie from those on record (doc_id, score)."""
    again = components_.select("doc_id", score({c: F.col(c) for c in names}).alias("again"))
    return again.join(scores.select("doc_id", "score"), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("again") - F.col("score"))).alias("max_diff"))
