"""The registered tests over the analysis tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.config import ANALYSIS, FAMILIES, TRAINED
from siftwell.operators import linear, metrics, resample
from siftwell.operators.report import verdict

A = ANALYSIS


def _cells(cells: DataFrame, columns: list[str]) -> list:
    """Cell rows on the driver: at most instances times strata."""
    return cells.select(*columns).dropna().orderBy(*columns).collect()


def _mixed(rows: list, y: str, x: list[str], group: str, slopes: list[str] = (), reml: bool = False) -> tuple[dict, np.ndarray]:
    target = np.array([r[y] for r in rows], float)
    fixed = np.column_stack([np.ones(len(rows)), *([r[c] for r in rows] for c in x)]).astype(float)
    random = np.column_stack([np.ones(len(rows)), *([r[c] for r in rows] for c in slopes)]).astype(float)
    return linear.mixed_model(target, fixed, random, np.array([r[group] for r in rows]), reml), fixed


def unification(cells: DataFrame, docs: DataFrame, family: str | None = None) -> dict:
    """Do flag rates fall with perplexity across all instances? Cells by a mixed model, documents by clustered logistic models."""
    if family:
        cells, docs = cells.filter(F.col("family") == family), docs.filter(metrics.family_of(F.col("detector")) == family)
    rows = _cells(cells, ["instance", "stratum", "fpr", "log_ppl_indep", "length"])
    full, x_full = _mixed(rows, "fpr", ["log_ppl_indep", "length"], "instance")
    base, x_base = _mixed(rows, "fpr", ["length"], "instance")
    gain = linear.marginal_r2(x_full, full) - linear.marginal_r2(x_base, base)
    coef = float(full["coef"][1])
    p = linear.Fit(["a", "b", "c"], full["coef"], full["cov"], len(rows)).p("b")
    numeric = ["log_ppl_indep", "n_tokens"]
    without = linear.logistic(docs, "flagged", numeric, ["instance"], cluster="item_id")["log_ppl_indep"]
    within = linear.logistic(docs, "flagged", numeric, ["instance", "stratum"], cluster="item_id")["log_ppl_indep"]
    attenuation = 1 - within / without if without else float("nan")
    good = coef < 0 and p < A["alpha"]
    return {
        "family": family or "all", "coef": coef, "p": p, "delta_r2": gain, "doc_coef": without, "doc_coef_with_stratum": within, "attenuation": attenuation, "n_cells": len(rows),
        "verdict": verdict(good and gain >= A["min_delta_r2"] and attenuation < A["max_attenuation"], not good or gain < A["fail_delta_r2"]),
    }


def reference_shift(cells: DataFrame, docs: DataFrame, references: list[str] | None = None, overlap: DataFrame | None = None, replicates: int = 2000) -> dict:
    """Does the same text's rate follow the reference's own perplexity? Fixed effects, and a permutation of references."""
    c = cells.filter((F.col("detector") == "D1") & F.col("log_ppl_ref").isNotNull())
    d = docs.filter(F.col("detector") == "D1")
    if references:
        c, d = c.filter(F.col("reference").isin(references)), d.filter(F.col("reference").isin(references))
    present = [r[0] for r in c.select("reference").distinct().orderBy("reference").collect()]
    if len(present) < 2:
        return {"references": present, "verdict": "NOT ESTIMABLE"}
    terms = ["log_ppl_ref", "length"]
    fit = linear.least_squares(c, "fpr", terms, ["stratum", "reference"], robust="HC3")
    shift = resample.profile_shift(d, "reference", replicates)
    good = fit["log_ppl_ref"] < 0 and fit.p("log_ppl_ref") < A["alpha"]
    out = {"references": present, "coef": fit["log_ppl_ref"], "p": fit.p("log_ppl_ref"), "shift_stat": shift["stat"], "shift_p": shift["p"], "verdict": verdict(good and shift["p"] < A["alpha"], shift["p"] >= A["alpha"])}
    if overlap is not None:
        own = c.join(overlap, ["reference", "stratum"], "left").dropna(subset=["sip"])
        spread = own.agg(F.countDistinct("sip").alias("s"), F.countDistinct("reference").alias("r")).first()
        if spread.s < 2 or spread.r < 2:
            out["robustness"] = "not estimable"
        else:
            again = linear.least_squares(own, "fpr", [*terms, "sip"], ["stratum", "reference"], robust="HC3")
            out["robustness"] = {"coef": again["log_ppl_ref"], "coef_sip": again["sip"], "p_sip": again.p("sip"), "n": again.n}
    return out


def trained_only(cells: DataFrame, docs: DataFrame, replicates: int = 2000) -> dict:
    out = unification(cells, docs, "trained")
    shift = resample.profile_shift(docs.filter(F.col("detector").isin(*TRAINED)), "instance", replicates)
    return out | {"shift_stat": shift["stat"], "shift_p": shift["p"]}


def held_out_strata(cells: DataFrame) -> dict:
    """Error of rates predicted for a stratum from the others, against a baseline without perplexity."""
    mae, _ = linear.held_out_errors(cells, "fpr", ["log_ppl_indep", "length"], ["instance"], "stratum")
    base, _ = linear.held_out_errors(cells, "fpr", ["length"], ["instance"], "stratum")
    skill = 1 - mae / base if base > 0 else 0.0
    return {"mae": mae, "mae_baseline": base, "skill": skill, "verdict": verdict(mae <= A["max_mae"] and skill >= A["min_skill"], mae > A["partial_mae"] or skill <= 0)}


def intervention(deltas: DataFrame) -> dict[str, dict]:
    """Per instance: the common slope of score change on perplexity change, and how far edits' own slopes spread.

    The sums of products per instance and edit come from one aggregation; no change of a document reaches the driver.
    """
    x, y = F.col("dlogppl"), F.col("dz")
    sums = deltas.groupBy("instance", "edit").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.regr_slope("dz", "dlogppl").alias("slope")
    )
    held: dict[str, list] = {}
    for r in sums.orderBy("instance", "edit").collect():
        held.setdefault(r.instance, []).append(r)
    out = {}
    for instance, rows in held.items():
        grams = []
        for r in rows:
            own = np.array([[r.n, r.sx], [r.sx, r.sxx]], float)
            right = np.array([[r.sy], [r.sxy]], float)
            grams.append(np.block([[own, own, right], [own, own, right], [right.T, right.T, np.array([[float(r.syy)]])]]))
        n = sum(r.n for r in rows)
        fit = linear.mixed_model_of_sums(grams, 2, 2, n, True)
        slope, p = float(fit["coef"][1]), linear.Fit(["a", "b"], fit["coef"], fit["cov"], n).p("b")
        ratio = float(np.sqrt(max(fit["random"][1, 1], 0.0))) / abs(slope) if slope else float("inf")
        good = slope < 0 and p < A["alpha"]
        out[instance] = {"slope": slope, "p": p, "sd_ratio": ratio, "per_edit": {r.edit: r.slope for r in rows}, "n": n, "verdict": verdict(good and ratio <= A["max_slope_ratio"], not good)}
    return out


def intervention_overall(per_instance: dict[str, dict], included: list[str]) -> dict:
    """Holm over the included instances; confirmed if at least half of them are."""
    own = sorted((i for i in included if i in per_instance), key=lambda i: (per_instance[i]["p"], i))
    if not own:
        return {"verdict": "NOT RUN", "n_instances": 0}
    worst, kept = 0.0, []
    for k, i in enumerate(own):
        r = per_instance[i]
        worst = max(worst, min(1.0, (len(own) - k) * r["p"]))
        r["p_holm"] = worst
        if r["slope"] < 0 and worst < A["alpha"] and r["sd_ratio"] <= A["max_slope_ratio"]:
            kept.append(i)
    return {"confirmed": sorted(kept), "share": len(kept) / len(own), "n_instances": len(own), "verdict": "CONFIRMED" if len(kept) >= 0.5 * len(own) else "REJECTED"}


def agreement_structure(docs: DataFrame, replicates: int = 5000) -> dict:
    """Do instances of one reference family agree more than others?"""
    pairs = metrics.kappa_pairs(docs).orderBy("a", "b").collect()
    names = sorted({r.a for r in pairs} | {r.b for r in pairs})
    index = [(names.index(r.a), names.index(r.b)) for r in pairs]
    out = resample.label_permutation([r.kappa for r in pairs], index, [FAMILIES.get(n, n) for n in names], replicates)
    return out | {"verdict": verdict(out["gap"] > 0 and out["p"] < A["alpha"], True)}
