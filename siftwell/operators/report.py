"""Forecasts, audits, verdicts and release tables."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell import config
from siftwell.operators import linear, metrics

A = config.ANALYSIS


def verdict(confirmed: bool, rejected: bool) -> str:
    return "CONFIRMED" if confirmed else "REJECTED" if rejected else "PARTIAL"


def decision(verdicts: list[str | None]) -> str:
    n = sum(v == "CONFIRMED" for v in verdicts)
    return "CONFIRMED" if n >= 2 else "SUGGESTIVE" if n == 1 else "REJECTED"


# forecast -------------------------------------------------------------------------------------------------------------


def forecast_model(cells: DataFrame) -> linear.Fit:
    """Rates on log perplexity, length and instance over the fitting strata; refuses held-out or missing strata."""
    seen = {r[0] for r in cells.select("stratum").distinct().collect()}
    if seen & set(config.FORECAST):
        raise ValueError("detector scores of held-out strata exist: the forecast would not be blind")
    if set(config.FIT) - seen:
        raise ValueError(f"strata missing: {', '.join(sorted(set(config.FIT) - seen))}")
    return linear.least_squares(cells, "fpr", ["log_ppl_indep", "length"], ["instance"])


def forecast_grid(targets: DataFrame, instances: list[str], fit: linear.Fit) -> DataFrame:
    """stratum, instance, fpr_pred: every target stratum (stratum, log_ppl_indep, length) for every instance, held to 0..1."""
    known = targets.sparkSession.createDataFrame([(i, fit[f"instance={i}"] if f"instance={i}" in fit.names else 0.0) for i in sorted(instances)], "instance string, shift double")
    grid = targets.crossJoin(F.broadcast(known))
    linear_part = F.lit(fit["Intercept"]) + F.lit(fit["log_ppl_indep"]) * F.col("log_ppl_indep") + F.lit(fit["length"]) * F.col("length") + F.col("shift")
    return grid.select("stratum", "instance", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear_part)), 4).alias("fpr_pred"))


def commit_forecast(grid: DataFrame, path: str | Path) -> str:
    """Writes the forecast once and its SHA-256 beside it; returns the digest."""
    path = Path(path)
    if path.exists():
        raise FileExistsError(f"{path}: a forecast is committed once")
    predictions: dict[str, dict[str, float]] = {}
    for r in grid.collect():
        predictions.setdefault(r.stratum, {})[r.instance] = r.fpr_pred
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"predictions": predictions, "provenance": config.provenance()}, indent=1, sort_keys=True), encoding="utf-8")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    path.with_suffix(".sha256").write_text(digest + "\n")
    return digest


def reveal_forecast(spark, path: str | Path, cells: DataFrame) -> DataFrame:
    """stratum, instance, fpr_pred, fpr, abs_error; refuses a file that is not the committed one."""
    path = Path(path)
    if hashlib.sha256(path.read_bytes()).hexdigest() != path.with_suffix(".sha256").read_text().strip():
        raise ValueError("the forecast does not match its committed hash")
    rows = [(s, i, p) for s, own in json.loads(path.read_text())["predictions"].items() for i, p in own.items()]
    predicted = spark.createDataFrame(rows, "stratum string, instance string, fpr_pred double")
    return forecast_errors(predicted, cells)


def forecast_errors(predicted: DataFrame, cells: DataFrame) -> DataFrame:
    return predicted.join(cells.select("stratum", "instance", "fpr"), ["stratum", "instance"]).withColumn("abs_error", F.abs(F.col("fpr_pred") - F.col("fpr")))


def errors_by_family(errors: DataFrame) -> DataFrame:
    """family, n, mae: the forecast's mean absolute error over trained and zero-shot instances."""
    family = metrics.family_of(F.split("instance", "@")[0])
    return errors.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"))


# audit ----------------------------------------------------------------------------------------------------------------

_AUDIT_X = lambda: [F.lit(1.0), F.col("log_ppl_indep"), F.col("n_tokens") / 100.0]


def audit_predictions(doc_table: DataFrame, fits: dict[str, linear.Fit]) -> DataFrame:
    """instance, stratum, observed and predicted logit of the flag rate."""
    table = F.create_map(*(v for g, f in fits.items() for v in (F.lit(g), F.array(*(F.lit(float(c)) for c in f.coef)))))
    eta = sum((table[F.col("instance")][i] * x for i, x in enumerate(_AUDIT_X())), F.lit(0.0))
    cells = doc_table.withColumn("_p", 1 / (1 + F.exp(-eta))).groupBy("instance", "stratum").agg(F.sum("flagged").alias("k"), F.count(F.lit(1)).alias("n"), F.avg("_p").alias("p"))
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("p")))
    return cells.select("instance", "stratum", metrics.empirical_logit(F.col("k"), F.col("n")).alias("observed"), F.log(p / (1 - p)).alias("predicted"))


def fit_audit(doc_table: DataFrame) -> dict:
    """Per instance a logistic model of flags on log perplexity and length, its covariance, and the spread of strata around it."""
    rows = doc_table.dropna(subset=["log_ppl_indep"])
    fits = linear.logistic_by(rows, "instance", "flagged", _AUDIT_X())
    spread = {r.instance: r for r in audit_predictions(rows, fits).groupBy("instance").agg(F.stddev_samp(F.col("observed") - F.col("predicted")).alias("sd"), F.count(F.lit(1)).alias("n")).collect()}
    return {
        i: {"coef": f.coef.tolist(), "cov": f.cov.tolist(), "population_sd_logit": float(spread[i].sd) if spread[i].n > 2 else 0.0, "n_docs": f.n, "n_populations": spread[i].n} for i, f in fits.items()
    }


def held_out_misses(doc_table: DataFrame) -> DataFrame:
    """instance, stratum, miss: how far a stratum's logit lies from a model of the others. All models are fitted at once, each row in all but its own stratum's."""
    rows = doc_table.dropna(subset=["log_ppl_indep"])
    strata = [r[0] for r in rows.select("stratum").distinct().collect()]
    name = lambda stratum: F.concat_ws("|", "instance", stratum)
    folds = F.filter(F.array(*map(F.lit, strata)), lambda x: x != F.col("stratum"))
    fits = linear.logistic_by(rows.withColumn("held", F.explode(folds)).withColumn("fold", name("held")), "fold", "flagged", _AUDIT_X())
    own = rows.withColumn("real", F.col("instance")).withColumn("instance", name("stratum")).filter(F.col("instance").isin(*fits))
    return audit_predictions(own, fits).select(F.split_part("instance", F.lit("|"), F.lit(1)).alias("instance"), "stratum", F.abs(F.col("observed") - F.col("predicted")).alias("miss"))


def conformal_pick(misses: DataFrame, level: float = 0.95) -> DataFrame:
    """n, width: of the misses (miss) the one at the rank that covers a new case."""
    ranked = misses.select("miss", F.row_number().over(Window.orderBy("miss")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    rank = F.least(F.col("n") - 1, F.ceil(F.round((F.col("n") + 1) * F.lit(level), 9)) - 1)
    return ranked.filter(F.col("i") - 1 == rank).select("n", F.col("miss").alias("width"))


def conformal_width(doc_table: DataFrame, level: float = 0.95) -> float:
    """Half width on the logit scale that covers a population the model has not seen: each stratum is held out in turn."""
    return conformal_pick(held_out_misses(doc_table), level).first()["width"]


MAX_AUDIT_TEXTS = 200_000


def audit_estimate(features: DataFrame, model: dict, width: float | None = None, draws: int = 2000, seed: int = 0) -> dict:
    """Estimated flag rate of a caller's texts (log_ppl_indep, n_tokens) with its interval and warnings; no verdict on one text.

    A draw takes coefficients, a shift of the population and a sample of the texts, which is a multinomial weight of each.
    An audit's texts are few thousand at most; more than MAX_AUDIT_TEXTS are refused.
    """
    rows = features.select("log_ppl_indep", "n_tokens").dropna().limit(MAX_AUDIT_TEXTS + 1).toPandas()
    n = len(rows)
    if n > MAX_AUDIT_TEXTS or not n:
        raise ValueError(f"an audit takes 1 to {MAX_AUDIT_TEXTS} texts")
    x = np.column_stack([np.ones(n), rows["log_ppl_indep"].to_numpy(float), rows["n_tokens"].to_numpy(float) / 100])
    rng = np.random.default_rng(seed)
    betas = rng.multivariate_normal(model["coef"], model["cov"], size=draws)
    shifts = model["population_sd_logit"] * rng.standard_t(max(model["n_populations"] - 1, 1), size=draws)
    step = max(1, 2_000_000 // n)
    simulated = np.concatenate([
        (rng.multinomial(n, np.full(n, 1 / n), size=len(betas[k : k + step])) / n * _sigmoid(betas[k : k + step] @ x.T + shifts[k : k + step, None])).sum(axis=1) for k in range(0, draws, step)
    ])
    point = float(_sigmoid(x @ np.array(model["coef"])).mean())
    band = np.quantile(simulated, [0.025, 0.975]).tolist()
    if width is not None:
        low, high = conformal_band(point, width)
        band = [min(band[0], low), max(band[1], high)]
    said = {"texts outside the studied lengths": not rows["n_tokens"].between(config.MIN_TOKENS, config.MAX_TOKENS).all(), "fewer than 30 texts": n < 30}
    return {"n_texts": n, "estimate": point, "low": band[0], "high": band[1], "warnings": [text for text, holds in said.items() if holds]}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def conformal_band(point: float, width: float) -> tuple[float, float]:
    p = min(max(point, 1e-4), 1 - 1e-4)
    centre = math.log(p / (1 - p))
    return 1 / (1 + math.exp(width - centre)), 1 / (1 + math.exp(-width - centre))


# release --------------------------------------------------------------------------------------------------------------


def wide_scores(scores: DataFrame, docs: DataFrame, flags: DataFrame, instances: list[str]) -> DataFrame:
    """One row per document: its scores and flags by instance; one score per document and instance."""
    doubled = scores.groupBy("item_id", "instance").count().filter("count > 1")
    if not doubled.isEmpty():
        raise ValueError("a document has two scores of one instance")
    name = {i: i.replace("@", "_") for i in instances}
    s = scores.groupBy("item_id").pivot("instance", instances).agg(F.first("score"))
    f = flags.groupBy("item_id").pivot("instance", instances).agg(F.first("flagged"))
    s = s.select(F.col("item_id").alias("doc_id"), *(F.col(f"`{i}`").alias(f"score_{name[i]}") for i in instances))
    f = f.select(F.col("item_id").alias("doc_id"), *(F.col(f"`{i}`").alias(f"flag_{name[i]}") for i in instances))
    return docs.join(s, "doc_id").join(f, "doc_id", "left")


def population_summary(docs: DataFrame, ppl: DataFrame, bins) -> DataFrame:
    """stratum, n, mean_tokens, mean_log_ppl and the number of documents in each length band."""
    rows = docs.join(ppl, docs["doc_id"] == ppl["item_id"], "left").withColumn("_b", bins)
    return rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean_tokens"), F.avg("log_ppl_indep").alias("mean_log_ppl"), *(F.count_if(F.col("_b") == b).alias(f"band{b}_docs") for b in range(config.LENGTH_BINS))
    )
