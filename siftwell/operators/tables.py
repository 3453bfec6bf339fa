"""The analysis tables: one row per instance and document, one per instance and stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.columns import fold
from siftwell.operators.metrics import empirical_logit, family_of, flag


def document_table(scores: DataFrame, thresholds: DataFrame, predictor: DataFrame, docs: DataFrame) -> DataFrame:
    """Flags of detector instances with a threshold, with the predictor's log perplexity (item_id, log_ppl_indep) and the
    document's stratum and length; scores of unknown documents drop out. The scorer's own token count is not taken over."""
    flagged = flag(scores.filter(F.col("instance").rlike(r"^D\d(@|$)")), thresholds)
    own = docs.select(F.col("doc_id").alias("item_id"), "stratum", "n_tokens")
    joined = flagged.join(own, "item_id").join(predictor, "item_id", "left")
    parts = F.split("instance", "@")
    return joined.select("instance", parts[0].alias("detector"), F.get(parts, F.lit(1)).alias("reference"), "item_id", "stratum", "score", "threshold", "flagged", "log_ppl_indep", "n_tokens")


def cell_table(doc_table: DataFrame, own_ppl: DataFrame | None = None) -> DataFrame:
    """Rates and means per instance, detector, reference (null for trained ones) and stratum; own_ppl: (reference, stratum, log_ppl_ref)."""
    cells = doc_table.groupBy("instance", "detector", "reference", "stratum").agg(
        F.avg("flagged").alias("fpr"), F.count(F.lit(1)).alias("n"), F.sum("flagged").alias("k"), F.avg("log_ppl_indep").alias("log_ppl_indep"), F.avg("n_tokens").alias("length")
    )
    if own_ppl is not None:
        cells = cells.join(own_ppl, ["reference", "stratum"], "left")
    return cells.withColumn("family", family_of(F.col("detector"))).withColumn("logit_fpr", empirical_logit(F.col("k"), F.col("n")))


def covariate(overlap: DataFrame) -> DataFrame:
    """reference, stratum, sip: the declared overlap as a number; what is no number is null."""
    return overlap.select(F.upper(fold(F.col("reference"))).alias("reference"), F.upper(fold(F.col("stratum"))).alias("stratum"), F.trim("source_in_pretraining").try_cast("double").alias("sip"))


def deltas(scores: DataFrame, variants: DataFrame, predictor: DataFrame, calibration: str = "S6") -> DataFrame:
    """instance, variant_id, doc_id, edit, intensity, dz, dlogppl: changes against the unedited document, the score's in
    standard deviations of the instance over the calibration group. scores: (instance, item_id, group_name, score)."""
    source = scores.filter(F.col("group_name") == calibration)
    spread = source.groupBy("instance").agg(F.stddev_samp("score").alias("sd"))
    before = source.select("instance", F.col("item_id").alias("doc_id"), F.col("score").alias("score_before"))
    edited = scores.filter(F.col("group_name") == "variants").join(variants.select(F.col("variant_id").alias("item_id"), "doc_id", "edit", "intensity"), "item_id")
    known = predictor.select("item_id", "log_ppl_indep")
    rows = edited.join(before, ["instance", "doc_id"]).join(spread, "instance").join(known, "item_id")
    rows = rows.join(known.select(F.col("item_id").alias("doc_id"), F.col("log_ppl_indep").alias("before")), "doc_id")
    out = rows.select("instance", F.col("item_id").alias("variant_id"), "doc_id", "edit", "intensity", ((F.col("score") - F.col("score_before")) / F.col("sd")).alias("dz"), (F.col("log_ppl_indep") - F.col("before")).alias("dlogppl"))
    return out.dropna(subset=["dz", "dlogppl"])
