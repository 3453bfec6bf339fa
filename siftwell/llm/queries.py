"""Queries over the project's tables for the operators of this subpackage, and SQL for those SQL can state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions.columns import token_count
from siftwell.llm import caps, cutoffs, leakage, mixing, neardup, proportions, residue, splitting
from siftwell.llm.sql import SQL as SQL
from siftwell.runtime import table


def _near(spark, d):
    return neardup.near_duplicates(table(spark, d, "candidates"), similarity="0.75")


def p1_found(spark, d):
    """Pairs of records of one stratum whose five-word sequences have a Jaccard similarity of 0.75 or more."""
    return neardup.duplicate_pairs(*_near(spark, d))


def p1_groups(spark, d):
    """Every record with its class of equal sets, its group of near-duplicates and its number of links."""
    return neardup.duplicate_groups(*_near(spark, d))


def p2_found(spark, d):
    """Records that hold template residue, filler or an error, refusal or script notice."""
    return residue.template_residue(table(spark, d, "candidates")).select("doc_id")


def p2_kept(spark, d):
    """Records left after those with residue are taken out, counted by stratum."""
    rows = table(spark, d, "candidates").select("doc_id", "stratum").distinct()
    bad = residue.template_residue(table(spark, d, "candidates"))
    marked = rows.join(bad.select("doc_id", F.lit(1).alias("bad")), "doc_id", "left")
    return marked.groupBy("stratum").agg(F.count(F.lit(1)).alias("records"), F.count("bad").alias("excluded"), F.count_if(F.col("bad").isNull()).alias("kept"))


def _sampled(spark, d):
    return proportions.proportional_sample(table(spark, d, "candidates"), table(spark, d, "sample_targets"))


def p3_found(spark, d):
    """Targets for which fewer records exist than their minimum or share asks for."""
    return _sampled(spark, d)[1].filter("short").select("stratum", "category")


def p3_sample(spark, d):
    """The records drawn."""
    return _sampled(spark, d)[0]


def p3_report(spark, d):
    """Quotas, records taken and shares reached of every target."""
    return _sampled(spark, d)[1]


def p3_needs(spark, d):
    """What every target needs and what there is."""
    return _sampled(spark, d)[1].select("stratum", "category", "size", "available", "needed", "short")


def p3_totals(spark, d):
    """Sizes of the samples by stratum: wanted, as quotas, and as drawn."""
    sample, report = _sampled(spark, d)
    drawn = sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("records"))
    return report.groupBy("stratum").agg(F.first("size").alias("size"), F.sum("quota").alias("drawn")).join(drawn, "stratum", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def _capped(spark, d, **how):
    return caps.capped(table(spark, d, "candidates"), caps.latest_rating(table(spark, d, "doc_quality")), **how)


def p4_found(spark, d):
    """Records beyond the five best of their contributor."""
    return _capped(spark, d).filter("not kept").select("doc_id")


def p4_kept(spark, d):
    """The candidates of kept records, whole."""
    kept = _capped(spark, d).filter("kept").select("doc_id")
    return table(spark, d, "candidates").join(kept, "doc_id", "left_semi")


def p4_share(spark, d):
    """Records beyond a contributor share of one percent of the stratum."""
    return _capped(spark, d, limit=None, max_share=0.01).filter("not kept").select("doc_id")


def _cut(spark, d):
    return cutoffs.cutoffs(cutoffs.latest_scores(table(spark, d, "scores")), table(spark, d, "keep_targets"))


def p5_found(spark, d):
    """Items above the cutoff of their instance and group."""
    return _cut(spark, d)[1].filter("not kept").select("instance", "item_id")


def p5_report(spark, d):
    """Cutoffs and kept sizes per instance and group."""
    return _cut(spark, d)[0]


def _leaks(spark, d, **how):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), **how)


def p6_found(spark, d):
    """Documents and the evaluation items with which they share twelve words in a row."""
    return _leaks(spark, d).selectExpr("cast(doc_id as bigint) as doc_id", "cast(item_id as bigint) as item_id").distinct()


def p6_runs(spark, d):
    """Every shared run with its places and length."""
    return _leaks(spark, d)


def p6_near(spark, d):
    """Documents in which most of an item's rarer words stand close together, in whatever order."""
    return _leaks(spark, d, proximity_window=80)


def _mixed(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_found(spark, d):
    """Sources that cannot reach their share."""
    return _mixed(spark, d)[1].filter("short").select("source")


def p7_mixture(spark, d):
    """The slots of the mixture with the documents' segments they hold."""
    return _mixed(spark, d)[0]


def p7_report(spark, d):
    """Wanted and reached tokens and shares per source."""
    return _mixed(spark, d)[1]


def p7_slots(spark, d):
    """The slots that each source fills in the mixture."""
    manifest, report = _mixed(spark, d)
    filled = manifest.groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    return report.join(filled, "source", "left").select("source", "tokens", F.round("wanted", 6).alias("wanted"), F.coalesce("slots", F.lit(0)).alias("slots"), "short")


def _split(spark, d):
    return splitting.split_oversized(table(spark, d, "documents"), table(spark, d, "split_limits"))


def p8_found(spark, d):
    """Documents larger than their source's limit."""
    return _split(spark, d).filter("piece = 0").selectExpr("cast(doc_id as bigint) as doc_id")


def p8_pieces(spark, d):
    """Their pieces."""
    return _split(spark, d)


def p8_checks(spark, d):
    """Whether the pieces of each document hold its limit, cover it, and share what they should."""
    own = Window.partitionBy("doc_id").orderBy("piece")
    rows = _split(spark, d).withColumn("before", F.lag("end_token").over(own))
    shared = F.least(F.least("overlap_tokens", F.col("max_tokens") - 1), F.col("before"))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.first("doc_tokens").alias("doc_tokens"), F.bool_and(F.col("n_tokens").between(1, F.col("max_tokens")) & (token_count(F.col("text")) == F.col("n_tokens"))).alias("fits"),
        ((F.min("start_token") == 0) & (F.max("end_token") == F.first("doc_tokens")) & (F.count(F.lit(1)) == F.first("pieces"))).alias("covers"),
        F.bool_and(F.col("before").isNull() | (F.col("before") - F.col("start_token") == shared)).alias("overlaps"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_kept": p2_kept,
    "p3_found": p3_found,
    "p3_sample": p3_sample,
    "p3_report": p3_report,
    "p3_needs": p3_needs,
    "p3_totals": p3_totals,
    "p4_found": p4_found,
    "p4_kept": p4_kept,
    "p4_share": p4_share,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_runs": p6_runs,
    "p6_near": p6_near,
    "p7_found": p7_found,
    "p7_mixture": p7_mixture,
    "p7_report": p7_report,
    "p7_slots": p7_slots,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
    "p8_checks": p8_checks,
}
