"""Document scores from token statistics, the score table, and what may be scored when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.config import FORECAST


def contrast(stats: DataFrame) -> DataFrame:
    """doc_id, score, n_tokens: (sum logp - sum mu) / sqrt(sum var), the variance at least 1e-8."""
    logp, mu, var = (F.sum(F.col(c).cast("double")) for c in ("logp", "mu", "var"))
    return stats.groupBy("doc_id").agg(((logp - mu) / F.sqrt(F.greatest(var, F.lit(1e-8)))).alias("score"), F.count(F.lit(1)).alias("n_tokens"))


def log_perplexity(stats: DataFrame) -> DataFrame:
    """doc_id, score, n_tokens: the mean negative log probability."""
    return stats.groupBy("doc_id").agg((-F.avg(F.col("logp").cast("double"))).alias("score"), F.count(F.lit(1)).alias("n_tokens"))


def ratio(stats: DataFrame) -> DataFrame:
    """doc_id, score, n_tokens: minus the ratio of the mean cross entropies, the lower at least 1e-8."""
    ce, xent = F.avg(F.col("ce").cast("double")), F.avg(F.col("xent").cast("double"))
    return stats.groupBy("doc_id").agg((-ce / F.greatest(xent, F.lit(1e-8))).alias("score"), F.count(F.lit(1)).alias("n_tokens"))


def surface(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float, float, float] = (-4.0, 0.8, 6.0, -1.5), keep: list[str] = ()) -> DataFrame:
    """doc_id, score (and the columns to keep): a logistic score of mean word length, punctuation rate and share of distinct words."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[ \t\n\f\r]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    marks = F.length(F.regexp_replace(F.col(text_col), r"[^,.;:!?]", "")) / F.greatest(F.length(text_col), F.lit(1))
    z = weights[0] + weights[1] * letters / n + weights[2] * marks + weights[3] * F.size(F.array_distinct(words)) / n
    return df.select(F.col(id_col).alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"), *keep)


def score_rows(scores: DataFrame, instance: str, group: str | Column, run: str, config_hash: str) -> DataFrame:
    """Scores of one instance as rows of the score table, of one group or with a column that names each one's; detectors without token counts have null there."""
    detector, _, reference = instance.partition("@")
    n = F.col("n_tokens").cast("int") if "n_tokens" in scores.columns else F.lit(None).cast("int")
    return scores.select(
        F.col("doc_id").cast("string").alias("item_id"), F.col("score").cast("double").alias("score"), n.alias("n_tokens"), F.lit(instance).alias("instance"), F.lit(detector).alias("detector"),
        F.lit(reference or None).cast("string").alias("reference"), F.lit(group).alias("group_name"), F.lit(run).alias("run_id"), F.lit(config_hash).alias("config_hash"),
    )


def union_scores(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def groups(docs: DataFrame, control: DataFrame, variants: DataFrame) -> DataFrame:
    """item_id, text, group_name of everything to be scored: the strata's documents (doc_id, stratum, text), generated texts
    (doc_id, text) and edited ones (variant_id, text)."""
    item = lambda c: F.col(c).cast("string").alias("item_id")
    return (
        docs.select(item("doc_id"), "text", F.col("stratum").alias("group_name"))
        .unionByName(control.select(item("doc_id"), "text", F.lit("control").alias("group_name")))
        .unionByName(variants.select(item("variant_id"), "text", F.lit("variants").alias("group_name")))
    )


def length_batches(df: DataFrame, partitions: int, length: str = "n_tokens", budget: int = 4096, truncate: int = 512) -> DataFrame:
    """df with `batch`: rows of like length together, so that a batch, padded to its longest row (at most `truncate`), stays
    within the budget of tokens. Rows are range-partitioned by length; a batch never spans two partitions.

    A model is then applied batch by batch with mapInPandas or mapInArrow, which see the rows in this order.
    """
    rows = df.withColumn("_n", F.greatest(F.lit(1), F.least(F.coalesce(F.col(length), F.lit(0)), F.lit(truncate)))).repartitionByRange(partitions, "_n").sortWithinPartitions(F.desc("_n"))

    def number(batches):
        import pyarrow as pa

        batch = held = longest = 0
        for rows_ in batches:
            numbers = []
            for n in rows_.column(rows_.schema.get_field_index("_n")).to_pylist():
                if held and (held + 1) * max(longest, n) > budget:
                    batch, held, longest = batch + 1, 0, 0
                held, longest = held + 1, max(longest, n)
                numbers.append(batch)
            names = [c for c in rows_.schema.names if c != "_n"]
            yield pa.RecordBatch.from_arrays([*(rows_.column(rows_.schema.get_field_index(c)) for c in names), pa.array(numbers, pa.int32())], [*names, "batch"])

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*df.schema.fields]).add("batch", IntegerType())
    return rows.mapInArrow(number, schema)


def latest_scores(df: DataFrame, *, item_col: str = "item_id", score_col: str = "score", instance_col: str = "instance", group_col: str = "group_name", run_col: str = "run_id") -> DataFrame:
    """instance, item_id, group_name, score: per instance and item the row of the greatest run with a usable score.

    Null and NaN scores and null items are passed over. A null run comes before all others; ties go to the greater group,
    then the greater score. One aggregation with partial results before the shuffle, so a hot item costs nothing extra.
    """
    rows = df.select(
        F.col(instance_col).cast("string").alias("instance"), F.col(item_col).cast("string").alias("item_id"), F.col(group_col).cast("string").alias("group_name"),
        F.col(score_col).cast("double").alias("score"), F.col(run_col).cast("string").alias("run"),
    ).filter(F.col("item_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    last = rows.groupBy("instance", "item_id").agg(F.max(F.struct("run", "group_name", "score")).alias("last"))
    return last.select("instance", "item_id", "last.group_name", F.expr("last.score + 0.0D").alias("score"))


def may_score(group: str, *, registered: bool, forecast_committed: bool, predictor: bool = False) -> None:
    """Refuses what would spoil the study: anything but the control before registration, held-out groups before the forecast."""
    if not registered and group != "control":
        raise PermissionError(f"{group} may not be scored before the registration")
    if group in FORECAST and not forecast_committed and not predictor:
        raise PermissionError(f"{group} may not be scored by a detector before the forecast is committed")


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that no earlier run finished."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, max_diff_sd, spearman of two runs' scores (doc_id, score): the greatest difference in SDs and the rank correlation."""
    both = a.select("doc_id", F.col("score").alias("x")).join(b.select("doc_id", F.col("score").alias("y")), "doc_id")
    ranked = mid_ranks(mid_ranks(both, [], "x", "rx"), [], "y", "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("x") - F.col("y"))) / F.stddev_samp("x")).alias("max_diff_sd"), F.corr("rx", "ry").alias("spearman"))


def mid_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the mean rank of ties: from counts of distinct values, so that a sort sees each value once per group."""
    from pyspark.sql import Window

    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*by, value])
