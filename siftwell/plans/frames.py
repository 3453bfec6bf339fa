"""DataFrames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.columns import fold, ruler
from siftwell.operators import lm, scoring, tables
from siftwell.operators.metrics import flag
from siftwell.runtime import Scratch, spread, table


def docs(spark: SparkSession, d: str, text: bool = True) -> DataFrame:
    """One row per record of candidates, with its length; without `text`, only what is computed from it is shuffled."""
    rows = table(spark, d, "candidates")
    columns = ["doc_id", "stratum", fold(F.col("source")).alias("source"), fold(F.col("source_doc_id")).alias("source_doc_id"), "pub_year", *(["text"] if text else []), "meta", ruler(F.col("text")).alias("n_tokens"), "text_sha256"]
    return rows.select(*columns).dropDuplicates(["doc_id"])


def latest(spark: SparkSession, d: str) -> DataFrame:
    return scoring.latest_scores(table(spark, d, "scores"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of known documents with stratum and length."""
    own = docs(spark, d, text=False).select(F.col("doc_id").alias("item_id"), "stratum", "n_tokens")
    return flag(latest(spark, d).select("instance", "item_id", "score"), table(spark, d, "thresholds")).join(own, "item_id")


def predictor(spark: SparkSession, d: str) -> DataFrame:
    """item_id, log_ppl_indep: log perplexity of records under an add-one unigram model of all documents."""
    training = lm.token_lists(spread(table(spark, d, "documents").select("doc_id", "text"))).select(F.explode("w").alias("v"))
    counts = training.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    own = lm.token_lists(docs(spark, d)).select("doc_id", F.explode("w").alias("v")).groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("t"))
    scratch = Scratch(spark, "predictor")
    own = scratch.keep(own, "tokens")
    vocabulary = counts.select("v").unionByName(own.select("v")).distinct().count()
    size = float((counts.agg(F.sum("c")).first()[0] or 0) + vocabulary)
    logs = own.join(counts, "v", "left").withColumn("l", F.log((F.coalesce("c", F.lit(0)) + 1) / F.lit(size)))
    return logs.groupBy(F.col("doc_id").alias("item_id")).agg((-F.sum(F.col("t") * F.col("l")) / F.sum("t")).alias("log_ppl_indep"))


def document_table(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "doctable")
    full = tables.document_table(latest(spark, d).select("instance", "item_id", "score"), table(spark, d, "thresholds"), predictor(spark, d), docs(spark, d, text=False))
    return scratch.keep(full, "rows")


def cell_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.cell_table(document_table(spark, d))


def cells_with_reference(spark: SparkSession, d: str, doc_table: DataFrame) -> DataFrame:
    """Cells with a perplexity of the reference: the mean score of its first detector, standing in for a model's own."""
    own = doc_table.filter(F.col("detector") == "D1").groupBy("reference", "stratum").agg((-F.avg("score")).alias("log_ppl_ref"))
    return tables.cell_table(doc_table, own)


FOLDS = 3


def language_models(spark: SparkSession, d: str) -> tuple[DataFrame, lm.Bigrams]:
    """(token lists of all documents, models by fold): each model is trained on a third of the documents."""
    scratch = Scratch(spark, "models")
    lists = scratch.keep(lm.token_lists(spread(table(spark, d, "documents").select("doc_id", "text"))).withColumn("fold", F.pmod("doc_id", F.lit(FOLDS)).cast("int")), "lists")
    return lists, lm.train(lists, lists, scratch)


def scored_by(lists: DataFrame, reference: int) -> DataFrame:
    """Lists with the fold that scores them as reference 1 or 2: never the one that holds the document."""
    return lists.withColumn("fold", F.pmod(F.col("doc_id") + reference, F.lit(FOLDS)).cast("int"))
