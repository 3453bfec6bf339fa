"""Estimates the flag rate of a population of texts: python -m siftwell.cli --texts PATH --reference PATH --model JSON --instance NAME."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.columns import ruler
from siftwell.operators import lm, report, scoring
from siftwell.runtime import Scratch, build_session
from siftwell.sources import readers


def features(spark: SparkSession, texts: DataFrame, reference: DataFrame) -> DataFrame:
    """log_ppl_indep, n_tokens of texts (text) under a bigram model of the reference's texts."""
    scratch = Scratch(spark, "features")
    rows = scratch.keep(texts.select(F.concat(F.lit("u"), F.monotonically_increasing_id()).alias("doc_id"), "text"), "texts")
    training = reference.select(F.lit("r").alias("doc_id"), "text")
    lists = lm.token_lists(rows)
    model = lm.train(lists.unionByName(lm.token_lists(training)), lm.token_lists(training), scratch)
    ppl = scoring.log_perplexity(lm.token_stats(lists, model)).select("doc_id", F.col("score").alias("log_ppl_indep"))
    return rows.join(ppl, "doc_id").select("log_ppl_indep", ruler(F.col("text")).alias("n_tokens"))


def main(args: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("texts", "reference", "model", "instance"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--master")
    given = parser.parse_args(args)
    spark = SparkSession.getActiveSession() or build_session("audit", given.master)
    model = json.loads(Path(given.model).read_text())
    rows = features(spark, readers.texts(spark, given.texts), readers.texts(spark, given.reference))
    out = report.audit_estimate(rows, model["instances"][given.instance], model.get("conformal_q_logit"))
    print(json.dumps(out, indent=1))
    return out


if __name__ == "__main__":
    main()
