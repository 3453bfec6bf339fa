import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import attribution, dedup, metrics, sample, scoring
from siftwell.runtime import Scratch


def scores(spark, n=200):
    rng = random.Random(2)
    rows = [("D5", f"h{i}", "S6", -rng.gauss(0, 1)) for i in range(n)] + [("D5", f"c{i}", "control", -rng.gauss(4, 1)) for i in range(n)]
    rows += [("D4", f"h{i}", "S6", rng.gauss(0, 1)) for i in range(n)] + [("D4", f"c{i}", "control", rng.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "instance string, item_id string, group_name string, score double")


def test_gate_run_flips_and_drops(spark):
    df = scores(spark)
    own = df.filter("group_name = 'S6'").select("item_id", F.lit("S6").alias("stratum")).distinct()
    flags = metrics.gate_run(df, own)
    assert {r[0] for r in flags.select("instance").distinct().collect()} == {"D5"}
    assert abs(flags.agg(F.avg("flagged")).first()[0] - 0.05) < 0.01
    assert {r[0] for r in metrics.gate_run(df, own, gated=False).select("instance").distinct().collect()} == {"D4", "D5"}
    with pytest.raises(ValueError):
        metrics.gate_run(df.filter("instance = 'D4'"), own)


def test_length_batches(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.choice([None, rng.randrange(900)])) for i in range(400)], "i int, n_tokens int")
    rows = scoring.length_batches(df, 3).withColumn("pid", F.spark_partition_id()).collect()
    assert sorted(r.i for r in rows) == list(range(400))
    held = {}
    for r in rows:
        held.setdefault((r.pid, r.batch), []).append(max(1, min(r.n_tokens or 0, 512)))
    assert all(len(v) == 1 or len(v) * max(v) <= 4096 for v in held.values())
    assert len(held) < 60


def test_precondition(spark):
    rng = random.Random(4)
    rows = [(f"s{s}-{i}", f"S{s}", r, int(rng.random() < (0.5 if (s + r) % 2 else 0.1))) for s in range(4) for i in range(80) for r in range(2)]
    df = spark.createDataFrame(rows, "item_id string, stratum string, reference int, flagged int")
    shift = attribution.precondition(df, replicates=300)
    assert shift["estimable"] and attribution.guarded(shift, "CONFIRMED") == "CONFIRMED"
    none = attribution.precondition(df.filter("reference = 0"), replicates=300)
    assert attribution.guarded(none, "CONFIRMED") == "NOT ESTIMABLE"


def test_pairs_of_a_hot_bucket(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("doc_id"), F.array(F.lit(1), F.lit(2), F.lit(3), F.col("id").cast("int")).alias("sig"))
    for block in (7, 256):
        pairs = dedup.candidate_pairs(df, bands=2, slots=4, block=block)
        assert pairs.count() == 300 * 299 // 2 and pairs.filter("doc_a >= doc_b").isEmpty()


def test_group_order_and_one_of_each(spark):
    df = spark.createDataFrame([(g, f"{g}{i}") for g in ("a", "b", None) for i in range(4)], "g string, k string")
    places = {r.g: r.place for r in sample.shuffled_groups(df, "g", Scratch(spark, "t")).collect()}
    assert sorted(places.values()) == [0, 1, 2] and set(places) == {"a", "b", None}
    assert {r.g for r in sample.one_of_each(df, "g", "k").collect()} == {"a", "b"}
