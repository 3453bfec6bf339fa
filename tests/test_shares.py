"""share_intervals: its bootstrap against brute force, its document sums against token statistics, and what it shuffles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import attribution, lm
from siftwell.plans import analysis, frames
from siftwell.runtime import Scratch

NAMES = ["nll", "entropy", "var"]


def score(c):
    return attribution.contrast_score(c | {"n": F.col("n")})


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    stratum = rng.choice([1, 2, 6], 900, p=[0.3, 0.2, 0.5])
    n, nll, var = rng.integers(150, 400, 900).astype(float), rng.normal(3, 0.3, 900), rng.lognormal(1, 0.1, 900)
    entropy = nll + rng.normal(-0.15, 0.12, 900)
    moved = entropy + 0.02 + np.where(stratum == 1, 0.08, np.where(stratum == 2, -0.05, 0.0)) + rng.normal(0, 0.02, 900)
    return [(f"d{i}", f"S{s}", *map(float, own)) for i, (s, *own) in enumerate(zip(stratum, n, nll, entropy, var, nll + 0.02, moved, var * 1.1, strict=True))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, stratum string, n double, " + ", ".join(f"{s}_{c} double" for s in "bt" for c in NAMES))


def test_profiles_have_the_distribution_of_resampled_documents(frame, rows):
    drawn = attribution.bootstrap_profiles(frame, NAMES, score, 1000).toPandas()
    assert len(drawn) == 1000 * 8 * 2 and not drawn.duplicated(["b", "mask", "stratum"]).any()
    stratum, values, rng = np.array([r[1] for r in rows]), np.array([r[2:] for r in rows]), np.random.default_rng(1)
    n, parts = values[:, 0], values[:, 1:].reshape(-1, 2, 3)
    mixed = {mask: (c := [parts[:, mask >> i & 1, i] for i in range(3)]) and np.sqrt(n) * (c[1] - c[0]) / np.sqrt(c[2]) for mask in range(8)}
    wanted = {(mask, s): [] for mask in range(8) for s in ("S1", "S2")}
    for _ in range(1000):
        pick = np.concatenate([rng.choice(np.flatnonzero(stratum == s), (stratum == s).sum()) for s in ("S1", "S2", "S6")])
        for mask, own in mixed.items():
            flagged = own[pick] > np.quantile(own[pick][stratum[pick] == "S6"], 0.95, method="higher")
            for s in ("S1", "S2"):
                wanted[mask, s].append(flagged[stratum[pick] == s].mean())
    wide = drawn.pivot(index="b", columns=["mask", "stratum"], values="rate")
    keys = sorted(wanted)
    ours, theirs = wide[keys].to_numpy(), np.array([wanted[k] for k in keys]).T
    sd = theirs.std(0)
    assert (np.abs(ours.mean(0) - theirs.mean(0)) < 0.2 * sd + 1e-12).all() and (np.abs(ours.std(0) / sd - 1) < 0.15).all()
    assert np.abs(np.corrcoef(ours.T) - np.corrcoef(theirs.T)).max() < 0.15


def test_thresholds_outside_their_ends_are_drawn_again(frame):
    mixed = attribution.mixed_scores(frame, NAMES, score)
    narrow, wide = (attribution.bootstrap_thresholds(mixed, "S6", 0.05, 200, sigmas=s) for s in (0.01, 8))
    assert np.isfinite(narrow).all() and np.abs(narrow.mean(0) - wide.mean(0)).max() < 0.3 * wide.std(0).max()
    assert attribution.bootstrap_thresholds(mixed, "S99", 0.05, 5).size == 0
    assert not attribution.bootstrap_profiles(frame.filter("stratum <> 'S6'"), NAMES, score, 5).collect()


def test_scores_without_a_value(spark):
    data = [(f"c{i}", "S6", float(i)) for i in range(40)] + [("x", "S6", None)] * 20 + [(f"t{i}", "S1", v) for i, v in enumerate([None, math.nan, 1e9, -1e9])]
    df = spark.createDataFrame([(k, s, v, v) for k, s, v in data], "doc_id string, stratum string, b_a double, t_a double")
    out = attribution.bootstrap_profiles(df, ["a"], lambda c: c["a"], 400).groupBy("mask").agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in out} == {400} and all(abs(r.rate - 0.5) < 0.06 for r in out)


def test_bootstrap_shuffles_no_row_per_replicate_and_document(frame):
    before = shuffled(frame.sparkSession)
    attribution.share_intervals(attribution.bootstrap_shares(frame, NAMES, score, 300)).collect()
    assert shuffled(frame.sparkSession) - before < 2_000_000


def test_query_shuffles_a_few_times_its_text(spark):
    before = shuffled(spark)
    out = analysis.share_intervals(spark, "/root/testdata/sf0.001").collect()
    assert {r.component for r in out} == set(NAMES) and all(r.low <= r.high for r in out)
    assert shuffled(spark) - before < 6_000_000


def test_document_sums_equal_token_statistics(spark):
    rng = np.random.default_rng(5)
    words = ["the", "The", "ÉTÉ", "été", "a b", "x\u000by", *(f"w{i}" for i in range(40))]
    texts = [" ".join(rng.choice(words, rng.integers(2, 60), p=(p := 1 / np.arange(1, 47)) / p.sum())) for _ in range(60)]
    texts += [" lead\t\ttab\n\nlines \r\f end ", "one", "", None, "   ", "two words", "the the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r.doc_id: r for r in lm.document_sums(docs.repartition(3), frames.FOLDS, [1, 2]).collect()}
    lists = lm.token_lists(docs).withColumn("fold", F.pmod("doc_id", F.lit(frames.FOLDS)).cast("int"))
    models = lm.train(lists, lists, Scratch(spark, "test"))
    for k in (1, 2):
        old = lm.token_stats(frames.scored_by(lists, k), models).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("logp", "mu", "var"))).collect()
        assert {r.doc_id for r in old} == set(new)
        for r in old:
            assert r.n == new[r.doc_id].n and all(math.isclose(r[c], new[r.doc_id][f"{c}{k}"], rel_tol=1e-9, abs_tol=1e-9) for c in ("logp", "mu", "var"))
