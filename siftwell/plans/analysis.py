"""Queries over scores: flags, agreement, gates, tables, token statistics, attribution, tests and releases.

Rates and coefficients are rounded to six digits, in the SQL too, as sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from siftwell import config
from siftwell.operators import attribution, edits, hypotheses, metrics, report, resample, sample, scoring, segment, tables
from siftwell.plans import frames
from siftwell.plans.registry import register
from siftwell.plans.sqltext import CELLS, DOC_TABLE, DOCS, FLAGS, LATEST, LISTS, MODELS, PPL, RATES, n_blank, pieces, stats
from siftwell.runtime import Scratch, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)
count = lambda name: F.count(F.lit(1)).alias(name)
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def _whole(df, *names):
    """df with the named columns rounded."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# thresholds, flags, rates ---------------------------------------------------------------------------------------------

_WILSON = "(p + z * z / (2 * n)) / (1 + z * z / n)", "z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)"


@query(f"""with {RATES}, w as (select *, k / n as p, 1.96::double as z from counts)
select instance, stratum, k::bigint as flagged, n, round(p, 6) as fpr, round({_WILSON[0]} - {_WILSON[1]}, 6) + 0.0 as fpr_lo, round({_WILSON[0]} + {_WILSON[1]}, 6) as fpr_hi from w""")
def fpr_wilson(spark, d):
    return _whole(metrics.rates(frames.flags(spark, d), ["instance", "stratum"]), "fpr", "fpr_lo", "fpr_hi")


@query(f"""with {FLAGS}, r as (select instance, score, row_number() over (partition by instance order by score) - 1 as i, count(*) over (partition by instance) as n from flags where stratum = 'S6')
select instance, score as threshold from r where i = ceil(round(0.95 * (n - 1), 9))""")
def thresholds_higher(spark, d):
    return metrics.calibrate(frames.flags(spark, d).filter(F.col("stratum") == config.CALIBRATION).select("instance", "score"))


@query(f"with {FLAGS} select instance, item_id, score, threshold, flagged from flags")
def flags(spark, d):
    return frames.flags(spark, d).select("instance", "item_id", "score", "threshold", "flagged")


_KAPPA = f"""{FLAGS}, full_items as (select item_id from flags group by 1 having count(distinct instance) = (select count(distinct instance) from flags)),
c as (select a.instance as a, b.instance as b, count(*) as n, avg((a.flagged = b.flagged)::int) as po, avg(a.flagged) as pa, avg(b.flagged) as pb from flags a join flags b on a.item_id = b.item_id and a.instance < b.instance where a.item_id in (select item_id from full_items) group by 1, 2),
kappa as (select a, b, n, case when pa * pb + (1 - pa) * (1 - pb) < 1 then (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) else 1.0 end as kappa from c)"""


@query(f"with {_KAPPA} select a, b, n, round(kappa, 6) + 0.0 as kappa from kappa")
def kappa_pairs(spark, d):
    return _whole(metrics.kappa_pairs(frames.flags(spark, d)), "kappa")


_FAMILY = "(case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in config.FAMILIES.items()) + " end)"


@query(f"with {_KAPPA}, f as (select kappa, {_FAMILY.format('a')} = {_FAMILY.format('b')} as same from kappa) select round(avg(kappa) filter (where same) - avg(kappa) filter (where not same), 6) + 0.0 as gap from f")
def family_kappa_gap(spark, d):
    names = F.create_map(*(F.lit(v) for pair in config.FAMILIES.items() for v in pair))
    same = names[F.col("a")] == names[F.col("b")]
    return metrics.kappa_pairs(frames.flags(spark, d)).agg(r6(F.avg(F.when(same, F.col("kappa"))) - F.avg(F.when(~same, F.col("kappa"))), "gap"))


# gates ----------------------------------------------------------------------------------------------------------------


def _gate(spark, d):
    own = frames.docs(spark, d, text=False).filter(F.col("stratum") == config.CALIBRATION).select(F.col("doc_id").alias("item_id"))
    scores = frames.latest(spark, d)
    human = scores.join(own, "item_id", "left_semi").filter("group_name <> 'control'").withColumn("positive", F.lit(0))
    control = scores.filter("group_name = 'control'").withColumn("positive", F.lit(1))
    return metrics.auroc(human.unionByName(control).select("instance", "score", "positive"))


_GATE = f"""{DOCS}, {LATEST}, y as (select instance, score, 0 as positive from latest where group_name <> 'control' and item_id in (select doc_id from docs where stratum = 'S6') union all select instance, score, 1 from latest where group_name = 'control'),
r as (select *, rank() over (partition by instance order by score) + (count(*) over (partition by instance, score) - 1) / 2 as rk from y),
s as (select instance, sum(positive) as n1, sum(1 - positive) as n0, sum(rk * positive) as r1 from r group by 1),
g as (select instance, n0, n1, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) as raw from s where n0 > 0 and n1 > 0),
gate as (select instance, case when split_part(instance, '@', 1) = 'D5' and raw < 0.5 then 1 - raw else raw end as auroc, split_part(instance, '@', 1) = 'D5' and raw < 0.5 as flipped, n0 as n_human, n1 as n_control from g)"""


@query(f"with {_GATE} select instance, round(auroc, 6) as auroc, flipped, auroc >= 0.8 as passed, n_human::bigint as n_human, n_control::bigint as n_control from gate")
def auroc_gate(spark, d):
    return _whole(_gate(spark, d), "auroc")


@query(f"with {_GATE} select l.instance, l.item_id, case when g.flipped then 1 - l.score else l.score end as score from latest l left join gate g using (instance)")
def flipped_scores(spark, d):
    return metrics.apply_flips(frames.latest(spark, d).select("instance", "item_id", "score"), _gate(spark, d)).select("instance", "item_id", "score")


@query(f"with {RATES} select instance, round(k / n, 6) as fpr, abs(k / n - 0.05) <= 0.005 as passed from counts where stratum = 'S6'")
def negative_control(spark, d):
    return _whole(metrics.negative_control(metrics.rates(frames.flags(spark, d), ["instance", "stratum"])), "fpr")


@query(f"""with {FLAGS}, s as (select * from flags where stratum = 'S6'), q as (select quantile_cont(n_tokens, [0.25, 0.5, 0.75]) as q from s),
b as (select instance, (n_tokens > q[1])::int + (n_tokens > q[2])::int + (n_tokens > q[3])::int as quartile, avg(flagged) as fpr from s, q group by 1, 2)
select instance, round(max(fpr) - min(fpr), 6) as fpr_spread, max(fpr) - min(fpr) <= 0.03 as passed from b group by 1""")
def length_invariance(spark, d):
    return _whole(metrics.length_invariance(frames.flags(spark, d).filter(F.col("stratum") == config.CALIBRATION)), "fpr_spread")


# tables ---------------------------------------------------------------------------------------------------------------


@query(f"with {DOC_TABLE} select instance, detector, reference, item_id, stratum, score, threshold, flagged, round(log_ppl_indep, 6) as log_ppl_indep, n_tokens from dt")
def document_table(spark, d):
    return _whole(frames.document_table(spark, d), "log_ppl_indep").withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"""with {CELLS} select instance, detector, reference, stratum, round(fpr, 6) as fpr, n, k::bigint as k, round(log_ppl_indep, 6) as log_ppl_indep, round(length, 6) as length,
case when detector in ('D3', 'D4', 'D5') then 'trained' else 'zero_shot' end as family, round(ln((k + 0.5) / (n - k + 0.5)), 6) as logit_fpr from cells""")
def cell_table(spark, d):
    return _whole(frames.cell_table(spark, d), "fpr", "log_ppl_indep", "length", "logit_fpr")


@query(f"""with {RATES}, p as (select reference, stratum, avg(fpr) as v from (select split_part(instance, '@', 2) as reference, stratum, k / n as fpr from counts where instance like 'D1@%') group by 1, 2),
x as (select a.reference as a, b.reference as b, sign(a.v - a2.v) as sx, sign(b.v - b2.v) as sy from p a join p a2 on a.reference = a2.reference and a.stratum < a2.stratum join p b on b.stratum = a.stratum and b.reference > a.reference join p b2 on b2.reference = b.reference and b2.stratum = a2.stratum)
select a, b, round(sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0), 6) + 0.0 as tau from x group by 1, 2""")
def kendall_tau(spark, d):
    rates = metrics.rates(frames.flags(spark, d).filter(F.col("instance").startswith("D1@")), ["instance", "stratum"])
    return _whole(metrics.kendall(rates.withColumn("reference", F.split("instance", "@")[1]), "reference", "stratum", "fpr"), "tau")


@query(f"""with {FLAGS}, one as (select * from flags where instance like 'D1@%'), full_items as (select item_id from one group by 1 having count(distinct instance) = (select count(distinct instance) from one)),
p as (select stratum, instance, avg(flagged) as r from one where item_id in (select item_id from full_items) group by 1, 2),
c as (select r - avg(r) over (partition by stratum) - avg(r) over (partition by instance) + avg(r) over () as c from p) select round(sum(c * c), 6) as stat from c""")
def profile_statistic(spark, d):
    full = metrics.complete_cases(frames.flags(spark, d).filter(F.col("instance").startswith("D1@")))
    return _whole(resample.profile_statistic(full.groupBy("stratum", "instance").agg(F.avg("flagged").alias("rate")), [], "stratum", "instance", "rate"), "stat")


@query(f"""with {RATES}, p as (select instance, k / n as p from counts where stratum = 'S1'), r as (select *, row_number() over (order by p, instance) as i, count(*) over () as m from p)
select instance, round(p, 6) as p, round(least(1.0, max((m - i + 1) * p) over (order by p, instance rows unbounded preceding)), 6) as p_holm from r""")
def holm_adjusted(spark, d):
    rates = metrics.rates(frames.flags(spark, d).filter("stratum = 'S1'"), ["instance"]).select("instance", F.col("fpr").alias("p"))
    return _whole(metrics.holm(rates, "instance", "p"), "p", "p_holm")


_MISSES = f"""{RATES}, l as (select instance, stratum, ln((k + 0.5) / (n - k + 0.5)) as o from counts), t as (select *, sum(o) over (partition by instance) as s, count(*) over (partition by instance) as m from l),
misses as (select abs(o - (s - o) / (m - 1)) as miss from t)"""


@query(f"with {_MISSES}, r as (select miss, row_number() over (order by miss) - 1 as i, count(*) over () as n from misses) select n, round(miss, 6) as width from r where i = least(n - 1, ceil(round((n + 1) * 0.95, 9)) - 1)")
def conformal_pick(spark, d):
    rates = metrics.rates(frames.flags(spark, d), ["instance", "stratum"]).withColumn("o", metrics.empirical_logit(F.col("flagged"), F.col("n")))
    own = Window.partitionBy("instance")
    misses = rates.select(F.abs(F.col("o") - (F.sum("o").over(own) - F.col("o")) / (F.count(F.lit(1)).over(own) - 1)).alias("miss"))
    return report.conformal_pick(misses).select("n", r6("width"))


@query(f"""with {CELLS} select instance, round(covar_samp(fpr, log_ppl_indep) / nullif(stddev_samp(fpr) * stddev_samp(log_ppl_indep), 0), 6) + 0.0 as r_ppl, round(covar_samp(fpr, length) / nullif(stddev_samp(fpr) * stddev_samp(length), 0), 6) + 0.0 as r_length,
round(covar_samp(fpr, log_ppl_indep) / nullif(var_samp(log_ppl_indep), 0), 6) + 0.0 as slope, round(stddev_samp(fpr), 6) as sd from cells group by 1""")
def predictor_correlations(spark, d):
    cells = frames.cell_table(spark, d)
    x, y, z = "fpr", "log_ppl_indep", "length"
    none = F.lit(0.0)
    return cells.groupBy("instance").agg(
        r6(F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), none), "r_ppl"), r6(F.covar_samp(x, z) / F.nullif(F.stddev_samp(x) * F.stddev_samp(z), none), "r_length"),
        r6(F.covar_samp(x, y) / F.nullif(F.var_samp(y), none), "slope"), r6(F.stddev_samp(x), "sd"),
    )


# scores ---------------------------------------------------------------------------------------------------------------


@query(f"with {LATEST} select instance, item_id, group_name, score from latest")
def latest_scores(spark, d):
    return frames.latest(spark, d)


@query(f"with {DOCS} select d.doc_id, s.instance from docs d, (select distinct instance from scores where instance is not null) s where not exists (select 1 from scores x where x.item_id = d.doc_id and x.instance = s.instance and x.score is not null and not isnan(x.score))")
def unscored_items(spark, d):
    instances = table(spark, d, "scores").select("instance").dropna().distinct()
    names = [r[0] for r in instances.limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 instances")
    wanted = frames.docs(spark, d, text=False).select(F.col("doc_id").alias("item_id"), F.explode(F.array(*map(F.lit, names))).alias("instance"))
    return scoring.pending(wanted, frames.latest(spark, d), ["item_id", "instance"]).select(F.col("item_id").alias("doc_id"), "instance")


_SURFACE = f"""{DOCS}, p as (select doc_id, stratum, text, {pieces('text')} as w from docs),
surface as (select doc_id, stratum, 1 / (1 + exp(-(-4.0 + 0.8 * coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1) + 6.0 * length(regexp_replace(text, '[^,.;:!?]', '', 'g')) / greatest(length(text), 1) - 1.5 * len(list_distinct(w)) / greatest(len(w), 1)))) as score from p)"""


@query(f"with {_SURFACE} select doc_id as item_id, round(score, 6) as score, 'D3' as instance, stratum as group_name from surface")
def derived_scores(spark, d):
    docs = frames.docs(spark, d)
    strata = scoring.surface(docs, keep=["stratum"])
    return scoring.score_rows(strata, "D3", F.col("stratum"), "run", config.config_hash()).select("item_id", r6("score"), "instance", "group_name")


# token statistics -----------------------------------------------------------------------------------------------------

_LM1 = f"{LISTS}, {MODELS}, {stats(1, 'm1')}"
_LM2 = f"{_LM1}, {stats(2, 'm2')}"


@query(f"with {_LM1} select doc_id, count(*) as n, round(sum(logp), 4) as logp, round(sum(mu), 4) as mu, round(sum(var), 4) as var, round(sum(xent), 4) as xent from m1stats group by 1")
def token_statistics(spark, d):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    lists = frames.scored_by(lists, 1)
    sums = lm.token_stats(lists, models).groupBy("doc_id").agg(count("n"), *(F.round(F.sum(c), 4).alias(c) for c in ("logp", "mu", "var")))
    return sums.join(lm.pair_stats(lists, models).groupBy("doc_id").agg(F.round(F.sum("xent"), 4).alias("xent")), "doc_id")


@query(f"with {_LM1} select doc_id, round((sum(logp) - sum(mu)) / sqrt(greatest(sum(var), 1e-8)), 6) as score, count(*) as n_tokens from m1stats group by 1")
def contrast_scores(spark, d):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    return _whole(scoring.contrast(lm.token_stats(frames.scored_by(lists, 1), models)), "score")


@query(f"with {_LM1} select doc_id, round(-avg(logp), 6) as score, count(*) as n_tokens from m1stats group by 1")
def log_perplexity(spark, d):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    return _whole(scoring.log_perplexity(lm.token_stats(frames.scored_by(lists, 1), models)), "score")


@query(f"with {_LM1} select doc_id, round(-avg(ce) / greatest(avg(xent), 1e-8), 6) as score, count(*) as n_tokens from m1stats group by 1")
def ratio_scores(spark, d):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    return _whole(scoring.ratio(lm.pair_stats(frames.scored_by(lists, 1), models)), "score")


# attribution ----------------------------------------------------------------------------------------------------------

_COMPONENTS = """{0}comp as (select doc_id, -avg(logp) as nll, -avg(mu) as entropy, avg(var) as var, count(*)::double as n from {0}stats group by 1)"""


def _components(spark, d, references):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    scratch = Scratch(spark, "components")
    return [scratch.keep(attribution.components(lm.token_stats(frames.scored_by(lists, k), models)), f"components-{k}") for k in references]


@query(f"with {_LM1}, {_COMPONENTS.format('m1')} select doc_id, round(nll, 6) as nll, round(entropy, 6) as entropy, round(var, 6) as var, n from m1comp")
def component_table(spark, d):
    return _whole(_components(spark, d, [1])[0], "nll", "entropy", "var")


@query(f"""with {_LM1}, {_COMPONENTS.format('m1')}, s as (select doc_id, (sum(logp) - sum(mu)) / sqrt(greatest(sum(var), 1e-8)) as score from m1stats group by 1)
select count(*) as n, max(abs(sqrt(n) * (entropy - nll) / sqrt(greatest(var, 1e-8)) - score)) < 1e-6 as same from m1comp join s using (doc_id)""")
def score_reproduction(spark, d):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    stats = Scratch(spark, "stats").keep(lm.token_stats(frames.scored_by(lists, 1), models), "stats")
    again = attribution.reproduction(attribution.components(stats), scoring.contrast(stats), attribution.contrast_score, ["nll", "entropy", "var", "n"])
    return again.select("n", (F.col("max_diff") < 1e-6).alias("same"))


@query(f"""with {_LM1}, c as (select doc_id, avg(ce) as nll, avg(xent) as xent from m1stats group by 1), s as (select doc_id, -avg(ce) / greatest(avg(xent), 1e-8) as score from m1stats group by 1)
select count(*) as n, max(abs(-nll / greatest(xent, 1e-8) - score)) < 1e-6 as same from c join s using (doc_id)""")
def ratio_reproduction(spark, d):
    from siftwell.operators import lm

    lists, models = frames.language_models(spark, d)
    stats_ = Scratch(spark, "stats").keep(lm.pair_stats(frames.scored_by(lists, 1), models), "pair-stats")
    again = attribution.reproduction(attribution.pair_components(stats_), scoring.ratio(stats_), attribution.ratio_score, ["nll", "xent"])
    return again.select("n", (F.col("max_diff") < 1e-6).alias("same"))


_NAMES = ["nll", "entropy", "var"]
_WEIGHTS = ", ".join(f"('{_NAMES[i]}', {mask}, {w!r}::double, {int(mask == 1 << i)})" for i, mask, w in attribution.weights(3))
_SHAPLEY = f"""{_LM2}, {_COMPONENTS.format('m1')}, {_COMPONENTS.format('m2')}, al as (select a.doc_id, l.stratum, a.n, a.nll as b0, a.entropy as b1, a.var as b2, b.nll as t0, b.entropy as t1, b.var as t2 from m1comp a join m2comp b using (doc_id) join lists l using (doc_id)),
mx as (select mask, stratum, sqrt(n) * ((case when mask & 2 <> 0 then t1 else b1 end) - (case when mask & 1 <> 0 then t0 else b0 end)) / sqrt(greatest(case when mask & 4 <> 0 then t2 else b2 end, 1e-8)) as score from al, (select unnest(range(0, 8)) as mask)),
rk as (select mask, score, row_number() over (partition by mask order by score) - 1 as i, count(*) over (partition by mask) as n from mx where stratum = 'S6'),
th as (select mask, score as threshold from rk where i = ceil(round(0.95 * (n - 1), 9))),
pr as (select mask, stratum, avg((score > threshold)::int) as rate from mx join th using (mask) where stratum <> 'S6' group by 1, 2),
ds as (select p.mask, sum(abs(p.rate - g.rate)) as d from pr p join pr g on g.stratum = p.stratum and g.mask = 7 group by 1),
cl as (select mask, (select d from ds where mask = 0) as total, (select d from ds where mask = 0) - d as v from ds),
w(component, mask, w, alone) as (values {_WEIGHTS})"""


@query(f"with {_SHAPLEY} select component, round(sum(w.w * v) / nullif(any_value(total), 0), 6) + 0.0 as share, round(sum(alone * v) / nullif(any_value(total), 0), 6) + 0.0 as single_share, round(any_value(total), 6) as total from cl join w using (mask) group by 1")
def shapley_shares(spark, d):
    base, target = _components(spark, d, [1, 2])
    rows = attribution.aligned(base, target, table(spark, d, "documents"), _NAMES).join(base.select("doc_id", "n"), "doc_id")
    rows = Scratch(spark, "aligned").keep(rows, "aligned")
    profiles = attribution.mixture_profiles(rows, _NAMES, lambda c: attribution.contrast_score(c | {"n": F.col("n")}))
    return _whole(attribution.shapley(Scratch(spark, "profiles").keep(profiles, "profiles"), _NAMES), "share", "single_share", "total")


@query()
def share_intervals(spark, d):
    """Shares over resampled documents."""
    from siftwell.operators import lm

    documents = table(spark, d, "documents")
    sums = lm.document_sums(spread(documents.select("doc_id", "text")), frames.FOLDS, [1, 2])
    parts = [(f"{s}_{c}", sign * F.col(f"{of}{k}") / F.col("n")) for s, k in (("b", 1), ("t", 2)) for c, of, sign in zip(_NAMES, ("logp", "mu", "var"), (-1, -1, 1), strict=True)]
    rows = sums.join(documents.select("doc_id", "stratum"), "doc_id").select("doc_id", "stratum", "n", *(column.alias(c) for c, column in parts))
    rows = Scratch(spark, "aligned").keep(rows, "aligned")
    return attribution.share_intervals(attribution.bootstrap_shares(rows, _NAMES, lambda c: attribution.contrast_score(c | {"n": F.col("n")}), 1000))


@query()
def control_windows(spark, d):
    return segment.control_texts(table(spark, d, "documents").select("doc_id", "text"))


# resampling -----------------------------------------------------------------------------------------------------------


@query(f"""with {FLAGS}, it as (select distinct stratum, item_id from flags where instance = 'D4'), nu as (select stratum, item_id, row_number() over (partition by stratum order by item_id) - 1 as i, count(*) over (partition by stratum) as n from it),
dr as (select b, stratum, ('0x' || substr(md5('0:' || b || ':' || stratum || '/' || i), 1, 13))::bigint % n as i from nu, (select unnest(range(0, 1000)) as b)),
ct as (select b, n.item_id, count(*) as times from dr join nu n using (stratum, i) group by 1, 2)
select b::int as b, stratum, sum(times)::bigint as n, round(sum(times * flagged) / sum(times), 6) as fpr from ct join flags f using (item_id) where f.instance = 'D4' group by 1, 2""")
def bootstrap_rates(spark, d):
    flags_ = frames.flags(spark, d).filter("instance = 'D4'")
    counts = resample.bootstrap_counts(flags_.select("item_id", "stratum"), 1000)
    return resample.bootstrap_cells(flags_, counts, ["stratum"], ["flagged"]).select("b", "stratum", "n", r6("flagged", "fpr"))


@query()
def bootstrap_coefficients(spark, d):
    """Percentile interval of the perplexity coefficient over resampled documents."""
    rows = frames.document_table(spark, d)
    counts = resample.bootstrap_counts(rows.select("item_id", "stratum"), 1000)
    cells = resample.bootstrap_cells(rows, counts, ["instance", "stratum"], ["flagged", "log_ppl_indep", "n_tokens"])
    return resample.interval(resample.bootstrap_coefficients(cells, "flagged", ["log_ppl_indep", "n_tokens"], ["instance"], "log_ppl_indep"), "coef")


@query()
def profile_permutation(spark, d):
    out = resample.profile_shift(frames.flags(spark, d).filter(F.col("instance").startswith("D1@")))
    return spark.createDataFrame([Row(**out)], "stat double, p double")


# tests ----------------------------------------------------------------------------------------------------------------


def _flat(spark, out: dict):
    """A result as rows of name and value."""
    rows = [(k, None if isinstance(v, (str, list, dict)) or v is None else float(v), v if isinstance(v, str) else None) for k, v in out.items() if not isinstance(v, (list, dict))]
    return spark.createDataFrame(rows, "name string, value double, label string")


@query()
def unification_test(spark, d):
    rows = frames.document_table(spark, d)
    return _flat(spark, hypotheses.unification(tables.cell_table(rows), rows))


@query()
def reference_shift_test(spark, d):
    rows = frames.document_table(spark, d)
    cells = frames.cells_with_reference(spark, d, rows)
    return _flat(spark, hypotheses.reference_shift(cells, rows, overlap=tables.covariate(table(spark, d, "source_overlap"))))


@query()
def trained_test(spark, d):
    rows = frames.document_table(spark, d)
    return _flat(spark, hypotheses.trained_only(tables.cell_table(rows), rows))


@query()
def held_out_test(spark, d):
    return _flat(spark, hypotheses.held_out_strata(frames.cell_table(spark, d)))


@query()
def agreement_test(spark, d):
    return _flat(spark, hypotheses.agreement_structure(frames.flags(spark, d)))


def _edited(spark, d):
    """Changes of surface scores and perplexity under edits of the calibration stratum."""
    from siftwell.operators import lm

    scratch = Scratch(spark, "edited")
    own = frames.docs(spark, d).filter(F.col("stratum") == config.CALIBRATION).select("doc_id", "text")
    variants = scratch.keep(edits.variants(own), "variants")
    both = own.unionByName(variants.select(F.col("variant_id").alias("doc_id"), "text"))
    scored = scoring.surface(both).join(variants.select(F.col("variant_id").alias("doc_id"), F.lit("variants").alias("g")), "doc_id", "left")
    scores = scored.select(F.lit("D3").alias("instance"), F.col("doc_id").alias("item_id"), F.coalesce("g", F.lit(config.CALIBRATION)).alias("group_name"), "score")
    lists = scratch.keep(lm.token_lists(both), "lists")
    training = lm.token_lists(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    bigrams = lm.train(lists.unionByName(training), training, scratch)
    ppl = scoring.log_perplexity(lm.token_stats(lists, bigrams)).select(F.col("doc_id").alias("item_id"), F.col("score").alias("log_ppl_indep"))
    return scratch.keep(tables.deltas(scores, variants, scratch.keep(ppl, "ppl")), "deltas")


@query()
def edit_deltas(spark, d):
    return _edited(spark, d)


@query()
def edit_slopes(spark, d):
    return _edited(spark, d).groupBy("instance", "edit").agg(count("n"), F.regr_slope("dz", "dlogppl").alias("slope"))


@query()
def intervention_test(spark, d):
    per = hypotheses.intervention(_edited(spark, d))
    overall = hypotheses.intervention_overall(per, list(per))
    rows = [(i, r["slope"], r["p"], r["p_holm"], r["sd_ratio"], r["n"], r["verdict"]) for i, r in per.items()]
    return spark.createDataFrame(rows, "instance string, slope double, p double, p_holm double, sd_ratio double, n long, verdict string").withColumn("overall", F.lit(overall["verdict"]))


# forecast, audit, release ---------------------------------------------------------------------------------------------


@query()
def forecast_errors(spark, d):
    cells = Scratch(spark, "cells").keep(frames.cell_table(spark, d), "cells")
    fit = report.forecast_model(cells.filter(F.col("stratum").isin(*config.FIT)))
    held = cells.filter(F.col("stratum").isin(*config.FORECAST))
    target = held.groupBy("stratum").agg(F.avg("log_ppl_indep").alias("log_ppl_indep"), F.avg("length").alias("length"))
    instances = [r[0] for r in cells.select("instance").distinct().collect()]
    return report.forecast_errors(report.forecast_grid(target, instances, fit), held)


@query()
def audit_models(spark, d):
    model_ = report.fit_audit(frames.document_table(spark, d))
    rows = [(i, m["coef"], m["population_sd_logit"], m["n_docs"], m["n_populations"]) for i, m in sorted(model_.items())]
    return spark.createDataFrame(rows, "instance string, coef array<double>, population_sd double, n_docs long, n_populations long")


@query()
def audit_estimates(spark, d):
    rows = frames.document_table(spark, d)
    fitted = report.fit_audit(rows.filter(F.col("stratum").isin(*config.FIT)))
    # The texts of one population are audited, as a caller would.
    features = Scratch(spark, "features").keep(rows.filter("stratum = 'S10' and instance = 'D4'").select("log_ppl_indep", "n_tokens"), "features")
    out = [(i, e["n_texts"], e["estimate"], e["low"], e["high"]) for i, m in sorted(fitted.items()) for e in [report.audit_estimate(features, m)]]
    return spark.createDataFrame(out, "instance string, n_texts long, estimate double, low double, high double")


_THREE = ("D1@R1", "D3", "D4")


@query(f"""with {FLAGS} select d.doc_id, d.stratum, d.n_tokens, {', '.join(f"max(score) filter (where instance = '{i}') as score_{i.replace('@', '_')}, max(flagged) filter (where instance = '{i}') as flag_{i.replace('@', '_')}" for i in _THREE)}
from docs d join flags f on f.item_id = d.doc_id group by 1, 2, 3""")
def wide_release(spark, d):
    own = frames.docs(spark, d, text=False).select("doc_id", "stratum", F.col("n_tokens").cast("long").alias("n_tokens"))
    flags_ = frames.flags(spark, d)
    return report.wide_scores(flags_, own, flags_, list(_THREE))


@query(f"""with {DOCS}, {PPL}, b as (select *, greatest(0, least(4, floor((n_tokens - 150) * 5 / 251)))::int as bin from docs left join ppl on item_id = doc_id)
select stratum, count(*) as n, round(avg(n_tokens), 6) as mean_tokens, round(avg(log_ppl_indep), 6) as mean_log_ppl, {', '.join(f'count(*) filter (where bin = {b}) as band{b}_docs' for b in range(5))} from b group by 1""")
def population_summary(spark, d):
    out = report.population_summary(frames.docs(spark, d, text=False), frames.predictor(spark, d), sample.length_bin(F.col("n_tokens")))
    return _whole(out, "mean_tokens", "mean_log_ppl")


@query("select c.\"column\", c.longest::int as longest from (select 'doc_id' as \"column\", max(length(doc_id)) as longest from candidates union all select 'stratum', max(length(stratum)) from candidates) c")
def longest_values(spark, d):
    from siftwell.sources.sinks import longest_values as longest

    return longest(table(spark, d, "candidates").select("doc_id", "stratum"))


@query(f"with {DOCS} select greatest(0, least(4, floor((n_tokens - 150) * 5 / 251)))::int as band, count(*) as n, round(avg({n_blank('text')}), 6) as mean_length from docs group by 1")
def length_bands(spark, d):
    rows = frames.docs(spark, d, text=False)
    return rows.groupBy(sample.length_bin(F.col("n_tokens")).alias("band")).agg(count("n"), r6(F.avg("n_tokens"), "mean_length"))




# gate runs, groups, agreement, intervals, forecasts -------------------------------------------------------------------


def _gated(where: str) -> str:
    return f"""with {_GATE}, fl as (select l.instance, l.item_id, d.stratum, case when g.flipped then 1 - l.score else l.score end as score from latest l join gate g using (instance) join docs d on d.doc_id = l.item_id where l.group_name <> 'control' and {where}),
rk as (select instance, score, row_number() over (partition by instance order by score) - 1 as i, count(*) over (partition by instance) as n from fl where stratum = 'S6'),
th as (select instance, score as threshold from rk where i = ceil(round(0.95 * (n - 1), 9)))
select instance, item_id, stratum, score, threshold, (score > threshold)::int as flagged from fl join th using (instance)"""


def _gate_run(spark, d, gated):
    own = frames.docs(spark, d, text=False).select(F.col("doc_id").alias("item_id"), "stratum")
    return metrics.gate_run(frames.latest(spark, d), own, gated)


@query(_gated("g.auroc >= 0.8"))
def gated_flags(spark, d):
    """Flags after the gates: flipped scores, failed instances dropped, thresholds of their own."""
    return _gate_run(spark, d, True)


@query(_gated("true"))
def ungated_flags(spark, d):
    """The exploratory rerun over all instances."""
    return _gate_run(spark, d, False)


_SPLIT_TEXT = "text"
for _word in ("and", "but", "so", "yet"):
    _SPLIT_TEXT = f"regexp_replace({_SPLIT_TEXT}, ', {_word} ([a-z])', '. {_word.capitalize()} \\1', 'g')"


@query(f"""with {DOCS}, gr as (select doc_id as item_id, text, stratum as group_name from docs union all select doc_id::varchar, text, 'control' from documents union all select doc_id || '|T3|1.00', {_SPLIT_TEXT}, 'variants' from docs where stratum = 'S6'),
p as (select item_id, group_name, text, {pieces('text')} as w from gr)
select item_id, group_name, round(1 / (1 + exp(-(-4.0 + 0.8 * coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1) + 6.0 * length(regexp_replace(text, '[^,.;:!?]', '', 'g')) / greatest(length(text), 1) - 1.5 * len(list_distinct(w)) / greatest(len(w), 1)))), 6) as score from p""")
def scored_groups(spark, d):
    """A surface score of the strata, of texts in the place of generated ones, and of edited texts."""
    docs = frames.docs(spark, d)
    variants = edits.edited(docs.filter(F.col("stratum") == config.CALIBRATION), "T3", (1.0,))
    items = scoring.groups(docs, table(spark, d, "documents"), variants)
    return scoring.surface(items, id_col="item_id", keep=["group_name"]).select(F.col("doc_id").alias("item_id"), "group_name", r6("score"))


@query(f"""with {LATEST}, xy as (select a.score as x, b.score as y from latest a join latest b using (item_id) where a.instance = 'D1@R1' and b.instance = 'D1@R2'),
rk as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from xy)
select count(*) as n, round(max(abs(x - y)) / stddev_samp(x), 6) as max_diff_sd, round(corr(rx, ry), 6) as spearman from rk""")
def score_agreement(spark, d):
    own = lambda i: frames.latest(spark, d).filter(F.col("instance") == i).select(F.col("item_id").alias("doc_id"), "score")
    return _whole(scoring.agreement(own("D1@R1"), own("D1@R2")), "max_diff_sd", "spearman")


@query(f"with {LATEST} select round(quantile_cont(score, 0.025), 6) as low, round(quantile_cont(score, 0.975), 6) as high from latest where instance = 'D4'")
def score_interval(spark, d):
    return _whole(resample.interval(frames.latest(spark, d).filter("instance = 'D4'"), "score"), "low", "high")


_COEFFICIENTS = {"Intercept": 0.4, "log_ppl_indep": -0.05, "length": 0.0005, "instance=D4": 0.02, "instance=D1@R2": -0.01}
_FORECAST = f"""with {CELLS}, t as (select stratum, avg(log_ppl_indep) as x, avg(length) as l from cells where stratum in ('S10', 'S11', 'S12') group by 1), i as (select distinct instance from cells),
g as (select stratum, instance, round(greatest(0, least(1, {_COEFFICIENTS['Intercept']} + {_COEFFICIENTS['log_ppl_indep']} * x + {_COEFFICIENTS['length']} * l + case instance when 'D4' then {_COEFFICIENTS['instance=D4']} when 'D1@R2' then {_COEFFICIENTS['instance=D1@R2']} else 0 end)), 4) as fpr_pred from t, i),
e as (select stratum, instance, fpr_pred, fpr, abs(fpr_pred - fpr) as abs_error from g join cells using (stratum, instance))"""


def _forecast(spark, d):
    """Errors of a forecast with given coefficients."""
    import numpy as np

    from siftwell.operators import linear

    cells = Scratch(spark, "forecast").keep(frames.cell_table(spark, d), "cells")
    fit = linear.Fit(list(_COEFFICIENTS), np.array(list(_COEFFICIENTS.values())), np.eye(len(_COEFFICIENTS)), 0)
    target = cells.filter(F.col("stratum").isin(*config.FORECAST)).groupBy("stratum").agg(F.avg("log_ppl_indep").alias("log_ppl_indep"), F.avg("length").alias("length"))
    return report.forecast_errors(report.forecast_grid(target, [r[0] for r in cells.select("instance").distinct().collect()], fit), cells)


@query(f"{_FORECAST} select stratum, instance, fpr_pred, round(fpr, 6) as fpr, round(abs_error, 6) as abs_error from e")
def given_forecast(spark, d):
    return _whole(_forecast(spark, d), "fpr", "abs_error")


@query(f"{_FORECAST} select case when split_part(instance, '@', 1) in ('D3', 'D4', 'D5') then 'trained' else 'zero_shot' end as family, count(*) as n, round(avg(abs_error), 6) as mae from e group by 1")
def forecast_by_family(spark, d):
    return _whole(report.errors_by_family(_forecast(spark, d)), "mae")
