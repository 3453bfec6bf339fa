import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import caps, cutoffs, proportions


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcd"), st.sampled_from("wxyz")), st.fractions(0, 9, max_denominator=12), max_size=16))
def test_rounding_keeps_margins(table):
    whole = proportions.controlled_rounding(table)
    rows, columns = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (r, c), x in table.items():
        assert math.floor(x) <= whole[r, c] <= math.ceil(x)
        for margin, key in ((rows, r), (columns, c)):
            margin[key][0] += x
            margin[key][1] += whole[r, c]
    for exact, got in [*rows.values(), *columns.values()]:
        assert math.floor(exact) <= got <= math.ceil(exact)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.fractions(0, 1, max_denominator=16), st.integers(0, 8), st.integers(0, 60)), min_size=1, max_size=6), st.integers(0, 120))
def test_fractional_quotas(cells, size):
    named = [(str(i), s, least, there) for i, (s, least, there) in enumerate(cells)]
    quota = proportions.fractional_quotas(size, named)
    for name, _, _, there in named:
        assert 0 <= quota[name] <= there
    assert sum(quota.values()) <= size


def test_sample(spark):
    rng = random.Random(1)
    rows = [(f"S-{i:04d}", rng.choice(["S", "T"]), f'{{"k": "{rng.choice(["a", " A", "b", "c"])}"}}', 0) for i in range(600)]
    rows += [("n1", "S", None, 0), ("n2", "S", "", 0), ("n3", "S", '{"k": "a', 0), ("n4", "S", '{"j": "a"}', 0), ("n5", "S", '{"k": 2}', 0), (None, "S", '{"k": "a"}', 0), ("x", None, '{"k": "a"}', 0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id string, stratum string, meta string, quota int")
    targets = spark.createDataFrame([(p, "k", c, s, m) for p in "ST" for c, s, m in (("a", 0.5, 8), ("b", 0.25, 8), ("c", 0.125, 8), ("2", 0.125, 4))], "stratum string, meta_key string, category string, target_share double, min_docs int")
    sample, report = proportions.proportional_sample(df, targets)
    drawn = Counter((r.stratum, r.category) for r in sample.collect())
    lines = {(r.stratum, r.category): r for r in report.collect()}
    sizes = Counter(r[1] for r in set((x[0], x[1]) for x in rows if x[0]))
    assert all(lines[k].taken == n == lines[k].quota for k, n in drawn.items())
    assert {k for k, r in lines.items() if r.short} == {("S", "2"), ("T", "2")}
    for p in "ST":
        assert sum(n for (q, _), n in drawn.items() if q == p) == sizes[p] // 2
        assert abs(drawn[p, "a"] / drawn[p, "b"] - 2) < 0.2
    assert sample.select("doc_id").distinct().count() == sample.count()
    empty, lines = proportions.proportional_sample(df.limit(0), targets)
    assert empty.count() == 0 and lines.count() == 8
    assert proportions.proportional_sample(df, targets.limit(0))[0].count() == 0


def test_caps(spark):
    rng = random.Random(2)
    rows = [(f"d{i:05d}", "S", rng.choice([" Hot ", "hot", "HOT\u00a0", "b", "c", None, "  "]), 0.5) for i in range(3000)]
    rows += [rows[5], (None, "S", "hot", 0.1), ("z", None, "hot", 0.1)]
    ratings = [(r[0], rng.choice([None, float("nan"), 0.25, 0.5, 0.75]), rng.choice([1, 2, None])) for r in rows if rng.random() < 0.9] * 2
    df = spark.createDataFrame(rows, "doc_id string, stratum string, source_doc_id string, score double").repartition(7)
    scores = caps.latest_rating(spark.createDataFrame(ratings, "doc_id string, quality double, rated_at int"))
    best = {}
    for d, q, t in ratings:
        if d and q is not None and not math.isnan(q):
            best[d] = max(best.get(d, (-1, -1.0)), (t if t is not None else -1, q))
    groups = defaultdict(list)
    for d, p, c, _ in {r[0]: r for r in rows if r[0]}.values():
        if c and c.strip():
            groups[p, c.strip().lower()].append((d not in best, -best.get(d, (0, 0))[1], d))
    kept = {d for g in groups.values() for *_, d in sorted(g)[:5]}
    free = {r[0] for r in rows if r[0] and not (r[2] and r[2].strip())}
    out = {r.doc_id: r.kept for r in caps.capped(df, scores).collect()}
    assert {d for d, k in out.items() if k} == kept | free
    assert len(out) == len({r[0] for r in rows if r[0]})
    n = Counter(p for p, _ in ((r[1], r[0]) for r in {x[0]: x for x in rows if x[0]}.values()))
    share = {r.doc_id for r in caps.capped(df, scores, limit=None, max_share=0.02).collect() if r.kept}
    assert share == {d for (p, _), g in groups.items() for *_, d in sorted(g)[: max(1, int(n[p] * 0.02))]} | free
    assert caps.capped(df.limit(0), scores).count() == 0
    with pytest.raises(ValueError):
        caps.capped(df, scores, limit=None)


def test_cutoffs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        inst, item = rng.choice("IJ"), f"i{rng.randrange(900)}"
        score = rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, rng.randrange(6) / 2, rng.gauss(0, 1)])
        group = None if item.endswith("7") else f"g{int(item[1:]) % 3}"
        rows.append((item, score, inst, group, rng.choice(["r1", "r2", "r3", None]), 1))
    rows = [*{(r[0], r[2], r[4]): r for r in rows}.values()]
    df = spark.createDataFrame(rows + rows[:50] + [(None, 1.0, "I", "g0", "r1", 1)], "item_id string, score double, instance string, group_name string, run_id string, cutoff int").repartition(5)
    targets = [("I", "g0", 0.75), ("I", "g1", 0.0), ("I", "g2", 1.0), ("J", "g0", 0.3), ("J", None, 0.5), ("K", "g0", 0.5), ("J", "g1", None)]
    report, items = cutoffs.cutoffs(cutoffs.latest_scores(df), spark.createDataFrame(targets, "instance string, group_name string, keep_fraction double"))
    last = {}
    for item, score, inst, group, run, _ in rows:
        if score is not None and not math.isnan(score):
            last[inst, item] = max(last.get((inst, item), ("",)), (run or "", group or "", score))
    groups = defaultdict(list)
    for (inst, _), (_, group, score) in last.items():
        groups[inst, group or None].append(score)
    want = {}
    for inst, group, f in targets:
        values = sorted(groups.get((inst, group), []))
        want[inst, group] = values[max(1, math.ceil(f * len(values))) - 1] if values and f is not None else None
    got = {(r.instance, r.group_name): r for r in report.collect()}
    for key, cut in want.items():
        assert got[key].cutoff == cut
        assert got[key].kept == sum(cut is None or v <= cut for v in groups.get(key, []))
    assert items.count() == len(last)
    assert cutoffs.cutoffs(cutoffs.latest_scores(df.limit(0)), spark.createDataFrame(targets, "instance string, group_name string, keep_fraction double"))[1].count() == 0


def test_fraction_import():
    assert Fraction("0.5") == Fraction(1, 2)


def test_rounding_of_large_tables():
    """Tens of thousands of cells take seconds."""
    import time

    rng = random.Random(7)
    table = {(f"r{i}", f"c{j}"): Fraction(rng.randrange(1, 500), 12) for i in range(150) for j in range(150)}
    began = time.time()
    whole = proportions.controlled_rounding(table)
    assert time.time() - began < 30
    for i in range(150):
        row = sum(table[f"r{i}", f"c{j}"] for j in range(150))
        assert math.floor(row) <= sum(whole[f"r{i}", f"c{j}"] for j in range(150)) <= math.ceil(row)
