"""Samples whose categories meet target proportions, by controlled rounding.

Counts per cell (part and category) are aggregated in the cluster; the tables of quotas have one cell per row of the
targets and are rounded on the driver. For each meta key the parts sharing it form a two-way table of fractional quotas,
which becomes integer by a max-flow that keeps every row and column total. The quotas are then taken exactly, by a random
key of each record, without ever gathering a cell in one task.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.columns import fold
from siftwell.operators.ordered import take_quota
from siftwell.runtime import Scratch

# Bound of the quota tables on the driver; beyond it the call is refused.
MAX_CELLS = 200_000


def controlled_rounding(table: dict[tuple[str, str], Fraction]) -> dict[tuple[str, str], int]:
    """Integer cells, each rounded down or up, whose row and column sums are the exact sums rounded down or up.

    Row and column totals of an exact table are whole-number feasible, so a flow with lower bounds always exists: source
    to rows, rows to columns over the cells' fractional parts, columns to sink, and a sink-to-source arc for the total.
    """
    rows, columns = defaultdict(Fraction), defaultdict(Fraction)
    for (r, c), x in table.items():
        rows[r] += x
        columns[c] += x
    bounds = []
    for r, x in rows.items():
        bounds.append(("s", ("r", r), math.floor(x), math.ceil(x)))
    for c, x in columns.items():
        bounds.append((("c", c), "t", math.floor(x), math.ceil(x)))
    for (r, c), x in table.items():
        bounds.append((("r", r), ("c", c), math.floor(x), math.ceil(x)))
    total = sum(table.values(), Fraction())
    bounds.append(("t", "s", math.floor(total), math.ceil(total)))
    flow = _feasible(bounds)
    return {(r, c): flow[("r", r), ("c", c)] for r, c in table}


def _feasible(bounds: list[tuple]) -> dict[tuple, int]:
    """A circulation within lower and upper bounds, by max-flow from a super source over the surplus of lower bounds."""
    capacity: dict = defaultdict(lambda: defaultdict(int))
    excess: dict = defaultdict(int)
    for a, b, low, high in bounds:
        capacity[a][b] += high - low
        capacity[b][a] += 0
        excess[b] += low
        excess[a] -= low
    for node, x in list(excess.items()):
        if x > 0:
            capacity["S"][node] += x
            capacity[node]["S"] += 0
        elif x < 0:
            capacity[node]["T"] -= x
            capacity["T"][node] += 0
    wanted = sum(x for x in excess.values() if x > 0)
    if _max_flow(capacity, "S", "T") < wanted:
        raise ValueError("the bounds admit no flow")
    return {(a, b): high - capacity[a][b] for a, b, low, high in bounds}


def _max_flow(capacity, source, sink) -> int:
    """Blocking flows over level graphs; leaves the residual capacities behind.

    Each node keeps a pointer to the first arc that may still carry flow in the level graph, so an arc is given up once.
    """
    total = 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in capacity[a].items():
                if c > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return total
        arcs = {a: [b for b in capacity[a] if level.get(b) == level[a] + 1] for a in level}
        at = dict.fromkeys(arcs, 0)
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = list(zip(path, path[1:]))
                least = min(capacity[x][y] for x, y in steps)
                for x, y in steps:
                    capacity[x][y] -= least
                    capacity[y][x] += least
                total += least
                full = next(k for k, (x, y) in enumerate(steps) if not capacity[x][y])
                del path[full + 1 :]
            elif at[a] == len(arcs[a]):
                path.pop()
                if path:
                    at[path[-1]] += 1
            elif capacity[a][arcs[a][at[a]]] > 0:
                path.append(arcs[a][at[a]])
            else:
                at[a] += 1


def fractional_quotas(size: int, cells: list[tuple[str, Fraction, int, int]]) -> dict[str, Fraction]:
    """Quotas of one part: (category, target share, minimum, available) to shares of `size` within what is there.

    Small categories first get their minimum as far as it exists; the rest is divided in proportion to the shares among
    categories that still have records, and what one cannot take goes to the others.
    """
    floor = {c: Fraction(min(least, there)) for c, _, least, there in cells}
    if sum(floor.values()) > size:
        scale = Fraction(size) / sum(floor.values())
        return {c: x * scale for c, x in floor.items()}
    there = {c: Fraction(n) for c, _, _, n in cells}
    share = {c: s for c, s, _, _ in cells}
    quota: dict[str, Fraction] = {}
    open_, left = set(there), Fraction(size)
    while open_:
        weight = sum(share[c] for c in open_)
        if weight == 0:
            even = {c: left / len(open_) for c in open_}
        else:
            even = {c: left * share[c] / weight for c in open_}
        over = {c for c in open_ if even[c] > there[c]}
        under = {c for c in open_ if even[c] < floor[c]}
        spill = sum(even[c] - there[c] for c in over) - sum(floor[c] - even[c] for c in under)
        fixed = over if spill >= 0 and over else under
        if not fixed:
            quota.update({c: even[c] for c in open_})
            break
        for c in fixed:
            quota[c] = there[c] if c in over else floor[c]
            left -= quota[c]
        left = max(left, Fraction(0))
        open_ -= fixed
    return quota


def with_category(df: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", part_col: str = "stratum", meta_col: str = "meta") -> DataFrame:
    """doc_id, part, meta_key, category of the distinct records of the targets' parts.

    The category is the value of the part's meta key in the JSON, as text, trimmed and in lower case; null where the JSON
    is null, blank or unreadable, or lacks the key. Of repeated ids the one with a category counts.
    """
    keys = targets.select(F.col("stratum").alias("part"), F.col("meta_key")).filter("part is not null").groupBy("part").agg(F.min("meta_key").alias("meta_key"))
    meta = F.when(F.try_parse_json(F.col("meta")).isNotNull(), F.col("meta"))
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(part_col).cast("string").alias("part"), F.col(meta_col).cast("string").alias("meta")).filter("doc_id is not null")
    read = rows.join(keys, "part").select("doc_id", "part", "meta_key", F.element_at(F.from_json(meta, "map<string,string>"), F.col("meta_key")).alias("category"))
    return read.groupBy("doc_id").agg(F.min("part").alias("part"), F.min("meta_key").alias("meta_key"), F.min(fold(F.col("category"))).alias("category"))


def proportional_sample(
    df: DataFrame, targets: DataFrame, *, fraction: str = "0.5", seed: int = 11, id_col: str = "doc_id", part_col: str = "stratum", meta_col: str = "meta"
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of distinct records against targets (stratum, meta_key, category, target_share, min_docs).

    The size of a part's sample is `fraction` of its distinct records, with or without a category, rounded down. sample:
    doc_id, stratum, category. report: one row per target with available, needed (the larger of min_docs and share times
    size), quota, taken, share reached, and `short` where a draw of the needed size runs out of records. Categories outside the targets
    and records without one are not drawn. What a short category lacks goes to the others in proportion, as far as they
    reach; if all are exhausted the sample is smaller than its size. Null ids are left out, null parts take no part,
    repeated ids count once, repeated targets are summed, and empty tables give an empty sample.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "proportions")
    clean_targets = targets.select(
        F.col("stratum").cast("string").alias("stratum"), F.col("meta_key").cast("string").alias("meta_key"), fold(F.col("category").cast("string")).alias("category"),
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("min_docs").cast("int"), F.lit(0)).alias("min_docs"),
    ).filter("stratum is not null and category is not null")
    clean_targets = clean_targets.groupBy("stratum", "category").agg(F.min("meta_key").alias("meta_key"), F.sum("target_share").alias("target_share"), F.sum("min_docs").alias("min_docs"))
    wanted = clean_targets.limit(MAX_CELLS + 1).collect()
    if len(wanted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    rows = scratch.keep(with_category(df, clean_targets, id_col=id_col, part_col=part_col, meta_col=meta_col), "rows")
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = clean_targets.select(F.col("stratum").alias("part"), "category")
    there = {(r.part, r.category): r.n for r in rows.join(cells, ["part", "category"], "left_semi").groupBy("part", "category").agg(F.count(F.lit(1)).alias("n")).collect()}

    by_part = defaultdict(list)
    for t in wanted:
        by_part[t.stratum].append(t)
    tables: dict[str, dict[tuple[str, str], Fraction]] = defaultdict(dict)
    size_of = {p: math.floor(Fraction(fraction) * sizes.get(p, 0)) for p in by_part}
    for part, ts in by_part.items():
        quotas = fractional_quotas(size_of[part], [(t.category, Fraction(t.target_share), t.min_docs, there.get((part, t.category), 0)) for t in ts])
        for t in ts:
            tables[t.meta_key][part, t.category] = quotas[t.category]
    whole = {cell: n for fractions in tables.values() for cell, n in controlled_rounding(fractions).items()}

    schema = "part string, category string, meta_key string, target_share double, min_docs int, available long, size long, quota long"
    plan = spark.createDataFrame(
        [(t.stratum, t.category, t.meta_key, t.target_share, int(t.min_docs), there.get((t.stratum, t.category), 0), size_of[t.stratum], whole[t.stratum, t.category]) for t in wanted], schema
    )
    needed = F.greatest(F.col("min_docs").cast("double"), F.col("target_share") * F.col("size"))
    # One draw for both: as many records as the quota, and as many as the target needs.
    keyed = rows.join(plan.select("part", "category", "quota", F.greatest(F.col("quota"), F.ceil(needed)).alias("most"), F.ceil(needed).alias("need")), ["part", "category"]).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    drawn = scratch.keep(take_quota(keyed, ["part", "category"], ["draw", "doc_id"], "most", scratch, place="place").select("doc_id", F.col("part").alias("stratum"), "category", "quota", "need", "place"), "drawn")
    sample = drawn.filter("place < quota").select("doc_id", "stratum", "category")
    taken = drawn.groupBy(F.col("stratum").alias("part"), "category").agg(F.count_if(F.col("place") < F.col("quota")).alias("taken"), F.count_if(F.col("place") < F.col("need")).alias("reached"))
    none = F.lit(0)
    report = plan.join(taken, ["part", "category"], "left").select(
        F.col("part").alias("stratum"), "meta_key", "category", "target_share", "min_docs", "size", "available", needed.alias("needed"), "quota",
        F.coalesce("taken", none).alias("taken"), (F.coalesce("taken", none) / F.nullif("size", none)).alias("share"), (F.coalesce("reached", none) < needed).alias("short"),
    )
    return sample, report
