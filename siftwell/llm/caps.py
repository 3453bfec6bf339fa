"""At most so many records per contributor, the best by a score.

Map side, each task keeps only the cap's best score-identifier pairs of each contributor it sees; the bounded heaps merge
in two levels, first per contributor and salt, then per contributor, so a contributor with a third of all rows sends a
handful of rows from each task. Full records are then selected by a join on the identifiers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.columns import fold
from siftwell.operators.ordered import running_total
from siftwell.runtime import Scratch

PAIR_SCHEMA = "part string, contributor string, unrated int, negative double, doc_id string, salt int"
_BUFFER = 200_000
_SALTS = 32


def _bounded(limit: int):
    """Worker: the first `limit` rows per contributor by (unrated, negative, doc_id), in a bounded buffer."""

    def trim(held: pa.Table) -> pa.Table:
        held = held.take(pa.compute.sort_indices(held, [(c, "ascending") for c in ("part", "contributor", "unrated", "negative", "doc_id")]))
        codes = []
        for name in ("part", "contributor"):
            column = held.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
            codes.append((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices.to_numpy(zero_copy_only=False))
        n = held.num_rows
        fresh = np.ones(n, bool)
        fresh[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        return held.filter(pa.array(np.arange(n) - first < limit))

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: pa.Table | None = None
        for batch in batches:
            new = trim(pa.Table.from_batches([batch]))
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows > _BUFFER:
                held = trim(held)
                if held.num_rows > _BUFFER // 2:
                    yield from held.to_batches(max_chunksize=20_000)
                    held = None
        if held is not None and held.num_rows:
            yield from trim(held).to_batches(max_chunksize=20_000)

    return run


def latest_rating(ratings: DataFrame, *, id_col: str = "doc_id", score_col: str = "quality", time_col: str = "rated_at") -> DataFrame:
    """doc_id, score: of each record the rating with the latest time among those neither null nor NaN.

    A null time comes before all others; of ratings at the same time the highest counts.
    """
    usable = ratings.select(F.col(id_col).cast("string").alias("doc_id"), F.col(score_col).cast("double").alias("score"), F.col(time_col).alias("at"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return usable.groupBy("doc_id").agg(F.max(F.struct("at", "score")).alias("last")).select("doc_id", "last.score")


def contributor_rows(df: DataFrame, scores: DataFrame, *, id_col: str, part_col: str | None, contributor_col: str) -> DataFrame:
    """One row per id: doc_id, part, contributor (folded, null if blank), unrated, negative score."""
    part = F.col(part_col).cast("string") if part_col else F.lit("")
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.struct(part.alias("part"), fold(F.col(contributor_col).cast("string")).alias("contributor")).alias("key"))
    single = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key")).select("doc_id", "key.part", "key.contributor")
    score = F.when(~F.isnan("score"), F.col("score"))
    return single.join(scores, "doc_id", "left").select(
        "doc_id", "part", "contributor", score.isNull().cast("int").alias("unrated"), (-F.coalesce(score, F.lit(0.0))).alias("negative")
    )


def capped(
    df: DataFrame,
    scores: DataFrame,
    *,
    limit: int | None = 5,
    max_share: float | None = None,
    id_col: str = "doc_id",
    part_col: str | None = "stratum",
    contributor_col: str = "source_doc_id",
) -> DataFrame:
    """One row per id: doc_id, part, contributor, kept.

    A contributor's records are kept from the highest score down, unrated ones last, ties by smaller id, until `limit`,
    or, with `max_share`, that share of the part's records (rounded down, at least one) is reached; with both, the
    smaller of the two holds. A null or blank contributor is not limited. Null ids are left out, repeated ids count once,
    A call with neither limit nor share is refused. NaN scores count as unrated, scores has (doc_id, score) with one row per id, and an empty table gives an empty result.
    """
    if limit is None and max_share is None:
        raise ValueError("a cap needs a limit or a share")
    scratch = Scratch(df.sparkSession, "caps")
    rows = scratch.keep(contributor_rows(df, scores, id_col=id_col, part_col=part_col, contributor_col=contributor_col), "rows")
    held = rows.filter("contributor is not null")
    if max_share is not None:
        totals = rows.groupBy("part").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * max_share)).alias("cap"))
        ranked = running_total(held.withColumn("_one", F.lit(1)), ["part", "contributor"], ["unrated", "negative", "doc_id"], "_one", "before", scratch)
        cap = F.least(F.col("cap"), F.lit(limit)) if limit is not None else F.col("cap")
        best = ranked.alias("r").join(totals.alias("t"), F.col("r.part").eqNullSafe(F.col("t.part"))).filter(F.col("before") < cap).select("doc_id")
    else:
        pairs = held.select("part", "contributor", "unrated", "negative", "doc_id", F.pmod(F.spark_partition_id(), F.lit(_SALTS)).cast("int").alias("salt"))
        heap = lambda items: F.slice(F.sort_array(items), 1, limit)
        first = pairs.mapInArrow(_bounded(limit), PAIR_SCHEMA).groupBy("part", "contributor", "salt").agg(heap(F.collect_list(F.struct("unrated", "negative", "doc_id"))).alias("heap"))
        merged = first.groupBy("part", "contributor").agg(heap(F.flatten(F.collect_list("heap"))).alias("heap"))
        best = merged.select(F.explode("heap.doc_id").alias("doc_id"))
    marked = rows.join(best.withColumn("best", F.lit(True)), "doc_id", "left")
    return marked.select("doc_id", "part", "contributor", (F.col("best").isNotNull() | F.col("contributor").isNull()).alias("kept"))
