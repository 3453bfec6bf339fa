"""Mixtures of sources with target shares of the tokens.

Each source's documents are put in a pseudorandom order and their tokens packed into blocks of fixed length. The mixture
is a list of output shards of fixed size; a multinomial draw, conditioned on the sources' totals, fixes how many slots of
a shard each source fills. A source's n-th slot takes the block that its pseudorandom permutation maps n to, a fresh
permutation for each pass over the source, so no block and no document is used more often than allowed. Slots and blocks
meet in a join on source and block number, whose keys are spread evenly whatever the sources' sizes.
"""

from __future__ import annotations

import math
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.hashing import mix
from siftwell.functions.text import count_tokens
from siftwell.operators.ordered import running_total
from siftwell.runtime import Scratch

MAX_SOURCES = 10_000
SHARDS_A_TASK = 256


def _count(batches):
    for batch in batches:
        counts = pa.array([count_tokens(t) for t in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "source", "n_tokens"])


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0..size-1 sends each index: a four-round Feistel network, walked until in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            with np.errstate(over="ignore"):
                mixed = mix(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn))
            left, right = right, left ^ (mixed & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def _half(counts: np.ndarray, room: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `room` slots, drawn without replacement from what the sources have left, fall to each source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for k, own in enumerate(counts.tolist()):
        rest -= own
        if not room or not own:
            continue
        low, high = max(0, room - rest), min(own, room)
        if own + rest < 1_000_000_000:
            n = int(rng.hypergeometric(own, rest, room)) if rest else room
        else:  # beyond the generator's range, where the normal curve is exact to a few parts in a million
            whole = own + rest
            mean, spread = room * (own / whole), math.sqrt(room * (own / whole) * (rest / whole) * ((whole - room) / max(1, whole - 1)))
            n = min(high, max(low, round(rng.normal(mean, spread))))
        out[k], room = n, room - n
    return out


def shards_between(quota: np.ndarray, shard_slots: int, seed: int, first: int, last: int):
    """(shard, slots per source in it, slots per source before it) of the shards first..last-1.

    The counts are a multinomial draw conditioned on the totals. They come from halving: a range of shards gives its
    left half a draw from its counts, seeded by the range, so any task finds its own shards without the others.
    """
    shards = -(-int(quota.sum()) // shard_slots)
    todo = [(0, shards, quota.astype(np.int64), np.zeros(len(quota), np.int64))]
    while todo:
        low, high, counts, before = todo.pop()
        if high <= first or low >= last or low == high:
            continue
        if high - low == 1:
            yield low, counts, before
            continue
        middle = (low + high) // 2
        left = _half(counts, (middle - low) * shard_slots, np.random.default_rng([seed, low, high]))
        todo += [(middle, high, counts - left, before + left), (low, middle, left, before)]


def shard_counts(quota: dict[str, int], shard_slots: int, seed: int) -> list[dict[str, int]]:
    """Slots per source of every shard."""
    names = sorted(quota)
    own = np.array([quota[s] for s in names], np.int64)
    shards = -(-int(own.sum()) // shard_slots)
    return [{s: k for s, k in zip(names, counts.tolist(), strict=True) if k} for _, counts, _ in shards_between(own, shard_slots, seed, 0, shards)]


def _slots(names: list[str], quota: np.ndarray, blocks: np.ndarray, shard_slots: int, seed: int):
    """Worker: consecutive shard numbers to their slots, each with the block and the pass that fill it."""
    marks = np.array([int.from_bytes(blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for n in names], np.uint64)

    def run(batches):
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(shards), 64):
                some = shards[start : start + 64]
                for shard, counts, before in shards_between(quota, shard_slots, seed, int(some.min()), int(some.max()) + 1):
                    own = np.repeat(np.arange(len(names)), counts)
                    draw = before[own] + np.arange(len(own)) - (np.cumsum(counts) - counts)[own]
                    turn = draw // blocks[own]
                    block = permuted(draw % blocks[own], blocks[own], mix(marks[own] ^ mix(turn.astype(np.uint64) + np.uint64(seed * 1_000_003 + 7))))
                    source = pa.DictionaryArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                    columns = [pa.array(np.full(len(own), shard, np.int64)), pa.array(np.arange(len(own), dtype=np.int32)), source, pa.array(block), pa.array(turn + 1)]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "source", "block", "use"])

    return run


def slot_quotas(weights: dict[str, Fraction], caps: dict[str, int], slots: int) -> dict[str, int]:
    """Whole slots per source: its weight of all slots, at most its cap, rounded by largest remainders."""
    exact = {s: min(w * slots, Fraction(caps[s])) for s, w in weights.items()}
    quota = {s: math.floor(x) for s, x in exact.items()}
    spare = math.floor(sum(exact.values())) - sum(quota.values())
    for s in sorted(exact, key=lambda s: (quota[s] - exact[s], s))[:spare]:
        quota[s] += quota[s] < caps[s]
    return quota


def mixture(
    docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_tokens: int = 256, shard_slots: int = 2048, total_tokens: int | None = None, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(manifest, report) of a mixture for targets (source, weight, max_repeats).

    manifest: shard, slot, source, block, use (1 = first), n_tokens and the block's segments (doc_id, from_token,
    to_token) in order. Its size is `total_tokens`, or else the tokens of all documents, in blocks of `block_tokens`; the
    last block of a source may be shorter. report: source, weight, max_repeats, tokens, wanted and reached tokens,
    share of the wanted total and of the mixture, the greatest use, and `short` where the source's packed blocks, used
    max_repeats times, hold less than its weight of the total; such a source gives all it may and the mixture is smaller for it.

    Null and blank texts have no tokens; sources without a target count for the total only; null sources have none. A null
    or negative weight counts as 0, a null max_repeats as 1, one below 0 as 0; of repeated targets the one with the
    greatest weight holds. Documents are told apart by id; a repeated id is a document each time. Null ids are left out
    of the mixture and counted in the total. Empty tables give an empty manifest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing", compact=True)
    weight, repeats = F.col("weight").cast("double"), F.col("max_repeats").cast("int")
    wanted = targets.select(F.col("source").cast("string").alias("source"), F.when(weight > 0, F.nanvl(weight, F.lit(0.0))).otherwise(0.0).alias("weight"), F.greatest(F.coalesce(repeats, F.lit(1)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.*")
    goals = {r.source: r for r in wanted.limit(MAX_SOURCES + 1).collect()}
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    sizes = scratch.keep(rows.mapInArrow(_count, "doc_id string, source string, n_tokens long"), "sizes")
    total = total_tokens if total_tokens is not None else sizes.agg(F.sum("n_tokens")).first()[0] or 0
    own = sizes.join(wanted.select("source"), "source", "left_semi")
    tokens = {r.source: r.n for r in own.groupBy("source").agg(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n_tokens"))).alias("n")).collect()}
    tokens = {s: tokens.get(s) or 0 for s in goals}
    blocks = {s: -(-n // block_tokens) for s, n in tokens.items()}
    slots = -(-total // block_tokens)
    quota = slot_quotas({s: Fraction(g.weight) for s, g in goals.items()}, {s: g.max_repeats * blocks[s] for s, g in goals.items()}, slots)
    quota = {s: k for s, k in quota.items() if k}
    names = sorted(quota)
    counts, sizes_ = np.array([quota[n] for n in names], np.int64), np.array([blocks[n] for n in names], np.int64)
    shards = -(-int(counts.sum()) // shard_slots) if names else 0
    numbers = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism), -(-shards // SHARDS_A_TASK)))
    # Written, so that the join sees the slots' true size: the range they come from is tiny, and they grow with the data.
    chosen = scratch.keep(numbers.mapInArrow(_slots(names, counts, sizes_, shard_slots, seed), "shard long, slot int, source string, block long, use long"), "slots")

    ordered = own.filter("n_tokens > 0 and doc_id is not null").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_tie", F.monotonically_increasing_id())
    packed = running_total(ordered, ["source"], ["_key", "doc_id", "_tie"], "n_tokens", "start", scratch)
    length = F.lit(block_tokens).cast("long")
    ranges = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n_tokens") - 1) / length))
    pieces = packed.select("source", "doc_id", "start", "n_tokens", F.explode(ranges).alias("block"))
    low = F.greatest(F.lit(0), F.col("block") * length - F.col("start"))
    high = F.least(F.col("n_tokens"), (F.col("block") + 1) * length - F.col("start"))
    segment = F.struct((F.col("start") + low).alias("at"), "doc_id", low.alias("from_token"), high.alias("to_token"))
    filled = pieces.select("source", "block", segment.alias("segment")).groupBy("source", "block").agg(F.sort_array(F.collect_list("segment")).alias("segments"))
    filled = scratch.keep(filled.withColumn("n_tokens", F.aggregate("segments", F.lit(0).cast("long"), lambda acc, x: acc + x.to_token - x.from_token)), "blocks")
    # What all blocks hold, each used as often as it may be.
    capacity = filled.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    manifest = scratch.keep(
        chosen.join(filled, ["source", "block"]).select("shard", "slot", "source", "block", "use", "n_tokens", F.transform("segments", lambda x: F.struct(x.doc_id.alias("doc_id"), x.from_token.alias("from_token"), x.to_token.alias("to_token"))).alias("segments")),
        "manifest",
    )
    reached = manifest.groupBy("source").agg(F.sum("n_tokens").alias("reached"), F.max("use").alias("uses"))
    known = spark.createDataFrame([(s, g.weight, g.max_repeats, tokens[s], g.weight * total) for s, g in goals.items()], "source string, weight double, max_repeats int, tokens long, wanted double")
    size = manifest.agg(F.sum("n_tokens")).first()[0]
    none = F.lit(0)
    report = known.join(reached, "source", "left").join(capacity, "source", "left").select(
        "source", "weight", "max_repeats", "tokens", "wanted", F.coalesce("reached", F.lit(0)).alias("reached"),
        (F.coalesce("reached", F.lit(0)) / F.nullif(F.lit(total), F.lit(0))).alias("share_of_wanted"),
        (F.coalesce("reached", F.lit(0)) / F.lit(size).cast("double")).alias("share_of_mixture"), F.coalesce("uses", F.lit(0)).alias("uses"),
        (F.col("max_repeats") * F.coalesce("held", none) < F.col("wanted")).alias("short"),
    )
    return manifest, report
