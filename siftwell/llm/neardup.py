"""Near-duplicate records by a chosen-path join over min-hashed word shingles.

Every text becomes its set of word shingles and the set a vector of `SLOTS` min-hashes, so that two sets agree in a slot
with a chance equal to their Jaccard similarity. A run is a tree: its root splits the collection on the shared value of
one sampled slot, and a node that is still large is split again on slots sampled from a hash of the node's path, the
same for every record that reached it. Small nodes are compared all against all on a one-bit sketch; what passes is
verified on the full shingle sets. Runs are repeated until the estimated share of pairs found reaches the target.

Equal sets are joined as one class before the tree, so copies neither fill buckets nor multiply pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.hashing import WordHasher, mix, shingles
from siftwell.functions.text import words
from siftwell.operators.pairs import block_sides
from siftwell.runtime import Scratch

SLOTS = 64
SET_SCHEMA = "doc_id string, part string, set_key string, n int, sketch long, slots array<int>"
_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x51_7C_C1_B7_27_22_0A_95)).astype(np.uint32) | np.uint32(1)


def _slots(items: np.ndarray) -> np.ndarray:
    """Min-hash of a set in each slot, as unsigned 32-bit numbers."""
    low, high = items.astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = low[None, :] * _SEEDS[:, None] + high[None, :]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(13)
    return mixed.min(axis=1)


def _sketch(slots: np.ndarray) -> int:
    """One bit of each slot's value, packed into a signed 64-bit number."""
    bits = (slots * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return int(np.packbits(bits.astype(np.uint8)).view(np.int64)[0])


def _set_rows(size: int, keep_sets: bool):
    """Worker function: (doc_id, part, text) batches to set descriptions, or to the sets themselves."""

    def run(batches):
        from hashlib import blake2b

        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                ids, parts, texts = (some.column(i) for i in range(3))
                sets = [shingles(hasher(words(text)), size) for text in texts.to_pylist()]
                if keep_sets:
                    columns = [ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "items"])
                    continue
                slots = [_slots(s) for s in sets]
                columns = [
                    ids,
                    parts,
                    pa.array([blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_sketch(s) for s in slots], pa.int64()),
                    pa.array([s.view(np.int32) for s in slots], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "set_key", "n", "sketch", "slots"])

    return run


def sketch_floor(similarity: float, bits: int = SLOTS, sigmas: float = 5.3) -> int:
    """Equal sketch bits below which a pair of this similarity is practically never found."""
    equal = (1 + similarity) / 2
    return max(0, math.floor(bits * equal - sigmas * math.sqrt(bits * equal * (1 - equal))))


def slots_floor(similarity: float, sigmas: float = 5.3) -> int:
    """Equal min-hash slots below which a pair of this similarity is practically never found."""
    return max(0, math.floor(SLOTS * similarity - sigmas * math.sqrt(SLOTS * similarity * (1 - similarity))))


def runs_for(similarity: float, recall: float) -> int:
    """Independent runs after which a pair at the threshold has met with this chance."""
    return min(SLOTS, max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity))))


class Found(tuple):
    """(members, links), with the estimated `recall` of the links and the number of `runs` it took."""

    recall: float = 1.0
    runs: int = 0


def _meet(left: DataFrame, right: DataFrame, keys: list[str], floor: int, ratio: Fraction, apart: str = "false") -> DataFrame:
    """Pairs of rows with equal keys whose sizes and sketches allow the similarity; where `apart` holds, the two sides share no row."""
    p, q = ratio.numerator, ratio.denominator
    names = ["cid", "n", "sketch", "run"]
    left = left.select(*keys, *(F.col(c).alias(f"{c}_a") for c in names))
    right = right.select(*keys, *(F.col(c).alias(f"{c}_b") for c in names))
    fits = (F.col("n_a") * q >= F.col("n_b") * p) & (F.col("n_b") * q >= F.col("n_a") * p)
    alike = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) <= SLOTS - floor
    met = left.join(right, keys).filter(((F.col("cid_a") < F.col("cid_b")) | F.expr(apart)) & fits & alike)
    return met.select(F.least("cid_a", "cid_b").alias("cid_a"), F.greatest("cid_a", "cid_b").alias("cid_b"), F.col("run_a").alias("run"))


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str | None = "stratum",
    shingle_words: int = 5,
    similarity: str = "0.8",
    target_recall: float = 0.9999,
    bucket_limit: int = 64,
    max_depth: int = 5,
    split: float = 0.5,
    block: int = 256,
) -> Found:
    """Classes of equal shingle sets and the links between classes whose Jaccard similarity is at least `similarity`.

    Returns Found (members, links): members has one row per distinct id (doc_id, part, class_id); links has (class_id_a,
    class_id_b, common, n_a, n_b) with the smaller class_id first, each verified on the full sets. Only records of the
    same part are linked; a null part is a part of its own. If all slots are used up before the estimated recall reaches
    `target_recall`, RecallError is raised.

    A node above `bucket_limit` is split on slots, each taken with a chance of 1/(split * SLOTS). What is still large at
    `max_depth` is compared completely, in pairs of blocks of about `block` records spread over the cluster.

    Null ids are left out. A null text counts as empty; all texts without a word form one class. Repeated ids count once
    and must carry the same text. Columns other than the named ones are ignored, whatever they are called. An empty table
    gives empty results.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup", compact=True)
    ratio = Fraction(similarity)
    floor = sketch_floor(float(ratio))
    part = F.coalesce(F.concat(F.lit("="), F.col(part_col).cast("string")), F.lit("null")) if part_col else F.lit("=")
    source = df.select(F.col(id_col).cast("string").alias("doc_id"), part.alias("part"), F.col(text_col).alias("text")).filter("doc_id is not null")

    sets = scratch.keep(source.mapInArrow(_set_rows(shingle_words, False), SET_SCHEMA), "sets")
    # Equal sets are equal in all that describes them, so one aggregate gives the classes; `cid` is a class' number in what follows.
    same = sets.groupBy("part", "set_key").agg(F.min("doc_id").alias("class_id"), *(F.first(c).alias(c) for c in ("n", "sketch", "slots")))
    classes = scratch.keep(same.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = scratch.keep(
        sets.select("doc_id", "part", "set_key").distinct().join(classes.select("part", "set_key", "class_id"), ["part", "set_key"]).select("doc_id", "part", "class_id"),
        "members",
    )
    scratch.drop(sets)

    order = np.random.default_rng(20).permutation(SLOTS).tolist()
    per_round = runs_for(float(ratio), target_recall)
    done, recall = 0, 0.0
    seen = links = None
    while done < SLOTS and recall < target_recall:
        met = _run_trees(scratch, classes, order[done : done + per_round], floor, ratio, bucket_limit, max_depth, split, block)
        done += per_round
        met = met.groupBy("cid_a", "cid_b").agg(F.count_distinct("run").alias("hits"))
        if seen is None:
            seen = scratch.keep(_alike(met, classes, slots_floor(float(ratio))), "met")
            links = scratch.keep(_verify(seen, classes, source, shingle_words, ratio, scratch), "links")
        else:
            # Only what no round before has met is verified; for the rest the hits are added.
            met = scratch.keep(met, "met")
            new = scratch.keep(_alike(met.join(seen, ["cid_a", "cid_b"], "left_anti"), classes, slots_floor(float(ratio))), "new")
            fresh = _verify(new, classes, source, shingle_words, ratio, scratch)
            again = links.alias("l").join(met.select("cid_a", "cid_b", F.col("hits").alias("more")), ["cid_a", "cid_b"], "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")
            links = scratch.keep(again.unionByName(fresh), "links")
            seen = scratch.keep(seen.select("cid_a", "cid_b").unionByName(new.select("cid_a", "cid_b")), "seen")
        recall = _estimated_recall(links)
    if recall < target_recall:
        raise RecallError(f"an estimated share of {recall:.6f} of the links was found in {SLOTS} runs, below {target_recall}")
    out = Found((members, links.drop("hits", "cid_a", "cid_b")))
    out.recall, out.runs = recall, min(done, SLOTS)
    return out


class RecallError(RuntimeError):
    """All slots are used up and the target recall is not reached."""


def _run_trees(scratch, classes, roots, floor, ratio, bucket_limit, max_depth, split, block) -> DataFrame:
    """Candidate pairs of one round: a tree for each slot in `roots`."""
    picks = F.array(*(F.struct(F.lit(r).cast("byte").alias("run"), F.col("slots")[r].alias("value")) for r in roots))
    rows = (
        classes.select("part", "cid", "n", "sketch", F.explode(picks).alias("pick"))
        .select(F.xxhash64("part", "pick.run", "pick.value").alias("node"), F.col("pick.run").alias("run"), "cid", "n", "sketch")
    )
    out = []
    for depth in range(max_depth + 1):
        sizes = rows.groupBy("node").count().filter("count > 1")
        # A node may hold a third of all rows; adaptive execution splits its side of this join, as the other has one row of it.
        live = scratch.keep(rows.join(sizes, "node"), f"nodes-{depth}")
        small = live.filter(F.col("count") <= bucket_limit)
        out.append(_meet(small, small, ["node"], floor, ratio))
        large = live.filter(F.col("count") > bucket_limit)
        if large.isEmpty():
            break
        if depth == max_depth:
            out.append(_meetblock_sides(large, floor, ratio, block))
            break
        limit = int((2**32) / (split * SLOTS))
        slot = F.posexplode("slots")
        children = (
            large.select("node", "run", "cid", "n", "sketch")
            .join(classes.select("cid", "slots"), "cid")
            .select("node", "run", "cid", "n", "sketch", slot)
            .filter(F.pmod(F.xxhash64("node", "pos"), F.lit(2**32)) < limit)
        )
        rows = children.select(F.xxhash64("node", "pos", "col").alias("node"), "run", "cid", "n", "sketch")
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _meetblock_sides(rows: DataFrame, floor: int, ratio: Fraction, block: int) -> DataFrame:
    """All pairs of each node, spread over pairs of blocks: no task holds more than two blocks of a node."""
    left, right = block_sides(rows, "cid", "count", block)
    return _meet(left, right, ["node", "low", "high"], floor, ratio, "low < high")


def _alike(met: DataFrame, classes: DataFrame, floor: int) -> DataFrame:
    """The pairs met whose min-hash slots allow the similarity."""
    own = lambda side: classes.select(F.col("cid").alias(f"cid_{side}"), F.col("slots").alias(f"slots_{side}"))
    both = met.join(own("a"), "cid_a").join(own("b"), "cid_b")
    equal = F.size(F.filter(F.zip_with("slots_a", "slots_b", lambda x, y: x == y), lambda same: same))
    return both.filter(equal >= floor).select("cid_a", "cid_b", "hits")


def _verify(found: DataFrame, classes: DataFrame, source: DataFrame, shingle_words: int, ratio: Fraction, scratch: Scratch) -> DataFrame:
    """Candidates whose full shingle sets reach the similarity; only the texts of candidates move."""
    ends = found.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
    ends = scratch.keep(classes.select("cid", F.col("class_id").alias("doc_id")).join(ends, "cid", "left_semi"), "ends")
    texts = source.join(ends, "doc_id", "left_semi").select("doc_id", "part", "text").dropDuplicates(["doc_id"])
    sets = scratch.keep(texts.mapInArrow(_set_rows(shingle_words, True), "doc_id string, items array<long>").join(ends, "doc_id"), "full-sets")
    p, q = ratio.numerator, ratio.denominator
    both = (
        found.select("cid_a", "cid_b", "hits")
        .join(sets.select(F.col("cid").alias("cid_a"), F.col("doc_id").alias("x"), F.col("items").alias("items_a")), "cid_a")
        .join(sets.select(F.col("cid").alias("cid_b"), F.col("doc_id").alias("y"), F.col("items").alias("items_b")), "cid_b")
    )
    counted = both.select("cid_a", "cid_b", "x", "y", "hits", F.size(F.array_intersect("items_a", "items_b")).alias("common"), F.size("items_a").alias("n_x"), F.size("items_b").alias("n_y"))
    first = F.col("x") < F.col("y")
    return counted.filter(F.col("common") * (p + q) >= (F.col("n_x") + F.col("n_y")) * p).select(
        "cid_a", "cid_b", F.least("x", "y").alias("class_id_a"), F.greatest("x", "y").alias("class_id_b"), "hits", "common",
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
    )


def _estimated_recall(links: DataFrame) -> float:
    """Share of pairs found, from how many were met by one run only and by just two."""
    seen = links.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") == 1).alias("once"), F.count_if(F.col("hits") == 2).alias("twice")).first()
    unseen = seen.once * (seen.once - 1) / (2 * (seen.twice + 1))
    return seen.n / (seen.n + unseen) if seen.n else 1.0


def duplicate_groups(members: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """One row per record: doc_id, class_id, group_id (smallest id reachable over links), n_links of its class.

    Labels spread by minimum over links with pointer jumping, so the rounds grow with the logarithm of a chain's length;
    every round is a written table, and nothing is gathered on the driver.
    """
    scratch = Scratch(members.sparkSession, "groups")
    edges = scratch.keep(links.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).unionByName(links.select(F.col("class_id_b").alias("a"), F.col("class_id_a").alias("b"))), "edges")
    labels = scratch.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        hop = labels.select(F.col("a").alias("label"), F.col("label").alias("jump"))
        step = (
            labels.join(near, "a")
            .join(hop, "label", "left")
            .select("a", F.least("label", "seen", "jump").alias("label"), F.col("label").alias("old"))
        )
        new = scratch.keep(step, "labels")
        changed = not new.filter("label <> old").isEmpty()
        scratch.drop(labels)
        labels = new.drop("old")
        labels._siftwell_path = new._siftwell_path
        if not changed:
            break
    else:
        raise RuntimeError("labels did not settle; raise max_rounds")
    degree = edges.groupBy(F.col("a").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"))
    return (
        members.join(labels.select(F.col("a").alias("class_id"), "label"), "class_id", "left")
        .join(degree, "class_id", "left")
        .select("doc_id", "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def duplicate_pairs(members: DataFrame, links: DataFrame, block: int = 256) -> DataFrame:
    """Pairs of records (doc_id_a < doc_id_b): those of one class and those of linked classes.

    The pairs of a class are as many as its size squared; a large one is cut into blocks of about `block` records, and its
    pairs of blocks are spread over the cluster.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    left, right = block_sides(members.select("doc_id", "class_id").join(sizes, "class_id"), "doc_id", "size", block)
    keys = ["class_id", "low", "high"]
    a, b = left.select(*keys, F.col("doc_id").alias("a")), right.select(*keys, F.col("doc_id").alias("b"))
    inside = a.join(b, keys).filter("low < high or a < b").select("a", "b")
    member = members.select("doc_id", "class_id")
    x, y = (member.select(F.col("doc_id").alias(n), F.col("class_id").alias(f"class_id_{n}")) for n in "ab")
    across = links.select("class_id_a", "class_id_b").join(x, "class_id_a").join(y, "class_id_b").select("a", "b")
    return inside.unionByName(across).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
