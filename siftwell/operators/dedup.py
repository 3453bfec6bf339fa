"""Exact and MinHash removal of repeated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.pairs import block_sides

PRIME = 2147483647
SLOTS, BANDS = 64, 16


def coefficients(slots: int = SLOTS) -> list[tuple[int, int]]:
    """Multipliers and offsets of the hash functions: powers of two generators modulo the prime."""
    return [(pow(48271, i + 1, PRIME), pow(69621, i + 1, PRIME)) for i in range(slots)]


def exact(df: DataFrame, key: str = "text_sha256", order: str = "doc_id") -> DataFrame:
    """The first row of each key; null keys are all kept."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(first, key).filter(F.col(order) == F.col("_first")).drop("_first").unionByName(df.filter(F.col(key).isNull()))


def shingle_hashes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """doc_id, h: distinct 32-bit hashes of all runs of `size` blank-separated words in lower case; a shorter text is one run."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[ \t\n\f\r]+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))
    hashed = F.conv(F.substring(F.md5("run"), 1, 8), 16, 10).cast("long")
    return df.select(F.col(id_col).alias("doc_id"), words.alias("w")).select("doc_id", F.explode(runs).alias("run")).select("doc_id", hashed.alias("h")).distinct()


def signatures(hashes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, sig: the least value of each hash function over the document's shingles, in one aggregation."""
    x = F.pmod("h", F.lit(PRIME))
    least = [F.min(F.pmod(F.lit(a) * x + F.lit(b), F.lit(PRIME))).alias(f"m{i}") for i, (a, b) in enumerate(coefficients(slots))]
    return hashes.groupBy("doc_id").agg(*least).select("doc_id", F.array(*(f"m{i}" for i in range(slots))).alias("sig"))


def signature_classes(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): one document of each distinct signature (doc_id, sig), the smallest, and doc_id, class_id of all."""
    heads = sigs.groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    return heads.select(F.col("class_id").alias("doc_id"), "sig"), sigs.join(heads, "sig").select("doc_id", "class_id")


def candidate_pairs(sigs: DataFrame, bands: int = BANDS, slots: int = SLOTS, block: int = 256) -> DataFrame:
    """doc_a, doc_b (doc_a < doc_b): documents that agree in all rows of a band.

    Give it the representatives of signature_classes(): copies then make no pairs. A bucket of whatever size is met in pairs
    of blocks.
    """
    rows = slots // bands
    band = F.posexplode(F.array(*(F.concat_ws(",", F.slice("sig", i * rows + 1, rows)) for i in range(bands))))
    keyed = sigs.select("doc_id", band.alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("bucket"), "band", "key")
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    left, right = block_sides(keyed.join(sizes, "bucket"), "doc_id", "n", block)
    on = ["bucket", "low", "high", "band", "key"]
    met = left.select(*on, F.col("doc_id").alias("a")).join(right.select(*on, F.col("doc_id").alias("b")), on).filter("low < high or a < b")
    return met.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def similar_pairs(sigs: DataFrame, pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_a, doc_b, similarity: pairs whose signatures agree in at least the share `threshold` of the slots."""
    a, b = (sigs.select(F.col("doc_id").alias(f"doc_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", (same / F.size("sig_a")).alias("similarity")).filter(F.col("similarity") >= threshold)


def keep_smallest(df: DataFrame, pairs: DataFrame, id_col: str = "doc_id", members: DataFrame | None = None) -> DataFrame:
    """Rows without a similar row of smaller id: the scalable rule, without order of visits. With the members of
    signature_classes(), pairs of representatives are enough."""
    gone = pairs.select(F.col("doc_b").alias(id_col))
    if members is not None:
        gone = gone.unionByName(members.filter("doc_id <> class_id").select(F.col("doc_id").alias(id_col)))
    return df.join(gone.distinct(), id_col, "left_anti")


def keep_first(ids: list[str], sigs: dict[str, list[int]], threshold: float = 0.8, bands: int = BANDS) -> list[str]:
    """The sequential rule for one stratum's sample on the driver: buckets in order of first visit, each survivor drops later ones."""
    rows = len(next(iter(sigs.values()), [])) // bands
    buckets: dict[tuple, list[str]] = {}
    for i in ids:
        for b in range(bands):
            buckets.setdefault((b, *sigs[i][b * rows : (b + 1) * rows]), []).append(i)
    gone: set[str] = set()
    for bucket in buckets.values():
        for k, i in enumerate(bucket):
            if i in gone:
                continue
            gone.update(j for j in bucket[k + 1 :] if sum(x == y for x, y in zip(sigs[i], sigs[j], strict=True)) >= threshold * len(sigs[i]))
    return [i for i in ids if i not in gone]


def skewed_cap(df: DataFrame, key: str, cap: int, order) -> DataFrame:
    """At most `cap` rows per key in a given order; the window keeps only the cap per key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
