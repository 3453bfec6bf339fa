"""Sinks: tables, compaction, results with provenance, and releases that cannot hold source text."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.config import provenance

FORBIDDEN = {"text", "html", "sites", "meta"}
LONGEST = 80


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet through Spark's commit protocol: readers see the old table or the new one."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def consolidate(parts: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key of a table written in parts; the first by `order`, or any where rows repeat exactly."""
    if not order:
        return parts.dropDuplicates(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return parts.withColumn("_place", place).filter("_place = 1").drop("_place")


def write_json(result: dict, path: str | Path) -> None:
    """A result with its provenance, written beside and renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_suffix(path.suffix + ".tmp")
    draft.write_text(json.dumps(result | {"_provenance": provenance()}, indent=1, sort_keys=True), encoding="utf-8")
    draft.replace(path)


def longest_values(df: DataFrame) -> DataFrame:
    """column, longest: the longest string of each string column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, longest int")
    one = df.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("longest")) for c in names))).alias("x")).select("x.*")


def release_csv(df: DataFrame, path: str) -> None:
    """Gzipped CSV with six significant digits, refused if a column may hold source text."""
    named = FORBIDDEN & set(df.columns)
    if named:
        raise ValueError(f"columns not to be released: {', '.join(sorted(named))}")
    long = longest_values(df).filter(F.col("longest") > LONGEST).collect()
    if long:
        raise ValueError(f"columns that may hold text: {', '.join(r.column for r in long)}")
    shown = {f.name: F.format_string("%.6g", F.col(f.name).cast("double")) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.withColumns(shown).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def checksums(folder: str | Path) -> list[str]:
    """'digest  name' of every file below a folder, in order of name."""
    folder = Path(folder)
    return [f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.relative_to(folder).as_posix()}" for p in sorted(folder.rglob("*")) if p.is_file()]
