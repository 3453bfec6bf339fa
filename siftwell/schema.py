"""Table schemas, and the checks every ingest applies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATES = "doc_id string, stratum string, source string, source_doc_id string, pub_year int, text string, license string, l1 string, proficiency string, meta string, text_sha256 string"
VARIANTS = "variant_id string, doc_id string, edit string, intensity double, text string, n_sites_eligible int, n_sites_applied int, sites array<struct<start:int,end:int,original:string,replacement:string>>, n_tokens int, text_sha256 string"
TOKEN_STATS = "doc_id string, token_idx int, logp float, mu float, var float"
PAIR_STATS = "doc_id string, token_idx int, ce float, xent float"
SCORES = "item_id string, score double, n_tokens int, instance string, detector string, reference string, group_name string, run_id string, config_hash string"
LEDGER = "stage string, model string, group_name string, n int, package_version string, config_hash string, git_sha string, python string, utc string"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns as null, so that aggregates pass over it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def assert_finite(df: DataFrame, *columns: str) -> DataFrame:
    """df, whose reading fails on a null, NaN or infinite value in the columns."""
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"non-finite {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df
