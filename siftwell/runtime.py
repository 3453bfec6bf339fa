"""Session settings, table access and tables written between the stages of an operator."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import siftwell

# Functions sent to Python workers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(siftwell)

_local_dir: tempfile.TemporaryDirectory | None = None


def build_session(app: str = "siftwell", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow transfer; nothing that fixes a cluster's size."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "6g")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, spread over them; a larger one as it stands. Rows stay the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    global _local_dir
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.TemporaryDirectory(prefix="siftwell-")
    return f"file://{_local_dir.name}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Tables of one operator run, written to the shared folder.

    keep() cuts the lineage: a lost executor costs a re-read, not a recomputation, and the optimizer sees true sizes.
    drop() removes a table that no later step reads; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str, compact: bool = False):
        """compact: files of the advisory size instead of one per core, for operators that write many small tables."""
        self.spark = spark
        self.parallel_first = "false" if compact else spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        self.root = f"{shared_dir(spark)}/siftwell-{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with setting(self.spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", self.parallel_first):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._siftwell_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for kept in tables:
            self._delete(kept._siftwell_path)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
