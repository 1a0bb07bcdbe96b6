"""Intermediate tables in the shared folder, and broadcasts behind a size check.

Intermediates are Parquet tables below ``spark.checkpoint.dir``, which every executor can read, so a lost executor
costs no recomputation of what was written, and the written size is known before a join strategy is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its rows, as stored and uncompressed by this factor, stay below the limit.
BROADCAST_BYTES = 32 << 20
STORED_FACTOR = 4


_OWN: dict[str, str] = {}  # folders made for local sessions without the setting, by application
_MADE: dict[str, list[str]] = {}  # what each application has written


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without the setting gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _OWN[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _place(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _goes_at_exit(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.deleteOnExit(p)  # marks only what is there


def new_path(spark: SparkSession, name: str) -> str:
    """A new empty folder in the shared one; it goes when the application ends, or with :func:`release`."""
    path = _place(spark, name)
    p, fs = _at(spark, path)
    fs.mkdirs(p)
    _goes_at_exit(spark, path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application; frames that still read them are of no more use."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        p, fs = _at(spark, path)
        fs.delete(p, True)
    return len(made)


def _size(spark: SparkSession, path: str) -> int:
    p, fs = _at(spark, path)
    return fs.getContentSummary(p).getLength()


class Stored:
    """A written intermediate table: ``df`` reads it, ``bytes`` is its stored size."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)
        self.bytes = _size(spark, path)

    def small(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes * STORED_FACTOR <= limit

    def hinted(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """With a broadcast hint when small enough; else as it is, for a shuffled join that AQE may split."""
        return F.broadcast(self.df) if self.small(limit) else self.df


def store(df: DataFrame, name: str = "t") -> Stored:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = _place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _goes_at_exit(spark, path)
    return Stored(spark, path, df.schema)


def spread(df: DataFrame, source: str) -> DataFrame:
    """For costly work on few rows: rows of a file too small to give every core a part are dealt out over all of them.

    The size of ``source``, the path that is read, tells; inputs that fill the cores are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if _size(spark, source) < cores * part else df


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``, NULL before any value; equal rows fall together.

    A plain aggregate, so copies of one hot key are merged before the shuffle. Rows that tie in ``order`` are told
    apart by their other columns, which makes the choice repeatable. Meant for narrow rows; texts go through
    :func:`latest_files`.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in (order, *rest)])


def latest_files(spark: SparkSession, path: str, keys: dict, order: str, columns: list[str]) -> DataFrame:
    """The latest record of each key with its wide ``columns``, without shuffling those columns.

    A narrow pass finds the file positions of superseded rows; the wide scan then leaves them out by an anti join
    (broadcast while the list is small, else shuffled by position, which no hot key can skew).
    """
    raw = spark.read.parquet(path)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    narrow = raw.select(*[e.alias(k) for k, e in keys.items()], F.col(order).alias("_order"), *at)
    ident = F.struct("_order", "_file", "_row")
    many = narrow.groupBy(*keys).agg(F.max(ident).alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    best = F.struct("a._order", "a._file", "a._row")
    old = store(narrow.alias("a").join(many.alias("b"), cond).filter(~best.eqNullSafe(F.col("b._best"))).select("a._file", "a._row"), "superseded")
    wide = raw.select(*[e.alias(k) for k, e in keys.items()], *[F.col(c) for c in columns if c not in keys], *at)
    return wide.join(old.hinted(), ["_file", "_row"], "left_anti").drop("_file", "_row")
