"""Features of a panel that look only at the past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _past(by: list[str], order: list[str]):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def expanding_z(df: DataFrame, by: list[str], order: list[str], cols: list[str], least: int = 3, floor: float = 1e-12) -> DataFrame:
    """``{c}_z`` against all earlier rows; NULL with fewer than ``least`` of them or no spread."""
    w = _past(by, order)
    z = [F.when((F.count(c).over(w) >= least) & (F.stddev_samp(c).over(w) >= floor), (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)).alias(f"{c}_z") for c in cols]
    return df.select("*", *z)


def full_sample_z(df: DataFrame, by: list[str], cols: list[str], least: int = 3, floor: float = 1e-12) -> DataFrame:
    """``{c}_fz`` against all rows of the group, later ones too; kept for comparison with the leak-free form."""
    w = W.partitionBy(*by)
    z = [F.when((F.count(c).over(w) >= least) & (F.stddev_samp(c).over(w) >= floor), (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)).alias(f"{c}_fz") for c in cols]
    return df.select("*", *z)


def qoq(df: DataFrame, by: list[str], order: list[str], cols: list[str], suffix: str = "_qoq") -> DataFrame:
    """Change against the previous row of the group; NULL for its first."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}{suffix}") for c in cols])


def past_stats(df: DataFrame, by: list[str], order: list[str], c: str, least: int) -> DataFrame:
    w = _past(by, order)
    enough = F.count(c).over(w) >= least
    return df.select("*", F.when(enough, F.avg(c).over(w)).alias(f"{c}_past_mean"), F.when(enough, F.stddev_samp(c).over(w)).alias(f"{c}_past_std"))


def streak(df: DataFrame, by: list[str], order: list[str], c: str) -> DataFrame:
    """``streak``: how many rows of one sign ended just before this one, negative for negative signs; 0 after none."""
    w = W.partitionBy(*by).orderBy(*order)
    x = df.withColumn("_s", F.signum(F.coalesce(F.col(c), F.lit(0.0))).cast("int"))
    x = x.withColumn("_new", F.when((F.col("_s") == 0) | (F.lag("_s").over(w) != F.col("_s")) | F.lag("_s").over(w).isNull(), 1).otherwise(0))
    x = x.withColumn("_isle", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.row_number().over(W.partitionBy(*by, "_isle").orderBy(*order)) * F.col("_s")
    x = x.withColumn("_run", run)
    return x.withColumn("streak", F.coalesce(F.lag("_run").over(w), F.lit(0))).drop("_s", "_new", "_isle", "_run")
