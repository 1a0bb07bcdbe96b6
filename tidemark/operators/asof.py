"""As-of joins by key: backward, nearest, and nearest in the order of the right side.

One union and one windowed pass carry the last (or next) right row to each left row. Windows are over an entity and a
shard of SHARD_DAYS days, so an entity with a third of all rows is spread over its shards; each shard gets the last right
row before it and the first after it, found over (entity, shard) cells, of which a calendar has few.

Defined results: a left row with a NULL entity meets right rows with a NULL entity; one with a NULL time has no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_DAYS = 128


def _shard(t: str | Column, days: int) -> Column:
    return F.floor(F.unix_date(t) / days)


def _both(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str], days: int) -> tuple[DataFrame, list[str]]:
    rest = [c for c in left.columns if c not in by and c != t]
    ltypes, rtypes = dict(left.dtypes), dict(right.dtypes)
    row = "struct<_t:date," + ",".join(f"{c}:{rtypes[c]}" for c in values) + ">"
    r = right.filter(F.col(t).isNotNull()).select(*by, F.struct(F.col(t).cast("date").alias("_t"), *values).alias("_r")).withColumn("_k", _shard("_r._t", days))
    ends = r.groupBy(*by, "_k").agg(F.max("_r").alias("hi"), F.min("_r").alias("lo"))
    asked = left.select(*by, _shard(t, days).alias("_k")).dropna(subset=["_k"]).distinct()
    cells = ends.unionByName(asked.select(*by, "_k", F.lit(None).cast(row).alias("hi"), F.lit(None).cast(row).alias("lo"))).groupBy(*by, "_k").agg(F.max("hi").alias("hi"), F.max("lo").alias("lo"))
    w = W.partitionBy(*by).orderBy("_k")  # a row per shard
    before = F.last("hi", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("lo", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    edges = cells.select(*by, "_k", F.array(before, after).alias("_e")).select(*by, "_k", F.explode("_e").alias("_r")).filter("_r is not null")
    none = F.struct(F.lit(None).cast("boolean").alias("_is"), *[F.lit(None).cast(ltypes[c]).alias(c) for c in rest])
    b = r.unionByName(edges.select(*by, "_r", "_k")).select(*by, F.col("_r._t").alias(t), none.alias("_l"), "_r", "_k", F.lit(0).alias("_side"))
    a = left.select(*by, t, F.struct(F.lit(True).alias("_is"), *rest).alias("_l"), F.lit(None).cast(row).alias("_r"), _shard(t, days).alias("_k"), F.lit(1).alias("_side"))
    return a.unionByName(b), rest


def _last_before(by: list[str], t: str):
    return W.partitionBy(*by, "_k").orderBy(t, "_side", F.col("_r").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str], tolerance: int | None = None, days: int = SHARD_DAYS) -> DataFrame:
    """The last right row at or before each left row; of several at one time the greatest values."""
    u, rest = _both(left, right, by, t, values, days)
    got = u.withColumn("_b", F.last("_r", ignorenulls=True).over(_last_before(by, t))).filter("_l._is")
    ok = F.datediff(t, F.col("_b._t")) <= tolerance if tolerance is not None else F.col(t).isNotNull()
    return got.select(*by, t, *[F.col("_l")[c].alias(c) for c in rest], *[F.when(ok, F.col("_b")[v]).alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str], tolerance: int, days: int = SHARD_DAYS) -> DataFrame:
    """The nearest right row within ``tolerance`` days; of two equally near ones the earlier."""
    u, rest = _both(left, right, by, t, values, days)
    ahead = W.partitionBy(*by, "_k").orderBy(F.col(t).desc(), "_side", F.col("_r").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    got = u.withColumn("_b", F.last("_r", ignorenulls=True).over(_last_before(by, t))).withColumn("_f", F.last("_r", ignorenulls=True).over(ahead)).filter("_l._is")
    db, df = F.datediff(t, F.col("_b._t")), F.datediff(F.col("_f._t"), t)
    pick = F.when((db <= tolerance) & (df.isNull() | (db <= df)), F.col("_b")).when(df <= tolerance, F.col("_f"))
    return got.withColumn("_p", pick).select(*by, t, *[F.col("_l")[c].alias(c) for c in rest], *[F.col("_p")[v].alias(v) for v in values])


def asof_legacy(left: DataFrame, key: list[str], right: DataFrame, by: list[str], t: str, tolerance: int, out: str = "matched") -> DataFrame:
    """The nearest right time within ``tolerance`` days; of two equally near ones the first by time.

    Right times are met through buckets as wide as the tolerance, three per left row, so the join stays an equi-join.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / max(1, tolerance))
    r = right.select(*by, F.col(t).alias("_rt")).distinct().withColumn("_k", bucket(F.col("_rt")))
    near = left.select(*key, t).withColumn("_k", F.explode(F.array(*[bucket(F.col(t)) + i for i in (-1, 0, 1)])))
    gap = F.abs(F.datediff(t, "_rt"))
    best = near.join(r, [*by, "_k"]).withColumn("_g", gap).filter(F.col("_g") <= tolerance).groupBy(*key).agg(F.min(F.struct("_g", "_rt")).alias("_m"))
    return left.join(best, key, "left").withColumn(out, F.col("_m._rt")).drop("_m")
