"""Column expressions with the semantics of the panel calculations: NULL for missing, explicit ties and minimums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float, high: float) -> Column:
    """Within [low, high]; NULL stays NULL, which greatest and least alone would not keep."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def trailing(by: str, order: str, n: int, shift: int = 0) -> WindowSpec:
    """The last ``n`` calendar rows, ``shift`` rows back, by position in the calendar rather than by own rows."""
    return W.partitionBy(by).orderBy(order).rangeBetween(-(n - 1) - shift, -shift)


def at_offset(c: str | Column, by: str, order: str, k: int) -> Column:
    """The value exactly ``k`` calendar rows away, NULL if there is none."""
    return F.max(col(c)).over(W.partitionBy(by).orderBy(order).rangeBetween(k, k))


def enough(agg: Column, c: str | Column, w: WindowSpec, least: int) -> Column:
    """``agg`` over ``w`` where at least ``least`` values are present."""
    return F.when(F.count(col(c)).over(w) >= least, agg.over(w))


def _sums(e: Column, by: str, order: str, n: int, shift: int) -> Column:
    """Sum over the last ``n`` calendar rows as the difference of two running sums, so the cost of a row does not grow
    with ``n`` as it does for a sliding frame."""
    upto = lambda k: F.coalesce(F.sum(e).over(W.partitionBy(by).orderBy(order).rangeBetween(W.unboundedPreceding, k)), F.lit(0.0))
    return upto(-shift) - upto(-shift - n)


def rolling_avg(c: str | Column, by: str, order: str, n: int, least: int, shift: int = 0) -> Column:
    k = _sums(col(c).isNotNull().cast("double"), by, order, n, shift)
    return F.when(k >= least, _sums(col(c), by, order, n, shift) / k)


def rolling_std(c: str | Column, by: str, order: str, n: int, least: int, shift: int = 0) -> Column:
    """Sample deviation; values should be of the size of returns, as sums of squares are subtracted."""
    k = _sums(col(c).isNotNull().cast("double"), by, order, n, shift)
    s, q = _sums(col(c), by, order, n, shift), _sums(col(c) * col(c), by, order, n, shift)
    return F.when((k >= least) & (k >= 2), F.sqrt(F.greatest((q - s * s / k) / (k - 1), F.lit(0.0))))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def pct_rank(c: str | Column, *by: str | Column) -> Column:
    """Rank over number of values, ties averaged; NULL for NULL."""
    c = col(c)
    low = F.rank().over(W.partitionBy(*by).orderBy(c.asc_nulls_last()))
    ties = F.count(c).over(W.partitionBy(*by, c))
    return F.when(c.isNotNull(), (low + (ties - 1) / 2) / F.count(c).over(W.partitionBy(*by)))


def average_rank(c: str | Column, *by: str | Column) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.rank().over(W.partitionBy(*by).orderBy(c.asc_nulls_last())) + (F.count(c).over(W.partitionBy(*by, c)) - 1) / 2)


def zscore(c: str | Column, *by: str | Column) -> Column:
    """(x - mean) / population deviation, NULL for NULL; 0 for all of a group whose sample deviation is 0 or undefined."""
    c, w = col(c), W.partitionBy(*by)
    return F.when(F.stddev_samp(c).over(w) > 0, (c - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0)


def quantile_bin(rank: Column, n: Column, bins: int = 10) -> Column:
    """0-based bin of a rank 1..n by equal-width edges over the ranks, closed on the right."""
    edges = [(1 + (n - 1) * F.lit(k / bins) < rank).cast("int") for k in range(bins + 1)]
    return F.greatest(F.lit(0), reduce(lambda a, b: a + b, edges) - 1)


def many_pct_ranks(df: DataFrame, cols: list[str], by: list[str], keys: list[str]) -> DataFrame:
    """Long form: ``keys``, ``_name``, ``_p`` with the percent rank of each of ``cols`` within ``by``.

    All columns are ranked in one pass over one partitioning instead of one sort each; only keys, name and value are
    shuffled, not the rows.
    """
    each = F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in cols])
    groups = [f"_by{i}" for i in range(len(by))]
    long = df.select(*keys, *[F.col(c).alias(g) for g, c in zip(groups, by)], F.explode(each).alias("_x"))
    long = long.select(*keys, *groups, "_x._name", "_x._v")
    return long.select(*keys, "_name", pct_rank("_v", *groups, "_name").alias("_p"))
