"""Nearest record in time by a piecewise-linear learned index.

The days at which an entity has records are cut into shards by a fixed width; a shard also holds the records up to the
tolerance beyond either edge, so a query needs no other shard. Each shard's sorted days get line segments that predict
a day's position to within EPSILON; the exact neighbours are then looked up in the few places around the prediction.

Defined results: repeated days count once. A query with a NULL entity or day, or with nothing within the tolerance,
has no match. Of two equally near days the earlier one is taken. Empty tables give no matches. A column of the queries that has the
output's name is replaced; others may have any name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_DAYS = 512
EPSILON = 4


def fit_segments(days: list[int], epsilon: int = EPSILON) -> list[tuple[int, float, int]]:
    """(first day, slope, first position) of segments; each narrows a cone of slopes until a day falls out of it."""
    out: list[tuple[int, float, int]] = []
    i, n = 0, len(days)
    while i < n:
        x0, lo, hi = days[i], 0.0, float("inf")
        j = i + 1
        while j < n:
            dx, dy = days[j] - x0, j - i
            a, b = max(lo, (dy - epsilon) / dx), min(hi, (dy + epsilon) / dx)
            if a > b:
                break
            lo, hi, j = a, b, j + 1
        out.append((x0, 0.0 if j == i + 1 else (lo + hi) / 2, i))
        i = j
    return out


def _fit(days: pd.Series) -> pd.DataFrame:
    rows = [fit_segments(d.tolist()) for d in days]
    return pd.DataFrame({k: [[s[i] for s in r] for r in rows] for i, k in enumerate(("x", "slope", "pos"))})


def time_index(records: DataFrame, entity: str, day: str, tolerance: int, shard_days: int = SHARD_DAYS) -> DataFrame:
    """One row per entity and shard: ``_ix`` with sorted ``days`` and their segments, ``seg.x``, ``seg.slope``, ``seg.pos``.

    Days are made distinct before they are collected, so a shard has at most ``shard_days + 2 * tolerance`` of them.
    """
    rows = records.select(F.col(entity).alias("_e"), F.unix_date(day).alias("d")).dropna().distinct()
    shard = lambda c: F.floor(c / shard_days).cast("int")
    rows = rows.select("_e", "d", F.explode(F.sequence(shard(F.col("d") - tolerance), shard(F.col("d") + tolerance))).alias("_shard"))
    index = rows.groupBy("_e", "_shard").agg(F.sort_array(F.collect_list("d")).alias("days"))
    fit = F.pandas_udf(_fit, "x array<int>, slope array<double>, pos array<int>")
    return index.select("_e", "_shard", F.struct("days", fit("days").alias("seg")).alias("_ix"))


def _neighbour(day: Column, epsilon: int) -> Column:
    """The nearest of ``days``, by the predicted position; NULL where there are none.

    A day between two records lies between their positions, and before the next segment's first; one place more on
    either side covers the rounding.
    """
    days, x, slope, pos = (F.col(f"_ix.{c}") for c in ("days", "seg.x", "seg.slope", "seg.pos"))
    k = F.size(F.filter(x, lambda s: s <= day))
    at = F.greatest(k, F.lit(1))
    guess = F.element_at(pos, at) + F.element_at(slope, at) * (day - F.element_at(x, at))
    upper = F.when(k < F.size(x), F.try_element_at(pos, at + 1)).otherwise(F.size(days))
    guess = F.greatest(F.element_at(pos, at), F.least(F.round(guess), upper)).cast("int")
    first = F.greatest(guess - epsilon - 1, F.lit(0))
    near = F.slice(days, first + 1, F.lit(2 * epsilon + 4))
    return F.array_min(F.transform(near, lambda d: F.struct(F.abs(d - day).alias("gap"), d.alias("d"))))["d"]


def nearest(queries: DataFrame, q_entity: str, q_day: str, records: DataFrame, r_entity: str, r_day: str, tolerance: int, out: str, shard_days: int = SHARD_DAYS, epsilon: int = EPSILON) -> DataFrame:
    """``queries`` with ``out``, the day of the nearest record of the same entity within ``tolerance`` days, or NULL.

    Queries are joined with one index row each by entity and shard; a hot entity's queries may be split by AQE.
    """
    index = time_index(records, r_entity, r_day, tolerance, shard_days)
    d = F.unix_date(q_day)
    q = queries.drop(out).withColumn("_qd", d).withColumn("_qs", F.floor(d / shard_days).cast("int"))
    j = q.join(index, (q[q_entity] == index["_e"]) & (q["_qs"] == index["_shard"]), "left")
    j = j.withColumn("_hit", F.when(F.size("_ix.days") > 0, _neighbour(F.col("_qd"), epsilon)))
    hit = F.when(F.abs(F.col("_hit") - F.col("_qd")) <= tolerance, F.date_from_unix_date("_hit"))
    return j.withColumn(out, hit).drop("_e", "_shard", "_ix", "_qd", "_qs", "_hit")
