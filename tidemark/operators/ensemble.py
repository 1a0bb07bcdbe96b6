"""Daily scores from monthly momentum and decaying events, blended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import zscore
from ..runtime import store


def event_decay(scores: DataFrame, cal: DataFrame, entry: DataFrame, days: int = 30, calendar_days: int = 60) -> DataFrame:
    """Event z by date, falling linearly over ``days`` calendar rows and ended after ``calendar_days`` days.

    ``scores``: ticker, event_date, score; ``entry``: event_date with entry_idx. Overlaps take the greatest.
    """
    z = scores.filter("score is not null").withColumn("z", zscore("score", "event_date")).join(F.broadcast(entry), "event_date")
    rows = z.select("ticker", "event_date", "z", "entry_idx", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    rows = rows.withColumn("cal_idx", F.col("entry_idx") + F.col("i")).join(F.broadcast(cal), "cal_idx")
    rows = rows.filter(F.col("date") <= F.date_add("event_date", calendar_days))
    return rows.groupBy("date", "ticker").agg(F.max(F.col("z") * (1 - F.col("i") / days)).alias("eca_z"))


def momentum_daily(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """Monthly composite z carried forward each day, NULL after a ticker's last priced date.

    The grid is whole: every ticker with any close, benchmarks too, on every date with any close from the first
    rebalance on. A rebalance without a score keeps the score before it.
    """
    z = store(panel.select("date", "ticker", zscore("composite", "date").alias("z")), "monthly-z").df
    priced = prices.filter("close is not null")
    last = priced.groupBy("ticker").agg(F.max("date").alias("_last"))
    begin = z.agg(F.min("date").alias("_begin"))
    # One row each: the start, and the list of calendar days, which a ticker's rows are exploded from.
    days = priced.select("date").distinct().join(F.broadcast(begin)).filter("date >= _begin").agg(F.sort_array(F.collect_list("date")).alias("_days"))
    grid = last.join(F.broadcast(days)).select("ticker", "_last", F.explode("_days").alias("date"))
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    x = grid.join(z, ["date", "ticker"], "left").withColumn("momentum_z", F.last("z", ignorenulls=True).over(w))
    return x.select("date", "ticker", F.when(F.col("date") <= F.col("_last"), F.col("momentum_z")).alias("momentum_z"))


def blend(momentum: DataFrame, events: DataFrame, reg: DataFrame, gate: bool = False, weight: float = 0.5, as_of: str | None = None) -> DataFrame:
    """Both scores, missing ones as 0, weighed, scaled by the regime if ``gate``, as z over all names of a date; of the
    date ``as_of`` only, if given."""
    if as_of:
        momentum, events = (x.filter(F.col("date") == F.lit(as_of).cast("date")) for x in (momentum, events))
    x = momentum.join(events, ["date", "ticker"], "full").join(F.broadcast(reg.select("date", F.col("multiplier").alias("regime"))), "date", "left")  # one row per day
    x = x.fillna({"momentum_z": 0.0, "eca_z": 0.0, "regime": 1.0})
    raw = weight * F.col("momentum_z") + (1 - weight) * F.col("eca_z")
    x = x.withColumn("_raw", raw * F.col("regime") if gate else raw)
    return x.select("date", "ticker", "momentum_z", "eca_z", "regime", zscore("_raw", "date").alias("ensemble_z"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: dates, tickers, share of rows in percent with either signal, mean regime, first and last date."""
    active = lambda c: (F.avg((F.abs(c) > 1e-8).cast("double")) * 100).alias(f"pct_{c[:-2]}_active")
    return scores.agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"), active("momentum_z"), active("eca_z"), F.avg("regime").alias("avg_regime"), F.min("date").alias("first"), F.max("date").alias("last"))
