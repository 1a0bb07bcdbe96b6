"""Risk signals by date and the exposure multiplier made of them. Series have one row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import rolling_avg
from .market import on_calendar


def vix_signal(c: Column) -> Column:
    """0; above 25 -0.5; above 35 -1. Missing is neutral."""
    return F.when(c > 35, -1.0).when(c > 25, -0.5).otherwise(0.0)


def trend_signal(gap: Column) -> Column:
    """1; below the average 0; more than 10 % below -1. Missing counts as 1."""
    return F.when(gap < -0.10, -1.0).when(gap < 0, 0.0).otherwise(1.0)


def breadth_signal(share: Column) -> Column:
    """1; under half 0; under 30 % -1. Missing counts as 0."""
    return F.when(share.isNull(), 0.0).when(share < 0.30, -1.0).when(share < 0.50, 0.0).otherwise(1.0)


def credit_signal(change: Column) -> Column:
    return F.when(change < -0.05, -1.0).when(change < -0.02, -0.5).otherwise(0.0)


def breadth(prices: DataFrame, benchmarks: list[str], window: int = 200, least: int = 200) -> DataFrame:
    """(date, share): names above their own average over names with a close; before any average exists that is 0.

    Benchmarks are no names. Rows of the average are the dates on which any name has a close.
    """
    names = on_calendar(prices.filter(~F.col("ticker").isin(benchmarks) & F.col("close").isNotNull()))
    x = names.withColumn("_dma", rolling_avg("close", "ticker", "cal_idx", window, least))
    share = F.try_divide(F.sum(F.coalesce((F.col("close") > F.col("_dma")).cast("int"), F.lit(0))), F.count("close"))
    return x.groupBy("date").agg(share.alias("share"))


def credit_ratio(prices: DataFrame, risky: str, safe: str, window: int = 20) -> DataFrame:
    """(date, change): change of the padded ratio of two tickers over ``window`` rows where both trade."""
    a = prices.filter(F.col("ticker") == risky).select("date", F.col("close").alias("a"))
    b = prices.filter(F.col("ticker") == safe).select("date", F.col("close").alias("b"))
    x = a.join(b, "date").withColumn("ratio", F.try_divide("a", "b"))
    w = W.orderBy("date")  # one pair of series: a row per day
    x = x.withColumn("ratio", F.last("ratio", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.select("date", (F.try_divide("ratio", F.lag("ratio", window).over(w)) - 1).alias("change"))


def regime(prices: DataFrame, benchmark: str, vix: DataFrame, credit: DataFrame | None = None, benchmarks: list[str] | None = None) -> DataFrame:
    """Per benchmark date: signals, their sum, and the multiplier 1, 0.6 (caution) or 0.25 (any signal at -1).

    Signals are aligned to the benchmark's dates; a series without a value of that very date is neutral there, also VIX
    and breadth: nothing is carried forward.
    """
    spy = prices.filter((F.col("ticker") == benchmark) & F.col("close").isNotNull())
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(-199, 0)
    gap = F.try_divide("close", F.when(F.count("close").over(w) >= 200, F.avg("close").over(w))) - 1
    x = spy.withColumn("gap", gap).select("date", "gap")
    x = x.join(vix.select("date", "vix_close"), "date", "left").join(breadth(prices, benchmarks or [benchmark]), "date", "left")
    x = x.join(credit, "date", "left") if credit is not None else x.withColumn("change", F.lit(None).cast("double"))
    x = x.select("date", "vix_close", vix_signal(F.col("vix_close")).alias("vix"), trend_signal(F.col("gap")).alias("spy"), breadth_signal(F.col("share")).alias("breadth"), credit_signal(F.col("change")).alias("credit"))
    off = F.least("vix", "spy", "breadth", "credit") <= -1
    caution = (F.col("vix") < 0) | (F.col("spy") <= 0) | (F.col("breadth") <= 0) | (F.col("credit") < 0)
    return x.select("*", (F.col("vix") + F.col("spy") + F.col("breadth") + F.col("credit")).alias("composite"), F.when(off, 0.25).when(caution, 0.6).otherwise(1.0).alias("multiplier"))


def occupancy() -> list[Column]:
    """Share of days in percent at each multiplier."""
    pct = lambda m, name: (F.avg((F.col("multiplier") == m).cast("double")) * 100).alias(name)
    return [pct(1.0, "risk_on_pct"), pct(0.6, "caution_pct"), pct(0.25, "risk_off_pct")]


def stress_windows(reg: DataFrame, windows: list[tuple[str, str, str]]) -> DataFrame:
    """Occupancy, mean multiplier and mean VIX within each named window, both ends included; windows without days are left out."""
    inside = F.filter(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in windows]), lambda x: F.col("date").between(x["a"], x["b"]))
    x = reg.select("*", F.explode(inside).alias("_w"))
    return x.groupBy(F.col("_w.label").alias("label")).agg(F.count("*").alias("days"), F.avg("multiplier").alias("mean_multiplier"), F.avg("vix_close").alias("mean_vix"), *occupancy())


def forward_by_regime(reg: DataFrame, prices: DataFrame, benchmark: str, horizons: tuple[int, ...] = (21, 63)) -> DataFrame:
    """Mean return of the benchmark over its next rows by multiplier, over days that have all of them."""
    w = W.partitionBy("ticker").orderBy("date")
    bench = prices.filter(F.col("ticker") == benchmark)
    bench = bench.select("date", *[(F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1).alias(f"fwd_{n}") for n in horizons])
    x = reg.join(bench, "date").dropna(subset=[f"fwd_{n}" for n in horizons])
    return x.groupBy("multiplier").agg(F.count("*").alias("days"), *[F.avg(f"fwd_{n}").alias(f"fwd_{n}") for n in horizons])
