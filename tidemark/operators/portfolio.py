"""Position sizing, trades with costs, and the measures of a return series. Groups are the names of one date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clip, pct_rank


def size_one_date(df: DataFrame, by: str = "date", gross: float = 2.0, max_name: float = 0.03, max_sector: float = 0.25, net_cap: float = 0.2) -> DataFrame:
    """``weight`` from score over vol: demeaned, scaled to ``gross``, clipped and rescaled three times, clipped, then
    shifted where a sector's net or the whole net is beyond its cap. Unusable names, or fewer than 4, get 0."""
    w, ws = W.partitionBy(by), W.partitionBy(by, "sector")
    ok = F.col("score").isNotNull() & (F.col("vol") > 0)
    x = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    x = x.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w)).withColumn("_ok", F.col("_ok") & (F.col("_n") >= 4))
    x = x.withColumn("_w", F.when(F.col("_ok"), F.col("score") / F.col("vol")))
    x = x.withColumn("_w", F.col("_w") - F.avg("_w").over(w))
    scale = lambda: F.when(F.sum(F.abs("_w")).over(w) > 0, F.col("_w") * gross / F.sum(F.abs("_w")).over(w)).otherwise(F.col("_w") * 0)
    x = x.withColumn("_w", scale())
    for _ in range(3):
        x = x.withColumn("_w", clip("_w", -max_name, max_name)).withColumn("_w", scale())
    x = x.withColumn("_w", clip("_w", -max_name, max_name))
    net = F.sum("_w").over(ws)
    over = (net - F.signum(net) * max_sector) / F.sum(F.col("_ok").cast("int")).over(ws)
    x = x.withColumn("_w", F.when(F.col("sector").isNotNull() & (F.abs(net) > max_sector), F.col("_w") - over).otherwise(F.col("_w")))
    net = F.sum("_w").over(w)
    x = x.withColumn("_w", F.when(F.abs(net) > net_cap, F.col("_w") - (net - F.signum(net) * net_cap) / F.col("_n")).otherwise(F.col("_w")))
    return x.withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_w", "_ok", "_n")


def size_deciles(df: DataFrame, by: str = "date", top: float = 0.1, gross: float = 2.0, max_name: float = 0.03, sector_neutral: bool = False) -> DataFrame:
    """``weight``: inverse vol within the top and bottom fraction, half of ``gross`` each, clipped; 0 under 10 names."""
    w = W.partitionBy(by)
    ok = F.coalesce(F.col("score").isNotNull() & (F.col("vol") > 0), F.lit(False))
    x = df.withColumn("_s", F.when(ok, F.col("score")))
    if sector_neutral:
        x = x.withColumn("_s", F.col("_s") - F.avg("_s").over(W.partitionBy(by, F.coalesce("sector", F.lit("Other")))))
    x = x.withColumn("_p", pct_rank("_s", by)).withColumn("_n", F.count("_s").over(w))
    side = F.when(F.col("_n") < 10, 0).when(F.col("_p") >= 1 - top, 1).when(F.col("_p") <= top, -1).otherwise(0)
    x = x.withColumn("_side", side).withColumn("_inv", F.when(F.col("_side") != 0, 1 / F.col("vol")))
    leg = F.sum("_inv").over(W.partitionBy(by, "_side"))
    x = x.withColumn("weight", F.coalesce(clip(F.col("_side") * F.col("_inv") / leg * gross / 2, -max_name, max_name), F.lit(0.0)))
    return x.drop("_s", "_p", "_n", "_side", "_inv")


def book_stats(df: DataFrame, by: str = "date") -> DataFrame:
    a = F.abs("weight")
    return df.groupBy(by).agg(F.sum((F.col("weight") != 0).cast("bigint")).alias("n"), F.sum(a).alias("gross"), F.sum("weight").alias("net"), F.max(a).alias("max_abs"), F.try_divide(F.sum(a) * F.sum(a), F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"))


def trades(df: DataFrame, by: str, cutoff: float | Column = 0.2, hold: int = 30, least: int = 5, bps: float = 10, borrow_bps: float = 50) -> DataFrame:
    """Equal-weighted top and bottom ``cutoff`` of each group with at least ``least`` outcomes, with gross and net return.

    Every row with an outcome stays: ``side`` and ``weight`` are 0 without a score, off the tails and in small groups,
    which then return 0. ``ew`` is the row's part in the equal-weighted return of its group.
    """
    keys = [by] if isinstance(cutoff, float) else [by, "cutoff"]
    c = F.lit(cutoff) if isinstance(cutoff, float) else cutoff
    x = df.filter("actual is not null").withColumn("_p", pct_rank("score", *keys)).withColumn("n_names", F.count("*").over(W.partitionBy(*keys)))
    side = F.when(F.col("n_names") < least, 0).when(F.col("_p") >= 1 - c, 1).when(F.col("_p") <= c, -1).otherwise(0)
    # A name in both tails (a cutoff of one half) is long and short at once.
    both = (F.col("n_names") >= least) & (F.col("_p") >= 1 - c) & (F.col("_p") <= c)
    x = x.withColumn("side", side).withColumn("_long", F.coalesce((F.col("side") == 1), F.lit(False))).withColumn("_short", F.coalesce((F.col("side") == -1) | both, F.lit(False)))
    w = W.partitionBy(*keys)
    leg = lambda f: F.when(F.col(f), 1 / F.sum(F.col(f).cast("int")).over(w)).otherwise(0.0)
    x = x.withColumn("weight", leg("_long") - leg("_short"))
    cost = F.abs("weight") * (bps / 1e4) + F.when(F.col("weight") < 0, F.abs("weight") * (borrow_bps / 1e4) * hold / 252).otherwise(0.0)
    x = x.withColumn("gross", F.col("weight") * F.col("actual")).withColumn("net", F.col("gross") - cost).withColumn("ew", F.col("actual") / F.col("n_names"))
    return x.withColumnsRenamed({"_long": "is_long", "_short": "is_short"}).drop("_p")


def event_pnl(tr: DataFrame, by: list[str]) -> DataFrame:
    """Per group: names, gross, net and equal-weighted return, positions, mean outcome of the long and of the short leg."""
    n = lambda f: F.sum(F.col(f).cast("int")).cast("bigint")
    leg = lambda f: F.avg(F.when(F.col(f), F.col("actual")))
    return tr.groupBy(*by).agg(F.count("*").alias("n"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.sum("ew").alias("ew"), n("is_long").alias("n_long"), n("is_short").alias("n_short"), leg("is_long").alias("long_only"), leg("is_short").alias("short_raw"))


def long_short(panel: DataFrame, score: str, ret: str, by: str = "date", top: float = 0.1, hold: int = 21, bps: float = 10, borrow_bps: float = 50) -> DataFrame:
    """Per date: mean of the top less the bottom ``top`` by score, and net of a round trip on both legs and the borrow."""
    x = panel.withColumn("_p", pct_rank(score, by))
    gross = F.avg(F.when(F.col("_p") >= 1 - top, F.col(ret))) - F.avg(F.when(F.col("_p") <= top, F.col(ret)))
    cost = 2 * (bps / 1e4) + (borrow_bps / 1e4) * hold / 252
    return x.groupBy(by).agg(gross.alias("gross")).withColumn("net", F.col("gross") - cost)


def drawdowns(series: DataFrame, by: list[str], order: str, r: str) -> DataFrame:
    """``equity`` and ``drawdown`` of compounded returns; the peak starts after the first return."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = series.withColumn("equity", F.product(1 + F.col(r)).over(w)).withColumn("_peak", F.max("equity").over(w))
    return x.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("_peak"), F.col("_peak"))).drop("_peak")


def metrics(series: DataFrame, by: list[str], order: str, r: str, per_year: float) -> DataFrame:
    """n, total, CAGR (years at least 1/12), Sharpe (0 without spread), greatest drawdown, share of wins, mean; all 0 with
    fewer than two returns."""
    x = drawdowns(series, by, order, r)
    at = F.when(F.col(r).isNotNull(), F.col(order))
    out = x.groupBy(*by).agg(F.count(r).alias("n"), F.product(1 + F.col(r)).alias("_end"), F.avg(r).alias("avg"), F.stddev_samp(r).alias("_sd"), F.min(F.when(F.col(r).isNotNull(), F.col("drawdown"))).alias("max_drawdown"), F.avg((F.col(r) > 0).cast("double")).alias("win_rate"), F.datediff(F.max(at), F.min(at)).alias("_days"))
    years = F.greatest(F.col("_days") / 365.25, F.lit(1 / 12))
    cagr = F.when(F.col("_end") > 0, F.pow("_end", 1 / years) - 1)
    sharpe = F.when(F.col("_sd") == 0, 0.0).otherwise(F.col("avg") / F.col("_sd") * math.sqrt(per_year))
    two = lambda c: F.when(F.col("n") < 2, 0.0).otherwise(c)
    return out.select(*by, "n", two(F.col("_end") - 1).alias("total"), two(cagr).alias("cagr"), two(sharpe).alias("sharpe"), *[two(F.col(c)).alias(c) for c in ("max_drawdown", "win_rate", "avg")])


def rolling_sharpe(series: DataFrame, order: str, r: str, per_year: float, most: int = 20) -> DataFrame:
    """Over the last min(``most``, a quarter of all) periods, NULL before there are so many and where that is under 4.

    The series has one row per period, so its whole length is a row count of a calendar.
    """
    x = series.filter(F.col(r).isNotNull())
    at = F.row_number().over(W.orderBy(order))
    x = x.withColumn("_i", at).join(F.broadcast(x.agg(F.least(F.lit(most), F.floor(F.count("*") / 4)).cast("int").alias("_k"))))
    held = F.collect_list(F.col(r)).over(W.orderBy(order).rowsBetween(-(most - 1), 0))
    last = F.slice(held, F.greatest(F.size(held) - F.col("_k") + 1, F.lit(1)), F.greatest(F.col("_k"), F.lit(1)))
    sums = F.aggregate(last, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    x = x.withColumn("_m", sums["s"] / F.col("_k")).withColumn("_sd", F.sqrt(F.aggregate(last, F.lit(0.0), lambda a, v: a + (v - sums["s"] / F.col("_k")) * (v - sums["s"] / F.col("_k"))) / (F.col("_k") - 1)))
    value = F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd") * math.sqrt(per_year)).otherwise(0.0)
    return x.withColumn("rolling_sharpe", F.when((F.col("_k") >= 4) & (F.col("_i") >= F.col("_k")), value)).drop("_i", "_k", "_m", "_sd")
