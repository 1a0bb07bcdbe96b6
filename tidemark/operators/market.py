"""Price panels on one trading calendar, event returns, momentum and liquidity.

Panels stay long: (ticker, cal_idx, ...), with ``cal_idx`` the 0-based position of a date in the calendar of all
dates that have any price. A ticker has at most one row per calendar date after :func:`clean_prices`, which bounds
every per-ticker window; the calendar itself has one row per day and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import at_offset, col, enough, many_pct_ranks, pct_rank, rolling_avg, rolling_std, trailing
from ..runtime import latest, store

WINDOWS = (1, 30, 90)


def calendar(prices: DataFrame) -> DataFrame:
    """(date, cal_idx) of all price dates. One row per day: the unpartitioned window is over a calendar."""
    days = prices.select("date").dropna().distinct()
    return days.withColumn("cal_idx", F.row_number().over(W.orderBy("date")) - 1)


def clean_prices(raw: DataFrame, keys: tuple[str, str] = ("ticker", "date"), order: str = "loaded_at") -> DataFrame:
    """The latest delivery of each (ticker, date), kept even where its prices are missing."""
    return latest(raw, list(keys), order).drop(order)


def on_calendar(prices: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """With ``cal_idx``; a calendar from the raw dates, if given, spares a pass over the cleaned prices."""
    return prices.join(F.broadcast(cal if cal is not None else calendar(prices)), "date")  # one row per day


def entries(events: DataFrame, event_date: str, cal: DataFrame) -> DataFrame:
    """``events`` with ``entry_idx``, the first calendar position on or after the event; NULL beyond the calendar.

    The calendar is spread to the days between its dates, so each event finds its row by equality.
    """
    w = W.orderBy("date")
    prev = F.coalesce(F.date_add(F.lag("date").over(w), 1), F.lit("1900-01-01").cast("date"))
    spans = cal.withColumn("_from", prev)
    first = F.min("date").over(W.partitionBy())
    spans = spans.withColumn("_first", first)
    days = spans.select(F.explode(F.sequence(F.greatest("_from", "_first"), "date")).alias("_d"), F.col("cal_idx").alias("entry_idx"))
    bound = cal.agg(F.min("date").alias("_lo"))
    e = events.join(F.broadcast(bound)).withColumn("_d", F.greatest(event_date, "_lo"))  # one row: the calendar's start
    return e.join(F.broadcast(days), "_d", "left").drop("_d", "_lo")


def event_window_returns(events: DataFrame, key: list[str], prices: DataFrame, cal: DataFrame, windows: tuple[int, ...], price: str = "close", forward: bool = True, benchmark: str | None = None) -> DataFrame:
    """``key`` with ``r{n}``: close n rows after the entry over close at entry, less 1 (or entry over n rows before).

    Each event asks for a few points of the calendar, of its ticker and, if given, of the ``benchmark`` (``b{n}``); one
    equi-join on (ticker, date), by which prices are already clustered, answers all of them. A missing price at the
    exact position gives NULL, nothing is filled.
    """
    step = 1 if forward else -1
    who = [("p", F.col("ticker"))] + ([("q", F.lit(benchmark))] if benchmark else [])
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t"), F.lit(n).alias("n"), (F.col("entry_idx") + step * n).alias("cal_idx")) for k, t in who for n in (0, *windows)])
    asked = events.select(*key, F.explode(wanted).alias("x")).select(*key, "x.*")
    asked = asked.join(F.broadcast(cal.select("cal_idx", F.col("date").alias("_at"))), "cal_idx", "left")  # one row per day
    px = prices.select(F.col("ticker").alias("t"), F.col("date").alias("_at"), F.col(price).alias("_px"))
    got = asked.join(px, ["t", "_at"], "left")
    out = got.groupBy(*key).agg(*[F.max(F.when((F.col("k") == k) & (F.col("n") == n), F.col("_px"))).alias(f"_{k}{n}") for k, _ in who for n in (0, *windows)])
    ratio = lambda k, n: F.try_divide(f"_{k}{n}", f"_{k}0") if forward else F.try_divide(f"_{k}0", f"_{k}{n}")
    return out.select(*key, *[(ratio(k, n) - 1).alias(f"{'r' if k == 'p' else 'b'}{n}") for k, _ in who for n in windows])


def known_daily(df: DataFrame, day: str, series: DataFrame, date: str, value: str) -> DataFrame:
    """``df`` with ``value``: the last non-missing value of a daily series on or before ``day``.

    Each value is spread over the days until the next one; after the last date the last value holds. Both sides of the
    join are calendars, a row per day.
    """
    s = series.select(F.col(date).alias("_d"), F.col(value)).dropna().groupBy("_d").agg(F.max(value).alias(value))
    upto = F.coalesce(F.date_sub(F.lead("_d").over(W.orderBy("_d")), 1), F.col("_d"))
    days = s.withColumn("_upto", upto).select(F.explode(F.sequence("_d", "_upto")).alias("_day"), F.col(value).alias("_v"))
    end = s.agg(F.max_by(value, "_d").alias("_last"), F.max("_d").alias("_end"))
    x = df.drop(value).join(F.broadcast(days), F.col(day) == F.col("_day"), "left").join(F.broadcast(end))  # the end is one row
    return x.withColumn(value, F.coalesce("_v", F.when(F.col(day) > F.col("_end"), F.col("_last")))).drop("_day", "_v", "_last", "_end")


def event_returns(events: DataFrame, prices: DataFrame, cal: DataFrame, benchmark: str, vix: DataFrame, special: tuple[str, str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Returns after each event, less the benchmark's over the same rows, with the last known VIX and a period flag."""
    key = ["ticker", "earnings_date"]
    out = event_window_returns(entries(events, "earnings_date", cal), key, prices, cal, windows, benchmark=benchmark)
    out = known_daily(out, "earnings_date", vix, "date", "vix_close")
    cols = [F.col(f"r{n}").alias(f"return_{n}d") for n in windows] + [(F.col(f"r{n}") - F.col(f"b{n}")).alias(f"abnormal_{n}d") for n in windows]
    return out.select(*key, *cols, "vix_close", F.col("earnings_date").between(*special).alias("is_covid"))


def daily_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", F.try_divide("close", at_offset("close", "ticker", "cal_idx", -1)) - 1)


def rolling(c: str, fn: Column, n: int, least: int, shift: int = 0) -> Column:
    return enough(fn, c, trailing("ticker", "cal_idx", n, shift), least)


def lagged(n: int) -> Column:
    return F.try_divide("close", at_offset("close", "ticker", "cal_idx", -n)) - 1


def momentum_features(panel: DataFrame, benchmark: str) -> DataFrame:
    """The 13 price features per (ticker, cal_idx), all from two windowed passes over one partitioning."""
    x = daily_returns(panel)
    m = x.filter(F.col("ticker") == benchmark).select("cal_idx", F.col("r").alias("m"), "close", "ticker")
    m = m.withColumn("mom_m", F.try_divide(1 + lagged(252), 1 + lagged(21)) - 1)
    wm = trailing("ticker", "cal_idx", 252)
    m = m.withColumn("m_avg", enough(F.avg("m"), "m", wm, 126)).withColumn("m_var", enough(F.var_samp("m"), "m", wm, 126))
    x = x.join(F.broadcast(m.select("cal_idx", "m", "mom_m", "m_avg", "m_var")), "cal_idx", "left")  # one row per day
    x = x.withColumn("rm", F.col("r") * F.col("m"))
    x = x.select("*", lagged(5).alias("rev_5d"), lagged(21).alias("rev_21d"), lagged(126).alias("r126"), lagged(252).alias("r252"), rolling("close", F.max("close"), 252, 200).alias("hi"), rolling_std("r", "ticker", "cal_idx", 60, 40).alias("vol_60d"), rolling_std("r", "ticker", "cal_idx", 20, 15).alias("vol_20d"), rolling_avg("rm", "ticker", "cal_idx", 252, 126).alias("rm_avg"), rolling_avg("r", "ticker", "cal_idx", 252, 126).alias("r_avg"))
    x = x.withColumn("mom_12_1", F.try_divide(1 + F.col("r252"), 1 + F.col("rev_21d")) - 1).withColumn("mom_6_1", F.try_divide(1 + F.col("r126"), 1 + F.col("rev_21d")) - 1)
    x = x.withColumn("dist_52wk", F.try_divide("close", "hi") - 1).withColumn("beta_252", F.try_divide(F.col("rm_avg") - F.col("r_avg") * F.col("m_avg"), F.col("m_var")))
    x = x.withColumn("idio_mom", F.col("mom_12_1") - F.col("beta_252") * F.col("mom_m"))
    va = lambda c, v: F.when(F.col(v) > 1e-8, F.col(c) / F.col(v))
    return x.select("ticker", "date", "cal_idx", "close", *([c for c in ("volume",) if c in x.columns]), *BASE, va("mom_12_1", "vol_60d").alias("mom_12_1_va"), va("mom_6_1", "vol_60d").alias("mom_6_1_va"), va("idio_mom", "vol_60d").alias("idio_mom_va"), va("rev_5d", "vol_20d").alias("rev_5d_va"))


BASE = ["mom_12_1", "mom_6_1", "rev_5d", "rev_21d", "dist_52wk", "vol_60d", "vol_20d", "beta_252", "idio_mom"]
SIGNS = {"mom_12_1": 1, "mom_6_1": 1, "idio_mom": 1, "dist_52wk": 1, "mom_12_1_va": 1, "mom_6_1_va": 1, "idio_mom_va": 1, "rev_5d": -1, "rev_21d": -1, "vol_60d": -1, "rev_5d_va": -1}


def liquidity(panel: DataFrame) -> DataFrame:
    x = panel.withColumn("dv", F.col("close") * F.col("volume"))
    x = x.withColumn("a21", rolling_avg("dv", "ticker", "cal_idx", 21, 15)).withColumn("a126", rolling_avg("dv", "ticker", "cal_idx", 126, 60))
    return x.withColumn("turn_trend", F.when(F.col("a126") > 0, F.col("a21") / F.col("a126") - 1)).withColumn("log_adv", F.when(F.col("a21") > 0, F.log("a21"))).drop("dv", "a21", "a126")


def month_ends(cal: DataFrame, warmup: int, hold: int) -> DataFrame:
    """The last calendar date of each month, from row ``warmup`` on, with ``hold`` rows left after it."""
    last = cal.groupBy(F.trunc("date", "MM").alias("_m")).agg(F.max("cal_idx").alias("cal_idx"))
    n = cal.agg(F.max("cal_idx").alias("_n"))
    return last.join(F.broadcast(n)).filter((F.col("cal_idx") >= warmup) & (F.col("cal_idx") <= F.col("_n") - hold)).select("cal_idx")


RANKED = [*BASE, "mom_12_1_va", "mom_6_1_va", "idio_mom_va", "rev_5d_va", "turn_trend", "log_adv"]


def rebalance_rows(prices: DataFrame, cal: DataFrame, benchmark: str, sector: Column, hold: int = 21, warmup: int = 260) -> DataFrame:
    """Month-end rows with features, liquidity and the return ahead less beta times the benchmark's, stored."""
    panel = on_calendar(prices, cal)
    f = liquidity(momentum_features(panel, benchmark))
    ahead = F.try_divide(at_offset("close", "ticker", "cal_idx", hold), F.col("close")) - 1
    f = f.withColumn("raw_target", ahead)
    f = f.join(F.broadcast(month_ends(cal, warmup, hold)), "cal_idx", "left_semi").withColumn("sector", sector)
    f = store(f, "rebalances").df  # a month's rows for each name, the benchmark's among them
    bench = f.filter(F.col("ticker") == benchmark).select("cal_idx", F.col("raw_target").alias("_bt"))
    f = f.join(F.broadcast(bench), "cal_idx", "left").withColumn("target", F.col("raw_target") - F.col("beta_252") * F.col("_bt")).drop("_bt")
    return f.filter((F.col("ticker") != benchmark) & F.col("target").isNotNull() & F.col("mom_12_1").isNotNull())


def scored_panel(prices: DataFrame, cal: DataFrame, benchmark: str, sector: Column, signs: dict[str, int] = SIGNS, **when) -> DataFrame:
    """Month-end rows with their sector ranks ``{c}_sn`` and the composite, as :func:`composite` would make it of them.

    Both kinds of ranks come from one long form of keys, names and values; only the first is ranked again by date.
    """
    f = rebalance_rows(prices, cal, benchmark, sector, **when)
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in RANKED])
    long = f.select("date", "ticker", "sector", F.explode(each).alias("x")).select("date", "ticker", "sector", "x.*")
    long = long.withColumn("sn", pct_rank("v", "date", "sector", "name"))
    sign = F.create_map(*[F.lit(x) for c, v in signs.items() for x in (c, float(v))])
    long = long.withColumn("p", pct_rank("v", "date", "name")).withColumn("q", pct_rank("sn", "date", "name")).withColumn("s", F.try_element_at(sign, "name"))
    signed = F.when(F.col("s").isNotNull(), F.col("s") * (F.col("p") + F.col("q")))
    total = F.when(F.count(signed) == len(signs), F.sum(signed) / (2 * len(signs)))
    wide = long.groupBy("date", "ticker").agg(*[F.max(F.when(F.col("name") == c, F.col("sn"))).alias(f"{c}_sn") for c in RANKED], total.alias("composite"))
    return f.join(wide, ["date", "ticker"])


def momentum_panel(prices: DataFrame, cal: DataFrame, benchmark: str, sector: Column, **when) -> DataFrame:
    """Month-end rows with their sector ranks."""
    f = rebalance_rows(prices, cal, benchmark, sector, **when)
    long = many_pct_ranks(f, RANKED, ["date", "sector"], ["date", "ticker"])
    wide = long.groupBy("date", "ticker").agg(*[F.max(F.when(F.col("_name") == c, F.col("_p"))).alias(f"{c}_sn") for c in RANKED])
    return f.join(wide, ["date", "ticker"])


def composite(panel: DataFrame, signs: dict[str, int] = SIGNS) -> DataFrame:
    """``composite``: the mean of signed percent ranks by date over the signed columns and their sector ranks."""
    use = {c + s: v for c, v in signs.items() for s in ("", "_sn") if c + s in panel.columns}
    sign = F.create_map(*[F.lit(x) for c, v in use.items() for x in (c, float(v))])
    panel = store(panel, "ranked").df
    long = many_pct_ranks(panel, list(use), ["date"], ["date", "ticker"])
    total = F.when(F.count("_p") == len(use), F.sum(sign[F.col("_name")] * F.col("_p")) / len(use))
    return panel.join(long.groupBy("date", "ticker").agg(total.alias("composite")), ["date", "ticker"])
