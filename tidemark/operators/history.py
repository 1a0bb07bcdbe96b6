"""History of changing attributes as a bitemporal ledger.

Every delivery asserts, for one key and one valid day, either values or absence, from the time it was recorded. The
ledger says for each record time which values were believed to hold over which days. A late assertion for an earlier
day splits the interval that covered it: the old interval keeps its row, closed in record time, and two new ones take
over. Nothing is overwritten.

Defined results: NULL and NaN are one missing value, equal to itself. Rows that repeat an assertion change nothing.
Of two assertions recorded at the same instant, a present one beats an absent one, then the greater values win.
Rows with a NULL key part or NULL valid day take no part. Empty input gives an empty ledger.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_DAY = 2932896  # 9999-12-31 in days since 1970
OPEN_TS = "9999-12-31 00:00:00"
OPEN_MICROS = OPEN_DAY * 86_400_000_000


def _steps(valid: list[int], first: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Sweep over the valid days of one key, latest first: place of the day, since when it is so, end of its interval.

    ``first`` is when each day was first recorded. The end of a day's interval is the nearest later day known at the
    record time in question, so it takes one step per later-recorded nearer day. ``stack`` holds later days, nearest
    last, each first recorded before all nearer ones; each day enters and leaves it once.
    """
    at, since, end = [], [], []
    stack: list[tuple[int, int]] = []
    for i in range(len(valid) - 1, -1, -1):
        d, a = valid[i], first[i]
        later: list[tuple[int, int]] = []
        while stack and stack[-1][1] > a:
            later.append(stack.pop())
        at.append(i)
        since.append(a)
        end.append(stack[-1][0] if stack else OPEN_DAY)
        for d2, a2 in reversed(later):  # farther ones were recorded earlier
            at.append(i)
            since.append(a2)
            end.append(d2)
        if stack and stack[-1][1] == a:
            stack.pop()
        stack.append((d, a))
    return at, since, end


def _sweep(valid: pd.Series, first: pd.Series) -> pd.DataFrame:
    """Steps of each key with ``upto``, when the next step of the same day begins."""
    out: dict[str, list] = {k: [] for k in ("at", "since", "upto", "end")}
    for v, f in zip(valid, first):
        at, since, end = _steps(v.tolist(), f.tolist())
        same = [i + 1 < len(at) and at[i + 1] == at[i] for i in range(len(at))]  # steps of a day come in order of time
        out["at"].append(at)
        out["since"].append(since)
        out["upto"].append([since[i + 1] if same[i] else OPEN_MICROS for i in range(len(at))])
        out["end"].append(end)
    return pd.DataFrame(out)


def bitemporal_ledger(present: DataFrame, absent: DataFrame | None, keys: list[str], valid: str, recorded: str, values: list[str], withdrawn: DataFrame | None = None) -> DataFrame:
    """Ledger rows: keys, ``valid_from``, ``valid_to`` (dates, end exclusive, 9999-12-31 while open), ``recorded_from``,
    ``recorded_to`` (timestamps, likewise), ``present``, values.

    ``absent`` rows say that a key was looked for and not there; they count only where nothing was recorded before.
    ``withdrawn`` rows take back what was recorded for their key and valid day; they count whenever they come.

    Assertions are first reduced per key, valid day and record day, with copies merged before the shuffle, so a key
    that is delivered over and over is small before its history meets in one place. All that follows, chain, sweep
    and what callers do by key, refines one clustering by the keys. The sweep sees one entry per key and valid day.
    """
    types = dict(present.dtypes)
    none = [F.lit(None).cast(types[v]).alias(v) for v in values]
    kinds = [(present, F.lit(True), F.lit(False), [F.col(v).alias(v) for v in values]), (absent, F.lit(False), F.lit(True), none), (withdrawn, F.lit(False), F.lit(False), none)]
    parts = [df.select(*keys, F.col(valid).alias("_valid"), F.unix_micros(F.coalesce(F.col(recorded).cast("timestamp"), F.lit(0).cast("timestamp"))).alias("r"), F.struct(here.alias("present"), *vals).alias("v"), weak.alias("weak")) for df, here, weak, vals in kinds if df is not None]
    base = reduce(DataFrame.unionByName, parts).dropna(subset=[*keys, "_valid"])
    # Of one instant the greatest assertion counts, present before absent; then those equal to the one before go.
    day = F.expr(f"r div {86_400_000_000}")
    told = base.groupBy(*keys, "_valid", day.alias("_day")).agg(F.sort_array(F.collect_set(F.struct("r", "v", "weak"))).alias("_a"))
    last = F.filter("_a", lambda x, i: ~F.coalesce(F.get("_a", i + 1)["r"] == x["r"], F.lit(False)))
    told = told.select(*keys, "_valid", F.when(F.size("_a") == 1, F.col("_a")).otherwise(last).alias("_a"))
    fresh = F.filter("_a", lambda x, i: (i == 0) | ~F.get("_a", i - 1)["v"].eqNullSafe(x["v"]))
    told = told.select(*keys, "_valid", F.explode(F.when(F.size("_a") == 1, F.col("_a")).otherwise(fresh)).alias("_x"))

    rows = told.select(*keys, "_valid", "_x.*").repartition(*keys)
    cell = [*keys, "_valid"]
    w = W.partitionBy(*cell).orderBy("r")
    rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1 or not weak").drop("_n", "weak")
    rows = rows.withColumn("_b", F.lag(F.struct("v")).over(w)).filter(F.col("_b").isNull() | ~F.col("_b.v").eqNullSafe(F.col("v"))).drop("_b")
    rows = rows.withColumn("until", F.coalesce(F.lead("r").over(w), F.lit(OPEN_MICROS)))
    cells = rows.groupBy(*cell).agg(F.min("r").alias("first"), F.collect_list(F.struct("r", "until", "v")).alias("chain"))
    history = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.unix_date("_valid").alias("d"), "first", "chain"))).alias("_c"))
    sweep = F.pandas_udf(_sweep, "at array<int>, since array<bigint>, upto array<bigint>, end array<int>")
    history = history.withColumn("_p", sweep(F.col("_c.d"), F.col("_c.first")))
    # Each step takes its day along, so a row never holds the whole history of its key.
    steps = F.transform(F.arrays_zip("_p.at", "_p.since", "_p.upto", "_p.end"), lambda p: F.struct(F.get("_c", p["at"]).alias("c"), p["since"].alias("since"), p["upto"].alias("upto"), p["end"].alias("end")))
    out = history.select(*keys, F.explode(steps).alias("_s")).select(*keys, "_s.since", "_s.upto", "_s.end", F.col("_s.c.d").alias("d"), F.explode("_s.c.chain").alias("_x"))
    stamp = lambda c: F.timestamp_micros(c)
    out = out.select(*keys, F.date_from_unix_date("d").alias("valid_from"), F.date_from_unix_date("end").alias("valid_to"), stamp(F.greatest("since", "_x.r")).alias("recorded_from"), stamp(F.least("upto", "_x.until")).alias("recorded_to"), F.col("_x.v.present").alias("present"), *[F.col("_x.v")[v].alias(v) for v in values])
    return out.filter("recorded_from < recorded_to")


def believed(ledger: DataFrame, at: Column | None = None) -> DataFrame:
    """The ledger's rows as believed at a record time; without one, as believed now."""
    if at is None:
        return ledger.filter(F.col("recorded_to") == F.lit(OPEN_TS).cast("timestamp"))
    return ledger.filter((F.col("recorded_from") <= at) & (at < F.col("recorded_to")))


def versions(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adjacent intervals with equal values become one version; absences end versions and are left out.

    ``rows`` must not overlap in valid time, as :func:`believed` leaves them.
    """
    w = W.partitionBy(*keys).orderBy("valid_from")
    v = F.struct("present", *values)
    rows = rows.withColumn("_v", v)
    rows = rows.withColumn("_b", F.lag("_v").over(w))
    starts = rows.filter(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.col("_v")))
    starts = starts.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w), F.lit("9999-12-31").cast("date")))
    return starts.filter("present").select(*keys, "valid_from", "valid_to", *values)


def ledger_steps_reference(valid: list[int], first: list[int]) -> set[tuple[int, int, int]]:
    """The same steps by trying every record time; for tests."""
    out = set()
    for i, (d, a) in enumerate(zip(valid, first)):
        ends = []
        for t in sorted({x for x in first if x >= a}):
            known = sorted(v for v, f in zip(valid, first) if f <= t)
            k = bisect_left(known, d + 1)
            e = known[k] if k < len(known) else OPEN_DAY
            if not ends or ends[-1][1] != e:
                ends.append((t, e))
        out |= {(i, t, e) for t, e in ends}
    return out
