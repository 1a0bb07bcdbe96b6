"""Attributes as known at event time.

A value dated ``d`` and loaded at ``l`` is known from the midnight after both. What was the latest known date is a step
function of time; each step is an interval from one change to the next, closed at its start and open at its end.
Intervals that end are cut into time buckets and events meet them in an equi-join on entity and bucket; the last,
unending interval of an entity is met on the entity alone, one row each, so nothing is spread to a far horizon.
A column of the events that has an output's name is replaced.

Defined results: an event before the first known value gets NULL. Values with a NULL date, NULL load time (where load
times count) or no value never become known. Repeated events are one event; an event with a NULL entity gets NULLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import store

BUCKET_DAYS = 64


def validity_intervals(values: DataFrame, entity: list[str], date: str, loaded: str | None = None) -> DataFrame:
    """Intervals of the latest known ``date``: entity, ``value_date``, ``since``, ``until`` (days, until NULL when open).

    Deliveries of one date are merged before any window, so an entity has at most one row per day of the calendar,
    however often it was delivered.
    """
    day = F.unix_date(F.col(date))
    known = (F.greatest(day, F.unix_date(F.to_date(loaded))) if loaded else day) + 1
    first = values.dropna(subset=[*entity, date, *([loaded] if loaded else [])])
    first = first.select(*entity, day.alias("d"), known.alias("k")).groupBy(*entity, "d").agg(F.min("k").alias("k"))
    first = first.groupBy(*entity, "k").agg(F.max("d").alias("d"))
    w = W.partitionBy(*entity).orderBy("k")
    best = F.max("d").over(w.rowsBetween(W.unboundedPreceding, -1))
    steps = first.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col("d") > F.col("_best")))
    return steps.select(*entity, F.date_from_unix_date("d").alias("value_date"), F.col("k").alias("since"), F.lead("k").over(w).alias("until"))


def known_at(events: DataFrame, event_day: str, intervals: DataFrame, entity: list[str], out: str, bucket_days: int = BUCKET_DAYS, few: bool = False) -> DataFrame:
    """``events`` with the date ``out`` that was the latest known when ``event_day`` (days since 1970) began.

    ``few``: the intervals are those of one calendar, at most one a day, and are broadcast.
    """
    closed = intervals.filter("until is not null").select(*entity, F.col("value_date").alias("_closed"), "since", "until")
    closed = closed.withColumn("_bucket", F.explode(F.sequence(F.expr(f"since div {bucket_days}"), F.expr(f"(until - 1) div {bucket_days}"))))
    last = intervals.filter("until is null").select(*entity, F.col("value_date").alias("_last"), F.col("since").alias("_since"))
    # Stored intervals are far smaller than in memory, so their size must not make them broadcast unasked.
    closed, last = (F.broadcast(closed), F.broadcast(last)) if few else (closed.hint("merge"), last.hint("merge"))
    e = events.drop(out).withColumn("_bucket", F.expr(f"{event_day} div {bucket_days}")).alias("e")
    c = closed.alias("c")
    on = (F.col("e._bucket") == F.col("c._bucket")) & (F.col(f"e.{event_day}") >= F.col("c.since")) & (F.col(f"e.{event_day}") < F.col("c.until"))
    for k in entity:
        on = on & (F.col(f"e.{k}") == F.col(f"c.{k}"))
    got = e.join(c, on, "left").select("e.*", "c._closed").alias("g")
    la = last.alias("l")
    on = F.col(f"g.{event_day}") >= F.col("l._since")
    for k in entity:
        on = on & (F.col(f"g.{k}") == F.col(f"l.{k}"))
    if not entity:
        la = F.broadcast(last).alias("l")  # one row
    got = got.join(la, on, "left")
    return got.select("g.*", F.coalesce("l._last", "g._closed").alias(out)).drop("_closed", "_bucket")


def as_known(events: DataFrame, event_date: str, sources: list[dict]) -> DataFrame:
    """Distinct ``events`` with one date column per source (dicts: rows, entity, date, loaded, out, few)."""
    out = events.filter(F.col(event_date).isNotNull()).distinct().withColumn("_day", F.unix_date(event_date))
    for s in sources:
        steps = store(validity_intervals(s["rows"], s["entity"], s["date"], s.get("loaded")), "validity").df
        out = known_at(out, "_day", steps, s["entity"], s["out"], few=s.get("few", False))
    return out.drop("_day")
