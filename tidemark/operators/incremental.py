"""Keyed tables that grow: upserts, resumable work, cut-offs, stratified samples, calendars of rules, JSON scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import latest

# Fields of a score, their least and greatest value, and whether they may be NULL.
SCORE_FIELDS = {
    "guidance_direction": (-1, 1, True),
    "guidance_confidence": (0, 2, True),
    "demand_outlook": (-2, 2, False),
    "margin_outlook": (-2, 2, False),
    "n_questions_dodged": (0, 30, False),
    "tone_numbers_gap": (-2, 2, False),
    "unexpected_negative": (0, 1, False),
    "analyst_pushback": (0, 2, False),
}


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The union with one row per key, the latest by ``order``; columns of either side only are NULL on the other."""
    return latest(existing.unionByName(new, allowMissingColumns=True), keys, order)


def todo(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti")


def after_cutoff(candidates: DataFrame, existing: DataFrame, by: str, date: str) -> DataFrame:
    """Candidates later than the last date already held for their ``by``; all of those it holds none for."""
    last = existing.groupBy(by).agg(F.max(date).alias("_last"))
    return candidates.join(last, by, "left").filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")


def stratified_sample(entities: DataFrame, key: str, stratum: str, n: int) -> DataFrame:
    """About ``n`` whole entities: of each stratum its share, at least one, in the order of a digest of their key; of these,
    strata by name, no more than ``n``.

    A distributed rank would only matter for strata of very many entities; entities here are a list of names.
    """
    w = W.partitionBy(stratum)
    x = entities.select(key, stratum).distinct()
    share = F.least(F.lit(1.0), F.lit(float(n)) / F.greatest(F.count("*").over(W.partitionBy()), F.lit(1)))
    x = x.withColumn("_n", F.row_number().over(w.orderBy(F.md5(key), key)))
    x = x.withColumn("_k", F.greatest(F.lit(1), F.bround(F.count("*").over(w) * share).cast("int"))).filter("_n <= _k")
    return x.orderBy(stratum, "_n").limit(n).select(key, stratum)


def fiscal_quarter(df: DataFrame, date: str, rules: DataFrame) -> DataFrame:
    """``quarter`` and fiscal ``year`` by the first rule of the ticker whose months, which may wrap, hold the date.

    ``rules``: ticker, month_start, month_end, quarter, year_offset, rule_order; spread to one row per month.
    """
    span = F.when(F.col("month_end") >= F.col("month_start"), F.col("month_end")).otherwise(F.col("month_end") + 12)
    m = rules.withColumn("_m", F.explode(F.sequence("month_start", span))).withColumn("_m", F.pmod(F.col("_m") - 1, F.lit(12)) + 1)
    m = m.groupBy("ticker", "_m").agg(F.min(F.struct("rule_order", "quarter", "year_offset")).alias("_r"))
    x = df.withColumn("_m", F.month(date)).join(m, ["ticker", "_m"], "left")
    return x.withColumn("quarter", F.col("_r.quarter")).withColumn("year", F.year(date) + F.col("_r.year_offset")).drop("_m", "_r")


def first_in_window(events: DataFrame, date: str, rows: DataFrame, row_date: str, by: str, before: int, after: int, out: str) -> DataFrame:
    """``out``: the first ``row_date`` of the same ``by`` from ``before`` days before to ``after`` days after."""
    asked = events.select(by, date).distinct().withColumn("_d", F.explode(F.sequence(F.date_sub(date, before), F.date_add(date, after))))
    got = asked.join(rows.select(by, F.col(row_date).alias("_d")).distinct(), [by, "_d"]).groupBy(by, date).agg(F.min("_d").alias(out))
    return events.join(got, [by, date], "left")


def json_object(text: Column) -> Column:
    """The object of an answer with prose or code fences around it."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(F.length(fenced) > 0, fenced).otherwise(bare), F.lit(""))


def validate_scores(json: Column, fields: dict = SCORE_FIELDS) -> Column:
    """Struct of the fields as integers within their bounds, rounded half to even; NULL if any field is not valid."""

    def checked(m: Column) -> Column:
        cols, valid = [], m.isNotNull()
        for f, (low, high, nullable) in fields.items():
            raw = F.try_element_at(m, F.lit(f))
            v = raw.try_cast("double")
            ok = v.isNotNull() & ~F.isnan(v) & ~raw.isin("true", "false")
            valid = valid & F.map_contains_key(m, f) & ((ok | raw.isNull()) if nullable else ok)
            cols.append(F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.bround(v).cast("int")))).alias(f))
        return F.when(F.coalesce(valid, F.lit(False)), F.struct(*cols))

    # Bound by a lambda, the answer is parsed once and not once per field.
    return F.transform(F.array(F.from_json(json_object(json), "map<string,string>")), checked)[0]
