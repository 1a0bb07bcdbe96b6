"""Small relational operators: attributes by key, selections by coverage or score, top and bottom rows, positions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..runtime import store


def with_attribute(df: DataFrame, dimension: DataFrame, key: str, attribute: str, default: str) -> DataFrame:
    """``df`` with ``attribute`` of its key from a dimension table, ``default`` where it is unknown or NULL.

    Of a key that the dimension holds several times the greatest attribute counts. A column of that name is replaced.
    """
    d = store(dimension.groupBy(key).agg(F.max(attribute).alias(attribute)), "dimension")
    return df.drop(attribute).join(d.hinted(), key, "left").withColumn(attribute, F.coalesce(attribute, F.lit(default)))


def valid_calls(df: DataFrame, first_year: int = 2005, year: str = "year", quarter: str = "quarter", text: str | None = None) -> DataFrame:
    """Rows of a year from ``first_year`` on and a quarter q1 to q4, with a text that is not blank, if one is named."""
    ok = (F.col(year) >= first_year) & F.col(quarter).rlike("^q[1-4]$")
    return df.filter(ok & (F.length(F.trim(text)) > 0) if text else ok)


def coverage(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Share of present values of each column, by one aggregate."""
    if not cols:
        return {}
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"_{i}"] / row["_n"] if row["_n"] else 0.0 for i, c in enumerate(cols)}


def select_candidates(df: DataFrame, groups: list[tuple[str, float]], leaky: list[str]) -> list[str]:
    """Numeric columns whose name matches the first pattern of ``groups`` that fits it and that are covered above its
    share, in the order of the groups and without repeats; ``leaky`` ones never."""
    numeric = [f.name for f in df.schema.fields if (isinstance(f.dataType, NumericType) or f.dataType.simpleString() == "boolean") and f.name not in leaky]
    share = coverage(df, numeric)
    out: list[str] = []
    taken: set[str] = set()
    for pattern, least in groups:
        mine = [c for c in numeric if c not in taken and re.search(pattern, c)]
        taken |= set(mine)
        out += [c for c in mine if share[c] > least]
    return ordered_distinct(out)


def ordered_distinct(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def prefixed(df: DataFrame, prefix: str, mark: str, keep: list[str]) -> DataFrame:
    """The old schema without prefixes, known by the column ``mark``, renamed to the new one; other frames unchanged."""
    if mark not in df.columns or f"{prefix}{mark}" in df.columns:
        return df
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def fill_median(df: DataFrame, c: str) -> DataFrame:
    """Missing values by the exact median of all rows; counts per distinct value keep the rows out of one task."""
    m = exact_quantiles(df, c, [0.5]).select(F.col("q")[0].alias("_m"))
    return df.join(F.broadcast(m)).withColumn(c, F.coalesce(c, "_m")).drop("_m")  # one row


def exact_quantiles(df: DataFrame, c: str, probs: list[float], ranges: int = 256) -> DataFrame:
    """One row ``q``: exact quantiles with linear interpolation, NULL without values.

    Values are counted, the counts summed over ranges cut at approximate quantiles and within each range, so the work is
    spread however many values there are; only the rows around each quantile come together.
    """
    values = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n"))
    values = store(values, "values").df
    cuts = values.agg(F.percentile_approx("v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10000).alias("_e"))
    x = values.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("v")))).drop("_e")  # one row
    per = x.groupBy("_b").agg(F.sum("n").alias("_c"))
    w = W.orderBy("_b")  # a row per range
    per = per.select("_b", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_n"))
    x = x.join(F.broadcast(per), "_b").withColumn("_to", F.col("_before") + F.sum("n").over(W.partitionBy("_b").orderBy("v")))
    x = x.withColumn("_from", F.col("_to") - F.col("n") + 1)
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), (F.floor(F.lit(p) * (F.col("_n") - 1)) + 1 + k).alias("at"), (F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))).alias("part")) for i, p in enumerate(probs) for k in (0, 1)])
    near = x.select("v", F.explode(F.filter(spots, lambda s: s["at"].between(F.col("_from"), F.col("_to")))).alias("s"))
    low = lambda i: F.max(F.when((F.col("s.i") == i) & (F.col("s.k") == 0), F.col("v")))
    high = lambda i: F.max(F.when((F.col("s.i") == i) & (F.col("s.k") == 1), F.col("v")))
    part = lambda i: F.max(F.when(F.col("s.i") == i, F.col("s.part")))
    return near.agg(F.array(*[low(i) + F.coalesce((high(i) - low(i)) * part(i), F.lit(0.0)) for i in range(len(probs))]).alias("q"))


def top_k(df: DataFrame, score: str, k: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), *tie).limit(k)


def feature_count(rows: int, low: int = 8, high: int = 20) -> int:
    """More rows support more features: one per 400 rows, within bounds."""
    return max(low, min(high, rows // 400))


def head_tail(df: DataFrame, score: str, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` greatest and the ``k`` least rows; a row that is both comes once."""
    best = top_k(df.filter(F.col(score).isNotNull()), score, k, tie)
    worst = df.filter(F.col(score).isNotNull()).orderBy(F.col(score).asc(), *[F.desc(t) for t in tie]).limit(k)
    return best.union(worst).distinct()


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` rows in the order of a digest of their keys: the same rows wherever and however often it runs."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys)), *keys).limit(n)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys both hold, and whether ``b`` holds all of ``a``."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "left")
    return x.agg(F.count("_b").alias("both"), (F.count("*") == F.count("_b")).alias("covered"))


def covered_entities(df: DataFrame, entity: str, c: str, least: float = 0.6) -> DataFrame:
    """Entities at least ``least`` of whose rows have a value of ``c``."""
    return df.groupBy(entity).agg(F.avg(F.col(c).isNotNull().cast("double")).alias("coverage")).filter(F.col("coverage") >= least)


def describe_calls(meta: DataFrame) -> DataFrame:
    """One row about a table of calls: entities, dates, share with questions, medians."""
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")  # noqa: E731  over counts of a call, few distinct values
    return meta.agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("pub_date").alias("first"), F.max("pub_date").alias("last"), F.avg("has_qa").alias("qa_share"), med("n_words_full"), med("n_analyst_questions"))


def row_position(df: DataFrame, date: str, tie: list[str]) -> DataFrame:
    """``position`` (from 0) and ``total`` of each row in the order of ``date`` and ``tie``, rows without a date last.

    Rows are numbered within their date; the counts of earlier dates, a calendar, are added. No task sees all rows.
    """
    per = df.groupBy(date).agg(F.count("*").alias("_c"))
    w = W.orderBy(F.col(date).asc_nulls_last())
    per = per.select(F.col(date).alias("_d"), (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("total"))
    x = df.join(F.broadcast(per), F.col(date).eqNullSafe(F.col("_d")))  # a row per day
    return x.withColumn("position", F.col("_before") + F.row_number().over(W.partitionBy(date).orderBy(*tie)) - 1).drop("_d", "_before")


def row_folds(df: DataFrame, date: str, tie: list[str], k: int = 3, start: float = 0.7) -> DataFrame:
    """``fold`` by row position: 0 for the first ``start`` of all rows, then ``k`` stretches whose bounds are evenly spaced
    and cut down to whole rows."""
    x = row_position(df, date, tie)
    first = F.floor(F.col("total") * start + 1e-9)
    bound = lambda i: F.floor(first + (F.col("total") - first) * i / k + 1e-9)
    fold = reduce(lambda a, b: a + b, [(F.col("position") >= bound(i)).cast("int") for i in range(k)])
    return x.withColumn("fold", fold).drop("position", "total")


def long_table(df: DataFrame, ids: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide columns as rows: ``ids``, ``name`` (the new name of each column), ``value``; missing values keep their rows."""
    return df.select(*ids, *[F.col(c).alias(n) for c, n in columns.items()]).unpivot(ids, list(columns.values()), name, value)


def as_number(c: str | Column) -> Column:
    """A number from any text or number; NULL where it is none, and for NaN."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(v), v)


def hold_days(target: str, default: int = 1) -> int:
    """Trading days in the name of a target, as in ``abnormal_30d``."""
    m = re.search(r"(\d+)d", target)
    return int(m.group(1)) if m else default


def raw_target(target: str) -> str:
    """The target behind an adjusted one."""
    return re.sub("_va$", "", target)


def prediction_column(columns: list[str]) -> str | None:
    """The column of predictions, those of the raw target before those of an adjusted one."""
    return min((c for c in columns if c.startswith("predicted_")), key=lambda c: (c.endswith("_va"), c), default=None)
