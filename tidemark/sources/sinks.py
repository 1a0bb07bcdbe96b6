"""Tables written and read by name, with the fall-backs and guards of the pipeline, and texts from pages.

A table is a folder of Parquet files below a root that all executors share.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..runtime import store
from .tables import number


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write ``df`` in place of what the table held; its number of rows. The frame may read the table it replaces."""
    held = store(df, "replacement").df
    w = held.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return held.count()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows of ``schema`` where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error that names what is missing."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def universe(spark: SparkSession, path: str, core: list[str], column: str = "ticker") -> DataFrame:
    """Distinct names of a table, which may be missing, and of a core list."""
    names = read_or_empty(spark, path, f"{column} string").select(F.upper(F.trim(column)).alias(column))
    return names.union(spark.createDataFrame([(c,) for c in core], f"{column} string")).dropna().distinct()


def resolve_names(given: list[str] | None, table: list[str], listed: list[str], core: list[str]) -> list[str]:
    """Names given, else those of the table if it has clearly more than the core, else those of the list, else the core."""
    if given:
        return [g.upper() for g in given]
    return table if len(table) > len(core) + 5 else listed or sorted(core)


def call_row(split: DataFrame) -> DataFrame:
    """Rows of the calls table from split turns: quarter in small letters, ratios at 4 decimals, words counted."""
    at4 = lambda c: F.bround(c, 4).alias(c)
    return split.select(F.upper(F.trim("ticker")).alias("ticker"), F.lower("quarter").alias("quarter"), F.col("year").cast("int").alias("year"), "pub_date", "source", "has_qa", "n_turns", "n_exec_speakers", "n_analyst_speakers", "n_analyst_questions", "analyst_q_words", "exec_a_words", at4("answer_question_ratio"), at4("hedge_per_1k"), F.size(words(F.col("full_text"))).alias("n_words_full"), F.col("full_text").alias("full_z"), F.col("prepared_text").alias("prep_z"), F.col("qa_text").alias("qa_z"))


def sections_of(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``section`` and ``text`` of each call: all three if it has questions, else ``full`` alone. NULL texts count as empty."""
    one = lambda name, c: F.struct(F.lit(name).alias("section"), F.coalesce(c, F.lit("")).alias("text"))
    full = one("full", F.col("full_z"))
    three = F.array(one("prepared_remarks", F.col("prep_z")), one("qa", F.col("qa_z")), full)
    return calls.select(*keys, F.explode(F.when(F.col("has_qa") == 1, three).otherwise(F.array(full))).alias("_s")).select(*keys, "_s.*")


def new_records(listing: DataFrame, held: DataFrame, keys: list[str], by: str, date: str) -> DataFrame:
    """Listed records whose key is not held and whose date is after the last one held for their ``by``; all of those it
    holds none for."""
    last = held.groupBy(by).agg(F.max(date).alias("_last"))
    fresh = listing.join(held.select(*keys).distinct(), keys, "left_anti").join(last, by, "left")
    return fresh.filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")


def nearest_filing(events: DataFrame, date: str, filings: DataFrame, by: str, before: int = 1, after: int = 3) -> DataFrame:
    """Events with the exhibit to read: of the latest filing from ``before`` days before to ``after`` days after that has
    any exhibit, the first one numbered 99, else the first.

    ``filings``: ``by``, filed, seq, description, kind, url. Days of the window are spelled out, so the join is by equality.
    """
    asked = events.select(by, date).distinct().withColumn("filed", F.explode(F.sequence(F.date_sub(date, before), F.date_add(date, after))))
    is99 = F.contains(F.upper(F.coalesce("description", F.lit(""))), F.lit("99")) | F.contains(F.upper(F.coalesce("kind", F.lit(""))), F.lit("EX-99"))
    order = F.struct(F.unix_date("filed").alias("a"), is99.alias("b"), (-F.col("seq")).alias("c"))
    best = asked.join(filings, [by, "filed"]).groupBy(by, date).agg(F.max_by(F.struct("url", "filed", "description"), order).alias("_f"))
    return events.join(best, [by, date], "left").select(events["*"], F.col("_f.url").alias("url"), F.col("_f.filed").alias("filed"), F.col("_f.description").alias("description"))


def resume(candidates: DataFrame, path: str, keys: list[str], score, schema: str) -> tuple[DataFrame, int]:
    """Scores of all candidates: those that the table at ``path`` lacks are scored and appended, the others are read.

    An append is one commit of new files, so work that was lost is done again and work that was kept is not.
    """
    spark = candidates.sparkSession
    todo = candidates.join(read_or_empty(spark, path, schema).select(*keys).distinct(), keys, "left_anti")
    fresh = store(score(todo), "fresh").df
    n = fresh.count()
    if n:
        fresh.write.mode("append").option("compression", "zstd").parquet(path)
    return read_or_empty(spark, path, schema).join(candidates.select(*keys).distinct(), keys, "left_semi"), n


def covers(held: DataFrame, wanted: DataFrame, keys: list[str]) -> bool:
    """Whether every wanted key is held."""
    return wanted.select(*keys).join(held.select(*keys), keys, "left_anti").isEmpty()


def record_snapshot(rows: DataFrame, path: str, keys: list[str], day: str, schema: str) -> int:
    """Append the rows of keys not yet recorded on their day, partitioned by day; how many. Copies among them come once."""
    held = read_or_empty(rows.sparkSession, path, schema).select(*keys, day)
    fresh = store(rows.dropDuplicates([*keys, day]).join(held, [*keys, day], "left_anti"), "snapshot").df
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy(day).option("compression", "zstd").parquet(path)
    return n


def earnings_rows(raw: DataFrame, first: str = "2016-07-01") -> DataFrame:
    """Names in snake case, UTC instants as their day, rows from ``first`` on."""
    short = {"surprise(%)": "eps_surprise_pct"}
    clean = lambda c: re.sub(r"\s+", "_", c.strip().lower())
    x = raw.withColumnsRenamed({c: short.get(clean(c), clean(c)) for c in raw.columns})
    x = x.withColumn("earnings_date", F.to_date("earnings_date")).filter(F.col("earnings_date") >= F.lit(first).cast("date"))
    return x.select(*[number(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in x.dtypes])


class _Text(HTMLParser):
    """Text of a page by element, without scripts, styles and page furniture."""

    DROPPED = frozenset(("script", "style", "nav", "footer", "header"))
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.dropped = 0
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.elements: list[tuple[str, str]] = []  # tag, class
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.elements.append((tag, dict(attrs).get("class") or ""))
        self.stack.append(len(self.elements) - 1)
        self.dropped += tag in self.DROPPED

    def handle_endtag(self, tag):
        while self.stack and tag in [self.elements[i][0] for i in self.stack]:
            i = self.stack.pop()
            self.dropped -= self.elements[i][0] in self.DROPPED
            if self.elements[i][0] == tag:
                break

    def handle_data(self, data):
        if not self.dropped and data.strip():
            self.parts.append((data.strip(), tuple(self.stack)))

    def text(self, keep=None) -> str:
        return re.sub(r"\s+", " ", " ".join(t for t, at in self.parts if keep is None or keep in at)).strip()


def page_text(page: str | None) -> str | None:
    """The first container for a page's body, content or text with more than 200 characters, else the body, else all."""
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    rules = [lambda t, c: t == "div" and "body" in c.split(), lambda t, c: "body" in c.split(), lambda t, c: t == "div" and "body" in c, lambda t, c: t == "div" and "content" in c, lambda t, c: t == "div" and "text" in c]
    for rule in rules:
        at = next((i for i, (t, c) in enumerate(p.elements) if rule(t, c)), None)
        if at is not None and len(out := p.text(at)) > 200:
            return out
    return p.text(next((i for i, (t, _) in enumerate(p.elements) if t == "body"), None))


def page_text_column(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(page_text).astype(object).where(s.notna(), None), "string")(c)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def last_values(raw: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of each key the last present value of each column, which may come from different rows."""
    return raw.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(order, v))).alias(v) for v in values])


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(``name``, ``text``) of whole text files; the name is that of the file without its folder and ending."""
    x = spark.read.text(folder, wholetext=True)
    plain = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # the name comes in URL form
    return x.select(F.regexp_extract(plain, r"^(.+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))
