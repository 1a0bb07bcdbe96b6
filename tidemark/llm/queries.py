"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import latest, latest_files, store
from ..sources.tables import calls_key, day, lowered, read, ticker
from .leaks import exact_leaks, leaks, matched_windows
from .mixing import exact_total, mix, mix_plan, mix_report, token_count
from .nearest_time import nearest
from .reading_level import fit_levels, level_column
from .repeated_lines import line_sets, repeated_lines, without_lines
from .split_text import split_spans
from .visual_form import lookalike_classes, lookalike_pairs, visual_form_column

CALL = ["ticker", "quarter", "year"]


def calls(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return latest_files(spark, f"{sf_dir}/transcripts_text.parquet", calls_key(), "loaded_at", columns)


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir, ["source", "full_z"]).withColumn("source", lowered("source"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_paged(spark, sf_dir), CALL, "source", "full_z", "ticker")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's page text without the lines of :func:`p1_found`."""
    docs = _paged(spark, sf_dir)
    _, sure = line_sets(docs, CALL, "source", "full_z", "ticker")
    return without_lines(docs, sure, "source", "full_z", "ticker").select(*CALL, "n_removed", "kept_text")


def _calls_with_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read(spark, sf_dir, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "pub_date", "loaded_at")
    return latest(meta, CALL, "loaded_at").select(*CALL, "pub_date")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    earnings = read(spark, sf_dir, "earnings").select(ticker().alias("t"), F.col("earnings_date").alias("d"))
    return nearest(_calls_with_date(spark, sf_dir), "ticker", "pub_date", earnings, "t", "d", 30, "earnings_date")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).filter("earnings_date is not null").select(*CALL, day("earnings_date").alias("earnings_date"))


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with ``matched_earnings_date`` and ``day_diff`` as they should be, and whether the older run agrees."""
    now = _matched(spark, sf_dir).select(*CALL, F.col("earnings_date").alias("m"), F.abs(F.datediff("earnings_date", "pub_date")).alias("day_diff"))
    old = read(spark, sf_dir, "sentiment_features").select(*[e.alias(k) for k, e in calls_key().items()], F.col("matched_earnings_date").alias("om"), F.col("day_diff").alias("od"))
    old = old.groupBy(*CALL).agg(F.max(F.struct("om", "od")).alias("o"))
    same = F.col("o.om").eqNullSafe(F.col("m")) & F.col("o.od").eqNullSafe(F.col("day_diff"))
    return now.join(old, CALL, "left").select(*CALL, day("m").alias("matched_earnings_date"), "day_diff", F.when(F.col("o").isNotNull(), same).alias("agrees"))


def _sections(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    c = calls(spark, sf_dir, list(fields))
    rows = [F.struct(F.lit(f).alias("section"), F.col(f).alias("text")) for f in fields]
    return c.select(*CALL, F.explode(F.array(*rows)).alias("x")).select(*CALL, "x.*").filter("text is not null")


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each non-empty section, with the measures behind it."""
    rows = _sections(spark, sf_dir, ("prep_z", "qa_z"))
    model = fit_levels(read(spark, sf_dir, "level_samples"), "text", "grade")
    return rows.select(*CALL, "section", level_column(model, rows, F.col("text")).alias("l")).filter("l.level is not null").select(*CALL, "section", "l.*")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_levels(spark, sf_dir).filter("level >= 20").select(*CALL, "section")


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, words and sentences by whole level."""
    rows = p3_levels(spark, sf_dir).withColumn("level", F.round("level").cast("int"))
    return rows.groupBy("section", "level").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir, ("full_z", "qa_z")).withColumnRenamed("section", "field")
    return rows.withColumn("spans", split_spans(F.col("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).filter(F.size("spans") > 1).select(*CALL, "field")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir).select(*CALL, "field", "text", F.posexplode("spans").alias("piece_no", "s"))
    return rows.select(*CALL, "field", (F.col("piece_no") + 1).alias("piece_no"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("piece"))


def p5_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text make together: the text itself, and whether all are within the limit, share with the
    one before no more than the overlap and something, and end after white space or within a word that fills a piece."""
    before = lambda i: F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)
    own = F.transform("spans", lambda s, i: F.substring("text", before(i) + 1, s["end"] - before(i)))
    n, last = F.char_length("text"), F.size("spans") - 1
    shared = lambda s, i: before(i) - s["start"]
    each = F.transform("spans", lambda s, i: F.struct(s["end"].alias("end"), (s["end"] - s["start"] <= 4000).alias("fits"), ((i == 0) | shared(s, i).between(1, 200)).alias("shares"), ((i == last) | F.substring("text", s["end"], F.lit(1)).rlike(r"(?U)\s") | ~F.substring("text", before(i) + 1, s["end"] - before(i)).rlike(r"(?U)\s")).alias("natural")))
    x = _split(spark, sf_dir).select(*CALL, "field", n.alias("n_chars"), F.md5(F.array_join(own, "")).alias("digest"), (F.size("spans") > 1).alias("cut"), each.alias("e"))
    every = lambda k: F.forall("e", lambda s: s[k]).alias(k)
    return x.select(*CALL, "field", "n_chars", "digest", "cut", every("fits"), every("shares"), every("natural"))


def _windows(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    return matched_windows(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "text", placed=placed)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_leaks(_windows(spark, sf_dir))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact leaks and those with other numbers, names or units."""
    return leaks(_windows(spark, sf_dir, placed=True))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", lowered("source").alias("source"), token_count(F.col("text")).alias("n_tokens"))
    return store(docs, "sizes").df


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "mix_targets").select(lowered("source").alias("source"), "target_weight", "max_repeats")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return mix(sizes, store(mix_plan(sizes, _targets(spark, sf_dir)), "plan"), "doc_id")


def _shares(sizes: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    plan = store(mix_plan(sizes, targets, total), "plan")
    return mix_report(mix(sizes, plan, "doc_id"), plan, "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix as large as the documents of all targeted sources; caps that bind cost small sources a part of theirs."""
    return _shares(_sizes(spark, sf_dir), _targets(spark, sf_dir), None)


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mix that meets all targets, which is smaller."""
    sizes, targets = _sizes(spark, sf_dir), _targets(spark, sf_dir)
    return _shares(sizes, targets, exact_total(sizes, targets))


def p9_capped_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix three times as large as the documents, for which several sources are too small even repeated."""
    sizes = _sizes(spark, sf_dir)
    return _shares(sizes, _targets(spark, sf_dir), 3.0 * (sizes.agg(F.sum("n_tokens")).first()[0] or 0))


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan behind :func:`p9_mix` with characters as sizes, which any engine can count."""
    docs = read(spark, sf_dir, "documents").select("doc_id", lowered("source").alias("source"), F.char_length("text").cast("bigint").alias("n_tokens"))
    plan = mix_plan(store(docs, "sizes").df, _targets(spark, sf_dir))
    return plan.select("source", "docs", "tokens", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("target_share", "copies")], "max_repeats")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", visual_form_column(F.col("text")).alias("form"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_features, p3_found, p3_levels, p3_profile, p5_found, p5_pieces, p5_roundtrip, p8_found, p8_leaks, p9_mix, p9_shares, p9_exact_shares, p9_capped_shares, p9_plan, p10_found, p10_classes, p10_forms)}
