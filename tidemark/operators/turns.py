"""Speaker turns: parsing, where the questions begin, who is who, and the statistics of both parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.exprs import bound
from ..functions.text import hedges, spaced, strip, words

TURNS = "array<struct<speaker:string,text:string>>"
SPEAKER_LINE = r"^([A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*){0,3}(?: -- [^:]{1,60}| \([^)]{1,40}\))?): ?(.*)$"


def normalize_turns(json: Column) -> Column:
    """Turns from JSON, without empty ones; an empty list for NULL or broken JSON."""
    t = F.transform(F.from_json(json, TURNS), lambda x: F.struct(strip(F.coalesce(x["speaker"], F.lit(""))).alias("speaker"), strip(F.coalesce(x["text"], F.lit(""))).alias("text")))
    return F.coalesce(F.filter(t, lambda x: x["text"] != ""), F.from_json(F.lit("[]"), TURNS))


def turns_of_lines(text: Column) -> Column:
    """Turns of a section whose lines begin with a speaker and a colon; other lines continue the turn before."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    named = lambda x: F.rlike(x, F.lit(SPEAKER_LINE))
    part = lambda x, i: F.regexp_extract(x, SPEAKER_LINE, i)
    one = lambda x: F.when(named(x), F.struct(part(x, 1).alias("speaker"), part(x, 2).alias("text"))).otherwise(F.struct(F.lit("").alias("speaker"), x.alias("text")))
    none = F.from_json(F.lit("[]"), TURNS)

    def gather(rows: Column) -> Column:
        begins = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | (x["speaker"] != ""), i)), lambda i: i.isNotNull())
        said = lambda a, z: F.array_join(F.filter(F.transform(F.slice(rows, a + 1, z - a), lambda x: x["text"]), lambda t: t != ""), " ")
        turn = lambda at: F.transform(at, lambda a, k: F.struct(F.get(rows, a)["speaker"].alias("speaker"), said(a, F.coalesce(F.get(at, k + 1), F.size(rows))).alias("text")))
        return bound(begins, turn)

    return F.coalesce(bound(F.transform(lines, one), gather), none)


def name_key(speaker: Column) -> Column:
    """First and last name of a label without its title."""
    base = F.element_at(F.split(F.lower(F.coalesce(speaker, F.lit(""))), r"--|—|\(|,"), 1)
    t = F.regexp_extract_all(base, F.lit("([a-z]+)"), 1)
    return F.when(F.size(t) == 0, "").when(F.size(t) == 1, F.try_element_at(t, F.lit(1))).otherwise(F.concat_ws(" ", F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(-1))))


def is_moderator(speaker: Column) -> Column:
    return F.coalesce(F.rlike(speaker, F.lit("(?i)" + P.MODERATOR)), F.lit(False))


def qa_boundary(turns: Column) -> Column:
    """0-based turn where the questions begin: after a moderator's announcement, else at the match; their number if none."""
    hit = lambda t, i: F.when(F.rlike(t["text"], F.lit("(?i)" + spaced(P.QUESTIONS_BEGIN))), F.struct(i.alias("i"), (i + is_moderator(t["speaker"]).cast("int")).alias("b")))
    return F.coalesce(F.array_min(F.transform(turns, hit))["b"], F.size(turns))


def split_turns(calls: DataFrame, keys: list[str], turns: str = "turns", least: int = 250) -> DataFrame:
    """Per call: sections as text and the statistics of speakers, questions and answers.

    Executives are those heard before the questions, or whose turns afterwards are mostly statements. Calls without
    turns keep a row with empty texts and zeros.
    """
    base = calls.select(*keys, F.col(turns).alias("_t"), qa_boundary(F.col(turns)).alias("_b"))
    rows = base.select(*keys, "_b", F.posexplode("_t").alias("i", "t")).select(*keys, "i", (F.col("i") >= F.col("_b")).alias("qa"), "t.speaker", "t.text")
    rows = rows.withColumn("key", name_key(F.col("speaker"))).withColumn("counts", (F.col("speaker") != "") & ~is_moderator(F.col("speaker")))
    w = W.partitionBy(*keys, "key")
    in_prep = F.max((F.col("counts") & ~F.col("qa")).cast("int")).over(w) == 1
    asks = F.avg(F.when(F.col("counts") & F.col("qa"), F.contains("text", F.lit("?")).cast("double"))).over(w)
    rows = rows.withColumn("exec", (in_prep & (F.col("key") != "")) | F.coalesce(asks < 0.5, F.lit(False)))
    n = F.size(words(F.col("text")))
    answer, question = F.col("qa") & F.col("counts") & F.col("exec"), F.col("qa") & F.col("counts") & ~F.col("exec")
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("int")
    text = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("i", "text")))), lambda x: x["text"]), " ")
    out = rows.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_turns"), text(~F.col("qa")).alias("prepared_text"), text(F.col("qa")).alias("_qa"),
        F.countDistinct(F.when(~F.col("qa") & F.col("counts") & (F.col("key") != ""), F.col("key"))).cast("int").alias("n_exec_speakers"),
        F.countDistinct(F.when(question, F.col("key"))).cast("int").alias("n_analyst_speakers"),
        total(question & F.contains("text", F.lit("?")), F.lit(1)).alias("n_analyst_questions"),
        total(question, n).alias("analyst_q_words"), total(answer, n).alias("exec_a_words"), total(answer, hedges(F.col("text"))).alias("_hedges"),
    )
    out = base.select(*keys).join(out, keys, "left").fillna(0).fillna("")
    has = F.length("_qa") >= least
    ratio = lambda a, b, k: F.coalesce(F.try_divide(F.col(a) * F.lit(k), F.col(b)), F.lit(0.0))
    return out.select(*keys, "prepared_text", F.when(has, F.col("_qa")).otherwise("").alias("qa_text"), strip(F.concat_ws(" ", "prepared_text", "_qa")).alias("full_text"), has.cast("int").alias("has_qa"), "n_turns", "n_exec_speakers", "n_analyst_speakers", "n_analyst_questions", "analyst_q_words", "exec_a_words", ratio("exec_a_words", "analyst_q_words", 1.0).alias("answer_question_ratio"), ratio("_hedges", "exec_a_words", 1000.0).alias("hedge_per_1k"))


def flat_sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The row of a call that came without speakers: all of its text, no questions and no statistics."""
    none = [F.lit(0).alias(c) for c in ("has_qa", "n_turns", "n_exec_speakers", "n_analyst_speakers", "n_analyst_questions", "analyst_q_words", "exec_a_words")]
    return df.select(*keys, F.lit("").alias("prepared_text"), F.lit("").alias("qa_text"), strip(F.coalesce(text, F.lit(""))).alias("full_text"), *none, F.lit(0.0).alias("answer_question_ratio"), F.lit(0.0).alias("hedge_per_1k"))


def call_sections(df: DataFrame, keys: list[str], turns: str, text: str) -> DataFrame:
    """Calls split by their turns, or flat where they have none; calls without any text are left out."""
    split = split_turns(df.filter(F.size(turns) > 0), keys, turns)
    return split.unionByName(flat_sections(df.filter(F.coalesce(F.size(turns), F.lit(0)) <= 0), keys, text)).filter("full_text <> ''")
