"""Text functions. White space is what Unicode calls so, written out as a class that every regex engine reads alike."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .exprs import bound

_SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{_SPACE}]"


def spaced(pattern: str, space: str = _SPACE) -> str:
    r"""``pattern`` with each ``\s`` written out, inside and outside of classes."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(space if depth else f"[{space}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        depth += (two[0] == "[") - (two[0] == "]")
        out.append(two[0])
        i += 1
    return "".join(out)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def unescape(c: Column) -> Column:
    """HTML entities; only texts with an ampersand go to Python."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else html.unescape(t)), "string")
    return F.coalesce(udf(F.when(F.contains(c, F.lit("&")), c)), c)


def _without(t: Column, pattern: str) -> Column:
    """``t`` with matches made blank. The date line's pattern tries every run of words again and again; its end, which
    begins with a dash, is cheap to look for and must be there."""
    gone = lambda x: F.regexp_replace(x, "(?i)" + spaced(pattern), " ")
    if pattern != P.DATE_LINE:
        return gone(t)
    end = "(?i)" + spaced(pattern[pattern.index("(—") :])
    return F.transform(F.array(t), lambda x: F.when(F.rlike(x, F.lit(end)), gone(x)).otherwise(x))[0]


def clean_transcript(c: Column) -> Column:
    """Entities, tags, quotes and dashes, the boilerplate list in order, then white space and stray punctuation."""
    t = unescape(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.replace(F.translate(t, "‘’“”–", "''\"\"-"), F.lit("—"), F.lit("--"))
    t = reduce(_without, P.BOILERPLATE, t)
    t = strip(F.regexp_replace(t, f"{SPACE}+", " "))
    t = F.regexp_replace(t, r" *\. *\. *\. *", ". ")
    t = F.regexp_replace(t, r" *, *, *", ", ")
    return F.regexp_replace(t, " {2,}", " ")


def is_boilerplate(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(p)) for p in P.BOILERPLATE_PHRASES])


def split_sections(c: Column, least: int = 250) -> Column:
    """struct<prepared, qa, full>: at the first mark, if what follows has ``least`` characters; else all is ``full``."""
    mark = F.regexp_extract(c, "(?i)(" + spaced(P.SECTION_MARK) + ")", 1)
    at = F.instr(c, mark)
    qa = strip(F.substring(c, at + F.length(mark), F.length(c)))
    found = (F.length(mark) > 0) & (F.length(qa) >= least)
    return F.struct(F.when(found, strip(F.substring(c, F.lit(1), at - 1))).alias("prepared"), F.when(found, qa).alias("qa"), F.when(~found | c.isNull(), F.coalesce(c, F.lit(""))).alias("full"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, "[.!?]+"), lambda s: F.length(strip(s)) > 0)


def linguistic(c: Column) -> Column:
    w, s = words(c), F.size(sentences(c))
    n = F.size(w)
    unique = F.size(F.array_distinct(F.transform(w, F.lower)))
    return F.struct(s.alias("n_sentences"), n.alias("n_words"), F.bround(F.coalesce(F.try_divide(unique, n), F.lit(0.0)), 4).alias("unique_word_ratio"), F.bround(F.coalesce(F.try_divide(n, s), F.lit(0.0)), 1).alias("avg_sentence_length"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), 1)


def lexicon_counts(c: Column, positive: list[str] = P.POSITIVE, negative: list[str] = P.NEGATIVE) -> Column:
    """Counts and ratios over positive + negative + 1. The finer categories are part of the row and always 0.

    Long lists are looked up by hash.
    """
    n = lambda ts, lex: F.size(F.filter(ts, lambda t: t.isin(lex)))

    def row(x: Column) -> Column:
        p, q = x["p"], x["q"]
        ratio = lambda v: v / (p + q + 1)
        return F.struct(p.alias("lm_positive"), q.alias("lm_negative"), *[F.lit(0).alias(f"lm_{k}") for k in ("uncertainty", "litigious", "constraining", "strong_modal", "weak_modal")], ratio(p - q).alias("lm_net"), ratio(p).alias("lm_pos_ratio"), ratio(q).alias("lm_neg_ratio"))

    return bound(bound(tokens(c), lambda ts: F.struct(n(ts, positive).alias("p"), n(ts, negative).alias("q"))), row)


def readability(c: Column, familiar: list[str] | None = None) -> Column:
    """Six published scores from counts of words, sentences, syllables (vowel groups), letters and words that are not
    ``familiar`` (without a list: of three syllables or more); 0 without words."""
    syllables = lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")))
    total = lambda arr, of: F.aggregate(arr, F.lit(0), lambda a, x: a + of(x)).cast("double")

    def counts(t: Column) -> Column:
        strange = F.size(F.filter(t, lambda w: ~w.isin(familiar))) if familiar is not None else F.lit(None).cast("int")
        return F.struct(F.size(t).cast("double").alias("n"), total(t, F.length).alias("letters"), F.transform(t, syllables).alias("syl"), strange.alias("strange"))

    def sums(x: Column) -> Column:
        s = F.greatest(F.lit(1), F.size(sentences(c))).cast("double")
        hard = F.size(F.filter(x["syl"], lambda y: y >= 3))
        return F.struct(x["n"].alias("n"), s.alias("s"), total(x["syl"], lambda y: y).alias("y"), hard.cast("double").alias("hard"), x["letters"].alias("letters"), F.coalesce(x["strange"], hard).cast("double").alias("strange"))

    def scores(x: Column) -> Column:
        n, s, y, hard, letters, strange = (x[k] for k in ("n", "s", "y", "hard", "letters", "strange"))
        ok = lambda e: F.when(n > 0, e).otherwise(0.0)
        share = 100 * strange / n
        return F.struct(
            ok(206.835 - 1.015 * n / s - 84.6 * y / n).alias("flesch_reading_ease"),
            ok(0.39 * n / s + 11.8 * y / n - 15.59).alias("flesch_kincaid_grade"),
            ok(0.4 * (n / s + 100 * hard / n)).alias("gunning_fog"),
            ok(1.043 * F.sqrt(30 * hard / s) + 3.1291).alias("smog_index"),
            ok(4.71 * letters / n + 0.5 * n / s - 21.43).alias("automated_readability"),
            ok(0.1579 * share + 0.0496 * n / s + F.when(share > 5, 3.6365).otherwise(0.0)).alias("dale_chall_score"),
        )

    return bound(bound(bound(tokens(c), counts), sums), scores)


def hedges(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?i)" + spaced(P.HEDGES)))


def truncate_words(c: Column, limit: int = 5000, mark: str = " [TRUNCATED]") -> Column:
    w = words(c)
    return F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit(mark))).otherwise(c)


def clean_and_split(c: Column) -> Column:
    """The sections of a text, each cleaned; cleaning comes last, as it takes the marks between them away."""
    x = split_sections(c)
    return F.struct(*[F.when(x[k].isNotNull(), clean_transcript(x[k])).alias(k) for k in ("prepared", "qa", "full")])


def sentence_groups(c: Column, k: int = 5) -> Column:
    s = F.transform(sentences(c), strip)
    at = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(k))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(s, i + 1, k), ". "))


def pack_sentences(c: Column, most: int = 256) -> Column:
    """Chunks of whole sentences, filled in order up to ``most`` words each; a longer sentence is a chunk of its own.

    A fold finds the sentences that begin a chunk; it grows by one entry per chunk, not per sentence.
    """
    s = F.filter(F.split(strip(c), rf"(?<=[.!?]){SPACE}+"), lambda x: x != "")

    def starts(parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            n, i = F.size(words(x)), acc["i"]
            new = (acc["n"] == 0) | (acc["n"] + n > most)
            return F.struct(F.when(new, F.concat(acc["at"], F.array(i))).otherwise(acc["at"]).alias("at"), F.when(new, n).otherwise(acc["n"] + n).alias("n"), (i + 1).alias("i"))

        zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"))
        at = F.aggregate(parts, zero, step, lambda a: a["at"])
        join = lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(parts, a + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - a), " "))
        return bound(at, join)

    return bound(s, starts)
