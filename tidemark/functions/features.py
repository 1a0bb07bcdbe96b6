"""One feature row per text: polarity, counts of a financial lexicon, linguistic counts and readability."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .polarity import KEYS, polarity
from .text import lexicon_counts, linguistic, readability

SECTIONS = {"full": "full_z", "prepared_remarks": "prep_z", "qa": "qa_z"}
LM = [f"lm_{k}" for k in ("positive", "negative", "uncertainty", "litigious", "constraining", "strong_modal", "weak_modal", "net", "pos_ratio", "neg_ratio")]
COUNTS = ["n_sentences", "n_words", "unique_word_ratio", "avg_sentence_length"]
SCORES = ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "automated_readability", "dale_chall_score"]
PLAIN = [*LM, *COUNTS, *SCORES]
ALL = [*[f"vader_{k}" for k in KEYS], *PLAIN]


@dataclass
class Lexicons:
    """Word lists of the caller's: valences, positive and negative financial words, words that easy readers know."""

    valence: dict[str, float] = field(default_factory=lambda: P.VALENCE)
    positive: list[str] = field(default_factory=lambda: P.POSITIVE)
    negative: list[str] = field(default_factory=lambda: P.NEGATIVE)
    familiar: list[str] | None = None

    @classmethod
    def of_tables(cls, valence: DataFrame, sides: DataFrame, familiar: DataFrame) -> Lexicons:
        """From tables (word, valence), (word, side: positive or negative) and (word): dictionaries, which bounds them."""
        s = [(r.word, r.side) for r in sides.select("word", "side").collect()]
        side = lambda k: sorted({w for w, x in s if x == k})
        return cls({r.word: r.valence for r in valence.select("word", "valence").collect()}, side("positive"), side("negative"), sorted({r.word for r in familiar.select("word").collect()}))


def plain_row(text: Column, lex: Lexicons) -> Column:
    """struct of PLAIN, all in the JVM; NULL texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    lm, li, re_ = lexicon_counts(t, lex.positive, lex.negative), linguistic(t), readability(t, lex.familiar)
    # Three structs, each computed once, side by side.
    whole = F.array(F.struct(lm.alias("a"), li.alias("b"), re_.alias("c")))
    return F.transform(whole, lambda x: F.struct(*[x["a"][k].alias(k) for k in LM], *[x["b"][k].alias(k) for k in COUNTS], *[x["c"][k].alias(k) for k in SCORES]))[0]


def feature_rows(df: DataFrame, keys: list[str], text: str, lex: Lexicons) -> DataFrame:
    """``keys`` and the 34 features of ALL."""
    x = df.select(*keys, plain_row(F.col(text), lex).alias("_p"), polarity(F.col(text), lex.valence).alias("_v"))
    return x.select(*keys, *[F.col(f"_v.{k}").alias(f"vader_{k}") for k in KEYS], *[F.col(f"_p.{k}").alias(k) for k in PLAIN])


def section_features(calls: DataFrame, keys: list[str], lex: Lexicons, sections: dict[str, str] = SECTIONS) -> DataFrame:
    """One wide row per call, ``{section}_{feature}``; sections of calls without questions are NULL but for the full text.

    Sections stand side by side in the row they come from, so nothing is shuffled.
    """
    here = lambda s: F.when((F.col("has_qa") == 1) | F.lit(s == "full"), F.coalesce(F.col(sections[s]), F.lit("")))
    x = calls.select(*keys, *[here(s).alias(f"_t_{s}") for s in sections])
    x = x.select(*keys, *[F.when(F.col(f"_t_{s}").isNotNull(), plain_row(F.col(f"_t_{s}"), lex)).alias(f"_p_{s}") for s in sections], *[F.when(F.col(f"_t_{s}").isNotNull(), polarity(F.col(f"_t_{s}"), lex.valence)).alias(f"_v_{s}") for s in sections])
    return x.select(*keys, *[c for s in sections for c in (*[F.col(f"_v_{s}")[k].alias(f"{s}_vader_{k}") for k in KEYS], *[F.col(f"_p_{s}")[k].alias(f"{s}_{k}") for k in PLAIN])])
