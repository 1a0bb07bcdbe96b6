"""One form for texts that look the same.

The form is the compatibility normalisation for what is drawn alike (width forms, joined letters, kinds of blanks),
canonical composition of accents, removal of characters that are not drawn, one blank, one hyphen, and Latin letters
for letters of other alphabets that are drawn alike. Compatibility mappings that change what is seen (superscripts,
fractions, circled letters) are left alone, and so are case, digits, accents and punctuation; folding the case is an
option for callers that compare words.

Defined results: NULL stays NULL. A text of drawn ASCII characters is its own form. Control characters, tabs and line
feeds stay.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Stored, store

# Letters of other alphabets drawn as a Latin letter, each line the letters and what they are drawn as:
# Greek, Cyrillic, Armenian, Cherokee.
DRAWN_ALIKE = [
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ϹͿο", "CJo"),
    ("ϲϳ", "cj"),
    ("νρ", "vp"),
    ("АВЕЅІЈКМНОРСТХ", "ABESIJKMHOPCTX"),
    ("аеорсухѕіј", "aeopcyxsij"),
    ("ԁԛԝԚԜһҺӀӏ", "dqwQWhhIl"),
    ("ѵѴүҮԌ", "vVyYG"),
    ("օսհցզ", "ouhgq"),
    ("ՕՍԼ", "OUL"),
    ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHGZVSLCPKB"),
]
#: Not drawn: the Unicode property Default_Ignorable_Code_Point, as ranges.
NOT_DRAWN = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Hyphens, beside the ASCII one and its width forms: hyphen and non-breaking hyphen.
HYPHENS = "‐‑"


#: Where characters with a compatibility mapping or of the blank kind lie; elsewhere are ideographs, syllables and the
#: like, which have none. Found by going through all of Unicode (see the tests).
MAPPED = [(0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10700, 0x10800), (0x1D000, 0x1F300)]
#: Blocks of ordinary letters and signs, none of which joins with its neighbours.
PLAIN_BLOCKS = [(0xA0, 0x250), (0x370, 0x530), (0x2010, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x27C0)]


def _table() -> dict[int, str | None]:
    """Every character's replacement after canonical decomposition, from the Unicode data of this Python."""
    out: dict[int, str | None] = {}
    for cp in (cp for a, b in MAPPED for cp in range(a, b) if not 0xD800 <= cp <= 0xDFFF):
        c = chr(cp)
        kind, _, _ = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            out[cp] = " "
        elif kind in ("<wide>", "<narrow>"):
            out[cp] = unicodedata.normalize("NFKD", c)
        elif kind == "<compat>" and unicodedata.category(c)[0] == "L":
            whole = unicodedata.normalize("NFKD", c)
            if len(whole) > 1 and all(unicodedata.category(x)[0] in "LM" for x in whole):
                out[cp] = whole
    for letters, as_ in DRAWN_ALIKE:
        out |= {ord(a): b for a, b in zip(letters, as_, strict=True)}
    out |= {ord(c): "-" for c in HYPHENS}
    for a, b in NOT_DRAWN:
        out |= dict.fromkeys(range(a, b + 1))
    return out


_TABLE = _table()


def _form(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


def _own_forms() -> str:
    """A regex class of the characters that any text keeps: ASCII and those of PLAIN_BLOCKS that are their own form and
    no combining marks."""
    keep = [cp for a, b in PLAIN_BLOCKS for cp in range(a, b) if unicodedata.category(chr(cp))[0] not in "MC" and _form(chr(cp)) == chr(cp)]
    runs: list[list[int]] = [[0, 0x7F]]
    for cp in keep:
        if cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


OWN_FORMS = _own_forms()
_OTHER = re.compile(f"[^{OWN_FORMS}]")


def visual_form(text: str, fold_case: bool = False) -> str:
    """The form of one text; one of characters that are their own forms is its own."""
    if _OTHER.search(text):
        text = _form(text)
    return text.casefold() if fold_case else text


def visual_forms(texts: pd.Series, fold_case: bool = False) -> pd.Series:
    """Of a batch, each distinct value once."""
    codes, values = pd.factorize(texts)
    forms = [visual_form(v, fold_case) for v in values]
    return pd.Series([None if k < 0 else forms[k] for k in codes], index=texts.index, dtype=object)


def visual_form_column(text: Column, fold_case: bool = False) -> Column:
    """The form of a column. Only texts with characters that are not their own form go to Python, with ``fold_case``
    those with other than ASCII characters."""
    udf = F.pandas_udf(lambda s: visual_forms(s, fold_case), "string")
    if fold_case:
        return F.coalesce(udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))
    # Most characters are ASCII and are passed before the long class is looked through.
    return F.coalesce(udf(F.when(text.rlike(rf"(?![\x00-\x7F])[^{OWN_FORMS}]"), text)), text)


def _two_hashes(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))


def shared_forms(docs: DataFrame, doc_id: str, text: str) -> Stored:
    """(``id``, ``t``, ``f``) of the documents whose form belongs to more than one text; ``t`` and ``f`` are two 64-bit
    hashes of the text and of its form."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), _two_hashes(F.col(text)).alias("t"), visual_form_column(F.col(text)).alias("form"))
    rows = store(rows.select("id", "t", _two_hashes(F.col("form")).alias("f")), "forms").df
    many = rows.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("f")
    return store(rows.join(store(many, "shared-forms").hinted(), "f", "left_semi"), "members")


def lookalike_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id_a`` < ``doc_id_b`` of documents whose texts have one form but are not the same characters.

    Only forms with more than one text go on; their distinct texts are paired, and each pair is then filled with the
    documents that have either text, so that exact copies of one text, however many, are never compared with each
    other. :func:`lookalike_classes` says the same in one row per document.
    """
    members = shared_forms(docs, doc_id, text)
    # Hashes do not compress, so the stored size is close to that in memory; beyond the limit joins are shuffled.
    side = lambda df: F.broadcast(df) if members.small() else df.hint("merge")
    texts = members.df.select("f", "t").distinct()
    pairs = texts.select("f", F.col("t").alias("t1")).join(side(texts.select("f", F.col("t").alias("t2"))), "f").filter("t1 < t2")
    left = pairs.join(side(members.df.select("f", F.col("t").alias("t1"), F.col("id").alias("i1"))), ["f", "t1"])
    both = left.join(side(members.df.select("f", F.col("t").alias("t2"), F.col("id").alias("i2"))), ["f", "t2"])
    return both.select(F.least("i1", "i2").alias("doc_id_a"), F.greatest("i1", "i2").alias("doc_id_b"))


def lookalike_classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document of a form with more than one text: ``doc_id``, ``class_id`` (its smallest document) and
    ``n_links``, the documents that look the same with other characters. Copies are counted, never paired."""
    members = shared_forms(docs, doc_id, text)
    per_text = members.df.groupBy("f", "t").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    w = W.partitionBy("f")  # over the distinct texts of a form
    per_text = per_text.select("f", "t", F.min("least").over(w).alias("class_id"), (F.sum("n").over(w) - F.col("n")).alias("n_links"))
    per_text = store(per_text, "classes")
    return members.df.join(F.broadcast(per_text.df) if per_text.small() else per_text.df.hint("merge"), ["f", "t"]).select(F.col("id").alias(doc_id), "class_id", "n_links")
