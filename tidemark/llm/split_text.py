"""Texts above a size limit cut into pieces at natural boundaries, with overlap.

A text is cut by a hierarchy of separators: sections (two or more empty lines), paragraphs (an empty line), lines,
sentences, words, characters. A unit too large for a piece is cut by the next finer separator; the units are then
packed greedily up to the limit. Each piece after the first begins with the end of the piece before: the longest stretch
within the overlap that begins at a word, or, where one word fills the overlap, exactly the overlap.

Defined results: sizes are code points. A NULL text has no pieces, any other text within the limit one. Separators
belong to the unit before them, so the pieces without their overlaps are the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200
SEPARATORS = (r"\n[^\S\n]*(?:\n[^\S\n]*){2,}", r"\n[^\S\n]*\n[^\S\n]*", r"\n", r"(?<=[.!?…])[\"'”’)\]]*\s+", r"\s+")
_COMPILED = [re.compile(s) for s in SEPARATORS]
_WORD_START = re.compile(r"\s+")


def units(text: str, size: int, overlap: int) -> list[int]:
    """End offsets of units, each at most ``size - overlap`` long, so that it fits behind any overlap."""
    most = max(1, size - overlap)
    ends: list[int] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if level and b - a <= most:
            ends.append(b)
        elif level == len(_COMPILED):
            ends.extend(range(a + most, b, most))
            ends.append(b)
        else:
            start, parts = a, []
            for m in _COMPILED[level].finditer(text, a, b):
                if m.end() > start:
                    parts.append((start, m.end(), level + 1))
                    start = m.end()
            if start < b:
                parts.append((start, b, level + 1))
            todo.extend(reversed(parts))
    return ends


def _shared_from(text: str, start: int, end: int, overlap: int) -> int:
    """Where the next piece begins: the first word within the last ``overlap`` characters, else those characters."""
    if overlap <= 0:
        return end
    at = max(start + 1, end - overlap)
    if at > 0 and text[at - 1].isspace():
        return at
    m = _WORD_START.search(text, at, end)
    return m.end() if m and m.end() < end else at


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``text``."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = units(text, limit, overlap)
    out, start, k = [], 0, 0
    while k < len(ends):
        while k + 1 < len(ends) and ends[k + 1] <= start + limit:
            k += 1
        out.append((start, ends[k]))
        start = _shared_from(text, start, ends[k], overlap)
        k += 1
    return out


def split_spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start, end>> of the pieces of ``text`` in code points.

    Only texts above the limit go to Python; the others get their one piece from their length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in pieces(t, limit, overlap)])

    n = F.char_length(text)
    udf = F.pandas_udf(cut, "array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    return F.when(text.isNull(), None).otherwise(F.coalesce(udf(F.when(n > limit, text)), whole))
