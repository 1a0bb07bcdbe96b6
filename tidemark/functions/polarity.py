"""Polarity of short texts by the published rules over a valence lexicon, and its statistics over groups of sentences.

The lexicon is the caller's: word -> valence. Rules: boosters raise or lower a word up to three places on, with less
weight the farther they stand; negations within three places turn it; capitals among small words and exclamation or
question marks are emphasis; what follows "but" outweighs what comes before; the sum is normalised by s / sqrt(s * s + 15).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rules: weights, words that raise and lower, words that negate.
BOOST, CAPITALS, TURNED, ALPHA = 0.293, 0.733, -0.74, 15
RAISING = """absolutely amazingly awfully completely considerable considerably decidedly deeply enormous enormously entirely especially exceptional
exceptionally extreme extremely fabulously fully greatly highly hugely incredible incredibly intensely major majorly more most particularly purely quite
really remarkably so substantially thoroughly total totally tremendous tremendously unbelievably unusually utter utterly very""".split()
LOWERING = "almost barely hardly kinda kindof less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta sortof".split()
NEGATING = """aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither never none nope nor not nothing nowhere
oughtnt shant shouldnt wasnt werent without wont wouldnt rarely seldom despite""".split()

KEYS = ["compound", "pos", "neg", "neu", "mean", "std", "min", "max", "p10", "p90", "pct_neg", "pct_pos", "n_chunks", "n_paragraphs"]
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


class Polarity:
    def __init__(self, valence: dict[str, float], idioms: dict[str, float] | None = None):
        self.valence, self.idioms = valence, idioms or {}
        self.booster = dict.fromkeys(RAISING, BOOST) | dict.fromkeys(LOWERING, -BOOST)
        self.negating = frozenset(NEGATING)

    def negates(self, w: str) -> bool:
        return w in self.negating or "n't" in w

    def _word(self, i: int, words: list[str], low: list[str], mixed: bool) -> float:
        v = self.valence[low[i]]
        if mixed and words[i].isupper():
            v += math.copysign(CAPITALS, v)
        for back in (1, 2, 3):
            j = i - back
            if j < 0 or low[j] in self.valence:
                continue
            b = self.booster.get(low[j], 0.0)
            if b:
                b = math.copysign(1, v) * b
                if mixed and words[j].isupper():
                    b += math.copysign(CAPITALS, v)
                v += b * (1, 0.95, 0.9)[back - 1]
            between = low[j + 1 : i]
            if back > 1 and low[j] == "never" and ("so" in between or "this" in between):
                v *= 1.25
            elif back > 1 and low[j] == "without" and "doubt" in between:
                pass
            elif self.negates(low[j]):
                v *= TURNED
            if back == 3:
                for n in (2, 3, 4):
                    for a in range(max(0, i - n + 1), i + 1):
                        v = self.idioms.get(" ".join(low[a : a + n]), v)
        if i and low[i - 1] == "least" and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= TURNED
        return v

    def scores(self, text: str) -> tuple[float, float, float, float]:
        """compound, pos, neg, neu; all 0 without words."""
        words = [s if len(s) > 2 else t for t in text.split() for s in (_EDGE.sub("", t),)]
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        low = [w.lower() for w in words]
        upper = sum(w.isupper() for w in words)
        v = [self._word(i, words, low, 0 < upper < len(words)) if w in self.valence and w not in self.booster else 0.0 for i, w in enumerate(low)]
        if "but" in low:
            k = low.index("but")
            v = [x * 0.5 if i < k else x * 1.5 if i > k else x for i, x in enumerate(v)]
        marks = text.count("?")
        loud = min(text.count("!"), 4) * 0.292 + (0 if marks < 2 else marks * 0.18 if marks < 4 else 0.96)
        total = round(sum(v), 9)  # words that cancel out leave no noise whose sign would be stressed
        total += math.copysign(loud, total) if total else 0.0
        pos, neg, neu = sum(x + 1 for x in v if x > 0), sum(x - 1 for x in v if x < 0), sum(x == 0 for x in v)
        if pos > -neg:
            pos += loud
        elif pos < -neg:
            neg -= loud
        whole = pos - neg + neu
        return total / math.sqrt(total * total + ALPHA), pos / whole, -neg / whole, neu / whole

    def row(self, text: str | None, size: int = 5) -> tuple[float, ...]:
        """The values of KEYS: of the whole text its compound, the rest over groups of ``size`` sentences."""
        parts = re.split(r"[.!?]+", text) if text and text.strip() else []
        groups = [g for g in (" ".join(parts[i : i + size]) for i in range(0, len(parts), size)) if g.strip()]
        if not groups:
            return (0.0,) * len(KEYS)
        s = np.array([self.scores(g) for g in groups])
        c = s[:, 0]
        return (self.scores(text)[0], *s[:, 1:].mean(axis=0), c.mean(), c.std(), c.min(), c.max(), *np.percentile(c, [10, 90]), (c < -0.05).mean(), (c > 0.05).mean(), len(c), len(c))


def polarity(c: Column, valence: dict[str, float], idioms: dict[str, float] | None = None) -> Column:
    """struct of KEYS. The lexicon is set up once per worker and batch stream."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Polarity(valence, idioms)
        for texts in batches:
            yield pd.DataFrame([p.row(t) for t in texts], columns=KEYS, index=texts.index, dtype=float)

    return F.pandas_udf(score, ", ".join(f"{k} double" for k in KEYS))(c)
