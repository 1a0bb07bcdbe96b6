"""Reading level of documents from the surprisal of an n-gram model.

An interpolated character n-gram model is trained on the easier half of graded passages, so that text is the more
surprising the further it is from easy text. A document's surprisal is taken over all its characters; the mean per word
and the mean and deviation over its sentences, weighed, are mapped to grades by isotonic regression.

Defined results: NULL, empty and wordless texts have no level. Speaker names at line starts are not part of the text;
a line end ends a sentence. Levels lie between the lowest and the highest grade of the samples;
without samples there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many graded passages are fitted, those with the smallest hashes.
MAX_SAMPLES = 20_000
ORDER = 4
FOLDS = 10
#: Weights tried for the index: of the deviation, and of bits per sentence against bits per word.
SHARES_SD = (0.0, 0.1, 0.2, 0.3)
SHARES_SENTENCE = tuple(k / 20 for k in range(21))
LEVEL = "struct<level:double,bits_per_word:double,bits_per_sentence:double,sentence_sd:double,words:double,sentences:double>"
#: Characters scored at a time.
BLOCK = 1 << 20

SPEAKER = re.compile(
    r"^[^\S\n]*[A-Z][\w.'’-]*(?:[^\S\n]+[A-Z][\w.'’-]*){0,4}"  # a name
    r"(?:[^\S\n]*(?:--|—|–)[^:\n]{1,60}|[^\S\n]*\([^)\n]{1,60}\)|,[^:\n]{1,60})?"  # a role
    r"[^\S\n]*:",
    re.MULTILINE,
)
CUT = "\x1e"
# Symbols: 0 blank, 1-26 letters, 27 digit, 28 other letter, 29 mark within a word, 30 line end, 31 other mark.
LETTERS, BITS = 32, 5


def _alphabet() -> np.ndarray:
    table = np.full(256, 31, np.uint8)
    table[[9, 11, 12, 13, 32]] = 0
    table[10] = 30
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    table[48:58] = 27
    table[128:] = 28
    table[[39, 45]] = 29
    return table


ALPHABET = _alphabet()
_IS_WORD = np.zeros(LETTERS, bool)
_IS_WORD[1:29] = True


def spoken(text: str) -> str:
    """Without speaker names."""
    return SPEAKER.sub("", text)


def symbols(raw: np.ndarray) -> np.ndarray:
    return ALPHABET[raw]


@dataclass
class NGrams:
    """Bits of each symbol after up to ORDER - 1 others, interpolated over all shorter contexts."""

    bits: np.ndarray

    @staticmethod
    def contexts(s: np.ndarray, order: int) -> np.ndarray:
        """Code of each symbol with the ``order - 1`` before it; blanks stand before the first."""
        code = s.astype(np.int32)
        out = code.copy()
        for k in range(1, order):
            out[k:] += code[:-k] << (BITS * k)
        return out

    @classmethod
    def train(cls, texts: list[str], order: int = ORDER) -> NGrams:
        s = symbols(np.frombuffer(" ".join(spoken(t) for t in texts).encode(), np.uint8))
        p = np.full(LETTERS, 1 / LETTERS)
        for n in range(1, order + 1):
            c = np.bincount(cls.contexts(s, n), minlength=LETTERS**n).astype(np.float64).reshape(-1, LETTERS)
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            lower = np.tile(p.reshape(-1, LETTERS), (len(c) // (p.size // LETTERS), 1)) if n > 1 else p.reshape(1, -1)
            # The share given to the shorter context grows with the kinds of symbols that followed (Witten-Bell).
            p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower).reshape(-1)
        return cls((-np.log2(np.maximum(p, 1e-12))).astype(np.float32))


def _read(raw: np.ndarray, model: NGrams, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per symbol: its bits, whether a word starts at it, whether a sentence ends with it."""
    s = symbols(raw)
    bits = model.bits[NGrams.contexts(s, order)]
    word = _IS_WORD[s]
    before = np.concatenate(([False], word[:-1]))
    starts = word & ~before & ~((np.concatenate(([0], s[:-1])) == 29) & np.concatenate(([False, False], word[:-2])))
    # A sentence ends at a line end, and at . ! ? before white space and something other than a small letter.
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    after = np.concatenate((s[1:], [30]))
    then = np.concatenate((raw[2:], [10, 10]))[: len(raw)]
    end = (s == 30) | (stop & ((after == 0) | (after == 30)) & ~((then >= 97) & (then <= 122)))
    return bits, starts, end


def measure(raw: np.ndarray, model: NGrams, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: bits, words, sentences, sum of squared bits per sentence. ``doc``: the document of each byte."""
    bits, starts, end = _read(raw, model)
    sentence = np.cumsum(end) - end + doc  # a new document is a new sentence too
    w = np.bincount(sentence, weights=starts)
    b = np.bincount(sentence, weights=bits)
    of = np.zeros(len(w), np.int64)
    of[sentence] = doc
    real = w > 0
    out = np.empty((n_docs, 4))
    out[:, 0] = np.bincount(of[real], weights=b[real], minlength=n_docs)
    out[:, 1] = np.bincount(of[real], weights=w[real], minlength=n_docs)
    out[:, 2] = np.bincount(of[real], minlength=n_docs)
    out[:, 3] = np.bincount(of[real], weights=b[real] ** 2, minlength=n_docs)
    return out


def measure_long(raw: np.ndarray, model: NGrams, block: int) -> np.ndarray:
    """The same of one document of any length, ``block`` bytes at a time. Each block is read with the bytes before and
    after it that its symbols depend on, and its last sentence goes on in the next, so the cuts change nothing."""
    out = np.zeros(4)
    open_w = open_b = 0.0

    def add(w: np.ndarray, b: np.ndarray) -> None:
        real = w > 0
        out[:] += b[real].sum(), w[real].sum(), real.sum(), (b[real] ** 2).sum()

    for a in range(0, len(raw), block):
        z = min(len(raw), a + block)
        lead = min(a, ORDER - 1)
        bits, starts, end = (x[lead : lead + z - a] for x in _read(raw[a - lead : z + 2], model))
        sentence = np.cumsum(end) - end
        w, b = np.bincount(sentence, weights=starts), np.bincount(sentence, weights=bits)
        w[0] += open_w
        b[0] += open_b
        open_w, open_b, n = (0.0, 0.0, len(w)) if end[-1] else (w[-1], b[-1], len(w) - 1)
        add(w[:n], b[:n])
    add(np.array([open_w]), np.array([open_b]))
    return out


LEAD = "\n" + CUT + "\n"  # stands before every text and a line end behind it, so that its ends have one context


def measures(texts: list[str | None], model: NGrams, block: int = BLOCK) -> np.ndarray:
    """As :func:`measure`, of about ``block`` characters at a time; what comes out does not depend on the blocks."""
    out = np.zeros((len(texts), 4))
    held: list[str] = []
    at: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, at, size
        if held:
            raw = np.frombuffer(SPEAKER.sub("", LEAD + LEAD.join(held) + "\n").encode(), np.uint8)
            out[at] = measure(raw, model, np.maximum(np.cumsum(raw == 0x1E) - 1, 0), len(held))
            held, at, size = [], [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        t = t.replace(CUT, " ")
        if len(t) > block:
            out[i] = measure_long(np.frombuffer(SPEAKER.sub("", LEAD + t + "\n").encode(), np.uint8), model, block)
            continue
        held.append(t)
        at.append(i)
        size += len(t)
        if size >= block:
            flush()
    flush()
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least squares fit by pooling adjacent violators: knots and their levels."""
    order = np.argsort(x, kind="stable")
    level: list[list[float]] = []  # sum, count, first x, last x
    for xi, yi in zip(x[order], y[order]):
        level.append([yi, 1, xi, xi])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            s, n, _, last = level.pop()
            level[-1] = [level[-1][0] + s, level[-1][1] + n, level[-1][2], last]
    xs = np.array([v for b in level for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    ys = np.array([b[0] / b[1] for b in level for _ in range(2 if b[3] > b[2] else 1)])
    return xs, ys


@dataclass
class LevelModel:
    """The index is a weighted mean of the parts of :meth:`distribution`, each over its spread in the samples; its isotonic
    map gives grades. The weights are those, in steps, whose map leaves the least error."""

    ngrams: NGrams
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], grades: list[int]) -> LevelModel:
        if not texts:
            raise ValueError("no graded passages")
        g = np.asarray(grades, float)
        is_easy = g <= np.median(g)
        ngrams = NGrams.train([t for t, e in zip(texts, is_easy) if e])
        # A passage is measured by a model that has not seen it, as any new text will be.
        fold, m = np.arange(len(texts)) % FOLDS, np.zeros((len(texts), 4))
        for k in range(FOLDS):
            others = [t for t, e, f in zip(texts, is_easy, fold) if e and f != k] or texts
            at = np.flatnonzero(fold == k)
            m[at] = measures([texts[i] for i in at], NGrams.train(others))
        keep = m[:, 1] > 0
        m, g = m[keep], g[keep]
        x = np.column_stack(cls.distribution(m))
        spread = np.maximum(x.std(axis=0), 1e-9)
        best, least = None, np.inf
        for sd in SHARES_SD:
            for per_sentence in SHARES_SENTENCE:
                w = np.array([(1 - sd) * (1 - per_sentence), (1 - sd) * per_sentence, sd]) / spread
                xs, ys = isotonic(x @ w, g)
                err = ((np.interp(x @ w, xs, ys) - g) ** 2).sum()
                if err < least - 1e-9:
                    best, least = cls(ngrams, w, xs, ys), err
        return best

    @staticmethod
    def distribution(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the surprisal of a document: mean per word, mean per sentence, deviation over sentences."""
        with np.errstate(divide="ignore", invalid="ignore"):
            per_sentence = m[:, 0] / m[:, 2]
            return m[:, 0] / m[:, 1], per_sentence, np.sqrt(np.maximum(m[:, 3] / m[:, 2] - per_sentence**2, 0))

    def index(self, m: np.ndarray) -> np.ndarray:
        return sum(w * d for w, d in zip(self.weights, self.distribution(m)))

    def grade(self, index: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(index), np.nan, np.interp(index, self.xs, self.ys))


def fit_levels(samples: DataFrame, text: str, grade: str, max_samples: int = MAX_SAMPLES) -> LevelModel | None:
    """Fit on the driver from at most ``max_samples`` graded passages; None without any."""
    rows = samples.select(F.col(text).alias("t"), F.col(grade).alias("g")).dropna()
    rows = rows.orderBy(F.xxhash64("t"), "t", "g").limit(max_samples).collect()
    return LevelModel.fit([r.t for r in rows], [r.g for r in rows]) if rows else None


def level_column(model: LevelModel | None, df: DataFrame, text: Column) -> Column:
    """struct<level, bits_per_word, bits_per_sentence, sentence_sd, words, sentences> of ``text``; NULLs without words or model."""
    if model is None:
        return F.lit(None).cast(LEVEL)
    shared = df.sparkSession.sparkContext.broadcast(model)  # the n-gram table has 32 ** ORDER floats, whatever the data

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            x = measures(texts.tolist(), m.ngrams)
            none = x[:, 1] == 0
            level, (bw, bs, sd) = m.grade(m.index(x)), m.distribution(x)
            out = pd.DataFrame({"level": level, "bits_per_word": bw, "bits_per_sentence": bs, "sentence_sd": sd, "words": x[:, 1], "sentences": x[:, 2]}, index=texts.index)
            yield out.mask(none[:, None] & np.ones(6, bool))

    return F.pandas_udf(score, LEVEL)(text)
