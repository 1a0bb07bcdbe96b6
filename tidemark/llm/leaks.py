"""Evaluation texts leaking into training text.

Texts are brought to their visual form and cut into words. Numbers, names and units become typed placeholders; what is
left is a template, and windows of WIDTH words of it are hashed and joined between items and documents. A window pair
is exact when the words themselves are equal, else re-parameterised when the values in its slots map one to one.

Windows are taken over three readings of a text. WORDS has one placeholder a word; a word's place in it depends on
nothing but the word as the items use it, so equal passages always have equal templates and no exact leak is lost by the
placeholders. LOOSE and CASED have one placeholder for a whole number, for a run of names and for a run of units, so that
the values may differ in their number of words; capital words that the items also write small are plain in LOOSE and names
in CASED. A unit is a word of UNITS, one that the items use after numbers, or any small word right after a number.

Defined results: NULL and empty texts leak nothing. Case does not count. Exact copies of a document or item each get
their own rows. Items of fewer than WIDTH words cannot be found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, Stored, store
from .visual_form import visual_form

WIDTH = 12
#: Item windows looked for in one pass over the documents; more of them make more passes, each with a part of the hashes.
WINDOWS_A_PASS = 4_000_000
#: Characters cut into words at a time.
BLOCK = 1 << 20
CUT = "\x1e"
WORD = re.compile(r"[^\W_]+")
#: Words of a template that must be plain for a re-parameterised match.
MIN_PLAIN = 6

#: A number with its sign, separators and decimals, a word, a percent sign, or a mark that ends a run of names.
PLACED = re.compile(rf"[^\W\d_][^\W_]*|(?:(?<![\w.,])[-+−])?(?:(?<![\w.])\.)?\d+(?:[.,'’]\d+)*|[^\W_]+|[%{CUT}.,;:!?()\n]")
MARKS = frozenset(".,;:!?()\n")
UNITS = frozenset(
    """percent pct bp bps kg kgs kilogram kilograms gram grams mg tonne tonnes ton tons lb lbs pound pounds oz ounce ounces
    km kilometre kilometres kilometer kilometers metre metres meter meters cm mm centimetre centimetres centimeter centimeters mile miles
    yards feet ft inch inches acre acres hectare hectares litre litres liter liters ml gallon gallons barrel barrels pint pints
    seconds sec minutes min hour hours hr hrs day days week weeks month months quarter quarters year years decade decades
    dollar dollars cent cents euro euros yen franc francs hundred thousand million millions billion billions trillion dozen
    watt watts kw kwh mw mwh gw gwh volt volts amp amps joule joules degree degrees celsius fahrenheit hz khz mhz ghz
    bytes kb mb gb tb crate crates boxes""".split()
)
#: Words right after a number that are not its unit.
NOT_UNITS = frozenset("a an and are as at be but by for from had has have he her his if in into is it its more nor not of on once or our out over she so than that the their them then they this to under until up was we were when where which while who will with you".split())

NONE, NUMBER, NAME, UNIT, FIRST = 0, 1, 2, 3, 4
SEAM, MARK = -1, -2
WORDS, LOOSE, CASED = 0, 1, 2
_MIX = 0x9E3779B97F4A7C15


@dataclass
class Lexicon:
    """How the items use each lower-case word: as a name, a unit or a plain word. One for all items, whatever their number."""

    kinds: dict[str, int]
    small: frozenset[str] = frozenset()

    @staticmethod
    def uses(texts: list[str]) -> dict[str, list[int]]:
        """Per lower-case word: how often capital within a sentence, how often small, how often small after a number."""
        out: dict[str, list[int]] = {}
        for t in texts:
            last, end = "", 0
            for m in WORD.finditer(t):
                w = m.group()
                opening = end == 0 or any(c in ".!?\n" for c in t[end : m.start()])
                n = out.setdefault(w.lower(), [0, 0, 0])
                if w[0].isupper():
                    n[0] += not opening
                else:
                    n[1] += 1
                    n[2] += last.isdigit() and w != "more" or last == "more"
                last, end = w, m.end()
        return out

    @classmethod
    def of_uses(cls, uses: dict[str, list[int]]) -> Lexicon:
        kinds: dict[str, int] = {}
        for k in sorted(uses):
            cased, small, after = uses[k]
            if any(c.isdigit() for c in k):
                continue
            if cased and not small:
                kinds[k] = NAME
            elif after and (k.endswith("s") or k == "percent"):
                kinds[k] = UNIT
            else:
                kinds[k] = FIRST + len(kinds)
        return cls(kinds, frozenset(k for k in uses if uses[k][1]))

    @classmethod
    def of(cls, texts: list[str]) -> Lexicon:
        return cls.of_uses(cls.uses(texts))


_WORD, _DIGIT, _CAPITAL, _KNOWN = 1, 2, 4, 8
_ODD = 0xD6E8FEB86659FD93  # odd, so its powers can be undone


class _Characters:
    """What each character is and its small form, filled in as characters come up."""

    def __init__(self):
        self.kind = np.zeros(0x110000, np.uint8)
        self.value = np.zeros(0x110000, np.uint64)
        self.power = self.undo = np.ones(1, np.uint64)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points of ``text`` and their kinds."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.kind[c].all():
            for cp in np.unique(c[self.kind[c] == 0]).tolist():
                ch = chr(cp)
                low = ch.lower()[0]
                x = ord("σ" if low == "ς" else low) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF
                x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
                self.value[cp] = x ^ x >> 27
                self.kind[cp] = _KNOWN | _WORD * (ch.isalnum() or ch == CUT) | _DIGIT * ch.isdigit() | _CAPITAL * ch.isupper()
        return c, self.kind[c]

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power, self.undo = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * n, f, np.uint64), dtype=np.uint64))) for f in (_ODD, pow(_ODD, -1, 1 << 64)))
        return self.power[:n], self.undo[:n]

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes of the small form and kinds (of the first character, with any digit) of the words."""
        c, kind = self.read(text)
        w = (kind & _WORD) > 0
        edge = np.diff(np.concatenate(([0], w.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, undo = self.powers(len(c))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[c] * power, dtype=np.uint64)))
        h = (total[end] - total[start]) * undo[start] if len(start) else np.empty(0, np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        digits = np.concatenate(([0], np.cumsum((kind & _DIGIT) > 0)))
        return start, end, h ^ (h >> np.uint64(29)), kind[start] & _CAPITAL | _DIGIT * (digits[end] > digits[start])


_CHARACTERS: list[_Characters] = []


class Coder:
    """Template ids of the words of a text, without a Python object for each word."""

    def __init__(self, lexicon: Lexicon):
        if not _CHARACTERS:
            _CHARACTERS.append(_Characters())
        self.characters = _CHARACTERS[0]
        known = sorted(lexicon.kinds)
        _, _, h, _ = self.characters.words(" ".join(known))
        at = np.argsort(h, kind="stable")
        self.hashes, self.ids = h[at], np.array([lexicon.kinds[k] for k in known], np.int64)[at]

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the words, seams among them."""
        start, end, h, kind = self.characters.words(text)
        code = np.where(kind & _DIGIT, NUMBER, np.where(kind & _CAPITAL, NAME, NONE)).astype(np.int64)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[k] == h
            code[hit] = self.ids[k[hit]]
        if CUT in text:
            first = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[start]
            code[first == ord(CUT)] = SEAM
        return code, start, end


def window_hashes(ids: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the windows without a NONE or SEAM."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.concatenate(([0], np.cumsum(ids <= NONE)))
    at = np.flatnonzero(bad[width:] == bad[:-width])
    x = ids.astype(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = (h ^ x[at + k]) * np.uint64(_MIX)
        h ^= h >> np.uint64(29)
    return at, h.view(np.int64)


def _stretches(texts: list[str], block: int = BLOCK, width: int = WIDTH) -> Iterator[tuple[list[int], str]]:
    """Documents joined by seams, about ``block`` characters at a time. A long document comes in parts, each after the
    first led by the ``width - 1`` words before it, so that no window is lost or seen twice."""
    held: list[str] = []
    at: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        a, lead = 0, ""
        while a < len(t):
            b = len(t)
            if b - a > block:
                b = a + block
                while b < len(t) and t[b].isalnum():
                    b += 1
            held.append(lead + t[a:b])
            at.append(i)
            size += b - a
            if b < len(t):
                lead = " ".join(WORD.findall(lead + t[a:b])[-(width - 1) :]) + " "
            a = b
            if size >= block:
                yield at, f" {CUT} ".join(held)
                held, at, size = [], [], 0
    if held:
        yield at, f" {CUT} ".join(held)


class Forms(list):
    """Texts in their visual form."""

    def __init__(self, texts: list[str | None]):
        super().__init__("" if t is None else visual_form(t).replace(CUT, " ") for t in texts)


def template_windows(texts: list[str | None], lexicon: Lexicon | Coder, wanted: np.ndarray | None, width: int = WIDTH, block: int = BLOCK) -> list[tuple[int, int, int, list[str]]]:
    """(text, position, hash, words) of the windows of ``texts``; of ``wanted`` (sorted hashes) only, if given. Positions are
    counted over the whole text."""
    forms = texts if isinstance(texts, Forms) else Forms(texts)
    coder = lexicon if isinstance(lexicon, Coder) else Coder(lexicon)
    out = []
    last, past = -1, 0  # the text that came last, and its words before the next part's lead
    for at, joined in _stretches(forms, block, width):
        code, first, end = coder.codes(joined)
        start, h = window_hashes(code, width)
        if wanted is not None:
            k = np.searchsorted(wanted, h)
            hit = wanted[np.minimum(k, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
            start, h = start[hit], h[hit]
        seams = np.flatnonzero(code == SEAM)
        part = np.searchsorted(seams, start)
        begins = np.concatenate(([0], seams + 1))
        lengths = np.append(seams, len(code)) - begins
        before = []
        for i, n in zip(at, lengths.tolist()):
            before.append(past if i == last else 0)
            last, past = i, before[-1] + max(0, n - (width - 1))
        for p, s, x in zip(part.tolist(), start.tolist(), h.tolist()):
            words = [joined[a:b].lower() for a, b in zip(first[s : s + width].tolist(), end[s : s + width].tolist())]
            out.append((at[p], int(s - begins[p]) + before[p], x, words))
    return out


class _Vocabulary(dict):
    """Numbers of the tokens as written, with what each is in LOOSE and CASED, and its part in finding units."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.kinds: tuple[list[int], list[int]] = ([], [])
        self.can: list[bool] = []
        self.more: list[bool] = []

    def __missing__(self, w: str) -> int:
        k = w.lower()
        capital = w[0].isupper()
        name = capital and k not in self.lexicon.small and not (w.isupper() and k in UNITS)
        if w == CUT or w in MARKS:
            kind = SEAM if w == CUT else MARK
        elif any(c.isdigit() for c in k):
            kind = NUMBER
        elif name:
            kind = NAME
        else:
            kind = UNIT if w == "%" or k in UNITS else self.lexicon.kinds.get(k, NONE)
        self.kinds[0].append(kind)
        self.kinds[1].append(NAME if capital and kind != NUMBER else kind)
        self.can.append(not capital and k not in NOT_UNITS and kind not in (SEAM, MARK, NUMBER))
        self.more.append(k == "more")
        self[w] = len(self)
        return len(self) - 1


def _groups(kind: np.ndarray, can: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and kinds of the template's places: runs of names and of units are one, marks none."""
    kind = kind.copy()
    number = kind == NUMBER
    after = np.zeros(len(kind), bool)
    after[1:] = number[:-1]
    after[2:] |= number[:-2] & more[1:-1]
    kind[after & can] = UNIT
    new = kind != MARK
    new[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] != NAME) & (kind[1:] != UNIT))
    at = np.flatnonzero(new)
    return at, kind[at]


def _blocks(texts: list[str], block: int) -> Iterator[tuple[list[int], str, bool]]:
    """Texts joined by seams up to ``block`` characters; longer ones alone, in parts cut at blanks. The last value tells
    whether the text goes on."""
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) <= block:
            held.append(i)
            size += len(t)
        if held and (size >= block or len(t) > block or i + 1 == len(texts)):
            yield held, f" {CUT} ".join(texts[k] for k in held), False
            held, size = [], 0
        if len(t) > block:
            a = 0
            while a < len(t):
                b = a + block
                while b < len(t) and not t[b].isspace():
                    b += 1
                yield [i], t[a:b], b < len(t)
                a = b


def placed_windows(texts: list[str | None], lexicon: Lexicon, wanted: np.ndarray | None, width: int = WIDTH, block: int = BLOCK) -> list[tuple[int, int, int, int, list[str], list[bool]]]:
    """(text, reading, position, hash, values, slots) of the windows in LOOSE and CASED; positions are places of the
    template, counted over the whole text."""
    forms = texts if isinstance(texts, Forms) else Forms(texts)
    out = []
    vocab = _Vocabulary(lexicon)
    kept: dict[int, tuple[list[str], int, int]] = {}  # of a text that goes on, by reading: last tokens, places before them, places of them that are done
    for ids, joined, goes_on in _blocks(forms, block):
        if len(vocab) > 1_000_000:
            vocab = _Vocabulary(lexicon)
        fresh = PLACED.findall(joined)
        found = np.fromiter(map(vocab.__getitem__, fresh), np.int64, len(fresh))
        for reading in (LOOSE, CASED):
            lead, before, done = kept.pop(reading, ([], 0, 0))
            tokens = lead + fresh
            index = np.concatenate((np.array([vocab[t] for t in lead], np.int64), found))
            at, kind = _groups(*(np.array(x)[index] for x in (vocab.kinds[reading - 1], vocab.can, vocab.more))) if tokens else (np.empty(0, np.int64), np.empty(0, np.int64))
            start, h = window_hashes(kind, width)
            h = h ^ np.int64(reading * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF)
            ok = start >= done
            if goes_on:  # the last place may grow; what comes next starts where its kind needs nothing before it
                ok &= start + width < len(at)
                done = max(done, len(at) - width)
                a = min(done, max(len(at) - 1, 0))
                while a > 0 and (kind[a] == UNIT or vocab.more[index[at[a]]]):
                    a -= 1
                kept[reading] = (tokens[at[a] :] if len(at) else [], before + a, done - a)
            if wanted is not None:
                k = np.searchsorted(wanted, h)
                ok &= wanted[np.minimum(k, len(wanted) - 1)] == h if len(wanted) else False
            start, h = start[ok], h[ok]
            seams = np.flatnonzero(kind == SEAM)
            begins = np.concatenate(([0], seams + 1))
            ends = np.append(at, len(tokens))
            for p, s, x in zip(np.searchsorted(seams, start), start, h):
                values = [" ".join(t.lower() for t in tokens[ends[g] : ends[g + 1]] if t not in MARKS) for g in range(s, s + width)]
                out.append((ids[p], reading, int(before + s - begins[p]), int(x), values, [bool(c < FIRST) for c in kind[s : s + width]]))
    return out


def item_lexicon(items: DataFrame, text: str) -> Lexicon:
    """The lexicon of all items, counted in parallel; only the vocabulary of the items, a stated query set, comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            u = Lexicon.uses(Forms(df["t"].tolist()))
            yield pd.DataFrame([(k, *n) for k, n in u.items()], columns=["w", "a", "b", "c"])

    uses = items.select(F.col(text).alias("t")).dropna().mapInPandas(count, "w string, a bigint, b bigint, c bigint")
    total = uses.groupBy("w").agg(*[F.sum(c).alias(c) for c in "abc"])
    return Lexicon.of_uses({r.w: [r.a, r.b, r.c] for r in total.collect()})


def item_windows(items: DataFrame, item_id: str, text: str, lexicon, width: int, placed: bool) -> Stored:
    """All windows of the items: ``item_id``, ``reading``, ``ipos``, ``h``, ``iwords``, ``slots``. ``lexicon`` is broadcast."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon.value
        plain = {w for w, k in lex.kinds.items() if k >= FIRST}
        for df in batches:
            forms, ids = Forms(df["t"].tolist()), df["i"].tolist()
            rows = [(ids[i], WORDS, s, h, w, [x not in plain for x in w]) for i, s, h, w in template_windows(forms, lex, None, width)]
            if placed:
                rows += [(ids[i], *r) for i, *r in placed_windows(forms, lex, None, width)]
            yield pd.DataFrame(rows, columns=["item_id", "reading", "ipos", "h", "iwords", "slots"])

    schema = f"item_id {dict(items.dtypes)[item_id]}, reading int, ipos int, h bigint, iwords array<string>, slots array<boolean>"
    return store(items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).dropna(subset=["t"]).mapInPandas(cut, schema), "items")


def matched_windows(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = WIDTH, per_pass: int = WINDOWS_A_PASS, placed: bool = False) -> DataFrame:
    """One row per document window and item window with one template: ``doc_id``, ``item_id``, ``reading``, ``pos``,
    ``ipos``, ``words``, ``iwords``, ``slots`` (which of the words stand in slots). With ``placed`` in all readings, else
    in WORDS, which has every exact leak.

    A pass looks for a part of the hash values, so passes differ in nothing but what they look for.
    """
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(item_lexicon(items, item_text))
    index = item_windows(items, item_id, item_text, lexicon, width, placed)
    passes = max(1, -(-index.df.count() // per_pass))
    out = None
    for p in range(passes):
        block = index.df if passes == 1 else index.df.filter(F.pmod("h", F.lit(passes)) == p)
        found = block.select("h").distinct().toPandas()["h"].to_numpy(np.int64)  # at most per_pass hashes of the items
        shared = spark.sparkContext.broadcast(np.sort(found))

        def seek(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lex, wanted = lexicon.value, shared.value
            coder = Coder(lex)
            for df in batches:
                texts = Forms(df["text"].tolist())
                hits = template_windows(texts, coder, wanted, width)
                if placed:
                    hits += [(i, s, h, w) for i, _, s, h, w, _ in placed_windows(texts, lex, wanted, width)]
                if not hits:
                    continue
                d = df["doc_id"].to_numpy()
                yield pd.DataFrame({"doc_id": [d[i] for i, *_ in hits], "pos": [s for _, s, _, _ in hits], "h": [h for _, _, h, _ in hits], "words": [w for *_, w in hits]})

        src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
        hits = src.mapInPandas(seek, f"doc_id {dict(docs.dtypes)[doc_id]}, pos int, h bigint, words array<string>")
        joined = hits.join(F.broadcast(block) if index.small(BROADCAST_BYTES * passes) else block, "h").drop("h")
        out = joined if out is None else out.unionByName(joined)
    return out


def _slot_values() -> Column:
    """Values in the slots of both windows, beside each other."""
    return F.transform(F.filter(F.arrays_zip("iwords", "words", "slots"), lambda x: x["slots"]), lambda x: F.struct(x["iwords"].alias("i"), x["words"].alias("d")))


def _one_to_one(slots: Column) -> Column:
    n = lambda a: F.size(F.array_distinct(a))
    return (n(slots) == n(F.transform(slots, lambda x: x["i"]))) & (n(slots) == n(F.transform(slots, lambda x: x["d"])))


def exact_leaks(windows: DataFrame) -> DataFrame:
    """Distinct (``doc_id``, ``item_id``) that share a whole window of words.

    Window pairs come from the template join; those whose slot values map one to one are consistent, and of these the
    ones whose values are the same are exact.
    """
    same = windows.filter(F.col("reading") == WORDS).withColumn("_s", _slot_values()).filter(_one_to_one(F.col("_s")))
    return same.filter(F.col("words") == F.col("iwords")).select("doc_id", "item_id").distinct()


def leaks(windows: DataFrame, min_plain: int = MIN_PLAIN) -> DataFrame:
    """Documents and items with ``kind`` (exact, reparameterised) and ``windows``, the document windows that match in the
    reading in which most do.

    Windows of one reading on one diagonal (document position less item position) belong to one passage. Its slots are consistent
    when each value of the item always stands for one value of the document and the other way round.
    """
    w = windows.select("doc_id", "item_id", "reading", "pos", (F.col("pos") - F.col("ipos")).alias("diag"), ((F.col("reading") == WORDS) & (F.col("words") == F.col("iwords"))).alias("same"), _slot_values().alias("slots"), (F.size("slots") - F.size(F.filter("slots", lambda x: x))).alias("plain"))
    w = store(w.filter((F.col("plain") >= min_plain) | F.col("same")), "leak-windows").df
    key = ["doc_id", "item_id", "reading", "diag"]
    pairs = w.select(*key, F.explode("slots").alias("s")).select(*key, "s.i", "s.d").distinct()
    count = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("i").alias("ni"), F.countDistinct("d").alias("nd"), F.max(F.col("i") != F.col("d")).alias("other"))
    bad = count.filter(f"n <> ni or n <> nd or reading <> {WORDS} and not other").select(*key, F.lit(True).alias("bad"))
    per = w.groupBy(*key).agg(F.max("same").alias("same"), F.countDistinct("pos").alias("windows")).join(bad, key, "left").filter("same or bad is null")
    per = per.groupBy("doc_id", "item_id", "reading").agg(F.max("same").alias("same"), F.sum("windows").alias("windows"))
    out = per.groupBy("doc_id", "item_id").agg(F.max("same").alias("same"), F.max("windows").alias("windows"))
    return out.select("doc_id", "item_id", F.when(F.col("same"), "exact").otherwise("reparameterised").alias("kind"), "windows")
