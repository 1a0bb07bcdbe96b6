import collections
import datetime as dt
import random
import re
import sys
import unicodedata

import numpy as np
import pytest
from compare import connect, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import leaks as LK
from tidemark.llm import mixing as MX
from tidemark.llm import reading_level as RL
from tidemark.llm import repeated_lines as RP
from tidemark.llm import visual_form as VF
from tidemark.llm.nearest_time import fit_segments, nearest
from tidemark.llm.queries import QUERIES
from tidemark.llm.queries_sql import ORACLE
from tidemark.llm.split_text import pieces, split_spans
from tidemark.llm.visual_form import lookalike_classes, lookalike_pairs, visual_form, visual_form_column
from tidemark.runtime import store

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("query", list(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, query):
    assert rows(QUERIES[query](spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(ORACLE[query]).df())


# Repeated lines


def test_repeated_lines_forms_ties_nulls(spark):
    docs = [(i, "s", f"AB{i}", f"Call {i} of AB{i}\t today\n\nown {chr(97 + i)}\nOwn {chr(97 + i)}\n \n(c) 20{i:02d} X Y") for i in range(6)]
    docs += [(10, None, "Q", docs[0][3]), (11, "s", "Q", None), (12, "s", None, ""), (13, "t", "Q", "call 1 of q today"), (14, "t", "Q", "call 2 of q today")]
    df = spark.createDataFrame(docs, "id int, src string, name string, text string").withColumn("h", F.lit(1)).withColumn("line_no", F.lit(1))
    got = {(r.id, r.line_no) for r in RP.repeated_lines(df, ["id"], "src", "text", "name").collect()}
    assert got == {(i, k) for i in range(6) for k in (1, 6)}
    _, sure = RP.line_sets(df, ["id"], "src", "text", "name")
    kept = {r.id: (r.kept_text, r.n_removed) for r in RP.without_lines(df, sure, "src", "text", "name").collect()}
    assert kept[0] == ("\nown a\nOwn a\n ", 2) and kept[10] == (docs[0][3], 0) and kept[12] == ("", 0) and kept[11][0] is None
    assert RP.repeated_lines(df.limit(0), ["id"], "src", "text", "name").count() == 0


def test_repeated_lines_share_and_long_sources(spark):
    rnd = random.Random(1)
    docs = [(i, "big", "\n".join(["rare" if i < 5 else "x%s" % rnd.random(), "often" if i % 10 == 0 else "-"] + [f"l{chr(97 + j // 26)}{chr(97 + j % 26)} {chr(97 + i % 26)}{chr(97 + i // 26)}" for j in range(300)])) for i in range(120)]
    got = RP.repeated_lines(spark.createDataFrame(docs, "id int, src string, text string"), ["id"], "src", "text", min_share=0.06)
    forms = collections.defaultdict(set)
    norm = lambda x: re.sub("[0-9]+", "#", x).strip()
    for i, _, t in docs:
        for x in t.split("\n"):
            forms[norm(x)].add(i)
    sure = {f for f, ids in forms.items() if f and len(ids) >= 8}
    assert {(r.id, r.line_no) for r in got.collect()} == {(i, n) for i, _, t in docs for n, x in enumerate(t.split("\n"), 1) if norm(x) in sure}


@pytest.mark.parametrize("tracked,map_size", [(12288, 16384), (96, 128), (12, 16)])
def test_long_sources_keep_to_the_sketches(spark, tracked, map_size):
    rnd = random.Random(5)
    docs = [(i, "abc"[i % 5 % 3], "\n".join([rnd.choice(["share this", "all rights", "follow us", "x"])] + [f"own {chr(97 + i % 26)}{chr(97 + i // 26)} {chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(90)])) for i in range(150)]
    df = spark.createDataFrame(docs, "id int, src string, text string")
    pairs, sure = RP.line_sets(df, ["id"], "src", "text", tracked=tracked, map_size=map_size)
    assert sure.df.count() == len({(s, t.split("\n")[0]) for _, s, t in docs})
    if map_size > 16:  # what was counted is what the sketches named, far from all lines
        assert pairs.count() < 0.1 * 150 * 91


def test_removed_lines_without_a_broadcast(spark):
    docs = [(i, "abc"[i % 3], f"Share this\nown {chr(97 + i)}\n\nshare  THIS\n{'Z' * (i % 3)}") for i in range(20)] + [(20, None, "Share this\nx"), (21, "a", None), (22, "a", "")]
    df = spark.createDataFrame(docs, "id int, src string, text string")
    _, sure = RP.line_sets(df, ["id"], "src", "text")
    plain = {tuple(r) for r in RP.without_lines(df, sure, "src", "text").collect()}
    sure.bytes = 1 << 60
    assert {tuple(r) for r in RP.without_lines(df, sure, "src", "text").collect()} == plain
    assert {r[0]: r[-2:] for r in plain}[0] == ("own a\n\n", 2) and len(plain) == 23


# Nearest time


@given(st.lists(st.integers(0, 2000), min_size=1, max_size=120, unique=True), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_segments_predict_within_bound(days, eps):
    days = sorted(days)
    seg = fit_segments(days, eps)
    for i, d in enumerate(days):
        x, slope, pos = [s for s in seg if s[0] <= d][-1]
        assert abs(pos + slope * (d - x) - i) <= eps + 1e-6


def test_nearest_against_brute_force(spark):
    rnd = random.Random(7)
    recs = [(rnd.choice("abc"), D(int(rnd.random() ** 3 * 1500))) for _ in range(900)] + [("a", None), (None, D(1))]
    qs = [(i, rnd.choice("abcd"), D(rnd.randrange(-100, 1700))) for i in range(600)] + [(900, None, D(1)), (901, "a", None)]
    q = spark.createDataFrame(qs, "days int, e string, x date").withColumn("m", F.lit("old"))
    r = spark.createDataFrame(recs, "e string, d date")
    by = collections.defaultdict(list)
    for e, d in recs:
        if e and d:
            by[e].append(d)
    want = {i: min(((abs((d - x).days), d) for d in by[e] if abs((d - x).days) <= 9), default=(0, None))[1] if x else None for i, e, x in qs}
    for shard, eps in ((512, 4), (16, 1)):
        got = nearest(q, "e", "x", r, "e", "d", 9, "m", shard_days=shard, epsilon=eps)
        assert {z.days: z.m for z in got.collect()} == want
    assert nearest(q, "e", "x", r.limit(0), "e", "d", 9, "m").filter("m is not null").count() == 0
    assert nearest(q.limit(0), "e", "x", r, "e", "d", 9, "m").count() == 0


# Reading level


def test_isotonic_is_monotone_and_fits():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=200)
    xs, ys = RL.isotonic(x, x + rnd.normal(scale=0.3, size=200))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert np.abs(np.interp(x, xs, ys) - x).mean() < 0.3


def test_levels_on_held_out_passages(spark, sf_dir):
    rows_ = spark.read.parquet(f"{sf_dir}/level_samples.parquet").collect()
    rows_.sort(key=lambda r: r.sample_id)
    train, held = rows_[::2], rows_[1::2]
    m = RL.LevelModel.fit([r.text for r in train], [r.grade for r in train])
    got = m.grade(m.index(RL.measures([r.text for r in held], m.ngrams)))
    g = np.array([r.grade for r in held])
    assert ((got >= 20) == (g >= 20)).all() and np.abs(got - g).mean() < 0.7


def test_levels_do_not_depend_on_blocks(spark, sf_dir):
    rnd = random.Random(9)
    m = RL.fit_levels(spark.read.parquet(f"{sf_dir}/level_samples.parquet"), "text", "grade")
    words = ["sales", "rose", "we", "don't", "believe.", "Why?", "Joe Doe:", "\n", "12.5", "étude", "x" * 300, ". and", "well-known"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (400, 3, 900, 60)] + ["y" * 5000, "One. Two! three? Four\n\nFive"]
    whole = RL.measures(texts, m.ngrams)
    for block in (1, 2, 7, 100, 1000):
        assert np.allclose(RL.measures(texts, m.ngrams, block), whole, rtol=1e-9)
    assert np.allclose(RL.measures(texts[::-1], m.ngrams)[::-1], whole, rtol=1e-9)


def test_levels_of_all_passages_from_models_that_have_not_seen_them(spark, sf_dir):
    rows_ = sorted(spark.read.parquet(f"{sf_dir}/level_samples.parquet").collect(), key=lambda r: r.sample_id)
    g, got = np.array([r.grade for r in rows_], float), np.zeros(len(rows_))
    for k in range(6):
        m = RL.LevelModel.fit([r.text for i, r in enumerate(rows_) if i % 6 != k], [r.grade for i, r in enumerate(rows_) if i % 6 != k])
        at = [i for i in range(len(rows_)) if i % 6 == k]
        got[at] = m.grade(m.index(RL.measures([rows_[i].text for i in at], m.ngrams)))
    print("mean error", np.abs(got - g).mean(), "wrong side of 20", ((got >= 20) != (g >= 20)).sum(), "of", len(g), "rank correlation", np.corrcoef(np.argsort(np.argsort(got)), np.argsort(np.argsort(g)))[0, 1])
    assert np.abs(got - g).mean() < 0.7 and ((got >= 20) != (g >= 20)).sum() <= 1


def test_levels_of_odd_texts(spark, sf_dir):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n . "), (4, "Joe Doe -- CEO: "), (5, "We sold 3 more.\n" * 90000), (6, "We sold 3 more.\n"), (7, "x" * 3_000_000), (8, "a\x1eb")], "id int, t string")
    m = RL.fit_levels(spark.read.parquet(f"{sf_dir}/level_samples.parquet"), "text", "grade")
    got = {r.id: r.l for r in df.select("id", RL.level_column(m, df, F.col("t")).alias("l")).collect()}
    assert all(got[i].level is None for i in (1, 2, 3, 4))
    assert abs(got[5].level - got[6].level) < 0.3 and got[5].sentences == 90000 and got[7].level > 20 and got[8].words == 2
    assert RL.fit_levels(spark.createDataFrame([], "t string, g int"), "t", "g") is None
    assert df.select(RL.level_column(None, df, F.col("t")).alias("l")).filter("l is not null").count() == 0


# Splitting


@given(st.text(alphabet=st.sampled_from("ab. \n\t!é😀"), max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_and_fit(text, limit, overlap):
    p = pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(b - a <= limit for a, b in p)
    for (a, b), (c, d) in zip(p, p[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_pieces_end_at_boundaries_and_share_words():
    text = " ".join(f"Sentence number {i} is here." for i in range(400))
    p = pieces(text, 500, 60)
    assert all(text[b - 1].isspace() or b == len(text) for _, b in p)
    assert all(text[a:b].strip().endswith(".") for a, b in p)
    assert all(40 <= b - c <= 60 and text[c - 1] == " " for (_, b), (c, _) in zip(p, p[1:]))


def test_split_column_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 9000), (4, "😀" * 4000)], "id int, t string")
    got = {r.id: r.s for r in df.select("id", split_spans(F.col("t")).alias("s")).collect()}
    assert got[1] is None and [(x.start, x.end) for x in got[2]] == [(0, 0)] and len(got[3]) == 3 and len(got[4]) == 1


# Leaks


def _brute(docs, items, n=12):
    at = collections.defaultdict(set)
    w = lambda t: re.findall(r"[^\W_]+", visual_form(t).lower())
    for i, t in items:
        x = w(t or "")
        for k in range(len(x) - n + 1):
            at[tuple(x[k : k + n])].add(i)
    return {(d, i) for d, t in docs for x in [w(t or "")] for k in range(len(x) - n + 1) for i in at.get(tuple(x[k : k + n]), ())}


def test_leaks_against_brute_force(spark, sf_dir):
    d, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "eval_items"))
    want = _brute(d.select("doc_id", "text").collect(), i.select("item_id", "text").collect())
    got = [(r.doc_id, r.item_id) for r in QUERIES["p8_found"](spark, sf_dir).collect()]
    assert set(got) == want and len(got) == len(want) > 0


ITEM = "In 2021 Selgodyne moved the forged anvil across from 41 market owners once the voucher followed 749 bolts because of Marsom."


def test_leaks_kinds_nulls_and_passes(spark):
    swap = ITEM.replace("2021", "1999").replace("Selgodyne", "Acmecorp").replace("41", "7").replace("749", "12").replace("Marsom", "Joeburg")
    docs = [(1, "intro words. " + ITEM.upper().replace(" ", " ")), (2, swap), (3, swap.replace("anvil", "table").replace("voucher", "letter")), (4, None), (5, ""), (6, "word " * 30 + ITEM + " word" * 30), (7, ITEM)]
    items = [(1, ITEM), (2, None), (3, "too short"), (4, ITEM)]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("words", F.lit(1))
    i = spark.createDataFrame(items, "item_id int, text string")
    for per in (4_000_000, 3):
        w = LK.matched_windows(d, "doc_id", "text", i, "item_id", "text", per_pass=per)
        assert {tuple(r) for r in LK.exact_leaks(w).collect()} == {(a, b) for a in (1, 6, 7) for b in (1, 4)}
        kinds = {(r.doc_id, r.item_id): r.kind for r in LK.leaks(w).collect()}
        assert kinds[2, 1] == "reparameterised" and kinds[1, 1] == "exact" and (3, 1) not in kinds
    empty = LK.matched_windows(d.limit(0), "doc_id", "text", i, "item_id", "text")
    assert LK.exact_leaks(empty).count() == 0 and LK.exact_leaks(LK.matched_windows(d, "doc_id", "text", i.limit(0), "item_id", "text")).count() == 0


def test_passes_share_one_lexicon(spark):
    """What an item's words are does not depend on which items are looked for together."""
    items = [(1, "On Monday Acme sold 12 crates of the apple stock to its partners in the north for cash again."), (2, "We saw apple and acme trees near the 7 partners of the crates on a monday with no stock at all."), (3, None)]
    docs = [(1, "Intro. " + items[0][1].replace("Acme", "Zeta").replace("12", "99") + " " + items[1][1])]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = [sorted(map(str, LK.matched_windows(d, "doc_id", "text", i, "item_id", "text", per_pass=per, placed=True).collect())) for per in (1_000_000, 5, 1)]
    assert got[0] == got[1] == got[2] and got[0]


def test_planted_reparameterised_leaks_are_found(spark, sf_dir):
    """Items of the project's data with other numbers, names and units, planted in documents: at least nine of ten come back."""
    rnd = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect() if len(re.findall(r"[^\W_]+", r.text)) >= 30]
    hosts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").dropna().collect() if len(r.text) > 200]
    names = ["Zarquon", "Pellmore", "Ostrava Works", "Kimber", "Dunsaney", "Villeroy Grand", "Threnody", "Quillfeather"]

    def other(text):
        swap = {}
        for w in dict.fromkeys(re.findall(r"(?<=[a-z,] )[A-Z][a-z]+(?: [A-Z][a-z]+)*", text)):
            swap[w] = names[len(swap) % len(names)] + ("" if len(swap) < len(names) else f"x{len(swap)}".replace("0", "o"))
        for w in dict.fromkeys(re.findall(r"(?<![\w.,])\d[\d.,]*\d|(?<![\w.,])\d", text)):
            swap[w] = str(1000 + 7 * len(swap))
        out = re.sub("|".join(rf"(?<!\w){re.escape(w)}(?!\w)" for w in sorted(swap, key=len, reverse=True)), lambda m: swap[m.group()], text) if swap else text
        return out, bool(swap)

    planted, docs = set(), []
    for n, (item, text) in enumerate(items):
        new, swapped = other(text)
        if swapped:
            planted.add((n, item))
            docs.append((n, rnd.choice(hosts) + "\n" + new + "\n" + rnd.choice(hosts)))
    assert len(planted) > 100
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in LK.leaks(LK.matched_windows(d, "doc_id", "text", i, "item_id", "text", placed=True)).collect()}
    print("recall", len(planted & got) / len(planted), "of", len(planted))
    assert len(planted & got) >= 0.9 * len(planted)


@pytest.mark.parametrize(
    "swaps",
    [
        {"749": "1,250", "41": "-3.5"},
        {"Lomo Quinmas": "Acme", "Marsom": "Joe Burg"},
        {"bolts": "kg", "market": "square metres"},
        {"Lomo Quinmas": "Apple"},
        {"Lomus Selbal": "Acme"},
        {"749 bolts": "5%"},
    ],
)
def test_leaks_whole_placeholders(spark, swaps):
    item = "Lomus Selbal changed in 2021 and Lomo Quinmas moved the forged anvil across from 41 market owners once the apple voucher followed 749 bolts because of Marsom today."
    other = item
    for a, b in swaps.items():
        other = other.replace(a, b)
    uneven = item.replace("2021", "1,999").replace("41", "7.5").replace("749", "7.5")  # two values of the item are one here
    d = spark.createDataFrame([(1, "intro. " + other), (2, item), (3, uneven)], "doc_id int, text string")
    i = spark.createDataFrame([(1, item)], "item_id int, text string")
    w = LK.matched_windows(d, "doc_id", "text", i, "item_id", "text", placed=True).cache()
    got = {r.doc_id: (r.kind, r.windows) for r in LK.leaks(w).collect()}
    per = collections.Counter(reading for _, reading, *_ in LK.placed_windows([item], LK.Lexicon.of([item]), None))
    met = {r.reading: r.n for r in w.filter("doc_id = 1").groupBy("reading").agg(F.countDistinct("pos").alias("n")).collect()}
    assert any(met.get(r) == per[r] > 0 for r in (LK.LOOSE, LK.CASED))  # no window of the passage is lost
    assert 1 in got and got[2][0] == "exact" and 3 not in got


@given(st.text(alphabet=st.sampled_from("aAéÉß_ .12²٣ΣςσİЖж\n-'語😀"), max_size=120), st.lists(st.text(alphabet="aéßσж1", min_size=1, max_size=3), max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_are_coded_as_written_out(text, known):
    lex = LK.Lexicon.of([" ".join(known)])
    code, start, end = LK.Coder(lex).codes(text)
    words = re.findall(r"[^\W_]+", text)
    assert [text[a:b] for a, b in zip(start, end)] == words
    sigma = lambda w: "".join(c.lower()[0] for c in w).replace("ς", "σ")
    kinds = {sigma(k): v for k, v in lex.kinds.items()}
    for w, c in zip(words, code.tolist()):
        if sigma(w) in kinds:
            assert c == kinds[sigma(w)]
        else:
            assert c == (LK.NUMBER if any(x.isdigit() for x in w) else LK.NAME if w[0].isupper() else LK.NONE)


def test_long_documents_keep_their_places():
    rnd = random.Random(3)
    words = ["alpha", "beta", "12", "3.5", "more", "square", "kg", "Acme", "Lomo", "Quinmas.", "gamma,", "of", "delta"]
    text = " ".join(rnd.choice(words) for _ in range(4000))
    lex = LK.Lexicon.of([text])
    whole = LK.placed_windows([text], lex, None)
    for block in (1, 40, 300, 5000):
        assert sorted(LK.placed_windows([text], lex, None, block=block)) == sorted(whole)
    texts = ["alpha beta", text, "", text[:700]]
    whole = LK.template_windows(texts, lex, None)
    for block in (1, 40, 300, 5000):
        assert sorted(LK.template_windows(texts, lex, None, block=block)) == sorted(whole)


def test_long_documents_lose_no_window():
    rnd = random.Random(2)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(5000))
    lex = LK.Lexicon.of([text])
    whole = collections.Counter(tuple(w) for *_, w in LK.template_windows([text], lex, None))
    cut = collections.Counter()
    coder = LK.Coder(lex)
    for at, joined in LK._stretches([text], block=300):
        code, first, end = coder.codes(joined)
        starts, h = LK.window_hashes(code)
        cut.update(tuple(joined[first[j] : end[j]] for j in range(k, k + LK.WIDTH)) for k in starts)
    assert cut == whole


# Mixing


def test_mix_shares_caps_and_hot_source(spark):
    rnd = random.Random(4)
    sizes = [(i, "hot" if i % 3 else "small" if i % 2 else "none", rnd.randrange(0, 200)) for i in range(6000)] + [(-1, None, 5), (-2, "hot", None)]
    targets = [("hot", 1.0, 1), ("small", 3.0, 2), ("nodocs", 2.0, 3), ("none", None, 2), ("hot2", 1.0, 0)]
    s = spark.createDataFrame(sizes, "doc_id int, source string, n_tokens int").withColumn("copies", F.lit(9))
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    plan = store(MX.mix_plan(s, t, MX.exact_total(s, t)), "plan")
    mixed = MX.mix(s, plan, "doc_id", chunk_docs=120).cache()
    rep = {r.source: r for r in MX.mix_report(mixed, plan, "doc_id").collect()}
    assert set(rep) == {"hot", "small"}
    assert abs(rep["hot"].target_share - 0.25) < 1e-9 and abs(rep["hot"].actual_share - 0.25) < 0.02
    assert rep["small"].most_repeats <= 2 and rep["hot"].most_repeats <= 1
    per = {r.source: r for r in mixed.groupBy("doc_id", "source").count().groupBy("source").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()}
    c = {r.source: r.copies for r in plan.df.collect()}
    assert all(per[x].hi <= np.ceil(c[x]) and per[x].lo >= max(1, np.floor(c[x])) for x in c)
    for x in c:  # systematic: the number emitted is within one of what is expected
        n = sum(1 for _, src, k in sizes if src == x and k)
        assert abs(mixed.filter(F.col("source") == x).count() - n * c[x]) <= 1
    assert mixed.filter("n_tokens = 0 or n_tokens is null").count() == 0
    none = store(MX.mix_plan(s.limit(0), t), "plan")
    assert MX.exact_total(s.limit(0), t) is None
    assert MX.mix(s, none, "doc_id").count() == 0 and MX.mix_report(mixed.limit(0), none, "doc_id").count() == 0


def test_mix_with_a_total_beyond_the_caps(spark):
    s = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(100)], "doc_id int, source string, n_tokens int")
    t = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 50)], "source string, target_weight double, max_repeats int")
    plan = store(MX.mix_plan(s, t, total=10_000.0), "plan")
    rep = {r.source: r for r in MX.mix_report(MX.mix(s, plan, "doc_id"), plan, "doc_id").collect()}
    assert rep["a"].tokens_used == 1000 and rep["b"].tokens_used == 5000


def test_one_small_source_does_not_shrink_the_mix(spark):
    s = spark.createDataFrame([(i, "small" if i < 10 else "mid" if i < 110 else "big", 10) for i in range(1000)], "doc_id int, source string, n_tokens int")
    t = spark.createDataFrame([("small", 1.0, 2), ("mid", 1.0, 3), ("big", 2.0, 4)], "source string, target_weight double, max_repeats int")
    plan = store(MX.mix_plan(s, t), "plan")
    rep = {r.source: r for r in MX.mix_report(MX.mix(s, plan, "doc_id"), plan, "doc_id").collect()}
    assert rep["small"].tokens_used == 200 and abs(rep["mid"].tokens_used - 2500) <= 10 and abs(rep["big"].tokens_used - 5000) <= 10
    exact = store(MX.mix_plan(s, t, MX.exact_total(s, t)), "plan")
    rep = {r.source: r for r in MX.mix_report(MX.mix(s, exact, "doc_id"), exact, "doc_id").collect()}
    assert rep["small"].tokens_used == 200 and abs(rep["big"].tokens_used - 400) <= 10


def test_token_count_is_the_tokenizers(spark):
    import tokenizers

    from public_tokenizers import path

    texts = ["Hello world, it's 2024!", "", None, "Großmann Werke 😀", "a" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", MX.token_count(F.col("t")).alias("n")).collect()}
    tok = tokenizers.Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    assert got == {i: None if t is None else len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# Visual form


@pytest.mark.parametrize("a,b", [("ＡＢ１", "AB1"), ("é", "é"), ("ﬁne oﬀer", "fine offer"), ("so­ft​ly﻿", "softly"), ("a b c", "a b c"), ("x‑y‐z", "x-y-z"), ("сору", "copy"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("Å", "Å")])
def test_drawn_alike(a, b):
    assert visual_form(a) == visual_form(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("1", "2"), ("x²", "x2"), ("a b", "a  b"), ("a-b", "a–b"), ("a,b", "ab"), ("0", "O"), ("½", "1/2")])
def test_drawn_otherwise(a, b):
    assert visual_form(a) != visual_form(b)


def test_mapped_characters_lie_where_they_are_sought():
    for cp in range(0x80, sys.maxunicode + 1):
        kind = unicodedata.decomposition(chr(cp)).partition(" ")[0]
        if unicodedata.category(chr(cp)) == "Zs" or kind in ("<wide>", "<narrow>", "<compat>"):
            assert any(a <= cp < b for a, b in VF.MAPPED), hex(cp)


@given(st.text(alphabet=st.one_of(st.sampled_from([chr(c) for a, b in VF.PLAIN_BLOCKS for c in range(a, b)]), st.characters(max_codepoint=0x7F), st.sampled_from("\u0301\u0308\u200b"))))
@settings(max_examples=300, deadline=None)
def test_plain_texts_are_their_own_form(t):
    assert visual_form(t) == VF._form(t)


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_form_is_stable(t):
    assert visual_form(visual_form(t)) == visual_form(t)


def test_lookalike_pairs_with_copies_and_nulls(spark):
    texts = ["same text", "same text", "same text", "sаme text", "Same text", None, None, "", "", "​", "other"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("f", F.lit(1)).withColumn("t", F.lit(2))
    got = [(r.doc_id_a, r.doc_id_b) for r in lookalike_pairs(df, "doc_id", "text").collect()]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] is not None and texts[b] is not None and texts[a] != texts[b] and visual_form(texts[a]) == visual_form(texts[b])}
    assert set(got) == want and len(got) == len(want) == 7
    links = collections.Counter(x for p in want for x in p)
    classes = {r.doc_id: (r.class_id, r.n_links) for r in lookalike_classes(df, "doc_id", "text").collect()}
    assert {k: n for k, (_, n) in classes.items()} == links and classes[3][0] == 0 and classes[9] == (7, 2)
    assert lookalike_classes(df.limit(0), "doc_id", "text").count() == 0
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    f = spark.createDataFrame([("STRASSE",), ("ﬁ Straße",), (None,)], "t string").select(visual_form_column(F.col("t"), fold_case=True).alias("f"))
    assert [r.f for r in f.collect()] == ["strasse", "fi strasse", None]
