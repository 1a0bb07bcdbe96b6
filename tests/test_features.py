"""Text features, sources and sinks, scoring, small relational operators and models, on hand-made rows."""

import datetime as dt
import itertools
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.functions import features as X
from tidemark.functions import text as T
from tidemark.functions.polarity import Polarity
from tidemark.operators import asof, ensemble, evaluate, incremental, portfolio, regime, turns
from tidemark.operators import events as EV
from tidemark.operators import ml as L
from tidemark.operators import relational as R
from tidemark.operators import scoring as SC
from tidemark.sources import sinks as K
from tidemark.streaming import jobs as S

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
VAL = {"good": 1.9, "bad": -2.5, "great": 3.1}


# Polarity: values worked out from the published rules


def _norm(s):
    return s / np.sqrt(s * s + 15)


@pytest.mark.parametrize(
    "text,total",
    [
        ("good", 1.9),
        ("very good", 1.9 + 0.293),
        ("very plainly good", 1.9 + 0.293 * 0.95),
        ("slightly bad", -2.5 + 0.293),
        ("not good", 1.9 * -0.74),
        ("isn't so good", (1.9 + 0.293) * -0.74),
        ("never so good", (1.9 + 0.293) * 1.25),
        ("GOOD stuff", 1.9 + 0.733),
        ("good!!", 1.9 + 0.584),
        ("bad!", -2.5 - 0.292),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("least good", 1.9 * -0.74),
        ("at least good", 1.9),
        ("without doubt good", 1.9),
        ("good??", 1.9 + 0.36),
        ("plain words", 0.0),
    ],
)
def test_polarity_rules(text, total):
    assert abs(Polarity(VAL).scores(text)[0] - _norm(total)) < 1e-9


def test_polarity_shares_groups_and_empties():
    p = Polarity(VAL)
    c, pos, neg, neu = p.scores("good bad day")
    assert abs(pos + neg + neu - 1) < 1e-9 and abs(pos - 2.9 / 7.4) < 1e-9 and abs(neg - 3.5 / 7.4) < 1e-9
    assert p.row(None) == p.row("  ") == (0.0,) * 14
    row = dict(zip(("compound", "pos", "neg", "neu", "mean", "std", "min", "max", "p10", "p90", "pct_neg", "pct_pos", "n_chunks", "n_paragraphs"), p.row("Good. a. b. c. d. Bad. e.")))
    assert row["n_chunks"] == 2 and abs(row["max"] - _norm(1.9)) < 1e-9 and abs(row["min"] - _norm(-2.5)) < 1e-9 and row["pct_neg"] == row["pct_pos"] == 0.5


def test_feature_row_has_34_keys_and_handles_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "We gain. A loss, a loss! " * 400, 1)], "id int, full_z string, has_qa int").withColumn("prep_z", F.col("full_z")).withColumn("qa_z", F.col("full_z"))
    lex = X.Lexicons(VAL, ["gain"], ["loss"], ["we", "a", "gain"])
    r = {x.id: x for x in X.feature_rows(df, ["id"], "full_z", lex).collect()}
    assert len(r[1]) == 35 and len(X.ALL) == 34
    assert r[1].n_words == r[2].n_words == 0 and r[1].dale_chall_score == 0 and r[2].lm_net == 0
    assert (r[3].lm_positive, r[3].lm_negative, r[3].n_sentences) == (400, 800, 800) and abs(r[3].lm_net + 400 / 1201) < 1e-12
    share = 100 * 800 / 2400
    assert abs(r[3].dale_chall_score - (0.1579 * share + 0.0496 * 2400 / 800 + 3.6365)) < 1e-9
    wide = {x.id: x for x in X.section_features(df, ["id"], lex).collect()}
    assert len(wide[1]) == 1 + 3 * 34 and wide[2].qa_n_words is None and wide[2].full_n_words == 0 and wide[3].qa_lm_negative == 800


def test_packing_never_splits_sentences(spark):
    t = "One two three. Four! " + "w " * 300 + "end. Five six."
    got = [r.c for r in spark.createDataFrame([(t,), ("",), (None,)], "t string").select(T.pack_sentences(F.col("t"), 5).alias("c")).collect()]
    assert got[0][0] == "One two three. Four!" and len(got[0]) == 3 and got[0][2] == "Five six." and got[1] == [] and got[2] is None


# Sources and sinks


def test_pages_become_text(spark):
    long = "word " * 60
    page = f"<html><head><style>x</style></head><body><nav>menu</nav><div class='other'>skip me</div><div class='main-content'><p>{long}</p><script>1</script> end &amp; done<br></div><footer>foot</footer></body></html>"
    short = "<body><div class='content'>tiny</div><p>rest</p>"
    assert K.page_text(page) == f"{long.strip()} end & done" and K.page_text(short) == "tiny rest" and K.page_text(None) is None and K.page_text("") == ""
    got = [r.t for r in spark.createDataFrame([(page,), (None,)], "p string").select(K.page_text_column(F.col("p")).alias("t")).collect()]
    assert got == [K.page_text(page), None]


def test_tables_replace_missing_guard_and_cover(spark):
    path = runtime.new_path(spark, "t")
    assert K.read_or_empty(spark, path, "a int").count() == 0
    assert K.replace_table(spark.range(5), path) == 5
    assert K.replace_table(spark.read.parquet(path).filter("id < 2"), path) == 2 and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="nothing has no rows"):
        K.require_rows(spark.range(0), "nothing")
    assert K.covers(spark.range(5), spark.range(3), ["id"]) and not K.covers(spark.range(3), spark.range(5), ["id"])
    assert K.resolve_names(["a"], [], [], []) == ["A"] and K.resolve_names(None, ["x"] * 9, ["l"], ["c"]) == ["x"] * 9 and K.resolve_names(None, ["x"], ["l"], ["c"]) == ["l"] and K.resolve_names(None, [], [], ["d", "c"]) == ["c", "d"]


def test_resume_scores_only_what_is_missing(spark):
    path, seen = runtime.new_path(spark, "r"), []
    df = spark.range(10).withColumnRenamed("id", "k")

    def score(x):
        seen.append(x.count())
        return x.withColumn("s", F.col("k") + 1)

    _, a = K.resume(df.filter("k < 4"), path, ["k"], score, "k bigint, s bigint")
    out, b = K.resume(df, path, ["k"], score, "k bigint, s bigint")
    _, c = K.resume(df, path, ["k"], score, "k bigint, s bigint")
    assert (a, b, c) == (4, 6, 0) and seen == [4, 6, 0] and sorted((r.k, r.s) for r in out.collect()) == [(k, k + 1) for k in range(10)]


def test_filing_prefers_exhibit_99(spark):
    f = spark.createDataFrame([("a", D(1), 1, "Annex", "8-K", "u1"), ("a", D(1), 2, "Exhibit 99.1", "8-K", "u2"), ("a", D(3), 1, None, None, "u3"), ("a", D(9), 1, "99", "x", "u4")], "t string, filed date, seq int, description string, kind string, url string")
    e = spark.createDataFrame([("a", D(0)), ("a", D(-2)), ("a", D(20)), ("b", D(0))], "t string, d date")
    assert {r.d: r.url for r in K.nearest_filing(e.filter("t = 'a'"), "d", f, "t").collect()} == {D(0): "u3", D(-2): "u2", D(20): None}


def test_row_of_a_call_and_its_sections(spark):
    df = spark.createDataFrame([("aa ", "Q1", 2024, D(0), "s", 1, 3, 1, 1, 1, 2, 3, 0.123456, 1.00005, "a b c", "p", "q"), ("bb", "q2", 2024, D(0), "s", 0, 3, 1, 1, 1, 2, 3, 0.0, 0.0, "", None, None)], "ticker string, quarter string, year int, pub_date date, source string, has_qa int, n_turns int, n_exec_speakers int, n_analyst_speakers int, n_analyst_questions int, analyst_q_words int, exec_a_words int, answer_question_ratio double, hedge_per_1k double, full_text string, prepared_text string, qa_text string")
    rows = K.call_row(df)
    r = {x.ticker: x for x in rows.collect()}
    assert r["AA"].quarter == "q1" and r["AA"].answer_question_ratio == 0.1235 and r["AA"].n_words_full == 3 and r["BB"].n_words_full == 0
    assert {(x.ticker, x.section, x.text) for x in K.sections_of(rows, ["ticker"]).collect()} == {("AA", "full", "a b c"), ("AA", "prepared_remarks", "p"), ("AA", "qa", "q"), ("BB", "full", "")}


def test_intermediates_can_be_released(spark):
    path = runtime.store(spark.range(3), "gone").path
    assert runtime.release(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_intermediates_go_with_the_application(tmp_path):
    code = f"""
from tidemark.session import build_session
from tidemark import runtime
s = build_session("gone", master="local[1]", shuffle_partitions=1, spark__checkpoint__dir={str(tmp_path)!r})
runtime.store(s.range(3), "x"); runtime.new_path(s, "y")
import os
print("made", sum(f.startswith("tidemark") for f in os.listdir({str(tmp_path)!r})))
s.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    assert "made 2" in out.stdout, out.stderr[-2000:]
    for _ in range(50):
        if not [f for f in os.listdir(tmp_path) if f.startswith("tidemark")]:
            break
        time.sleep(0.2)
    assert not [f for f in os.listdir(tmp_path) if f.startswith("tidemark")]


def test_session_without_the_setting_gets_its_own_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Bare:
        conf, sparkContext = Conf(), spark.sparkContext

    assert runtime.shared_dir(Bare()) == runtime.shared_dir(Bare())


# Scoring


def test_scoring_retries_once_and_gives_up(spark):
    ok = "{" + ", ".join(f'"{f}": 1' for f in incremental.SCORE_FIELDS) + "}"

    def provider():
        return lambda p: ok if "fine" in p or SC.RETRY in p and "later" in p else "sorry"

    df = spark.createDataFrame([(1, "fine"), (2, "later"), (3, "never"), (4, None)], "k int, t string")
    got = {r.k: (r.demand_outlook, r.attempts) for r in SC.score_texts(df, ["k"], "t", provider, workers=2).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (None, 2)}

    def broken():
        def f(p):
            raise OSError("down")

        return f

    assert {r.k: r.demand_outlook for r in SC.score_texts(df, ["k"], "t", broken, workers=4).collect()} == {1: None, 2: None, 3: None}
    with pytest.raises(Exception, match="down"):
        SC.score_texts(df, ["k"], "t", broken, workers=1, most_failures=2).count()
    cost = SC.run_cost(spark.createDataFrame([("x" * 40,), (None,)], "p string"), "p", 1.0, 2.0, out_tokens=5).first()
    assert (cost.calls, cost.tokens_in) == (1, 10) and abs(cost.cost - 20e-6) < 1e-12


def test_probabilities_of_chunks(spark):
    df = spark.createDataFrame([(1, "up up."), (2, ""), (3, None)], "k int, t string")
    got = {r.k: r for r in SC.mean_probabilities(df, ["k"], "t", lambda: lambda c: [(2.0, 0.0, 0.0) for _ in c]).collect()}
    assert got[1].label == "positive" and abs(got[1].positive - np.exp(2) / (np.exp(2) + 2)) < 1e-9 and got[2].label == "neutral" and got[2].chunks == 0 and got[3].positive is None


# Relational


def test_quantiles_positions_and_folds(spark):
    rnd = random.Random(3)
    v = [rnd.choice([1.0, 2.0, 3.5]) if rnd.random() < 0.5 else rnd.random() * 100 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")
    got = R.exact_quantiles(df, "x", [0.0, 0.01, 0.5, 0.99, 1.0]).first().q
    assert np.allclose(got, np.quantile(v, [0.0, 0.01, 0.5, 0.99, 1.0]))
    assert R.exact_quantiles(spark.createDataFrame([(7.0,)], "x double"), "x", [0.3]).first().q == [7.0]
    assert R.exact_quantiles(df.limit(0), "x", [0.5]).first().q == [None]
    rows = [(D(i // 3), i) for i in range(31)]
    rnd.shuffle(rows)
    f = {r.i: r.fold for r in R.row_folds(spark.createDataFrame(rows, "d date, i int"), "d", ["i"], 3, 0.7).collect()}
    bounds = np.linspace(int(31 * 0.7), 31, 4).astype(int)
    assert f == {i: int(sum(i >= b for b in bounds[:3])) for i in range(31)}


def test_attributes_candidates_and_ends(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1.0), ("c", None, None)], "k string, full_x double, y_z double").withColumn("sector", F.lit("old"))
    dim = spark.createDataFrame([("a", "S1"), ("a", "S0"), ("b", None)], "k string, sector string")
    assert {r.k: r.sector for r in R.with_attribute(df, dim, "k", "sector", "Other").collect()} == {"a": "S1", "b": "Other", "c": "Other"}
    assert R.select_candidates(df, [("_z$", 0.3), ("^full_", 0.5), (".", 0.0)], []) == ["y_z", "full_x"] and R.select_candidates(df, [("_z$", 0.5), ("^full_", 0.9)], []) == []
    assert R.coverage(df.limit(0), ["full_x"]) == {"full_x": 0.0}
    assert {r.k for r in R.head_tail(df, "full_x", 1, ["k"]).collect()} == {"a", "b"} and R.head_tail(df, "full_x", 9, ["k"]).count() == 2
    o = R.overlap(df, df.limit(2), ["k"]).first()
    assert (o.both, o.covered) == (2, False)
    assert R.feature_count(100) == 8 and R.feature_count(4800) == 12 and R.feature_count(10**6) == 20
    n = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string").select(R.as_number("s").alias("v"))
    assert [r.v for r in n.collect()] == [1.5, None, None, None]


def test_names_of_targets():
    assert R.hold_days("abnormal_30d") == 30 and R.hold_days("target") == 1 and R.raw_target("abnormal_30d_va") == "abnormal_30d"
    assert R.prediction_column(["x", "predicted_a_va", "predicted_b"]) == "predicted_b" and R.prediction_column(["predicted_a_va"]) == "predicted_a_va" and R.prediction_column([]) is None
    assert R.ordered_distinct(["b", "a", "b"]) == ["b", "a"]


def test_texts_from_files_and_calls_without_speakers(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("one\ntwo")
    (tmp_path / "c").write_text("x")
    assert {(r.name, r.text) for r in K.text_files(spark, str(tmp_path)).collect()} == {("a b", "one\ntwo"), ("c", "x")}
    df = spark.createDataFrame([(1, [{"speaker": "Ann Lee", "text": "hello"}], "flat"), (2, [], " flat text\n"), (3, None, None)], "k int, turns array<struct<speaker:string,text:string>>, t string")
    assert {r.k: (r.full_text, r.n_turns) for r in turns.call_sections(df, ["k"], "turns", "t").collect()} == {1: ("hello", 1), 2: ("flat text", 0)}


def test_sample_keeps_each_stratum_and_the_total(spark):
    t = spark.createDataFrame([(f"t{i}", "s%d" % (i % 7 if i < 7 else 0)) for i in range(50)], "k string, s string")
    assert incremental.stratified_sample(t, "k", "s", 10).count() == 10
    wide = spark.createDataFrame([(f"t{i}", f"s{i}") for i in range(9)], "k string, s string")
    assert {r.s for r in incremental.stratified_sample(wide, "k", "s", 4).collect()} == {"s0", "s1", "s2", "s3"}
    assert incremental.stratified_sample(wide.limit(0), "k", "s", 4).count() == 0


def test_asof_shards_agree_with_brute_force(spark):
    rnd = random.Random(8)
    right = [(rnd.choice("ab"), D(rnd.randrange(0, 900)), rnd.randrange(50)) for _ in range(200)] + [("a", None, 1)]
    left = [(rnd.choice("abc"), D(rnd.randrange(-50, 1000)), i) for i in range(300)] + [("a", None, 999)]
    lf, rt = spark.createDataFrame(left, "k string, t date, id int"), spark.createDataFrame(right, "k string, t date, v int")

    def back(k, t, tol):
        c = [(d, v) for kk, d, v in right if kk == k and d and t and d <= t and (tol is None or (t - d).days <= tol)]
        return max(c)[1] if c else None

    def near(k, t, tol):
        b, f = [(d, v) for kk, d, v in right if kk == k and d and t and d <= t], [(d, v) for kk, d, v in right if kk == k and d and t and d >= t]
        db, df = (t - max(b)[0]).days if b else None, (min(f)[0] - t).days if f else None
        if db is not None and db <= tol and (df is None or db <= df):
            return max(b)[1]
        return min(f)[1] if df is not None and df <= tol else None

    for days in (7, 128):
        assert {r.id: r.v for r in asof.asof_backward(lf, rt, ["k"], "t", ["v"], None, days).collect()} == {i: back(k, t, None) for k, t, i in left}
        assert {r.id: r.v for r in asof.asof_backward(lf, rt, ["k"], "t", ["v"], 20, days).collect()} == {i: back(k, t, 20) for k, t, i in left}
        assert {r.id: r.v for r in asof.asof_nearest(lf, rt, ["k"], "t", ["v"], 30, days).collect()} == {i: near(k, t, 30) for k, t, i in left}
    assert asof.asof_nearest(lf, rt.limit(0), ["k"], "t", ["v"], 30).filter("v is not null").count() == 0


# Traps of the published code


def test_breadth_leaves_benchmarks_out_and_missing_vix_is_neutral(spark):
    px = [("B", D(i), 100.0 + i) for i in range(6)] + [("x", D(i), 10.0 - i) for i in range(6)] + [("y", D(i), 5.0) for i in range(4, 6)]
    p = spark.createDataFrame(px, "ticker string, date date, close double")
    got = {r.date: r.share for r in regime.breadth(p, ["B"], 3, 3).collect()}
    assert got == {D(i): 0.0 for i in range(6)}  # the rising benchmark does not count; the young name stays below the line
    v = spark.createDataFrame([(D(0), 40.0), (D(2), 30.0)], "date date, vix_close double")
    reg = {r.date: (r.vix, r.vix_close) for r in regime.regime(p, "B", v).collect()}
    assert reg[D(0)] == (-1.0, 40.0) and reg[D(1)] == (0.0, None) and reg[D(2)] == (-0.5, 30.0) and reg[D(3)] == (0.0, None)
    w = regime.stress_windows(regime.regime(p, "B", v), [("w", "2024-01-01", "2024-01-02"), ("none", "2020-01-01", "2020-01-02")]).collect()
    assert [(r.label, r.days, r.risk_off_pct) for r in w] == [("w", 2, 100.0)]


def test_grid_is_whole_and_ends_in_null(spark):
    panel = spark.createDataFrame([(D(1), "x", 0.9), (D(1), "y", 0.1), (D(3), "x", None), (D(3), "y", 0.5), (D(3), "w", 0.7)], "date date, ticker string, composite double")
    px = spark.createDataFrame([(t, D(i), None if t == "y" and i > 2 else 1.0) for t in ("B", "w", "x", "y") for i in range(5)] + [("z", D(0), None)], "ticker string, date date, close double")
    got = {(r.date, r.ticker): r.momentum_z for r in ensemble.momentum_daily(panel, px).collect()}
    assert len(got) == 4 * 4 and all(got[D(i), "B"] is None for i in range(1, 5))
    assert got[D(2), "y"] == got[D(1), "y"] == -1 and got[D(3), "y"] is None and got[D(4), "x"] == got[D(1), "x"] == 1  # a NULL score keeps the one before


def test_trades_of_small_dates_and_both_tails(spark):
    rows = [(D(0), float(i), 0.01 * i) for i in range(5)] + [(D(1), float(i), 0.1) for i in range(4)] + [(D(2), None if i == 0 else float(i), 0.1) for i in range(6)]
    t = portfolio.trades(spark.createDataFrame(rows, "d date, score double, actual double"), "d")
    assert t.count() == 15
    p = {r.d: r for r in portfolio.event_pnl(t, ["d"]).collect()}
    assert (p[D(0)].n_long, p[D(0)].n_short) == (2, 1) and abs(p[D(0)].gross - 0.035) < 1e-12
    assert p[D(1)].gross == p[D(1)].net == 0 and p[D(1)].long_only is None and abs(p[D(1)].ew - 0.1) < 1e-12
    assert p[D(2)].n == 6 and p[D(2)].n_long == 2
    m = portfolio.metrics(spark.createDataFrame([("a", D(0), 0.5), ("b", D(0), 0.1), ("b", D(40), -0.1), ("c", D(0), None)], "s string, d date, r double"), ["s"], "d", "r", 12.0)
    got = {r.s: (r.n, r.total, r.sharpe) for r in m.collect()}
    assert got["a"] == (1, 0.0, 0.0) and got["c"] == (0, 0.0, 0.0) and got["b"][0] == 2 and abs(got["b"][1] + 0.01) < 1e-12


# Models


def test_ridge_and_logit_are_the_published_ones(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(120, 2)) * [1.0, 30.0]
    y = 0.03 * x[:, 0] - 0.002 * x[:, 1] + rnd.normal(size=120) * 0.05
    df = spark.createDataFrame([(D(i), float(a), float(b), float(v), int(v > 0)) for i, ((a, b), v) in enumerate(zip(x, y))], "d date, a double, b double, y double, c int").withColumn("fold", F.when(F.col("d") >= D(90), 1).otherwise(0))
    tr, te = slice(0, 90), slice(90, 120)
    z = (x - x[tr].mean(0)) / x[tr].std(0)
    w = np.linalg.solve(z[tr].T @ z[tr] + 5 * np.eye(2), z[tr].T @ (y[tr] - y[tr].mean()))
    got = [r.predicted for r in L.walk_forward(df, ["a", "b"], "y", L.ridge(), 1).orderBy("d").collect()]
    assert np.allclose(got, y[tr].mean() + z[te] @ w, atol=1e-9)
    w, b = np.zeros(2), 0.0
    for _ in range(100):  # Newton steps for the penalised likelihood
        p = 1 / (1 + np.exp(-(z[tr] @ w + b)))
        g = np.append(z[tr].T @ (p - (y[tr] > 0)) + w, (p - (y[tr] > 0)).sum())
        s = p * (1 - p)
        a = np.column_stack((z[tr], np.ones(90)))
        h = a.T @ (a * s[:, None]) + np.diag([1.0, 1.0, 0.0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:2], b - step[2]
    got = [r.predicted for r in L.walk_forward(df, ["a", "b"], "c", L.logit(), 1, classify=True).orderBy("d").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(z[te] @ w + b))), atol=1e-4)


def test_shapley_values_add_up_and_equal_all_orders(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 3))
    y = x[:, 0] * 2 + (x[:, 1] > 0) * x[:, 2]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k int, a double, b double, c double, y double")
    data = L.prepared(df, ["a", "b", "c"], "y")
    model, apply = L.fit_one(data, ["a", "b", "c"], L.boosted(maxIter=5))
    scored = apply(data).cache()
    v = {r.k: (r.shap_a, r.shap_b, r.shap_c) for r in L.shapley_values(scored, model, ["a", "b", "c"], ["k"]).collect()}
    p = {r.k: (r.prediction, r._x.toArray()) for r in scored.select("k", "prediction", "_x").collect()}
    base = {round(p[k][0] - sum(v[k]), 9) for k in v}
    assert len(base) == 1  # prediction less the values is the same expectation everywhere
    trees = L._trees(model)

    def expect(t, at, row, known):
        f, cut, a, b, value, _ = t[at]
        if f < 0:
            return value
        if f in known:
            return expect(t, a if row[f] <= cut else b, row, known)
        w = t[a][5] / (t[a][5] + t[b][5])
        return w * expect(t, a, row, known) + (1 - w) * expect(t, b, row, known)

    for k in (0, 17):
        total = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for i, f in enumerate(order):
                total[f] += sum(expect(t, 0, p[k][1], set(order[: i + 1])) - expect(t, 0, p[k][1], set(order[:i])) for t in trees) / 6
        assert np.allclose(v[k], total, atol=1e-9)
    imp = {r.feature: r.splits for r in L.importances(model, ["a", "b", "c"], spark).collect()}
    assert sum(imp.values()) == sum(n[0] >= 0 for t in trees for n in t) and imp["a"] > 0


def test_winsor_clips_training_labels_only(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1000.0 if i == 0 else float(i % 2), 1 if i >= 100 else 0) for i in range(110)], "k int, x double, y double, fold int")
    got = L.walk_forward(df, ["x"], "y", L.ridge(1e-9), 1, winsor=0.02).filter("x = 0").first()
    assert abs(got.predicted) < 0.1 and L.walk_forward(df.limit(0), ["x"], "y", L.ridge(), 1).count() == 0


def test_auc_of_probabilities(spark):
    rnd = random.Random(6)
    rows = [(rnd.random(), rnd.choice([1.0, -1.0])) for _ in range(400)] + [(0.5, 1.0), (0.5, -1.0)]
    pos, neg = [s for s, a in rows if a > 0], [s for s, a in rows if a <= 0]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(evaluate.roc_auc(spark.createDataFrame(rows, "score double, actual double")).first().auc - want) < 1e-12


def test_event_features_pass_missing_columns_over(spark):
    rows = spark.createDataFrame([("a", "q1", 2024, D(5), 0.1)], "ticker string, quarter string, year int, date date, abnormal_30d double")
    px = spark.createDataFrame([("a", D(i), 1.0 + i) for i in range(10)], "ticker string, date date, close double")
    cal = px.select("date", F.datediff("date", F.lit(D(0))).alias("cal_idx"))
    sur = spark.createDataFrame([("a", D(6), 2.0)], "ticker string, earnings_date date, eps_surprise_pct double")
    sectors = spark.createDataFrame([], "ticker string, sector string")
    scores = spark.createDataFrame([("a", "q1", 2024, 2)], "ticker string, quarter string, year int, demand_outlook int")
    r = EV.event_features(rows, sectors, px, cal, sur, scores=scores).first()
    assert r.sector == "Other" and r.eps_surprise_pct == 2.0 and r.pre_momentum_5d == 5.0 and r.pre_momentum_20d is None and r.sue == 0 and r.llm_demand_outlook == 2 and r.va_scale is None


# Streams


def test_upserts_and_water_marks_over_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 5, "a"), (2, 1, "b")], [(1, 3, "late"), (3, 1, "c")], [(2, 9, "new")]]):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/x.parquet")
        assert i >= 0
    seen = S.Progress()
    spark.streams.addListener(seen)
    got = S.upsert_once(S.read_table(spark, str(tmp_path), "x", files_per_batch=1), ["k"], "t")
    assert {(r.k, r.v) for r in got.collect()} == {(1, "a"), (2, "new"), (3, "c")}
    have = spark.createDataFrame([(1, 4), (2, 1)], "k int, t int")
    fresh = S.run_once(S.above_water_mark(S.read_table(spark, str(tmp_path), "x"), have, "k", "t"))
    assert {(r.k, r.t) for r in fresh.collect()} == {(1, 5), (2, 9), (3, 1)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(seen)
    assert sum(n for _, n, _ in seen.batches) >= 5 and (seen.rate() > 0) and seen.seconds_left(10) is not None
