import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import exprs as E
from tidemark.functions import text as T
from tidemark.operators import asof, ensemble, evaluate, incremental, panel, portfolio, turns
from tidemark.operators import market as M
from tidemark.operators import ml as L
from tidemark.operators.history import _steps, believed, bitemporal_ledger, ledger_steps_reference, versions
from tidemark.operators.point_in_time import as_known
from tidemark.operators.snapshot_diff import snapshot_changes, tree_depth
from tidemark.runtime import latest, store
from tidemark.streaming import jobs

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
TS = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_latest_ties_nulls_and_empty(spark):
    s = "k string, v double, t timestamp"
    df = spark.createDataFrame([("a", 1.0, TS(1)), ("a", 2.0, TS(2)), ("a", 2.0, TS(2)), ("b", None, None), (None, 5.0, TS(1))], s)
    assert {(r.k, r.v) for r in latest(df, ["k"], "t").collect()} == {("a", 2.0), ("b", None), (None, 5.0)}
    assert latest(spark.createDataFrame([], s), ["k"], "t").count() == 0


def test_store_knows_its_size(spark):
    x = store(spark.range(10), "t")
    assert x.df.count() == 10 and x.bytes > 0 and x.small() and not x.small(1)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), min_size=1, max_size=14, unique_by=lambda x: x[0]))
@settings(max_examples=200, deadline=None)
def test_sweep_steps(cells):
    cells = sorted(cells)
    valid, first = [c[0] for c in cells], [c[1] for c in cells]
    assert set(zip(*_steps(valid, first))) == ledger_steps_reference(valid, first)


LEDGER = "k string, d date, t timestamp, v double, extra string, present boolean"


def _ledger(spark, rows, absent=()):
    df = spark.createDataFrame(rows, LEDGER)
    gone = spark.createDataFrame(list(absent), "k string, d date, t timestamp")
    return bitemporal_ledger(df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), gone, ["k"], "d", "t", ["v"])


def test_late_update_splits_without_overwriting(spark):
    led = _ledger(spark, [("a", D(0), TS(0), 1.0, "", None), ("a", D(20), TS(20), 3.0, "", None), ("a", D(10), TS(30), 2.0, "", None), ("a", D(10), TS(30), 2.0, "", None)])
    at = lambda t: {(r.valid_from, r.valid_to, r.v) for r in believed(led, F.lit(t)).collect()}
    end = dt.date(9999, 12, 31)
    assert at(TS(5)) == {(D(0), end, 1.0)}
    assert at(TS(25)) == {(D(0), D(20), 1.0), (D(20), end, 3.0)}
    assert at(TS(31)) == {(D(0), D(10), 1.0), (D(10), D(20), 2.0), (D(20), end, 3.0)}
    assert led.count() == 5


def test_withdrawal_of_a_recorded_day(spark):
    rows = spark.createDataFrame([("a", D(0), TS(0), 1.0), ("a", D(0), TS(5), 1.0), ("a", D(0), TS(9), 1.0)], "k string, d date, t timestamp, v double")
    gone = spark.createDataFrame([("a", D(0), TS(7))], "k string, d date, t timestamp")
    led = bitemporal_ledger(rows, None, ["k"], "d", "t", ["v"], withdrawn=gone)
    got = sorted((r.recorded_from, r.recorded_to, r.present, r.v) for r in led.collect())
    assert got == [(TS(0), TS(7), True, 1.0), (TS(7), TS(9), False, None), (TS(9), dt.datetime(9999, 12, 31), True, 1.0)]
    weak = bitemporal_ledger(rows, gone, ["k"], "d", "t", ["v"])  # an absence after a record says nothing
    assert [(r.recorded_from, r.present) for r in weak.collect()] == [(TS(0), True)]


def test_versions_missing_values_absence_and_empty(spark):
    nan = float("nan")
    led = _ledger(spark, [("a", D(0), TS(0), None, "x", None), ("a", D(1), TS(1), nan, "y", None), ("a", D(3), TS(3), 2.0, "", True), (None, D(0), TS(0), 1.0, "", None), ("a", None, TS(0), 1.0, "", None)], [("a", D(2), TS(3)), ("b", D(2), TS(3))])
    got = {(r.k, r.valid_from, r.valid_to, r.v) for r in versions(believed(led), ["k"], ["v"]).collect()}
    assert got == {("a", D(0), D(2), None), ("a", D(3), dt.date(9999, 12, 31), 2.0)}
    assert versions(believed(_ledger(spark, [])), ["k"], ["v"]).count() == 0


def test_changes_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(D(d), f"k{k}", rnd.choice([1.0, 2.0, None]), TS(d), "x") for d in (0, 5, 9, 20) for k in range(300) if rnd.random() < 0.9]
    rows = [r for r in rows if r[0] != D(9)]
    df = spark.createDataFrame(rows + rows[:50], "s date, k string, v double, t timestamp, leaf string")
    days = spark.createDataFrame([(D(d),) for d in (0, 5, 9, 20, 20)] + [(None,)], "s date")
    held = {d: {r[1]: r[2] for r in rows if r[0] == D(d)} for d in (0, 5, 9, 20)}
    want = set()
    for a, b in ((0, 5), (5, 9), (9, 20)):
        for k in held[a].keys() | held[b].keys():
            kind = "added" if k not in held[a] else "removed" if k not in held[b] else "changed" if held[a][k] != held[b][k] else None
            if kind:
                want.add((D(b), k, kind))
    got = snapshot_changes(df, days, "s", ["k"], ["v"], "t", fanout=4)
    assert {(r.s, r.k, r.change) for r in got.collect()} == want and got.count() == len(want)
    assert snapshot_changes(df.limit(0), days, "s", ["k"], ["v"], "t").count() == 0
    assert snapshot_changes(df, days.limit(0), "s", ["k"], ["v"], "t").count() == 0
    assert tree_depth(0) == 1 and tree_depth(16 * 16**3, 16) == 3


def test_changes_see_values_swapped_with_null(spark):
    nan = float("nan")
    rows = [(D(0), "a", None, 5.0, TS(0)), (D(1), "a", 5.0, None, TS(1)), (D(0), "b", None, 1.0, TS(0)), (D(1), "b", nan, 1.0, TS(1)), (D(0), "c", 2.0, 2.0, TS(0)), (D(1), "c", None, None, TS(1))]
    df = spark.createDataFrame(rows, "s date, k string, v double, w double, t timestamp")
    got = snapshot_changes(df, df.select("s"), "s", ["k"], ["v", "w"], "t")
    assert {(r.k, r.change) for r in got.collect()} == {("a", "changed"), ("c", "changed")}


def test_as_known_against_brute_force(spark):
    rnd = random.Random(5)
    vals = [(rnd.choice("ab"), D(rnd.randrange(400)), TS(rnd.randrange(500))) for _ in range(120)] + [(None, D(1), TS(1)), ("a", None, TS(1)), ("a", D(2), None)]
    events = [(rnd.choice("abc"), D(rnd.randrange(600))) for _ in range(80)] + [("a", None), (None, D(50)), ("a", D(100)), ("a", D(100))]
    v = spark.createDataFrame(vals, "e string, d date, t timestamp")
    e = spark.createDataFrame(events, "e string, day date")
    got = as_known(e, "day", [{"rows": v, "entity": ["e"], "date": "d", "loaded": "t", "out": "known"}, {"rows": v, "entity": [], "date": "d", "out": "any", "few": True}])
    best = lambda k, x: max((d for a, d, t in vals if a == k and a and d and t and d < x and t < dt.datetime.combine(x, dt.time())), default=None)
    anyd = lambda x: max((d for _, d, _ in vals if d and d < x), default=None)
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, {(k, x, best(k, x), anyd(x)) for k, x in events if x}))
    assert as_known(e, "day", [{"rows": v.limit(0), "entity": ["e"], "date": "d", "out": "known"}]).filter("known is not null").count() == 0


def test_ranks_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 5.0, None)], "x double").withColumn("g", F.lit(1))
    got = [r.p for r in df.select("x", E.pct_rank("x", "g").alias("p")).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert got == [0.25, 0.625, 0.625, 1.0, None]
    b = spark.range(1, 16).select("id", E.quantile_bin(F.col("id"), F.lit(15)).alias("b")).orderBy("id")
    assert [r.b for r in b.collect()] == [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 7, 7, 8, 9, 9]
    c = spark.createDataFrame([(None,), (50.0,)], "x double").select(E.clip("x", -1, 1).alias("c")).collect()
    assert {r.c for r in c} == {None, 1.0}
    z = spark.createDataFrame([(1, 3.0)], "g int, x double").select(E.zscore("x", "g").alias("z")).first()
    assert z.z == 0


def test_streak_and_expanding(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, -1.0, 0.0, 3.0])], "k string, i int, v double")
    assert [r.streak for r in panel.streak(df, ["k"], ["i"], "v").orderBy("i").collect()] == [0, 1, 2, -1, 0]
    z = panel.past_stats(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0)], "k string, i int, v double"), ["k"], ["i"], "v", 2)
    assert [r.v_past_std and round(r.v_past_std, 6) for r in z.orderBy("i").collect()] == [None, None, 0.707107]


def test_event_returns_branches(spark):
    px = spark.createDataFrame([("a", D(i), 100.0 + i) for i in range(5)] + [("b", D(i), None if i == 0 else 1.0) for i in range(5)], "ticker string, date date, close double")
    cal = M.calendar(px)
    e = spark.createDataFrame([("a", D(-1)), ("a", D(4)), ("b", D(0)), ("zz", D(0)), ("a", D(40))], "ticker string, earnings_date date")
    got = M.event_window_returns(M.entries(e, "earnings_date", cal), ["ticker", "earnings_date"], px, cal, (1,))
    r = {(x.ticker, x.earnings_date): x.r1 for x in got.collect()}
    assert abs(r["a", D(-1)] - 0.01) < 1e-12 and [v for k, v in r.items() if k != ("a", D(-1))] == [None] * 4


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("a", D(10), 1), ("a", D(60), 2), ("b", D(10), 3)], "k string, t date, id int")
    right = spark.createDataFrame([("a", D(8), 1), ("a", D(8), 2), ("a", D(12), 3), ("a", D(90), 9), ("a", D(91), 9)], "k string, t date, v int")
    assert {r.id: r.v for r in asof.asof_nearest(left, right, ["k"], "t", ["v"], 30).collect()} == {1: 2, 2: 9, 3: None}
    assert {r.id: r.v for r in asof.asof_nearest(left, right, ["k"], "t", ["v"], 29).collect()}[2] is None
    assert {r.id: r.v for r in asof.asof_backward(left, right, ["k"], "t", ["v"], 10).collect()} == {1: 2, 2: None, 3: None}


def test_scored_panel_is_the_composite_of_the_panel(spark):
    rnd = random.Random(12)
    rows = [(f"t{k}", D(i), 10.0 + rnd.random() * 5, float(rnd.randrange(1000))) for k in range(6) for i in range(420) if rnd.random() < 0.99 or k == 0]
    px = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    sector = F.substring("ticker", 2, 1).cast("int") % 2
    cal = M.calendar(px)
    a = M.composite(M.momentum_panel(px, cal, "t0", sector)).select("date", "ticker", "composite", "rev_5d_sn")
    b = M.scored_panel(px, cal, "t0", sector).select("date", "ticker", F.col("composite").alias("c"), F.col("rev_5d_sn").alias("r"))
    x = a.join(b, ["date", "ticker"], "full").collect()
    assert len(x) == a.count() == b.count() > 8 and all((r.composite is None) == (r.c is None) and abs((r.composite or 0) - (r.c or 0)) < 1e-9 and r.rev_5d_sn == r.r for r in x)


def test_decay(spark):
    cal = spark.createDataFrame([(D(i), i) for i in range(40)], "date date, cal_idx int")
    s = spark.createDataFrame([("a", D(0), 1.0), ("b", D(0), -1.0)], "ticker string, event_date date, score double")
    got = {r.date: r.eca_z for r in ensemble.event_decay(s, cal, cal.select(F.col("date").alias("event_date"), F.col("cal_idx").alias("entry_idx"))).filter("ticker = 'a'").collect()}
    assert got[D(0)] == 1 and abs(got[D(15)] - 0.5) < 1e-9 and D(30) not in got


def test_sizing_needs_names(spark):
    df = spark.createDataFrame([(1, float(i), 0.1, "S") for i in range(3)], "date int, score double, vol double, sector string")
    assert {r.weight for r in portfolio.size_one_date(df).collect()} == {0.0}
    assert {r.weight for r in portfolio.size_deciles(df).collect()} == {0.0}


def test_drawdown_starts_after_first_return(spark):
    df = spark.createDataFrame([(1, 0, -0.10), (1, 1, 0.05)], "g int, i int, r double")
    assert portfolio.drawdowns(df, ["g"], "i", "r").agg(F.min("drawdown")).first()[0] == 0


def test_auc_and_empty(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.4, -1.0), (0.4, 1.0), (0.1, -1.0)], "score double, actual double")
    assert abs(evaluate.roc_auc(df).first().auc - 0.875) < 1e-12
    assert evaluate.roc_auc(df.limit(0)).first().auc is None


def test_names_turns_and_boundary(spark):
    s = spark.createDataFrame([("John T. Doe -- CEO",), ("John Doe",), ("Doe",), (None,), ("(x)",)], "s string")
    assert [r.k for r in s.select(turns.name_key(F.col("s")).alias("k")).collect()] == ["john doe", "john doe", "doe", "", ""]
    j = spark.createDataFrame([('{not json',), (None,), ('[{"text":" "}]',), ('[{"speaker":"Operator","text":"now our first question"},{"speaker":"A B","text":"hi?"}]',)], "j string")
    got = [(len(r.t), r.b) for r in j.select(turns.normalize_turns(F.col("j")).alias("t")).select("t", turns.qa_boundary(F.col("t")).alias("b")).collect()]
    assert got == [(0, 0), (0, 0), (0, 0), (2, 1)]


def test_split_turns_statistics(spark):
    said = [("Ann Lee -- CEO", "Welcome all."), ("Operator", "We take the first question."), ("Bob Ray", "Why? How? " + "w " * 130), ("Ann Lee", "I think it depends. " + "a " * 130), ("Cy Fox", "Sales rose.")]
    df = spark.createDataFrame([(1, [{"speaker": a, "text": b} for a, b in said]), (2, [])], "id int, turns array<struct<speaker:string,text:string>>")
    r = {x.id: x for x in turns.split_turns(df, ["id"]).collect()}
    assert (r[1].n_turns, r[1].has_qa, r[1].n_exec_speakers, r[1].n_analyst_speakers, r[1].n_analyst_questions) == (5, 1, 1, 1, 1)
    assert r[1].analyst_q_words == 132 and r[1].exec_a_words == 136 and abs(r[1].hedge_per_1k - 2 / 136 * 1000) < 1e-9
    assert (r[2].n_turns, r[2].full_text, r[2].has_qa) == (0, "", 0)


def test_text_cleaning(spark):
    rows = [("<p>A&amp;B</p>  see  the 10 stocks.  x",), ("",), (None,), ("REDMOND, Wash. -- October 30, 2024 Sales rose",)]
    got = [r.c for r in spark.createDataFrame(rows, "t string").select(T.clean_transcript(F.col("t")).alias("c")).collect()]
    assert got[:3] == ["A&B x", "", ""] and got[3] == "Sales rose"
    q = "Hello. Questions and Answers: " + "x" * 250
    s = spark.createDataFrame([(q,), (q[:-1],), (None,)], "t string").select(T.split_sections(F.col("t")).alias("s")).collect()
    assert s[0].s.prepared == "Hello." and s[1].s.full == q[:-1] and s[2].s.full == ""
    assert spark.createDataFrame([("I think it depends.",)], "t string").select(T.hedges(F.col("t"))).first()[0] == 2


def test_scores(spark):
    ok = '{"guidance_direction": null, "guidance_confidence": 1, "demand_outlook": %s, "margin_outlook": 0, "n_questions_dodged": 1, "tone_numbers_gap": 0, "unexpected_negative": 0, "analyst_pushback": 0}'
    rows = [("so ```json " + ok % "2.5" + " ``` ok",), (ok % "-7",), (ok % "true",), (ok.replace('"margin_outlook": 0, ', "") % "1",), (ok % "null",), ("none",), (None,)]
    got = [r.s and r.s.demand_outlook for r in spark.createDataFrame(rows, "j string").select(incremental.validate_scores(F.col("j")).alias("s")).collect()]
    assert got == [2, -2, None, None, None, None, None]


def test_fiscal_rules_wrap(spark):
    rules = spark.createDataFrame([("a", 11, 1, "q3", 1, 1)], "ticker string, month_start int, month_end int, quarter string, year_offset int, rule_order int")
    df = spark.createDataFrame([("a", dt.date(2024, 12, 5)), ("a", dt.date(2025, 1, 5)), ("a", dt.date(2025, 5, 5))], "ticker string, d date")
    got = {(r.d.month, r.quarter, r.year) for r in incremental.fiscal_quarter(df, "d", rules).collect()}
    assert got == {(12, "q3", 2025), (1, "q3", 2026), (5, None, None)}


def test_upsert_keeps_one_row(spark):
    a = spark.createDataFrame([(1, 1, "x")], "k int, t int, a string")
    b = spark.createDataFrame([(1, 2, "y"), (2, 1, "z")], "k int, t int, b string")
    assert {(r.k, r.t, r.a, r.b) for r in incremental.upsert(a, b, ["k"], "t").collect()} == {(1, 2, None, "y"), (2, 1, None, "z")}


def test_plans_have_no_cartesian_join(spark, sf_dir):
    from tidemark.plans.market import QUERIES

    for q in ("asof_nearest_30d", "asof_legacy_nearest", "asof_backward_10d"):
        plan = QUERIES[q](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_complete_counts_over_several_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(TS(k % 2), "x", 1.0) for k in range(20)], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    s = jobs.read_table(spark, str(tmp_path), "events", files_per_batch=1)
    got = jobs.run_once(jobs.windowed_counts(s, "ts", "event_type", "1 day", "1 day"), mode="complete")
    assert sorted((r.window.start, r.n, r.value) for r in got.collect()) == [(TS(0), 30, 30.0), (TS(1), 30, 30.0)]


def test_search_tries_the_grid_before_the_predicted_folds(spark):
    rnd = random.Random(1)
    data = [(D(i), x, x + rnd.gauss(0, 0.1)) for i in range(40) for x in [rnd.gauss(0, 1)]]
    tried = []

    def make(alpha):
        tried.append(alpha)
        return L.ridge(alpha)

    best = []
    for sign in (1, -1):  # labels of the predicted folds do not count
        rows = [(d, x, y if d < D(16) else sign * 9 * y) for d, x, y in data]
        df = L.date_folds(spark.createDataFrame(rows, "date date, x double, y double"), "date", 3)
        best.append(L.search(df, ["x"], "y", {"alpha": [500.0, 5.0, 0.5]}, make, 30))
    assert tried == [500.0, 5.0, 0.5] * 2
    assert best[0] == best[1] and best[0][0] == {"alpha": 0.5}


def test_boosting_has_all_rounds(spark):
    for m in (L.boosted()(9, 1.0), L.boosted(classify=True)(9, 1.0)):
        assert (m.getMaxIter(), m.getStepSize()) == (300, 0.05)
    assert L.boosted(maxIter=7)(9, 1.0).getMaxIter() == 7
