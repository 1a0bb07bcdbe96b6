"""Queries over texts, turns and the keyed tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import patterns as P
from ..functions import polarity as V
from ..functions import text as T
from ..operators import incremental as I
from ..operators import relational as L
from ..operators import scoring as SC
from ..operators import turns as U
from ..operators.events import Z_COLS
from ..operators.panel import expanding_z
from ..runtime import latest, latest_files, new_path, spread, store
from ..sources import sinks as K
from ..sources.sinks import sections_of
from ..sources.tables import calls_key, day, lowered, read, ticker
from ..streaming import jobs as S
from .market import events, prices, r6
from .strategy import predictions

CALL = ["ticker", "quarter", "year"]


def calls(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    path = f"{d}/transcripts_text.parquet"
    return spread(latest_files(spark, path, calls_key(), "loaded_at", columns), path)


def meta(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "pub_date", lowered("source").alias("source"), "has_qa", "loaded_at")
    return latest(x, CALL, "loaded_at")


def clean_transcript(spark, d):
    return calls(spark, d, ["full_z"]).select(*CALL, T.clean_transcript(F.col("full_z")).alias("clean"))


def boilerplate_lines(spark, d):
    x = calls(spark, d, ["full_z"]).select(*CALL, F.explode(F.split("full_z", "\n")).alias("line"))
    return x.groupBy(*CALL).agg(F.sum(T.is_boilerplate(F.col("line")).cast("bigint")).alias("n_boilerplate"), F.count("*").alias("n_lines"))


def split_sections(spark, d):
    x = calls(spark, d, ["full_z"]).select(*CALL, T.split_sections(F.col("full_z")).alias("s"))
    return x.select(*CALL, F.length("s.prepared").alias("n_prepared"), F.length("s.qa").alias("n_qa"), F.length("s.full").alias("n_full"))


def _sections(spark, d):
    """The sections of each call in long form, as they would be fetched for scoring."""
    return sections_of(calls(spark, d, ["full_z", "prep_z", "qa_z", "has_qa"]), CALL)


def section_texts(spark, d):
    return _sections(spark, d).select(*CALL, "section", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def cleaned_sections(spark, d):
    x = calls(spark, d, ["full_z"]).select(*CALL, T.clean_and_split(F.col("full_z")).alias("s"))
    return x.select(*CALL, "s.*")


def linguistic_features(spark, d):
    return _sections(spark, d).select(*CALL, "section", T.linguistic(F.col("text")).alias("s")).select(*CALL, "section", "s.*")


def lm_counts(spark, d):
    x = _sections(spark, d).select(*CALL, "section", T.lexicon_counts(F.col("text")).alias("s"))
    return x.select(*CALL, "section", "s.lm_positive", "s.lm_negative", *[r6(F.col("s")[c], c) for c in ("lm_net", "lm_pos_ratio", "lm_neg_ratio")])


def _familiar(spark, d):
    """Words that stand in passages of the first four grades, as a table; a vocabulary."""
    x = read(spark, d, "level_samples").filter("grade <= 4")
    return x.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()


def _lexicons(spark, d):
    valence = spark.createDataFrame(list(P.VALENCE.items()), "word string, valence double")
    sides = spark.createDataFrame([(w, "positive") for w in P.POSITIVE] + [(w, "negative") for w in P.NEGATIVE], "word string, side string")
    return X.Lexicons.of_tables(valence, sides, _familiar(spark, d))


def readability(spark, d):
    x = _sections(spark, d).select(*CALL, "section", T.readability(F.col("text"), _lexicons(spark, d).familiar).alias("s")).select(*CALL, "section", "s.*")
    return x.select(*CALL, "section", *[r6(c) for c in x.columns if c not in (*CALL, "section")])


def plain_features(spark, d):
    """The features of a row that need no polarity, of every section."""
    x = _sections(spark, d).select(*CALL, "section", X.plain_row(F.col("text"), _lexicons(spark, d)).alias("s")).select(*CALL, "section", "s.*")
    return x.select(*CALL, "section", *[r6(F.col(c).cast("double"), c) for c in X.PLAIN])


def sentiment_rows(spark, d):
    """All 34 features of every section."""
    x = X.feature_rows(_sections(spark, d), [*CALL, "section"], "text", _lexicons(spark, d))
    return x.select(*CALL, "section", *[r6(F.col(c).cast("double"), c) for c in X.ALL])


def section_features(spark, d):
    """One wide row per call with the features of its sections beside each other."""
    x = X.section_features(calls(spark, d, ["full_z", "prep_z", "qa_z", "has_qa"]), CALL, _lexicons(spark, d))
    return x.select(*CALL, *[r6(F.col(c).cast("double"), c) for c in x.columns if c not in CALL])


def section_z_scores(spark, d):
    """Features of the whole call and of its questions against those of the ticker's earlier calls."""
    x = section_features(spark, d).join(meta(spark, d).select(*CALL, "pub_date"), CALL)
    cols = [f"{s}_{c}" for s in ("full", "qa") for c in Z_COLS if f"{s}_{c}" in x.columns]
    z = expanding_z(x.select(*CALL, "pub_date", *cols), ["ticker"], ["pub_date", "quarter", "year"], cols)
    return z.select(*CALL, *[r6(f"{c}_z") for c in cols])


def hedge_rate(spark, d):
    x = calls(spark, d, ["qa_z"])
    return x.select(*CALL, F.coalesce(T.hedges(F.col("qa_z")), F.lit(0)).alias("n_hedges"))


def truncated_words(spark, d):
    return calls(spark, d, ["qa_z"]).select(*CALL, T.truncate_words(F.col("qa_z"), 100).alias("text"))


def prompts(spark, d):
    x = calls(spark, d, ["qa_z"]).filter("qa_z is not null")
    return x.select(*CALL, F.md5(SC.build_prompt(F.col("qa_z"), 100, "Score this.")).alias("digest"))


def scored_calls(spark, d):
    """The scoring surface with a provider made of rules: it counts question marks, and answers badly at first when there are many."""

    def provider():
        def complete(prompt: str) -> str:
            n = prompt.split("SECTION ---", 1)[1].count("?")
            body = ", ".join(f'"{f}": {n if f == "n_questions_dodged" else 0}' for f in I.SCORE_FIELDS)
            return "no idea" if n % 3 == 0 and SC.RETRY not in prompt else "Sure: ```json {" + body + "} ```"

        return complete

    return SC.score_texts(calls(spark, d, ["qa_z"]), CALL, "qa_z", provider)


def scoring_cost(spark, d):
    x = calls(spark, d, ["qa_z"]).filter("qa_z is not null").select(SC.build_prompt(F.col("qa_z"), 5000, "Score this.").alias("prompt"))
    return SC.run_cost(x, "prompt", 0.1, 0.4).select("calls", F.col("tokens_in").cast("bigint").alias("tokens_in"), r6("cost"))


def _probabilities(spark, d):
    """Batch inference over chunks with a model made of rules: scores from the counts of good, bad and other words."""

    def model():
        import re as regex

        def run(chunks):
            out = []
            for c in chunks:
                w = regex.findall(r"[a-z']+", c.lower())
                good, bad = sum(x in P.POSITIVE for x in w), sum(x in P.NEGATIVE for x in w)
                out.append((good / 4, bad / 4, 1.0))
            return out

        return run

    return SC.mean_probabilities(_sections(spark, d), [*CALL, "section"], "text", model)


def chunk_probabilities(spark, d):
    x = _probabilities(spark, d)
    return x.select(*CALL, "section", "chunks", "label", *[r6(c) for c in ("positive", "negative", "neutral", "net")])


def sentence_groups(spark, d):
    x = _sections(spark, d).select(*CALL, "section", F.posexplode(T.sentence_groups(F.col("text"))).alias("i", "chunk"))
    return x.select(*CALL, "section", "i", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def packed_sentences(spark, d):
    return _sections(spark, d).select(*CALL, "section", F.posexplode(T.pack_sentences(F.col("text"))).alias("i", "chunk")).select(*CALL, "section", "i", F.size(T.words(F.col("chunk"))).alias("n_words"), F.md5("chunk").alias("digest"))


def tone_features(spark, d):
    return _sections(spark, d).select(*CALL, "section", V.polarity(F.col("text"), P.VALENCE).alias("v")).select(*CALL, "section", *[r6(F.col("v")[k], k) for k in V.KEYS])


def tone_combined(spark, d):
    """The whole call's shares from those of its two sections."""
    p = _probabilities(spark, d).filter("section <> 'full'").select(*CALL, "section", F.struct("positive", "negative", "neutral", "chunks").alias("p"))
    n = _sections(spark, d).select(*CALL, "section", F.size(T.words(F.col("text"))).cast("double").alias("words"))
    part = lambda s: F.max(F.when(F.col("section") == s, F.struct("words", "p.positive", "p.negative", "p.neutral", "p.chunks")))
    x = p.join(n, [*CALL, "section"]).groupBy(*CALL).agg(part("prepared_remarks").alias("a"), part("qa").alias("b"))
    return SC.combined(x, CALL, "a", "b").select(*CALL, "chunks", "label", *[r6(c) for c in ("positive", "negative", "neutral", "net")])


def _turns(spark, d):
    x = calls(spark, d, ["prep_z", "qa_z"])
    return x.select(*CALL, F.concat(U.turns_of_lines(F.col("prep_z")), U.turns_of_lines(F.col("qa_z"))).alias("turns"))


def speaker_turns(spark, d):
    x = _turns(spark, d).select(*CALL, F.explode("turns").alias("t"))
    k = U.name_key(F.col("t.speaker"))
    return x.groupBy(*CALL).agg(F.count("*").alias("n_turns"), F.countDistinct(F.when(k != "", k)).alias("n_speakers"), F.sum(U.is_moderator(F.col("t.speaker")).cast("bigint")).alias("n_moderator"))


def split_turns(spark, d):
    x = U.split_turns(_turns(spark, d), CALL)
    return x.withColumn("answer_question_ratio", r6("answer_question_ratio")).withColumn("hedge_per_1k", r6("hedge_per_1k"))


def parsed_props(spark, d):
    x = read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return x.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"))


def validated_scores(spark, d):
    """Scores of the event properties: all fields from one number, as a stored answer would hold them."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    fields = ", ".join(f'"{f}": %s' for f in I.SCORE_FIELDS)
    x = read(spark, d, "events").select("event_id", F.format_string("Here you are: ```json {" + fields + "} ```", *[k - i for i in range(len(I.SCORE_FIELDS))]).alias("j"))
    return x.select("event_id", I.validate_scores(F.col("j")).alias("s")).select("event_id", "s.*")


def upsert_latest(spark, d):
    x = read(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "pub_date", "n_turns", "loaded_at")
    cut = F.lit("2024-01-01").cast("timestamp")
    out = I.upsert(x.filter(F.col("loaded_at") < cut), x.filter(F.col("loaded_at") >= cut), CALL, "loaded_at")
    return out.select(*CALL, F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"))


def resume_antijoin(spark, d):
    done = read(spark, d, "sentiment_features").select(*[e.alias(k) for k, e in calls_key().items()])
    return I.todo(meta(spark, d).select(*CALL), done, CALL)


def incremental_cutoff(spark, d):
    have = predictions(spark, d).select("ticker", F.col("date").alias("pub_date"))
    return I.after_cutoff(meta(spark, d).filter("pub_date is not null"), have, "ticker", "pub_date").select(*CALL, day("pub_date").alias("pub_date"))


def snapshot_counts(spark, d):
    x = read(spark, d, "analyst_snapshot").select("snap_date", ticker().alias("ticker")).distinct()
    return x.groupBy(day("snap_date").alias("snap_date")).agg(F.count("*").alias("n"))


def pilot_sample(spark, d):
    t = meta(spark, d).select("ticker").distinct().withColumn("sector", F.concat(F.lit("S"), (F.ascii(F.substring("ticker", 1, 1)) % 4).cast("string")))
    return I.stratified_sample(t, "ticker", "sector", 10)


def fiscal_quarter(spark, d):
    rules = [(12, 2, "q4", 1, 1), (3, 5, "q1", 0, 2), (6, 8, "q2", 0, 3), (9, 11, "q3", 0, 4), (1, 12, "q9", 9, 5)]  # the first wraps, the last never comes first
    base = spark.createDataFrame(rules, "month_start int, month_end int, quarter string, year_offset int, rule_order int")
    e = events(spark, d).select("ticker", "earnings_date")
    rules = e.select("ticker").distinct().join(F.broadcast(base))  # five rules a ticker
    return I.fiscal_quarter(e, "earnings_date", rules).select("ticker", day("earnings_date").alias("earnings_date"), "quarter", "year")


def filing_window(spark, d):
    x = I.first_in_window(events(spark, d).select("ticker", "earnings_date"), "earnings_date", prices(spark, d), "date", "ticker", 1, 3, "first_date")
    return x.select("ticker", day("earnings_date").alias("earnings_date"), day("first_date").alias("first_date"))


def stream_snapshot_dedup(spark, d):
    s = S.read_table(spark, d, "analyst_snapshot").select("snap_date", ticker().alias("ticker"), F.col("snap_date").alias("t"))
    x = S.run_once(S.dedup(s, ["snap_date", "ticker"], "t", "10000 days"), ["snap_date", "ticker"])
    return x.select(day("snap_date").alias("snap_date"), "ticker")


def stream_event_counts(spark, d):
    s = S.read_table(spark, d, "events").select("ts", "event_type", "value")
    x = S.run_once(S.windowed_counts(s, "ts", "event_type", "1 day", "1 day"), mode="complete")
    return x.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6("value"))


def filing_exhibit(spark, d):
    """Filings made of the price days: of each, two exhibits, of which every third filing numbers the second one 99."""
    p = prices(spark, d).filter("close is not null").select("ticker", F.col("date").alias("filed"), (F.dayofmonth("date") % 3 == 0).alias("late"))
    each = F.array(*[F.struct(F.lit(i).alias("seq"), F.when((F.lit(i) == 2) & F.col("late"), f"Exhibit {98 + i - 1}").otherwise(f"Annex {i}").alias("description"), F.lit("8-K").alias("kind"), F.concat_ws("/", "ticker", F.col("filed").cast("string"), F.lit(str(i))).alias("url")) for i in (1, 2)])
    f = p.select("ticker", "filed", F.explode(each).alias("x")).select("ticker", "filed", "x.*")
    out = K.nearest_filing(events(spark, d).select("ticker", "earnings_date"), "earnings_date", f, "ticker")
    return out.select("ticker", day("earnings_date").alias("earnings_date"), "url", "description")


def new_calls(spark, d):
    """Listed calls that are neither held nor older than what is held of their ticker; every other call is held."""
    m = meta(spark, d).filter("pub_date is not null").select(*CALL, "pub_date")
    held = m.filter(F.col("year") <= 2023)
    return K.new_records(m, held, CALL, "ticker", "pub_date").select(*CALL, day("pub_date").alias("pub_date"))


def stored_calls(spark, d):
    """Calls split into turns and built into rows of the calls table, written in place of a table and read back."""
    m = meta(spark, d).select(*CALL, "pub_date", "source")
    path = new_path(spark, "calls")
    t = _turns(spark, d).join(calls(spark, d, ["full_z"]), CALL)
    K.replace_table(K.call_row(U.call_sections(t, CALL, "turns", "full_z").join(m, CALL)), path)
    x = K.require_rows(K.read_or_empty(spark, path, "ticker string"), "the calls table")
    return x.select(*CALL, "has_qa", "n_turns", "n_words_full", "answer_question_ratio", "hedge_per_1k")


def resumed_scores(spark, d):
    """Half of the calls are scored and kept, then all are asked for; the second run scores only the other half."""
    path = new_path(spark, "scores")
    m = meta(spark, d).select(*CALL, "has_qa")
    score = lambda x: x.withColumn("score", F.col("has_qa") * 2)
    schema = "ticker string, quarter string, year int, has_qa int, score int"
    half = m.filter(F.col("year") % 2 == 0)
    K.resume(half, path, CALL, score, schema)
    out, fresh = K.resume(m, path, CALL, score, schema)
    return out.select(*CALL, "score", F.lit(fresh).cast("bigint").alias("fresh"))


def recorded_snapshots(spark, d):
    """Snapshots recorded in two runs that overlap, partitioned by day; each key once per day."""
    path = new_path(spark, "snapshots")
    s = read(spark, d, "analyst_snapshot").select("snap_date", ticker().alias("ticker"))
    schema = "ticker string, snap_date date"
    K.record_snapshot(s.filter(F.col("snap_date") < "2024-06-01"), path, ["ticker"], "snap_date", schema)
    K.record_snapshot(s, path, ["ticker"], "snap_date", schema)
    return K.read_or_empty(spark, path, schema).select(day("snap_date").alias("snap_date"), "ticker")


def missing_table(spark, d):
    """A table that is not there reads as one without rows."""
    return K.read_or_empty(spark, f"{d}/no_such_table.parquet", "ticker string, n int").agg(F.count("*").alias("n"))


def core_universe(spark, d):
    return K.universe(spark, f"{d}/transcripts_text.parquet", ["AAA", "BMKIDX"])


def unpivoted_prices(spark, d):
    x = read(spark, d, "vix").groupBy("date").agg(F.max(L.as_number("vix_close")).alias("Close"), F.count("*").cast("double").alias("Rows"))
    return L.long_table(x.withColumn("date", day("date")), ["date"], {"Close": "close", "Rows": "rows"}, "field", "value")


def stream_upsert(spark, d):
    """Calls upserted by a stream: of each key the latest delivery, whichever batch it came in."""
    s = S.read_table(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "n_turns", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    return S.upsert_once(s, CALL, "loaded_at").select(*CALL, F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"))


def stream_water_mark(spark, d):
    have = store(predictions(spark, d).select("ticker", F.col("date").alias("pub_date")), "held").df
    s = S.read_table(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "pub_date").filter("pub_date is not null")
    return S.run_once(S.above_water_mark(s, have, "ticker", "pub_date")).distinct().select(*CALL, day("pub_date").alias("pub_date"))


QUERIES = {f.__name__: f for f in (clean_transcript, boilerplate_lines, split_sections, section_texts, cleaned_sections, linguistic_features, lm_counts, readability, plain_features, sentiment_rows, section_features, section_z_scores, hedge_rate, truncated_words, prompts, scored_calls, scoring_cost, chunk_probabilities, sentence_groups, packed_sentences, tone_features, tone_combined, speaker_turns, split_turns, parsed_props, validated_scores, upsert_latest, resume_antijoin, incremental_cutoff, snapshot_counts, pilot_sample, fiscal_quarter, filing_window, filing_exhibit, new_calls, stored_calls, resumed_scores, recorded_snapshots, missing_table, core_universe, unpivoted_prices, stream_snapshot_dedup, stream_event_counts, stream_upsert, stream_water_mark)}
