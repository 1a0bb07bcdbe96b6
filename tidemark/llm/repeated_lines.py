"""Lines repeated across one source's documents.

Per source, mergeable heavy-hitter summaries (frequent-items sketches, kept inside the JVM) name candidate lines, an
exact second pass counts them, and the confirmed lines, few per source, are taken out of each document.

Two lines are the same when equal in :func:`line_form`. Lines are carried as two 64-bit hashes of that form.

Defined results: documents with a NULL source take no part; a NULL or empty text has no lines; empty lines never
count; a line counts once per document however often it stands there, and every standing is taken out. Documents are
told apart by their keys, so deliveries must be reduced to one per document before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, store

#: White space other than the line feed.
BLANKS = r"[\t\x0B\f\r\x1C-\x1F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
NAME_MARK, DIGIT_MARK = "\u0001", "\u0002"
#: Items a sketch tracks; its hash map has the next power of two of 4/3 of that, and an error of 3.5 / map size.
TRACKED = 12288
MAP_SIZE = 16384
#: Error allowed to a sketch, as a part of the documents a line must stand in, when sketches are planned; half of the bound.
PLANNED = 0.25
#: Buckets of a source's set of confirmed lines, so that a line is looked up among few.
BUCKETS = 256
MIN_DOCS = 3
MIN_SHARE = 0.05


def text_form(text: Column, own_name: Column | None) -> Column:
    """The whole text with each line in the form in which lines are compared, still to be split and trimmed."""
    t = F.lower(text)
    if own_name is not None:
        name = F.lower(F.trim(own_name))
        t = F.when(F.length(name) > 0, F.replace(t, name, F.lit(NAME_MARK))).otherwise(t)
    t = F.regexp_replace(t, "[0-9]+", DIGIT_MARK)
    return F.regexp_replace(t, BLANKS, " ")


def hashed_lines(text: Column, own_name: Column | None) -> Column:
    """array<struct<line_no, h, g>> of the non-empty lines; ``line_no`` counts from 1 over the split at line feeds."""
    lines = F.transform(F.split(text_form(text, own_name), "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(x).alias("f")))
    full = F.filter(lines, lambda x: F.length(x["f"]) > 0)
    return F.transform(full, lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["f"]).alias("h"), F.xxhash64(F.lit(1), x["f"]).alias("g")))


def line_sets(docs: DataFrame, keys: list[str], source: str, text: str, own_name: str | None = None, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, tracked: int = TRACKED, map_size: int = MAP_SIZE) -> tuple[DataFrame, Stored]:
    """All lines of candidates (keys, ``src``, ``h``, ``g``, ``line_no``), and the confirmed (``src``, ``h``, ``g``).

    A source's lines are split by hash over as many sketches as its (document, line) pairs need: a sketch that has met
    ``p`` pairs names every line that stands in more than ``2 * 3.5 / map_size * p`` documents, and ``p`` is planned at
    half of what may be. Should hashes still fall so unevenly that a sketch is beyond the bound, which the second count
    of pairs shows, all lines of that one sketch are candidates: the exact count then decides as it does for the others.
    """
    name = F.col(own_name) if own_name else None
    rows = docs.filter(F.col(source).isNotNull()).select(*keys, F.col(source).alias("src"), hashed_lines(F.col(text), name).alias("_lines"))
    kept = store(rows, "lines").df

    size = kept.groupBy("src").agg(F.count("*").alias("docs"), F.sum(F.coalesce(F.size(F.array_distinct("_lines.h")), F.lit(0))).alias("pairs"))
    least = F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * F.lit(min_share) - 1e-9)).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil(3.5 / map_size * F.col("pairs") / (PLANNED * F.col("least")))).cast("bigint")
    sources = store(size.withColumn("least", least).withColumn("parts", parts), "sources")

    items = kept.select("src", F.explode(F.array_distinct("_lines.h")).alias("h")).join(sources.hinted().select("src", "parts", "least"), "src")
    part = F.pmod(F.xxhash64(F.lit(2), "h"), F.col("parts")).alias("part")
    sketch = items.groupBy("src", part).agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"), F.count("*").alias("met"), F.first("least").alias("least"))
    sketch = store(sketch.withColumn("sure", 7.0 / map_size * F.col("met") < F.col("least")), "sketches").df
    top = sketch.filter("sure").select("src", "least", F.explode(F.expr(f"approx_top_k_estimate(s, {tracked})")).alias("x"))
    cand = store(top.filter("x.count >= least").select("src", F.col("x.item").alias("h"), F.lit(True).alias("_cand")), "candidates")
    unsure = store(sketch.filter("not sure").select("src", "part", F.lit(True).alias("_all")), "unsure")

    pairs = kept.select(*keys, "src", F.explode("_lines").alias("l")).select(*keys, "src", "l.line_no", "l.h", "l.g")
    pairs = pairs.join(sources.hinted().select("src", "parts", "least"), "src").withColumn("part", part)
    pairs = pairs.join(cand.hinted(), ["src", "h"], "left").join(unsure.hinted(), ["src", "part"], "left").filter("_cand or _all")
    pairs = store(pairs.select(*keys, "src", "h", "g", "line_no", "least"), "counted").df
    once = pairs.select(*keys, "src", "h", "g", "least").distinct()
    sure = once.groupBy("src", "h", "g").agg(F.count("*").alias("n"), F.first("least").alias("least")).filter("n >= least")
    return pairs.drop("least"), store(sure.select("src", "h", "g", "n"), "confirmed")


def repeated_lines(docs: DataFrame, keys: list[str], source: str, text: str, own_name: str | None = None, **how) -> DataFrame:
    """Keys and ``line_no`` of each line standing in at least ``min_docs`` documents and ``min_share`` of its source."""
    pairs, sure = line_sets(docs, keys, source, text, own_name, **how)
    return pairs.join(sure.hinted(), ["src", "h", "g"], "left_semi").select(*keys, "line_no")


def without_lines(docs: DataFrame, sure: Stored, source: str, text: str, own_name: str | None = None, out: str = "kept_text") -> DataFrame:
    """``docs`` with ``out``, the text without the confirmed lines of its source, and ``n_removed``.

    A source has at most its mean number of lines over ``min_share`` confirmed ones. While the sets of all sources are
    small they go to the documents as one hash table a source, broadcast. Beyond that, documents meet nothing by their
    source, which a few may share: each line asks for its own (source, hash) and the answers go back to the document by
    its place in the input.
    """
    name = F.col(own_name) if own_name else None
    forms = lambda: F.split(text_form(F.col(text), name), "\n", -1)
    two = lambda f: F.struct(F.xxhash64(f).alias("h"), F.xxhash64(F.lit(1), f).alias("g"))
    if sure.small():
        bucket = F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int")
        per = sure.df.groupBy(F.col("src").alias("_src"), bucket.alias("_b")).agg(F.collect_list(F.struct("h", "g")).alias("_l"))
        table = per.groupBy("_src").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_l"))).alias("_m"))
        table = table.select("_src", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.try_element_at("_m", i)).alias("_drop"))
        both = docs.join(F.broadcast(table), docs[source] == F.col("_src"), "left")
        lines = F.arrays_zip(F.split(text, "\n", -1).alias("raw"), forms().alias("form"))
        known = lambda f: F.transform(F.array(two(f)), lambda k: F.array_contains(F.get("_drop", F.pmod(k["h"], F.lit(BUCKETS)).cast("int")), k))[0]
        hit = lambda x: (F.length(F.trim(x["form"])) > 0) & F.coalesce(known(F.trim(x["form"])), F.lit(False))
        left = F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~hit(x)))
    else:
        docs = store(docs.withColumn("_id", F.monotonically_increasing_id()), "documents").df
        asked = docs.filter(F.col(source).isNotNull()).select("_id", F.col(source).alias("src"), F.posexplode(forms()).alias("_i", "_f")).select("_id", "src", "_i", F.trim("_f").alias("_f")).filter("_f <> ''")
        asked = asked.select("_id", "src", "_i", two(F.col("_f")).alias("k")).select("_id", "src", "_i", "k.*")
        gone = asked.join(sure.df.select("src", "h", "g"), ["src", "h", "g"], "left_semi").groupBy("_id").agg(F.collect_set("_i").alias("_gone"))
        both = docs.join(gone, "_id", "left").drop("_id")
        lines = F.arrays_zip(F.split(text, "\n", -1).alias("raw"))
        left = F.when(F.col("_gone").isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)))
    both = both.withColumn("_left", F.transform(left, lambda x: x["raw"]))
    both = both.withColumn(out, F.array_join("_left", "\n")).withColumn("n_removed", F.size(F.split(text, "\n", -1)) - F.size("_left"))
    return both.drop("_left", "_drop", "_src", "_gone")
