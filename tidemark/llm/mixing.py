"""Records of several sources mixed to target shares of the total size.

Each source gets an expected number of copies per document such that its expected size is its share of the total, but
at most its cap. Copies are drawn by systematic sampling: expected copies are summed along the source's documents, one
offset is added, and a document is emitted once per integer that its stretch of the sum crosses.

The running sum is made in two levels, over many small chunks of a source and then over the chunks' sums, so a source
with most of the rows is still spread over all tasks.

Defined results: texts without tokens (NULL, empty) are never emitted. Targets without documents, with a missing or
non-positive weight or a missing or non-positive cap get nothing and the other weights are scaled up; sources without
a target get nothing. Without ``total``, the total is the size of all documents of the sources that take part, so that
one source that is too small for its share does not shrink the rest: it gives all that its cap allows, the others their
shares of the total, and the mix is smaller by what is lacking. :func:`exact_total` is the largest total at which no cap
binds and all shares are met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Stored, store

#: Documents of a chunk, about; a source's prefix sum is made within its chunks and over them.
CHUNK_DOCS = 20_000
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A long text is counted in parts of about so many characters, cut before a blank that follows a letter or digit.
PART = 1 << 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer files lie; another folder may be given to :func:`token_count` itself."""
    return import_module("public_tokenizers").path(name)


_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def token_count(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of ``text`` by a byte-level vocabulary file that every worker can read; NULL for NULL."""
    path = path or vocabulary_path()
    pattern = pattern or import_module("public_tokenizers").PATTERN

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path, pattern)
        for texts in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64", index=texts.index)

    return F.pandas_udf(count, "bigint")(text)


def _taking_part(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with documents and a target: docs, tokens, target_share (scaled), max_repeats."""
    t = targets.groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("t")).select("source", "t.*")
    t = t.filter((F.col("target_weight") > 0) & ~F.isnan("target_weight") & (F.col("max_repeats") > 0))
    have = sizes.filter("n_tokens > 0").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    both = t.join(have, "source")
    return both.withColumn("target_share", F.col("target_weight") / F.sum("target_weight").over(W.partitionBy()))  # one row per target


def exact_total(sizes: DataFrame, targets: DataFrame) -> float | None:
    """The largest total in tokens at which no cap binds; None where no source takes part."""
    return _taking_part(sizes, targets).agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).first()[0]


def mix_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source: docs, tokens, target_share (scaled), max_repeats, ``copies`` expected per document."""
    both = _taking_part(sizes, targets)
    goal = F.lit(float(total)) if total is not None else F.sum("tokens").over(W.partitionBy()).cast("double")  # one row per target
    copies = F.least(F.col("target_share") * goal / F.col("tokens"), F.col("max_repeats").cast("double"))
    return both.select("source", "docs", "tokens", "target_share", "max_repeats", copies.alias("copies"))


def mix(sizes: DataFrame, plan: Stored, doc_id: str, seed: int = 0, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """One row per emitted copy: ``doc_id``, source, n_tokens, ``copy_no`` from 1.

    Within a chunk documents go by size, so that the systematic sample takes all sizes evenly. A source has as many
    chunks as hold about ``chunk_docs`` documents each, so no task's part grows with the source.
    """
    p = plan.df.select("source", "copies", F.ceil(F.col("docs") / chunk_docs).alias("_chunks"))
    rows = sizes.select(doc_id, "source", "n_tokens").filter("n_tokens > 0").join(F.broadcast(p) if plan.small() else p, "source")
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed), doc_id), F.col("_chunks")))
    number = F.row_number().over(W.partitionBy("source", "_chunk").orderBy("n_tokens", doc_id))
    count = rows.groupBy("source", "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = count.select("source", "_chunk", before.alias("_before"))  # a row per chunk
    rows = rows.withColumn("_k", number).join(base, ["source", "_chunk"])
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.lit(1 << 30)) / float(1 << 30)
    upto = lambda k: F.floor(k * F.col("copies") + offset)
    place = F.col("_before") + F.col("_k")
    n = F.least(upto(place) - upto(place - 1), F.ceil("copies"))
    emitted = rows.withColumn("_copies", n).filter("_copies > 0")
    return emitted.select(doc_id, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy_no"))


def mix_report(mixed: DataFrame, plan: Stored, doc_id: str) -> DataFrame:
    """Per source of the plan: what was asked for and what was reached."""
    got = mixed.groupBy("source").agg(F.count("*").alias("copies_used"), F.countDistinct(doc_id).alias("docs_used"), F.sum("n_tokens").alias("tokens_used"), F.max("copy_no").alias("most_repeats"))
    zero = {c: 0 for c in ("copies_used", "docs_used", "tokens_used", "most_repeats")}
    both = plan.df.join(got, "source", "left").fillna(zero)
    return both.withColumn("actual_share", F.try_divide("tokens_used", F.sum("tokens_used").over(W.partitionBy())))
