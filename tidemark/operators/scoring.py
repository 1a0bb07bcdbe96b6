"""Texts scored by an outside model: prompt, answer, one retry, a limit on the rate, and what a run would cost.

The provider is the caller's: a function that is called once per worker and returns a function from prompt to answer.
No network is touched here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pack_sentences, truncate_words
from ..runtime import store
from .incremental import SCORE_FIELDS, validate_scores

RETRY = "\n\nReturn ONLY the raw JSON object, nothing else."


def instructions(fields: dict = SCORE_FIELDS) -> str:
    each = "\n".join(f'- "{f}": an integer from {low} to {high}{", or null where the text does not say" if nullable else ""}' for f, (low, high, nullable) in fields.items())
    return f"Score the questions and answers below from the text alone. Answer with one JSON object with all of these fields and nothing else.\n{each}"


def build_prompt(text: Column, most_words: int = 5000, head: str | None = None) -> Column:
    """Instructions, the text cut at ``most_words`` words, and where the answer begins."""
    return F.concat(F.lit((head or instructions()) + "\n\n--- TRANSCRIPT Q&A SECTION ---\n"), truncate_words(text, most_words), F.lit("\n--- END TRANSCRIPT ---\n\nJSON:"))


def _answers(df: DataFrame, keys: list[str], provider: Callable[[], Callable[[str], str]], per_minute: float, most_failures: int) -> DataFrame:
    kinds = dict(df.dtypes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = provider()
        wait, due, failed = 60.0 / per_minute if per_minute > 0 else 0.0, 0.0, 0
        for b in batches:
            out = []
            for p in b["prompt"]:
                if wait:
                    now = time.monotonic()
                    due = max(now, due) + wait
                    time.sleep(max(0.0, due - wait - now))
                try:
                    out.append(complete(p))
                    failed = 0
                except Exception:  # a provider's own errors, of whatever kind
                    out.append(None)
                    failed += 1
                    if failed >= most_failures:
                        raise
            yield b[keys].assign(answer=pd.Series(out, index=b.index, dtype=object))

    return df.select(*keys, "prompt").mapInPandas(ask, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", answer string")


def score_texts(df: DataFrame, keys: list[str], text: str, provider: Callable[[], Callable[[str], str]], workers: int = 4, per_minute: float = 0, most_failures: int = 5, fields: dict = SCORE_FIELDS) -> DataFrame:
    """``keys`` with the fields and ``attempts``; answers that do not hold are asked for once more, then the row has NULLs.

    As many tasks as ``workers`` ask at a time, each at its part of ``per_minute``. A task gives up after
    ``most_failures`` calls in a row have failed, and the job with it; what was checkpointed before stays.
    NULL texts are not asked about.
    """
    src = df.filter(F.col(text).isNotNull()).select(*keys, build_prompt(F.col(text)).alias("prompt")).repartition(workers)
    rate = per_minute / workers
    first = store(_answers(src, keys, provider, rate, most_failures).select(*keys, validate_scores(F.col("answer"), fields).alias("s")), "answers").df
    again = src.join(first.filter("s is null").select(*keys), keys, "left_semi").withColumn("prompt", F.concat("prompt", F.lit(RETRY))).repartition(workers)
    second = _answers(again, keys, provider, rate, most_failures).select(*keys, validate_scores(F.col("answer"), fields).alias("s"), F.lit(2).alias("attempts"))
    return first.filter("s is not null").withColumn("attempts", F.lit(1)).unionByName(second).select(*keys, "s.*", "attempts")


def run_cost(df: DataFrame, prompt: str, per_million_in: float, per_million_out: float, out_tokens: int = 150, chars_per_token: float = 4.0) -> DataFrame:
    """One row: calls, tokens in, and price of a run, before it is made."""
    tokens = F.sum(F.ceil(F.char_length(prompt) / chars_per_token))
    return df.agg(F.count(prompt).alias("calls"), tokens.alias("tokens_in"), ((tokens * per_million_in + F.count(prompt) * out_tokens * per_million_out) / 1e6).alias("cost"))


def mean_probabilities(df: DataFrame, keys: list[str], text: str, model: Callable[[], Callable[[list[str]], object]], labels: tuple[str, ...] = ("positive", "negative", "neutral"), most_words: int = 256, batch: int = 16) -> DataFrame:
    """``keys`` with the mean probability of each label over the chunks of a text, ``label``, ``net`` and ``chunks``.

    ``model`` is set up once per worker and maps a batch of chunks to rows of raw scores, which a softmax makes
    probabilities. Texts without chunks have NULLs, the label neutral and no chunks.
    """
    chunks = df.select(*keys, F.explode(pack_sentences(F.col(text), most_words)).alias("chunk"))

    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model()
        for s in batches:
            out = []
            for i in range(0, len(s), batch):
                x = np.asarray(f(s.iloc[i : i + batch].tolist()), float)
                e = np.exp(x - x.max(axis=1, keepdims=True))
                out.extend((e / e.sum(axis=1, keepdims=True)).tolist())
            yield pd.Series(out, index=s.index, dtype=object)

    p = chunks.select(*keys, F.pandas_udf(infer, "array<double>")("chunk").alias("p"))
    mean = p.groupBy(*keys).agg(*[F.avg(F.col("p")[i]).alias(n) for i, n in enumerate(labels)], F.count("*").alias("chunks"))
    x = df.select(*keys).join(mean, keys, "left").fillna({"chunks": 0})
    return x.withColumn("net", F.col(labels[0]) - F.col(labels[1])).withColumn("label", top_label(labels))


def top_label(labels: tuple[str, ...], default: str = "neutral") -> Column:
    """The label with the greatest value, of equal ones (to 12 decimals) the first; ``default`` without values."""
    at = lambda c: F.round(c, 12)
    label = F.lit(default)
    for n in reversed(labels):
        label = F.when(at(F.col(n)) == at(F.greatest(*labels)), n).otherwise(label)
    return label


def combined(x: DataFrame, keys: list[str], a: str, b: str, labels: tuple[str, ...] = ("positive", "negative", "neutral")) -> DataFrame:
    """Scores of a whole from those of two parts (structs with ``words``, the labels' shares and ``chunks``), weighted by
    words; parts without words or shares count for nothing, and without either the whole has none and is neutral."""
    ok = lambda s: (F.col(s)["words"] > 0) & F.col(s)[labels[0]].isNotNull()
    n = lambda s: F.when(ok(s), F.col(s)["words"]).otherwise(0.0)
    mean = lambda k: F.try_divide(n(a) * F.coalesce(F.col(a)[k], F.lit(0.0)) + n(b) * F.coalesce(F.col(b)[k], F.lit(0.0)), n(a) + n(b))
    count = lambda s: F.when(ok(s), F.coalesce(F.col(s)["chunks"], F.lit(0))).otherwise(0)
    x = x.select(*keys, *[mean(k).alias(k) for k in labels], (count(a) + count(b)).alias("chunks"))
    return x.withColumn("net", F.col(labels[0]) - F.col(labels[1])).withColumn("label", top_label(labels))
