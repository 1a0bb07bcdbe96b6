"""Domain tables with their keys in one form: tickers upper case, quarters and periods lower case, blanks off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_DATE = "9999-12-31"


def ticker(c: str | Column = "ticker") -> Column:
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def lowered(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def number(c: str | Column) -> Column:
    """NaN as NULL; every missing number is NULL from here on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def eps(c: str | Column) -> Column:
    """Per-share values at 4 decimals, without a sign on zero, so that float noise does not tell them apart."""
    return F.round(number(c), 4) + F.lit(0.0)


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls_key() -> dict[str, Column]:
    return {"ticker": ticker(), "quarter": lowered("quarter"), "year": F.col("year").cast("int")}
