"""Registry of this folder's queries and small helpers its operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL for the same rows where there is some."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark a join side for broadcast if it has at most ``most_rows`` rows; a larger one is left to a shuffle join.

    The count stops after ``most_rows`` + 1 rows. Give a written table, or the side is computed twice.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def boxed(df: DataFrame, *more: Column | str) -> DataFrame:
    """Whole rows as one column ``_row`` beside the given ones, so that no name of theirs meets a name used on the way."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *more)


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
