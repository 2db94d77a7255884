"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, measure

HOT_ROWS = 1_000_000  # a key with more rows than this is spread over several join keys
MAX_HOT_KEYS = 1_000_000  # the limit above rises where needed, so that never more keys than this are hot
SALT = "_salt"


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None = None, rows: int | None = None
) -> DataFrame | None:
    """``(keys, _salts)`` for the keys with more than ``hot_rows`` rows, or None if there are none.

    ``rows`` is an upper bound of the row count if the caller knows one: a frame that is small as a whole has no hot
    key and needs no counting. The result has at most ``MAX_HOT_KEYS`` rows whatever the data, so it may be broadcast.
    """
    limit = hot_rows or HOT_ROWS
    if rows is not None and rows <= limit:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = measure(counts, rows=F.coalesce(F.sum("_n"), F.lit(0)), top=F.max("_n"))
    limit = max(limit, totals["rows"] // MAX_HOT_KEYS)
    if totals["top"] is None or totals["top"] <= limit:
        return None
    salts = F.ceil(F.col("_n") / limit).cast("int").alias("_salts")
    return checkpointed(counts.filter(F.col("_n") > limit).select(*keys, salts))


def salted(df: DataFrame, keys: Sequence[str], hot: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Add ``_salt``: rows of a hot key are spread by a hash of ``by`` (default: their other columns), so a retried
    task gives a row the same salt."""
    other = by or [name for name in df.columns if name not in keys]
    spread = F.pmod(F.xxhash64(*other), F.coalesce("_salts", F.lit(1))).cast("int")
    return df.join(F.broadcast(hot), list(keys), "left").withColumn(SALT, spread).drop("_salts")


def repeated(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: one copy of each row per salt of its key."""
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    joined = df.join(F.broadcast(hot), list(keys), "left")
    return joined.withColumn(SALT, F.explode(salts)).drop("_salts")


def join_spread(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join in which ``many`` may hold any number of rows per key and ``one`` has few.

    ``how`` is inner, left, left_semi or left_anti. See ``hot_keys`` for ``rows`` and ``hot_rows``.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, hot_rows, rows)
    if hot is None:
        return many.join(one, keys, how)
    return salted(many, keys, hot).join(repeated(one, keys, hot), [*keys, SALT], how).drop(SALT)


def join_spread_both(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Inner join in which both sides may hold any number of rows per key.

    Hot keys of ``left`` are spread over salts and those rows of ``right`` repeated, then the same the other way round.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, hot_rows)
    if hot is None:
        return join_spread(right, left, keys, hot_rows=hot_rows)
    left = salted(left, keys, hot).withColumnRenamed(SALT, "_left_salt")
    right = repeated(right, keys, hot).withColumnRenamed(SALT, "_left_salt")
    return join_spread(right, left, [*keys, "_left_salt"], hot_rows=hot_rows).drop("_left_salt")
