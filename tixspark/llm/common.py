"""Helpers shared by the corpus operators: staging, checked broadcasts, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged as staged

#: Rows of one or two small columns that may be broadcast (tens of MB); larger sides are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: White space of the corpus contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged before) with a broadcast hint if it has at most ``limit`` rows, else ``df``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path of ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def running_start(df: DataFrame, key: str, value: str, order: list[str], out: str, seed: int = 0) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``key`` that come before.

    Rows of a key are ordered by a hash of ``order`` (a pseudorandom order that agrees between
    runs), then by ``order``. A key may hold any share of the rows: they are dealt over 65,536
    cells, cells are added up in two levels of at most 256 rows, and only the rows of one cell
    are ordered in one task. ``key`` must not be null.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(65536))
    df = df.withColumn("_c1", F.shiftright(h, 8).cast("int")).withColumn("_c2", h.bitwiseAND(F.lit(255)).cast("int"))
    cells = df.groupBy(key, "_c1", "_c2").agg(F.sum(value).alias("_v"))
    tops = cells.groupBy(key, "_c1").agg(F.sum("_v").alias("_t"))
    w1 = Window.partitionBy(key).orderBy("_c1").rowsBetween(Window.unboundedPreceding, -1)
    w2 = Window.partitionBy(key, "_c1").orderBy("_c2").rowsBetween(Window.unboundedPreceding, -1)
    w3 = Window.partitionBy(key, "_c1", "_c2").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = tops.select(key, "_c1", F.coalesce(F.sum("_t").over(w1), zero).alias("_o1"))
    cells = cells.join(tops, [key, "_c1"]).select(
        key, "_c1", "_c2", (F.col("_o1") + F.coalesce(F.sum("_v").over(w2), zero)).alias("_o2")
    )
    return (
        df.withColumn("_o3", F.coalesce(F.sum(value).over(w3), zero))
        .join(cells, [key, "_c1", "_c2"])
        .withColumn(out, F.col("_o2") + F.col("_o3"))
        .drop("_c1", "_c2", "_o2", "_o3")
    )


#: A key is hot if it holds more than a share of one in HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1024


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (staged before; one row per ``key``, ``count`` is the number of its rows).

    Rows of hot keys meet a broadcast of fewer than HOT_SHARE rows, all others are shuffled, so
    no key fills a task. ``count`` is not in the result.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(side.where(F.col(count) * HOT_SHARE > total))
    cold = side.where(F.col(count) * HOT_SHARE <= total)
    few = rows.join(hot, key)
    many = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return few.unionByName(many).drop(count)
