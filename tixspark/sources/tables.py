"""Readers for the driver's parquet tables.

Every reader is a plain ``spark.read.parquet`` so Catalyst prunes columns and pushes
filters into the scan. Nothing is cached here; callers persist what they fan out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_rows(df: DataFrame) -> DataFrame:
    """``df`` dealt over ``spark.tixspark.text.partitions`` partitions where the session sets it.

    Text rules cost CPU per row. The scan's splits decide how many tasks run them unless the
    session asks for a number itself (local sessions do, their tables being one row group).
    """
    n = df.sparkSession.conf.get("spark.tixspark.text.partitions", None)
    return df.repartition(int(n)) if n else df


def padded(number: Column, width: int) -> Column:
    """``number`` with leading zeros up to ``width``; longer numbers keep all digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def padded_sql(number: str, width: int) -> str:
    text = f"cast({number} as varchar)"
    return f"lpad({text}, cast(greatest({width}, length({text})) as integer), '0')"


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    return F.substring(text, F.length(first_line(text)) + 2, F.length(text))


FIRST_LINE_SQL = "split_part(text, chr(10), 1)"
AFTER_FIRST_LINE_SQL = f"substring(text, length({FIRST_LINE_SQL}) + 2)"
