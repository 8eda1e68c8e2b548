"""Tables of a data folder, and the rules for their dirt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def code(c: Column | str) -> Column:
    """A site or source code: lower case, without white space (of any kind) around it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
