"""Deterministic samples: the same rows at any partitioning, by hash keys instead of random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(column: str, seed: int) -> Column:
    """Order of a sample: ``md5('<seed>:<id>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def uniform(rows: DataFrame, n: int, seed: int = 0, column: str = "global_id") -> DataFrame:
    """n rows without replacement (all, if there are fewer), in order of their id."""
    return rows.withColumn("_k", key(column, seed)).orderBy("_k", column).limit(n).drop("_k").orderBy(column)


def stratified(rows: DataFrame, target: int, strata: list[str], seed: int = 0, column: str = "global_id") -> DataFrame:
    """The ``max(1, target // strata)`` rows of lowest key in each stratum; small strata give what they have.

    The number of strata comes first (a count of distinct values); the rank filter is a literal, so
    each map task already keeps only a stratum's best (``WindowGroupLimit``) and a stratum that holds a
    third of all rows shuffles ``per`` rows per task.
    """
    n = rows.select(*strata).distinct().count()
    per = max(1, target // n) if n else 1
    w = Window.partitionBy(*strata).orderBy(key(column, seed), column)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")


def check(sample: DataFrame, again: DataFrame, column: str = "global_id") -> DataFrame:
    """One row: is the sample the same twice, and without repeats?"""
    a, b = sample.select(column), again.select(column)
    n = a.agg(F.count("*").alias("n"), F.countDistinct(column).alias("d"))
    diff = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differ"))
    return n.crossJoin(diff).select("n", (F.col("n") == F.col("d")).alias("unique_ids"), (F.col("differ") == 0).alias("repeatable"))
