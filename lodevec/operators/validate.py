"""Checks of a frame table and an index: one row per check, and a report gated by thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.operators import layout

# Default thresholds of the report.
THRESHOLDS = {"recall_at_k": 0.9, "self_retrieval": 1.0, "zero_norm": 0.0, "non_finite": 0.0}
# Checks where less is better: their threshold is the most allowed.
AT_MOST = ("zero_norm", "non_finite", "null_vectors", "wrong_length", "index_rows_lacking", "top1_gap_mean", "top1_gap_max")
CHECK = "name string, value double, passed boolean"


def integrity(manifest: DataFrame, n_vectors: int | None = None) -> DataFrame:
    """Counts agree, ids are dense, time never goes back inside a site."""
    t = layout.totals(manifest)
    span = manifest.agg((F.max("global_id") - F.min("global_id") + 1).alias("span"))
    back = layout.backward_steps(manifest).agg(F.coalesce(F.sum("n_back"), F.lit(0)).alias("n_back"))
    d = t.crossJoin(span).crossJoin(back)  # one row each
    same = F.lit(None).cast("boolean") if n_vectors is None else F.col("n_ids") == n_vectors
    return d.select("n_rows", "n_ids", "n_shards", "n_sites", (F.col("span") == F.col("n_ids")).alias("dense"), "n_back", (F.col("n_back") == 0).alias("monotone"), same.alias("counts_agree"))


def health(vectors: DataFrame, dim: int = V.DIM) -> DataFrame:
    """One row: nulls, wrong lengths, non-finite rows, zero rows, least norm.

    The norm of a row that is not finite counts as 0, so such a row is in both tallies.
    """
    d = vectors.select("embedding", (F.size("embedding") == dim).alias("fit"))
    fine = V.finite("embedding")
    n = F.when(fine, V.norm("embedding")).otherwise(0.0)
    d = d.select("fit", F.col("embedding").isNull().alias("null_"), fine.alias("fine"), F.when(F.col("fit"), n).alias("norm"))
    return d.agg(F.count("*").alias("n"), F.count_if("null_").alias("n_null"), F.count_if(~F.col("null_") & ~F.col("fit")).alias("n_length"), F.count_if(F.col("fit") & ~F.col("fine")).alias("n_non_finite"),
                 F.count_if(F.col("norm") == 0).alias("n_zero"), F.round(F.min("norm"), 6).alias("min_norm"))


def self_retrieval(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of queries whose best answer is themselves (or a copy at the same score)."""
    first = answers.where("rank = 1").select("query_id", F.col("global_id").alias("best"), F.col("score").alias("s"))
    own = answers.where("query_id = global_id").select("query_id", F.col("score").alias("own"))
    d = queries.select("query_id").distinct().join(first, "query_id", "left").join(own, "query_id", "left")
    return d.agg(F.count("*").alias("n"), F.avg(F.coalesce(((F.col("best") == F.col("query_id")) | (F.col("own") == F.col("s"))).cast("double"), F.lit(0.0))).alias("self_share"))


def agreement(reference: DataFrame, frames: DataFrame) -> DataFrame:
    """Reference vectors against stored ones by address; those that are missing are counted."""
    f = frames.select("site", "obs_hour", "frame_idx", F.col("embedding").alias("mine")).dropDuplicates(["site", "obs_hour", "frame_idx"])
    d = reference.join(f, ["site", "obs_hour", "frame_idx"], "left").withColumn("cos", F.round(V.cosine("embedding", "mine"), V.DIGITS))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("mine").isNull()).alias("n_missing"), F.avg("cos").alias("mean_cos"), F.min("cos").alias("min_cos"))


def gate(checks: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``(name, value, threshold, passed)``; given thresholds override the defaults one by one. No threshold: no verdict."""
    spark: SparkSession = checks.sparkSession
    t = spark.createDataFrame([(k, float(v)) for k, v in (THRESHOLDS | (thresholds or {})).items()], "name string, threshold double")
    below = F.col("name").isin(*AT_MOST)
    return checks.join(F.broadcast(t), "name", "left").select("name", "value", "threshold", F.when(below, F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")).alias("passed"))


def verdict(gated: DataFrame) -> DataFrame:
    """All verdicts together: nulls don't count, none at all is a failure."""
    return gated.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.count("*").alias("n"))


def freeze(measured: DataFrame, floor: float = 0.0, slack: float = 0.05) -> DataFrame:
    """Thresholds from measured values: ``round(max(floor, value - slack), 3)``; ``round(value + slack, 3)`` where less is better."""
    least = F.greatest(F.lit(floor), F.col("value") - slack)
    return measured.select("name", F.round(F.when(F.col("name").isin(*AT_MOST), F.col("value") + slack).otherwise(least), 3).alias("threshold"))


def orphans(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """Keys of the first that the second lacks; empty if it is a subset."""
    return small.select(key).distinct().join(large.select(key).distinct(), key, "left_anti")
