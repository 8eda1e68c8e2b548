"""Recall, latency, locality: measures of answers against the truth.

Answers are long tables ``(query_id, rank, global_id, score)``. Recall is the overlap of two id sets over
the size of the truth, whatever the order; queries without any overlap count. Percentiles interpolate
linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(truth: DataFrame, answers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, query_id, n_truth, n_hit, recall, top1)``; ``by`` columns are those of the answers."""
    t = truth.groupBy("query_id").agg(F.countDistinct("global_id").alias("n_truth"), F.min_by("global_id", "rank").alias("top_truth"))
    points = answers.select(*by).distinct() if by else None
    base = t.crossJoin(F.broadcast(points)) if by else t  # operating points: a handful, stated by the caller
    a = answers.select(*by, "query_id", "global_id").distinct().join(truth.select("query_id", "global_id").distinct(), ["query_id", "global_id"])
    hit = a.groupBy(*by, "query_id").agg(F.count("*").alias("n_hit"))
    first = answers.where("rank = 1").groupBy(*by, "query_id").agg(F.min("global_id").alias("top"))
    d = base.join(hit, [*by, "query_id"], "left").join(first, [*by, "query_id"], "left")
    n = F.coalesce("n_hit", F.lit(0))
    return d.select(*by, "query_id", "n_truth", n.alias("n_hit"), (n / F.col("n_truth")).alias("recall"), F.coalesce(F.col("top") == F.col("top_truth"), F.lit(False)).alias("top1"))


def recall_summary(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("n"), F.avg("recall").alias("mean"), F.percentile("recall", F.lit(0.1)).alias("p10"), F.min("recall").alias("min"), F.avg(F.col("top1").cast("double")).alias("top1_rate"))


def score_gap(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """Mean and greatest difference of the best scores."""
    t = truth.where("rank = 1").select("query_id", F.col("score").alias("t"))
    a = answers.where("rank = 1").select("query_id", F.col("score").alias("a"))
    return t.join(a, "query_id").agg(F.avg(F.col("t") - F.col("a")).alias("mean_gap"), F.max(F.col("t") - F.col("a")).alias("max_gap"))


def summary(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, median, p95, p99, mean, min and max, as for latencies."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*by)
    d = g.agg(F.count("*").alias("n"), p.alias("p"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return d.select(*by, "n", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "mean", "min", "max")


def locality(candidates: DataFrame, total: Column | int) -> DataFrame:
    """Per query: contiguous runs of its candidates' ids and the share of the id range they span."""
    w = Window.partitionBy("query_id").orderBy("global_id")
    c = candidates.select("query_id", "global_id").distinct().withColumn("new", F.coalesce((F.col("global_id") - F.lag("global_id").over(w) > 1).cast("int"), F.lit(1)))
    g = c.groupBy("query_id").agg(F.sum("new").alias("runs"), (F.max("global_id") - F.min("global_id")).alias("span"))
    return g.select("query_id", "runs", (F.col("span") / F.lit(total)).alias("span_share"))


def ratios(latency: DataFrame, exact_seconds: float) -> DataFrame:
    """Speed of each path against one exact pass."""
    return latency.withColumn("speed_up", F.lit(exact_seconds) / F.col("median"))
