"""Filters on frames: sites are alternatives, time windows are alternatives, both must hold.

An empty list, like none, means no filter; a list of unknown sites matches nothing. Windows include
both ends; a reversed window matches nothing. All of it is plain predicates, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicate(sites: Sequence[str] | None = None, windows: Sequence[tuple[int, int]] | None = None) -> Column:
    ok = F.lit(True)
    if sites:
        ok = ok & F.col("site").isin(*[s.strip().lower() for s in sites])
    if windows:
        ok = ok & reduce(or_, [F.col("time_ns").between(a, b) for a, b in windows])
    return ok


def select(frames: DataFrame, sites=None, windows=None) -> DataFrame:
    return frames.where(predicate(sites, windows))


def in_windows(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames inside any row of ``windows(start_ns, end_ns)``; overlapping windows give a frame once.

    Windows are merged first, so that each frame meets at most one; the merged windows are looked up
    by hour buckets, an equi-join.
    """
    hour = 3_600_000_000_000
    w = merge_ranges(windows.where("start_ns <= end_ns").select(F.col("start_ns").alias("lo"), (F.col("end_ns") + 1).alias("hi")), "lo", "hi")
    w = w.withColumn("h", F.explode(F.sequence(F.expr(f"lo div {hour}L"), F.expr(f"(hi - 1) div {hour}L"))))
    return frames.withColumn("h", F.expr(f"time_ns div {hour}L")).join(w, "h").where("time_ns >= lo and time_ns < hi").drop("h", "lo", "hi")


def merge_ranges(ranges: DataFrame, start: str = "start", end: str = "end", by: Sequence[str] = ()) -> DataFrame:
    """Half-open ranges with overlapping and adjacent ones merged; empty ones are dropped."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    r = ranges.where(F.col(end) > F.col(start)).withColumn("_m", F.max(end).over(before))
    r = r.withColumn("_g", F.sum(F.when(F.col("_m").isNull() | (F.col(start) > F.col("_m")), 1).otherwise(0)).over(order))
    return r.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def islands(ids: DataFrame, column: str = "global_id", by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive ids as half-open ranges ``(start, end)``.

    The window is over ``by``; without it, over buckets of a million ids, whose edges are then merged
    (few rows), so that no task sorts all ids.
    """
    keys = list(by) or ["_b"]
    d = ids.select(*by, F.col(column).alias("_i")).where("_i is not null").distinct()
    if not by:
        d = d.withColumn("_b", F.expr("_i div 1000000L"))
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*keys).orderBy("_i")))
    r = d.groupBy(*keys, "_g").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end")).drop("_g")
    return r if by else merge_ranges(r.drop("_b"))
