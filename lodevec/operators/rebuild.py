"""Nearest frame in time, and rebuilding a manifest from shards that are known by their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.operators.layout import dense_ids
from lodevec.session import stage


def nearest_frame(wanted: DataFrame, frames: DataFrame, keys: list[str], bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """For each wanted ``(*keys, want_ns)`` the frame nearest in time, before or after; ties: lower frame, then id.

    Frames and wanted times of a time bucket walk in order together, once up and once down; no pairs are made. What
    lies outside the bucket is one frame on either side: the ends of the nearest filled buckets, found by a walk over buckets.
    """
    c = F.struct("time_ns", "frame_idx", "global_id")
    f = frames.where("time_ns is not null").groupBy(*keys, "time_ns").agg(F.min(F.struct("frame_idx", "global_id")).alias("x"))
    f = f.select(*keys, "time_ns", "x.frame_idx", "x.global_id").withColumn("b", F.expr(f"time_ns div {bucket_ns}L"))
    w = wanted.select(*keys, "want_ns").distinct().withColumn("b", F.expr(f"want_ns div {bucket_ns}L"))
    none = F.lit(None)
    kind = "struct<time_ns:bigint,frame_idx:int,global_id:bigint>"
    # inside the bucket
    both = f.select(*keys, "b", F.col("time_ns").alias("t"), c.alias("c"), none.cast("long").alias("want_ns")).unionByName(w.select(*keys, "b", F.col("want_ns").alias("t"), none.cast(kind).alias("c"), "want_ns"))
    so_far = lambda *order: Window.partitionBy(*keys, "b").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("lo", F.last("c", True).over(so_far("t"))).withColumn("hi", F.last("c", True).over(so_far(F.desc("t")))).where("want_ns is not null")
    # nearest filled bucket before and after: a row for each bucket, filled or asked for
    ends = f.groupBy(*keys, "b").agg(F.min_by(c, "time_ns").alias("first"), F.max_by(c, "time_ns").alias("last"))
    marks = ends.unionByName(w.select(*keys, "b").distinct(), True).groupBy(*keys, "b").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    others = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sides = marks.select(*keys, "b", F.last("last", True).over(others("b")).alias("p"), F.last("first", True).over(others(F.desc("b"))).alias("n"))
    off = lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["time_ns"] - F.col("want_ns")).alias("off"), x["frame_idx"].alias("frame_idx"), x["global_id"].alias("global_id"), x["time_ns"].alias("time_ns")))
    best = F.least(*[off(F.col(x)) for x in ("lo", "hi", "p", "n")])
    d = near.join(sides, [*keys, "b"]).withColumn("x", best).where("x is not null")
    return d.select(*keys, "want_ns", "x.global_id", "x.frame_idx", "x.time_ns", F.col("x.off").alias("off_ns"))


def align(shards: DataFrame, rows: DataFrame, longest_gap: int = 1024) -> DataFrame:
    """Place shards in an existing sequence of rows, as an ordered subsequence by first and last row.

    ``shards(shard_path, first_key, last_key, n)`` in order of path; ``rows(pos, key)``. A shard stands at the
    position where its first key is found and its last key n - 1 rows on; shards without a place are skipped.
    More than ``longest_gap`` skipped in a row, overlapping places, or rows left over raise ``ValueError``.
    Work is two equi-joins on keys; the order of the shards is numbered by ranges.
    """
    a = shards.join(rows.select(F.col("key").alias("first_key"), F.col("pos").alias("start")), "first_key", "left")
    ends = rows.select(F.col("key").alias("last_key"), F.col("pos").alias("stop"))
    a = a.join(ends, "last_key", "left").where("stop - start = n - 1 or start is null or stop is null")
    best = a.groupBy("shard_path").agg(F.min(F.when(F.col("stop") - F.col("start") == F.col("n") - 1, F.struct("start", "stop"))).alias("at"))
    d = shards.select("shard_path", "n").join(best, "shard_path", "left").select("shard_path", "n", "at.start", "at.stop")
    # neighbours in order of path: inside buckets of ordinals, and between the ends of the buckets
    d = stage(dense_ids(d, ["shard_path"], "i"), "placed")
    placed = d.where("start is not null").withColumn("b", F.expr("i div 100000L"))
    w = Window.partitionBy("b").orderBy("i")
    inner = placed.select((F.col("start") <= F.lag("stop").over(w)).alias("over"), (F.col("i") - F.lag("i").over(w) - 1).alias("gap"))
    ends = placed.groupBy("b").agg(F.min_by(F.struct("i", "start"), "i").alias("first"), F.max_by(F.struct("i", "stop"), "i").alias("last"))
    before = F.lag("last").over(Window.orderBy("b"))  # a row for 100,000 shards
    edges = ends.select((F.col("first.start") <= before["stop"]).alias("over"), (F.col("first.i") - F.coalesce(before["i"], F.lit(-1)) - 1).alias("gap"))
    bad = inner.unionByName(edges).agg(F.count_if("over").alias("overlap"), F.max("gap").alias("gap")).first()
    size = d.agg(F.count("*").alias("n"), F.max(F.when(F.col("start").isNotNull(), F.col("i"))).alias("last"), F.sum(F.when(F.col("start").isNotNull(), F.col("n"))).alias("placed")).first()
    gap = max(bad.gap or 0, size.n - 1 - (size.last if size.last is not None else -1))
    if bad.overlap:
        raise ValueError(f"{bad.overlap} shards stand out of order")
    if gap > longest_gap:
        raise ValueError(f"{gap} shards in a row have no place")
    total = rows.count()
    if (size.placed or 0) != total:
        raise ValueError(f"{size.placed or 0} of {total} rows belong to a shard")
    return d.where("start is not null").select("shard_path", "start", (F.col("stop") + 1).alias("end"))
