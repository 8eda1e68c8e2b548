"""Layout of a frame table: dense ids, hour ranges, site blocks, shard marks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import when
from lodevec.session import stage


def dense_ids(rows: DataFrame, order: list[str], name: str = "dense_id") -> DataFrame:
    """Ids 0..n-1 in the order of ``order`` (which should tell all rows apart), without a one-task sort.

    Rows are range-partitioned and staged with their partition's number; each partition is numbered by
    itself and shifted by the counts of those before it (one row per partition).
    """
    p = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    p = stage(p, "ranges")
    counts = p.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return p.withColumn("_i", inside).join(F.broadcast(shift), "_p").withColumn(name, F.col("_s") + F.col("_i") - 1).drop("_p", "_i", "_s")


def browse(manifest: DataFrame) -> DataFrame:
    """``(site, date, hour, gid_start, gid_end, n_frames)`` of every site-hour with a time."""
    t = manifest.where("site is not null and time_ns is not null")
    g = t.groupBy("site", when.day_stamp("time_ns").alias("date"), F.substring(when.hour_stamp("time_ns"), 9, 2).alias("hour"))
    return g.agg(F.min("global_id").alias("gid_start"), (F.max("global_id") + 1).alias("gid_end"), F.count("*").alias("n_frames"))


def browse_map(manifest: DataFrame) -> DataFrame:
    """The browse table as one nested map per site: date to hour to ``[start, end)``."""
    b = browse(manifest).groupBy("site", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", F.struct("gid_start", "gid_end"))))).alias("hours"))
    return b.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("date", "hours"))).alias("dates"))


def site_blocks(manifest: DataFrame) -> DataFrame:
    """Id range and count of each site, and whether its ids are contiguous."""
    g = manifest.where("site is not null").groupBy("site").agg(F.min("global_id").alias("first"), F.max("global_id").alias("last"), F.countDistinct("global_id").alias("n"))
    return g.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("n"))


def backward_steps(manifest: DataFrame) -> DataFrame:
    """Per site, how often time goes back as ids rise.

    Windows run over buckets of ids within a site; each bucket also looks at the last row before it, so
    a site that holds a third of all rows is many tasks.
    """
    m = manifest.where("site is not null and time_ns is not null").select("site", "global_id", "time_ns").withColumn("b", F.expr("global_id div 100000L"))
    inner = Window.partitionBy("site", "b").orderBy("global_id", "time_ns")
    steps = m.withColumn("back", (F.col("time_ns") < F.lag("time_ns").over(inner)).cast("int")).groupBy("site", "b").agg(
        F.sum(F.coalesce("back", F.lit(0))).alias("back"), F.min(F.struct("global_id", "time_ns")).alias("first"), F.max(F.struct("global_id", "time_ns")).alias("last"))
    across = (F.col("first.time_ns") < F.lag("last.time_ns").over(Window.partitionBy("site").orderBy("b"))).cast("int")
    return steps.withColumn("edge", F.coalesce(across, F.lit(0))).groupBy("site").agg((F.sum("back") + F.sum("edge")).alias("n_back")).withColumn("monotone", F.col("n_back") == 0)


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Shards with their first frame, rows, and whether frames count up from 0 without gaps."""
    g = manifest.where("shard_path is not null and frame_idx is not null").groupBy("shard_path")
    g = g.agg(F.min("global_id").alias("gid_start"), F.count("*").alias("n_rows"), F.countDistinct("frame_idx").alias("n_frames"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    return g.select("shard_path", "gid_start", "n_rows", (F.col("lo") == 0).alias("starts_at_0"), ((F.col("hi") - F.col("lo") + 1) == F.col("n_frames")).alias("gapless"))


def frame_positions(manifest: DataFrame) -> DataFrame:
    """Position of each frame in its shard by time, from 0."""
    w = Window.partitionBy("shard_path").orderBy("time_ns", "global_id")
    return manifest.where("shard_path is not null and time_ns is not null").select("global_id", "shard_path", (F.row_number().over(w) - 1).alias("position"))


def site_codes(manifest: DataFrame) -> DataFrame:
    """Dense codes of the sites in order of name, from 0 (a window over distinct sites, not rows)."""
    s = manifest.where("site is not null").select("site").distinct()
    return s.select("site", (F.row_number().over(Window.orderBy("site")) - 1).alias("code"))


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("n_rows"), F.countDistinct("global_id").alias("n_ids"), F.countDistinct("shard_path").alias("n_shards"), F.countDistinct("site").alias("n_sites"), F.min("time_ns").alias("min_ns"), F.max("time_ns").alias("max_ns"))


def ordered_digest(paths: DataFrame, column: str = "shard_path") -> str:
    """SHA-256 of the distinct paths in order, one to a line. The hash of one list is one chain: rows stream through it, none are held."""
    h, first = hashlib.sha256(), True
    p = paths.where(f"{column} is not null").select(F.col(column).alias("p")).distinct().orderBy("p")
    for r in p.toLocalIterator(prefetchPartitions=True):
        h.update((b"" if first else b"\n") + r.p.encode())
        first = False
    return h.hexdigest()


def digest(paths: DataFrame, column: str = "shard_path") -> DataFrame:
    """SHA-256 over the ordered distinct paths, in two levels: the paths of each site folder, then the folders.

    No task holds more than one folder's paths.
    """
    p = paths.where(f"{column} is not null").select(F.col(column).alias("p")).distinct()
    by = p.groupBy(F.sha2(F.substring_index(F.translate("p", "\\", "/"), "/", 2), 256).alias("folder"))
    one = by.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("p"))), 256).alias("h"), F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("n_shards"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))), 256).alias("sha256"))
