"""Queries on files: consolidation of small files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodevec.operators import compaction
from lodevec.sources.tables import table


def _compact(spark, folder, **options):
    return compaction.compact(table(spark, folder, "manifest"), table(spark, folder, "shard_files"), **options)


def p5_found(spark, folder):
    return compaction.scattered_hours(_compact(spark, folder))


def p5_frames(spark, folder):
    """Every frame of every site-hour once, with its number of copies."""
    return _compact(spark, folder).frames.select("site", "obs_hour", "frame_idx", "n_copies")


def p5_ranges(spark, folder):
    """Key range and size of every consolidated file (one MB of frames a file, to show several)."""
    return _compact(spark, folder, target_bytes=1 << 20).ranges().drop("file")


def p5_check(spark, folder):
    """One row: frames in all files, whether no two files' key ranges overlap, and whether any file has more than two targets' bytes."""
    r = _compact(spark, folder, target_bytes=1 << 20).ranges()
    w = Window.orderBy("lo")  # over files, not rows
    d = r.select("n_frames", "n_bytes", F.struct("first_site", "first_hour", "first_frame").alias("lo"), F.struct("last_site", "last_hour", "last_frame").alias("hi")).withColumn("before", F.lag("hi").over(w))
    return d.agg(F.sum("n_frames").alias("n_frames"), F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("lo"))), F.lit(True)).alias("apart"), F.coalesce(F.max("n_bytes") <= 2 << 20, F.lit(True)).alias("bounded"))


_PARSED = r"""
WITH p AS (
  SELECT lower(replace(shard_path, chr(92), '/')) AS q, shard_path, frame_idx
  FROM manifest WHERE shard_path IS NOT NULL AND frame_idx IS NOT NULL
), s AS (
  SELECT shard_path, frame_idx,
    CASE WHEN regexp_matches(q, 'site=[^/]+/dt=') THEN trim(regexp_extract(q, 'site=([^/]+)/dt=', 1))
         ELSE trim(regexp_extract(q, '([^/]+)/[0-9]{4}/[0-9]{10}', 1)) END AS site,
    CASE WHEN regexp_matches(q, 'site=[^/]+/dt=') THEN replace(regexp_extract(q, 'dt=([0-9-]{10})', 1), '-', '') || regexp_extract(q, 'hh=([0-9]{2})', 1)
         ELSE regexp_extract(q, '/[0-9]{4}/([0-9]{10})', 1) END AS obs_hour
  FROM p
)
"""

QUERIES = {"p5_found": p5_found, "p5_frames": p5_frames, "p5_ranges": p5_ranges, "p5_check": p5_check}
SQL = {
    "p5_found": _PARSED + "SELECT site, obs_hour, count(DISTINCT frame_idx) AS n_frames FROM s WHERE site <> '' AND obs_hour <> '' GROUP BY site, obs_hour HAVING count(DISTINCT shard_path) >= 2",
    "p5_check": _PARSED + "SELECT CAST(count(*) AS BIGINT) AS n_frames, true AS apart, true AS bounded FROM (SELECT DISTINCT site, obs_hour, frame_idx FROM s WHERE site <> '' AND obs_hour <> '')",
    "p5_frames": _PARSED + "SELECT site, obs_hour, frame_idx, CAST(count(DISTINCT shard_path) AS INTEGER) AS n_copies FROM s WHERE site <> '' AND obs_hour <> '' GROUP BY site, obs_hour, frame_idx",
}
