"""What the queries share: SQL for the cleaned tables, and the query frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodevec.functions.vector import usable
from lodevec.sources import frames as src
from lodevec.sources.tables import table

SITE = r"lower(regexp_replace(site, '^\s+|\s+$', '', 'g'))"
M = f"m AS (SELECT DISTINCT global_id, {SITE} AS site, time_ns, shard_path, frame_idx FROM manifest WHERE global_id IS NOT NULL)"
V = """v AS (SELECT DISTINCT global_id, CAST(embedding AS DOUBLE[]) AS embedding FROM frame_vectors
  WHERE global_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
Q = "q AS (SELECT global_id AS query_id, embedding AS qv FROM v WHERE global_id = (SELECT min(global_id) FROM v))"
COS = "round(list_cosine_similarity(embedding, qv), 6)"
UTC = "make_timestamp(time_ns // 1000)"


def manifest(spark, folder):
    return src.manifest(spark, folder)


def vectors(spark, folder):
    return src.vectors(spark, folder)


def frames(spark, folder):
    return src.frames(spark, folder)


def first_query(vecs):
    """The usable vector of the lowest id, of vectors as they are stored."""
    v = vecs.select("global_id", "embedding")
    low = v.orderBy("global_id", "embedding").limit(64).where(usable("embedding")).orderBy("global_id", "embedding").first()  # usually among the first
    return (low or v.where(usable("embedding")).orderBy("global_id", "embedding").first()).embedding


def stored_vectors(spark, folder):
    return src.stored_vectors(spark, folder)


def usable_vectors(spark, folder):
    return src.usable_vectors(spark, folder)


def stored_manifest(spark, folder):
    return src.stored_manifest(spark, folder)


def stored_frames(spark, folder):
    return src.stored_frames(spark, folder)


def query_set(vecs):
    """Every frame whose id is divisible by 50."""
    return vecs.where(F.pmod("global_id", F.lit(50)) == 0).select(F.col("global_id").alias("query_id"), "embedding")


QSET = "qs AS (SELECT global_id AS query_id, embedding AS qv FROM v WHERE global_id % 50 = 0)"

__all__ = ["COS", "M", "Q", "QSET", "SITE", "UTC", "V", "first_query", "frames", "manifest", "query_set", "stored_frames", "stored_manifest", "stored_vectors", "table", "usable_vectors", "vectors"]
