"""The frames of a data folder: manifest rows and their vectors, cleaned of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions.vector import usable
from lodevec.sources.tables import code, table

MANIFEST = "global_id long, site string, time_ns long, shard_path string, frame_idx int"
VECTORS = "global_id long, embedding array<float>"
HITS = "rank int, global_id long, score double, site string, time_ns long, shard_path string, frame_idx int"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows, site codes plain, exact repeats once. Rows without an id are left out."""
    return stored_manifest(spark, folder).distinct()


def stored_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`manifest` as it is stored, repeats and all: no shuffle."""
    m = table(spark, folder, "manifest").where("global_id is not null")
    return m.select("global_id", code("site").alias("site"), "time_ns", "shard_path", "frame_idx")


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as they are stored, usable or not."""
    return table(spark, folder, "frame_vectors").where("global_id is not null").select("global_id", "embedding")


def stored_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows with their vectors as they are stored: repeats and unusable vectors too."""
    return stored_manifest(spark, folder).join(stored_vectors(spark, folder), "global_id")


def usable_vectors(spark: SparkSession, folder: str, dim: int = 64) -> DataFrame:
    """Usable vectors as they are stored, repeats and all: no shuffle."""
    v = table(spark, folder, "frame_vectors").where("global_id is not null")
    return v.where(usable("embedding", dim)).select("global_id", "embedding")


def vectors(spark: SparkSession, folder: str, dim: int = 64) -> DataFrame:
    """Usable vectors, exact repeats once."""
    return usable_vectors(spark, folder, dim).distinct()


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames that have a usable vector, with their manifest columns."""
    return manifest(spark, folder).join(vectors(spark, folder), "global_id")


def query_vector(vecs: DataFrame, global_id: int) -> list[float]:
    """The stored vector of one frame; nothing is embedded anew."""
    row = vecs.where((F.col("global_id") == F.lit(global_id).cast("long")) & usable("embedding")).select("embedding").orderBy("embedding").first()
    if row is None:
        raise KeyError(f"frame {global_id} has no usable vector")
    return row.embedding
