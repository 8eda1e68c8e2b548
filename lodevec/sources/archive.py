"""Sources and sinks around an image archive: listings, work-lists, inventories, sidecars, specs, reports."""

from __future__ import annotations

import dataclasses
import json
import os
import traceback
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import address, when

WORKLIST = "site string, datetime string, filename string, url string, target_path string, size_bytes long"
INVENTORY = "site string, datetime string, drive_path string, file_size_bytes long, status string"
SIDECAR = "site string, datetime string, n_frames int, time_ns array<long>, source_sha256 string, source_path string"
SPEC = "name string, description string, nlist int, nprobe int, prefilter int, expected_vectors long, thresholds map<string,double>, cdfs array<struct<site:string,datetime:string,size_bytes:long,sha256:string>>"


@dataclasses.dataclass(frozen=True)
class Places:
    """Where data and artifacts lie; the environment overrides the defaults."""

    data_root: str = dataclasses.field(default_factory=lambda: os.environ.get("LODEVEC_DATA", "data"))
    artifacts: str = dataclasses.field(default_factory=lambda: os.environ.get("LODEVEC_ARTIFACTS", "artifacts"))


def seeds(base: str, sites: Sequence[str], start: str | None, end: str | None, years: Sequence[int]) -> list[str]:
    """The ``<site>/<year>/`` folders that a date range can touch: nothing else needs listing."""
    lo, hi = (start or "0000").replace("-", "")[:4], (end or "9999").replace("-", "")[:4]
    return [f"{base.rstrip('/')}/{s}/{y}/" for s in sites for y in years if lo <= str(y) <= hi]


def links(pages: DataFrame) -> DataFrame:
    """``(page_url, href)``: every link of listing pages ``(page_url, html)`` but queries and parents."""
    h = pages.select("page_url", F.explode(F.regexp_extract_all("html", F.lit(address.LINK), F.lit(1))).alias("href"))
    return h.where("href <> '../' and not startswith(href, '/')")


def listing(pages: DataFrame, sites: Sequence[str] | None = None, start: str | None = None, end: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """``(site, datetime, filename, remote_url)`` of image files on listing pages.

    Known rows (an earlier run's) are added first; the filter is over all rows, so old rows outside the
    range don't come back. One row per URL.
    """
    site, _, hour = address.name_parts("href")
    d = links(pages).select(site.alias("site"), hour.alias("datetime"), F.col("href").alias("filename"), F.concat("page_url", "href").alias("remote_url"))
    d = d.where(F.col("filename").rlike("^" + address.FILE_NAME + "$"))
    if known is not None:
        d = known.select(*d.columns).unionByName(d)
    d = d.where(when.in_prefix_range("datetime", start, end))
    if sites:
        d = d.where(F.col("site").isin(*sites))
    return d.dropDuplicates(["remote_url"])


def new_links(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("remote_url").distinct(), "remote_url", "left_anti")


def worklist(listing_: DataFrame, root: str) -> DataFrame:
    return listing_.select("site", "datetime", "filename", F.col("remote_url").alias("url"), address.local_path(root, "site", "datetime").alias("target_path"), F.lit(None).cast("long").alias("size_bytes"))


def read_worklist(spark: SparkSession, path: str, drive_root: str | None = None) -> DataFrame:
    """A work-list table; lacking columns are an error."""
    d = spark.read.parquet(path)
    lacking = {"url", "target_path"} - set(d.columns)
    if lacking:
        raise ValueError(f"the work-list lacks {', '.join(sorted(lacking))}")
    return d.where(F.startswith("target_path", F.lit(drive_root))) if drive_root else d


def walk(spark: SparkSession, root: str, pattern: str = "*.cdf") -> DataFrame:
    """Image files below a folder as an inventory; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    site, _, hour = address.name_parts("path")
    return f.select(site.alias("site"), hour.alias("datetime"), F.regexp_replace("path", "^file:/*", "/").alias("drive_path"), F.col("length").alias("file_size_bytes"), F.lit("unprocessed").alias("status")).where("datetime is not null")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files as they are, one row per shard."""
    return spark.read.schema(SIDECAR).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def frames_of(side: DataFrame) -> DataFrame:
    """One row per frame: ``(site, datetime, frame_idx, time_ns)``."""
    return side.select("site", "datetime", F.posexplode("time_ns").alias("frame_idx", "time_ns"))


def write_frames(frames: DataFrame, at: str) -> None:
    """Frames by site and hour; only the partitions written are replaced, each job commits as a whole."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "obs_hour").parquet(at)


def specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPEC).option("multiLine", "true").json(path)


def spec_totals(spec: DataFrame) -> DataFrame:
    """Files, bytes, sites and months of each spec, smallest first."""
    b = F.aggregate("cdfs", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["size_bytes"], F.lit(0)))
    return spec.select("name", F.size("cdfs").alias("n_files"), b.alias("n_bytes"), F.array_sort(F.array_distinct(F.transform("cdfs", lambda x: x["site"]))).alias("sites"),
                       F.array_sort(F.array_distinct(F.transform("cdfs", lambda x: F.substring(x["datetime"], 1, 6)))).alias("months")).orderBy("n_files", "name")


def spec_files(spec: DataFrame, root: str) -> DataFrame:
    """The work-list of a pinned spec, without any discovery."""
    c = spec.select("name", F.inline("cdfs"))
    return c.select("name", "site", "datetime", address.url("site", "datetime").alias("url"), address.local_path(root, "site", "datetime").alias("target_path"), "size_bytes", "sha256")


def spec_cost(spec: DataFrame, bytes_per_s: float, frames_per_s: float, index_base_s: float = 0.0, index_s_per_frame: float = 0.0) -> DataFrame:
    """Seconds to fetch, embed and index each spec; indexing is linear in the vectors."""
    b = F.aggregate("cdfs", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["size_bytes"], F.lit(0)))
    return spec.select("name", F.round(b / bytes_per_s, 3).alias("fetch_s"), F.round(F.col("expected_vectors") / frames_per_s, 3).alias("embed_s"), F.round(F.lit(index_base_s) + F.col("expected_vectors") * F.lit(index_s_per_frame), 3).alias("index_s"))


def read_inventory(spark: SparkSession, at: str) -> DataFrame:
    """A written inventory; lacking columns are an error, further ones are left out."""
    d = spark.read.parquet(at)
    names = [c.split()[0] for c in INVENTORY.split(", ")]
    lacking = set(names) - set(d.columns)
    if lacking:
        raise ValueError(f"the inventory lacks {', '.join(sorted(lacking))}")
    return d.select(*[F.col(n).cast(k).alias(n) for n, k in (c.split() for c in INVENTORY.split(", "))])


def write_inventory(inventory: DataFrame, at: str) -> None:
    """The five columns of an inventory, by site: each job commits as a whole."""
    names = [c.split()[0] for c in INVENTORY.split(", ")]
    inventory.select(*names).repartitionByRange("site", "datetime").sortWithinPartitions("site", "datetime", "drive_path").write.mode("overwrite").parquet(at)


def write_shards(frames: DataFrame, at: str) -> None:
    """Frames and their sidecars: ``frames/`` by site and hour, and one sidecar row a shard in ``sidecars/``.

    ``frames(site, obs_hour, frame_idx, time_ns, embedding, source_path, source_sha256)``. Frames are committed
    before sidecars, so a shard with a sidecar is complete.
    """
    write_frames(frames, f"{at}/frames")
    side = frames.groupBy("site", F.col("obs_hour").alias("datetime")).agg(
        F.count("*").cast("int").alias("n_frames"), F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "time_ns"))), lambda x: x["time_ns"]).alias("time_ns"),
        F.min("source_sha256").alias("source_sha256"), F.min("source_path").alias("source_path"))  # a shard is one hour's frames
    side.write.mode("overwrite").json(f"{at}/sidecars")


def discover_shards(spark: SparkSession, at: str) -> DataFrame:
    """``(ordinal, site, datetime, n_frames, source_path)`` of complete shards, in order of site and hour."""
    from lodevec.operators.layout import dense_ids

    s = spark.read.schema(SIDECAR).json(f"{at}/sidecars").where("site is not null and datetime is not null")
    return dense_ids(s.select("site", "datetime", "n_frames", "source_path"), ["site", "datetime", "source_path"], "ordinal")


def write_header(spark: SparkSession, shards: DataFrame, at: str, dim: int, path: str = "shard_path") -> dict:
    """The header of a frame table: shape, type, number of shards and the digest of their ordered paths."""
    from lodevec.operators.layout import ordered_digest

    n = shards.agg(F.sum("n_frames").alias("n")).first().n or 0
    h = {"shape": [int(n), dim], "dtype": "float32", "n_shards": shards.select(path).distinct().count(), "shard_paths_sha256": ordered_digest(shards, path)}
    spark.createDataFrame([(json.dumps(h),)], "value string").coalesce(1).write.mode("overwrite").text(at)
    return h


def read_header(spark: SparkSession, at: str, shards: DataFrame | None = None, path: str = "shard_path") -> dict:
    """A written header; given the shards, ``ValueError`` if their order or number is not the one it was written for."""
    from lodevec.operators.layout import ordered_digest

    h = json.loads(spark.read.text(at).first().value)
    if shards is not None and ordered_digest(shards, path) != h["shard_paths_sha256"]:
        raise ValueError("the shards are not those of the header")
    return h


def read_files(files: DataFrame, parse: Callable[[str, bytes], list[tuple]], schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, failures)`` of binary files ``(path, content)``: a file that can't be parsed fails by itself.

    ``parse(path, content)`` gives tuples of ``schema``; failures are ``(path, exception_type, exception_msg, traceback)``.
    Works on streams as well (``readStream.format("binaryFile")``).
    """
    out = f"path string, row struct<{', '.join(':'.join(c.split(None, 1)) for c in schema.split(', '))}>, exception_type string, exception_msg string, traceback string"

    def run(parts):
        import pandas as pd

        for d in parts:
            rows = []
            for p, c in zip(d["path"], d["content"]):
                try:
                    rows += [(p, dict(zip(names, r)), None, None, None) for r in parse(p, bytes(c))]
                except Exception as e:  # noqa: BLE001 - one file's failure is a row
                    rows.append((p, None, type(e).__name__, str(e), traceback.format_exc()))
            yield pd.DataFrame(rows, columns=["path", "row", "exception_type", "exception_msg", "traceback"])

    names = [c.split()[0] for c in schema.split(", ")]
    d = files.select("path", "content").mapInPandas(run, out)
    return d.where("exception_type is null").select("path", "row.*"), d.where("exception_type is not null").drop("row")


def write_csv(rows: DataFrame, at: str) -> None:
    """One CSV file with a header: for result tables, which are small by their limit."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(at)


def write_json(rows: DataFrame, at: str) -> None:
    rows.write.mode("overwrite").json(at)
