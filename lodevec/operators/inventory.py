"""Inventories of image files: de-duplication, reconciliation, status, grouping by drive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(inventory: DataFrame, roots: Sequence[str]) -> DataFrame:
    """One row per (site, datetime): the one on the first root in the given order, then the lowest path.

    Rows on no root come last. A partial minimum, not a window: copies don't travel.
    """
    order = F.lit(len(roots))
    for i in range(len(roots) - 1, -1, -1):
        order = F.when(F.startswith("drive_path", F.lit(roots[i].rstrip("/") + "/")), i).otherwise(order)
    rest = [c for c in inventory.columns if c not in ("site", "datetime", "drive_path")]
    best = F.min(F.struct(order.alias("o"), F.col("drive_path").isNull().alias("n"), "drive_path", *[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in rest])).alias("b")
    g = inventory.groupBy("site", "datetime").agg(best)
    return g.select("site", "datetime", "b.drive_path", *[F.col(f"b.{c}")[c].alias(c) for c in rest])


def root_of(paths: DataFrame, roots: Sequence[str], path: str = "drive_path") -> DataFrame:
    """The rows with ``root``: the longest of the roots that holds the path, ``''`` if none does."""
    root = F.lit("")
    for r in sorted({r.rstrip("/") for r in roots}, key=len):
        root = F.when((F.col(path) == r) | F.startswith(path, F.lit(r + "/")), r).otherwise(root)
    return paths.withColumn("root", root)


def by_drive(inventory: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Rows with their root and their place in its queue, by site and hour; a drive with most of the rows is many tasks."""
    from lodevec.operators.layout import dense_ids

    d = dense_ids(root_of(inventory, roots), ["root", "site", "datetime", "drive_path", "file_size_bytes", "status"], "_pos")
    first = d.groupBy("root").agg(F.min("_pos").alias("_f"))  # one row a root
    return d.join(F.broadcast(first), "root").withColumn("position", (F.col("_pos") - F.col("_f") + 1).cast("int")).select(*inventory.columns, "root", "position")


def choose(inventory: DataFrame, sites: Sequence[str] | None = None, years: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    d = inventory
    if sites:
        d = d.where(F.col("site").isin(*sites))
    if years:
        d = d.where(F.substring("datetime", 1, 4).isin(*map(str, years)))
    return d.orderBy("site", "datetime", "drive_path").limit(limit) if limit is not None else d


def write_back(inventory: DataFrame, results: DataFrame, keys: Sequence[str] = ("site", "datetime")) -> DataFrame:
    """The inventory with new statuses; a row without a result keeps its own. Several results: the greatest."""
    new = results.groupBy(*keys).agg(F.max("status").alias("_new"))
    return inventory.join(new, list(keys), "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def reconcile(pinned: DataFrame, present: DataFrame) -> DataFrame:
    """``(key, state)`` of files pinned by a spec against those present.

    States, the first that applies: extra, missing, size, hash, ok. Both sides: ``(key, size_bytes, sha256)``.
    """
    a = pinned.select("key", F.col("size_bytes").alias("a_size"), F.col("sha256").alias("a_hash"), F.lit(True).alias("a"))
    b = present.select("key", F.col("size_bytes").alias("b_size"), F.col("sha256").alias("b_hash"), F.lit(True).alias("b"))
    state = (F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(~F.col("a_size").eqNullSafe(F.col("b_size")), "size")
             .when(~F.col("a_hash").eqNullSafe(F.col("b_hash")), "hash").otherwise("ok"))
    return a.join(b, "key", "full_outer").select("key", state.alias("state"))


def download_status(worklist: DataFrame, present: DataFrame) -> DataFrame:
    """What a download run would do with each file: skip exact ones, fetch the rest."""
    p = present.groupBy("target_path").agg(F.max("size_bytes").alias("have"))
    d = worklist.join(p, "target_path", "left")
    status = F.when(F.col("have").isNotNull() & (F.col("have") == F.col("expected_bytes")), "skipped").when(F.col("expected_bytes").isNull(), "failed").otherwise("downloaded")
    return d.select("target_path", "expected_bytes", status.alias("status"), F.when(status == "downloaded", F.col("expected_bytes")).otherwise(0).alias("bytes_written"))


def counts(rows: DataFrame, by: str = "status", size: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.sum(size).alias("bytes")] if size else [])
    return rows.groupBy(by).agg(*aggs)


def unsuccessful(rows: DataFrame) -> DataFrame:
    """Rows that failed or were stopped."""
    return rows.where(F.col("status").isin("failed", "stopped")).orderBy("site", "datetime") if "datetime" in rows.columns else rows.where(F.col("status").isin("failed", "stopped"))


def unfinished(inventory: DataFrame, done: DataFrame, keys: Sequence[str] = ("site", "datetime")) -> DataFrame:
    """Rows whose outputs don't stand yet: the outputs, not a log, say what is done."""
    return inventory.join(done.select(*keys).distinct(), list(keys), "left_anti")


def share(rows: DataFrame, workers: int, worker: int, order: Sequence[str]) -> DataFrame:
    """The rows of one worker: a hash of the order columns deals them out without a global sort."""
    return rows.where(F.pmod(F.xxhash64(*order), F.lit(workers)) == worker)


def stride(rows: DataFrame, workers: int, worker: int, order: Sequence[str]) -> DataFrame:
    """Every n-th row in order, exactly as a strided slice takes them (positions by range, not by one task)."""
    from lodevec.operators.layout import dense_ids

    return dense_ids(rows, list(order), "_pos").where(F.pmod("_pos", F.lit(workers)) == worker).drop("_pos")


def with_failures(worker_failures: DataFrame, announced: DataFrame, received: DataFrame) -> DataFrame:
    """Failure rows of the workers and of groups that got fewer frames than announced."""
    short = announced.join(received.groupBy("site", "datetime").agg(F.count("*").alias("got")), ["site", "datetime"], "left")
    short = short.where(F.coalesce("got", F.lit(0)) < F.col("n_frames")).select(
        "site", "datetime", F.lit("IncompleteStream").alias("exception_type"), F.concat(F.coalesce("got", F.lit(0)).cast("string"), F.lit(" of "), F.col("n_frames").cast("string"), F.lit(" frames")).alias("exception_msg"))
    return worker_failures.select("site", "datetime", "exception_type", "exception_msg").unionByName(short).distinct()
