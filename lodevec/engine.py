"""Derived tables that are made once per state of their source, and the default index of a data folder.

A derived table lies in the shared folder under its name and the *stamp* of its source: number, bytes and latest change of
the source's files, with a format version. As long as the stamp holds, it is opened; a changed source gets a new one.
The opened indexes of a process are kept by folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodevec.operators.index import FORMAT, Index, build
from lodevec.session import shared_folder
from lodevec.sources import frames

_open: dict[tuple, Index] = {}


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    it = fs.listFiles(p, True)
    while it.hasNext():
        yield it.next()


def stamp(spark: SparkSession, *paths: str, version: str = "1") -> str:
    """A short code of the files below the paths: it changes when a file comes, goes, grows or is written anew."""
    parts = [version]
    for path in paths:
        n = size = last = 0
        for f in _files(spark, path):
            n, size, last = n + 1, size + f.getLen(), max(last, f.getModificationTime())
        parts.append(f"{path}:{n}:{size}:{last}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:20]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def place(spark: SparkSession, name: str, code: str) -> str:
    return f"{shared_folder(spark)}/lodevec/derived/{name}-{code}"


def derived(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table ``make()`` gives, written on the first call for this state of the sources and read afterwards."""
    at = place(spark, name, stamp(spark, *sources))
    if not exists(spark, f"{at}/_SUCCESS"):
        w = make().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    return spark.read.parquet(at)


def index(spark: SparkSession, folder: str, at: str | None = None, rebuild: bool = False, **options) -> Index:
    """The index of a data folder, kept in the shared folder for each state of its vectors, or at ``at``.

    One at ``at`` that was built for other vectors is refused, not replaced, unless ``rebuild`` says so.
    """
    source = stamp(spark, f"{folder}/frame_vectors.parquet", version=str(FORMAT))
    key = (folder, at, source, tuple(sorted(options.items())))
    if not rebuild and key in _open and _open[key].spark is spark:
        return _open[key]
    where = at or place(spark, "index", f"{source}-{hashlib.sha256(repr(key[3]).encode()).hexdigest()[:8]}")
    if not rebuild and exists(spark, f"{where}/model/_SUCCESS"):
        got = Index(spark, where)
        if got.header["stamp"] != source:
            raise ValueError(f"the index at {where} was built for other vectors; build it anew")
        _open[key] = got
        return got
    from pyspark.sql import functions as F

    strata = frames.stored_manifest(spark, folder).select("global_id", "site", F.date_format(F.timestamp_micros(F.expr("time_ns div 1000")), "yyyyMM").alias("month"))
    _open[key] = build(frames.vectors(spark, folder), where, strata=strata, stamp=source, **options)
    return _open[key]


def query(spark: SparkSession, folder: str, site: str, hour, frame: int, at: str | None = None, **options) -> DataFrame:
    """Search by address through the folder's index; the export table. Options are those of :meth:`Index.search`."""
    from lodevec.operators import search

    m = frames.stored_manifest(spark, folder)
    i = index(spark, folder, at)
    vector = frames.query_vector(i.rows, search.resolve(m, site, hour, frame))
    return search.export(i.search(m, vector, **options).orderBy("rank"))
