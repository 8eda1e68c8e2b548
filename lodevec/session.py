"""Session settings and staged tables.

A *staged table* is how long jobs cut their lineage: rows are written as Parquet
into the folder that the session names in ``spark.checkpoint.dir`` (a folder that
all executors share) and read back with the schema they were written with. A lost
executor then costs a task, never the work before it.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def build_session(app: str = "lodevec", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, ANSI on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and one machine does it all (as in tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodevec-stage-"))
            atexit.register(shutil.rmtree, _own[0], True)
        at = "file://" + _own[0]
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_lodevec_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodevec-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lodevec.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(f"{folder}/lodevec.zip")
    sc._lodevec_shipped = True  # noqa: SLF001


@contextlib.contextmanager
def _shuffles_end_with_query(spark: SparkSession):
    """Shuffle files of a staged table's plan go when it is written: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        old = spark.conf.get(key)
        spark.conf.set(key, "true")
    except Exception:  # a version without this setting: the cleaner does it later
        old = None
    try:
        yield
    finally:
        if old is not None:
            spark.conf.set(key, old)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` into the shared folder and read it back; its lineage ends there."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/lodevec/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_query(spark):
        df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at  # noqa: SLF001
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that no later step reads."""
    at = getattr(df, "_staged_at", None)
    if not at:
        return
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(at)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced plans."""
    gc.collect()
    spark._jvm.System.gc()  # noqa: SLF001
