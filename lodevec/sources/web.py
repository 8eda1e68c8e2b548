"""Crawling listing pages and fetching files, as Spark jobs that can be stopped and taken up again.

The crawl goes level by level: the pages of one level are fetched by tasks (each at its own pace), their links are parsed in
the engine, new folders are the next level. Every level's pages are written before the next begins, so a crawl that
stopped goes on from the last complete level. ``fetch`` is any function from a URL to its text; the default reads
http(s) and file URLs.

A download asks for the size first, skips a file that stands with exactly that size, else streams into ``<target>.part``,
renames it when its size is right, and tries again a bounded number of times. A full disk stops the task: its other files come
back as ``stopped``. Targets lie in a folder that all executors share.
"""

from __future__ import annotations

import errno
import os
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.engine import exists

from lodevec.sources import archive

PAGES = "page_url string, html string, error string"
RESULTS = "url string, target_path string, status string, bytes_written long, expected_bytes long, error string"
MOST_LEVELS = 12


def read_url(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as r:
        return r.read().decode("utf-8", "replace")


def _fetch_pages(fetch: Callable[[str], str], pause: float, tries: int):
    def run(batches):
        for b in batches:
            out = []
            for url in b.column("page_url").to_pylist():
                html = error = None
                for _ in range(max(1, tries)):
                    time.sleep(pause)
                    try:
                        html, error = fetch(url), None
                        break
                    except Exception as e:  # noqa: BLE001 - a page that can't be read is a row, not the end of the crawl
                        error = f"{type(e).__name__}: {e}"
                out.append((url, html, error))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["page_url", "html", "error"])

    return run


def crawl(spark: SparkSession, seeds: Sequence[str], state: str, fetch: Callable[[str], str] = read_url, pause: float = 0.0, tries: int = 3, tasks: int = 4, most_levels: int = MOST_LEVELS) -> DataFrame:
    """The pages ``(page_url, html, error)`` reachable from the seeds through folder links below them, level by level.

    ``state`` is the folder of the levels; levels written there before are read, not fetched again. A page that
    cannot be read is a row with its error. Pages are visited once, whatever links to them.
    """
    frontier = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "page_url string")
    done: DataFrame | None = None
    for level in range(most_levels):
        at = f"{state.rstrip('/')}/level={level}"
        if not exists(spark, f"{at}/_SUCCESS"):
            frontier.repartition(tasks, "page_url").mapInArrow(_fetch_pages(fetch, pause, tries), PAGES).write.mode("overwrite").parquet(at)
        pages = spark.read.schema(PAGES).parquet(at)
        done = pages if done is None else done.unionByName(pages)
        folders = archive.links(pages.where("html is not null")).where("endswith(href, '/') and not contains(href, '?') and not contains(href, '://')")
        frontier = folders.select(F.concat("page_url", "href").alias("page_url")).distinct().join(done.select("page_url"), "page_url", "left_anti")
        if not frontier.limit(1).count():
            return done
    return done


def prune(pages: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Pages whose dated folders (``.../YYYY/MM/DD/``, as far as they go) can hold files of the range; undated pages stay."""
    stamp = F.regexp_replace(F.regexp_extract("page_url", r"/([0-9]{4}(?:/[0-9]{2}){0,2})/$", 1), "/", "")
    lo, hi = ((x or y).replace("-", "")[:8] for x, y in ((start, "0"), (end, "9")))
    return pages.where((stamp == "") | ((F.rpad(stamp, 8, "9") >= lo.ljust(8, "0")) & (F.rpad(stamp, 8, "0") <= hi.ljust(8, "9"))))


def head(url: str) -> int | None:
    """The size a server announces."""
    if url.startswith("file:"):
        return os.path.getsize(urllib.request.url2pathname(url.removeprefix("file://")))
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
        n = r.headers.get("Content-Length")
    return int(n) if n else None


def _stream(url: str, part: str) -> int:
    n = 0
    with urllib.request.urlopen(url, timeout=60) as r, open(part, "wb") as f:
        while block := r.read(1 << 20):
            f.write(block)
            n += len(block)
    return n


def fetch_one(url: str, target: str, size: int | None = None, tries: int = 3, pause: float = 0.0, stream: Callable[[str, str], int] = _stream) -> tuple[str, int, int | None, str | None]:
    """``(status, bytes, expected, error)`` of one file: skipped, downloaded, failed, or stopped (the disk is full)."""
    error = None
    part = target + ".part"
    for attempt in range(max(1, tries)):
        time.sleep(pause * attempt)
        try:
            want = size if size is not None else head(url)
            if os.path.exists(target) and want is not None and os.path.getsize(target) == want:
                return "skipped", 0, want, None
            os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
            n = stream(url, part)
            if want is not None and n != want:
                raise OSError(f"{n} of {want} bytes")
            os.replace(part, target)
            return "downloaded", n, want, None
        except Exception as e:  # noqa: BLE001 - the outcome is a row
            if os.path.exists(part):
                os.remove(part)
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, OSError) and e.errno == errno.ENOSPC:
                return "stopped", 0, size, error
    return "failed", 0, size, error


def download(worklist: DataFrame, tries: int = 3, pause: float = 1.0, tasks: int = 8, stream: Callable[[str, str], int] = _stream) -> DataFrame:
    """Fetch a work-list ``(url, target_path, size_bytes)``; one row of outcome a file. The files are the effect: write the result once."""

    def run(batches: Iterator[pa.RecordBatch]):
        full = False
        for b in batches:
            out = []
            for r in b.to_pylist():
                got = ("stopped", 0, r["size_bytes"], None) if full else fetch_one(r["url"], r["target_path"], r["size_bytes"], tries, pause, stream)
                full = full or got[0] == "stopped"
                out.append((r["url"], r["target_path"], *got))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["url", "target_path", "status", "bytes_written", "expected_bytes", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    w = worklist.where("url is not null and target_path is not null").select("url", "target_path", F.col("size_bytes").cast("long").alias("size_bytes")).dropDuplicates(["target_path"])
    return w.repartition(tasks, "target_path").mapInArrow(run, RESULTS)


def unfinished(results: DataFrame) -> DataFrame:
    """What a next run has to fetch: failed and stopped files."""
    return results.where(F.col("status").isin("failed", "stopped"))


def verified(spark: SparkSession, path: str, sha256: str) -> str:
    """The path of a file whose hash is as pinned; ``ValueError`` otherwise (a model's weights, say)."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    if got is None:
        raise FileNotFoundError(path)
    if got.h != sha256.lower():
        raise ValueError(f"{path} has hash {got.h}, not {sha256.lower()}")
    return path
