"""Crawls that stop and go on, downloads that fail, skip and stop; files that can't be parsed."""

import errno
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodevec.operators import inventory, layout
from lodevec.sources import archive, web

BASE = "https://x.org/a/"
NAME = "asi_l1_brqu_2006010{}0{}_v01.cdf"


def site(folder):
    """A listing of two years with days below, as files that tasks read."""
    pages = {BASE: '<a href="../">up</a><a href="2006/">2006</a><a href="2007/">2007</a><a href="?sort=x">s</a><a href="/root/">r</a>', BASE + "2007/": None}
    pages[BASE + "2006/"] = '<a href="01/">01</a>'
    pages[BASE + "2006/01/"] = "".join(f'<a href="0{d}/">0{d}</a>' for d in (1, 2)) + '<a href="01/">again</a>'
    for d in (1, 2):
        pages[BASE + f"2006/01/0{d}/"] = "".join(f'<a href="{NAME.format(d, h)}">f</a>' for h in (1, 2)) + '<a href="thumb.jpg">t</a>'
    for url, html in pages.items():
        if html is not None:
            (folder / hashlib.md5(url.encode()).hexdigest()).write_text(html)
    return str(folder)


def reader(folder, log):
    def fetch(url):
        import hashlib

        with open(log, "a") as f:
            f.write(url + "\n")
        with open(f"{folder}/{hashlib.md5(url.encode()).hexdigest()}") as f:
            return f.read()

    return fetch


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "site").mkdir()
    log = str(tmp_path / "log")
    fetch = reader(site(tmp_path / "site"), log)
    first = web.crawl(spark, [BASE, BASE], str(tmp_path / "state"), fetch, tries=1, tasks=2, most_levels=2)
    assert {r.page_url for r in first.collect()} == {BASE, BASE + "2006/", BASE + "2007/"}
    assert [r.page_url for r in first.where("error is not null").collect()] == [BASE + "2007/"]
    pages = web.crawl(spark, [BASE], str(tmp_path / "state"), fetch, tries=1, tasks=2)
    seen = open(log).read().split()
    assert len(seen) == len(set(seen)) == pages.count() == 6
    found = archive.listing(pages)
    assert sorted(r.datetime for r in found.collect()) == ["2006010101", "2006010102", "2006010201", "2006010202"]
    assert {r.page_url for r in web.prune(pages, "2006-01-02", None).collect()} == {BASE, BASE + "2006/", BASE + "2007/", BASE + "2006/01/", BASE + "2006/01/02/"}
    assert {r.page_url for r in web.prune(pages, None, "20060101").collect()} == {BASE, BASE + "2006/", BASE + "2006/01/", BASE + "2006/01/01/"}


def test_downloads_skip_retry_and_rename(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}").write_bytes(b"x" * (10 + i))
    out = tmp_path / "out"
    out.mkdir()
    (out / "f0").write_bytes(b"y" * 10)
    rows = [(f"file://{src}/f{i}", f"{out}/f{i}", None) for i in range(3)] + [(f"file://{src}/none", f"{out}/none", None), (f"file://{src}/f1", f"{out}/short", 99), (None, "z", 1)]
    w = spark.createDataFrame(rows, "url string, target_path string, size_bytes long")
    at = str(tmp_path / "results")
    web.download(w, tries=2, pause=0, tasks=2).write.parquet(at)
    got = {os.path.basename(r.target_path): (r.status, r.bytes_written) for r in spark.read.parquet(at).collect()}
    assert got == {"f0": ("skipped", 0), "f1": ("downloaded", 11), "f2": ("downloaded", 12), "none": ("failed", 0), "short": ("failed", 0)}
    assert not list(out.glob("*.part")) and (out / "f0").read_bytes() == b"y" * 10
    assert {r.target_path.rsplit("/", 1)[1] for r in web.unfinished(spark.read.parquet(at)).collect()} == {"none", "short"}


def test_a_full_disk_stops(tmp_path):
    def full(url, part):
        raise OSError(errno.ENOSPC, "no space")

    (tmp_path / "a").write_bytes(b"1")
    got = web.fetch_one(f"file://{tmp_path}/a", str(tmp_path / "b"), stream=full)
    assert got[0] == "stopped" and not (tmp_path / "b").exists()
    calls = []

    def second(url, part):
        calls.append(1)
        if len(calls) == 1:
            raise TimeoutError
        return web._stream(url, part)

    assert web.fetch_one(f"file://{tmp_path}/a", str(tmp_path / "b"), stream=second)[0] == "downloaded" and len(calls) == 2


def test_pinned_hash(spark, tmp_path):
    (tmp_path / "w").write_bytes(b"weights")
    good = hashlib.sha256(b"weights").hexdigest()
    assert web.verified(spark, str(tmp_path / "w"), good.upper()).endswith("/w")
    with pytest.raises(ValueError, match="hash"):
        web.verified(spark, str(tmp_path / "w"), "0" * 64)


def test_one_bad_file_fails_alone(spark, tmp_path):
    for name, text in (("a.txt", "1\n2"), ("b.txt", "x"), ("c.txt", "3"), ("d.txt", "")):
        (tmp_path / name).write_text(text)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows, bad = archive.read_files(files, lambda p, c: [(i, float(x)) for i, x in enumerate(c.decode().split())], "frame_idx int, value double")
    assert sorted((os.path.basename(r.path), r.frame_idx, r.value) for r in rows.collect()) == [("a.txt", 0, 1.0), ("a.txt", 1, 2.0), ("c.txt", 0, 3.0)]
    b = bad.collect()
    assert len(b) == 1 and b[0].exception_type == "ValueError" and "b.txt" in b[0].path and "Traceback" in b[0].traceback


def test_shards_sidecars_and_header(spark, tmp_path):
    rows = [("b", "2006010100", i, 1000 + i, [1.0, 2.0], "p2", "h2") for i in range(3)] + [("a", "2006010101", 1, 7, [0.0, 1.0], "p1", "h1"), ("a", "2006010101", 0, 5, [0.0, 1.0], "p1", "h1")]
    f = spark.createDataFrame(rows, "site string, obs_hour string, frame_idx int, time_ns long, embedding array<float>, source_path string, source_sha256 string")
    at = str(tmp_path / "shards")
    archive.write_shards(f, at)
    d = archive.discover_shards(spark, at).orderBy("ordinal").collect()
    assert [(r.ordinal, r.site, r.datetime, r.n_frames) for r in d] == [(0, "a", "2006010101", 2), (1, "b", "2006010100", 3)]
    side = spark.read.schema(archive.SIDECAR).json(f"{at}/sidecars").where("site = 'a'").first()
    assert side.time_ns == [5, 7]
    shards = spark.createDataFrame([("p2", 3), ("p1", 2)], "shard_path string, n_frames int")
    h = archive.write_header(spark, shards, str(tmp_path / "header"), 2)
    assert h["shape"] == [5, 2] and h["n_shards"] == 2 and h["shard_paths_sha256"] == hashlib.sha256(b"p1\np2").hexdigest()
    assert archive.read_header(spark, str(tmp_path / "header"), shards) == h
    with pytest.raises(ValueError):
        archive.read_header(spark, str(tmp_path / "header"), shards.where("shard_path = 'p1'"))
    assert layout.ordered_digest(shards.where("false")) == hashlib.sha256(b"").hexdigest()


def test_inventory_round_trip(spark, tmp_path):
    i = spark.createDataFrame([("b", "2006010101", "/d/2", None, None), ("a", "2006010100", "/d/1", 5, "failed"), ("a", "2006010102", "/d/3", 5, "stopped")], archive.INVENTORY).withColumn("more", F.lit(1))
    archive.write_inventory(i, str(tmp_path / "inv"))
    back = archive.read_inventory(spark, str(tmp_path / "inv"))
    assert back.columns == ["site", "datetime", "drive_path", "file_size_bytes", "status"] and back.exceptAll(i.drop("more")).count() == 0 and back.count() == 3
    assert [r.datetime for r in inventory.unsuccessful(back).collect()] == ["2006010100", "2006010102"]
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="lacks"):
        archive.read_inventory(spark, str(tmp_path / "odd"))
