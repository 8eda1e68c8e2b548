import json

import pytest
from pyspark.sql import functions as F

from lodevec.functions import address, when
from lodevec.operators import inventory as inv
from lodevec.sources import archive
from lodevec.streaming import groups


@pytest.mark.parametrize("text, want", [("2006-01-02", ("2006-01-02", "00")), ("20060102", ("2006-01-02", "00")), ("2006010217", ("2006-01-02", "17")), ("2006-01-02 17:45:10", ("2006-01-02", "17")), ("2006-01-02T17", ("2006-01-02", "17")), ("2006-01-02 17:00:00 UTC", ("2006-01-02", "17"))])
def test_parse_hour(text, want):
    assert address.parse_hour(text) == want


@pytest.mark.parametrize("text", ["200601", "2006010299", "hello", "", "2006-13-01"])
def test_parse_hour_refuses(text):
    with pytest.raises(ValueError):
        address.parse_hour(text)


def test_day_range_and_prefixes():
    a, b = when.day_range_ns("1970-01-02", "1970-01-02")
    assert (a, b) == (when.DAY_NS, 2 * when.DAY_NS - 1)
    assert when.prefix_bound("2006-01", False) == "2006010000" and when.prefix_bound("2006-01", True) == "2006019999"


def test_times_before_and_between_seconds(spark):
    d = spark.createDataFrame([(1136073600999999999,), (-1,), (None,)], "t long")
    assert [r[0] for r in d.select(when.readable("t")).collect()] == ["2006-01-01 00:00:00 UTC", "1969-12-31 23:59:59 UTC", None]


def test_listing_filters_known_rows_and_names(spark):
    html = '<a href="../">..</a><a href="asi_l1_aaaa_2006010203_v01.cdf">a</a><a href="asi_l1_aaaa_2007010203_v01.cdf">b</a><a href="asi_l1_aaaa_2006010203_v01.cdf.png">t</a><a href="x?C=M">q</a>'
    pages = spark.createDataFrame([("u/aaaa/2006/", html)], "page_url string, html string")
    known = spark.createDataFrame([("bbbb", "2009010100", "f", "old")], "site string, datetime string, filename string, remote_url string")
    got = archive.listing(pages, start="2006", end="2006", known=known).collect()
    assert [(r.site, r.datetime, r.remote_url) for r in got] == [("aaaa", "2006010203", "u/aaaa/2006/asi_l1_aaaa_2006010203_v01.cdf")]
    assert archive.seeds("b/", ["aaaa"], "2006-05", "2007", range(2005, 2009)) == ["b/aaaa/2006/", "b/aaaa/2007/"]


def test_walk_and_sidecars_and_specs(spark, tmp_path):
    d = tmp_path / "aaaa/2006"
    d.mkdir(parents=True)
    (d / "asi_l1_aaaa_2006010203_v01.cdf").write_bytes(b"12345")
    (d / "other.cdf").write_bytes(b"1")
    (d / "2006010203.json").write_text(json.dumps({"site": "aaaa", "datetime": "2006010203", "n_frames": 2, "time_ns": [5, 8], "source_sha256": "x", "source_path": "p"}, indent=1))
    w = archive.walk(spark, str(tmp_path)).collect()
    assert [(r.site, r.datetime, r.file_size_bytes, r.status) for r in w] == [("aaaa", "2006010203", 5, "unprocessed")]
    assert [(r.frame_idx, r.time_ns) for r in archive.frames_of(archive.sidecars(spark, str(tmp_path))).collect()] == [(0, 5), (1, 8)]
    (tmp_path / "specs.json").write_text(json.dumps([{"name": "t", "nlist": 1, "thresholds": {"a": 0.5}, "expected_vectors": 90, "cdfs": [{"site": "aaaa", "datetime": "2006010203", "size_bytes": 10, "sha256": "h"}]}]))
    s = archive.specs(spark, str(tmp_path / "specs.json"))
    assert archive.spec_totals(s).first().n_bytes == 10 and archive.spec_cost(s, 10, 90).first().embed_s == 1.0
    archive.write_csv(archive.spec_files(s, "/d"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().target_path == "/d/aaaa/2006/asi_l1_aaaa_2006010203_v01.cdf"
    archive.spec_totals(s).write.parquet(str(tmp_path / "w"))
    with pytest.raises(ValueError, match="lacks"):
        archive.read_worklist(spark, str(tmp_path / "w"))


def test_write_frames_replaces_only_its_partitions(spark, tmp_path):
    mk = lambda x: spark.createDataFrame(x, "site string, obs_hour string, v int")
    archive.write_frames(mk([("a", "1", 1), ("a", "2", 2)]), str(tmp_path / "f"))
    archive.write_frames(mk([("a", "2", 3)]), str(tmp_path / "f"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [1, 3]


def test_inventory_states(spark):
    mk = lambda x: spark.createDataFrame(x, "key string, size_bytes long, sha256 string")
    got = inv.reconcile(mk([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", None, None)]), mk([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "y"), ("e", 1, "x"), ("d", None, None)])).collect()
    assert {r.key: r.state for r in got} == {"a": "ok", "b": "size", "c": "hash", "d": "ok", "e": "extra"}
    assert inv.reconcile(mk([("a", 1, "x")]), mk([])).first().state == "missing"
    i = spark.createDataFrame([("a", "1", "/x/f", 1, None), ("a", "1", "/y/f", 1, "done"), (None, None, None, None, None)], archive.INVENTORY)
    assert {(r.site, r.drive_path) for r in inv.first_wins(i, ["/y", "/x"]).collect()} == {("a", "/y/f"), (None, None)}


def test_shares_cover_all_rows(spark):
    d = spark.range(100).select(F.col("id").alias("k"))
    assert sum(inv.share(d, 3, w, ["k"]).count() for w in range(3)) == 100
    assert sorted(r.k for r in inv.stride(d, 10, 3, ["k"]).collect()) == list(range(3, 100, 10))


def test_stream_completes_restarts_and_times_out(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "site string, datetime string, n_frames int, frame_idx int"
    put = lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(src)
    out = lambda: sorted((r.site, r.received, r.state) for r in spark.read.schema(groups.OUT).parquet(str(tmp_path / "out")).collect())
    put([("a", "1", 2, 0), ("b", "1", 3, 0), ("a", "1", 2, 0)])
    run = lambda: groups.drain(groups.complete_groups(spark.readStream.schema(schema).parquet(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    assert out() == []
    put([("a", "1", 2, 1), ("b", "1", 3, 1), ("c", "1", None, 1), ("c", "1", 2, -1)])
    run()
    assert out() == [("a", 2, "complete")]
    put([("a", "1", 2, 1), ("a", "1", 2, 0), ("b", "1", 3, 9)])
    run()
    assert out() == [("a", 2, "complete"), ("b", 3, "complete")]


def test_incomplete_groups_time_out(spark, tmp_path):
    import time

    src = str(tmp_path / "in")
    schema = "site string, datetime string, n_frames int, frame_idx int"
    put = lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", "1", 2, 0)])
    s = groups.complete_groups(spark.readStream.schema(schema).parquet(src), timeout_ms=500)
    q = s.writeStream.outputMode("append").format("memory").queryName("late").start()
    try:
        # with a timeout the query never idles, so the test waits for rows, not for the query
        deadline = time.time() + 40
        while time.time() < deadline and spark.table("late").count() < 1:
            time.sleep(0.3)
        put([("b", "1", 1, 0)])
        while time.time() < deadline and spark.table("late").count() < 2:
            time.sleep(0.3)
        assert sorted((r.site, r.state) for r in spark.table("late").collect()) == [("a", "incomplete"), ("b", "complete")]
    finally:
        q.stop()


def test_command_line(spark, tiny, tmp_path, capsys):
    from lodevec.__main__ import main
    from lodevec.sources import frames

    assert main(["build", "--data", tiny, "--out", str(tmp_path / "ix"), "--cells", "4"]) == 0
    assert spark.read.parquet(str(tmp_path / "ix/rows")).select("cell_id").distinct().count() <= 4
    with pytest.raises(ValueError, match="other vectors"):
        main(["query", "--data", tiny.replace("sf0.001", "sf0.01"), "--index", str(tmp_path / "ix"), "brqu", "2006010100", "0"])
    r = frames.frames(spark, tiny).where("site is not null and time_ns is not null and frame_idx is not null").select("site", when.hour_stamp("time_ns").alias("h"), "frame_idx").orderBy("site", "h", "frame_idx").first()
    assert main(["query", "--data", tiny, r.site, r.h, str(r.frame_idx), "--results", "3", "--csv", str(tmp_path / "csv")]) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["site", "datetime", "score", "source_cdf"]
    assert main(["validate", "--data", tiny, "--threshold", "non_finite=1e9", "--threshold", "zero_norm=1e9"]) == 0
    assert main(["bench", "--data", tiny, "--queries", "2"]) == 0
