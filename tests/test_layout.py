import pytest
from pyspark.sql import functions as F

from lodevec.operators import compaction, filters, layout, metrics, rebuild, sample

MAN = "global_id long, site string, time_ns long, shard_path string, frame_idx int"


def test_merge_ranges_adjacent_overlapping_reversed(spark):
    r = spark.createDataFrame([(1, 3), (3, 5), (4, 9), (20, 10), (12, 12), (11, 13)], "start long, end long")
    assert sorted((x.start, x.end) for x in filters.merge_ranges(r).collect()) == [(1, 9), (11, 13)]


def test_islands_cross_buckets(spark):
    i = spark.createDataFrame([(x,) for x in (1, 2, 2, 5, 999_999, 1_000_000, None)], "global_id long")
    assert sorted((x.start, x.end) for x in filters.islands(i).collect()) == [(1, 3), (5, 6), (999_999, 1_000_001)]


@pytest.mark.parametrize("n", [1, 4, 7])
def test_dense_ids_at_any_partitioning(spark, n):
    d = spark.range(200).select((F.col("id") * 7 % 200).alias("k")).repartition(n)
    assert all(r.k == r.i for r in layout.dense_ids(d, ["k"], "i").collect())


def test_backward_steps_cross_buckets(spark):
    rows = [(99_999, "a", 5, None, None), (100_000, "a", 4, None, None), (100_001, "a", 9, None, None), (1, "b", 3, None, None)]
    got = {r.site: r.n_back for r in layout.backward_steps(spark.createDataFrame(rows, MAN)).collect()}
    assert got == {"a": 1, "b": 0}


@pytest.mark.parametrize("n", [1, 4, 7])
def test_stratified_is_invariant(spark, n):
    d = spark.range(300).select(F.col("id").alias("global_id"), (F.col("id") % 7).alias("s")).repartition(n)
    s = sample.stratified(d, 40, ["s"], seed=2)
    assert s.count() == 35 and {r.global_id for r in s.collect()} == {r.global_id for r in sample.stratified(d.coalesce(1), 40, ["s"], seed=2).collect()}
    assert sample.stratified(d.where("false"), 40, ["s"]).count() == 0


def test_site_hour_layouts(spark):
    rows = [("brqu/2006/2006010317.f16.npy",), ("brqu\\2006\\2006011023.f16.npy#0",), ("site=Keld/dt=2006-01-02/hh=04/chunk0.f16.npy",), ("/vol1/shards/ORBA/2006/2006011501-0.f16.npy",), ("retry/hask/2006/2006011000.f16.npy",), ("nonsense",), (None,)]
    s, h = compaction.site_hour(F.col("p"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "p string").select(s, h).collect()]
    assert got == [("brqu", "2006010317"), ("brqu", "2006011023"), ("keld", "2006010204"), ("orba", "2006011501"), ("hask", "2006011000"), (None, None), (None, None)]


def test_compaction_keeps_each_frame_once(spark, tmp_path):
    a, b, c = "aa/2006/2006010100.f16.npy", "aa/2006/2006010100/001.f16.npy", "bb/2006/2006010100.f16.npy"
    rows = [(1, "aa", 1, a, 0), (1, "aa", 1, a, 0), (2, "aa", 2, a, 1), (9, "aa", 1, b, 0), (3, "aa", 3, b, 7), (None, None, None, b, 8), (4, "bb", None, c, 5000), (5, "bb", 1, c, 3), (6, "bb", 1, None, 3), (7, "bb", 1, c, None), (8, "bb", 1, "odd", 1), (10, "bb", 1, c, 3)]
    m = spark.createDataFrame(rows, MAN).withColumn("block", F.lit(1)).withColumn("first", F.lit("x"))
    got = compaction.compact(m, out=str(tmp_path / "out"), target_bytes=128 * 2)
    f = [(r.site, r.frame_idx, r.global_id, r.shard_path, r.n_copies) for r in got.frames.orderBy("site", "frame_idx").collect()]
    assert f == [("aa", 0, 1, a, 2), ("aa", 1, 2, a, 1), ("aa", 7, 3, b, 1), ("aa", 8, None, b, 1), ("bb", 3, 5, c, 1), ("bb", 5000, 4, c, 1)]
    r = got.ranges().collect()
    assert sum(x.n_frames for x in r) == 6 and all(x.n_bytes <= 256 for x in r)
    spans = sorted((x.first_site, x.first_frame, x.last_site, x.last_frame) for x in r)
    assert all(p[2:] <= q[:2] for p, q in zip(spans, spans[1:]))
    assert [(x.site, x.n_frames) for x in compaction.scattered_hours(got).collect()] == [("aa", 4)]


def test_compaction_of_long_keys_and_unsorted_files(spark, tmp_path, monkeypatch):
    """Runs that exceed a chunk, rows out of order, a file's repeats far apart: the same as counting."""
    import random

    monkeypatch.setattr(compaction, "CHUNK", 8)
    rng = random.Random(2)
    rows = []
    for i in range(900):
        hour, part = rng.choice(["2006010100", "2006010101"]), rng.randrange(5)
        rows.append((rng.randrange(50) if rng.random() > 0.1 else None, "aa", i, f"aa/2006/{hour}/{part:03d}.f16.npy", rng.choice([0, 1, 2, 3, 7, 4095, 4096, -1])))
    rows += rows[:100]
    runs = compaction.runs(spark.createDataFrame(rows, MAN).repartition(6))
    merged = [r.asDict() for r in runs.collect()]
    import pyarrow as pa

    table = pa.Table.from_pylist(sorted(merged, key=lambda r: (r["site"], r["obs_hour"], r["block"], r["first_path"])), schema=compaction._RUN)
    out = [r for b in compaction._merge_runs(table.to_batches(max_chunksize=3)) for r in b.to_pylist()]
    want = {}
    for g, _, t, p, f in rows:
        w = want.setdefault((p.split("/")[2], f), [set(), None])
        w[0].add(p)
        k = (p, g is None, g, t) if g is not None else (p, True, 0, t)
        w[1] = k if w[1] is None else min(w[1], k)
    got = {(r["obs_hour"], f): (r["paths"][n], g, c) for r in out for n, f, g, c in zip(r["path_no"], r["frame_idx"], r["global_id"], r["n_copies"])}
    assert got == {k: (w[1][0], None if w[1][1] else w[1][2], len(w[0])) for k, w in want.items()}
    assert len(out) == len({(r["obs_hour"], r["block"]) for r in out}) and all(r["frame_idx"] == sorted(set(r["frame_idx"])) for r in out)


def test_compaction_uses_stored_sizes(spark, tmp_path):
    a, b = "aa/2006/2006010100.f16.npy", "bb/2006/2006010100.f16.npy"
    m = spark.createDataFrame([(i, "aa", i, a, i) for i in range(10)] + [(20 + i, "bb", i, b, i) for i in range(10)], MAN)
    f = spark.createDataFrame([(a, 1000, 3), (b, None, 10), (None, 5, 5), ("odd", 7, 1)], "shard_path string, size_bytes long, n_frames int")
    got = compaction.compact(m, f, out=str(tmp_path / "out"), target_bytes=500).ranges()
    assert {(r.first_site, r.n_frames, r.n_bytes) for r in got.collect()} == {("aa", 5, 500), ("bb", 5, 500)} and got.count() == 4


def test_compaction_of_nothing(spark, tmp_path):
    got = compaction.compact(spark.createDataFrame([], MAN), out=str(tmp_path / "out"))
    assert got.frames.count() == 0 and compaction.scattered_hours(got).count() == 0


def test_recall_counts_misses_and_top1(spark):
    t = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (2, 1, 20, 0.9), (2, 2, 21, 0.7)], "query_id long, rank int, global_id long, score double")
    a = spark.createDataFrame([(1, 1, 11, 0.8), (1, 2, 10, 0.9)], t.schema)
    got = {r.query_id: (r.recall, r.top1) for r in metrics.recall(t, a).collect()}
    assert got == {1: (1.0, False), 2: (0.0, False)}


def test_summary_interpolates(spark):
    d = metrics.summary(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double"), "x").first()
    assert d.p95 == pytest.approx(8.95) and d.median == 2.5


def test_nearest_frame_ties_and_sides(spark):
    f = spark.createDataFrame([(1, "a", 0, None, 5), (2, "a", 10, None, 4), (3, "a", 10**14, None, 1), (4, "b", 7, None, 1)], MAN)
    w = spark.createDataFrame([("a", 5), ("a", 10**14 - 1), ("a", 5 * 10**13), ("b", -(10**15)), ("c", 1)], "site string, want_ns long")
    got = {(r.site, r.want_ns): r.global_id for r in rebuild.nearest_frame(w, f, ["site"]).collect()}
    # at a tie the lower frame wins; 5e13 lies 5e13 - 10 from the one and 5e13 from the other
    assert got == {("a", 5): 2, ("a", 10**14 - 1): 3, ("a", 5 * 10**13): 2, ("b", -(10**15)): 4}


def test_align_places_skips_and_refuses(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate("abcdef")], "pos long, key string")
    mk = lambda x: spark.createDataFrame(x, "shard_path string, first_key string, last_key string, n long")
    good = mk([("p1", "a", "c", 3), ("p2", "x", "y", 2), ("p3", "d", "f", 3)])
    assert [(r.shard_path, r.start, r.end) for r in rebuild.align(good, rows).orderBy("start").collect()] == [("p1", 0, 3), ("p3", 3, 6)]
    with pytest.raises(ValueError, match="out of order"):
        rebuild.align(mk([("p1", "d", "f", 3), ("p2", "a", "c", 3)]), rows)
    with pytest.raises(ValueError, match="belong"):
        rebuild.align(mk([("p1", "a", "c", 3)]), rows)
    with pytest.raises(ValueError, match="no place"):
        rebuild.align(good, rows, longest_gap=0)
