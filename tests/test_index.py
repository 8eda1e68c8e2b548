"""The written index, its cache, the reports around it, and a pinned build."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec import engine
from lodevec.operators import index, ivf, pilot, report, search, validate

SEC = 1_000_000_000
MAN = "global_id long, site string, time_ns long, shard_path string, frame_idx int"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([centres[i % 40] + 0.5 * rng.standard_normal(64) for i in range(1200)]).reshape(-1, 64).astype(np.float32)
    at = tmp_path_factory.mktemp("folder")
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "global_id long, embedding array<float>")
    m = spark.createDataFrame([(i, "aa" if i % 3 else "bb", (1136073600 + 10 * i) * SEC, f"s{i % 7}", i) for i in range(1200)], MAN)
    v.write.parquet(f"{at}/frame_vectors.parquet")
    m.unionByName(m.limit(5)).write.parquet(f"{at}/manifest.parquet")
    return str(at), spark.read.parquet(f"{at}/frame_vectors.parquet"), spark.read.parquet(f"{at}/manifest.parquet"), x


@pytest.fixture(scope="module")
def built(spark, data, tmp_path_factory):
    _, v, m, _ = data
    with pytest.MonkeyPatch.context() as mp:
        mp.setattr(index, "BLOCK_ROWS", 200)
        return index.build(v, str(tmp_path_factory.mktemp("index")), cells=20, strata=m.select("global_id", "site"), codes=64)


def ids(df):
    return [r.global_id for r in df.orderBy("rank").collect()]


def test_opening_and_refusing(spark, built, tmp_path):
    again = index.Index(spark, built.at)
    assert again.header == built.header and again.header["n"] == 1200 and (again.centroids == built.centroids).all()
    assert np.allclose(again.rotation @ again.rotation.T, np.eye(64), atol=1e-4)
    with pytest.raises(FileNotFoundError):
        index.Index(spark, str(tmp_path / "none"))
    h = {**built.header, "format": 99}
    spark.createDataFrame([(json.dumps(h), b"", b"", b"")], index.MODEL).write.parquet(str(tmp_path / "odd/model"))
    with pytest.raises(ValueError, match="format"):
        index.Index(spark, str(tmp_path / "odd"))
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame([], "global_id long, embedding array<float>"), str(tmp_path / "x"))


def test_probe_prunes_folders_and_cells(data, built, monkeypatch):
    q = data[3][7].tolist()
    plan = built.probe(q, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell_block" in plan and "cell_id" in plan.split("PushedFilters")[1]
    assert "embedding" not in built.by_codes(built.probe(q, 2).select("cell_id", "global_id", "codes"), q, 5)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_scores_of_codes_and_both_ways_of_reading(data, built, monkeypatch):
    _, v, m, x = data
    q = x[7].tolist()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.global_id: r.approx for r in built.by_codes(built.rows, q, 2000).collect()}
    off = np.array([got[i] for i in range(1200)]) - u @ u[7]
    assert np.abs(off).mean() < 0.08
    one = built.pool(q, 20, 50).orderBy(F.desc("score"), "global_id").collect()
    monkeypatch.setattr(index, "ONE_SCAN_ROWS", 0)
    assert built.pool(q, 20, 50).orderBy(F.desc("score"), "global_id").collect() == one and len(one) == 50


def test_search_against_exact(data, built):
    _, v, m, x = data
    q = x[11].tolist()
    exact = ids(search.search_split(m, v, q, k=10, diversify_seconds=None))
    assert ids(built.search(m, q, k=10, nprobe=20, prefilter=1200, diversify_seconds=None)) == exact
    assert len(set(exact) & set(ids(built.search(m, q, k=10, nprobe=6, prefilter=100, diversify_seconds=None)))) >= 8
    d = built.search(m, q, k=5, nprobe=20, prefilter=1200, diversify_seconds=1000)
    assert ids(d) == ids(search.search_split(m, v, q, k=5, diversify_seconds=1000))
    assert built.search(m, q, min_score=0.99, nprobe=20, diversify_seconds=None).count() == 1
    with pytest.raises(ValueError):
        built.search(m, q, k=0)
    with pytest.raises(ValueError):
        built.search(m, [1.0], k=1)


def test_filters_choose_their_path(data, built):
    _, v, m, x = data
    q, log = x[11].tolist(), []
    run = lambda **o: ids(built.search(m, q, k=7, diversify_seconds=None, log=log, **o))
    want = ids(search.search(m.join(v, "global_id"), q, k=7, diversify_seconds=None, sites=["bb"]))
    assert run(sites=["bb"]) == want and log == ["exact"]
    log.clear()
    assert run(sites=["bb"], exact_rows=10, nprobe=20, prefilter=1200) == want and log == ["probe 20"]
    log.clear()
    assert run(sites=["zz"]) == [] and log == ["none"]
    log.clear()
    far = int(built.rows.where(F.col("cell_id") != int(np.argmax(built.centroids @ (x[11] / np.linalg.norm(x[11]))))).select(F.min("global_id")).first()[0])
    t = (1136073600 + 10 * far) * SEC
    assert run(windows=[(t, t)], exact_rows=0, nprobe=1) == [far] and log in (["probe 1", "probe 16"], ["probe 1", "probe 16", "exact"])


def test_batches_agree_with_single_searches(data, built, monkeypatch):
    _, v, m, x = data
    q = v.where("global_id % 100 = 3").select(F.col("global_id").alias("query_id"), "embedding")
    rows = built.batch(q, k=5, nprobe=6, prefilter=100).collect()
    for i in (3, 503):
        single = ids(built.search(m, x[i].tolist(), k=5, nprobe=6, prefilter=100, diversify_seconds=None))
        assert [r.global_id for r in sorted((r for r in rows if r.query_id == i and r["rank"] <= 5), key=lambda r: r["rank"])] == single
    monkeypatch.setattr(search, "MOST_QUERIES", 4)
    assert sorted(map(str, built.batch(q, k=5, nprobe=6, prefilter=100).collect())) == sorted(map(str, rows))
    assert built.batch(q.where("false")).count() == 0


def test_cache_follows_the_source(spark, data, tmp_path):
    folder = data[0]
    a = engine.index(spark, folder, cells=8)
    assert engine.index(spark, folder, cells=8) is a and engine.index(spark, folder, cells=9) is not a
    engine._open.clear()
    b = engine.index(spark, folder, cells=8)
    assert b is not a and b.at == a.at
    src = str(tmp_path / "t.parquet")
    made = []
    make = lambda: made.append(1) or spark.range(len(made))
    spark.range(3).write.parquet(src)
    assert engine.derived(spark, "d", [src], make).count() == engine.derived(spark, "d", [src], make).count() == 1
    spark.range(4).write.mode("append").parquet(src)
    assert engine.derived(spark, "d", [src], make).count() == 2 and len(made) == 2
    q = engine.query(spark, folder, "aa", "2006-01-01 00", 1, k=3, diversify_seconds=None)
    assert q.columns == ["site", "datetime", "score", "source_cdf"] and q.count() == 3 and q.first().score == 1.0


def test_running_best_equals_sorting():
    rng = np.random.default_rng(2)
    best, rows = search.Best(3, 4), []
    best.most = 10
    for step in range(30):
        s = np.round(rng.random((3, 7)), 1)
        s[rng.random((3, 7)) < 0.1] = np.nan
        g = np.arange(step * 7, step * 7 + 7)
        a, c = search.candidates(s, best.floor, 4)
        best.add(a, g[c], s[a, c])
        rows += [(i, g[j], s[i, j]) for i in range(3) for j in range(7) if np.isfinite(s[i, j])]
    q, gid, sc = best.rows()[:3]
    for i in range(3):
        want = sorted((-x, y) for k, y, x in rows if k == i)[:4]
        assert [(-x, y) for k, y, x in zip(q, gid, sc) if k == i] == want


def test_pages_of_a_crowded_site(spark):
    near = [(i, [1.0, i / 1e5] + [0.0] * 62, "aa", i * SEC // 100, "s", 0) for i in range(2500)]
    far = [(5000 + i, [1.0, 1.0 + i] + [0.0] * 62, "bb", i * 100 * SEC, "s", 0) for i in range(5)] + [(6000, [1.0, 9.0] + [0.0] * 62, None, None, None, None)] * 2
    f = spark.createDataFrame(near + far, "global_id long, embedding array<float>, site string, time_ns long, shard_path string, frame_idx int")
    q = [1.0] + [0.0] * 63
    want = [0, 5000, 5001, 5002, 5003, 5004, 6000]
    assert ids(search.search(f, q, k=50, diversify_seconds=30)) == want
    assert ids(search.search_split(f.drop("embedding"), f.select("global_id", "embedding"), q, k=50, diversify_seconds=30)) == want
    copies = spark.createDataFrame([near[0]] * 700 + far, f.schema)
    assert ids(search.search(copies, q, k=3, diversify_seconds=None)) == [0, 5000, 5001]
    assert ids(search.search_split(copies.drop("embedding"), copies.select("global_id", "embedding"), q, k=3, diversify_seconds=None)) == [0, 5000, 5001]


def test_reports(spark, data, built, tmp_path):
    _, v, m, x = data
    h = search.search_split(m, v, x[0].tolist(), k=4, diversify_seconds=None)
    c = h.select(report.caption().alias("c")).first().c.split("\n")
    assert len(c) == 3 and c[0].startswith("#1  score 1.0000") and c[1].startswith("BB  2006-01-01 00:00:00") and "frame 0" in c[2]
    r = report.export_roundtrip(h, str(tmp_path / "csv")).first()
    assert (r.n, r.n_same) == (4, 4)
    assert report.number(1234567) == "1,234,567" and report.number(None) == "-" and report.number(0.12345) == "0.1235" and report.seconds(0.0123) == "12.3 ms" and report.size(1.5e9) == "1.5 GB"
    t = report.latex_table([{"a_b": "x&y", "n": 3}], caption_="50 %", label="t")
    assert r"a\_b & n \\" in t and r"x\&y & 3 \\" in t and r"\caption{50 \%}" in t
    assert report.text_table([{"a": 1, "b": None}]).split("\n")[2] == "1  -"
    assert report.regime(1000, 500, 10, 500).startswith("the 500") and report.regime(10**9, 500, 10, 500) is None and report.regime(10**9, 5, 10, 500).startswith("5 queries") and report.regime(0, 1, 1, 1)
    q = v.where("global_id % 50 = 0").select(F.col("global_id").alias("query_id"), "embedding")
    got, verdict = report.validation(m.distinct(), v, v, built, q, {"recall_at_k": 0.8}, nprobe=10, prefilter=100)
    by = {r.name: r for r in got.collect()}
    assert verdict["passed"] and by["recall_at_k"].value >= 0.8 and by["raw_recall"].value <= by["recall_at_k"].value and by["index_rows_lacking"].value == 0 and by["self_retrieval_index"].value == 1.0
    assert "raw_recall: no threshold" in verdict["gaps"]
    b = report.benchmark(spark, m, v, built, str(tmp_path / "bench"), n_queries=2, points=((4, 50),))
    assert {(r["path"], r["phase"]) for r in b["latency"]} == {(p, f) for p in ("exact", "index 4/50") for f in ("cold", "warm")}
    assert set(b["stages"]) == {"probe", "rerank", "attributes", "total"} and "index" in report.report_text(b)
    assert spark.read.parquet(str(tmp_path / "bench/ground_truth")).count() == 20


def test_thresholds_of_counts_loosen_upwards(spark):
    d = spark.createDataFrame([("zero_norm", 3.0), ("recall_at_k", 0.93)], "name string, value double")
    assert {r.name: r.threshold for r in validate.freeze(d).collect()} == {"zero_norm": 3.05, "recall_at_k": 0.88}


def test_pinned_build(spark, data, tmp_path):
    _, v, m, _ = data
    files = "key string, size_bytes long, sha256 string"
    pinned = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], files)
    spec = {"name": "tiny", "nlist": 8, "nprobe": 8, "prefilter": 200, "expected_vectors": 1200, "thresholds": {"recall_at_k": 0.8}}
    r = pilot.build(spec, pinned, pinned, m.distinct(), v, str(tmp_path / "i"))
    assert r["passed"] and not r["warnings"] and r["index"]["cells"] == 8
    with pytest.raises(pilot.Drift, match="missing"):
        pilot.build(spec, pinned, pinned.limit(1), m, v, str(tmp_path / "j"))
    odd = spark.createDataFrame([("a", 1, "x"), ("b", 2, "z"), ("c", 1, "q")], files)
    log = spark.createDataFrame([("E", "one"), ("E", "two")], "exception_type string, exception_msg string")
    r = pilot.build({**spec, "expected_vectors": 5}, pinned, odd, m, v, str(tmp_path / "k"), log, check=False)
    assert r["warnings"] == ["1 files: hash", "1 files: extra", "1200 vectors, 5 expected", "2 x E: one"]
    with pytest.raises(pilot.Drift, match="hash"):
        pilot.build(spec, pinned, odd, m, v, str(tmp_path / "l"), strict=True)
    with pytest.raises(pilot.Drift, match="shards"):
        pilot.build(spec, pinned, pinned, m.where("false"), v, str(tmp_path / "m"))
