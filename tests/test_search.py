import pytest
from pyspark.sql import functions as F

from lodevec.operators import filters, ivf, search

SEC = 1_000_000_000
COLS = "global_id long, embedding array<float>, site string, time_ns long, shard_path string, frame_idx int"


def vec(a, b):
    return [float(a), float(b)] + [0.0] * 62


@pytest.fixture(scope="module")
def frames(spark):
    rows = []
    for i in range(40):
        rows.append((i, vec(1, i / 40), "aa" if i % 2 else "bb", (i // 2) * 10 * SEC, f"s{i % 3}", i))
    rows += [(50, vec(1, 0), "aa", 0, "s", 0), (51, vec(1, 0), None, None, None, None), (52, vec(1, 0), None, None, None, None)]
    return spark.createDataFrame(rows, COLS)


def ids(df):
    return [r.global_id for r in df.orderBy("rank").collect()]


def greedy(frames, q, d, limit, least=None):
    rows = search.scored(frames, q).collect()
    rows.sort(key=lambda r: (-r.score, r.global_id))
    kept = []
    for r in rows:
        if least is not None and r.score < least:
            break
        if any(r.site is not None and k.site == r.site and k.time_ns is not None and abs(k.time_ns - r.time_ns) <= d * SEC for k in kept):
            continue
        kept.append(r)
        if len(kept) == limit:
            break
    return [r.global_id for r in kept]


@pytest.mark.parametrize("d", [0, 9.999999999, 10, 25, 1000])
def test_diversify_is_the_greedy_walk(frames, d):
    q = vec(1, 0)
    assert ids(search.search(frames, q, k=6, diversify_seconds=d)) == greedy(frames, q, d, 6)


def test_none_is_off_and_zero_drops_same_instants(frames):
    q = vec(1, 0)
    assert ids(search.search(frames, q, k=5, diversify_seconds=None)) == [0, 50, 51, 52, 1]
    assert ids(search.search(frames, q, k=5, diversify_seconds=0))[:4] == [0, 50, 51, 52]


def test_threshold_ignores_k_and_is_monotone(frames):
    q = vec(1, 0)
    n = [search.search(frames, q, k=1, min_score=s, diversify_seconds=None).count() for s in (0.7, 0.9, 0.99, 1.1)]
    assert n == sorted(n, reverse=True) and n[0] > 20 and n[-1] == 0


def test_refusals(frames):
    with pytest.raises(ValueError):
        search.search(frames, vec(1, 0), k=0)
    with pytest.raises(ValueError):
        search.search(frames, [1.0], k=1)


def test_empty_lists_are_no_filter_but_unknown_sites_match_nothing(frames):
    assert filters.select(frames, [], []).count() == 43
    assert filters.select(frames, ["zz"]).count() == 0
    assert filters.select(frames, [" AA "], [(0, 0), (9 * SEC, 1)]).count() == 2
    assert search.search(frames, vec(1, 0), sites=["zz"]).count() == 0


def test_resolve_names_what_there_is(frames):
    m = frames.where("site is not null").withColumn("time_ns", F.col("time_ns") + 1136073600 * SEC)
    assert search.resolve(m, "AA", "2006-01-01 00", 3) == 3
    with pytest.raises(KeyError, match="no site"):
        search.resolve(m, "zz", "2006-01-01", 0)
    with pytest.raises(KeyError, match="nothing at"):
        search.resolve(m, "aa", "2007010100", 0)
    with pytest.raises(IndexError):
        search.resolve(m, "aa", "20060101", 999)
    with pytest.raises(IndexError):
        search.resolve(m, "aa", "20060101", -1)


def test_ladder(spark, frames):
    f = frames.where("site is not null")
    cent = spark.createDataFrame([(0, vec(1, 0)), (1, vec(0, 1))], "cell_id int, centroid array<double>")
    cells = ivf.assign(f.select("global_id", "embedding"), cent)
    run = lambda **o: (log := [], ivf.filtered_search(cells, cent, f, vec(1, 0), k=3, log=log, diversify_seconds=None, **o).count(), log)[1:]
    assert run(sites=["aa"]) == (3, ["exact"])
    assert run(sites=["zz"]) == (0, ["none"])
    assert run(sites=["aa"], exact_rows=0, nprobe=1) == (3, ["probe 1"])
    assert run() == (3, ["probe"])
    # all rows in a cell that is not probed: escalate, then find
    only = ivf.assign(f.select("global_id", "embedding"), cent).withColumn("cell_id", F.lit(1))
    log = []
    assert ivf.filtered_search(only, cent, f, vec(1, 0), k=3, nprobe=1, sites=["aa"], exact_rows=0, log=log).count() == 3
    assert log == ["probe 1", "probe 2"]
    lost = only.withColumn("cell_id", F.lit(9))
    log = []
    assert ivf.filtered_search(lost, cent, f, vec(1, 0), k=3, nprobe=1, sites=["aa"], exact_rows=0, log=log).count() == 3
    assert log == ["probe 1", "probe 2", "exact"]


def test_full_probe_is_exact(spark, frames):
    f = frames.where("site is not null")
    cent = spark.createDataFrame([(0, vec(1, 0)), (1, vec(1, 1))], "cell_id int, centroid array<double>")
    cells = ivf.assign(f.select("global_id", "embedding"), cent)
    a = ivf.search(cells, cent, f.drop("embedding"), vec(1, 0.3), k=9, nprobe=2, prefilter=100, diversify_seconds=None)
    assert ids(a) == ids(search.search(f, vec(1, 0.3), k=9, diversify_seconds=None))
    assert ivf.search(cells, cent, f.drop("embedding"), vec(1, 0.3), k=9, nprobe=2, prefilter=4, diversify_seconds=None).count() == 4


def test_cells_by_size():
    assert [ivf.auto_cells(n) for n in (0, 5, 10_000, 10**6, 10**8)] == [1, 2, 100, 4096, 65536]
    assert ivf.index_string(64) == "OPQ16,IVF64,PQ16x8"


def test_index_round_trip(spark, frames, tmp_path):
    f = frames.where("site is not null")
    cent = ivf.train(f.select("global_id", "embedding"), 3)
    cells = ivf.assign(f.select("global_id", "embedding"), cent)
    ivf.write(cells, str(tmp_path / "cells"))
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert back.count() == 41
    plan = ivf.probe(back, cent, vec(1, 0), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell_id" in plan.replace("isnotnull(cell_id", "cell_id")


def test_more_queries_than_a_matrix_holds_go_in_blocks(spark, frames, monkeypatch):
    f = frames.select("global_id", "embedding")
    q = f.select(F.col("global_id").alias("query_id"), "embedding")
    cent = spark.createDataFrame([(0, vec(1, 0)), (1, vec(1, 1))], "cell_id int, centroid array<double>")
    run = lambda: (sorted(map(tuple, search.batch_top(f, q, 3).collect())), sorted(map(tuple, ivf.grid(ivf.assign(f, cent), cent, q, [1, 2], [4], 3).collect())))
    want = run()
    assert len(want[0]) == 43 * 3
    monkeypatch.setattr(search, "MOST_QUERIES", 10)
    assert run() == want


def _rows(n, seed, first=0):
    import numpy as np
    import pyarrow as pa

    x = np.random.default_rng(seed).standard_normal((n, 64)).astype(np.float32)
    x[: n // 4] = x[n // 4 : 2 * (n // 4)]  # ties
    e = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    return x, pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(np.arange(n, dtype=np.int32) % 3), e], names=["global_id", "cell_id", "embedding"])


class _Held:
    def __init__(self, value):
        self.value = value


def test_a_grid_task_sends_on_no_more_than_the_answers():
    """ivf_grid: k rows of a probe, not the whole prefilter, and those of a plain sort."""
    import numpy as np

    from lodevec.functions.arrays import unit

    x, b = _rows(3000, 1)
    q, v = unit(x[::100]), unit(x)
    rank = np.stack([np.roll(np.arange(3), i) for i in range(len(q))]).astype(np.int32)
    out = list(ivf._grid(_Held((np.arange(len(q)), q, rank, np.arange(3))), [1, 3], 10)([b.slice(0, 1700), b.slice(1700)]))
    got = sorted((m, i, -s, g) for t in out for m, i, g, s in zip(*(c.to_pylist() for c in t.columns)))
    s = np.round(q @ v.T, 6) + 0.0
    cell = np.arange(3000) % 3
    want = [(m, i, -s[i, g], g) for m in (1, 3) for i in range(len(q)) for g in sorted(np.flatnonzero(rank[i][cell] < m), key=lambda g: (-s[i, g], g))[:10]]
    assert got == sorted(want)


def _asked(monkeypatch, spark, folder, query):
    from lodevec.plans import searching

    got = []
    real = ivf.grid
    monkeypatch.setattr(ivf, "grid", lambda *a: got.append(a[3:]) or real(*a))
    getattr(searching, query)(spark, folder)
    return got


def test_score_gap_asks_for_the_best_row_of_its_own_point(spark, tiny, monkeypatch):
    assert _asked(monkeypatch, spark, tiny, "ivf_score_gap") == [([4], [200], 1)]


def test_pool_recall_asks_for_its_own_point(spark, tiny, monkeypatch):
    assert _asked(monkeypatch, spark, tiny, "ivf_pool_recall") == [([16], [200], 10)]


def _staged(monkeypatch, spark, folder, query):
    from lodevec.plans import searching

    got = []
    real = searching.stage
    monkeypatch.setattr(searching, "stage", lambda df, name: got.append(name) or real(df, name))
    getattr(searching, query)(spark, folder)
    return sorted(got)


def test_recall_scores_once_what_it_reads_several_times(spark, tiny, monkeypatch):
    assert _staged(monkeypatch, spark, tiny, "ivf_recall") == ["grid", "truth"]


def test_locality_asks_for_its_own_point(spark, tiny, monkeypatch):
    assert [x[:2] for x in _asked(monkeypatch, spark, tiny, "locality")] == [([4], [200])]


def test_order_of_kept_rows_is_that_of_a_sort_by_all_keys():
    import numpy as np

    r = np.random.default_rng(0)
    for digits, scale in ((2, 1), (6, 1), (12, 1), (2, 9)):  # ties, cosines, unrounded, no cosines
        q, g, s = r.integers(0, 50, 5000), r.permutation(5000), np.round(r.uniform(-scale, scale, 5000), digits)
        assert (search._order(q, g, s) == np.lexsort((g, -s, q))).all()


def test_locality_is_of_all_candidates_of_the_rerank(spark, tiny, monkeypatch):
    assert _asked(monkeypatch, spark, tiny, "locality") == [([4], [200], 200)]


def test_index_recall_scores_once_what_it_reads_several_times(spark, tiny, monkeypatch):
    assert _staged(monkeypatch, spark, tiny, "index_recall") == ["answers", "truth"]
