"""Clusters, neighbours, runs, subsets: against brute force on small tables, odd rows included."""

import itertools

import pytest

pytest.importorskip("lodevec.llm")

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodevec.llm import clusters, components, neighbours, runs, subset
from lodevec.llm import vectors as vec

VEC = "global_id long, embedding array<float>"


def table(spark, gids, x):
    rows = [(int(g), None if v is None else [float(f) for f in v]) for g, v in zip(gids, x)]
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0] * 3), (9005, [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    d = spark.createDataFrame(rows + odd, VEC)
    return d.unionAll(d.limit(20)).withColumn("v", F.lit("x")).withColumn("data", F.lit(1))


@pytest.fixture(scope="module")
def scenes():
    rng = np.random.default_rng(4)
    x, g = [], []
    for n in (8, 9, 30, 7):
        c = rng.standard_normal(64)
        x += [3 * (c + 0.35 * rng.standard_normal(64)) for _ in range(n)]
    x += [c for c in rng.standard_normal((150, 64))]
    x += [x[20], x[21], 2 * x[22]]  # copies
    g = rng.permutation(len(x)) + 1
    return g, np.array(x, np.float16).astype(np.float32)


def cliques(g, x, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    adj = u @ u.T >= 0.7
    seen, out = set(), []
    for i in range(len(g)):  # these components are cliques
        m = frozenset(np.flatnonzero(adj[i]))
        if m not in seen and len(m) >= least:
            seen.add(m)
            assert adj[np.ix_(list(m), list(m))].all()
            out.append(sorted(int(g[j]) for j in m))
    return sorted(out)


def test_clusters_equal_brute_force(spark, scenes):
    g, x = scenes
    want = cliques(g, x, 8)
    assert len(want) == 3
    got = clusters.find(table(spark, g, x)).collect()
    by = {}
    for r in got:
        by.setdefault((r.comp, r.nth), []).append(r.global_id)
        assert r.cluster_gid == min(s for k in [(r.comp, r.nth)] for s in [q.global_id for q in got if (q.comp, q.nth) == k])
    assert sorted(sorted(v) for v in by.values()) == want
    assert clusters.find(table(spark, [], [])).count() == 0


def test_large_components_go_block_by_block(spark, scenes, monkeypatch):
    g, x = scenes
    monkeypatch.setattr(clusters, "LARGE", 9)
    by = {}
    for r in clusters.find(table(spark, g, x)).collect():
        by.setdefault((r.comp, r.nth), []).append(r.global_id)
    assert sorted(sorted(v) for v in by.values()) == cliques(g, x, 8)


def test_loose_components_split_into_all_maximal_sets():
    rng = np.random.default_rng(0)
    for n, p in ((12, 0.5), (16, 0.7), (14, 0.85)):
        adj = rng.random((n, n)) < p
        adj = np.triu(adj, 1)
        adj = adj | adj.T | np.eye(n, dtype=bool)
        full = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if adj[np.ix_(c, c)].all()]
        maximal = sorted(sorted(c) for c in full if not any(c < d for d in full) and len(c) >= 3)
        got = sorted(sorted(int(i) for i in s) for s in clusters.maximal_sets(adj, np.ones(n, int), 3))
        assert got == maximal
        assert clusters.maximal_sets(adj, np.ones(n, int), 3, steps=1) is not None


def everything(n, adj, least):
    full = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if adj[np.ix_(c, c)].all()]
    return sorted(sorted(c) for c in full if not any(c < d for d in full) and len(c) >= least)


def test_spent_steps_lose_no_set():
    rng = np.random.default_rng(5)
    adj = np.triu(rng.random((14, 14)) < 0.75, 1)
    adj = adj | adj.T | np.eye(14, dtype=bool)
    want = everything(14, adj, 3)
    assert sorted(sorted(int(i) for i in s) for s in clusters.maximal_sets(adj, np.ones(14, int), 3, steps=2)) == want
    # the same by searches that are cut again and again
    todo, got = [clusters.search_of(adj, np.ones(14, int), ids=np.arange(14), cls=np.arange(14), u=np.zeros((14, 1)))], []
    while todo:
        w = todo.pop()
        got += [[int(w["ids"][i]) for i in clusters._ones(x)] for x in clusters.advance(w, 3, 2)]
        todo += clusters.divide(w, 3)
    assert sorted(map(sorted, got)) == want


@pytest.fixture(scope="module")
def loose():
    """Vectors in a ring, each similar to the five before and after it: twenty overlapping sets of six, one component."""
    angle = np.arange(20) * 2 * np.pi / 20
    ring = np.stack([np.cos(angle), np.sin(angle)], 1)
    x = np.zeros((20, 64), np.float32)
    x[:, :2] = ring
    x[:, 2] = np.sqrt((0.7 - np.cos(5.5 * 2 * np.pi / 20)) / 0.3)  # cosine 0.70 between the fifth and the sixth
    return np.arange(1, 21), x


@pytest.mark.parametrize("large", [30_000, 9])
def test_search_goes_on_in_further_tasks(spark, loose, monkeypatch, large):
    g, x = loose
    monkeypatch.setattr(clusters, "LARGE", large)
    comp = spark.createDataFrame([(int(i), [float(f) for f in v]) for i, v in zip(g, x)], VEC).mapInArrow(clusters._pack_rows, "global_id long, v binary").selectExpr("1L as comp", "global_id", "v", "20L as size")
    want = sorted(sorted((i + j) % 20 + 1 for j in range(6)) for i in range(20))
    if large == 9:
        got = clusters._large(comp.drop("size"), comp.select("comp", "size").distinct(), 0.7, 6)
    else:
        # work that a spent budget left over: every search untouched
        u = vec.unit(x)
        work = clusters.search_of(clusters._adjacency(g, x, u, 0.7)[1], np.ones(20, int), ids=g, cls=np.arange(20), u=u)
        rows = [(1, clusters.pickle.dumps(w | {"adj": np.packbits(w["adj"], axis=1)}, 5)) for w in clusters.divide(work)]
        todo = spark.createDataFrame(rows, "comp long, todo binary").selectExpr("comp", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in clusters.MEMBERS.split(", ")[1:]], "todo")
        got = clusters._all_sets(todo, 6)
    by = {}
    for r in got.collect():
        by.setdefault((r.comp, r.nth), []).append(r.global_id)
    assert sorted(map(sorted, by.values())) == want


@pytest.mark.parametrize("crowd", [4096, 4])
def test_links_of_a_bucket_connect_all_that_are_similar(monkeypatch, crowd):
    monkeypatch.setattr(clusters, "CROWD", crowd)
    # eight alike; two lower and two higher rows, each similar to one half of them
    e = np.eye(64)
    at = lambda angle, n: [np.cos(angle) * e[0] + np.sin(angle) * e[1]] * n
    low = [*at(-0.7227, 1), *at(1.3662, 1)]
    core = [*at(0, 4), *at(0.6435, 4)]
    rng = np.random.default_rng(0)
    for x in ([*low, *core, *low[::-1]], rng.standard_normal((300, 3)) @ e[:3], rng.standard_normal((700, 7)) @ e[:7]):
        u = vec.unit(np.array(x, np.float32))
        near = u @ u.T >= 0.7
        want = clusters.connect(len(u), *np.nonzero(near))
        assert (clusters.connect(len(u), *clusters._bucket_links(u, 0.7)) == want).all()


class Counted(np.ndarray):
    """Rows that count the cosines made of them."""

    made = 0

    def __matmul__(self, other):
        out = np.asarray(self) @ np.asarray(other)
        Counted.made += out.size
        return out


def test_a_bucket_compares_each_pair_once_and_no_rows_joined_before(monkeypatch):
    rng = np.random.default_rng(8)
    n = 1500
    u = vec.unit(rng.standard_normal((n, 9)) @ np.eye(64)[:9])
    near = u @ u.T >= 0.8
    want = clusters.connect(n, *np.nonzero(near))
    assert 1 < len(np.unique(want)) < n
    monkeypatch.setattr(Counted, "made", 0)
    assert (clusters.connect(n, *clusters._bucket_links(u.view(Counted), 0.8)) == want).all()
    assert Counted.made < 0.6 * n * n
    # links of earlier bands: the rest is joined, and nothing where all is
    i, j = (x[: len(x) // 50] for x in np.nonzero(near))
    before = clusters.connect(n, i, j)
    a, b = clusters._bucket_links(u, 0.8, before + 7000)
    assert (clusters.connect(n, np.r_[a, i], np.r_[b, j]) == want).all()
    monkeypatch.setattr(Counted, "made", 0)
    assert not len(clusters._bucket_links(u.view(Counted), 0.8, np.full(n, 3))[0]) and Counted.made == 0


@pytest.mark.parametrize("min_cos", [0.75, -0.2])
def test_buckets_of_all_sizes_link_all_that_are_similar(min_cos):
    rng = np.random.default_rng(12)
    size = np.array([30, 25, 400, 128, 26, 129, 90, 25])
    u = vec.unit(rng.standard_normal((size.sum(), 8 if min_cos > 0 else 64)) @ np.eye(64)[: 8 if min_cos > 0 else 64])
    start = np.cumsum(size) - size
    got = {(int(i), int(j)) for i, j in zip(*clusters._upper_links(u, start, size, min_cos))}
    want = {(s + i, s + j) for s, n in zip(start, size) for i, j in zip(*np.nonzero(np.triu(u[s : s + n] @ u[s : s + n].T >= min_cos, 1)))}
    assert got == {(int(i), int(j)) for i, j in want}


def test_names_and_min_hashes_equal_their_definition():
    rng = np.random.default_rng(6)
    h = clusters.Hashes(vec.unit(rng.standard_normal((600, 64))), 1, 2, 2, 0)
    u = vec.unit(rng.standard_normal((2500, 64)))
    names = h.sets(u)
    d = (u.astype(float) @ h.w + h.off).reshape(len(u), clusters.BOOKS, clusters.CENTROIDS)
    own = np.take_along_axis(d, names[:, :, None].astype(int), 2)[:, :, 0]
    assert names.dtype == np.uint8 and np.allclose(own, d.min(2), atol=1e-5)
    want = np.zeros(len(u), np.int64)
    for order in h.orders[3:5]:
        want = want * (clusters.BOOKS * clusters.CENTROIDS) + order[np.arange(clusters.BOOKS), names].min(1)
    assert (h.key(names, 3, 2) == want).all()


@pytest.mark.parametrize("small", [24, 1])
def test_few_names_in_common_break_no_link(monkeypatch, small):
    monkeypatch.setattr(clusters, "SMALL", small)
    rng = np.random.default_rng(3)
    h = clusters.Hashes(vec.unit(rng.standard_normal((500, 64))), 1, 1, 1, 0)
    monkeypatch.setattr(h, "key", lambda names, first, count: np.zeros(len(names), np.int64))  # all in one bucket
    monkeypatch.setattr(h, "sets", lambda u: np.where(np.arange(24) < 4, 0, np.arange(len(u))[:, None] % 8).astype(np.uint8))  # 4 of 24 names
    v = np.rint(vec.unit(np.eye(64)[0] + 0.05 * rng.standard_normal((6, 64))) * 127).astype(np.int8)
    data = clusters.pickle.dumps((np.arange(6), v), 5)
    got = clusters._links(h, 0.7)((pa.scalar(0), pa.scalar(0)), pa.table({"data": pa.array([data], pa.binary())}))
    assert got["a"].to_pylist() == [1, 2, 3, 4, 5] and set(got["b"].to_pylist()) == {0}


def test_large_components_know_typical_members_and_all_vectors_of_an_id(spark, monkeypatch):
    rng = np.random.default_rng(9)
    c = np.eye(64)[0]
    x = [c + 0.02 * (30 - i) / 30 * rng.standard_normal(64) for i in range(12)]
    g = [*range(1, 13)]
    g, x = [*g, 5], np.array([*x, np.eye(64)[3] * 9 - 9 * c], np.float32)  # id 5 has a second vector, unlike all others
    run = lambda: {r.global_id: (r.cluster_gid, r.n, round(r.typical, 6) if r.global_id != 5 else 0) for r in clusters._large(comp, size, 0.7, 8).collect()}
    comp = table(spark, g, x).mapInArrow(clusters._pack_rows, "global_id long, v binary").where("global_id < 9000").selectExpr("1L as comp", "global_id", "v").distinct()
    size = spark.createDataFrame([(1, 12)], "comp long, size long")
    for large in (9, 30_000):
        monkeypatch.setattr(clusters, "LARGE", large)
        got = run()
        assert set(got) == set(range(1, 13)) and all(v[:2] == (1, 12) and v[2] is not None for v in got.values())
    u = vec.unit(x[[i for i in range(12) if i != 4]])
    one = comp.where("global_id <> 5")
    got = {r.global_id: r.typical for r in clusters._large(one, spark.createDataFrame([(1, 11)], "comp long, size long"), 0.7, 8).collect()}
    assert np.allclose([got[k] for k in sorted(got)], clusters._typical(u)) and len(got) == 11


def test_two_clusters_with_a_bridge():
    rng = np.random.default_rng(2)
    a, b = np.eye(64)[0], np.eye(64)[0] * 0.6 + np.eye(64)[1] * 0.8
    x = [a + 0.01 * rng.standard_normal(64) for _ in range(9)] + [b + 0.01 * rng.standard_normal(64) for _ in range(9)] + [a + b]
    got = sorted(s.tolist() for s in clusters.clusters_of(np.arange(19), np.array(x, np.float32), 0.7, 8))
    assert got == [[*range(9), 18], [*range(9, 18), 18]]


def test_components(spark):
    e = [(1, 2), (3, 2), (5, 4), (4, 5), (7, 7), (None, 1)] + [(i, i + 1) for i in range(100, 180)]
    d = components.components(spark.createDataFrame(e, "a long, b long"))
    got = {r.node: r.root for r in d.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 181)}


def brute_near(g, x, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    return {int(g[i]): [int(g[j]) for j in np.lexsort((g, -np.round(s[i], 9)))[:k]] for i in range(len(g))}, s


def test_walk_is_ordered_and_batches_agree():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random((5, 8)), rng.random((5, 8))
    i, j, s = neighbours.walks(d1, d2, 20)
    for q in range(5):
        w = list(itertools.islice(neighbours.walk(d1[q], d2[q]), 20))
        assert np.allclose([x[2] for x in w], s[q]) and [(x[0], x[1]) for x in w] == list(zip(i[q].tolist(), j[q].tolist()))
        assert len(list(neighbours.walk(d1[q], d2[q]))) == 64


@pytest.mark.parametrize("n,k1,k2,cells", [(9, 4, 4, 16), (9, 7, 5, 20), (5, 32, 32, 300), (6, 3, 9, 100), (8, 16, 16, 8), (4, 1, 1, 5), (0, 4, 4, 3)])
def test_heaps_in_step_pop_in_order(n, k1, k2, cells):
    rng = np.random.default_rng(n + k1)
    d1, d2 = rng.random((n, k1)).astype(np.float32), rng.random((n, k2)).astype(np.float32)
    i, j, s = neighbours.walks(d1, d2, cells)
    assert i.shape == (n, min(cells, k1 * k2))
    for q in range(n):
        w = list(itertools.islice(neighbours.walk(d1[q], d2[q]), cells))
        assert np.allclose([x[2] for x in w], s[q]) and len(set(zip(i[q].tolist(), j[q].tolist()))) == len(w)


def test_recall_at_the_settings_of_the_queries(spark, monkeypatch):
    """256 cells, as many as 33,000 rows have: the pairs' settings, and a quarter of the cells for lists."""
    from lodevec.llm import queries as q

    monkeypatch.setattr(neighbours, "PER_CELL", 4)
    rng = np.random.default_rng(3)
    scenes = rng.standard_normal((80, 64))
    x = np.concatenate([scenes[i // 6] + 0.25 * rng.standard_normal(64) for i in range(480)] + [rng.standard_normal(64) for _ in range(300)]).reshape(-1, 64).astype(np.float32)
    v = table(spark, np.arange(1, len(x) + 1), x)
    exact = set(map(tuple, neighbours.mutual(neighbours.nearest(v, k=10, min_score=0.93, cells=None, slack=1.0)).collect()))
    got = set(map(tuple, neighbours.mutual(neighbours.nearest(v, k=10, min_score=0.93, cells=q.P3_FOUND_CELLS, slack=q.P3_FOUND_SLACK)).collect()))
    assert len(exact) > 300 and len(got ^ exact) <= 0.01 * len(exact)
    truth = {(r.src, r.dst) for r in neighbours.brute_force(v, 5, 10).collect()}
    near = {(r.src, r.dst) for r in neighbours.nearest(v, k=10, cells=64, query_step=5).collect()}
    assert len(truth & near) >= 0.7 * len(truth)


def test_all_cells_give_exact_neighbours(spark, scenes):
    g, x = scenes
    want, _ = brute_near(g, x, 5)
    got = neighbours.nearest(table(spark, g, x), k=5, cells=10_000).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.src, []).append(r.dst)
    same = sum(set(by[i]) == set(want[i]) for i in want)
    assert set(by) == set(want) and same >= len(want) - 3  # ties of scaled copies may fall either way
    exact = neighbours.brute_force(table(spark, g, x), 10, 5)
    one = neighbours.nearest(table(spark, g, x), k=5, cells=10_000, query_step=10)
    assert exact.select("src", "rank", "dst").exceptAll(one.select("src", "rank", "dst")).count() <= 2


def test_mutual_pairs_with_many_copies(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal(64)
    x = np.array([v] * 15 + [*rng.standard_normal((40, 64))], np.float32)
    g = np.arange(1, 56)
    got = {(r.gid_a, r.gid_b) for r in neighbours.mutual(neighbours.nearest(table(spark, g, x), k=10, min_score=0.95)).collect()}
    assert got == set(itertools.combinations(range(1, 12), 2))  # the eleven lowest are each other's ten nearest
    assert neighbours.nearest(table(spark, [], [])).count() == 0


def test_pack_is_lossless():
    x = np.array([[0.1] * 64, [0.5] * 64, [1e30] + [0.0] * 63, [1e-40] * 64], np.float32)
    half, single, h = vec.pack(x)
    assert h.tolist() == [False, True, False, False] and (vec.unpack(half, single, h) == x).all()
    assert np.allclose(np.linalg.norm(vec.unit(x), axis=1), 1, atol=1e-6)


HITS = "hit_id long, query_id long, hit_rank int, global_id long, score double, site string, time_ns long"


def brute_runs(rows):
    ok = {}
    for h, q, _, g, s, site, t in rows:
        if site is None or t is None or s is None or s != s:
            continue
        k = (q, site.strip().lower(), t, g)
        if k not in ok or h < ok[k][0]:
            ok[k] = (h, s)
    seqs = {}
    for (q, site, t, g), (_, s) in ok.items():
        seqs.setdefault((q, site), []).append((t, g is not None, g or 0, s))
    out = []
    for (q, site), seq in seqs.items():
        seq.sort()
        run = [seq[0]]
        for a, b in zip(seq, seq[1:]):
            if b[0] - a[0] <= 60 * 10**9 and abs(b[3] - a[3]) <= 0.001:
                run.append(b)
            else:
                out.append((q, site, run[0][0], run[-1][0], len(run)))
                run = [b]
        out.append((q, site, run[0][0], run[-1][0], len(run)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slab", [10**9, 7 * 10**10, 3_600_000_000_000, 10**15])
def test_runs_equal_brute_force_for_any_slab(spark, slab):
    rng = np.random.default_rng(6)
    rows = []
    for h in range(600):
        t = int(rng.integers(0, 400)) * 10 * 10**9 if rng.random() > 0.03 else None
        s = float(rng.choice([0.5, 0.5005, 0.502, float("nan")], p=[0.5, 0.3, 0.17, 0.03]))
        rows.append((h, int(rng.integers(0, 2)) if rng.random() > 0.05 else None, 1, int(rng.integers(0, 3)) if rng.random() > 0.05 else None, s if rng.random() > 0.02 else None, str(rng.choice(["aa", " AA\t", "bb"])) if rng.random() > 0.03 else None, t))
    d = spark.createDataFrame(rows, HITS).withColumn("slab", F.lit(1)).withColumn("pos", F.lit("x"))
    got = sorted(((r.query_id, r.site, r.start_ns, r.end_ns, r.n_hits) for r in runs.collapse(d, slab_ns=slab).collect()), key=str)
    assert got == brute_runs(rows)
    assert runs.collapse(d.where("false")).count() == 0


MAN = "global_id long, site string, time_ns long, shard_path string, frame_idx int"
T0 = subset.FLOOR_NS


def test_subset_covers_and_levels(spark):
    rows = [(i, " A " if i % 2 else "a", T0 + i * 10**9, None, None) for i in range(700)]  # a crowded day
    rows += [(1000 + i, "b", T0 + subset.DAY_NS * i, None, None) for i in range(12)] + [(2000, "c", T0 - 1, None, None), (2001, None, T0, None, None), (2002, "c", None, None, None), (None, "d", T0, None, None), (1000, "b", T0, None, None)]
    m = spark.createDataFrame(rows, MAN).withColumn("day", F.lit("x")).withColumn("node", F.lit(1)).repartition(5)
    for k in (0, 3, 14, 30, 10_000):
        got = subset.choose(m, k=k).collect()
        assert len(got) == min(k, 713) and len({(r.global_id, r.site, r.time_ns) for r in got}) == len(got)
        if k >= 14:
            assert len({(r.site, r.obs_day) for r in got}) == 14
        if k == 30:
            assert sum(r.site == "a" for r in got) == 30 - 13
    three = subset.choose(m, k=3).collect()
    assert {r.site for r in three} == {"a", "b", "d"}  # every site before any has two
    five = subset.choose(m, k=5).collect()
    assert len({(r.site, r.obs_day) for r in five}) == 5 and sum(r.site == "b" for r in five) == 3
    assert subset.choose(m.where("false"), k=5).count() == 0
    req = spark.createDataFrame([("r", 100), ("none", None)], "request_name string, share_permille int")
    assert subset.requested(m, req).count() == 72
    assert subset.requested(m, req.where("false")).count() == 0


def test_few_picks_reach_all_sites_and_spread_over_the_years(spark):
    rows = [(s * 1000 + d, f"s{s}", T0 + d * 30 * subset.DAY_NS, None, None) for s in range(6) for d in range(60 if s == 0 else 12)]
    m = spark.createDataFrame(rows, MAN)
    assert {r.site for r in subset.choose(m, k=6).collect()} == {f"s{s}" for s in range(6)}
    got = [r for r in subset.choose(m, k=24).collect()]
    assert {s: sum(r.site == s for r in got) for s in {r.site for r in got}} == {f"s{s}": 4 for s in range(6)}
    days = sorted((r.time_ns - T0) // subset.DAY_NS for r in got if r.site == "s0")
    assert days[-1] - days[0] > 600  # not one season


def test_pivots_are_independent_before_they_repeat():
    t = T0 + np.arange(0, 86400, 600) * 10**9
    f = subset.features(t)
    at, size = subset.pivots(f, 16)
    assert len(set(at.tolist())) == 16 and np.linalg.matrix_rank(f[at[:8]]) == 8 and np.linalg.matrix_rank(f[at[8:16]]) == 8
    assert (np.diff(size[:8]) <= 1e-9).all()
    assert subset.level([(1, 5), (10, 2)], 9) == (2, 0) and subset.level([(1, 5), (10, 2)], 3) == (0, 3) and subset.level([], 4) == (0, 0)
