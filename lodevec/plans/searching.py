"""Queries on search: exact, threshold, filtered, batch, by index; with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodevec.functions import vector as vec
from lodevec import engine
from lodevec.operators import ivf, metrics, sample, search, validate
from lodevec.operators.filters import in_windows
from lodevec.plans.common import COS, QSET, M, Q, V, first_query, frames, manifest, query_set, stored_frames, stored_manifest, stored_vectors, table, usable_vectors, vectors
from lodevec.session import stage

SITES = ["brqu", "dovr", "fjoa"]
WINDOWS = [(1136073600000000000, 1137283199999999999), (1138752000000000000, 1139961599999999999)]  # two fortnights of 2006
IN_WINDOWS = " OR ".join(f"time_ns BETWEEN {a} AND {b}" for a, b in WINDOWS)
IN_SITES = ", ".join(f"'{s}'" for s in SITES)
CELLS, PROBE, PREFILTER, K = 16, 4, 500, 24


def search_exact(spark, folder):
    v = stored_vectors(spark, folder)
    return search.search_split(stored_manifest(spark, folder), v, first_query(v), k=K, diversify_seconds=None)


def search_diversified(spark, folder):
    v = stored_vectors(spark, folder)
    return search.search_split(stored_manifest(spark, folder), v, first_query(v), k=K, diversify_seconds=30)


def search_threshold(spark, folder):
    v = stored_vectors(spark, folder)
    return search.search_split(stored_manifest(spark, folder), v, first_query(v), min_score=0.3, diversify_seconds=None)


def search_filtered(spark, folder):
    f = stored_frames(spark, folder)
    return search.search(f, first_query(stored_vectors(spark, folder)), k=K, diversify_seconds=3600, sites=SITES, windows=WINDOWS)


def search_export(spark, folder):
    return search.export(search_filtered(spark, folder))


def search_by_address(spark, folder):
    """The query frame by its address, then the export table."""
    v = stored_vectors(spark, folder)
    m = stored_manifest(spark, folder)
    have = m.where("site is not null and time_ns is not null and frame_idx is not null").join(usable_vectors(spark, folder).select("global_id"), "global_id", "left_semi")
    at = have.selectExpr("site", "date_format(timestamp_micros(time_ns div 1000), 'yyyyMMddHH') as h", "frame_idx").orderBy("site", "h", "frame_idx").first()
    return search.query(m, v, at.site, at.h, at.frame_idx, k=10, diversify_seconds=None)


def lookup_hits(spark, folder):
    """Reported hits with the manifest's own attributes."""
    h = table(spark, folder, "hits").select("hit_id", "query_id", "global_id", "score")
    return h.join(manifest(spark, folder), "global_id").select("hit_id", "query_id", "global_id", "site", "time_ns", "shard_path", "frame_idx")


def frames_in_windows(spark, folder):
    w = spark.createDataFrame(WINDOWS + [(WINDOWS[0][0] + 10**9, WINDOWS[0][1] + 10**14), (5, 1)], "start_ns long, end_ns long")
    return in_windows(manifest(spark, folder).where("time_ns is not null"), w).select("global_id", "site", "time_ns").distinct()


def batch_topk(spark, folder):
    v = vectors(spark, folder)
    return search.batch_top(v, query_set(v), 10)


def batch_topk_others(spark, folder):
    v = vectors(spark, folder)
    return search.batch_top(v, query_set(v), 10, skip_self=True)


def self_retrieval(spark, folder):
    v = vectors(spark, folder)
    q = query_set(v)
    return validate.self_retrieval(q, search.batch_top(v, q, 10))


def vector_norms(spark, folder):
    v = vectors(spark, folder)
    n = vec.normalise("embedding")
    return v.select("global_id", F.round(vec.norm("embedding"), 6).alias("norm"), F.round(n[0], 6).alias("first"), F.round(vec.norm(n), 6).alias("unit_norm"), F.round(vec.dot("embedding", "embedding"), 6).alias("self_dot"))


def contrast_stretch(spark, folder):
    v = vectors(spark, folder).select("global_id", vec.stretch("embedding").alias("s"))
    return v.select("global_id", F.round(F.array_min("s"), 6).alias("lo"), F.round(F.array_max("s"), 6).alias("hi"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def masked_stretch(spark, folder):
    """Each vector as an 8 x 8 image: stretched, then cut to its disc, then at 4 x 4."""
    v = vectors(spark, folder).select("global_id", vec.disc(vec.stretch("embedding"), 8).alias("d"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return v.select("global_id", F.round(total("d"), 5).alias("total"), F.round(F.col("d")[0], 6).alias("corner"), F.round(4 * total(vec.resize("d", 8, 4)), 5).alias("small_total"))  # a small pixel is the mean of four


def _cells(spark, folder):
    """The vectors by their nearest of 16 stored vectors, those of the lowest keys (cells that SQL can name as well): made once, read by cell."""
    source = f"{folder}/frame_vectors.parquet"

    def centroids():
        one = usable_vectors(spark, folder).withColumn("k", sample.key("global_id", 7))
        low = one.groupBy("global_id", "k").agg(F.min("embedding").alias("embedding")).orderBy("k", "global_id").limit(CELLS).collect()
        return spark.createDataFrame([(i, [float(x) for x in r.embedding]) for i, r in enumerate(low)], "cell_id int, centroid array<double>").coalesce(1)

    c = engine.derived(spark, "cells16-centroids", [source], centroids)
    return engine.derived(spark, "cells16", [source], lambda: ivf.assign(vectors(spark, folder), c).repartition("cell_id"), ("cell_id",)), c


def ivf_cells(spark, folder):
    return _cells(spark, folder)[0].select("global_id", "cell_id")


def ivf_search(spark, folder):
    cells, c = _cells(spark, folder)
    return ivf.search(cells, c, stored_manifest(spark, folder), first_query(stored_vectors(spark, folder)), k=K, nprobe=PROBE, prefilter=PREFILTER, diversify_seconds=None)


def ivf_filtered(spark, folder):
    """A filtered subset above the exact limit: probed within the filter."""
    cells, c = _cells(spark, folder)
    return ivf.filtered_search(cells, c, stored_manifest(spark, folder), first_query(stored_vectors(spark, folder)), k=K, nprobe=PROBE, prefilter=PREFILTER, sites=SITES, windows=WINDOWS, exact_rows=0, diversify_seconds=None)


def _grid(spark, folder, nprobes=(1, 4, 16), prefilters=(20, 200), k=10):
    """All usable vectors, the stated queries and their answers at these operating points."""
    cells, c = _cells(spark, folder)
    v = cells.select("global_id", "embedding")
    q = query_set(v)
    return v, q, ivf.grid(cells, c, q, nprobes, prefilters, k)


def ivf_grid(spark, folder):
    return _grid(spark, folder)[2].drop("rank")


def ivf_recall(spark, folder):
    v, q, g = _grid(spark, folder, [1, 4, 16], [20, 200])
    per = metrics.recall(stage(search.batch_top(v, q, 10), "truth"), stage(g, "grid"), ("nprobe", "prefilter"))  # both are read several times
    s = metrics.recall_summary(per, ("nprobe", "prefilter"))
    return s.select("nprobe", "prefilter", "n", F.round("mean", 6).alias("mean"), F.round("p10", 6).alias("p10"), F.round("min", 6).alias("min"), F.round("top1_rate", 6).alias("top1_rate"))


def ivf_score_gap(spark, folder):
    """Of the best scores, so the best row of each query is enough."""
    v, q, one = _grid(spark, folder, [4], [200], 1)
    d = metrics.score_gap(search.batch_top(v, q, 1), one)
    return d.select(F.round("mean_gap", 6).alias("mean_gap"), F.round("max_gap", 6).alias("max_gap"))


def ivf_pool_recall(spark, folder):
    """Recall within a sampled pool: the index answers are cut to the pool first."""
    v, q, g = _grid(spark, folder, [16], [200])
    pool = stage(sample.uniform(v.select("global_id").distinct(), 2000, seed=3), "pool")
    truth = stage(search.batch_top(v.join(F.broadcast(pool), "global_id", "left_semi"), q, 10), "truth")
    a = stage(g.join(F.broadcast(pool), "global_id", "left_semi"), "grid")
    return metrics.recall(truth, search.ranked(a.select("query_id", "global_id", "score"), ("query_id",))).select("query_id", "n_truth", "n_hit")


def ivf_trained(spark, folder):
    """Cells by k-means: sizes of the cells (no SQL can fit them)."""
    v = vectors(spark, folder)
    n = ivf.auto_cells(v.count())
    c = ivf.train(sample.uniform(v, 64 * n, seed=1), n)  # 64 vectors a cell, however many cells
    return ivf.assign(v, c).groupBy("cell_id").agg(F.count("*").alias("n"))


def _books(v):
    one = v.groupBy("global_id").agg(F.min("embedding").alias("embedding"))
    rows = one.withColumn("k", sample.key("global_id", 9)).orderBy("k", "global_id").limit(16).collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    return np.stack([x[:, m * 8 : (m + 1) * 8] for m in range(8)])


def pq_scores(spark, folder):
    v = vectors(spark, folder)
    b = _books(v)
    return ivf.code_scores(ivf.encode(v, b), b, first_query(stored_vectors(spark, folder)))


def locality(spark, folder):
    """Of all candidates that the operating point hands to the rerank, not only the answers."""
    v, q, g = _grid(spark, folder, [4], [200], 200)
    return metrics.locality(g, v.count()).select("query_id", "runs", F.round("span_share", 6).alias("span_share"))


def index_search(spark, folder):
    """The written index, by codes and then exactly."""
    return engine.index(spark, folder).search(stored_manifest(spark, folder), first_query(stored_vectors(spark, folder)), k=K, nprobe=64, prefilter=PREFILTER, diversify_seconds=30)


def index_header(spark, folder):
    """What the written index says of itself, against its rows."""
    i = engine.index(spark, folder)
    rows = i.rows.agg(F.count("*").alias("n_rows"), F.count_distinct("cell_id").alias("filled"), F.bool_and(F.size("codes") == i.header["parts"]).alias("coded"))
    return rows.select("n_rows", F.lit(i.header["dim"]).alias("dim"), "coded", (F.col("n_rows") == i.header["n"]).alias("counts_agree"), (F.col("filled") <= i.header["cells"]).alias("cells_agree"))


def _index_answers(spark, folder):
    q = query_set(vectors(spark, folder))
    return q, engine.index(spark, folder).batch(q, k=10, nprobe=64, prefilter=PREFILTER)


def index_self_retrieval(spark, folder):
    """Self-retrieval through the codes."""
    q, a = _index_answers(spark, folder)
    return validate.self_retrieval(q, a)


def index_recall(spark, folder):
    """Recall@10 of the two stages and of the codes alone, against brute force: above the least allowed, and the rerank no worse."""
    q, a = _index_answers(spark, folder)
    a, truth = stage(a, "answers"), stage(search.batch_top(vectors(spark, folder), q, 10), "truth")  # both are read several times
    two = metrics.recall_summary(metrics.recall(truth, a.where("rank <= 10")))
    raw = metrics.recall_summary(metrics.recall(truth, a.where("approx_rank <= 10").withColumn("rank", F.col("approx_rank"))))
    return two.crossJoin(raw.select(F.col("mean").alias("raw_mean"))).select("n", (F.col("mean") >= 0.9).alias("enough"), (F.col("mean") >= F.col("raw_mean")).alias("no_worse"))  # one row each


def index_filtered(spark, folder):
    """A filtered search through the index that is small enough to be scanned exactly."""
    return engine.index(spark, folder).search(stored_manifest(spark, folder), first_query(stored_vectors(spark, folder)), k=K, sites=SITES, windows=WINDOWS, diversify_seconds=3600)


_RANK = "row_number() OVER (ORDER BY score DESC, global_id)"
_FRAMES = f"{M}, {V}, f AS (SELECT m.*, embedding FROM m JOIN v USING (global_id)), {Q}"
_SCORED = f"WITH RECURSIVE {_FRAMES}, s AS (SELECT global_id, {COS} AS score, site, time_ns, shard_path, frame_idx FROM f, q"
_OUT = "global_id, score, site, time_ns, shard_path, frame_idx"


def _top_sql(where: str, limit: int) -> str:
    return f"{_SCORED} {where}) SELECT CAST(r AS INTEGER) AS rank, {_OUT} FROM (SELECT {_RANK} AS r, * FROM s) WHERE r <= {limit}"


def _fold_sql(where: str, limit: int, seconds: int) -> str:
    item = ", ".join(f"{c} := r.{c}" for c in ("global_id", "score", "site", "time_ns", "shard_path", "frame_idx"))
    return f"""{_SCORED} {where}), r AS (SELECT {_RANK} AS n, * FROM s),
step AS (
  SELECT 0::BIGINT AS n, []::STRUCT(global_id BIGINT, score DOUBLE, site VARCHAR, time_ns BIGINT, shard_path VARCHAR, frame_idx INTEGER)[] AS kept
  UNION ALL
  SELECT r.n, CASE WHEN len(list_filter(step.kept, lambda y: coalesce(y.site = r.site AND abs(y.time_ns - r.time_ns) <= {seconds}000000000, false))) > 0
    THEN step.kept ELSE list_append(step.kept, struct_pack({item})) END
  FROM step JOIN r ON r.n = step.n + 1 WHERE len(step.kept) < {limit}
), last AS (SELECT kept FROM step ORDER BY n DESC LIMIT 1),
flat AS (SELECT unnest(kept) AS h, unnest(range(1, len(kept) + 1)) AS i FROM last)
SELECT CAST(i AS INTEGER) AS rank, h.global_id, h.score, h.site, h.time_ns, h.shard_path, h.frame_idx FROM flat"""


_FILTER = f"WHERE site IN ({IN_SITES}) AND ({IN_WINDOWS})"
_BATCH = f"""WITH {V}, {QSET}, s AS (SELECT query_id, global_id, {COS} AS score FROM v, qs {{where}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, global_id, score FROM r WHERE n <= 10"""
_URL = "'https://example.org/asi/' || site || '/' || strftime(make_timestamp(time_ns // 1000), '%Y') || '/asi_l1_' || site || '_' || strftime(make_timestamp(time_ns // 1000), '%Y%m%d%H') || '_v01.cdf'"
_EXPORT = f"SELECT site, strftime(make_timestamp(time_ns // 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS datetime, score, {_URL} AS source_cdf"
_CENT = f"""WITH {M}, {V}, one AS (SELECT global_id, min(embedding) AS embedding FROM v GROUP BY global_id),
cent AS (SELECT CAST(row_number() OVER (ORDER BY md5('7:' || global_id), global_id) - 1 AS INTEGER) AS cell_id, embedding AS centroid FROM one
  QUALIFY cell_id < {CELLS}),
cs AS (SELECT v.global_id, v.embedding, cell_id, round(list_cosine_similarity(v.embedding, centroid), 6) AS c FROM v, cent),
cells AS (SELECT global_id, embedding, cell_id FROM cs QUALIFY row_number() OVER (PARTITION BY global_id, embedding ORDER BY c DESC, cell_id) = 1)"""
_PROBED = f"""{_CENT}, {Q}, near AS (SELECT cell_id FROM cent, q ORDER BY round(list_cosine_similarity(centroid, qv), 6) DESC, cell_id LIMIT {PROBE})"""
_GRID = f"""{_CENT}, {QSET},
qc AS (SELECT query_id, qv, cell_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv, centroid), 6) DESC, cell_id) - 1 AS cell_rank FROM qs, cent),
cand AS (SELECT query_id, cell_rank, global_id, {COS} AS score FROM cells JOIN qc USING (cell_id)),
p AS (SELECT CAST(nprobe AS INTEGER) AS nprobe, query_id, global_id, score, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY score DESC, global_id) AS rank
  FROM cand, (VALUES (1), (4), (16)) t(nprobe) WHERE cell_rank < nprobe),
g AS (SELECT nprobe, CAST(prefilter AS INTEGER) AS prefilter, query_id, rank, global_id, score FROM p, (VALUES (20), (200)) t(prefilter) WHERE rank <= prefilter AND rank <= 10),
truth AS (SELECT query_id, global_id, {COS} AS score FROM v, qs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) <= 10),
best AS (SELECT query_id, arg_min(global_id, (-score, global_id)) AS top, max(score) AS s FROM truth GROUP BY query_id)"""

QUERIES = {
    f.__name__: f
    for f in (search_exact, search_diversified, search_threshold, search_filtered, search_export, search_by_address, lookup_hits, frames_in_windows, batch_topk, batch_topk_others, self_retrieval,
              vector_norms, contrast_stretch, masked_stretch, ivf_cells, ivf_search, ivf_filtered, ivf_grid, ivf_recall, ivf_score_gap, ivf_pool_recall, ivf_trained, pq_scores, locality, index_search, index_header, index_self_retrieval, index_recall, index_filtered)
}
SQL = {
    "search_exact": _top_sql("", K),
    "search_threshold": _top_sql(f"WHERE {COS} >= 0.3", 2000),
    "search_diversified": _fold_sql("", K, 30),
    "search_filtered": _fold_sql(_FILTER, K, 3600),
    "search_export": f"{_EXPORT} FROM ({_fold_sql(_FILTER, K, 3600)})",
    "search_by_address": f"""WITH {M}, {V}, f AS (SELECT m.*, embedding FROM m JOIN v USING (global_id)),
adr AS (SELECT site, strftime(make_timestamp(time_ns // 1000), '%Y%m%d%H') AS h, frame_idx FROM f WHERE site IS NOT NULL AND time_ns IS NOT NULL AND frame_idx IS NOT NULL ORDER BY 1, 2, 3 LIMIT 1),
id AS (SELECT min(global_id) AS global_id FROM m, adr WHERE m.site = adr.site AND strftime(make_timestamp(m.time_ns // 1000), '%Y%m%d%H') = adr.h AND m.frame_idx = adr.frame_idx),
q AS (SELECT min(embedding) AS qv FROM v JOIN id USING (global_id)),
s AS (SELECT global_id, {COS} AS score, site, time_ns FROM f, q ORDER BY score DESC, global_id LIMIT 10)
{_EXPORT} FROM s""",
    "lookup_hits": f"WITH {M} SELECT hit_id, query_id, global_id, m.site, m.time_ns, m.shard_path, m.frame_idx FROM hits JOIN m USING (global_id)",
    "frames_in_windows": f"WITH {M} SELECT DISTINCT global_id, site, time_ns FROM m WHERE time_ns IS NOT NULL AND ({IN_WINDOWS} OR time_ns BETWEEN {WINDOWS[0][0] + 10**9} AND {WINDOWS[0][1] + 10**14})",
    "batch_topk": _BATCH.format(where=""),
    "batch_topk_others": _BATCH.format(where="WHERE query_id <> global_id"),
    "self_retrieval": f"""WITH {V}, {QSET}, s AS (SELECT query_id, global_id, {COS} AS score FROM v, qs),
b AS (SELECT query_id, arg_min(global_id, (-score, global_id)) AS best, max(score) AS m, max(CASE WHEN global_id = query_id THEN score END) AS own FROM s GROUP BY query_id)
SELECT count(*) AS n, avg(CASE WHEN best = query_id OR own = m THEN 1.0 ELSE 0.0 END) AS self_share FROM b""",
    "index_header": f"WITH {V} SELECT count(*) AS n_rows, 64 AS dim, true AS coded, true AS counts_agree, true AS cells_agree FROM v",
    "index_self_retrieval": f"WITH {V}, {QSET} SELECT count(DISTINCT query_id) AS n, CAST(1.0 AS DOUBLE) AS self_share FROM qs",
    "index_recall": f"WITH {V}, {QSET} SELECT count(DISTINCT query_id) AS n, true AS enough, true AS no_worse FROM qs",
    "index_filtered": _fold_sql(_FILTER, K, 3600),
    "vector_norms": f"""WITH {V}, n AS (SELECT global_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS norm FROM v)
SELECT global_id, round(norm, 6) AS norm, round(embedding[1] / norm, 6) AS first, round(sqrt(list_sum(list_transform(embedding, lambda x: (x / norm) * (x / norm)))), 6) AS unit_norm, round(norm * norm, 6) AS self_dot FROM n""",
    "contrast_stretch": f"""WITH {V}, p AS (SELECT global_id, embedding, list_aggregate(embedding, 'quantile_cont', 0.01) AS a, list_aggregate(embedding, 'quantile_cont', 0.99) AS b FROM v),
s AS (SELECT global_id, list_transform(embedding, lambda x: CASE WHEN b > a THEN least(greatest((x - a) / (b - a), 0.0), 1.0) ELSE 0.0 END) AS s FROM p)
SELECT global_id, round(list_min(s), 6) AS lo, round(list_max(s), 6) AS hi, round(list_sum(s), 5) AS total FROM s""",
    "masked_stretch": f"""WITH {V}, p AS (SELECT global_id, embedding, list_aggregate(embedding, 'quantile_cont', 0.01) AS a, list_aggregate(embedding, 'quantile_cont', 0.99) AS b FROM v),
s AS (SELECT global_id, list_transform(range(64), lambda i: CASE WHEN (i % 8 - 3.5) ** 2 + (i // 8 - 3.5) ** 2 <= 16 AND b > a THEN least(greatest((embedding[i + 1] - a) / (b - a), 0.0), 1.0) ELSE 0.0 END) AS d FROM p)
SELECT global_id, round(list_sum(d), 5) AS total, round(d[1], 6) AS corner, round(list_sum(d), 5) AS small_total FROM s""",
    "ivf_cells": f"{_CENT} SELECT global_id, cell_id FROM cells",
    "ivf_search": f"""{_PROBED}, pool AS (SELECT global_id, {COS} AS score FROM cells, q WHERE cell_id IN (SELECT cell_id FROM near) ORDER BY score DESC, global_id LIMIT {PREFILTER}),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, global_id) AS n FROM pool JOIN m USING (global_id))
SELECT CAST(n AS INTEGER) AS rank, {_OUT} FROM r WHERE n <= {K}""",
    "ivf_filtered": f"""{_PROBED}, pool AS (SELECT m.*, {COS} AS score FROM cells JOIN m USING (global_id), q {_FILTER} AND cell_id IN (SELECT cell_id FROM near) ORDER BY score DESC, global_id LIMIT {PREFILTER}),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, global_id) AS n FROM pool)
SELECT CAST(n AS INTEGER) AS rank, {_OUT} FROM r WHERE n <= {K}""",
    "ivf_grid": f"{_GRID} SELECT nprobe, prefilter, query_id, global_id, score FROM g",
    "ivf_recall": f"""{_GRID}, pts AS (SELECT DISTINCT nprobe, prefilter FROM g),
hit AS (SELECT nprobe, prefilter, query_id, count(*) AS h FROM g JOIN truth USING (query_id, global_id) GROUP BY ALL),
lead1 AS (SELECT nprobe, prefilter, query_id, global_id AS a FROM g WHERE rank = 1),
per AS (SELECT nprobe, prefilter, b.query_id, coalesce(h, 0) / (SELECT count(*) FROM truth t WHERE t.query_id = b.query_id) AS r, CASE WHEN a = top THEN 1.0 ELSE 0.0 END AS t1
  FROM best b CROSS JOIN pts LEFT JOIN hit USING (nprobe, prefilter, query_id) LEFT JOIN lead1 USING (nprobe, prefilter, query_id))
SELECT nprobe, prefilter, count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.1), 6) AS p10, round(min(r), 6) AS min, round(avg(t1), 6) AS top1_rate FROM per GROUP BY nprobe, prefilter""",
    "ivf_score_gap": f"{_GRID} SELECT round(avg(s - score), 6) AS mean_gap, round(max(s - score), 6) AS max_gap FROM g JOIN best USING (query_id) WHERE rank = 1 AND nprobe = 4 AND prefilter = 200",
    "ivf_pool_recall": f"""{_GRID}, pool AS (SELECT DISTINCT global_id, md5('3:' || global_id) AS k FROM v ORDER BY k, global_id LIMIT 2000),
pt AS (SELECT query_id, global_id, {COS} AS score FROM v, qs WHERE global_id IN (SELECT global_id FROM pool) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) <= 10),
a AS (SELECT query_id, global_id FROM g WHERE nprobe = 16 AND prefilter = 200 AND global_id IN (SELECT global_id FROM pool))
SELECT query_id, count(*) AS n_truth, count(a.global_id) AS n_hit FROM pt LEFT JOIN a USING (query_id, global_id) GROUP BY query_id""",
    "pq_scores": f"""WITH {V}, {Q}, one AS (SELECT global_id, min(embedding) AS e FROM v GROUP BY global_id),
bk AS (SELECT row_number() OVER (ORDER BY md5('9:' || global_id), global_id) - 1 AS code, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM one QUALIFY code < 16),
u AS (SELECT global_id, embedding, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS e FROM v),
qn AS (SELECT list_transform(qv, lambda x: x / sqrt(list_sum(list_transform(qv, lambda y: y * y)))) AS e FROM q),
parts AS (SELECT unnest(range(8)) AS p),
c AS (SELECT u.global_id, u.embedding, p, code, list_distance(u.e[8 * p + 1 : 8 * p + 8], bk.e[8 * p + 1 : 8 * p + 8]) AS d, list_inner_product(qn.e[8 * p + 1 : 8 * p + 8], bk.e[8 * p + 1 : 8 * p + 8]) AS x FROM u, bk, qn, parts),
b AS (SELECT global_id, embedding, p, x FROM c QUALIFY row_number() OVER (PARTITION BY global_id, embedding, p ORDER BY d, code) = 1)
SELECT global_id, round(sum(x), 6) AS score FROM b GROUP BY global_id, embedding""",
    "locality": f"""{_GRID}, c AS (SELECT query_id, global_id, lag(global_id) OVER (PARTITION BY query_id ORDER BY global_id) AS p FROM p WHERE nprobe = 4 AND rank <= 200)
SELECT query_id, CAST(sum(CASE WHEN p IS NULL OR global_id - p > 1 THEN 1 ELSE 0 END) AS BIGINT) AS runs, round((max(global_id) - min(global_id)) / (SELECT count(*) FROM v), 6) AS span_share FROM c GROUP BY query_id""",
}
