"""An inverted-file index: centroids, cells, probes with exact rerank, and product codes.

An index is two tables, ``centroids(cell_id, centroid)`` and ``cells(cell_id, global_id, embedding)``,
the second written partitioned by ``cell_id`` so that a probe prunes to its cells. The centroid table
is bounded (``MOST_CELLS``, checked) and travels to the tasks; rows never do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.functions.arrays import unit
from lodevec.operators import search as S
from lodevec.operators.filters import select

MOST_CELLS = 65_536
EXACT_ROWS = 4_000_000  # filtered subsets up to this size are scanned exactly
ESCALATE = 16


def auto_cells(n: int) -> int:
    """Number of cells for n vectors."""
    if n >= 100_000_000:
        return 65_536
    if n >= 1_000_000:
        return 4096
    return max(1, min(4096, int(n**0.5)))


def index_string(cells: int, parts: int = 16, codes: int = 256) -> str:
    """The index layout by name: rotation, number of cells, parts and bits of the codes."""
    return f"OPQ{parts},IVF{cells},PQ{parts}x{(codes - 1).bit_length()}"


def train(sample: DataFrame, cells: int, seed: int = 0) -> DataFrame:
    """Centroids by spherical k-means on a sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = sample.where(V.usable("embedding")).select(array_to_vector(V.normalise("embedding")).alias("features"))
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10, initMode="random").fit(d.cache())
    d.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return sample.sparkSession.createDataFrame(rows, "cell_id int, centroid array<double>")


def matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = centroids.orderBy("cell_id").limit(MOST_CELLS + 1).collect()
    if len(got) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    c = np.array([r.centroid for r in got], np.float64).reshape(len(got), -1)
    n = np.sqrt((c * c).sum(1))
    return np.array([r.cell_id for r in got], np.int32), c / np.where(n > 0, n, 1)[:, None]


def _nearest(held, count: int):
    def run(batches):
        ids, c = held.value
        for b in batches:
            v = b.column("embedding").flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            n = np.sqrt((v * v).sum(1))
            s = np.round((v / np.where(n > 0, n, 1)[:, None]) @ c.T, V.DIGITS) + 0.0
            at = np.argsort(-s, axis=1, kind="stable")[:, :count]  # ids ascend, so ties go to the lower cell
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]), pa.array(ids[at].ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "cells"])

    return run


def nearest_cells(vectors: DataFrame, centroids: DataFrame, count: int) -> DataFrame:
    """The rows with ``cells``, their nearest cells, nearest first."""
    ids, c = matrix(centroids)
    held = vectors.sparkSession.sparkContext.broadcast((ids, c))
    schema = vectors.schema.simpleString()[7:-1]
    return vectors.mapInArrow(_nearest(held, min(count, len(ids))), f"{schema},cells:array<int>")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    return nearest_cells(vectors, centroids, 1).withColumn("cell_id", F.col("cells")[0]).drop("cells")


def write(cells: DataFrame, at: str) -> None:
    cells.write.mode("overwrite").partitionBy("cell_id").parquet(at)


def probe(cells: DataFrame, centroids: DataFrame, query, nprobe: int) -> DataFrame:
    """Rows of the query's nearest cells: the cell ids become a literal filter, which prunes."""
    ids, c = matrix(centroids)
    q = np.asarray(query, np.float64)
    n = float(np.sqrt((q * q).sum()))
    s = np.round(c @ (q / (n or 1.0)), V.DIGITS) + 0.0
    best = ids[np.argsort(-s, kind="stable")[:nprobe]]
    return cells.where(F.col("cell_id").isin([int(x) for x in best]))


def search(cells: DataFrame, centroids: DataFrame, manifest: DataFrame, query, k: int = 24, nprobe: int = 64, prefilter: int = 500, min_score: float | None = None, diversify_seconds: float | None = 30) -> DataFrame:
    """Two stages: the best ``prefilter`` rows of the nearest cells, then threshold or k, diversified."""
    if k < 1:
        raise ValueError("k must be at least 1")
    pool = S.top(probe(cells, centroids, query, nprobe), query, prefilter).select("global_id", "score")
    hits = manifest.join(F.broadcast(pool), "global_id").select(*S.ATTRIBUTES).distinct()  # at most prefilter ids; repeats go last
    limit = k if min_score is None else S.MOST_HITS
    if min_score is not None:
        hits = hits.where(F.col("score") >= F.lit(float(min_score)))
    return S.diversify(hits.select(*S.ATTRIBUTES), diversify_seconds, limit).select("rank", *S.ATTRIBUTES)


def filtered_search(cells: DataFrame, centroids: DataFrame, manifest: DataFrame, query, k: int = 24, nprobe: int = 64, prefilter: int = 500, sites=None, windows=None, exact_rows: int = EXACT_ROWS, log: list | None = None, **options) -> DataFrame:
    """A filtered search that never comes back empty while rows match.

    Small subsets are scanned exactly. Larger ones are probed within the filter (the rows of the near cells first, then those
    of them that the filter keeps), once more with sixteen times the cells if that found nothing, and scanned if
    that found nothing either. ``log`` receives the steps taken. ``manifest`` may hold rows twice.
    """
    log = log if log is not None else []
    if not sites and not windows:
        log.append("probe")
        return search(cells, centroids, manifest, query, k, nprobe, prefilter, **options)
    subset = select(manifest, sites, windows).select("global_id", *[c for c in S.ATTRIBUTES if c not in ("global_id", "score")])
    rows = lambda near: subset.join(near.select("global_id", "embedding"), "global_id")
    n = subset.count()
    if n <= exact_rows:
        log.append("exact" if n else "none")
        return S.search(rows(cells), query, k, **options)
    total = centroids.count()
    for m in dict.fromkeys((nprobe, min(total, ESCALATE * nprobe))):
        log.append(f"probe {m}")
        pool = S.top(rows(probe(cells, centroids, query, m)).distinct(), query, prefilter).select(*S.ATTRIBUTES)
        if pool.limit(1).count():
            limit = k if options.get("min_score") is None else S.MOST_HITS
            if options.get("min_score") is not None:
                pool = pool.where(F.col("score") >= options["min_score"])
            return S.diversify(pool.select(*S.ATTRIBUTES), options.get("diversify_seconds", 30), limit).select("rank", *S.ATTRIBUTES)
    log.append("exact")
    return S.search(rows(cells), query, k, **options)


def _grid(held, nprobes: list[int], most: int):
    def run(batches):
        ids, q, rank, cell_at = held.value
        rough, widths, seen = q.astype(np.float32), np.array(nprobes), {}
        best = [S.Best(len(ids), most) for _ in widths]
        asks: dict[int, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            rows, v = S.unit_rows(b)
            g, cell = b.column("global_id").to_numpy()[rows], cell_at[b.column("cell_id").to_numpy()[rows]]
            o = np.argsort(cell, kind="stable")
            for c in np.unique(cell):
                if c not in seen:  # who asks for the cell, and the narrowest probe that does
                    who = np.flatnonzero(rank[:, c] < widths[-1])
                    seen, asks = {c: 0}, {c: (who, np.searchsorted(widths, rank[who, c], side="right"), q[who], rough[who])}
                who, level, exact, fast = asks[c]
                own = o[np.searchsorted(cell[o], c) : np.searchsorted(cell[o], c, side="right")]
                at = 0
                while at < len(own) and len(who):
                    step = own[at : at + max(S.FIRST_ROWS, seen[c])]  # the floors rise before the next, larger step
                    floor = np.stack([x.floor for x in best])[level, who]
                    for a, r, s in S.near(exact, fast, v[step], floor, most):
                        for m, x in enumerate(best):
                            fit = (level[a] <= m) & (s >= x.floor[who[a]])
                            x.add(who[a[fit]], g[step[r[fit]]], s[fit])
                    for x in best:
                        x.tighten()
                    seen[c], at = seen[c] + len(step), at + len(step)
        for m, x in zip(nprobes, best):
            qq, gg, sc = x.rows()[:3]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qq), m, np.int32)), pa.array(ids[qq]), pa.array(gg), pa.array(sc)], names=["nprobe", "query_id", "global_id", "score"])

    return run


def grid(cells: DataFrame, centroids: DataFrame, queries: DataFrame, nprobes: list[int], prefilters: list[int], k: int) -> DataFrame:
    """``(nprobe, prefilter, query_id, rank, global_id, score)`` for every operating point at once.

    The stated queries travel as matrices of bounded size with the rank of every cell for every query. A row is met once by the
    queries that probe its cell, against the floor of the narrowest probe that does, and is kept by each probe it is good enough
    for. A point's prefilter ranks by the exact score, so the k best of a probe are the k best of its prefilter (or all that it has).
    """
    ids, c = matrix(centroids)
    cell_at = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    cell_at[ids] = np.arange(len(ids))
    nprobes, most = sorted(set(nprobes)), min(k, max(prefilters))

    def run(query_ids, x):
        q = unit(x)
        order = np.argsort(-(np.round(q @ c.T, V.DIGITS) + 0.0), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(ids)), order.shape), 1)
        held = cells.sparkSession.sparkContext.broadcast((query_ids, q, rank.astype(np.int32), cell_at))
        part = cells.select("global_id", "cell_id", "embedding").mapInArrow(_grid(held, nprobes, most), "nprobe int, query_id long, global_id long, score double")
        w = Window.partitionBy("nprobe", "query_id").orderBy(F.desc("score"), "global_id")
        p = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        p = p.select("*", F.explode(F.array(*map(F.lit, prefilters))).alias("prefilter")).where("rank <= prefilter")
        return p.select("nprobe", "prefilter", "query_id", "rank", "global_id", "score"), held

    out = S.in_blocks(queries, run, most * len(nprobes))
    return cells.sparkSession.createDataFrame([], "nprobe int, prefilter int, query_id long, rank int, global_id long, score double") if out is None else out


# ---- product codes ------------------------------------------------------------------------------


def train_codes(sample: np.ndarray, parts: int = 8, codes: int = 16, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """Codebooks ``(parts, codes, width)`` by k-means in each part of the unit vectors."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] // parts
    out = np.empty((parts, codes, width))
    for m in range(parts):
        x = sample[:, m * width : (m + 1) * width]
        c = x[rng.choice(len(x), codes, replace=len(x) < codes)].copy()
        for _ in range(rounds):
            a = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            for j in range(codes):
                if (a == j).any():
                    c[j] = x[a == j].mean(0)
        out[m] = c
    return out


def _codes(held):
    def run(batches):
        books = held.value
        parts, _, width = books.shape
        for b in batches:
            v = b.column("embedding").flatten().to_numpy().astype(np.float64).reshape(b.num_rows, parts, width)
            n = np.sqrt((v * v).sum((1, 2)))
            v = v / np.where(n > 0, n, 1)[:, None, None]
            c = np.stack([((v[:, m, None] - books[m]) ** 2).sum(2).argmin(1) for m in range(parts)], 1) if b.num_rows else np.zeros((0, parts), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * parts), pa.array(c.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("global_id"), lists], names=["global_id", "codes"])

    return run


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``(global_id, codes)``: the nearest centroid of each part."""
    held = vectors.sparkSession.sparkContext.broadcast(books)  # parts x codes x width numbers
    return vectors.select("global_id", "embedding").mapInArrow(_codes(held), "global_id long, codes array<int>")


def code_scores(codes: DataFrame, books: np.ndarray, query) -> DataFrame:
    """Approximate scores from codes: a table of products per part, looked up and summed."""
    q = np.asarray(query, np.float64)
    q = q / (np.sqrt((q * q).sum()) or 1.0)
    lut = np.einsum("mcw,mw->mc", books, q.reshape(books.shape[0], -1))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in lut])
    total = F.aggregate(F.zip_with("codes", table, lambda c, row: F.get(row, c)), F.lit(0.0), lambda s, x: s + x)
    return codes.select("global_id", F.round(total, V.DIGITS).alias("score"))
