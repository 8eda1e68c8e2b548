"""A written index: cells, product codes in a learnt rotation, and the vectors, opened once and probed by literal filters.

On disk an index is a folder of two tables. ``model`` is one row: the header (format, rows, dimension, cells,
parts, stamp of the source), the centroids, the rotation and the codebooks; its size follows the number of cells, which
is bounded. ``rows(cell_block, cell_id, global_id, codes, embedding)`` is partitioned by blocks of cells and sorted by
cell and id inside, so a probe reads the folders and row groups of its cells only.

A search scores the probed rows from their codes (``q . centroid`` plus a table of products per part), keeps the best
``prefilter`` of them and ranks those by exact cosine; a task sends on its best rows only.

Training: ``PER_CELL`` vectors a cell, stratified where strata are given, for the centroids; at most ``FIT_CODES`` residuals
for rotation and codebooks, which are fitted in turn (codebooks by k-means, the rotation by Procrustes).
"""

from __future__ import annotations

import json
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.functions.arrays import scores, unit
from lodevec.operators import ivf, sample
from lodevec.operators import search as S
from lodevec.operators.filters import predicate

FORMAT = 1
PARTS, CODES = 16, 256
PER_CELL = 64
FIT_CODES = 65_536
BLOCK_ROWS = 8192  # rows a block of cells should have at least
MOST_BLOCKS = 1024
ONE_SCAN_ROWS = 262_144  # up to so many probed rows, codes and vectors are read in one scan
MODEL = "header string, centroids binary, rotation binary, books binary"
ROWS = "cell_block int, cell_id int, global_id long, codes array<smallint>, embedding array<float>"


def _unit(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("embedding").flatten().to_numpy().astype(np.float32).reshape(b.num_rows, -1)
    n = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    return (v / np.where(n > 0, n, 1)[:, None]).astype(np.float32)


def _books(y: np.ndarray, parts: int, codes: int, rng, books: np.ndarray | None = None, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks ``(parts, codes, width)`` of rotated residuals, and the residuals as they decode."""
    width = y.shape[1] // parts
    out = np.zeros((parts, codes, width), np.float32)
    back = np.empty_like(y)
    for m in range(parts):
        x = y[:, m * width : (m + 1) * width]
        c = x[rng.choice(len(x), codes, replace=len(x) < codes)].copy() if books is None else books[m].copy()
        for _ in range(rounds):
            a = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
            n = np.bincount(a, minlength=codes)
            for d in range(width):
                s = np.bincount(a, x[:, d], codes)
                c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
        a = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        out[m], back[:, m * width : (m + 1) * width] = c, c[a]
    return out, back


def fit_codes(residuals: np.ndarray, parts: int = PARTS, codes: int = CODES, seed: int = 0, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and codebooks that lose little: k-means in the parts and the best rotation for it, in turn."""
    rng = np.random.default_rng(seed)
    rotation = np.eye(residuals.shape[1], dtype=np.float32)
    books = None
    for _ in range(rounds):
        books, back = _books(residuals @ rotation, parts, codes, rng, books)
        u, _, vt = np.linalg.svd(residuals.T @ back)
        rotation = (u @ vt).astype(np.float32)
    books, _ = _books(residuals @ rotation, parts, codes, rng, books)
    return rotation, books


def _fit_task(centroids: np.ndarray, parts: int, codes: int, seed: int):
    def run(key, t):
        x = _unit(pa.RecordBatch.from_arrays([t.sort_by("global_id")["embedding"].combine_chunks()], names=["embedding"]))
        r = x - centroids[(x @ centroids.T).argmax(1)]
        rotation, books = fit_codes(r, parts, codes, seed)
        return pa.table({"rotation": pa.array([rotation.tobytes()], pa.binary()), "books": pa.array([books.tobytes()], pa.binary())})

    return run


def _index_rows(held, per_block: int):
    def run(batches):
        centroids, rotation, books = held.value
        parts, _, width = books.shape
        half = (books * books).sum(2)
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(b)
            cell = np.concatenate([(u[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(u), 4096)]).astype(np.int32)
            y = (u - centroids[cell]) @ rotation
            codes = np.stack([(half[m] - 2 * (y[:, m * width : (m + 1) * width] @ books[m].T)).argmin(1) for m in range(parts)], 1).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell // per_block), pa.array(cell), b.column("global_id"), lists, b.column("embedding")], names=["cell_block", "cell_id", "global_id", "codes", "embedding"])

    return run


def build(vectors: DataFrame, at: str, cells: int | None = None, strata: DataFrame | None = None, seed: int = 0, parts: int = PARTS, codes: int = CODES, stamp: str = "") -> Index:
    """Train and write an index of ``vectors(global_id, embedding)`` (usable, without repeats) to the folder ``at``.

    ``strata(global_id, ...)`` spreads the training vectors evenly over its other columns. The model is written last: a
    folder without it is no index.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        raise ValueError("there is no vector to index")
    cells = min(cells or ivf.auto_cells(n), n)
    dim = len(vectors.select("embedding").first().embedding)
    if strata is None:
        chosen = sample.uniform(vectors, PER_CELL * cells, seed)
    else:
        names = [c for c in strata.columns if c != "global_id"]
        chosen = sample.stratified(vectors.join(strata.dropDuplicates(["global_id"]), "global_id"), PER_CELL * cells, names, seed).select("global_id", "embedding")
    centroids = ivf.matrix(ivf.train(chosen, cells, seed))[1].astype(np.float32)
    few = sample.uniform(chosen, FIT_CODES, seed + 1)
    got = few.groupBy(F.lit(0).alias("one")).applyInArrow(_fit_task(centroids, parts, codes, seed), "rotation binary, books binary").first()
    rotation = np.frombuffer(bytes(got.rotation), np.float32).reshape(dim, dim)
    books = np.frombuffer(bytes(got.books), np.float32).reshape(parts, codes, -1)
    blocks = int(np.clip(n // BLOCK_ROWS, 1, min(MOST_BLOCKS, len(centroids))))
    per_block = -(-len(centroids) // blocks)
    held = spark.sparkContext.broadcast((centroids, rotation, books))  # at most ``ivf.MOST_CELLS`` centroids
    rows = vectors.select("global_id", "embedding").mapInArrow(_index_rows(held, per_block), ROWS)
    rows = rows.repartitionByRange("cell_block", "cell_id").sortWithinPartitions("cell_block", "cell_id", "global_id")
    rows.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("cell_block").parquet(f"{at}/rows")
    header = {"format": FORMAT, "n": n, "dim": dim, "cells": len(centroids), "per_block": per_block, "parts": parts, "codes": codes, "seed": seed, "stamp": stamp, "layout": ivf.index_string(len(centroids), parts, codes)}
    spark.createDataFrame([(json.dumps(header), centroids.tobytes(), rotation.tobytes(), books.tobytes())], MODEL).coalesce(1).write.mode("overwrite").parquet(f"{at}/model")
    return Index(spark, at)


def _probed(query: np.ndarray, lut: np.ndarray, cell_scores: np.ndarray, prefilter: int):
    """The best ``prefilter`` rows of a task by their codes, with the exact score where the vector is read as well."""

    def run(batches):
        best: tuple | None = None
        parts = len(lut)
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("codes").flatten().to_numpy().reshape(b.num_rows, parts)
            cell, g = b.column("cell_id").to_numpy(), b.column("global_id").to_numpy()
            near = np.round(cell_scores[cell] + lut[np.arange(parts), codes].sum(1), V.DIGITS)
            keep = np.lexsort((g, -near))[:prefilter]
            exact = scores(b.column("embedding").take(pa.array(keep)).flatten().to_numpy().reshape(len(keep), -1), query) if "embedding" in b.schema.names else np.zeros(len(keep))
            new = (g[keep], cell[keep], near[keep], exact)
            best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new))
            o = np.lexsort((best[0], -best[2]))[:prefilter]
            best = tuple(x[o] for x in best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["global_id", "cell_id", "approx", "score"])

    return run


class Index:
    """An open index. Opening reads the model row; the rows are read where a probe needs them."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        try:
            m = spark.read.schema(MODEL).parquet(f"{self.at}/model").first()
        except Exception as e:
            raise FileNotFoundError(f"no index at {self.at}") from e
        if m is None:
            raise FileNotFoundError(f"no index at {self.at}")
        self.header = h = json.loads(m.header)
        if h.get("format") != FORMAT:
            raise ValueError(f"the index at {self.at} has format {h.get('format')}, not {FORMAT}")
        self.centroids = np.frombuffer(bytes(m.centroids), np.float32).reshape(h["cells"], h["dim"])
        self.rotation = np.frombuffer(bytes(m.rotation), np.float32).reshape(h["dim"], h["dim"])
        self.books = np.frombuffer(bytes(m.books), np.float32).reshape(h["parts"], h["codes"], -1)
        self.rows = spark.read.schema(ROWS).parquet(f"{self.at}/rows")

    def _unit(self, query) -> np.ndarray:
        q = np.asarray(query, np.float64)
        if q.shape != (self.header["dim"],):
            raise ValueError(f"a query has {self.header['dim']} numbers, not {q.size}")
        return q / (np.sqrt((q * q).sum()) or 1.0)

    def probe(self, query, nprobe: int) -> DataFrame:
        """The rows of the query's nearest cells, by literal filters on folder and cell."""
        cells = np.argsort(-np.round(self.centroids @ self._unit(query), V.DIGITS), kind="stable")[: max(1, nprobe)]
        if len(cells) == self.header["cells"]:
            return self.rows
        blocks = np.unique(cells // self.header["per_block"])
        return self.rows.where(F.expr(f"cell_block in ({','.join(map(str, blocks))}) and cell_id in ({','.join(map(str, cells))})"))

    def by_codes(self, rows: DataFrame, query, prefilter: int) -> DataFrame:
        """``(global_id, cell_id, approx, score)``: the best rows by what their cell and codes give; ``score`` is exact if the rows have vectors."""
        q = self._unit(query)
        lut = np.einsum("mcw,mw->mc", self.books, (q @ self.rotation).reshape(self.header["parts"], -1))
        best = rows.mapInArrow(_probed(q, lut, self.centroids @ q, prefilter), "global_id long, cell_id int, approx double, score double")
        return best.orderBy(F.desc("approx"), "global_id").limit(prefilter)

    def pool(self, query, nprobe: int = 64, prefilter: int = 500, within: DataFrame | None = None) -> DataFrame:
        """``(global_id, score)``: the best ``prefilter`` rows of the probe by their codes, with exact scores.

        ``within(global_id)`` restricts the rows before they are ranked. Few probed rows are read once, codes and vectors together; of
        more, the codes are read first and then the vectors of the best.
        """
        near = self.probe(query, nprobe)
        if within is not None:
            near = near.join(within.select("global_id"), "global_id", "left_semi")
        if self.header["n"] * min(1.0, nprobe / self.header["cells"]) <= ONE_SCAN_ROWS:
            return self.by_codes(near.select("cell_id", "global_id", "codes", "embedding"), query, prefilter).select("global_id", "score")
        first = self.by_codes(near.select("cell_id", "global_id", "codes"), query, prefilter).select("cell_id", "global_id")
        best = self.probe(query, nprobe).join(F.broadcast(first), ["cell_id", "global_id"])  # at most prefilter rows
        return S.top(best.select("global_id", "embedding"), query, prefilter)

    def search(self, manifest: DataFrame, query, k: int = 24, nprobe: int = 64, prefilter: int = 500, min_score: float | None = None, diversify_seconds: float | None = 30, sites=None, windows=None, exact_rows: int = ivf.EXACT_ROWS, log: list | None = None) -> DataFrame:
        """``(rank, global_id, score, site, time_ns, shard_path, frame_idx)``; ``manifest`` may hold rows twice.

        A filter (sites, windows) that leaves at most ``exact_rows`` frames is scanned exactly; a larger one is probed within, with
        sixteen times the cells if that finds nothing, and scanned if that finds nothing either. ``log`` receives the steps.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        log = log if log is not None else []
        m = manifest.select("global_id", "site", "time_ns", "shard_path", "frame_idx")
        if not sites and not windows:
            log.append(f"probe {nprobe}")
            return self._answer(m, self.pool(query, nprobe, max(prefilter, k)), k, min_score, diversify_seconds)
        m = m.where(predicate(sites, windows))
        n = m.count()
        if n > exact_rows:
            for wide in dict.fromkeys((nprobe, min(self.header["cells"], ivf.ESCALATE * nprobe))):
                log.append(f"probe {wide}")
                p = self.pool(query, wide, max(prefilter, k), m).persist()
                if p.count():
                    return self._answer(m, p, k, min_score, diversify_seconds)
                p.unpersist()
        log.append("exact" if n else "none")
        return S.search_split(m, self.rows.select("global_id", "embedding"), query, k, min_score, diversify_seconds)

    def _answer(self, manifest: DataFrame, pool: DataFrame, k: int, min_score: float | None, diversify_seconds: float | None) -> DataFrame:
        # at most prefilter ids; in one partition, cleaning and ranking need no further shuffle
        hits = manifest.join(F.broadcast(pool), "global_id").select(*S.ATTRIBUTES).repartition(1).distinct()
        if min_score is not None:
            hits = hits.where(F.col("score") >= F.lit(float(min_score)))
        return S.diversify(hits, diversify_seconds, k if min_score is None else S.MOST_HITS).select("rank", *S.ATTRIBUTES)

    def batch(self, queries: DataFrame, k: int = 10, nprobe: int = 64, prefilter: int = 500) -> DataFrame:
        """``(query_id, rank, global_id, score, approx_rank)`` of a stated query set, in blocks: one scan of the rows each.

        Every task keeps the best ``prefilter`` by codes of each query as it goes; ``rank`` is by exact score among them,
        ``approx_rank`` by the codes alone (k or less in either is kept).
        """
        h = self.header

        def run(ids, x):
            if x.shape[1] != h["dim"]:
                raise ValueError(f"a query has {h['dim']} numbers, not {x.shape[1]}")
            q = unit(x).astype(np.float32)
            s = q @ self.centroids.T
            wide = min(max(1, nprobe), h["cells"])
            near = np.argsort(-np.round(s, V.DIGITS), axis=1, kind="stable")[:, :wide]
            asks: list[np.ndarray] = [np.zeros(0, np.int64)] * h["cells"]
            o = np.argsort(near.ravel(), kind="stable")
            cut = np.searchsorted(near.ravel()[o], np.arange(h["cells"] + 1))
            who = o // wide
            asks = [who[cut[c] : cut[c + 1]] for c in range(h["cells"])]
            held = self.spark.sparkContext.broadcast((ids, q, asks, self.centroids, self.rotation, self.books))
            found = self.rows.select("cell_id", "global_id", "codes", "embedding").mapInArrow(_batch(held, prefilter), "query_id long, global_id long, approx double, score double")
            by = Window.partitionBy("query_id")
            p = found.withColumn("approx_rank", F.row_number().over(by.orderBy(F.desc("approx"), "global_id"))).where(F.col("approx_rank") <= prefilter)
            p = p.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "global_id"))).where((F.col("rank") <= k) | (F.col("approx_rank") <= k))
            return p.select("query_id", "rank", "global_id", "score", "approx_rank"), held

        out = S.in_blocks(queries, run, prefilter)
        return self.spark.createDataFrame([], "query_id long, rank int, global_id long, score double, approx_rank int") if out is None else out

    def stages(self, manifest: DataFrame, query, nprobe: int = 64, prefilter: int = 500, k: int = 24) -> dict[str, float]:
        """Seconds of one search's stages: ``probe`` (codes of the near cells), ``rerank`` (exact scores of the best), ``attributes``, ``total``."""
        t = [time.perf_counter()]
        self.by_codes(self.probe(query, nprobe).select("cell_id", "global_id", "codes"), query, prefilter).collect()
        t.append(time.perf_counter())
        pool = self.pool(query, nprobe, prefilter).collect()
        t.append(time.perf_counter())
        kept = self.spark.createDataFrame([(r.global_id, r.score) for r in pool], "global_id long, score double")
        self._answer(manifest, kept, k, None, None).collect()
        t.append(time.perf_counter())
        return {"probe": t[1] - t[0], "rerank": max(0.0, (t[2] - t[1]) - (t[1] - t[0])), "attributes": t[3] - t[2], "total": t[3] - t[1]}


def _batch(held, prefilter: int):
    def run(batches):
        ids, q, asks, centroids, rotation, books = held.value
        turned = q @ rotation
        parts = books.shape[0]
        best = S.Best(len(ids), prefilter)
        for b in batches:
            if not b.num_rows:
                continue
            cell, g = b.column("cell_id").to_numpy(), b.column("global_id").to_numpy()
            codes = b.column("codes").flatten().to_numpy().reshape(b.num_rows, parts)
            back = np.concatenate([books[m][codes[:, m]] for m in range(parts)], 1)
            u = _unit(b).astype(np.float64)
            o = np.argsort(cell, kind="stable")
            cut = np.flatnonzero(np.r_[True, cell[o][1:] != cell[o][:-1]])
            for i, j in zip(cut, np.r_[cut[1:], len(o)]):
                rows, c = o[i:j], cell[o[i]]
                who = asks[c]
                for x in range(0, len(who), 1024):
                    w = who[x : x + 1024]
                    near = np.round((q[w] @ centroids[c])[:, None] + turned[w] @ back[rows].T, V.DIGITS).astype(np.float64)
                    a, r = S.candidates(near, best.floor[w], prefilter)
                    exact = np.round(np.einsum("ij,ij->i", q[w[a]].astype(np.float64), u[rows[r]]), V.DIGITS) + 0.0
                    best.add(w[a], g[rows[r]], near[a, r], exact)
        who, gid, approx, exact = best.rows()
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(gid), pa.array(approx), pa.array(exact)], names=["query_id", "global_id", "approx", "score"])

    return run
