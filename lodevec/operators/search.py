"""Exact and two-stage search of frames by cosine.

Arrow batches are scored as matrices and a task sends on its best rows only (``TakeOrderedAndProject`` merges them): the
product of a row costs far less there than as a native array expression, which walks its numbers one by one. Many
queries go as a matrix (of bounded size) with a running top-k in each task. Scores are rounded to six digits, ties go to
the lower id, NaN never ranks.

Modes: ``min_score`` set - all hits at or above it, at most ``MOST_HITS``; else the best ``k``. With
``diversify_seconds`` set, a hit is dropped if a better kept hit of its site is at most that many
seconds away (0 drops frames of the same instant; None keeps all); the limit applies to what is kept.
``k`` below 1 is refused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.functions import when
from lodevec.functions.arrays import scores, unit, usable_rows
from lodevec.functions.address import parse_hour, url
from lodevec.operators.filters import select
from lodevec.session import stage

MOST_HITS = 2000
MOST_QUERIES = 65_536  # of one matrix; more go in blocks
MOST_KEPT = 2_500_000  # best rows that a task keeps for all queries of a matrix
TILE_QUERIES, TILE_ROWS = 256, 1024  # a tile of scores stays in the processor's cache
FIRST_ROWS = 256
ATTRIBUTES = ["global_id", "score", "site", "time_ns", "shard_path", "frame_idx"]


def ranked(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "global_id")
    return hits.withColumn("rank", F.row_number().over(w))


def scored(frames: DataFrame, query) -> DataFrame:
    """The frames that have a usable vector, with their score."""
    return frames.where(V.usable("embedding", len(query))).withColumn("score", V.score_to("embedding", query))


def _best_rows(held, k: int, least: float | None, names: list[str]):
    def run(batches):
        query = held
        best = None
        for b in batches:
            rows, x = usable_rows(b, len(query))
            if not len(rows):
                continue
            s = scores(x, query)
            keep = np.ones(len(s), bool) if least is None else s >= least
            if best is not None and best.num_rows >= k:
                keep &= s >= floor  # noqa: F821 - set with best
            rows, s = rows[keep], s[keep]
            if not len(rows):
                continue
            new = pa.Table.from_batches([b.select(names)]).take(pa.array(rows)).append_column("score", pa.array(s))
            best = new if best is None else pa.concat_tables([best, new])
            if best.num_rows > k:
                best = best.take(pa.array(np.lexsort((best["global_id"].to_numpy(), -best["score"].to_numpy()))[:k])).combine_chunks()
            floor = float(np.min(best["score"].to_numpy()))
        if best is not None:
            yield from best.to_batches()

    return run


def top(frames: DataFrame, query, k: int, min_score: float | None = None) -> DataFrame:
    """The k best rows with their score, unusable vectors left out; the other columns stay, without the vector.

    Arrow batches are scored as matrices; a task sends on its k best rows only.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    names = [c for c in frames.columns if c != "embedding"]
    q = np.asarray(query, np.float64)
    q = q / (np.sqrt((q * q).sum()) or 1.0)
    schema = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    return frames.mapInArrow(_best_rows(q, k, min_score, names), schema).orderBy(F.desc("score"), "global_id").limit(k)


def diversify(candidates: DataFrame, seconds: float | None, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The greedy walk down a ranked list of bounded length, as an ordered fold in the engine.

    The state is what is kept so far (at most ``limit`` hits): a hit stays unless a kept hit of its
    site is within the distance. Null sites and times suppress nothing.
    """
    if seconds is None:
        return ranked(candidates, by).where(F.col("rank") <= limit)
    d = int(seconds * 1_000_000_000)
    item = F.struct((-F.col("score")).alias("neg"), *[F.col(c) for c in ATTRIBUTES])
    lst = F.array_sort(F.collect_list(item)).alias("c")
    g = candidates.groupBy(*by).agg(lst) if by else candidates.agg(lst)
    near = lambda y, x: F.coalesce((y["site"] == x["site"]) & (F.abs(y["time_ns"] - x["time_ns"]) <= d), F.lit(False))
    keep = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda y: near(y, x)), acc).otherwise(F.concat(acc, F.array(x))))
    out = g.select(*by, F.posexplode(keep).alias("p", "h"))
    return out.select(*by, (F.col("p") + 1).alias("rank"), *[F.col(f"h.{c}").alias(c) for c in ATTRIBUTES])


def _paged(frames: DataFrame, query, min_score: float | None, limit: int, seconds: float | None, kept: list[tuple] = [], after=None) -> DataFrame:  # noqa: B006
    """The ranked list in pages of bounded size, each folded with what is kept so far.

    From the second page on, hits that a kept one suppresses are left out before ranking, so every page brings new
    ones or ends the list, however many a crowded site has.
    """
    spark = frames.sparkSession
    take = max(512, 4 * limit)
    columns = [c for c in ATTRIBUTES if c != "score"]
    frames = frames.select(*columns, "embedding")
    schema = "global_id long, score double, site string, time_ns long, shard_path string, frame_idx int"
    while True:
        f = top(frames, query, take, min_score).select(*ATTRIBUTES)
        if after is not None:
            f = _above(scored(frames, query), min_score).select(*ATTRIBUTES)
            s, g = F.lit(after.score), F.lit(after.global_id)
            f = f.where((F.col("score") < s) | ((F.col("score") == s) & (F.col("global_id") >= g))).distinct()
            if seconds is not None and kept:
                d = int(seconds * 1_000_000_000)
                near = spark.createDataFrame([(r[2], r[3] - d, r[3] + d) for r in kept if r[2] is not None and r[3] is not None], "_s string, _a long, _b long")
                f = f.join(F.broadcast(near), (F.col("site") == F.col("_s")) & F.col("time_ns").between(F.col("_a"), F.col("_b")), "left_anti")  # at most ``limit`` rows
        got = f.orderBy(F.desc("score"), "global_id").limit(take).collect()
        rows = list(dict.fromkeys([*kept, *map(tuple, got)]))
        out = diversify(spark.createDataFrame(rows, schema), seconds, limit).select("rank", *ATTRIBUTES)
        if len(got) < take:
            return out
        done = out.collect()  # at most ``limit`` rows
        if len(done) >= limit:
            return spark.createDataFrame(done, out.schema)
        if after is not None and (after.score, after.global_id) == (got[-1].score, got[-1].global_id):
            take *= 2  # a page of one id's rows
        kept, after = [tuple(r)[1:] for r in done], got[-1]


def _check(query, k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if len(query) != V.DIM:
        raise ValueError(f"a query has {V.DIM} numbers, not {len(query)}")


def _above(found: DataFrame, min_score: float | None) -> DataFrame:
    return found if min_score is None else found.where(F.col("score") >= F.lit(float(min_score)))


def search(frames: DataFrame, query, k: int = 24, min_score: float | None = None, diversify_seconds: float | None = 30, sites=None, windows=None, most_hits: int = MOST_HITS) -> DataFrame:
    """Exact search: ``(rank, global_id, score, site, time_ns, shard_path, frame_idx)``. ``frames`` may hold rows twice.

    Filters and scores come before anything is shuffled. The result is that of the whole ranked list.
    """
    _check(query, k)
    return _paged(select(frames, sites, windows), query, min_score, k if min_score is None else most_hits, diversify_seconds)


def search_split(manifest: DataFrame, vectors: DataFrame, query, k: int = 24, min_score: float | None = None, diversify_seconds: float | None = 30, most_hits: int = MOST_HITS) -> DataFrame:
    """:func:`search` over all frames without joining them first; both tables may hold rows twice.

    Vectors alone are scored; the best few (never more than asked for here) are broadcast to the manifest as it is
    stored, and only what is left is cleaned of repeats. Vectors without a manifest row are no frames. Where these
    few don't fill the list, the frames after them are joined and searched.
    """
    _check(query, k)
    spark = manifest.sparkSession
    limit = k if min_score is None else most_hits
    take = max(512, 4 * limit)
    got = top(vectors.select("global_id", "embedding"), query, take, min_score).collect()
    best = spark.createDataFrame(list(dict.fromkeys(map(tuple, got))), "global_id long, score double")
    out = diversify(manifest.join(F.broadcast(best), "global_id").select(*ATTRIBUTES).distinct(), diversify_seconds, limit).select("rank", *ATTRIBUTES)
    if len(got) < take:
        return out
    done = out.collect()  # at most ``limit`` rows
    if len(done) >= limit:
        return spark.createDataFrame(done, out.schema)
    return _paged(manifest.join(vectors.select("global_id", "embedding"), "global_id"), query, min_score, limit, diversify_seconds, [tuple(r)[1:] for r in done], got[-1])


def export(hits: DataFrame) -> DataFrame:
    """The user-facing table: ``(site, datetime, score, source_cdf)``."""
    return hits.select("site", when.readable("time_ns").alias("datetime"), "score", url("site", when.hour_stamp("time_ns")).alias("source_cdf"))


def resolve(manifest: DataFrame, site: str, hour, frame: int) -> int:
    """The id at an address; ``KeyError`` names what there is, ``IndexError`` the number of frames."""
    day, hh = parse_hour(hour)
    stamp = day.replace("-", "") + hh
    at_site = manifest.where(F.col("site") == site.strip().lower())
    rows = at_site.where(when.hour_stamp("time_ns") == stamp)
    got = rows.where(F.col("frame_idx") == frame).agg(F.min("global_id").alias("g")).first().g
    if got is not None:
        return got
    n = rows.agg((F.max("frame_idx") + 1).alias("n")).first().n
    if n is not None:
        raise IndexError(f"{site} {stamp} has frames 0 to {n - 1}")
    known = [r.site for r in manifest.select("site").distinct().orderBy("site").collect()]
    if site.strip().lower() not in known:
        raise KeyError(f"no site {site!r}; there are {', '.join(x for x in known if x)}")
    days = [r.d for r in at_site.select(when.day_stamp("time_ns").alias("d")).distinct().orderBy("d").limit(20).collect()]
    raise KeyError(f"{site} has nothing at {stamp}; days: {', '.join(x for x in days if x)}")


def query(manifest: DataFrame, vectors: DataFrame, site: str, hour, frame: int, **options) -> DataFrame:
    """Exact search by address; the export table. Both tables may hold rows twice."""
    from lodevec.sources.frames import query_vector

    return export(search_split(manifest, vectors, query_vector(vectors, resolve(manifest, site, hour, frame)), **options).orderBy("rank"))


def candidates(s: np.ndarray, floor: np.ndarray, k: int, margin: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what may stand among the k best of each row (with all ties), at its floor or above; finite only.

    ``margin``: how far a score may lie below the k-th and still count.
    """
    hit = (s >= floor[:, None]) & np.isfinite(s)
    if s.shape[1] > k:
        many = np.flatnonzero(hit.sum(1) > k)
        if len(many):
            part = s[many]
            kth = np.partition(np.where(hit[many], part, -np.inf), part.shape[1] - k, axis=1)[:, part.shape[1] - k]
            hit[many] &= part >= (kth - np.asarray(margin, s.dtype))[:, None]
    return np.nonzero(hit)


def near(exact: np.ndarray, rough: np.ndarray, v: np.ndarray, floor: np.ndarray, k: int, blank: tuple | None = None):
    """``(query, row, score)`` of all that may stand among the k best rows of a query, tile by tile.

    Unit vectors in double precision; ``rough`` are the queries in single precision. Products in single precision find what may
    reach a query's floor, with a margin above their error and the rounding of scores; only that is scored in double precision.
    ``blank`` are queries and rows that don't count.
    """
    margin = 1e-6 + 1.3e-7 * v.shape[1]
    few, low = v.astype(np.float32), (floor - margin).astype(np.float32)
    for i in range(0, len(exact), TILE_QUERIES):
        for j in range(0, len(v), TILE_ROWS):
            s = rough[i : i + TILE_QUERIES] @ few[j : j + TILE_ROWS].T
            if blank is not None:
                here = (blank[0] >= i) & (blank[0] < i + len(s)) & (blank[1] >= j) & (blank[1] < j + s.shape[1])
                s[blank[0][here] - i, blank[1][here] - j] = -np.inf
            some = np.flatnonzero(s.max(1) >= low[i : i + TILE_QUERIES])
            if not len(some):
                continue
            s = s[some]
            a, c = candidates(s, low[i + some], k, 2 * margin)
            a, c = some[a] + i, c + j
            yield a, c, np.round(np.einsum("ij,ij->i", exact[a], v[c]), V.DIGITS) + 0.0


def unit_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, vectors)`` of a batch whose vectors have one length: those that have finite numbers at length one."""
    v = unit(b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1))
    rows = np.flatnonzero(np.isfinite(v).all(1))
    return rows, v if len(rows) == len(v) else v[rows]


def _order(query: np.ndarray, gid: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The order by query, falling score and id: one sort of whole numbers where the scores are cosines of six digits."""
    whole = np.rint(score * 1e6)
    bits = len(query).bit_length()
    if not len(query) or np.abs(whole).max() > 2e6 or np.abs(score * 1e6 - whole).max() > 0.2 or int(query.max()).bit_length() + 22 + bits > 62:
        return np.lexsort((gid, -score, query))
    key = (query.astype(np.int64) << 22) + (2_000_000 - whole.astype(np.int64))
    both = np.sort((key << bits) | np.arange(len(key)))
    o, key = both & ((1 << bits) - 1), both >> bits
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    o[tied] = o[tied][np.lexsort((gid[o[tied]], key[tied]))]
    return o


class Best:
    """The k best rows of each of n queries so far, ties to the lower id; what a task sends on when its input ends.

    Memory is a few times n x k numbers. ``floor`` is each query's k-th score: lower ones needn't be added.
    """

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.held: list[tuple] = []
        self.size, self.kept, self.most = 0, 0, max(1 << 16, 4 * n * k)

    def add(self, query: np.ndarray, gid: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        if not len(query):
            return
        self.held.append((query, gid, score, *more))
        self.size += len(query)
        if self.size > self.most:
            self.shrink()

    def shrink(self) -> None:
        cols = [np.concatenate(x) for x in zip(*self.held)]
        o = _order(*cols[:3])
        cols = [c[o] for c in cols]
        q = cols[0]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        size = np.diff(np.r_[first, len(q)])
        keep = np.arange(len(q)) - np.repeat(first, size) < self.k
        full = size >= self.k
        self.floor[q[first[full]]] = cols[2][first[full] + self.k - 1]
        self.held, self.size = [tuple(c[keep] for c in cols)], int(keep.sum())
        self.kept = self.size

    def tighten(self) -> None:
        """Raise the floors where enough has come since the last time."""
        if self.held and self.size >= 1.5 * self.kept:
            self.shrink()

    def rows(self):
        if not self.held:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.shrink()
        return self.held[0]


def _batch(queries, k: int, skip_self: bool):
    def run(batches):
        ids, q = queries.value
        rough, order, seen = q.astype(np.float32), np.argsort(ids, kind="stable"), 0
        best = Best(len(ids), k)
        for b in batches:
            if not b.num_rows:
                continue
            rows, v = unit_rows(b)
            g = b.column("global_id").to_numpy()[rows]
            at = 0
            while at < len(g):
                end = at + max(FIRST_ROWS, seen)  # the floors rise before the next, larger step
                blank = None
                if skip_self:
                    lo, hi = (np.searchsorted(ids, g[at:end], side, sorter=order) for side in ("left", "right"))
                    n = hi - lo
                    blank = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], np.repeat(np.arange(len(n)), n)
                for a, c, s in near(q, rough, v[at:end], best.floor, k, blank):
                    best.add(a, g[at + c], s)
                best.tighten()
                seen, at = seen + len(g[at:end]), end
        qq, gg, sc = best.rows()[:3]
        if len(qq):
            yield pa.RecordBatch.from_arrays([pa.array(ids[qq]), pa.array(gg), pa.array(sc)], names=["query_id", "global_id", "score"])

    return run


def in_blocks(queries: DataFrame, run: Callable, kept: int = 1) -> DataFrame | None:
    """The union of ``run(ids, vectors)``, a DataFrame and the broadcast it reads, over blocks of queries.

    A block has at most ``MOST_QUERIES`` queries or so, and fewer where ``kept`` rows of each would pass ``MOST_KEPT``.
    An id's rows are in one block (by hash of ``query_id``). Where there are several blocks, each one's answers
    are staged and its matrix is dropped before the next one, so that no number of queries is refused. None without queries.
    """
    q = queries.select("query_id", "embedding")
    most = max(1, min(MOST_QUERIES, MOST_KEPT // kept))

    def matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = rows.toArrow().combine_chunks()
        n = t.num_rows
        return t["query_id"].to_numpy(), t["embedding"].combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, V.DIM))

    ids, x = matrix(q.limit(most + 1))
    if len(ids) <= most:
        return run(ids, x)[0] if len(ids) else None
    parts, out = -(-11 * q.count() // (10 * most)), None
    for part in range(parts):
        ids, x = matrix(q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))
        if not len(ids):
            continue
        answers, held = run(ids, x)
        answers = stage(answers, "answers")
        held.destroy()
        out = answers if out is None else out.unionByName(answers)
    return out


def batch_top(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, most: int | None = None) -> DataFrame:
    """``(query_id, rank, global_id, score)``: a stated query set against all rows, in blocks.

    ``queries(query_id, embedding)`` travels as matrices of bounded size; more than ``most`` rows are refused where it is given.
    """
    if most is not None and queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries in one batch")
    spark = vectors.sparkSession

    def run(ids, x):
        held = spark.sparkContext.broadcast((ids, unit(x)))
        part = vectors.select("global_id", "embedding").mapInArrow(_batch(held, k, skip_self), "query_id long, global_id long, score double")
        return ranked(part, ("query_id",)).where(F.col("rank") <= k).select("query_id", "rank", "global_id", "score"), held

    out = in_blocks(queries, run, k)
    return spark.createDataFrame([], "query_id long, rank int, global_id long, score double") if out is None else out
