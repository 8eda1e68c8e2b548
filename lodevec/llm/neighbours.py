"""The most similar vectors of every vector: an inverted multi-index.

Method: each vector is cut into two halves and each half is quantised by its own codebook of K
centroids, which gives K x K cells from two small codebooks. A query sorts the centroids of each
half by distance and walks the pairs of centroids in order of summed distance (the order a heap
over the two sorted lists yields); the entries of the cells met are reranked by exact cosine.

The codebooks are fitted on a bounded sample (``FIT_ROWS`` rows by hash of the id); every row is
indexed. Rows are routed to *blocks*, the cells that share a first centroid; a row visits the other
blocks its walk reaches, so a row travels once for its home block and once for each block visited,
in half precision where that loses nothing. Within a block whole cells are scored by matrix
products in tiles. Blocks that hold more than ``BLOCK_ROWS`` rows, by the sample, are split by a
hash of the vector; whatever visits such a block visits all its parts.

Exact copies: of the rows with one vector only the k+1 lowest ids can stand among anyone's k
nearest, so no more of them are entries (all of them are queries). No list of pairs is ever longer
than k for each row and block.

Walks: with ``min_score`` set, a pair at cosine c or more is at most ``r = sqrt(2 - 2c)`` apart, so
cell C can hold it only if its summed distance exceeds that of the home cell H by at most
``2 r |C - H|``; ``slack`` of this bound is walked, up to ``cells`` cells. Without it a walk ends
after ``cells`` cells. ``slack=1`` and ``cells=None`` lose nothing, at more cost. Missed neighbours are the accuracy loss; the measured recall is in the README.

Defined results: unusable vectors (null, wrong length, not finite, all zero) and null ids take no
part; an id given several vectors is compared by each, and a pair's score is its best; repeated rows
count once; equal scores rank by lower id; a row never meets its own id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm import vectors as vec

FIT_ROWS = 16_384
BLOCK_ROWS = 131_072
PER_CELL = 128
SLACK = 0.35
HALF = vec.DIM // 2
TILE = 2048
WALKED = 1 << 20  # steps walked at once
HELD = 250_000  # candidate pairs held before they are cut to each row's best
STEP = 1 << 16  # pairs whose vectors are gathered at once
PAIRS = "src long, dst long, score double"


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = distances(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c, np.float64)
        np.add.at(s, a, x)
        live = n > 0
        c[live] = (s[live] / n[live, None]).astype(np.float32)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)
    d -= 2 * (x @ c.T)
    return np.maximum(d, 0, out=d)


class Codebooks:
    """The two codebooks, and how many parts each block is split into."""

    def __init__(self, first: np.ndarray, second: np.ndarray, parts: np.ndarray):
        self.first, self.second, self.parts = first, second, parts


def _sample(batches):
    for b in batches:
        g, v = vec.usable(b)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array([r.tobytes() for r in vec.unit(v)] if len(v) else [], pa.binary())], names=["global_id", "v"])


def fit(vectors: DataFrame, seed: int = 0, fit_rows: int = FIT_ROWS) -> Codebooks | None:
    """Codebooks from at most about ``fit_rows`` rows; None if there is no usable vector among them."""
    n = vectors.count()
    v = vectors.select("global_id", "embedding")
    step = max(1, n // fit_rows)
    if step > 1:
        v = v.where(F.pmod(F.xxhash64("global_id"), F.lit(step)) == 0)
    got = sorted((r.global_id, bytes(r.v)) for r in v.mapInArrow(_sample, "global_id long, v binary").collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(g[1] for g in got), np.float32).reshape(-1, vec.DIM)
    k = int(np.clip(2 ** round(np.log2(max(1.0, n / PER_CELL) ** 0.5)), 4, 1024))
    first, second = kmeans(x[:, :HALF], k, seed), kmeans(x[:, HALF:], k, seed + 1)
    share = np.bincount(distances(x[:, :HALF], first).argmin(1), minlength=len(first)) / len(x)
    return Codebooks(first, second, np.maximum(1, np.ceil(share * n / BLOCK_ROWS)).astype(np.int64))


def walk(d1: np.ndarray, d2: np.ndarray):
    """Cells (i, j, summed distance) of one query by rising sum: a heap over two sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        s, i, j = heapq.heappop(heap)
        yield int(o1[i]), int(o2[j]), s
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))


def walks(d1: np.ndarray, d2: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``cells`` steps of :func:`walk` for many queries at once: a heap for each, all heaps in step.

    The heap of a query holds one pair for each of its first centroids: with the nearest second centroid it was
    not yet popped with. A pop gives the root and puts that first centroid's next pair in its place, which
    sinks level by level. Only the ``cells`` nearest centroids of a half can ever be popped.
    """
    n, k1, k2 = len(d1), d1.shape[1], d2.shape[1]
    cells = min(cells, k1 * k2)
    w1, w2 = min(cells, k1), min(cells, k2)

    def nearest_of(d, w):
        o = np.argpartition(d, w - 1, axis=1)[:, :w] if w < d.shape[1] else np.broadcast_to(np.arange(w), d.shape)
        v = np.take_along_axis(d, o, 1)
        p = np.argsort(v, axis=1, kind="stable")
        return np.take_along_axis(o, p, 1), np.take_along_axis(v, p, 1)

    o1, a = nearest_of(d1, w1)
    o2, b = nearest_of(d2, w2)
    b = np.concatenate([b, np.full((n, 1), np.inf, b.dtype)], 1)  # past the last: sinks to the bottom
    q = np.arange(n)
    depth = max(1, w1.bit_length())
    width = (1 << depth) - 1
    key = np.full((n, 2 * width + 2), np.inf, np.float32)  # a sorted list is a heap
    key[:, :w1] = a + b[:, :1]
    who = np.zeros((n, width), np.int32)
    who[:, :w1] = np.arange(w1)
    col = np.zeros((n, w1), np.int32)
    i, j, s = np.empty((n, cells), np.int32), np.empty((n, cells), np.int32), np.empty((n, cells), np.float32)
    for t in range(cells):
        top = who[:, 0]
        i[:, t], j[:, t], s[:, t] = top, col[q, top], key[:, 0]
        col[q, top] += 1
        x = (a[q, top] + b[q, col[q, top]]).astype(np.float32)
        mine, at = top.copy(), np.zeros(n, np.int64)
        on = q
        for _ in range(depth - 1):  # sink: while a child is smaller, it moves up
            here = at[on]
            left = key[on, 2 * here + 1]
            right = key[on, 2 * here + 2]
            child = 2 * here + 1 + (right < left)
            low = np.minimum(left, right)
            down = low < x[on]
            if not down.any():
                break
            on, here, child = on[down], here[down], child[down]
            key[on, here] = low[down]
            who[on, here] = who[on, child]
            at[on] = child
        key[q, at] = x
        who[q, at] = mine
    return np.take_along_axis(o1, i, 1), np.take_along_axis(o2, j, 1), s


def _mix(v: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes."""
    w = np.ascontiguousarray(v.astype(np.float32)).view(np.uint32).astype(np.uint64)
    m = np.random.default_rng(11).integers(1, 2**63, w.shape[1], dtype=np.uint64) | np.uint64(1)
    h = (w * m).sum(1, dtype=np.uint64)
    return h ^ (h >> np.uint64(29))


def _route(books, cells: int, reach: float | None, slack: float, query_step: int):
    """Payload rows (block, part, data). reach: the distance r of the docstring, or None for a plain walk."""

    def run(batches):
        c1, c2, parts = books.first, books.second, books.parts
        for b in batches:
            g, v = vec.usable(b)
            if not len(g):
                continue
            u = vec.unit(v)
            d1, d2 = distances(u[:, :HALF], c1), distances(u[:, HALF:], c2)
            h1, h2 = d1.argmin(1), d2.argmin(1)
            asks = np.arange(len(g)) if query_step == 1 else np.flatnonzero(g % query_step == 0)
            met = []
            step = max(1, WALKED // min(cells, len(c1) * len(c2)))
            for x in range(0, len(asks), step):
                some = asks[x : x + step]
                i, j, s = walks(d1[some], d2[some], cells)
                go = np.ones(s.shape, bool)
                if reach is not None:
                    gap = s - (d1[some, h1[some]] + d2[some, h2[some]])[:, None]
                    apart = np.sqrt(((c1[i] - c1[h1[some]][:, None]) ** 2).sum(2) + ((c2[j] - c2[h2[some]][:, None]) ** 2).sum(2))
                    go = gap <= 2 * reach * slack * apart + 1e-5
                    go[:, 0] = True
                q, col = np.nonzero(go)
                met.append((some[q], i[q, col].astype(np.int64), j[q, col].astype(np.int64)))
            row, blk, cell = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 3
            # one entry for each (row, block): the home block always, other blocks where cells are asked
            n = np.int64(len(c1))
            want = row.astype(np.int64) * n + blk
            home = np.arange(len(g), dtype=np.int64) * n + h1
            entry = np.unique(np.concatenate([want, home]))
            e_row, e_blk = entry // n, entry % n
            is_home = h1[e_row] == e_blk
            o = np.argsort(want, kind="stable")
            want, cell = want[o], cell[o].astype(np.uint16)
            lo, hi = np.searchsorted(want, entry, "left"), np.searchsorted(want, entry, "right")
            mine = (_mix(v)[e_row] % parts[e_blk].astype(np.uint64)).astype(np.int64)
            for blk_ in np.unique(e_blk):
                at = np.flatnonzero(e_blk == blk_)
                for p in range(int(parts[blk_])):
                    lives = is_home[at] & (mine[at] == p)
                    sel = lives | (hi[at] > lo[at])
                    if not sel.any():
                        continue
                    a, lv = at[sel], lives[sel]
                    half, single, mask = vec.pack(v[e_row[a]])
                    cnt = (hi[a] - lo[a]).astype(np.int64)
                    asked = np.concatenate([cell[x:y] for x, y in zip(lo[a], hi[a])]) if cnt.sum() else cell[:0]
                    c_home = np.where(lv, h2[e_row[a]], 65535).astype(np.uint16)
                    data = pickle.dumps((g[e_row[a]], half, single, np.packbits(mask), c_home, cnt.astype(np.uint16), asked), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([blk_], pa.int64()), pa.array([p], pa.int64()), pa.array([data], pa.binary())], names=["block", "part", "data"])

    return run


def _top(src, dst, score, k):
    """The k best rows of each src, by score, then lower dst; repeated pairs count once."""
    o = np.lexsort((dst, -score, src))
    src, dst, score = src[o], dst[o], score[o]
    pair = np.lexsort((-score, dst, src))
    fresh = np.ones(len(src), bool)
    fresh[1:] = (src[pair][1:] != src[pair][:-1]) | (dst[pair][1:] != dst[pair][:-1])
    keep = np.zeros(len(src), bool)
    keep[pair[fresh]] = True
    src, dst, score = src[keep], dst[keep], score[keep]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
    rank = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)]))
    return src[rank < k], dst[rank < k], score[rank < k]


def _best_columns(s: np.ndarray, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row (and what ties with the k-th), at ``floor`` (a number, or one a row) or more."""
    hit = s >= (floor[:, None] if isinstance(floor, np.ndarray) else floor)
    if s.shape[1] > k:
        many = np.flatnonzero(hit.sum(1) > k)
        if len(many):
            part = s[many]
            kth = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
            hit[many] &= part >= (kth - 2e-6)[:, None]
    return np.nonzero(hit)


def _score(k: int, min_score: float | None, both: bool):
    floor = -2.0 if min_score is None else min_score - 1e-5

    def run(key, t):
        cols = [pickle.loads(x) for x in t["data"].to_pylist()]
        g = np.concatenate([c[0] for c in cols])
        v = np.concatenate([vec.unpack(c[1], c[2], np.unpackbits(c[3], count=len(c[0])).astype(bool)) for c in cols])
        c_home = np.concatenate([c[4] for c in cols])
        cnt = np.concatenate([c[5] for c in cols]).astype(np.int64)
        asked = np.concatenate([c[6] for c in cols])
        del cols
        u = vec.unit(v)
        live = np.flatnonzero(c_home != 65535)
        # of exact copies, the k+1 lowest distinct ids are entries
        mix = _mix(v[live])
        o = np.lexsort((g[live], mix))
        live, mix = live[o], mix[o]
        same = np.zeros(len(live), bool)
        same[1:] = (mix[1:] == mix[:-1]) & (v[live[1:]] == v[live[:-1]]).all(1)
        again = same & np.r_[False, g[live[1:]] == g[live[:-1]]]
        live, same = live[~again], same[~again]
        head = np.flatnonzero(~same)
        nth = np.arange(len(live)) - np.repeat(head, np.diff(np.r_[head, len(live)]))
        live = live[nth <= k]
        o = np.lexsort((g[live], c_home[live]))
        live = live[o]
        who = np.repeat(np.arange(len(g)), cnt)
        o = np.argsort(asked, kind="stable")
        who, asked = who[o], asked[o]
        held: list[tuple] = []
        size = 0
        low = np.full(len(g), floor, np.float32)  # the k-th best score of each row so far
        cells, first = np.unique(c_home[live], return_index=True)
        for c, i, j in zip(cells, first, np.r_[first[1:], len(live)]):
            h = live[i:j]
            q = who[np.searchsorted(asked, c, "left") : np.searchsorted(asked, c, "right")]
            for x in range(0, len(q), TILE):
                qq = q[x : x + TILE]
                for y in range(0, len(h), 4 * TILE):
                    hh = h[y : y + 4 * TILE]
                    s = u[qq] @ u[hh].T
                    if len(hh) and g[hh[0]] <= g[qq].max() and g[qq].min() <= g[hh[-1]]:
                        s[g[qq][:, None] == g[hh][None, :]] = -3
                    a, b = _best_columns(s, k, low[qq])
                    found = [(qq[a], hh[b])]
                    if both:
                        b, a = _best_columns(s.T, k, low[hh])
                        found.append((hh[b], qq[a]))
                    for a, b in found:
                        if len(a):
                            held.append((a, b))
                            size += len(a)
                    if size > HELD:
                        held = [_shrink(held, u, g, k, low)]
                        size = len(held[0][0]) // 2  # what stays counts half, so that shrinking pays
        if held:
            a, b = _shrink(held, u, g, k, low)
            sc = np.concatenate([vec.cosines(v[a[x : x + STEP]], v[b[x : x + STEP]]) for x in range(0, len(a), STEP)]) if len(a) else np.zeros(0)
            ok = np.ones(len(a), bool) if min_score is None else sc >= min_score
            src, dst, sc = _top(g[a[ok]], g[b[ok]], sc[ok], k)
        else:
            src = dst = np.zeros(0, np.int64)
            sc = np.zeros(0)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "score": pa.array(sc, pa.float64())})

    return run


def _shrink(held, u, g, k, low):
    """Each row's k best pairs and what ties with them; ``low`` rises to the k-th score where there are k."""
    a, b = (np.concatenate(z) for z in zip(*[z[:2] for z in held]))
    sc = np.concatenate([np.einsum("ij,ij->i", u[a[x : x + STEP]], u[b[x : x + STEP]]) for x in range(0, len(a), STEP)]) if len(a) else np.zeros(0, np.float32)
    o = np.lexsort((-sc, g[b], a))  # an id's best vector stands for it
    a, b, sc = a[o], b[o], sc[o]
    one = np.r_[True, (a[1:] != a[:-1]) | (g[b[1:]] != g[b[:-1]])][: len(a)]
    a, b, sc = a[one], b[one], sc[one]
    o = np.lexsort((g[b], -sc, a))
    a, b, sc = a[o], b[o], sc[o]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    kth = np.minimum(first + k - 1, np.r_[first[1:], len(a)] - 1)
    keep = (rank < k) | (sc >= np.repeat(sc[kth], np.diff(np.r_[first, len(a)])) - 2e-6)
    full = np.flatnonzero(np.diff(np.r_[first, len(a)]) >= k)
    low[a[first[full]]] = np.maximum(low[a[first[full]]], sc[kth[full]] - 4e-6)
    return a[keep], b[keep]


def nearest(vectors: DataFrame, k: int = 10, min_score: float | None = None, cells: int | None = 8, query_step: int = 1, seed: int = 0, slack: float = SLACK) -> DataFrame:
    """``(src, dst, score, rank)``: up to k nearest of each query (ids divisible by ``query_step``).

    ``cells=None`` walks without an end; with ``slack=1`` as well (or without ``min_score``) the result is exact.
    """
    books = fit(vectors, seed)
    spark = vectors.sparkSession
    if books is None:
        return spark.createDataFrame([], PAIRS + ", rank int")
    reach = None if min_score is None else float(np.sqrt(max(0.0, 2 - 2 * min_score)))
    held = spark.sparkContext.broadcast(books)  # two codebooks of at most 1024 x 32 floats
    most = len(books.first) * len(books.second) if cells is None else cells
    route = lambda it: _route(held.value, most, reach, slack, query_step)(it)
    routed = vectors.select("global_id", "embedding").mapInArrow(route, "block long, part long, data binary")
    score = _score(k, min_score, query_step == 1)
    pairs = routed.groupBy("block", "part").applyInArrow(score, PAIRS)
    best = pairs.groupBy("src", "dst").agg(F.max("score").alias("score"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual(near: DataFrame) -> DataFrame:
    """``(gid_a, gid_b)``, gid_a < gid_b: pairs where each is in the other's list."""
    p = near.groupBy(F.least("src", "dst").alias("gid_a"), F.greatest("src", "dst").alias("gid_b")).agg(F.count("*").alias("n"))
    return p.where("n = 2").select("gid_a", "gid_b")


def _brute(k: int, queries):
    def run(batches):
        ids, q = queries
        best: tuple | None = None
        for b in batches:
            g, v = vec.usable(b)
            if not len(g):
                continue
            u = vec.unit(v)
            for x in range(0, len(ids), TILE):
                s = q[x : x + TILE] @ u.T
                s[ids[x : x + TILE][:, None] == g[None, :]] = -3
                a, c = _best_columns(s, k, -2.0)
                new = (ids[x : x + TILE][a], g[c], s[a, c].astype(np.float64))
                best = new if best is None else tuple(np.concatenate(z) for z in zip(best, new))
            best = _top(*best, k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2])], names=["src", "dst", "score"])

    return run


def brute_force(vectors: DataFrame, query_step: int, k: int = 10, most: int = 4096) -> DataFrame:
    """Exact ``(src, dst, score, rank)`` of a stated query set (at most ``most`` vectors) against all rows, in blocks."""
    v = vectors.select("global_id", "embedding")
    n = v.where(F.pmod("global_id", F.lit(query_step)) == 0).count()
    if n > most:
        raise ValueError(f"{n} queries: brute force takes at most {most}")
    got = v.where(F.pmod("global_id", F.lit(query_step)) == 0).mapInArrow(_sample, "global_id long, v binary").distinct().collect()
    ids = np.array([r.global_id for r in got], np.int64)
    q = np.frombuffer(b"".join(bytes(r.v) for r in got), np.float32).reshape(-1, vec.DIM)
    held = vectors.sparkSession.sparkContext.broadcast((ids, q))
    part = v.mapInArrow(lambda it: _brute(k, held.value)(it), PAIRS) if len(ids) else vectors.sparkSession.createDataFrame([], PAIRS)
    best = part.groupBy("src", "dst").agg(F.max("score").alias("score"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
