"""Clusters of mutually similar vectors.

A cluster is a maximal set of at least ``least`` ids any two of which have a cosine of at least
``min_cos``. Method:

1. *Sets.* ``BOOKS`` codebooks of ``CENTROIDS`` centroids each, every one in a random subspace of its own
   and fitted on a bounded sample (``FIT_ROWS`` rows by hash of the id), name a centroid for a vector:
   its set holds these names, one of each codebook.
2. *MinHash banding.* A band is several min-hashes of the set. Bands come in groups that share their
   first ``lead`` min-hashes; a group's rows travel together, once, by these, with the vector in one byte
   a number, and fall into the group's bands where they arrive. The number of min-hashes follows the number
   of vectors (chance company per bucket stays about constant).
3. *Verification.* Rows of a bucket are linked if their cosine is ``min_cos`` up to the rounding of the bytes
   (``ROUNDING``), in buckets of any size and with heads alike. The Jaccard of two sets is no condition: any
   bound on it would lose pairs that the cosine, which defines a cluster, accepts. Out of a task comes one
   link for each row, to the least id it is connected to there, never a list of pairs. A bucket's links connect
   every two rows found similar in it: each pair is compared once, in blocks, unless this or an earlier band has joined a
   whole block; buckets above ``CROWD`` rows are peeled first (all that are similar to one of the
   lowest ids join it and leave, while these are many). Rows that no band
   joined are compared with the heads of the groups found where they arrive. Exact copies
   are joined to one of them per input batch before anything travels.
4. *Connected components* of the stars, by staged rounds.
5. *Splitting loose ones.* Vectors meet by component, and cosines are exact from here on. A component
   in which all are similar to all is a cluster. Any other is split around its highest-degree
   medoid: the maximal sets that hold the medoid lie among its neighbours and are enumerated there;
   then the medoid is set aside and the next one follows. Members with the same neighbours count as
   one, and members with fewer than ``least - 1`` neighbours are dropped first. This finds every maximal
   set of the component. After ``STEPS`` steps a task hands the rest of its search, cut into
   subgraphs, to further tasks, round by round until nothing is left; no set is given up.
   Components above ``LARGE`` members are compared block by block on many tasks; members similar
   to all others stand aside, so that the sets of the others only are searched: in one task, or,
   where they are more than ``LARGE``, in the neighbourhood of each by itself.

Defined results: unusable vectors and null ids take no part; an id counts once, given several vectors
it is similar where one of them is; ids in several maximal sets appear in each; repeated rows change
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm import vectors as vec
from lodevec.llm.components import components
from lodevec.llm.neighbours import kmeans
from lodevec.session import release_shuffles, stage

BOOKS = 24
CENTROIDS = 8
SUBSPACE = 16
FIT_ROWS = 8_192
GROUPS = 6
BANDS = 4
ROUNDING = 0.01
STRANGERS = 150
SMALL = 24  # buckets up to this size are compared by shifts, larger ones by matrix products
MIDDLE = 128  # buckets up to this size share products with others, larger ones are compared in blocks
CROWD = 4096  # larger ones are peeled by heads first
TILE, BLOCK = 262_144, 128  # cosines at once, and rows they belong to
LARGE = 30_000
STEPS = 200_000  # of one task in the search for maximal sets; what is left then goes to further tasks
ROOM = 1_000_000  # members of the sets that one task finds
PARTS = 16
ANCHORS = 1000
MEMBERS = "comp long, nth long, cluster_gid long, global_id long, n long, typical double"
SPLIT = MEMBERS + ", todo binary"
SPLIT_NAMES = [x.split()[0] for x in SPLIT.split(", ")]


def shape(n: int) -> tuple[int, int, int]:
    """(lead, groups, rows): shared min-hashes, groups of bands, further min-hashes of each band.

    Two strange vectors share a min-hash with a chance of about 1/15. A task takes up to some 250,000 rows,
    a bucket some ``STRANGERS`` strangers; each further shared min-hash asks for twice the groups.
    """
    lead = 1 + max(0, int(np.ceil(np.log(max(n, 1) / 2_000_000) / np.log(15))))
    total = max(lead + 1, round(np.log(max(n, 1) / STRANGERS) / np.log(15)))
    return lead, GROUPS * 2 ** (lead - 1), total - lead


class Hashes:
    """Codebooks and random orders of their centroids."""

    def __init__(self, sample: np.ndarray, lead: int, groups: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.lead, self.groups, self.rows = lead, groups, rows
        cols, offs = [], []
        for j in range(BOOKS):
            basis = np.linalg.qr(rng.standard_normal((vec.DIM, SUBSPACE)))[0].astype(np.float32)
            c = kmeans(sample @ basis, CENTROIDS, seed + j, rounds=6)
            if len(c) < CENTROIDS:
                c = np.concatenate([c, np.full((CENTROIDS - len(c), SUBSPACE), 9, np.float32)])
            cols.append(-2 * basis @ c.T)
            offs.append((c * c).sum(1))
        self.w, self.off = np.concatenate(cols, 1).astype(np.float32), np.concatenate(offs).astype(np.float32)
        n = groups * (lead + BANDS * rows)
        self.orders = np.stack([rng.permutation(BOOKS * CENTROIDS).astype(np.uint16).reshape(BOOKS, CENTROIDS) for _ in range(n)])

    def sets(self, u: np.ndarray) -> np.ndarray:
        """Of each row, the centroid that each codebook names."""
        out = np.empty((len(u), BOOKS), np.uint8)
        w = np.ascontiguousarray(self.w.reshape(-1, BOOKS, CENTROIDS).transpose(2, 1, 0)).reshape(CENTROIDS * BOOKS, -1)
        off = self.off.reshape(BOOKS, CENTROIDS).T.reshape(-1, 1)
        for i in range(0, len(u), 1024):
            # all first centroids, all second ones, and so on: as many whole rows to compare
            d = w @ u[i : i + 1024].T
            d += off
            d = d.reshape(CENTROIDS, -1)
            least, name, above = d.min(0), np.zeros(d.shape[1], np.uint8), np.ones(d.shape[1], bool)
            for c in range(CENTROIDS - 1):
                above &= d[c] > least
                name += above
            out[i : i + 1024] = name.reshape(BOOKS, -1).T
        return out

    def key(self, names: np.ndarray, first: int, count: int) -> np.ndarray:
        """``count`` min-hashes, the least rank of a name in a random order of all, as one number."""
        out = np.zeros(len(names), np.int64)
        # the names of four books are one number, looked up at once
        fours = [np.ascontiguousarray(names[:, j : j + 4]).astype(np.intp) @ CENTROIDS ** np.arange(3, -1, -1) for j in range(0, BOOKS, 4)]
        for h in range(first, first + count):
            least = np.full(len(names), BOOKS * CENTROIDS, np.uint16)
            for j, at in zip(range(0, BOOKS, 4), fours):
                t = self.orders[h][j]
                for more in self.orders[h][j + 1 : j + 4]:
                    t = np.minimum(t[:, None], more).ravel()
                np.minimum(least, t[at], out=least)
            out = out * (BOOKS * CENTROIDS) + least
        return out


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected to."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _lead(hashes: Hashes):
    def run(batches):
        for b in batches:
            g, v = vec.usable(b)
            if not len(g):
                continue
            # exact copies: the lowest id stands for all
            o = np.argsort(g, kind="stable")
            g, v = g[o], v[o]
            _, at, back = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_index=True, return_inverse=True)
            rep = g[at][back]
            copy = rep != g
            group_, lead_, data_ = [], [], []
            if copy.any():
                group_.append(-1)
                lead_.append(int(g[copy][0]) & 0xFFF)
                data_.append(pickle.dumps((g[copy], rep[copy]), 5))
            g, v = g[at], v[at]
            u = vec.unit(v)
            scale = np.abs(u).max(1, keepdims=True) / 127
            v = np.rint(u / scale).astype(np.int8)
            names = hashes.sets(vec.unit(v))
            for k in range(hashes.groups):
                key = hashes.key(names, k * hashes.lead, hashes.lead)
                o = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
                for i, j in zip(cut, np.r_[cut[1:], len(o)]):
                    r = o[i:j]
                    group_.append(k)
                    lead_.append(int(key[r[0]]))
                    data_.append(pickle.dumps((g[r], v[r]), 5))
            yield pa.RecordBatch.from_arrays([pa.array(group_, pa.int64()), pa.array(lead_, pa.int64()), pa.array(data_, pa.binary())], names=["grp", "lead", "data"])

    return run


def _upper_links(u: np.ndarray, start: np.ndarray, size: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of similar rows in small buckets that lie one after the other in ``u``; buckets of about one size share a product."""
    a, b = [], []
    by = np.argsort(size, kind="stable")
    while len(by):
        # from the largest down, so that padding is little
        n = int(size[by[-1]])
        mine, by = np.split(by, [max(0, len(by) - max(1, TILE // (n * n)))])[::-1]
        x = u[np.minimum(start[mine][:, None] + np.arange(n), len(u) - 1)]
        near = np.matmul(x, x.transpose(0, 2, 1)) >= min_cos
        near &= np.tri(n, k=-1, dtype=bool).T
        at, pair = np.divmod(np.flatnonzero(near), n * n)
        i, j = np.divmod(pair, n)
        own = j < size[mine][at]  # i < j, and what lies behind a shorter bucket is another's
        at, i, j = start[mine][at[own]], i[own], j[own]
        a.append(at + i)
        b.append(at + j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _bucket_links(u: np.ndarray, min_cos: float, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of one bucket, by which, and by equal roots, any two similar rows are connected.

    Rows of different groups are compared in blocks, each pair of rows once.
    """
    n = len(u)
    a, b = [], []
    root = np.arange(n) if root is None else root
    if n > CROWD:
        x, y = _heads(u, min_cos)
        a.append(x)
        b.append(y)
        root = np.unique(root, return_inverse=True)[1]
        root = connect(n, root[x], root[y])[root]
    o = np.argsort(root, kind="stable")
    u, root = u[o], root[o]
    root = np.maximum.accumulate(np.where(np.r_[True, root[1:] != root[:-1]], np.arange(n), 0))

    def join(p, q):
        nonlocal root
        x, y = root[p], root[q]
        new = np.flatnonzero(x != y)
        if len(new):
            a.append(o[p[new]])
            b.append(o[q[new]])
            root = connect(n, x[new], y[new])[root]

    for i in range(0, n, BLOCK):
        for j in range(i, n, TILE // BLOCK):
            p, q = slice(i, i + BLOCK), slice(j, j + TILE // BLOCK)
            if (root[p] == root[i]).all() and (root[q] == root[i]).all():
                continue
            near = u[q] @ u[p].T >= min_cos
            r = np.flatnonzero(near.any(1))
            near = near[r]
            join(j + r, i + near.argmax(1))
            # most rows met their group by the first row similar to them, few pairs are left
            near &= root[j + r][:, None] != root[p]
            x, y = np.divmod(np.flatnonzero(near), near.shape[1])
            join(j + r[x], i + y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _heads(u: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a crowd's rows to the lowest similar to them, as long as these take many along."""
    left, a, b, many = np.arange(len(u)), [], [], True
    while many and len(left):
        heads = left[:64]
        near = u[left] @ u[heads].T >= min_cos
        near[np.arange(len(heads)), np.arange(len(heads))] = True
        has = near.any(1)
        a.append(left[has])
        b.append(heads[near[has].argmax(1)])
        many = has.sum() > len(heads) + len(left) // 16
        left = left[~has]
    return np.concatenate(a), np.concatenate(b)


def _links(hashes: Hashes, min_cos: float):
    def run(key, t):
        rows = [pickle.loads(x) for x in t["data"].to_pylist()]
        group = key[0].as_py()
        if group < 0:
            a, b = (np.concatenate(z) for z in zip(*rows))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        g = np.concatenate([r[0] for r in rows])
        v = np.concatenate([r[1] for r in rows])
        del rows
        o = np.argsort(g, kind="stable")
        g, u = g[o], vec.unit(v[o])
        del v
        names = hashes.sets(u)
        root = np.arange(len(g))
        for band in range(BANDS):
            one, two = [], []
            k = hashes.key(names, hashes.groups * hashes.lead + (group * BANDS + band) * hashes.rows, hashes.rows)
            o = np.argsort(k, kind="stable")
            ks = k[o]
            start = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
            size = np.diff(np.r_[start, len(o)])
            small = np.repeat((size > 1) & (size <= SMALL), size)
            so, sk = o[small], ks[small]
            su = u[so]
            for d in range(1, SMALL):
                if d >= len(so):
                    break
                at = np.flatnonzero(sk[d:] == sk[:-d])
                if not len(at):
                    break
                cos = np.einsum("ij,ij->i", su[at], su[at + d])
                hit = at[cos >= min_cos - ROUNDING]
                if len(hit):
                    one.append(so[hit])
                    two.append(so[hit + d])
            middle, crowd = (size > SMALL) & (size <= MIDDLE), size > max(SMALL, MIDDLE)
            if middle.any():
                r = o[np.repeat(middle, size)]
                x, y = _upper_links(u[r], np.cumsum(size[middle]) - size[middle], size[middle], min_cos - ROUNDING)
                one.append(r[x])
                two.append(r[y])
            for i, n in zip(start[crowd], size[crowd]):
                r = o[i : i + n]
                x, y = _bucket_links(u[r], min_cos - ROUNDING, root[r])  # what earlier bands joined stays so
                one.append(r[x])
                two.append(r[y])
            if one:
                root = connect(len(g), root[np.concatenate(one)], root[np.concatenate(two)])[root]
        # what no band joined meets the heads of the groups formed here
        size = np.bincount(root, minlength=len(g))
        heads, alone = np.flatnonzero(size >= 3), np.flatnonzero(size[root] < 3)
        one, two = [], []
        for i in range(0, len(alone), 1024):
            a = alone[i : i + 1024]
            for j in range(0, len(heads), 4096):
                near = u[a] @ u[heads[j : j + 4096]].T >= min_cos - ROUNDING
                has = np.flatnonzero(near.any(1))
                if len(has):
                    one.append(root[a[has]])
                    two.append(heads[j + near[has].argmax(1)])
        if one:
            root = connect(len(g), np.concatenate(one), np.concatenate(two))[root]
        at = np.flatnonzero(g[root] != g)
        return pa.table({"a": pa.array(g[at], pa.int64()), "b": pa.array(g[root][at], pa.int64())})

    return run


def _sample(batches):
    for b in batches:
        g, v = vec.usable(b)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([r.tobytes() for r in vec.unit(v)] if len(v) else [], pa.binary())], names=["global_id", "v"])


def linked(vectors: DataFrame, min_cos: float, seed: int = 0) -> DataFrame | None:
    """Links ``(a, b)`` that connect similar vectors; None if no vector is usable."""
    v = vectors.select("global_id", "embedding")
    n = v.count()
    step = max(1, n // FIT_ROWS)
    got = (v.where(F.pmod(F.xxhash64("global_id"), F.lit(step)) == 0) if step > 1 else v).mapInArrow(_sample, "global_id long, v binary").collect()
    if not got:
        return None
    x = np.frombuffer(b"".join(r for _, r in sorted((r.global_id, bytes(r.v)) for r in got)), np.float32).reshape(-1, vec.DIM)
    hashes = vectors.sparkSession.sparkContext.broadcast(Hashes(x, *shape(n), seed))  # codebooks and orders: under 1 MB
    sent = v.mapInArrow(lambda it: _lead(hashes.value)(it), "grp long, lead long, data binary")
    return sent.groupBy("grp", "lead").applyInArrow(lambda k, t: _links(hashes.value, min_cos)(k, t), "a long, b long")


# ---- exact part -------------------------------------------------------------------------------


def _pack_rows(batches):
    for b in batches:
        g, v = vec.usable(b)
        h = vec.halves(v)
        data = [r.astype(np.float16).tobytes() if k else r.tobytes() for r, k in zip(v, h)]
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(data, pa.binary())], names=["global_id", "v"])


def _rows(col: pa.ChunkedArray) -> np.ndarray:
    data = col.to_pylist()
    return np.stack([np.frombuffer(x, np.float16).astype(np.float32) if len(x) == 2 * vec.DIM else np.frombuffer(x, np.float32) for x in data])


def _near(u: np.ndarray, w: np.ndarray, min_cos: float, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which rows of u and w reach ``min_cos``; what single precision can't decide is done in double."""
    s = u @ w.T
    out = s >= min_cos
    a, b = np.nonzero(np.abs(s - min_cos) < 1e-5)
    if len(a):
        out[a, b] = vec.cosines(v[a], x[b]) >= min_cos
    return out


def _merge_ids(a: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """An adjacency over rows reduced to one over ids (similar where any rows are)."""
    if len(group) == n:
        return a
    out = np.zeros((n, n), bool)
    r, c = np.nonzero(a)
    out[group[r], group[c]] = True
    return out


def _mask(on: np.ndarray) -> int:
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def _bits(mask: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little").astype(bool)


def search_of(adj: np.ndarray, weight: np.ndarray, **more) -> dict:
    """A search for maximal cliques at its start: medoid by medoid, highest degree first."""
    order = sorted(range(len(adj)), key=lambda i: (-int(weight[adj[i]].sum()), i))
    return {"adj": adj, "weight": weight, "stack": [], "anchors": order, "gone": 0} | more


def is_open(work: dict) -> bool:
    return bool(work["stack"] or work["anchors"])


def advance(work: dict, least: int, steps: int, room: int = ROOM) -> list[int]:
    """Go on with a search for ``steps`` steps or until the sets found have ``room`` members; what is left stays in it."""
    weight, stack, anchors, gone, at = work["weight"], work["stack"], work["anchors"], work["gone"], 0
    near = [_mask(row) & ~(1 << i) for i, row in enumerate(work["adj"])]
    heavy = lambda mask: sum(int(weight[i]) for i in _ones(mask))
    found: list[int] = []
    while steps > 0 and room > 0:
        if not stack:
            if at == len(anchors):
                break
            m = anchors[at]
            at += 1
            stack.append((1 << m, near[m] & ~gone, near[m] & gone))
            gone |= 1 << m
        steps -= 1
        chosen, cand, done = stack.pop()
        if (chosen | cand).bit_count() < least and heavy(chosen | cand) < least:
            continue
        if not cand:
            if not done:
                found.append(chosen)
                room -= heavy(chosen)
            continue
        pivot = max(_ones(cand | done), key=lambda i: (near[i] & cand).bit_count())
        for i in _ones(cand & ~near[pivot]):
            stack.append((chosen | 1 << i, cand & near[i], done & near[i]))
            cand &= ~(1 << i)
            done |= 1 << i
    work["anchors"], work["gone"] = anchors[at:], gone
    return found


def _cut(work: dict, stack: list, anchors: list[int], gone: int) -> dict:
    """Part of a search, with the rows it needs alone."""
    adj, n = work["adj"], len(work["adj"])
    used = np.zeros(n, bool)
    for state in stack:
        used |= _bits(state[0] | state[1] | state[2], n)
    if anchors:
        used |= adj[anchors].any(0)
        used[anchors] = True
    at, new = np.flatnonzero(used), np.cumsum(used) - 1
    sub = lambda mask: _mask(_bits(mask, n)[at])
    keep = used[work["cls"]]
    return {"adj": adj[np.ix_(at, at)], "weight": work["weight"][at], "stack": [tuple(map(sub, x)) for x in stack], "anchors": [int(new[m]) for m in anchors], "gone": sub(gone),
            "ids": work["ids"][keep], "cls": new[work["cls"][keep]], "u": work["u"][keep]}


def divide(work: dict, parts: int = PARTS) -> list[dict]:
    """The rest of a search as up to ``2 * parts`` searches of their own."""
    out = [_cut(work, mine, [], 0) for i in range(parts) if (mine := work["stack"][i::parts])]
    gone, step = work["gone"], max(1, -(-len(work["anchors"]) // parts))
    for i in range(0, len(work["anchors"]), step):
        mine = work["anchors"][i : i + step]
        out.append(_cut(work, [], mine, gone))
        for m in mine:
            gone |= 1 << m
    return out


def maximal_sets(adj: np.ndarray, weight: np.ndarray, least: int, steps: int = STEPS) -> list[np.ndarray]:
    """All maximal cliques of weight ``least`` or more, ``steps`` steps at a time."""
    work, found = search_of(adj, weight), []
    while is_open(work):
        found += advance(work, least, steps)
    return [np.array(list(_ones(x)), np.int64) for x in found]


def _ones(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _adjacency(gid: np.ndarray, v: np.ndarray, u: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids, and which of them are similar."""
    ids, group = np.unique(gid, return_inverse=True)
    adj = np.zeros((len(gid), len(gid)), bool)
    for i in range(0, len(gid), 2048):
        adj[i : i + 2048] = _near(u[i : i + 2048], u, min_cos, v[i : i + 2048], v)
    adj = _merge_ids(adj, group, len(ids))
    if len(group) == len(ids):
        adj = adj[np.argsort(gid)][:, np.argsort(gid)]
    np.fill_diagonal(adj, True)
    return ids, adj


def _twins(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, class, count) of equal rows: members with the same neighbours (themselves among them) are in the same sets."""
    bits = np.ascontiguousarray(np.packbits(rows, axis=1))
    return np.unique(bits.view(f"V{bits.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)[1:]


def _first(ids: np.ndarray, gid: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The first vector of each id."""
    o = np.argsort(gid, kind="stable")
    return u[o[np.searchsorted(gid[o], ids)]]


def _search(gid: np.ndarray, v: np.ndarray, min_cos: float, least: int) -> dict | None:
    """The search for all clusters among some vectors."""
    if len(np.unique(gid)) < least:
        return None
    u = vec.unit(v)
    ids, adj = _adjacency(gid, v, u, min_cos)
    at = np.arange(len(ids))
    while len(at):
        keep = adj.sum(1) >= least
        if keep.all():
            break
        at, adj = at[keep], adj[keep][:, keep]
    if not len(at):
        return None
    first, cls, cnt = _twins(adj)
    return search_of(adj[first][:, first], cnt, ids=ids[at], cls=cls, u=_first(ids[at], gid, u))


def clusters_of(gid: np.ndarray, v: np.ndarray, min_cos: float, least: int) -> list[np.ndarray]:
    """All clusters among some vectors, as arrays of distinct ids."""
    work = _search(gid, v, min_cos, least)
    if work is None:
        return []
    sets = maximal_sets(work["adj"], work["weight"], least)
    return [work["ids"][np.isin(work["cls"], s)] for s in sets]


def _typical(u: np.ndarray) -> np.ndarray:
    """Mean cosine of each member to the others (of an id with several vectors, the first's)."""
    w = u.astype(np.float64)
    return (w @ w.sum(0) - 1) / max(1, len(w) - 1)


def _table(comp: int, work: dict | None, least: int) -> pa.Table:
    """What ``STEPS`` steps of a search find, and the rest of it for further tasks."""
    out, todo = [], []
    if work is not None:
        n = len(work["adj"])
        for x in advance(work, least, STEPS):
            at = _bits(x, n)[work["cls"]]
            g = work["ids"][at]
            # a set's number follows from its members, whichever task finds it
            nth = int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "big") >> 1
            out.append((np.full(len(g), nth), np.full(len(g), g[0]), g, np.full(len(g), len(g)), _typical(work["u"][at])))
        if is_open(work):
            todo = [pickle.dumps(w | {"adj": np.packbits(w["adj"], axis=1)}, 5) for w in divide(work)]
    k, c, g, n, ty = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
    none = lambda kind: pa.nulls(len(todo), kind)
    cols = [pa.concat_arrays([pa.array(x, kind), none(kind)]) for x, kind in ((k, pa.int64()), (c, pa.int64()), (g, pa.int64()), (n, pa.int64()), (ty, pa.float64()))]
    return pa.Table.from_arrays([pa.array(np.full(len(g) + len(todo), comp), pa.int64()), *cols, pa.concat_arrays([pa.nulls(len(g), pa.binary()), pa.array(todo, pa.binary())])], names=SPLIT_NAMES)


def _split(min_cos: float, least: int):
    def run(key, t):
        return _table(key[0].as_py(), _search(t["global_id"].to_numpy(), _rows(t["v"]), min_cos, least), least)

    return run


def _resume(least: int):
    def run(batches):
        for b in batches:
            for comp, data in zip(b.column("comp").to_pylist(), b.column("todo").to_pylist()):
                w = pickle.loads(data)
                w["adj"] = np.unpackbits(w["adj"], axis=1, count=len(w["adj"])).astype(bool)
                yield from _table(comp, w, least).to_batches()

    return run


def _all_sets(split: DataFrame, least: int) -> DataFrame:
    """All members of all sets: what one task's budget leaves over goes to further tasks, round by round."""
    out = None
    while True:
        split = stage(split, "sets")
        members = split.where("todo is null").drop("todo")
        out = members if out is None else out.unionByName(members)
        todo = split.where("todo is not null").select("comp", "todo")
        n = todo.count()
        if not n:
            return out
        split = todo.repartition(min(n, 4000)).mapInArrow(_resume(least), SPLIT)


def _around(min_cos: float, least: int):
    """The sets of some members' neighbourhoods: each with its neighbours later in the order of degrees."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        gid, v = t["global_id"].to_numpy(), _rows(t["v"])
        u = vec.unit(v)
        ids, first, group = np.unique(gid, return_index=True, return_inverse=True)
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((ids, t["deg"].to_numpy()[first]))] = np.arange(len(ids))
        mine = t["mine"].to_numpy(zero_copy_only=False)[first]
        for m in np.flatnonzero(mine):
            r = np.flatnonzero(group == m)
            near = np.zeros(len(ids), bool)
            near[group[_near(u[r], u, min_cos, v[r], v).any(0)]] = True
            near[m] = False
            if (near & (place > place[m])).sum() + 1 < least:
                continue
            r = np.flatnonzero(near[group])
            others, adj = _adjacency(gid[r], v[r], u[r], min_cos) if len(r) else (ids[:0], np.zeros((0, 0), bool))
            before = place[near] < place[m]
            full = np.ones((len(others) + 1, len(others) + 1), bool)
            full[1:, 1:] = adj
            status = np.r_[2, before.astype(np.uint8)]  # m itself, later ones, earlier ones
            one, cls, cnt = _twins(np.c_[full, status == 0, status == 2])
            full, status = full[one][:, one], status[one]
            state = tuple(_mask(status == s) for s in (2, 0, 1))
            names = np.r_[ids[m], others]
            o = np.argsort(names)
            work = {"adj": full, "weight": cnt, "stack": [state], "anchors": [], "gone": 0, "ids": names[o], "cls": cls[o], "u": _first(names[o], gid, u)}
            yield from _table(key[0].as_py(), work, least).to_batches()

    return run


def _block_degrees(min_cos: float):
    def run(key, t):
        o = np.argsort(t["global_id"].to_numpy(), kind="stable")
        gid, v, side = t["global_id"].to_numpy()[o], _rows(t["v"])[o], t["side"].to_numpy()[o]
        u = vec.unit(v)
        i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: a block with itself
        one, two = (np.unique(gid[x], return_index=True) for x in (i, j))  # ids and their first rows: an id may have several
        end = np.r_[one[1][1:], len(i)]
        deg, deg2 = np.zeros(len(one[0]), np.int64), np.zeros(len(two[0]), np.int64)
        for x in range(0, len(one[0]), 2048):
            ids, at = one[0][x : x + 2048], one[1][x : x + 2048]
            a = i[at[0] : end[x : x + 2048][-1]]
            near = _near(u[a], u[j], min_cos, v[a], v[j])
            if len(two[0]) < len(j):
                near = np.logical_or.reduceat(near, two[1], axis=1)
            if len(ids) < len(a):
                near = np.logical_or.reduceat(near, at - at[0], axis=0)
            near &= ids[:, None] != two[0][None, :]
            deg[x : x + 2048] += near.sum(1)
            deg2 += near.sum(0)
        g, d = (one[0], deg) if (side == 2).any() else (np.r_[one[0], two[0]], np.r_[deg, deg2])
        return pa.table({"comp": pa.array(np.full(len(g), key[0].as_py()), pa.int64()), "global_id": pa.array(g, pa.int64()), "deg": pa.array(d, pa.int64())})

    return run


def _units(batches):
    for b in batches:
        u = vec.unit(_rows(b.column("v"))).astype(np.float64) if b.num_rows else np.zeros((0, vec.DIM))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * vec.DIM), pa.array(u.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("comp"), b.column("global_id"), lists], names=["comp", "global_id", "u"])


def _with_typical(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``typical`` of clusters of any size: each member against the sum of its cluster (of an id with several vectors, one)."""
    u = vectors.groupBy("comp", "global_id").agg(F.min("v").alias("v")).mapInArrow(_units, "comp long, global_id long, u array<double>")
    m = members.join(u, ["comp", "global_id"])
    total = m.groupBy("comp", "nth").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(vec.DIM)]).alias("total"))
    dot = F.aggregate(F.zip_with("u", "total", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return m.join(total, ["comp", "nth"]).select("comp", "nth", "cluster_gid", "global_id", "n", ((dot - 1) / F.greatest(F.lit(1), F.col("n") - 1)).alias("typical"))


def _large(members: DataFrame, sizes: DataFrame, min_cos: float, least: int) -> DataFrame:
    """Clusters of the components above ``LARGE``. members: one row for each vector of an id."""
    m = members.join(sizes.select("comp", "size"), "comp")
    blocks = F.ceil(F.col("size") / F.lit(LARGE / 2)).cast("int")
    m = m.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("global_id"), F.col("blocks").cast("long")).cast("int"))
    # each block meets every other: a member travels once for each block of its component
    pairs = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "comp", "global_id", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))
    deg = pairs.groupBy("comp", "i", "j").applyInArrow(_block_degrees(min_cos), "comp long, global_id long, deg long").groupBy("comp", "global_id").agg(F.sum("deg").alias("deg"))
    deg = stage(m.select("comp", "global_id", "v", "size").join(deg, ["comp", "global_id"]), "degrees")
    core = deg.where("deg = size - 1").select("comp", "global_id").distinct()
    rest = deg.where(f"deg < size - 1 and deg >= {least - 1}").select("comp", "global_id", "v", "deg")
    # sets of the others: every one of them together with the core; a lone core is a set itself
    rests = rest.groupBy("comp").agg(F.countDistinct("global_id").alias("n_rest"))
    rest = rest.join(rests, "comp")
    split = rest.where(F.col("n_rest") <= LARGE).groupBy("comp").applyInArrow(_split(min_cos, 1), SPLIT)
    # where the others are many, every one's neighbourhood is searched for itself
    parts = F.ceil(F.col("n_rest") / F.lit(ANCHORS)).cast("int")
    many = rest.where(F.col("n_rest") > LARGE).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "comp", "part", "global_id", "v", "deg", (F.pmod(F.xxhash64("global_id"), parts.cast("long")) == F.col("part")).alias("mine"))
    around = _around(min_cos, 1)
    split = split.unionByName(many.groupBy("comp", "part").applyInArrow(around, SPLIT))
    sets = _all_sets(split, 1).select("comp", F.col("nth").alias("part"), "global_id", F.lit(False).alias("core"))
    n_core = core.groupBy("comp").agg(F.count("*").alias("n_core"), F.min("global_id").alias("least_core"))
    keyed = sets.select("comp", "part").distinct()
    with_core = core.join(keyed, "comp", "left").select("comp", F.coalesce("part", F.lit(-1)).alias("part"), "global_id", F.lit(True).alias("core"))
    both = sets.unionByName(with_core)
    size = both.groupBy("comp", "part").agg(F.count("*").alias("n"), F.min("global_id").alias("cluster_gid")).where(f"n >= {least}")
    found = both.join(size, ["comp", "part"]).select("comp", F.col("part").alias("nth"), "cluster_gid", "global_id", "n")
    return _with_typical(found, deg)


def find(vectors: DataFrame, min_cos: float = 0.70, least: int = 8, seed: int = 0) -> DataFrame:
    """``(comp, nth, cluster_gid, global_id, n, typical)``: one row for each member of each cluster.

    ``typical`` is the mean cosine to the other members.
    """
    spark = vectors.sparkSession
    links = linked(vectors, min_cos, seed)
    if links is None:
        return spark.createDataFrame([], MEMBERS)
    links = stage(links, "links")
    release_shuffles(spark)
    roots = stage(components(links).select(F.col("node").alias("global_id"), F.col("root").alias("comp")), "roots")
    sizes = stage(roots.groupBy("comp").agg(F.count("*").alias("size")).where(f"size >= {least}"), "sizes")
    members = roots.join(sizes.select("comp", "size"), "comp")
    packed = vectors.select("global_id", "embedding").mapInArrow(_pack_rows, "global_id long, v binary")
    placed = packed.join(members, "global_id")
    out = _all_sets(placed.where(F.col("size") <= LARGE).groupBy("comp").applyInArrow(_split(min_cos, least), SPLIT), least)
    if sizes.where(F.col("size") > LARGE).limit(1).count():
        big = placed.where(F.col("size") > LARGE).select("comp", "global_id", "v").distinct()
        out = out.unionByName(_large(big, sizes.where(F.col("size") > LARGE), min_cos, least))
    return out
