"""Choosing a varied subset: tournament-pivoted rank-revealing QR.

A row's feature vector is ``e(site, day) (x) phi(time of day)``: one block of coordinates for each
site and day, filled with a few harmonics of the time of day. Blocks are orthogonal, so the
pivots of the one large QR are those of one small QR per block, and no block's size gives it
more pivots than its neighbours.

Method: in every input partition each block's rows go through a column-pivoted QR that nominates
linearly independent rows (the largest residual first); once a block's rank is used up its chosen
rows are taken out (deflation) and the QR starts again on the rest, until it has nominated as
many rows as a block can need. Nominees then meet in pairs, up a tree, and are pivoted again. What
is shuffled is nominees only, and a group is at most ``FAN`` partitions' nominees of one block, so
a block that holds a third of all rows is split like any other.

How many rows a block gives follows from the block sizes: every block gives its first pivot, then
every block its second, and so on, until k rows stand. So every site and day is covered once k
reaches their number. In the last round, where not all fit (the only one, if k is below the number of
blocks), the nominees of that round meet in the same way one level up: their features are ``e(site) (x)
psi(day)``, with harmonics of the season and of the years; each site's are pivoted in deflated rounds, and the
sites give their pivots in turn. Where not all sites fit, they go by residual, then by a hash.

Defined results: rows without site or time, or before ``floor_ns``, are never chosen; repeated
rows (same id, site and time) count once; ties go to the lower id, then the earlier time; k above
the number of rows chooses all, k of 0 or below none; an empty table gives no rows. The choice
inside a block may depend on how the input is partitioned; the number of rows per block does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.session import stage
from lodevec.sources.tables import code

DAY_NS = 86_400_000_000_000
FLOOR_NS = 1_104_537_600_000_000_000  # 2005-01-01 UTC
RANK = 8
FAN = 32
SCHEMA = "node long, site string, day long, global_id long, time_ns long, rank int, pivot double"


def usable_rows(manifest: DataFrame, floor_ns: int = FLOOR_NS) -> DataFrame:
    m = manifest.select("global_id", code("site").alias("site"), F.col("time_ns").cast("long").alias("time_ns"))
    return m.where(f"site is not null and time_ns is not null and time_ns >= {floor_ns}")


def features(time_ns: np.ndarray) -> np.ndarray:
    x = (time_ns % DAY_NS) / DAY_NS * 2 * np.pi
    cols = [np.ones(len(x))]
    for h in range(1, RANK):
        f = (h + 1) // 2
        cols.append((np.cos if h % 2 else np.sin)(f * x) / f)
    return np.stack(cols, 1)


YEAR = 365.2425


def day_features(day: np.ndarray) -> np.ndarray:
    """Harmonics of the season, and of eight years: near days are alike, opposite seasons are not."""
    x = day / YEAR * 2 * np.pi
    cols = [np.ones(len(day))]
    for f in (1, 2):
        cols += [np.sin(f * x) / f, np.cos(f * x) / f]
    cols += [np.sin(x / 8), np.cos(x / 8), np.sin(x / 3) / 2]
    return np.stack(cols, 1)


def pivots(feat: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` row numbers by deflated rounds of pivoted QR, and their residual norms."""
    left = np.arange(len(feat))
    order: list[int] = []
    size: list[float] = []
    while len(order) < most and len(left):
        r = feat[left].copy()
        norms = (r * r).sum(1)
        taken = np.zeros(len(left), bool)
        for _ in range(min(RANK, most - len(order), len(left))):
            p = int(np.argmax(norms))
            if norms[p] <= 1e-12:
                break
            q = r[p] / np.sqrt(norms[p])
            order.append(int(left[p]))
            size.append(float(np.sqrt(norms[p])))
            taken[p] = True
            r -= np.outer(r @ q, q)
            norms = np.where(taken, -1.0, (r * r).sum(1))
        if not taken.any():  # rows without any feature left: as they come
            rest = left[: most - len(order)]
            order += [int(x) for x in rest]
            size += [0.0] * len(rest)
            break
        left = left[~taken]
    return np.array(order, np.int64), np.array(size)


def _best(gid: np.ndarray, t: np.ndarray, most: int):
    """Distinct (id, time), pivoted: ids, times, residual norms in order of choice."""
    o = np.lexsort((t, gid))
    gid, t = gid[o], t[o]
    keep = np.ones(len(gid), bool)
    keep[1:] = (gid[1:] != gid[:-1]) | (t[1:] != t[:-1])
    gid, t = gid[keep], t[keep]
    at, size = pivots(features(t), most)
    return gid[at], t[at], size


NO_ID = np.iinfo(np.int64).min  # stands for a null global_id


def _rows(node, site, day, gid, t, size) -> pa.RecordBatch:
    n = len(gid)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, node), pa.int64()), pa.array([site] * n, pa.string()), pa.array(np.full(n, day), pa.int64()), pa.array(gid, pa.int64(), mask=gid == NO_ID), pa.array(t, pa.int64()), pa.array(np.arange(1, n + 1), pa.int32()), pa.array(size, pa.float64())],
        names=["node", "site", "day", "global_id", "time_ns", "rank", "pivot"],
    )


def _nominate(most: int):
    def run(batches):
        from pyspark import TaskContext

        node, held = TaskContext.get().partitionId(), {}
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column("site").dictionary_encode()
            names = d.dictionary.to_pylist()
            s = d.indices.to_numpy()
            g = b.column("global_id").fill_null(int(NO_ID)).to_numpy()
            t = b.column("time_ns").to_numpy()
            day = t // DAY_NS
            o = np.lexsort((day, s))
            cut = np.flatnonzero(np.r_[True, (s[o][1:] != s[o][:-1]) | (day[o][1:] != day[o][:-1])])
            for i, j in zip(cut, np.r_[cut[1:], len(o)]):
                rows = o[i:j]
                key = (names[s[rows[0]]], int(day[rows[0]]))
                old = held.get(key)
                gg, tt = (g[rows], t[rows]) if old is None else (np.r_[old[0], g[rows]], np.r_[old[1], t[rows]])
                held[key] = _best(gg, tt, most)
        for (site, day), (gg, tt, size) in held.items():
            yield _rows(node, site, day, gg, tt, size)

    return run


def _replay(most: int):
    def run(key, t):
        node, site, day = (x.as_py() for x in key)
        at = t["node0"].to_numpy()
        g, tt = t["global_id"].fill_null(int(NO_ID)).to_numpy(), t["time_ns"].to_numpy()
        parts = [(g[at == n], tt[at == n], None) for n in np.unique(at)]
        while len(parts) > 1:  # pairwise tree
            parts = [_best(np.r_[parts[i][0], parts[i + 1][0]], np.r_[parts[i][1], parts[i + 1][1]], most) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        gg, ts, size = parts[0] if parts[0][2] is not None else _best(parts[0][0], parts[0][1], most)
        return pa.Table.from_batches([_rows(node, site, day, gg, ts, size)])

    return run


def _in_turn(most: int):
    """The nominees of one site, one for each of its days, in order of their pivots: ``turn`` from 1."""

    def run(key, t):
        t = t.sort_by([("day", "ascending")])
        at, size = pivots(day_features(t["day"].to_numpy()), min(most, t.num_rows))
        return t.select(["site", "day"]).take(pa.array(at)).append_column("turn", pa.array(np.arange(1, len(at) + 1), pa.int32())).append_column("residual", pa.array(size))

    return run


LAST = "site string, day long"


def last_round(nominees: DataFrame, k: int) -> DataFrame:
    """``k`` of the nominees, at most one a block, spread over the sites and within them over the days."""
    days = nominees.select("site", "day")
    sizes = [(r.n, r.b) for r in days.groupBy("site").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("b")).collect()]
    lv, extra = level(sizes, k)
    most = lv + (extra > 0)
    turns = days.groupBy("site").applyInArrow(_in_turn(most), LAST + ", turn int, residual double")
    chosen = turns.where(F.col("turn") <= lv)
    if extra:
        chosen = chosen.unionByName(turns.where(F.col("turn") == most).orderBy(F.desc(F.round("residual", 6)), F.xxhash64("site"), "site").limit(extra))
    return nominees.join(chosen.select("site", "day"), ["site", "day"], "left_semi")


def level(sizes: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """``(L, r)``: all blocks give up to L rows, r of those with more give one row more. sizes: (rows, blocks)."""
    level_, left, alive = 0, max(0, k), sum(b for _, b in sizes)
    for n, b in sorted(sizes):
        step = n - level_
        if alive * step > left:
            return level_ + left // alive, left % alive
        left -= alive * step
        level_, alive = n, alive - b
    return level_, 0


def choose(manifest: DataFrame, k: int | None = None, share_permille: int | None = None) -> DataFrame:
    """``(global_id, site, obs_day, time_ns, pick)``: k rows, or that share of the usable rows."""
    rows = usable_rows(manifest)
    distinct = rows.distinct()
    # sizes of the blocks as a histogram: at most sqrt(2 N) rows, whatever the data
    hist = distinct.groupBy("site", F.expr(f"time_ns div {DAY_NS}L").alias("day")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("b")).collect()
    sizes = [(r.n, r.b) for r in hist]
    if k is None:
        k = -(-(share_permille or 0) * rows.count() // 1000)
    lv, extra = level(sizes, k)
    most = lv + (extra > 0)
    spark = manifest.sparkSession
    if most == 0:
        return spark.createDataFrame([], "global_id long, site string, obs_day string, time_ns long, pick int")
    nominees = rows.select("global_id", "site", "time_ns").mapInArrow(_nominate(most), SCHEMA)
    width = max(1, rows.rdd.getNumPartitions())
    while True:
        up = nominees.withColumn("node0", F.col("node")).withColumn("node", F.expr(f"node div {FAN}L"))
        nominees = up.groupBy("node", "site", "day").applyInArrow(_replay(most), SCHEMA)
        width = -(-width // FAN)
        if width <= 1:
            break
    if extra:
        nominees = stage(nominees, "nominees")
        last = last_round(nominees.where(F.col("rank") == most), extra)
        nominees = nominees.where(F.col("rank") < most).unionByName(last)
    day = F.date_format(F.timestamp_seconds(F.col("day") * 86400), "yyyyMMdd")
    return nominees.select("global_id", "site", day.alias("obs_day"), "time_ns", F.col("rank").alias("pick"))


def requested(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """One subset for each row of ``subset_requests`` (a table written by hand), with its name."""
    out = None
    for r in requests.select("request_name", "share_permille").distinct().orderBy("request_name", "share_permille").collect():
        d = choose(manifest, share_permille=r.share_permille or 0).withColumn("request_name", F.lit(r.request_name).cast("string"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        out = manifest.sparkSession.createDataFrame([], "global_id long, site string, obs_day string, time_ns long, pick int, request_name string")
    return out
