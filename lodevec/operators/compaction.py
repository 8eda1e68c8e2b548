"""Consolidating very many small files into few well-sized ones.

The frames of a site-hour lie in many small files, some in several of them. Out come files in
which the frames stand in order of (site, hour, frame), each once, rolled by bytes, with the key
range of every file.

Method: sorted-run consolidation. The rows of a file, as they are stored, are a sorted run (one that
is not in order is sorted when it is read); a scan cuts them at every ``BLOCK`` frame numbers and
packs each piece into one row, without a shuffle. Pieces meet by (file, block), where those of a block
are merged; the merged runs then go to key ranges, where what is left of each block is merged and files
are rolled by bytes. A merge lays the sorted runs of many keys end to end and sorts them stably, whole
columns at once: Timsort finds the runs and merges them, no row is touched by itself. Frames that
several files hold come from the first file in order of path, with the number of files.

Sizes are those of ``shard_files``: a site-hour's bytes over the rows its files had; a file without a
size counts as the mean file, and without any sizes a frame has ``FRAME_BYTES``.

A site-hour, a file or one frame's copies may hold a third of all rows: blocks split the first two, and
copies of a frame are spread by their file before they meet. Repeats within a file are reduced when it is
read. A task streams; it holds ``CHUNK`` rows of whole keys, or one block.

Defined results: rows without path or frame number, or whose path names no site-hour, take no
part; exact repeats count once; different ids for one frame: the lowest of the file that is kept;
an empty table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.session import shared_folder, stage

BLOCK = 4096
FRAME_BYTES = 128  # a 64-number half-precision vector
TARGET_BYTES = 128 << 20
CHUNK = 1 << 18  # frames merged at once
FRAMES = "site string, obs_hour string, frame_idx int, global_id long, time_ns long, shard_path string, n_copies int"
# The two families of layouts, by name and by key, with either slash.
BY_NAME = r"(?:^|/)\s*([^/]+?)\s*/[0-9]{4}/([0-9]{10})"
BY_KEY = r"(?:^|/)site=\s*([^/]+?)\s*/dt=([0-9]{4})-([0-9]{2})-([0-9]{2})/hh=([0-9]{2})"
NONE = np.iinfo(np.int64).max  # stands for null: such ids and times come last
# A run: the frames of one block, in order; which file each frame comes from, and in how many it lies.
RUN = "site string, obs_hour string, block long, first_path string, last_path string, n_rows long, paths array<string>, path_no array<int>, frame_idx array<int>, global_id array<long>, time_ns array<long>, n_copies array<int>"
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_RUN = pa.schema([("site", pa.string()), ("obs_hour", pa.string()), ("block", pa.int64()), ("first_path", pa.string()), ("last_path", pa.string()), ("n_rows", pa.int64()),
                  ("paths", pa.list_(pa.string())), ("path_no", _INTS), ("frame_idx", _INTS), ("global_id", _LONGS), ("time_ns", _LONGS), ("n_copies", _INTS)])


def site_hour(path: Column) -> tuple[Column, Column]:
    """Site code and ``YYYYMMDDHH`` that a shard path names, null if it names none.

    Two families of layouts: ``.../<site>/<YYYY>/<YYYYMMDDHH>...`` and
    ``.../site=<site>/dt=<YYYY-MM-DD>/hh=<HH>/...``, with either slash.
    """
    p = F.lower(F.translate(path, "\\", "/"))
    keyed = p.rlike(BY_KEY)
    site = F.when(keyed, F.regexp_extract(p, BY_KEY, 1)).otherwise(F.regexp_extract(p, BY_NAME, 1))
    hour = F.when(keyed, F.concat(*[F.regexp_extract(p, BY_KEY, k) for k in (2, 3, 4, 5)])).otherwise(F.regexp_extract(p, BY_NAME, 2))
    return F.nullif(site, F.lit("")), F.nullif(hour, F.lit(""))


def _site_hour(path: str) -> tuple[str, str] | None:
    """:func:`site_hour` of one path."""
    p = path.replace("\\", "/").lower()
    k = re.search(BY_KEY, p, re.ASCII)
    if k:
        return k[1], "".join(k.groups()[1:])
    n = re.search(BY_NAME, p, re.ASCII)
    return (n[1], n[2]) if n else None


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """First positions of the stretches of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType, null: bool = False) -> pa.ListArray:
    v = pa.array(values, kind, mask=values == NONE) if null else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.r_[at, len(values)].astype(np.int32)), v)


def _form(batches):
    """Runs of a scan: the rows of each file and block in a batch, in order, repeats once."""
    for b in batches:
        if not b.num_rows:
            continue
        d = b.column("shard_path").dictionary_encode()
        names = d.dictionary.to_pylist()
        hours = [_site_hour(x) for x in names]
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        p = rank[d.indices.to_numpy()]
        good = np.array([hours[i] is not None for i in order], bool)[p]
        f = b.column("frame_idx").to_numpy()
        g, t = (b.column(c).fill_null(int(NONE)).to_numpy() for c in ("global_id", "time_ns"))
        p, f, g, t = p[good], f[good], g[good], t[good]
        if not len(p):
            continue
        block = np.floor_divide(f, BLOCK).astype(np.int64)
        o = np.lexsort((t, g, f, p))
        p, f, g, t, block = p[o], f[o], g[o], t[o], block[o]
        keep = np.zeros(len(p), bool)
        keep[_cuts(p, f)] = True
        at = _cuts(p, block)
        n_rows = np.diff(np.r_[at, len(p)])
        p, f, g, t, block = p[keep], f[keep], g[keep], t[keep], block[keep]
        at = _cuts(p, block)
        path = [names[order[i]] for i in p[at]]
        site, hour = zip(*[hours[order[i]] for i in p[at]])
        ones = np.ones(len(p), np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(site), pa.array(hour), pa.array(block[at]), pa.array(path), pa.array(path), pa.array(n_rows), pa.array([[x] for x in path]),
             _lists(ones - 1, at, pa.int32()), _lists(f, at, pa.int32()), _lists(g, at, pa.int64(), True), _lists(t, at, pa.int64(), True), _lists(ones, at, pa.int32())],
            schema=_RUN)


def runs(manifest: DataFrame) -> DataFrame:
    """The sorted runs of all files: one row for each file and block of a scan's batch. No shuffle."""
    m = manifest.where("shard_path is not null and frame_idx is not null")
    return m.select("shard_path", F.col("frame_idx").cast("int").alias("frame_idx"), F.col("global_id").cast("long").alias("global_id"), F.col("time_ns").cast("long").alias("time_ns")).mapInArrow(_form, RUN)


def _tail(t: pa.Table, columns: list[str]) -> int:
    """Where the stretch of rows that agree with the last row begins."""
    same = np.ones(t.num_rows, bool)
    for c in columns:
        same &= pc.equal(t[c], t[c][-1]).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if len(other) else 0


def _whole_keys(batches):
    """Tables of whole keys, of about ``CHUNK`` frames; the runs of a key that is longer come merged, file by file."""
    held: list[pa.Table] = []
    frames = lambda t: pc.sum(pc.list_value_length(t["frame_idx"])).as_py() or 0
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b.select(_RUN.names)]))
        size += frames(held[-1])
        if size < CHUNK:
            continue
        t = pa.concat_tables(held).combine_chunks()
        first = _tail(t, ["site", "obs_hour", "block"])
        if first:
            yield t.slice(0, first)
            held = [t.slice(first)]
        else:  # all one key: the last file may go on, the others are done
            cut = _tail(t, ["first_path"])
            held = [pa.Table.from_batches([_merge(x)]) for x in (t.slice(0, cut), t.slice(cut)) if x.num_rows]
        size = sum(map(frames, held))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _merge(t: pa.Table) -> pa.RecordBatch:
    """One run for each key of a table of runs; runs with a file in common count it once where they follow each other."""
    col = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    flat = lambda c: col(c).flatten()
    keys = [col(c).dictionary_encode().indices.to_numpy() for c in ("site", "obs_hour")] + [col("block").to_numpy()]
    row_at = _cuts(*keys)
    group = np.repeat(np.arange(len(row_at)), np.diff(np.r_[row_at, t.num_rows]))
    n = pc.list_value_length(col("frame_idx")).to_numpy()
    of = np.repeat(np.arange(t.num_rows), n)
    names = flat("paths").dictionary_encode()
    words = names.dictionary.to_pylist()
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    rank = np.empty(max(1, len(words)), np.int64)
    rank[order] = np.arange(len(words))
    per = pc.list_value_length(col("paths")).to_numpy()
    base = np.cumsum(per) - per
    p = rank[names.indices.to_numpy()[base[of] + flat("path_no").to_numpy()]]
    f, copies = flat("frame_idx").to_numpy(), flat("n_copies").to_numpy()
    g, ts = (flat(c).fill_null(int(NONE)).to_numpy() for c in ("global_id", "time_ns"))
    k = group[of]
    o = np.lexsort((ts, g, p, f, k))
    k, f, p, g, ts, copies = k[o], f[o], p[o], g[o], ts[o], copies[o]
    # a file's repeats of a frame count once; its run has as many copies as its files
    same_file = np.zeros(len(k), bool)
    same_file[1:] = (k[1:] == k[:-1]) & (f[1:] == f[:-1]) & (p[1:] == p[:-1])
    head = _cuts(k, f)
    total = np.add.reduceat(np.where(same_file, 0, copies), head) if len(head) else copies
    k, f, p, g, ts = k[head], f[head], p[head], g[head], ts[head]
    at = np.searchsorted(k, np.arange(len(row_at)))
    # the files that are left, per key
    key_path = np.unique(k * np.int64(len(words)) + p) if len(k) else np.zeros(0, np.int64)
    pk, pp = np.divmod(key_path, np.int64(max(1, len(words))))
    p_at = np.searchsorted(pk, np.arange(len(row_at)))
    no = np.searchsorted(key_path, k * np.int64(len(words)) + p) - p_at[k]
    firsts, lasts = col("first_path").to_pylist(), col("last_path").to_pylist()
    ends = np.r_[row_at[1:], t.num_rows]
    paths = pa.ListArray.from_arrays(pa.array(np.r_[p_at, len(pp)].astype(np.int32)), pa.array([words[i] for i in order], pa.string()).take(pa.array(pp)))
    take = pa.array(row_at)
    return pa.RecordBatch.from_arrays(
        [col("site").take(take), col("obs_hour").take(take), col("block").take(take), pa.array([min(firsts[i:j]) for i, j in zip(row_at, ends)], pa.string()), pa.array([max(lasts[i:j]) for i, j in zip(row_at, ends)], pa.string()),
         pa.array(np.add.reduceat(col("n_rows").to_numpy(), row_at) if len(row_at) else np.zeros(0, np.int64)), paths,
         _lists(no.astype(np.int32), at, pa.int32()), _lists(f, at, pa.int32()), _lists(g, at, pa.int64(), True), _lists(ts, at, pa.int64(), True), _lists(total.astype(np.int32), at, pa.int32())],
        schema=_RUN)


def _merge_runs(batches):
    for t in _whole_keys(batches):
        yield _merge(t)


def merged(run_table: DataFrame) -> DataFrame:
    """The runs of each block, merged by the file they lie in: a frame's copies are spread, each file stands in one task."""
    at = run_table.repartition(F.xxhash64("first_path", "block")).sortWithinPartitions("site", "obs_hour", "block", "first_path")
    return at.mapInArrow(_merge_runs, RUN)


def hour_bytes(run_table: DataFrame, shard_files: DataFrame | None) -> DataFrame:
    """``(site, obs_hour, frame_bytes)``: what a stored row of each site-hour takes."""
    rows = run_table.groupBy("site", "obs_hour").agg(F.sum("n_rows").alias("n"))
    if shard_files is None:
        return rows.select("site", "obs_hour", F.lit(float(FRAME_BYTES)).alias("frame_bytes"))
    site, hour = site_hour(F.col("shard_path"))
    f = shard_files.where("shard_path is not null").groupBy("shard_path").agg(F.max(F.when(F.col("size_bytes") > 0, F.col("size_bytes"))).alias("b"))
    f = f.select(site.alias("site"), hour.alias("obs_hour"), "b").where("site is not null and obs_hour is not null")
    by = f.groupBy("site", "obs_hour").agg(F.sum("b").alias("b"), F.count("b").alias("known"), F.count("*").alias("n_files"))
    mean = by.agg((F.sum("b") / F.sum("known")).alias("mean"))
    d = rows.join(by, ["site", "obs_hour"], "left").crossJoin(F.broadcast(mean))  # one row
    size = (F.coalesce("b", F.lit(0)) + (F.coalesce("n_files", F.lit(1)) - F.coalesce("known", F.lit(0))) * F.col("mean")) / F.col("n")
    return d.select("site", "obs_hour", F.coalesce(size, F.lit(float(FRAME_BYTES))).alias("frame_bytes"))


def _final(target: int):
    names = [x.strip().split()[0] for x in FRAMES.split(",")] + ["n_bytes", "roll"]

    def run(batches):
        rolled = 0.0
        sizes: dict = {}

        def noted():
            for b in batches:
                for s, h, x in zip(*(b.column(c).to_pylist() for c in ("site", "obs_hour", "frame_bytes"))):
                    sizes[s, h] = x
                yield b

        for t in _whole_keys(noted()):
            m = _merge(t)
            n = pc.list_value_length(m.column("frame_idx")).to_numpy()
            of = pa.array(np.repeat(np.arange(m.num_rows), n))
            hours = list(zip(m.column("site").to_pylist(), m.column("obs_hour").to_pylist()))
            per = np.array([sizes[x] for x in hours])
            for x in hours[:-1]:
                if x != hours[-1]:
                    sizes.pop(x, None)
            size = np.repeat(per, n)
            done = rolled + np.cumsum(size)
            roll = ((done - size) // target).astype(np.int32)
            rolled = float(done[-1]) if len(done) else rolled
            lens = pc.list_value_length(m.column("paths")).to_numpy()
            base = np.repeat(np.cumsum(lens) - lens, n)
            path = m.column("paths").flatten().take(pa.array(base + m.column("path_no").flatten().to_numpy()))
            cols = [m.column("site").take(of), m.column("obs_hour").take(of), m.column("frame_idx").flatten(), m.column("global_id").flatten(), m.column("time_ns").flatten(), path, m.column("n_copies").flatten(), pa.array(size), pa.array(roll)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


class Consolidated:
    """The result of :func:`compact`: the written frames, the merged runs, and the files' key ranges."""

    def __init__(self, frames: DataFrame, run_table: DataFrame, at: str):
        self.frames, self.runs, self.at = frames, run_table, at

    def ranges(self) -> DataFrame:
        """Key range, rows, bytes of the frames and length of every file written."""
        first, last = F.min(F.struct("site", "obs_hour", "frame_idx")), F.max(F.struct("site", "obs_hour", "frame_idx"))
        g = self.frames.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size")).agg(first.alias("lo"), last.alias("hi"), F.count("*").alias("n_frames"), F.sum("n_bytes").alias("b"))
        return g.select("file", F.col("lo.site").alias("first_site"), F.col("lo.obs_hour").alias("first_hour"), F.col("lo.frame_idx").alias("first_frame"),
                        F.col("hi.site").alias("last_site"), F.col("hi.obs_hour").alias("last_hour"), F.col("hi.frame_idx").alias("last_frame"), "n_frames", F.round("b").cast("long").alias("n_bytes"), "file_size")


def compact(manifest: DataFrame, shard_files: DataFrame | None = None, out: str | None = None, target_bytes: int = TARGET_BYTES) -> Consolidated:
    """Write the consolidated files (to ``out``, else into the shared folder)."""
    spark = manifest.sparkSession
    r = stage(merged(runs(manifest)), "merged-runs")
    sizes = hour_bytes(r, shard_files)
    n = r.groupBy("site", "obs_hour").agg(F.sum(F.size("frame_idx")).alias("f")).join(sizes, ["site", "obs_hour"]).agg(F.sum("f").alias("f"), F.sum(F.col("f") * F.col("frame_bytes")).alias("b")).first()
    n_files = max(1, -(-int(n.b or 0) // target_bytes))
    at = out or f"{shared_folder(spark)}/lodevec/compacted-{uuid.uuid4().hex}"
    # key ranges of about a file's bytes each; of fewer where there is little, so that few files come out
    keyed = r.join(sizes, ["site", "obs_hour"]).repartitionByRange(n_files, "site", "obs_hour", "block").sortWithinPartitions("site", "obs_hour", "block", "first_path")
    rows = keyed.mapInArrow(_final(target_bytes), FRAMES + ", n_bytes double, roll int")
    rows.sortWithinPartitions("roll", "site", "obs_hour", "frame_idx").write.option("compression", "zstd").partitionBy("roll").parquet(at)
    return Consolidated(spark.read.schema(rows.schema).parquet(at), r, at)


def scattered_hours(c: Consolidated) -> DataFrame:
    """Site-hours whose frames lay in two or more files, with their frames after consolidation."""
    many = c.runs.groupBy("site", "obs_hour").agg(F.min("first_path").alias("a"), F.max("last_path").alias("b")).where("a < b").select("site", "obs_hour")
    n = c.frames.groupBy("site", "obs_hour").agg(F.count("*").alias("n_frames"))
    return n.join(many, ["site", "obs_hour"])
