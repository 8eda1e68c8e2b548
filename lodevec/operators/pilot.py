"""Building a small pinned slice end to end: files against the spec, frames against the files, the index, its checks.

Nothing is discovered: the spec names the files. What deviates from it either warns or, with ``strict``, ends the build
before anything is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.operators import index, inventory, report
from lodevec.session import stage


class Drift(ValueError):
    """The files present are not those of the spec."""


def drift(spec_files: DataFrame, present: DataFrame) -> DataFrame:
    """``(state, n)`` of the spec's files against those present, by ``(key, size_bytes, sha256)``."""
    return inventory.reconcile(spec_files, present).groupBy("state").agg(F.count("*").alias("n"))


def failures(logs: DataFrame, most: int = 20) -> list[str]:
    """The failures of the embedding step as lines, most frequent first; at most ``most`` lines."""
    g = logs.groupBy("exception_type").agg(F.count("*").alias("n"), F.min("exception_msg").alias("example")).orderBy(F.desc("n"), "exception_type").limit(most)
    return [f"{r.n} x {r.exception_type}: {r.example}" for r in g.collect()]


def build(spec: dict, spec_files: DataFrame, present: DataFrame, manifest: DataFrame, vectors: DataFrame, out: str, logs: DataFrame | None = None, strict: bool = False, check: bool = True) -> dict:
    """Build and check the slice; the report. ``spec`` has ``name``, ``nlist``, ``nprobe``, ``prefilter``, ``expected_vectors`` and ``thresholds``.

    Missing files, or fewer site-hours than the spec has files, end the build; files of another size or hash, further files, another number
    of vectors and failures of the embedding are warnings, or end it with ``strict``.
    """
    warnings: list[str] = []
    states = {r.state: r.n for r in drift(spec_files, present).collect()}  # five states
    if states.get("missing"):
        raise Drift(f"{states['missing']} files of {spec['name']} are missing")
    warnings += [f"{states[s]} files: {s}" for s in ("size", "hash", "extra") if states.get(s)]
    hours = manifest.select("shard_path").distinct().count()
    pinned = spec_files.count()
    if hours < pinned:
        raise Drift(f"{hours} shards for {pinned} files" + "".join(f"; {x}" for x in (failures(logs) if logs is not None else [])))
    n = vectors.count()
    if spec.get("expected_vectors") not in (None, n):
        warnings.append(f"{n} vectors, {spec['expected_vectors']} expected")
    if logs is not None:
        warnings += failures(logs)
    if strict and warnings:
        raise Drift("; ".join(warnings))
    i = index.build(vectors, out, cells=spec.get("nlist"))
    result = {"name": spec["name"], "n_vectors": n, "n_files": pinned, "warnings": warnings, "index": i.header}
    if check:
        q = stage(vectors.where(F.pmod("global_id", F.lit(50)) == 0).select(F.col("global_id").alias("query_id"), "embedding"), "queries")
        got, verdict = report.validation(manifest, vectors, vectors, i, q, spec.get("thresholds"), nprobe=spec.get("nprobe") or 64, prefilter=spec.get("prefilter") or 500)
        result |= {"checks": {r.name: r.value for r in got.collect()}, **verdict}
    return result
