"""Reports: captions, tables of figures in text and LaTeX, latencies, caveats, and the checks and measures of an index in one run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import when
from lodevec.operators import metrics, sample, search, validate
from lodevec.operators.index import Index


def caption() -> Column:
    return caption_of(F.col("rank"))


def caption_of(rank: Column) -> Column:
    """Three lines for a frame: rank and score, site and time, shard and frame. A null part is a dash."""
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("#"), dash(rank), F.lit("  score "), dash(F.format_string("%.4f", "score"))),
        F.concat(dash(F.upper("site")), F.lit("  "), dash(when.readable("time_ns"))),
        F.concat(dash(F.col("shard_path")), F.lit("  frame "), dash(F.col("frame_idx"))),
    )


def number(x) -> str:
    """A figure for a table: whole numbers with separators, large and small ones shortened, none as a dash."""
    if x is None or x != x:
        return "-"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, str):
        return x
    if isinstance(x, int) or float(x).is_integer() and abs(x) < 1e15:
        return f"{int(x):,}"
    return f"{x:,.1f}" if abs(x) >= 100 else f"{x:.4g}"


def seconds(x: float | None) -> str:
    return "-" if x is None else f"{x * 1000:.1f} ms" if x < 1 else f"{x:.2f} s" if x < 120 else f"{x / 60:.1f} min"


def size(n: float | None) -> str:
    if n is None:
        return "-"
    for unit in ("B", "kB", "MB", "GB"):
        if abs(n) < 1000:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
    return f"{n:.1f} TB"


def text_table(rows: Sequence[dict], columns: Sequence[str] | None = None) -> str:
    """A plain table of a short list of rows."""
    columns = list(columns or (rows[0] if rows else []))
    cells = [columns, *[[number(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def latex_table(rows: Sequence[dict], columns: Sequence[str] | None = None, caption_: str = "", label: str = "") -> str:
    """The same as a LaTeX table; special characters are escaped."""
    columns = list(columns or (rows[0] if rows else []))
    plain = str.maketrans({c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})
    line = lambda r: " & ".join(str(x).translate(plain) for x in r) + r" \\"
    body = [line([number(r.get(c)) for c in columns]) for r in rows]
    head = [r"\begin{table}", r"\centering", rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", r"\hline", line(columns), r"\hline"]
    foot = [r"\hline", r"\end{tabular}", *([rf"\caption{{{caption_.translate(plain)}}}"] if caption_ else []), *([rf"\label{{{label}}}"] if label else []), r"\end{table}"]
    return "\n".join([*head, *body, *foot])


def regime(n_vectors: int, n_queries: int, k: int, prefilter: int) -> str | None:
    """Why a recall figure may say little: a pool not much larger than the candidates, or few queries. None if it stands."""
    if n_vectors == 0 or n_queries == 0:
        return "no vectors or no queries: recall says nothing"
    if prefilter >= 0.1 * n_vectors:
        return f"the {prefilter} candidates reranked are {100 * prefilter / n_vectors:.0f} % of all {n_vectors} vectors: recall is nearly that of an exact scan and will fall with more vectors"
    if n_queries * k < 1000:
        return f"{n_queries} queries with {k} answers each: the figure moves by {100 / (n_queries * k):.1g} % with every miss"
    return None


def gaps(gated: DataFrame) -> list[str]:
    """Checks without a verdict: nothing was measured, or no threshold is set."""
    got = gated.where("passed is null").select("name", F.col("value").isNull().alias("none")).orderBy("name").collect()  # one row a check
    return [f"{r.name}: {'not measured' if r.none else 'no threshold'}" for r in got]


def timed(run: Callable[[], object], times: int) -> list[float]:
    out = []
    for _ in range(times):
        t = time.perf_counter()
        run()
        out.append(time.perf_counter() - t)
    return out


def latencies(spark: SparkSession, paths: dict[str, Callable[[list[float]], DataFrame]], queries: Sequence[Sequence[float]], warm: int = 1) -> DataFrame:
    """``(path, phase, n, median, p95, p99, mean, min, max, per_second)`` of searches one after the other.

    ``cold`` is each query's first run, ``warm`` the runs after it; a path is called with a query and its answer is collected.
    """
    rows = []
    for name, path in paths.items():
        for phase, times in (("cold", 1), ("warm", warm)):
            for q in queries:
                rows += [(name, phase, s) for s in timed(lambda p=path, q=q: p(list(q)).collect(), times)]
    d = metrics.summary(spark.createDataFrame(rows, "path string, phase string, seconds double"), "seconds", ("path", "phase"))
    return d.withColumn("per_second", F.try_divide(F.lit(1.0), "mean"))


def speed_ratios(latency: DataFrame, exact_path: str = "exact") -> DataFrame:
    """Speed of each path and phase against the exact path's warm median."""
    base = latency.where((F.col("path") == exact_path) & (F.col("phase") == "warm")).select(F.col("median").alias("_m"))
    return latency.crossJoin(F.broadcast(base)).select("path", "phase", "median", (F.col("_m") / F.col("median")).alias("speed_up"))  # one row


def ground_truth(vectors: DataFrame, queries: DataFrame, k: int, at: str) -> DataFrame:
    """Exact answers of a stated query set, written as ``(query_id, rank, global_id, score)`` and read back."""
    search.batch_top(vectors, queries, k).repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").write.mode("overwrite").parquet(at)
    return vectors.sparkSession.read.parquet(at)


def storage(spark: SparkSession, **paths: str) -> DataFrame:
    """``(name, n_files, bytes, mean_bytes)`` of folders, from their listing."""
    from lodevec.engine import _files

    rows = []
    for name, p in paths.items():
        sizes = [f.getLen() for f in _files(spark, p)]
        rows.append((name, len(sizes), sum(sizes), sum(sizes) / len(sizes) if sizes else None))
    return spark.createDataFrame(rows, "name string, n_files long, bytes long, mean_bytes double")


def provenance(spark: SparkSession) -> dict:
    """Versions and the settings that decide a plan."""
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.executor.memory", "spark.driver.memory")
    return {"spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism, **{k: spark.conf.get(k, None) for k in keys}}


def export_roundtrip(hits: DataFrame, at: str) -> DataFrame:
    """One row ``(n, n_same)``: the export table written as CSV, read back, and its times parsed again."""
    from lodevec.sources import archive

    out = search.export(hits)
    archive.write_csv(out, at)
    back = hits.sparkSession.read.option("header", "true").schema(out.schema).csv(at)
    a = out.groupBy(*out.columns).count().withColumnRenamed("count", "a")
    b = back.where(when.parse_readable("datetime").isNotNull() | F.col("datetime").isNull()).groupBy(*out.columns).count().withColumnRenamed("count", "b")
    d = a.join(b, [a[c].eqNullSafe(b[c]) for c in out.columns], "left")
    return d.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.least("a", F.coalesce("b", F.lit(0)))), F.lit(0)).alias("n_same"))


def checks(manifest: DataFrame, raw_vectors: DataFrame, vectors: DataFrame, index: Index | None, queries: DataFrame, k: int = 10, nprobe: int = 64, prefilter: int = 500) -> DataFrame:
    """All checks as ``(name, value)``: layout, vectors, self-retrieval and recall on the exact and the index path."""
    spark = manifest.sparkSession
    one = lambda d, **named: d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).cast("double").alias("value")) for n, e in named.items()])).alias("x")).select("x.*")
    out = one(validate.health(raw_vectors), zero_norm="n_zero", non_finite="n_non_finite", null_vectors="n_null", wrong_length="n_length")
    out = out.unionByName(one(validate.integrity(manifest), dense_ids="cast(dense as int)", monotone="cast(monotone as int)"))
    truth = search.batch_top(vectors, queries, k)
    out = out.unionByName(one(validate.self_retrieval(queries, truth), self_retrieval="self_share"))
    if index is not None:
        a = index.batch(queries, k, nprobe, prefilter)
        two = a.where(F.col("rank") <= k)
        raw = a.where(F.col("approx_rank") <= k).withColumn("rank", F.col("approx_rank"))
        out = out.unionByName(one(validate.self_retrieval(queries, two), self_retrieval_index="self_share"))
        out = out.unionByName(one(metrics.recall_summary(metrics.recall(truth, two)), recall_at_k="mean", recall_p10="p10", recall_min="min", top1="top1_rate"))
        out = out.unionByName(one(metrics.recall_summary(metrics.recall(truth, raw)), raw_recall="mean"))
        out = out.unionByName(one(metrics.score_gap(truth, two), top1_gap_mean="mean_gap", top1_gap_max="max_gap"))
        n = spark.createDataFrame([("index_rows_lacking", float(index.header["n"] - index.rows.count()))], "name string, value double")
        out = out.unionByName(n)
    return out


def validation(manifest: DataFrame, raw_vectors: DataFrame, vectors: DataFrame, index: Index | None, queries: DataFrame, thresholds: dict[str, float] | None = None, **options) -> tuple[DataFrame, dict]:
    """The gated checks, and the report around them: verdict, checks without one, the caveat of the recall."""
    from lodevec.session import stage

    got = stage(validate.gate(checks(manifest, raw_vectors, vectors, index, queries, **options), thresholds), "checks")
    v = validate.verdict(got).first()
    caveat = regime(index.header["n"], queries.count(), options.get("k", 10), options.get("prefilter", 500)) if index is not None else None
    return got, {"passed": v.passed, "n_judged": v.n, "gaps": gaps(got), "caveat": caveat}


def benchmark(spark: SparkSession, manifest: DataFrame, vectors: DataFrame, index: Index, out: str, n_queries: int = 10, k: int = 10, points: Sequence[tuple[int, int]] = ((8, 100), (64, 500)), seed: int = 0) -> dict:
    """Latencies, throughput, stages, locality, recall by operating point, storage and provenance; the truth and the report are written to ``out``."""
    ids = sample.uniform(vectors.select("global_id").distinct(), n_queries, seed)
    q = vectors.join(F.broadcast(ids), "global_id").select(F.col("global_id").alias("query_id"), "embedding")  # n_queries rows
    chosen = [list(r.embedding) for r in q.dropDuplicates(["query_id"]).orderBy("query_id").collect()]
    paths: dict[str, Callable] = {"exact": lambda x: search.search_split(manifest, vectors, x, k, diversify_seconds=None)}
    for nprobe, prefilter in points:
        paths[f"index {nprobe}/{prefilter}"] = lambda x, a=nprobe, b=prefilter: index.search(manifest, x, k, a, b, diversify_seconds=None)
    lat = latencies(spark, paths, chosen)
    ratio = speed_ratios(lat)
    truth = ground_truth(vectors, q, k, f"{out}/ground_truth")
    rows = []
    for nprobe, prefilter in points:
        a = index.batch(q, prefilter, nprobe, prefilter)
        r = metrics.recall_summary(metrics.recall(truth, a.where(F.col("rank") <= k))).first().asDict()
        loc = metrics.locality(a.where(F.col("approx_rank") <= prefilter), index.header["n"]).agg(F.percentile("runs", F.lit(0.5)).alias("runs"), F.percentile("span_share", F.lit(0.5)).alias("span_share")).first().asDict()
        rows.append({"nprobe": nprobe, "prefilter": prefilter, **r, **loc})
    stages = [index.stages(manifest, x) for x in chosen[:3]]
    report = {
        "header": index.header, "provenance": provenance(spark), "latency": [r.asDict() for r in lat.orderBy("path", "phase").collect()], "speed_up": [r.asDict() for r in ratio.orderBy("path", "phase").collect()],
        "recall": rows, "stages": {s: sorted(x[s] for x in stages)[len(stages) // 2] for s in stages[0]} if stages else {}, "storage": [r.asDict() for r in storage(spark, index=index.at).collect()],
        "caveat": regime(index.header["n"], len(chosen), k, max(b for _, b in points)),
    }
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return report


def report_text(report: dict) -> str:
    """A benchmark report for people."""
    out = [f"index {report['header']['layout']}, {number(report['header']['n'])} vectors of {report['header']['dim']}"]
    out.append(text_table([{"path": r["path"], "phase": r["phase"], "n": r["n"], "median": seconds(r["median"]), "p95": seconds(r["p95"]), "per second": r["per_second"]} for r in report["latency"]]))
    out.append(text_table([{"nprobe": r["nprobe"], "prefilter": r["prefilter"], "recall": r["mean"], "p10": r["p10"], "min": r["min"], "top 1": r["top1_rate"], "runs": r["runs"]} for r in report["recall"]]))
    out.append(text_table([{"folder": r["name"], "files": r["n_files"], "size": size(r["bytes"])} for r in report["storage"]]))
    return "\n\n".join(out + ([f"note: {report['caveat']}"] if report["caveat"] else []))
