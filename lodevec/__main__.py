"""``python -m lodevec build|query|validate|bench|crawl|download ...`` (or through spark-submit)."""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import functions as F


def arguments() -> argparse.ArgumentParser:
    from lodevec.sources.archive import Places

    places = Places()
    p = argparse.ArgumentParser(prog="lodevec", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    one = lambda name, text: sub.add_parser(name, help=text)
    b, q, v, m = one("build", "train and write the index"), one("query", "search by the address of a frame"), one("validate", "run the checks; exit code 1 if one fails"), one("bench", "latencies, recall, stages, storage")
    for x in (b, q, v, m):
        x.add_argument("--data", default=places.data_root, help="folder of the tables")
        x.add_argument("--index", default=None, help="folder of the index; by default one is kept for each state of the data")
        x.add_argument("--nprobe", type=int, default=64)
        x.add_argument("--prefilter", type=int, default=500)
    b.add_argument("--out", dest="index", help="the same as --index")
    b.add_argument("--cells", type=int)
    q.add_argument("site")
    q.add_argument("hour")
    q.add_argument("frame", type=int)
    q.add_argument("--results", type=int, default=24)
    q.add_argument("--min-score", type=float)
    q.add_argument("--diversify", type=float, default=30)
    q.add_argument("--exact", action="store_true", help="scan all vectors instead of the index")
    q.add_argument("--csv", help="folder for a CSV file; printed otherwise")
    v.add_argument("--threshold", action="append", default=[], metavar="NAME=VALUE")
    v.add_argument("--no-index", action="store_true", help="only what needs no index")
    v.add_argument("--json", help="folder for the report")
    m.add_argument("--queries", type=int, default=10)
    m.add_argument("--out", help="folder of the truth and the report; the shared folder by default")
    c, d = one("crawl", "list the image files below seed pages"), one("download", "fetch the files of a work-list")
    c.add_argument("seeds", nargs="+")
    c.add_argument("--state", default=f"{places.artifacts}/crawl", help="folder of the crawl's levels; a stopped crawl goes on from it")
    c.add_argument("--out", default=f"{places.artifacts}/listing")
    c.add_argument("--start")
    c.add_argument("--end")
    c.add_argument("--pause", type=float, default=0.5)
    d.add_argument("worklist")
    d.add_argument("--out", default=f"{places.artifacts}/downloads")
    for x in (b, q, v, m, c, d):
        x.add_argument("--master")
    return p


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)

    from lodevec import engine
    from lodevec.operators import report, search
    from lodevec.session import build_session, shared_folder
    from lodevec.sources import archive, frames, web
    from lodevec.sources.tables import table

    spark = build_session("lodevec", a.master)
    if a.what == "crawl":
        pages = web.prune(web.crawl(spark, a.seeds, a.state, pause=a.pause), a.start, a.end)
        found = archive.listing(pages, start=a.start, end=a.end)
        found.write.mode("overwrite").parquet(a.out)
        print(json.dumps({"files": spark.read.parquet(a.out).count(), "unread_pages": pages.where("html is null").count()}))
        return 0
    if a.what == "download":
        web.download(archive.read_worklist(spark, a.worklist)).write.mode("overwrite").parquet(a.out)
        got = spark.read.parquet(a.out)
        print(json.dumps({r.status: r.n for r in got.groupBy("status").agg(F.count("*").alias("n")).collect()}))
        return 1 if web.unfinished(got).limit(1).count() else 0
    manifest = frames.stored_manifest(spark, a.data)
    if a.what == "build":
        options = {"cells": a.cells} if a.cells else {}
        print(json.dumps(engine.index(spark, a.data, a.index, rebuild=True, **options).header))
    elif a.what == "query":
        options = dict(k=a.results, min_score=a.min_score, diversify_seconds=a.diversify)
        if a.exact:
            hits = search.query(manifest, frames.stored_vectors(spark, a.data), a.site, a.hour, a.frame, **options)
        else:
            hits = engine.query(spark, a.data, a.site, a.hour, a.frame, at=a.index, nprobe=a.nprobe, prefilter=a.prefilter, **options)
        archive.write_csv(hits, a.csv) if a.csv else hits.show(a.results, truncate=False)
    elif a.what == "validate":
        vecs = frames.vectors(spark, a.data)
        q = vecs.where(F.pmod("global_id", F.lit(50)) == 0).select(F.col("global_id").alias("query_id"), "embedding")
        index = None if a.no_index else engine.index(spark, a.data, a.index)
        limits = {k: float(x) for k, x in (t.split("=") for t in a.threshold)}
        got, verdict = report.validation(frames.manifest(spark, a.data), table(spark, a.data, "frame_vectors"), vecs, index, q, limits, nprobe=a.nprobe, prefilter=a.prefilter)
        print(report.text_table([r.asDict() for r in got.orderBy("name").collect()]))
        print(json.dumps(verdict))
        if a.json:
            archive.write_json(got, a.json)
        return 0 if verdict["passed"] else 1
    else:
        vecs = frames.usable_vectors(spark, a.data)
        print(report.report_text(report.benchmark(spark, manifest, vecs, engine.index(spark, a.data, a.index), a.out or f"{shared_folder(spark)}/lodevec/bench-{uuid.uuid4().hex}", a.queries, points=((8, 100), (a.nprobe, a.prefilter)))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
