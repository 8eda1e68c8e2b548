"""Queries on inventories, listings, addresses and streams; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodevec.functions import address, when
from lodevec.operators import inventory as inv
from lodevec.plans.common import UTC, M, manifest, table
from lodevec.sources import archive
from lodevec.streaming import groups

ROOTS = ["/drive_a", "/drive_b", "/drive_c", "/drive_d", "/backup/drive_a", "/backup"]


def _inventory(spark, folder):
    from lodevec.sources.tables import code

    i = table(spark, folder, "inventory")
    return i.select(code("site").alias("site"), "datetime", "drive_path", "file_size_bytes", F.lower("status").alias("status"))


def inventory_first_wins(spark, folder):
    return inv.first_wins(_inventory(spark, folder), ROOTS)


def inventory_roots(spark, folder):
    return inv.root_of(_inventory(spark, folder), ROOTS).groupBy("root").agg(F.count("*").alias("n"))


def inventory_queues(spark, folder):
    return inv.by_drive(_inventory(spark, folder).distinct(), ROOTS).select("root", "position", "site", "datetime", "drive_path")


def inventory_chosen(spark, folder):
    return inv.choose(_inventory(spark, folder).select("site", "datetime", "drive_path").distinct(), ["brqu", "dovr", "elmx"], ["2006"], 50)


def inventory_written_back(spark, folder):
    """Statuses after a run: failures from the log, the rest as it was."""
    from lodevec.sources.tables import code

    failed = table(spark, folder, "embed_failures").select(code("site").alias("site"), "datetime", F.lit("failed").alias("status"))
    return inv.write_back(_inventory(spark, folder), failed).groupBy("site", "status").agg(F.count("*").alias("n"))


def inventory_status(spark, folder):
    return inv.counts(_inventory(spark, folder), "status", "file_size_bytes")


def inventory_reconciled(spark, folder):
    """Files pinned (the first drive's) against those on backup, by name, size and hash of the size."""
    i = _inventory(spark, folder).where("drive_path is not null")
    i = i.select(F.substring_index("drive_path", "/", -1).alias("key"), F.col("file_size_bytes").alias("size_bytes"), F.startswith("drive_path", F.lit("/backup")).alias("backup"))
    one = i.groupBy("key", "backup").agg(F.max("size_bytes").alias("size_bytes")).withColumn("sha256", F.sha2(F.col("size_bytes").cast("string"), 256))
    return inv.reconcile(one.where("not backup"), one.where("backup"))


def downloads(spark, folder):
    i = _inventory(spark, folder)
    work = i.groupBy(address.local_path("/data", "site", "datetime").alias("target_path")).agg(F.max("file_size_bytes").alias("expected_bytes"))
    have = i.where("status = 'done'").select(address.local_path("/data", "site", "datetime").alias("target_path"), F.col("file_size_bytes").alias("size_bytes"))
    return inv.download_status(work, have)


def unfinished(spark, folder):
    i = _inventory(spark, folder)
    return inv.unfinished(i, i.where("status = 'done'")).select("site", "datetime").distinct()


def worker_stride(spark, folder):
    i = _inventory(spark, folder).select("site", "datetime").where("site is not null and datetime is not null").distinct()
    return inv.stride(i, 3, 1, ["site", "datetime"])


def failures(spark, folder):
    """Logged failures and groups that got fewer frames than their file announces."""
    from lodevec.sources.tables import code

    log = table(spark, folder, "embed_failures").select(code("site").alias("site"), "datetime", "exception_type", "exception_msg")
    m = manifest(spark, folder).where("site is not null and time_ns is not null and frame_idx is not null").select("site", when.hour_stamp("time_ns").alias("datetime"), "frame_idx").distinct()
    want = m.groupBy("site", "datetime").agg((F.max("frame_idx") + 1).alias("n_frames"))
    return inv.with_failures(log, want, m)


def failure_counts(spark, folder):
    f = table(spark, folder, "embed_failures").distinct()
    return inv.counts(f, "exception_type")


def _pages(spark, folder):
    i = _inventory(spark, folder).where("site is not null and datetime is not null and drive_path is not null")
    name = F.substring_index("drive_path", "/", -1)
    html = F.concat(F.lit('<a href="../">up</a><a href="?C=M">sort</a><a href="'), name, F.lit('">x</a><a href="thumb.png">t</a>'))
    return i.select(F.concat(F.lit(address.BASE + "/"), "site", F.lit("/"), F.substring("datetime", 1, 4), F.lit("/")).alias("page_url"), html.alias("html"))


def crawl_listing(spark, folder):
    return archive.listing(_pages(spark, folder), start="2006-01-10", end="2006-02")


def crawl_new(spark, folder):
    """Links of the second month that the first month's crawl has not seen."""
    p = _pages(spark, folder)
    return archive.new_links(archive.listing(p, start="2006"), archive.listing(p, end="2006-01"))


def crawl_worklist(spark, folder):
    return archive.worklist(archive.listing(_pages(spark, folder)), "/data").select("site", "datetime", "url", "target_path")


def name_parts(spark, folder):
    site, year, hour = address.name_parts("drive_path")
    return _inventory(spark, folder).where("drive_path is not null").select("drive_path").distinct().select("drive_path", site.alias("site"), year.alias("year"), hour.alias("hour"))


def addresses(spark, folder):
    i = _inventory(spark, folder).select("site", "datetime").where("site is not null and datetime is not null").distinct()
    u = address.url("site", "datetime")
    return i.select("site", "datetime", u.alias("url"), address.local_path("/data/", "site", "datetime").alias("path"), address.url_to_local("/data", u).alias("again"), F.sha2(u, 256).alias("sha256"))


def hours_parsed(spark, folder):
    i = _inventory(spark, folder).select("datetime").where("datetime is not null").distinct()
    forms = F.array(F.col("datetime"), F.substring("datetime", 1, 8), F.substring("datetime", 1, 6), F.concat(F.substring("datetime", 1, 4), F.lit("-"), F.substring("datetime", 5, 2), F.lit("-"), F.substring("datetime", 7, 2), F.lit(" "), F.substring("datetime", 9, 2), F.lit(":30")))
    return i.select("datetime", F.posexplode(forms).alias("form", "text")).select("text", "form", address.hour_of("text").alias("hour")).distinct()


def times_shown(spark, folder):
    m = manifest(spark, folder).where("time_ns is not null").select("time_ns").distinct()
    return m.select("time_ns", when.readable("time_ns").alias("readable"), when.hour_stamp("time_ns").alias("hour"), when.file_stamp("time_ns").alias("stamp"), when.month_bucket("time_ns").alias("month"), address.file_name(F.lit("brqu"), "time_ns").alias("name"))


def prefix_range(spark, folder):
    return _inventory(spark, folder).where(when.in_prefix_range("datetime", "2006-01-15", "2006-02")).select("site", "datetime").distinct()


def day_range(spark, folder):
    a, b = when.day_range_ns("2006-01-10", "2006-01-12")
    return manifest(spark, folder).where(F.col("time_ns").between(a, b)).select("global_id", "time_ns")


def spec_summary(spark, folder):
    """Two pinned specs made of the inventory, and their totals."""
    return archive.spec_totals(_spec(spark, folder))


def _spec(spark, folder):
    i = _inventory(spark, folder).where("site is not null and datetime is not null and file_size_bytes is not null").groupBy("site", "datetime").agg(F.max("file_size_bytes").alias("b"))
    one = F.struct("site", "datetime", F.col("b").alias("size_bytes"), F.sha2(F.col("site"), 256).alias("sha256"))
    # a spec is one record by its nature; the two here hold a bounded part: a site's hours
    s = i.where(F.col("site").isin("brqu", "dovr", "yolk")).withColumn("name", F.when(F.col("site") == "yolk", "tiny").otherwise("small"))
    return s.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("cdfs"), (F.count("*") * 1000).alias("expected_vectors"))


def spec_files(spark, folder):
    return archive.spec_files(_spec(spark, folder), "/data").select("name", "url", "target_path", "size_bytes")


def spec_cost(spark, folder):
    return archive.spec_cost(_spec(spark, folder), 1e6, 90.0, 5.0, 0.002)


def groups_complete(spark, folder):
    """Site-hours as groups of frames: complete, or short of what was announced."""
    return groups.complete_batch(_announced(spark, folder))


def _announced(spark, folder):
    m = manifest(spark, folder).where("site is not null and time_ns is not null and frame_idx is not null")
    f = m.select("site", when.hour_stamp("time_ns").alias("datetime"), "frame_idx")
    n = f.groupBy("site", "datetime").agg((F.max("frame_idx") + 1).alias("n_frames"))
    return f.join(n, ["site", "datetime"]).select("site", "datetime", "n_frames", "frame_idx")


def groups_streamed(spark, folder):
    """The complete groups, from a stream over the same frames in several files."""
    import uuid

    from lodevec.session import shared_folder

    at = f"{shared_folder(spark)}/lodevec/stream-{uuid.uuid4().hex}"
    src = _announced(spark, folder)
    src.repartition(4).write.parquet(f"{at}/in")
    s = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    groups.drain(groups.complete_groups(s), f"{at}/out", f"{at}/state")
    return spark.read.schema(groups.OUT).parquet(f"{at}/out").select("site", "datetime", "n_frames", "received", "state")


def hourly_hits(spark, folder):
    h = table(spark, folder, "hits").where("received_at is not null").withColumn("received", F.col("received_at").cast("timestamp"))
    return groups.hourly(h, "received", ["query_id"])


def hourly_hits_streamed(spark, folder):
    """The same from a stream, with a watermark; windows still open at the end stay out."""
    import uuid

    from lodevec.session import shared_folder

    src = table(spark, folder, "hits")
    at = f"{shared_folder(spark)}/lodevec/stream-{uuid.uuid4().hex}"
    name = f"{folder}/hits.parquet"
    s = spark.readStream.schema(src.schema).parquet(name if spark._jvm.java.io.File(name.removeprefix("file:")).isDirectory() else f"{folder}/hit[s].parquet")  # noqa: SLF001
    s = s.where("received_at is not null").withColumn("received", F.col("received_at").cast("timestamp"))
    groups.drain(groups.hourly(s, "received", ["query_id"], "2 hours"), f"{at}/out", f"{at}/state")
    return spark.read.schema("hour string, query_id long, n long").parquet(f"{at}/out")


_I = r"i AS (SELECT lower(regexp_replace(site, '^\s+|\s+$', '', 'g')) AS site, datetime, drive_path, file_size_bytes, lower(status) AS status FROM inventory)"
_ORD = "CASE " + " ".join(f"WHEN starts_with(drive_path, '{r}/') THEN {k}" for k, r in enumerate(ROOTS)) + f" ELSE {len(ROOTS)} END"
_ROOT = "CASE " + " ".join(f"WHEN starts_with(drive_path, '{r}/') OR drive_path = '{r}' THEN '{r}'" for r in sorted(ROOTS, key=len, reverse=True)) + " ELSE '' END"
_BASE = "'https://example.org/asi/'"
_ADDR = "site || '/' || substr(datetime, 1, 4) || '/asi_l1_' || site || '_' || datetime || '_v01.cdf'"
_NAME = "asi_l1_([a-z0-9]{4})_([0-9]{10})_v([0-9]{2})\\.cdf"
_LIST = f"""{_I}, l AS (SELECT DISTINCT regexp_extract(f, '{_NAME}', 1) AS site, regexp_extract(f, '{_NAME}', 2) AS datetime, f AS filename, {_BASE} || site || '/' || substr(datetime, 1, 4) || '/' || f AS remote_url
  FROM (SELECT site, datetime, string_split(drive_path, '/')[-1] AS f FROM i WHERE site IS NOT NULL AND datetime IS NOT NULL AND drive_path IS NOT NULL) WHERE regexp_full_match(f, '{_NAME}'))"""
_G = f"g AS (SELECT site, strftime({UTC}, '%Y%m%d%H') AS datetime, CAST(max(frame_idx) + 1 AS INTEGER) AS n_frames, CAST(count(DISTINCT frame_idx) AS INTEGER) AS received FROM m WHERE site IS NOT NULL AND time_ns IS NOT NULL AND frame_idx IS NOT NULL GROUP BY 1, 2)"
_SPEC = f"""{_I}, c AS (SELECT site, datetime, max(file_size_bytes) AS b FROM i WHERE site IN ('brqu', 'dovr', 'yolk') AND datetime IS NOT NULL AND file_size_bytes IS NOT NULL GROUP BY 1, 2),
s AS (SELECT CASE WHEN site = 'yolk' THEN 'tiny' ELSE 'small' END AS name, * FROM c)"""

QUERIES = {
    f.__name__: f
    for f in (inventory_first_wins, inventory_roots, inventory_queues, inventory_chosen, inventory_written_back, inventory_status, inventory_reconciled, downloads, unfinished, worker_stride, failures, failure_counts,
              crawl_listing, crawl_new, crawl_worklist, name_parts, addresses, hours_parsed, times_shown, prefix_range, day_range, spec_summary, spec_files, spec_cost, groups_complete, groups_streamed, hourly_hits, hourly_hits_streamed)
}
SQL = {
    "inventory_first_wins": f"WITH {_I} SELECT site, datetime, drive_path, file_size_bytes, status FROM i QUALIFY row_number() OVER (PARTITION BY site, datetime ORDER BY {_ORD}, drive_path NULLS LAST, file_size_bytes NULLS LAST, status NULLS LAST) = 1",
    "inventory_roots": f"WITH {_I} SELECT {_ROOT} AS root, count(*) AS n FROM i GROUP BY 1",
    "inventory_queues": f"WITH {_I}, d AS (SELECT DISTINCT * FROM i) SELECT {_ROOT} AS root, CAST(row_number() OVER (PARTITION BY {_ROOT} ORDER BY site NULLS FIRST, datetime NULLS FIRST, drive_path NULLS FIRST, file_size_bytes NULLS FIRST, status NULLS FIRST) AS INTEGER) AS position, site, datetime, drive_path FROM d",
    "inventory_chosen": f"WITH {_I} SELECT DISTINCT site, datetime, drive_path FROM i WHERE site IN ('brqu', 'dovr', 'elmx') AND substr(datetime, 1, 4) = '2006' ORDER BY site, datetime, drive_path NULLS FIRST LIMIT 50",
    "inventory_written_back": f"""WITH {_I}, f AS (SELECT DISTINCT lower(regexp_replace(site, '^\\s+|\\s+$', '', 'g')) AS site, datetime FROM embed_failures)
SELECT i.site, CASE WHEN f.site IS NOT NULL THEN 'failed' ELSE status END AS status, count(*) AS n FROM i LEFT JOIN f ON i.site = f.site AND i.datetime = f.datetime GROUP BY 1, 2""",
    "inventory_status": f"WITH {_I} SELECT status, count(*) AS n, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM i GROUP BY status",
    "inventory_reconciled": f"""WITH {_I}, o AS (SELECT string_split(drive_path, '/')[-1] AS key, starts_with(drive_path, '/backup') AS backup, max(file_size_bytes) AS b FROM i WHERE drive_path IS NOT NULL GROUP BY 1, 2),
a AS (SELECT * FROM o WHERE NOT backup), p AS (SELECT * FROM o WHERE backup)
SELECT coalesce(a.key, p.key) AS key, CASE WHEN a.key IS NULL THEN 'extra' WHEN p.key IS NULL THEN 'missing' WHEN a.b IS DISTINCT FROM p.b THEN 'size' ELSE 'ok' END AS state FROM a FULL JOIN p ON a.key = p.key""",
    "downloads": f"""WITH {_I}, t AS (SELECT array_to_string(['/data', array_to_string([site, substr(datetime, 1, 4), concat_ws('', 'asi_l1_' || site || '_' || datetime || '_v01.cdf')], '/')], '/') AS target_path, * FROM i),
w AS (SELECT target_path, max(file_size_bytes) AS e FROM t GROUP BY 1), h AS (SELECT target_path, max(file_size_bytes) AS have FROM t WHERE status = 'done' GROUP BY 1)
SELECT target_path, e AS expected_bytes, CASE WHEN have = e THEN 'skipped' WHEN e IS NULL THEN 'failed' ELSE 'downloaded' END AS status, CASE WHEN have = e OR e IS NULL THEN 0 ELSE e END AS bytes_written FROM w LEFT JOIN h USING (target_path)""",
    "unfinished": f"WITH {_I} SELECT DISTINCT site, datetime FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.status = 'done' AND j.site = i.site AND j.datetime = i.datetime)",
    "worker_stride": f"WITH {_I}, d AS (SELECT DISTINCT site, datetime FROM i WHERE site IS NOT NULL AND datetime IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY site, datetime) - 1 AS k FROM d) SELECT site, datetime FROM r WHERE k % 3 = 1",
    "failures": f"""WITH {M}, {_G} SELECT lower(regexp_replace(site, '^\\s+|\\s+$', '', 'g')) AS site, datetime, exception_type, exception_msg FROM embed_failures
UNION SELECT site, datetime, 'IncompleteStream', received || ' of ' || n_frames || ' frames' FROM g WHERE received < n_frames""",
    "failure_counts": "SELECT exception_type, count(*) AS n FROM (SELECT DISTINCT * FROM embed_failures) GROUP BY 1",
    "crawl_listing": f"WITH {_LIST} SELECT * FROM l WHERE datetime BETWEEN '2006011000' AND '2006029999'",
    "crawl_new": f"WITH {_LIST} SELECT * FROM l WHERE datetime >= '2006000000' AND remote_url NOT IN (SELECT remote_url FROM l WHERE datetime <= '2006019999')",
    "crawl_worklist": f"WITH {_LIST} SELECT site, datetime, remote_url AS url, '/data/' || {_ADDR} AS target_path FROM l",
    "name_parts": f"WITH {_I} SELECT DISTINCT drive_path, nullif(regexp_extract(drive_path, '{_NAME}', 1), '') AS site, nullif(substr(regexp_extract(drive_path, '{_NAME}', 2), 1, 4), '') AS year, nullif(regexp_extract(drive_path, '{_NAME}', 2), '') AS hour FROM i WHERE drive_path IS NOT NULL",
    "addresses": f"WITH {_I} SELECT DISTINCT site, datetime, {_BASE} || {_ADDR} AS url, '/data/' || {_ADDR} AS path, '/data/' || {_ADDR} AS again, sha256({_BASE} || {_ADDR}) AS sha256 FROM i WHERE site IS NOT NULL AND datetime IS NOT NULL",
    "hours_parsed": f"""WITH {_I}, d AS (SELECT DISTINCT datetime FROM i WHERE datetime IS NOT NULL),
t AS (SELECT datetime AS text, 0 AS form, datetime AS hour FROM d UNION SELECT substr(datetime, 1, 8), 1, substr(datetime, 1, 8) || '00' FROM d UNION SELECT substr(datetime, 1, 6), 2, NULL FROM d
UNION SELECT substr(datetime, 1, 4) || '-' || substr(datetime, 5, 2) || '-' || substr(datetime, 7, 2) || ' ' || substr(datetime, 9, 2) || ':30', 3, datetime FROM d)
SELECT * FROM t""",
    "times_shown": f"""WITH {M} SELECT DISTINCT time_ns, strftime({UTC}, '%Y-%m-%d %H:%M:%S') || ' UTC' AS readable, strftime({UTC}, '%Y%m%d%H') AS hour, strftime({UTC}, '%Y%m%dT%H%M%SZ') AS stamp,
CAST((year({UTC}) - 1970) * 12 + month({UTC}) - 1 AS INTEGER) AS month, 'brqu_' || strftime({UTC}, '%Y%m%dT%H%M%SZ') || '.csv' AS name FROM m WHERE time_ns IS NOT NULL""",
    "prefix_range": f"WITH {_I} SELECT DISTINCT site, datetime FROM i WHERE datetime BETWEEN '2006011500' AND '2006029999'",
    "day_range": f"WITH {M} SELECT global_id, time_ns FROM m WHERE time_ns BETWEEN 1136851200000000000 AND 1137110399999999999",
    "spec_summary": f"WITH {_SPEC} SELECT name, CAST(count(*) AS INTEGER) AS n_files, CAST(sum(b) AS BIGINT) AS n_bytes, list_sort(list(DISTINCT site)) AS sites, list_sort(list(DISTINCT substr(datetime, 1, 6))) AS months FROM s GROUP BY name",
    "spec_files": f"WITH {_SPEC} SELECT name, {_BASE} || {_ADDR} AS url, '/data/' || {_ADDR} AS target_path, b AS size_bytes FROM s",
    "spec_cost": f"WITH {_SPEC} SELECT name, round(sum(b) / 1e6, 3) AS fetch_s, round(count(*) * 1000 / 90.0, 3) AS embed_s, round(5.0::DOUBLE + count(*) * 1000 * 0.002::DOUBLE, 3) AS index_s FROM s GROUP BY name",
    "groups_complete": f"WITH {M}, {_G} SELECT *, CASE WHEN received >= n_frames THEN 'complete' ELSE 'incomplete' END AS state FROM g",
    "groups_streamed": f"WITH {M}, {_G} SELECT *, 'complete' AS state FROM g WHERE received >= n_frames",
    "hourly_hits": "SELECT strftime(received_at, '%Y%m%d%H') AS hour, query_id, count(*) AS n FROM hits WHERE received_at IS NOT NULL GROUP BY 1, 2",
    "hourly_hits_streamed": """SELECT strftime(received_at, '%Y%m%d%H') AS hour, query_id, count(*) AS n FROM hits WHERE received_at IS NOT NULL
      AND date_trunc('hour', received_at) + INTERVAL 1 HOUR <= (SELECT max(received_at) FROM hits) - INTERVAL 2 HOUR GROUP BY 1, 2""",
}
