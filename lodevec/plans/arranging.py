"""Queries on layout, samples, validation and measures; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodevec.functions import when
from lodevec.operators import filters, layout, metrics, rebuild, report, sample, validate
from lodevec.operators.compaction import site_hour
from lodevec.plans.common import COS, QSET, UTC, M, V, frames, manifest, query_set, table, vectors

FORTNIGHT = 14 * 86400 * 10**9


def id_islands(spark, folder):
    """Runs of consecutive ids of two sites."""
    return filters.islands(manifest(spark, folder).where(F.col("site").isin("brqu", "dovr")).select("global_id"))


def merged_ranges(spark, folder):
    """The time ranges of the shards of each site, overlapping and adjacent ones merged."""
    m = manifest(spark, folder).where("site is not null and time_ns is not null and shard_path is not null")
    r = m.groupBy("site", "shard_path").agg(F.min("time_ns").alias("start"), (F.max("time_ns") + 60_000_000_000).alias("end"))
    return filters.merge_ranges(r, by=["site"])


def browse(spark, folder):
    return layout.browse(manifest(spark, folder))


def browse_map(spark, folder):
    """Dates and hours of each site's nested map, counted."""
    b = layout.browse_map(manifest(spark, folder))
    return b.select("site", F.size("dates").alias("n_dates"), F.aggregate(F.map_values("dates"), F.lit(0), lambda s, h: s + F.size(h)).alias("n_hours"))


def site_blocks(spark, folder):
    return layout.site_blocks(manifest(spark, folder))


def monotone(spark, folder):
    return layout.backward_steps(manifest(spark, folder))


def shard_starts(spark, folder):
    return layout.shard_starts(manifest(spark, folder))


def frame_positions(spark, folder):
    return layout.frame_positions(manifest(spark, folder))


def site_codes(spark, folder):
    return layout.site_codes(manifest(spark, folder))


def totals(spark, folder):
    return layout.totals(manifest(spark, folder))


def shard_digest(spark, folder):
    return layout.digest(table(spark, folder, "shard_files"))


def dense_ids(spark, folder):
    m = manifest(spark, folder).where("site is not null and time_ns is not null")
    return layout.dense_ids(m.select("site", "time_ns", "global_id").distinct(), ["site", "time_ns", "global_id"])


def month_counts(spark, folder):
    m = manifest(spark, folder).where("site is not null and time_ns is not null")
    return m.groupBy("site", when.month_bucket("time_ns").alias("month")).agg(F.count("*").alias("n"))


def _days(spark, folder):
    m = manifest(spark, folder).where("site is not null and time_ns is not null")
    return m.select("global_id", "site", when.day_stamp("time_ns").alias("obs_day")).distinct()


def stratified_sample(spark, folder):
    return sample.stratified(_days(spark, folder), 1000, ["site", "obs_day"], seed=0)


def uniform_sample(spark, folder):
    return sample.uniform(manifest(spark, folder).select("global_id").distinct(), 300, seed=5)


def sample_check(spark, folder):
    d = _days(spark, folder)
    return sample.check(sample.stratified(d, 1000, ["site", "obs_day"]), sample.stratified(d.repartition(5), 1000, ["site", "obs_day"]))


def vector_health(spark, folder):
    return validate.health(table(spark, folder, "frame_vectors"))


def integrity(spark, folder):
    return validate.integrity(manifest(spark, folder), vectors(spark, folder).select("global_id").distinct().count())


def _checks(spark, folder):
    h = validate.health(table(spark, folder, "frame_vectors"))
    v = vectors(spark, folder)
    from lodevec.operators import search

    q = query_set(v)
    s = validate.self_retrieval(q, search.batch_top(v, q, 1))
    one = lambda d, name, value: d.select(F.lit(name).alias("name"), value.cast("double").alias("value"))
    return one(h, "zero_norm", F.col("n_zero")).unionByName(one(h, "non_finite", F.col("n_non_finite"))).unionByName(one(h, "nulls", F.col("n_null"))).unionByName(one(s, "self_retrieval", F.round("self_share", 6)))


def gated_report(spark, folder):
    return validate.gate(_checks(spark, folder), {"non_finite": 1e9})


def report_verdict(spark, folder):
    return validate.verdict(validate.gate(_checks(spark, folder), {"non_finite": 1e9}))


def frozen_thresholds(spark, folder):
    return validate.freeze(_checks(spark, folder), floor=0.5)


def reference_agreement(spark, folder):
    """Vectors of one week against all, by address: what lacks an address is missing."""
    f = frames(spark, folder).where("site is not null and time_ns is not null and frame_idx is not null").withColumn("obs_hour", when.hour_stamp("time_ns"))
    one = f.groupBy("site", "obs_hour", "frame_idx").agg(F.min_by("embedding", "global_id").alias("embedding"))
    ref = one.where(F.col("obs_hour") < "2006010900").withColumn("frame_idx", F.col("frame_idx") + F.when(F.col("frame_idx") > 100, 100000).otherwise(0))
    return validate.agreement(ref, one)


def export_roundtrip(spark, folder):
    """Times that don't come back from their readable form to the second: none."""
    m = manifest(spark, folder).where("time_ns is not null").select("time_ns").distinct()
    back = when.parse_readable(when.readable("time_ns"))
    sec = F.col("time_ns") - F.pmod("time_ns", F.lit(1_000_000_000))
    return m.agg(F.count("*").alias("n"), F.count_if(~back.eqNullSafe(sec)).alias("n_wrong"))


def score_summary(spark, folder):
    """Median and upper percentiles of the reported scores, as for latencies."""
    d = metrics.summary(table(spark, folder, "hits"), "score", ("query_id",))
    return d.select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("median", "p95", "p99", "mean", "min", "max")])


def speed_ratios(spark, folder):
    d = metrics.ratios(metrics.summary(table(spark, folder, "hits"), "score", ("query_id",)), 10.0)
    return d.select("query_id", F.round("speed_up", 5).alias("speed_up"))


def captions(spark, folder):
    """The three lines under each reported hit."""
    h = table(spark, folder, "hits").where("score is not null and not isnan(score) and time_ns is not null and site is not null")
    return h.select("hit_id", report.caption_of(F.col("hit_rank")).alias("caption"))


def paths_digest(spark, folder):
    """Number and digest of the ordered shard paths."""
    m = table(spark, folder, "manifest")
    return spark.createDataFrame([(layout.ordered_digest(m),)], "sha256 string").crossJoin(m.agg(F.count_distinct("shard_path").alias("n_shards")))  # one row each


def nearest_in_time(spark, folder):
    """For each reported hit the manifest frame of its site nearest to half a minute later."""
    from lodevec.sources.tables import code

    w = table(spark, folder, "hits").select(code("site").alias("site"), (F.col("time_ns") + 30_000_000_000).alias("want_ns")).where("site is not null and want_ns is not null")
    m = manifest(spark, folder).where("site is not null and time_ns is not null").fillna(-1, ["frame_idx"])
    return rebuild.nearest_frame(w, m, ["site"]).select("site", "want_ns", "global_id", "off_ns")


def rebuilt_shards(spark, folder):
    """Shards placed again in the sequence of all rows in order of path, frame and id."""
    m = manifest(spark, folder).where("shard_path is not null").select("shard_path", F.coalesce("frame_idx", F.lit(-1)).alias("frame_idx"), "global_id", "time_ns").distinct()
    rows = layout.dense_ids(m, ["shard_path", "frame_idx", "global_id", "time_ns"], "pos")
    key = F.concat_ws("|", "shard_path", "frame_idx", "global_id", F.coalesce("time_ns", F.lit(0)))
    keyed = rows.select("pos", key.alias("key"), "shard_path")
    s = keyed.groupBy("shard_path").agg(F.min_by("key", "pos").alias("first_key"), F.max_by("key", "pos").alias("last_key"), F.count("*").alias("n"))
    return rebuild.align(s, keyed)


def cross_site_pairs(spark, folder):
    """Pairs of sites that observed in the same hours, with how many."""
    b = layout.browse(manifest(spark, folder)).select("site", F.concat("date", "hour").alias("h"))
    o = b.select(F.col("site").alias("other"), "h")
    return b.join(o, "h").where("site < other").groupBy("site", "other").agg(F.count("*").alias("n_hours"))


def tiny_in_small(spark, folder):
    """Site-hours of the first fortnight that the whole lacks (none), and of the whole that the fortnight lacks."""
    m = manifest(spark, folder).where("site is not null and time_ns is not null")
    tiny = m.where("time_ns < 1137283200000000000").select(F.concat("site", when.hour_stamp("time_ns")).alias("k"))
    whole = m.select(F.concat("site", when.hour_stamp("time_ns")).alias("k"))
    a, b = validate.orphans(tiny, whole, "k"), validate.orphans(whole, tiny, "k")
    return a.agg(F.count("*").alias("n")).select(F.lit("tiny").alias("side"), "n").unionByName(b.agg(F.count("*").alias("n")).select(F.lit("whole").alias("side"), "n"))


def site_day_sets(spark, folder):
    """Site-days that only the manifest knows, only the hits know, or both."""
    from lodevec.sources.tables import code

    m = manifest(spark, folder).where("site is not null and time_ns is not null").select("site", when.day_stamp("time_ns").alias("d")).distinct()
    h = table(spark, folder, "hits").select(code("site").alias("site"), "time_ns").where("site is not null and time_ns is not null").select("site", when.day_stamp("time_ns").alias("d")).distinct()
    n = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return n(m.subtract(h), "manifest").unionByName(n(h.subtract(m), "hits")).unionByName(n(m.intersect(h), "both"))


def path_hours(spark, folder):
    site, hour = site_hour(F.col("shard_path"))
    m = table(spark, folder, "manifest").where("shard_path is not null").select("shard_path").distinct()
    return m.select("shard_path", site.alias("site"), hour.alias("obs_hour"))


_OK = "site IS NOT NULL AND time_ns IS NOT NULL"
_HOUR = f"strftime({UTC}, '%Y%m%d%H')"
_DAY = f"strftime({UTC}, '%Y%m%d')"
_BROWSE = f"b AS (SELECT site, {_DAY} AS date, strftime({UTC}, '%H') AS hour, min(global_id) AS gid_start, max(global_id) + 1 AS gid_end, count(*) AS n_frames FROM m WHERE {_OK} GROUP BY 1, 2, 3)"
_HSITE = r"lower(regexp_replace(site, '^\s+|\s+$', '', 'g'))"
_STRATA = f"""d AS (SELECT DISTINCT global_id, site, {_DAY} AS obs_day FROM m WHERE {_OK}),
per AS (SELECT greatest(1, 1000 // count(*)) AS k FROM (SELECT DISTINCT site, obs_day FROM d)),
s AS (SELECT *, row_number() OVER (PARTITION BY site, obs_day ORDER BY md5('0:' || global_id), global_id) AS r FROM d)"""
_HEALTH = """h AS (SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (embedding IS NOT NULL AND len(embedding) <> 64) AS n_length,
  count(*) FILTER (len(embedding) = 64 AND bad) AS n_non_finite, count(*) FILTER (len(embedding) = 64 AND (bad OR norm = 0)) AS n_zero,
  round(min(CASE WHEN len(embedding) = 64 THEN CASE WHEN bad THEN 0.0 ELSE norm END END), 6) AS min_norm
  FROM (SELECT embedding, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 AS bad, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM frame_vectors))"""
_CHECKS = f"""{V}, {QSET}, {_HEALTH}, sc AS (SELECT query_id, global_id, {COS} AS score FROM v, qs),
sr AS (SELECT avg(CASE WHEN best = query_id THEN 1.0 WHEN own = m AND best = query_id THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT query_id, arg_min(global_id, (-score, global_id)) AS best, max(score) AS m, max(CASE WHEN global_id = query_id THEN score END) AS own FROM sc GROUP BY query_id)),
c AS (SELECT 'zero_norm' AS name, CAST(n_zero AS DOUBLE) AS value FROM h UNION ALL SELECT 'non_finite', n_non_finite FROM h UNION ALL SELECT 'nulls', n_null FROM h UNION ALL SELECT 'self_retrieval', round(s, 6) FROM sr),
g AS (SELECT name, value, CASE name WHEN 'zero_norm' THEN 0.0 WHEN 'non_finite' THEN 1e9 WHEN 'self_retrieval' THEN 1.0 END AS threshold,
  CASE name WHEN 'zero_norm' THEN value <= 0 WHEN 'non_finite' THEN value <= 1e9 WHEN 'self_retrieval' THEN value >= 1.0 END AS passed FROM c)"""
_FIN = "score IS NOT NULL AND NOT isnan(score)"

QUERIES = {
    f.__name__: f
    for f in (id_islands, merged_ranges, browse, browse_map, site_blocks, monotone, shard_starts, frame_positions, site_codes, totals, shard_digest, dense_ids, month_counts, stratified_sample, uniform_sample,
              sample_check, vector_health, integrity, gated_report, report_verdict, frozen_thresholds, reference_agreement, export_roundtrip, score_summary, speed_ratios, nearest_in_time, rebuilt_shards,
              cross_site_pairs, tiny_in_small, site_day_sets, path_hours, captions, paths_digest)
}
SQL = {
    "id_islands": f"""WITH {M}, d AS (SELECT DISTINCT global_id AS i FROM m WHERE site IN ('brqu', 'dovr')), g AS (SELECT i, i - row_number() OVER (ORDER BY i) AS k FROM d)
SELECT min(i) AS start, max(i) + 1 AS "end" FROM g GROUP BY k""",
    "merged_ranges": f"""WITH {M}, r AS (SELECT site, shard_path, min(time_ns) AS s, max(time_ns) + 60000000000 AS e FROM m WHERE {_OK} AND shard_path IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, max(e) OVER (PARTITION BY site ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT site, min(s) AS start, max(e) AS "end" FROM g GROUP BY site, k""",
    "browse": f"WITH {M}, {_BROWSE} SELECT * FROM b",
    "browse_map": f"WITH {M}, {_BROWSE} SELECT site, CAST(count(DISTINCT date) AS INTEGER) AS n_dates, CAST(count(*) AS INTEGER) AS n_hours FROM b GROUP BY site",
    "site_blocks": f"WITH {M} SELECT site, min(global_id) AS first, max(global_id) AS last, count(DISTINCT global_id) AS n, max(global_id) - min(global_id) + 1 = count(DISTINCT global_id) AS contiguous FROM m WHERE site IS NOT NULL GROUP BY site",
    "monotone": f"""WITH {M}, l AS (SELECT site, time_ns < lag(time_ns) OVER (PARTITION BY site ORDER BY global_id, time_ns) AS back FROM m WHERE {_OK})
SELECT site, count(*) FILTER (back) AS n_back, count(*) FILTER (back) = 0 AS monotone FROM l GROUP BY site""",
    "shard_starts": f"WITH {M} SELECT shard_path, min(global_id) AS gid_start, count(*) AS n_rows, min(frame_idx) = 0 AS starts_at_0, max(frame_idx) - min(frame_idx) + 1 = count(DISTINCT frame_idx) AS gapless FROM m WHERE shard_path IS NOT NULL AND frame_idx IS NOT NULL GROUP BY shard_path",
    "frame_positions": f"WITH {M} SELECT global_id, shard_path, CAST(row_number() OVER (PARTITION BY shard_path ORDER BY time_ns, global_id) - 1 AS INTEGER) AS position FROM m WHERE shard_path IS NOT NULL AND time_ns IS NOT NULL",
    "site_codes": f"WITH {M} SELECT site, CAST(row_number() OVER (ORDER BY site) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT site FROM m WHERE site IS NOT NULL)",
    "totals": f"WITH {M} SELECT count(*) AS n_rows, count(DISTINCT global_id) AS n_ids, count(DISTINCT shard_path) AS n_shards, count(DISTINCT site) AS n_sites, min(time_ns) AS min_ns, max(time_ns) AS max_ns FROM m",
    "shard_digest": """WITH p AS (SELECT DISTINCT shard_path AS p FROM shard_files WHERE shard_path IS NOT NULL), q AS (SELECT p, replace(p, chr(92), '/') AS s FROM p),
f AS (SELECT sha256(array_to_string(list_slice(string_split(s, '/'), 1, 2), '/')) AS folder, sha256(string_agg(p, chr(10) ORDER BY p)) AS h, count(*) AS n FROM q GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_shards, sha256(string_agg(h, chr(10) ORDER BY h)) AS sha256 FROM f""",
    "dense_ids": f"WITH {M} SELECT site, time_ns, global_id, row_number() OVER (ORDER BY site, time_ns, global_id) - 1 AS dense_id FROM (SELECT DISTINCT site, time_ns, global_id FROM m WHERE {_OK})",
    "month_counts": f"WITH {M} SELECT site, CAST((year({UTC}) - 1970) * 12 + month({UTC}) - 1 AS INTEGER) AS month, count(*) AS n FROM m WHERE {_OK} GROUP BY 1, 2",
    "stratified_sample": f"WITH {M}, {_STRATA} SELECT global_id, site, obs_day FROM s, per WHERE r <= k",
    "uniform_sample": f"WITH {M}, d AS (SELECT DISTINCT global_id FROM m) SELECT global_id FROM d ORDER BY md5('5:' || global_id), global_id LIMIT 300",
    "sample_check": f"WITH {M}, {_STRATA} SELECT count(*) AS n, count(*) = count(DISTINCT global_id) AS unique_ids, true AS repeatable FROM s, per WHERE r <= k",
    "vector_health": f"WITH {_HEALTH} SELECT * FROM h",
    "integrity": f"""WITH {M}, {V}, l AS (SELECT time_ns < lag(time_ns) OVER (PARTITION BY site ORDER BY global_id, time_ns) AS back FROM m WHERE {_OK})
SELECT count(*) AS n_rows, count(DISTINCT global_id) AS n_ids, count(DISTINCT shard_path) AS n_shards, count(DISTINCT site) AS n_sites, max(global_id) - min(global_id) + 1 = count(DISTINCT global_id) AS dense,
(SELECT count(*) FILTER (back) FROM l) AS n_back, (SELECT count(*) FILTER (back) FROM l) = 0 AS monotone, count(DISTINCT global_id) = (SELECT count(DISTINCT global_id) FROM v) AS counts_agree FROM m""",
    "gated_report": f"WITH {_CHECKS} SELECT * FROM g",
    "report_verdict": f"WITH {_CHECKS} SELECT coalesce(bool_and(passed), false) AS passed, count(*) AS n FROM g",
    "frozen_thresholds": f"WITH {_CHECKS} SELECT name, round(CASE WHEN name IN ('zero_norm', 'non_finite') THEN value + 0.05 ELSE greatest(0.5, value - 0.05) END, 3) AS threshold FROM c",
    "reference_agreement": f"""WITH {M}, {V}, f AS (SELECT site, {_HOUR} AS obs_hour, frame_idx, arg_min(embedding, global_id) AS embedding FROM m JOIN v USING (global_id) WHERE {_OK} AND frame_idx IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT site, obs_hour, frame_idx + CASE WHEN frame_idx > 100 THEN 100000 ELSE 0 END AS frame_idx, embedding AS qv FROM f WHERE obs_hour < '2006010900'),
j AS (SELECT f.embedding IS NULL AS lost, CASE WHEN f.embedding IS NOT NULL THEN {COS} END AS c FROM r LEFT JOIN f USING (site, obs_hour, frame_idx))
SELECT count(*) AS n, count(*) FILTER (lost) AS n_missing, avg(c) AS mean_cos, min(c) AS min_cos FROM j""",
    "export_roundtrip": f"WITH {M} SELECT count(DISTINCT time_ns) AS n, CAST(0 AS BIGINT) AS n_wrong FROM m WHERE time_ns IS NOT NULL",
    "score_summary": f"""SELECT query_id, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99,
round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max FROM hits WHERE {_FIN} GROUP BY query_id""",
    "speed_ratios": f"SELECT query_id, round(10.0 / quantile_cont(score, 0.5), 5) AS speed_up FROM hits WHERE {_FIN} GROUP BY query_id",
    "captions": """SELECT hit_id, '#' || coalesce(CAST(hit_rank AS VARCHAR), '-') || '  score ' || CAST(CAST(CAST(score AS DECIMAL(20,8)) AS DECIMAL(18,4)) AS VARCHAR) || chr(10) || upper(site) || '  ' || strftime(make_timestamp(time_ns // 1000), '%Y-%m-%d %H:%M:%S') || ' UTC'
|| chr(10) || coalesce(shard_path, '-') || '  frame ' || coalesce(CAST(frame_idx AS VARCHAR), '-') AS caption FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND time_ns IS NOT NULL AND site IS NOT NULL""",
    "paths_digest": "SELECT sha256(string_agg(shard_path, chr(10) ORDER BY shard_path)) AS sha256, count(*) AS n_shards FROM (SELECT DISTINCT shard_path FROM manifest WHERE shard_path IS NOT NULL)",
    "nearest_in_time": f"""WITH {M}, w AS (SELECT DISTINCT {_HSITE} AS site, time_ns + 30000000000 AS want_ns FROM hits WHERE site IS NOT NULL AND time_ns IS NOT NULL),
t AS (SELECT site, time_ns, arg_min(global_id, (coalesce(frame_idx, -1), global_id)) AS global_id, min(coalesce(frame_idx, -1)) AS frame_idx FROM m WHERE {_OK} GROUP BY 1, 2),
b AS (SELECT w.site, want_ns, t.global_id, t.frame_idx, abs(t.time_ns - want_ns) AS off_ns FROM w ASOF JOIN t ON w.site = t.site AND t.time_ns <= w.want_ns),
a AS (SELECT w.site, want_ns, t.global_id, t.frame_idx, abs(t.time_ns - want_ns) AS off_ns FROM w ASOF JOIN t ON w.site = t.site AND t.time_ns >= w.want_ns)
SELECT site, want_ns, arg_min(global_id, (off_ns, frame_idx, global_id)) AS global_id, min(off_ns) AS off_ns FROM (SELECT * FROM b UNION ALL SELECT * FROM a) GROUP BY 1, 2""",
    "rebuilt_shards": f"""WITH {M}, d AS (SELECT DISTINCT shard_path, coalesce(frame_idx, -1) AS frame_idx, global_id, time_ns FROM m WHERE shard_path IS NOT NULL),
r AS (SELECT shard_path, row_number() OVER (ORDER BY shard_path, frame_idx, global_id, time_ns) - 1 AS pos FROM d)
SELECT shard_path, min(pos) AS start, max(pos) + 1 AS "end" FROM r GROUP BY shard_path""",
    "cross_site_pairs": f"WITH {M}, {_BROWSE} SELECT a.site, o.site AS other, count(*) AS n_hours FROM b a JOIN b o USING (date, hour) WHERE a.site < o.site GROUP BY 1, 2",
    "tiny_in_small": f"""WITH {M}, w AS (SELECT DISTINCT site || {_HOUR} AS k FROM m WHERE {_OK}), t AS (SELECT DISTINCT site || {_HOUR} AS k FROM m WHERE {_OK} AND time_ns < 1137283200000000000)
SELECT 'tiny' AS side, count(*) AS n FROM (FROM t EXCEPT FROM w) UNION ALL SELECT 'whole', count(*) FROM (FROM w EXCEPT FROM t)""",
    "site_day_sets": f"""WITH {M}, a AS (SELECT DISTINCT site, {_DAY} AS d FROM m WHERE {_OK}), h AS (SELECT DISTINCT {_HSITE} AS site, {_DAY} AS d FROM hits WHERE {_OK})
SELECT 'manifest' AS side, count(*) AS n FROM (FROM a EXCEPT FROM h) UNION ALL SELECT 'hits', count(*) FROM (FROM h EXCEPT FROM a) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM h)""",
    "path_hours": """WITH p AS (SELECT DISTINCT shard_path, lower(replace(shard_path, chr(92), '/')) AS q FROM manifest WHERE shard_path IS NOT NULL)
SELECT shard_path, CASE WHEN q LIKE '%site=%' THEN regexp_extract(q, 'site=([^/]+)', 1) ELSE regexp_extract(q, '([^/]+)/[0-9]{4}/[0-9]{10}', 1) END AS site,
CASE WHEN q LIKE '%site=%' THEN replace(regexp_extract(q, 'dt=([0-9-]{10})', 1), '-', '') || regexp_extract(q, 'hh=([0-9]{2})', 1) ELSE regexp_extract(q, '/[0-9]{4}/([0-9]{10})', 1) END AS obs_hour FROM p""",
}
