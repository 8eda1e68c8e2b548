"""The pN_ queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.llm import clusters, foul, mixing, neighbours, runs, subset, tokenizer
from lodevec.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.find(table(spark, folder, "frame_vectors")).where("global_id <> cluster_gid").select("cluster_gid", "global_id").distinct()


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster with its size and its three most typical members."""
    m = clusters.find(table(spark, folder, "frame_vectors"))
    w = Window.partitionBy("comp", "nth").orderBy(F.desc("typical"), "global_id")
    top = m.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return top.groupBy("comp", "nth", "cluster_gid", "n").agg(F.sort_array(F.collect_list(F.struct("r", "global_id"))).alias("t")).select(
        "cluster_gid", F.col("n").alias("size"), F.col("t.global_id").alias("typical_gids"))


P3_CELLS = 896
P3_FOUND_CELLS, P3_FOUND_SLACK = 8, 0.35


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse(table(spark, folder, "hits")).where("n_hits >= 2").drop("duration_ns")


def p2_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event after collapsing, single ones too, with count and duration."""
    return runs.collapse(table(spark, folder, "hits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.mutual(neighbours.nearest(table(spark, folder, "frame_vectors"), k=10, min_score=0.95, cells=P3_FOUND_CELLS, slack=P3_FOUND_SLACK))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar frames of every frame whose id is divisible by 50, against all frames."""
    return neighbours.nearest(table(spark, folder, "frame_vectors"), k=10, cells=P3_CELLS, query_step=50)


def p4_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row a request: rows chosen, whether all are different usable rows, and whether no site-day has two rows more than another that had rows left."""
    got = p4_subset(spark, folder)
    day = F.date_format(F.timestamp_seconds(F.expr("time_ns div 1000000000L")), "yyyyMMdd")
    have = subset.usable_rows(table(spark, folder, "manifest")).distinct().groupBy("site", day.alias("obs_day")).agg(F.count("*").alias("n_all"))
    by = got.groupBy("request_name", "site", "obs_day").agg(F.count("*").alias("n"), F.count_distinct(F.struct("global_id", "time_ns")).alias("d"))
    m = by.join(have, ["site", "obs_day"], "left").groupBy("request_name").agg(
        F.sum("n").alias("n_rows"), F.bool_and((F.col("n") == F.col("d")) & (F.col("n") <= F.coalesce("n_all", F.lit(0)))).alias("usable"), F.max("n").alias("hi"), F.min(F.when(F.col("n") < F.col("n_all"), F.col("n"))).alias("lo"))
    return m.select("request_name", "n_rows", "usable", F.coalesce(F.col("hi") - F.col("lo") <= 1, F.lit(True)).alias("even"))


def p4_subset(spark: SparkSession, folder: str) -> DataFrame:
    return subset.requested(table(spark, folder, "manifest"), table(spark, folder, "subset_requests"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_subset(spark, folder).select("site", "obs_day").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose decoded ids differ from their text: none, when all is well."""
    docs = table(spark, folder, "documents").selectExpr("doc_id", "coalesce(text, '') as text")
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.selectExpr("doc_id", "xxhash64(text) as a").join(back.selectExpr("doc_id", "xxhash64(decoded) as b"), "doc_id", "full_outer").where("not (a <=> b)").select("doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).where("short").select("source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where(F.col("score") >= foul.FOUL).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return foul.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return foul.rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return foul.passages(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents scored, whether every score lies in 0..1, and whether the rates by source add up to the documents found."""
    s = foul.scores(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id", "source"])
    by = foul.rates_of(s)
    all_ = s.agg(F.count("*").alias("n_docs"), F.coalesce(F.bool_and((F.col("score") >= 0) & (F.col("score") <= 1)), F.lit(True)).alias("in_range"), F.coalesce(F.sum((F.col("score") >= foul.FOUL).cast("long")), F.lit(0)).alias("f"))
    sums = by.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_foul"), F.lit(0)).alias("g"))
    return all_.crossJoin(sums).select("n_docs", "in_range", ((F.col("d") == F.col("n_docs")) & (F.col("g") == F.col("f"))).alias("rates_agree"))  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_events": p2_events,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p4_subset": p4_subset,
    "p4_check": p4_check,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
    "p8_counts": p8_counts,
    "p8_passages": p8_passages,
}

_RUNS = """
WITH u AS (
  SELECT query_id, lower(regexp_replace(site, '^\\s+|\\s+$', '', 'g')) AS site, time_ns, global_id, arg_min(score, hit_id) AS score
  FROM hits WHERE site IS NOT NULL AND time_ns IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY 1, 2, 3, 4
), l AS (
  SELECT *, lag(time_ns) OVER w AS pt, lag(score) OVER w AS ps FROM u
  WINDOW w AS (PARTITION BY query_id, site ORDER BY time_ns, global_id)
), g AS (
  SELECT *, sum(CASE WHEN pt IS NULL OR time_ns - pt > 60000000000 OR abs(score - ps) > 0.001 THEN 1 ELSE 0 END)
    OVER (PARTITION BY query_id, site ORDER BY time_ns, global_id) AS run FROM l
)
SELECT query_id, site, min(time_ns) AS start_ns, max(time_ns) AS end_ns, count(*) AS n_hits{more}
FROM g GROUP BY query_id, site, run{having}
"""

SQL: dict[str, str] = {
    "p6_roundtrip": "SELECT doc_id FROM documents WHERE false",
    "p8_counts": "SELECT count(*) AS n_docs, true AS in_range, true AS rates_agree FROM documents",
    "p2_found": _RUNS.format(more="", having=" HAVING count(*) >= 2"),
    "p2_events": _RUNS.format(more=", max(time_ns) - min(time_ns) AS duration_ns", having=""),
    "p3_found": """
        WITH v AS (SELECT DISTINCT global_id, CAST(embedding AS DOUBLE[]) AS e FROM frame_vectors
          WHERE global_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u AS (SELECT global_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
        p AS (SELECT a.global_id AS src, b.global_id AS dst, max(list_inner_product(a.e, b.e)) AS s FROM u a JOIN u b ON a.global_id <> b.global_id
          WHERE list_inner_product(a.e, b.e) >= 0.95 GROUP BY 1, 2),
        r AS (SELECT src, dst FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 10)
        SELECT least(src, dst) AS gid_a, greatest(src, dst) AS gid_b FROM r GROUP BY 1, 2 HAVING count(*) = 2""",
    "p4_check": """
        WITH u AS (SELECT lower(regexp_replace(site, '^\\s+|\\s+$', '', 'g')) AS site, time_ns, global_id FROM manifest WHERE site IS NOT NULL AND time_ns >= 1104537600000000000)
        SELECT request_name, CAST(least(ceil(any_value(share_permille) * (SELECT count(*) FROM u) / 1000.0), (SELECT count(*) FROM (SELECT DISTINCT * FROM u))) AS BIGINT) AS n_rows, true AS usable, true AS even
        FROM subset_requests GROUP BY request_name""",
    "p4_found": """
        SELECT DISTINCT lower(regexp_replace(site, '^\\s+|\\s+$', '', 'g')) AS site, strftime(make_timestamp(time_ns // 1000), '%Y%m%d') AS obs_day
        FROM manifest WHERE site IS NOT NULL AND time_ns >= 1104537600000000000""",
}
