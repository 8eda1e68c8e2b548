"""Collapsing runs of repeated consecutive events.

A *sequence* is what shares the key columns, in order of time, then of id. An event continues a
run if it comes at most ``gap_ns`` after the event before it and its score differs from that
one's by at most ``tolerance``; each longest run becomes one event with count and duration.

Method: boundary-only rows. Inside a slab of time each event meets its predecessor by ``lag``;
only events that differ from it are kept, with their position. ``lead`` over these starts gives
each run's count (difference of positions) and end (time of the row before the next start).

A sequence may hold a third of all rows, so no window spans one: windows run inside
(key, slab of ``slab_ns``), and only the first and last start of each slab - two rows however
many events there are - meet across slabs, where runs that cross an edge are joined up.

Defined results: rows whose site, time or score is null (or score NaN) take no part; null in
another key column is a value like any other; rows that agree in key, time and id count once
(the delivery with the lowest hit_id gives the score); several ids at one time follow each other
by id (null first); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.session import stage
from lodevec.sources.tables import code

HOUR_NS = 3_600_000_000_000


def usable_hits(hits: DataFrame) -> DataFrame:
    return hits.select("hit_id", "query_id", code("site").alias("site"), "time_ns", "global_id", F.col("score").cast("double").alias("score")).where(
        "site is not null and time_ns is not null and score is not null and not isnan(score)"
    )


def collapse(hits: DataFrame, gap_ns: int = 60_000_000_000, tolerance: float = 0.001, slab_ns: int = HOUR_NS) -> DataFrame:
    """``(query_id, site, start_ns, end_ns, n_hits, duration_ns)``: one row for every run, single events too."""
    slab = F.expr(f"time_ns div {int(slab_ns)}L")
    keys = ["query_id", "site", "slab"]
    h = usable_hits(hits).withColumn("slab", slab)
    # partial minima run before the shuffle: repeated deliveries don't travel
    h = h.groupBy(*keys, "time_ns", "global_id").agg(F.min(F.struct("hit_id", "score")).alias("kept")).select(*keys, "time_ns", "global_id", "kept.score")
    w = Window.partitionBy(*keys).orderBy("time_ns", "global_id")
    whole = Window.partitionBy(*keys)
    h = h.select(
        *keys, "time_ns", "score", F.row_number().over(w).alias("pos"), F.lag("time_ns").over(w).alias("pt"), F.lag("score").over(w).alias("ps"),
        F.count("*").over(whole).alias("n"), F.max(F.struct("time_ns", "global_id", "score")).over(whole).alias("last"),
    )
    breaks = lambda t, s: (F.col("time_ns") - t > gap_ns) | (F.abs(F.col("score") - s) > tolerance)
    starts = h.where(F.col("pt").isNull() | breaks(F.col("pt"), F.col("ps")))
    by_pos = Window.partitionBy(*keys).orderBy("pos")
    starts = starts.select(*keys, "pos", "time_ns", "score", "n", F.col("last.time_ns").alias("last_t"), F.col("last.score").alias("last_s"),
                           F.lead("pos").over(by_pos).alias("next_pos"), F.lead("pt").over(by_pos).alias("before_next"))
    starts = starts.withColumn("cnt", F.coalesce("next_pos", F.col("n") + 1) - F.col("pos")).withColumn("end_ns", F.coalesce("before_next", "last_t"))
    starts = stage(starts.select(*keys, "pos", "time_ns", "score", "last_t", "last_s", "next_pos", "cnt", "end_ns"), "runs")

    edge = (F.col("pos") == 1) | F.col("next_pos").isNull()
    inner = starts.where(~edge).select("query_id", "site", F.col("time_ns").alias("start_ns"), "end_ns", F.col("cnt").cast("long").alias("n_hits"))
    seq = Window.partitionBy("query_id", "site").orderBy("slab", "pos")
    e = starts.where(edge)
    e = e.withColumn("lt", F.lag("last_t").over(seq)).withColumn("ls", F.lag("last_s").over(seq))
    e = e.withColumn("opens", ((F.col("pos") > 1) | F.col("lt").isNull() | breaks(F.col("lt"), F.col("ls"))).cast("int"))
    e = e.withColumn("run", F.sum("opens").over(seq))
    joined = e.groupBy("query_id", "site", "run").agg(F.min("time_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("cnt").cast("long").alias("n_hits")).drop("run")
    return inner.unionByName(joined).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))
