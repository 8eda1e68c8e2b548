"""Mixing sources to target shares of the total size in tokens.

Method: tokens are summed per source (partial sums before the shuffle, so a source that holds
a third of all rows costs one row per task); each source's repetition rate is
``min(max_uses, target_share * total / tokens)``; every document is emitted ``floor(rate)``
times plus one more with probability equal to the fraction, decided by a hash of its id and
the seed. A rate is a property of the source, so emission is a map over documents: no shuffle,
no order, and the same copies at any partitioning.

Sources compare in lower case without white space around them. Documents of sources that are
not in the targets (null among them) are not emitted but count in the total. Targets without
documents, or whose documents have no tokens, get rate ``max_uses`` and contribute nothing.
A null or negative share counts as 0, a null ``max_uses`` as 0. Repeated targets: the one with
the largest share, then the most uses, counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.tokenizer import token_counts
from lodevec.sources.tables import code

MOST_TARGETS = 100_000  # a list of mixing targets is written by hand; more is refused


def source_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(src, n_docs, tokens)`` for each source code, null included."""
    return _sums(token_counts(docs.select("source", "text"), ["source"], path))


def _sums(t: DataFrame) -> DataFrame:
    # raw spellings first: the code is then derived from a few rows only
    raw = t.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    return raw.groupBy(code("source").alias("src")).agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))


def clean_targets(targets: DataFrame) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("target_share"), F.desc("max_uses"), "source")
    t = targets.select(
        "source", code("source").alias("src"),
        F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.col("max_uses").cast("int"), F.lit(0)), F.lit(0)).alias("max_uses"),
    )
    return t.where("src is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mix_plan(docs: DataFrame, targets: DataFrame, path: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """One row per target: its tokens, repetition rate, and whether it falls short of its share.

    ``counted(doc_id, source, n_tokens)`` stands for the documents where their tokens are counted already.
    """
    sums = source_tokens(docs, path) if counted is None else _sums(counted)
    # a few rows (one per source): the total is a window over them, not a second pass over the corpus
    sums = sums.withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    empty = F.lit(0).cast("long")
    joined = clean_targets(targets).join(sums, "src", "full_outer").withColumn("total", F.coalesce(F.max("total").over(Window.partitionBy()), empty))
    t = joined.where("source is not null").withColumn("tokens", F.coalesce("tokens", empty)).withColumn("n_docs", F.coalesce("n_docs", empty))
    want = F.col("target_share") * F.col("total")
    most = F.col("max_uses").cast("double")
    rate = F.when(F.col("tokens") > 0, F.least(most, want / F.when(F.col("tokens") > 0, F.col("tokens")))).otherwise(most)
    return t.select(
        "source", "src", "target_share", "max_uses", "n_docs", "tokens", "total",
        rate.alias("rate"), (F.col("tokens") * most < want).alias("short"),
    )


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every document."""
    return token_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"], path)


def emit(docs: DataFrame, plan: DataFrame, seed: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """``(doc_id, src, n_tokens, copy)``: the copies that the plan calls for, ``copy`` from 1 on."""
    if plan.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mixing targets")
    counted = (count_documents(docs) if counted is None else counted).withColumn("src", code("source"))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    uses = F.floor("rate").cast("int") + (u < F.col("rate") - F.floor("rate")).cast("int")
    d = counted.join(F.broadcast(plan.select("src", "rate")), "src").withColumn("uses", uses).where("uses > 0")
    return d.select("doc_id", "src", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))


def report(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Target and actual share of every target source, with the tokens and documents emitted. Texts are read once."""
    from lodevec.session import stage

    counted = stage(count_documents(docs), "counted")
    plan = stage(mix_plan(docs, targets, counted=counted), "mix")
    got = emit(docs, plan, seed, counted).groupBy("src").agg(F.count("*").alias("copies"), F.countDistinct("doc_id").alias("docs_used"), F.sum("n_tokens").alias("mixed_tokens"))
    out = plan.join(got, "src", "left").fillna(0, ["copies", "docs_used", "mixed_tokens"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    return out.select("source", "target_share", "max_uses", "rate", "tokens", "copies", "docs_used", "mixed_tokens",
                      F.when(total > 0, F.col("mixed_tokens") / F.when(total > 0, total)).otherwise(0.0).alias("actual_share"), "short")
