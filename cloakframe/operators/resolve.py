"""Who owns a string, and which of overlapping spans hold."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patterns import SPAN_COLUMNS


def reject_failed_checksums(spans: DataFrame) -> DataFrame:
    """Drops pattern spans whose corroborating checksum failed."""
    return spans.where("NOT (match_class = 'built_in_pattern' AND NOT checksum_ok)")


_STRENGTH = "struct(rank, -confidence, category, coalesce(main_text, ''))"


def unify_ownership(spans: DataFrame) -> DataFrame:
    """One owner for each string over the whole batch: every claim takes the category, class and main text of the
    strongest (rank, then confidence, then category), and claims that became equal merge.

    ``owned_from`` is the category a claim gave up, null where nothing changed.
    """
    best = spans.groupBy("owner_key").agg(F.min_by(F.struct("category", "match_class", "rank", "main_text", "confidence", "checksum_ok"), F.expr(_STRENGTH)).alias("_o"))
    # as all that follows wants it; by number, since spans are few bytes but much work, and would be put together into a few tasks
    spark = spans.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    joined = spans.join(best, "owner_key").repartition(tasks, "doc_ord", "region_ord")
    changed = F.col("_o.category") != F.col("category")
    out = joined.select(
        "doc_ord", "region_ord", "start", "end", "byte_len", F.col("_o.category").alias("category"), "original", F.when(F.col("rank") == F.col("_o.rank"), F.coalesce("main_text", "_o.main_text")).otherwise(F.col("_o.main_text")).alias("main_text"),
        F.when(changed, F.col("_o.confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(changed, F.col("_o.checksum_ok")).otherwise(F.col("checksum_ok")).alias("checksum_ok"),
        F.col("_o.match_class").alias("match_class"), F.col("_o.rank").alias("rank"), "owner_key", F.when(changed, F.col("category")).alias("owned_from"),
    )
    same = ["doc_ord", "region_ord", "start", "end", "category", "owner_key"]
    rest = [c for c in out.columns if c not in same]
    merged = out.groupBy(*same).agg(F.min_by(F.struct(*rest), F.struct("rank", -F.col("confidence"), F.coalesce("main_text", F.lit("")))).alias("_s"), F.max("owned_from").alias("_from"))
    return merged.select(*[c if c in same else F.col(f"_s.{c}").alias(c) for c in SPAN_COLUMNS], F.col("_from").alias("owned_from"))


def ownership_losses(unified: DataFrame, limit: int = 50) -> DataFrame:
    """``category, owned_from, owner_key`` for strings that changed hands, once each; a report of ``limit`` rows."""
    return unified.where("owned_from IS NOT NULL").select("category", "owned_from", "owner_key").distinct().orderBy("owner_key", "owned_from").limit(limit)


#: The total order in which spans are looked at; no two different spans are equal in it.
PRIORITY = "struct(rank, -confidence, -byte_len, start, category, end, original, coalesce(main_text, ''))"


def _clustered(spans: DataFrame) -> DataFrame:
    """``spans`` with ``_c``, the start of their cluster: a region is cut wherever no span crosses, which changes no outcome
    and keeps a region with very many spans from being one row."""
    w = Window.partitionBy("doc_ord", "region_ord").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_c", F.when(reach.isNull() | (F.col("start") >= reach), F.col("start")))
    return opened.withColumn("_c", F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def greedy(starts: list[int], ends: list[int]) -> list[bool]:
    """For spans in order of priority: does each stay, being disjoint from all that stayed before it?"""
    held: list[int] = []
    until: list[int] = []
    kept = []
    for s, e in zip(starts, ends, strict=True):
        at = bisect_left(held, e)
        free = not at or until[at - 1] <= s
        kept.append(free)
        if free:
            held.insert(at, s)
            until.insert(at, e)
    return kept


#: Clusters of up to so many spans are folded by an expression, larger ones in Python, which sees their places only.
FOLDED = 64
_STATE = "struct<held: array<struct<a: int, b: int>>, kept: array<boolean>>"
_FOLD = f"""aggregate(s, CAST(struct(array() AS held, array() AS kept) AS {_STATE}), (z, x) -> transform(array(exists(z.held, y -> x.start < y.b AND y.a < x.end)), hit ->
    CAST(struct(CASE WHEN hit THEN z.held ELSE array_append(z.held, struct(x.start AS a, x.end AS b)) END AS held, array_append(z.kept, NOT hit) AS kept) AS {_STATE}))[0], z -> z.kept)"""


def _far(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else greedy(list(a), list(b)) for a, b in zip(starts, ends, strict=True)])


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """``spans`` with ``kept``. Strongest first, each stays that is disjoint from all that stayed before it.

    The order is total: rank, confidence (high first), bytes (many first), start, category, end, original, main text. Spans
    alike in all of these are the same claim twice, of which one stays. Regions are independent, and so are the clusters of a
    region between which no span crosses.
    """
    own = [c for c in spans.columns if c not in ("doc_ord", "region_ord")]
    item = F.struct(F.expr(PRIORITY).alias("p"), *own)
    grouped = _clustered(spans).groupBy("doc_ord", "region_ord", "_c").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in own])).alias("s")).drop("_c")
    places = [F.expr(f"CASE WHEN size(s) > {FOLDED} THEN transform(s, x -> x.{c}) END") for c in ("start", "end")]
    grouped = grouped.withColumn("far", F.pandas_udf(_far, "array<boolean>")(*places))
    kept = F.expr(f"CASE WHEN size(s) = 1 THEN array(true) WHEN size(s) <= {FOLDED} THEN {_FOLD} ELSE far END")
    rows = grouped.withColumn("kept", kept).select("doc_ord", "region_ord", F.explode(F.arrays_zip("s", "kept")).alias("x"))
    return rows.select("doc_ord", "region_ord", *[F.col(f"x.s.{c}").alias(c) for c in own], F.col("x.kept").alias("kept"))


def resolve_overlaps_native(spans: DataFrame) -> DataFrame:
    """The kept spans only, in the same order of priority, by one fold over each cluster's sorted spans, without Python. For
    clusters of some hundred spans."""
    own = [c for c in SPAN_COLUMNS if c not in ("doc_ord", "region_ord")]
    item = F.struct(F.expr(PRIORITY).alias("p"), *own)
    grouped = _clustered(spans).groupBy("doc_ord", "region_ord", "_c").agg(F.array_sort(F.collect_list(item)).alias("s"))
    fold = "aggregate(s, slice(s, 1, 0), (k, x) -> CASE WHEN exists(k, y -> x.start < y.end AND y.start < x.end) THEN k ELSE concat(k, array(x)) END)"
    rows = grouped.select("doc_ord", "region_ord", F.explode(F.expr(fold)).alias("x"))
    return rows.select("doc_ord", "region_ord", *[F.col(f"x.{c}").alias(c) for c in own])
