"""The re-identification registry: one placeholder for each original, numbered by first occurrence.

Numbers are dense over the whole batch without sorting it in one task: originals are range-partitioned
by label and first occurrence, counted by partition, and numbered as partition offset plus place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.presets import LABELS
from .graph import cut

REGISTRY = "category string, original string, original_lc string, placeholder string, label string, number long, count long, overridden boolean"
RETIRED = "placeholder string, label string, number long"
PLACEHOLDER = re.compile(r"^\[[A-Z][A-Z0-9_]*_[0-9]+\]$")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def no_retired(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RETIRED)


def _label(column: str):
    return F.create_map(*[F.lit(z) for pair in LABELS.items() for z in pair])[F.col(column)]


def assign(kept: DataFrame, registry: DataFrame, retired: DataFrame) -> DataFrame:
    """``registry`` after the kept spans: known originals count on, new ones are numbered by label in the order of
    document, region and place, past the label's counter and over numbers that entries or retired ones hold."""
    spark = kept.sparkSession
    seen = kept.groupBy("owner_key").agg(F.count("*").alias("n"), F.min(F.struct("doc_ord", "region_ord", "start", "category", F.coalesce("main_text", "original").alias("original"))).alias("f"))
    known = registry.join(seen.select(F.col("owner_key").alias("original_lc"), "n"), "original_lc", "left")
    known = known.select(*[F.col(c) if c != "count" else (F.col("count") + F.coalesce("n", F.lit(0))).alias("count") for c in registry.columns])
    fresh = seen.join(registry.select(F.col("original_lc").alias("owner_key")), "owner_key", "left_anti")
    fresh = fresh.select("owner_key", "n", "f.doc_ord", "f.region_ord", "f.start", "f.category", "f.original", _label("f.category").alias("label"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["label", "doc_ord", "region_ord", "start", "owner_key"]
    fresh = cut(fresh.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = fresh.groupBy("label", "_p").agg(F.count("*").alias("c"))  # labels x partitions rows
    before = Window.partitionBy("label").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("label", "_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    used = registry.select("label", "number").unionByName(retired.select("label", "number"))
    automatic = registry.where("NOT overridden").select("label", "number").unionByName(retired.select("label", "number"))
    counters = automatic.groupBy("label").agg(F.max("number").alias("top"))
    taken = used.join(counters, "label", "left").where("number > coalesce(top, 0)").groupBy("label").agg(F.array_sort(F.collect_set("number")).alias("taken"))  # overridden numbers only
    place = F.row_number().over(Window.partitionBy("label", "_p").orderBy(*order[1:]))
    numbered = fresh.withColumn("_k", place).join(sizes, ["label", "_p"]).join(counters, "label", "left").join(taken, "label", "left")
    number = F.expr("aggregate(coalesce(taken, CAST(array() AS array<bigint>)), coalesce(top, 0) + offset + _k, (n, t) -> CASE WHEN t <= n THEN n + 1 ELSE n END)")
    new = numbered.withColumn("number", number.cast("long"))
    new = new.select("category", "original", F.lower("original").alias("original_lc"), F.format_string("[%s_%d]", "label", "number").alias("placeholder"), "label", "number", F.col("n").alias("count"), F.lit(False).alias("overridden"))
    return known.unionByName(new)


def lookup(registry: DataFrame, category: str, original: str) -> DataFrame:
    """The placeholder of an original, under its category if it is there, else under any."""
    hit = registry.where(F.col("original_lc") == original.lower())
    return hit.orderBy((F.col("category") != category).cast("int")).limit(1).select("placeholder")


def export(registry: DataFrame) -> DataFrame:
    """The mapping: original, placeholder, category, count, by category, length of placeholder, placeholder."""
    return registry.orderBy("category", F.length("placeholder"), "placeholder").select("original", "placeholder", "category", "count")


def entries(registry: DataFrame) -> DataFrame:
    """Longest original first (bytes), then in the order of ``export``."""
    return registry.orderBy(F.octet_length("original").desc(), "category", F.length("placeholder"), "placeholder")


def owner(registry: DataFrame, placeholder: str) -> DataFrame:
    return registry.where(F.col("placeholder") == placeholder)


def set_placeholder(registry: DataFrame, retired: DataFrame, original: str, placeholder: str) -> DataFrame:
    """``registry`` with one placeholder replaced. A malformed, taken or retired one is refused, and an unknown original."""
    if not PLACEHOLDER.match(placeholder):
        raise ValueError(f"not a placeholder: {placeholder}")
    low = original.lower()
    if registry.where((F.col("placeholder") == placeholder) & (F.col("original_lc") != low)).limit(1).count() or retired.where(F.col("placeholder") == placeholder).limit(1).count():
        raise ValueError(f"{placeholder} is taken")
    if not registry.where(F.col("original_lc") == low).limit(1).count():
        raise ValueError(f"no entry for {original}")
    label, number = placeholder[1:-1].rsplit("_", 1)
    mine = F.col("original_lc") == low
    new = {"placeholder": F.lit(placeholder), "label": F.lit(label), "number": F.lit(int(number)).cast("long"), "overridden": F.lit(True)}
    return registry.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in registry.columns])


rename = set_placeholder


def overrides(registry: DataFrame) -> DataFrame:
    return registry.where("overridden").select("category", "original", "placeholder")


def forget(registry: DataFrame, retired: DataFrame, original: str) -> tuple[DataFrame, DataFrame]:
    """Without an original; its number is never used again."""
    mine = F.col("original_lc") == original.lower()
    return registry.where(~mine), retired.unionByName(registry.where(mine).select("placeholder", "label", "number")).distinct()


def from_entries(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    """A registry from (category, original, placeholder, count); two entries for one original are refused."""
    lows = [o.lower() for _, o, _, _ in rows]
    if len(set(lows)) != len(lows):
        raise ValueError("one original has two entries")
    made = []
    for c, o, p, n in rows:
        label, number = p[1:-1].rsplit("_", 1)
        made.append((c, o, o.lower(), p, label, int(number), n, label != LABELS.get(c)))
    return spark.createDataFrame(made, REGISTRY)


def restored(mapping: DataFrame) -> DataFrame:
    """A registry from rows (category, original, placeholder, count) such as ``export`` gives; two entries for one original, one
    placeholder for two originals and malformed placeholders are refused."""
    rows = mapping.withColumn("original_lc", F.lower("original"))
    for column in ("original_lc", "placeholder"):
        twice = rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two entries for {twice[0][0]}")
    if bad := rows.where(~F.col("placeholder").rlike(PLACEHOLDER.pattern) | F.col("placeholder").isNull()).limit(1).collect():
        raise ValueError(f"not a placeholder: {bad[0].placeholder}")
    rows = rows.withColumns({"label": F.regexp_extract("placeholder", r"^\[(.*)_[0-9]+\]$", 1), "number": F.regexp_extract("placeholder", r"_([0-9]+)\]$", 1).cast("long")})
    return rows.select("category", "original", "original_lc", "placeholder", "label", "number", F.col("count").cast("long").alias("count"), F.coalesce(F.col("label") != _label("category"), F.lit(True)).alias("overridden"))


def apply_overrides(registry: DataFrame, retired: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with the placeholders of ``wanted`` (original, placeholder), and the rows that can't be carried out with
    their ``reason``: no entry, malformed, asked for twice, retired, or held by another entry that keeps it."""
    asked = wanted.select("original", "placeholder", F.lower("original").alias("k")).distinct()
    times = asked.groupBy("placeholder").agg(F.count("*").alias("n"))
    again = asked.groupBy("k").agg(F.count("*").alias("n_k"))
    held = registry.join(asked.select(F.col("k").alias("original_lc")), "original_lc", "left_anti").select("placeholder", F.lit(True).alias("held"))
    rows = asked.join(times, "placeholder").join(again, "k").join(registry.select(F.col("original_lc").alias("k"), F.lit(True).alias("known")), "k", "left")
    rows = rows.join(retired.select("placeholder", F.lit(True).alias("gone")).distinct(), "placeholder", "left").join(held, "placeholder", "left")
    reason = (
        F.when(F.col("known").isNull(), "no entry for this original").when(~F.col("placeholder").rlike(PLACEHOLDER.pattern), "not a placeholder").when((F.col("n") > 1) | (F.col("n_k") > 1), "asked for twice")
        .when(F.col("gone"), "the number is retired").when(F.col("held"), "another entry holds it")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason IS NULL").select(F.col("k").alias("original_lc"), F.col("placeholder").alias("_new"))
    new = {
        "placeholder": F.col("_new"), "label": F.regexp_extract("_new", r"^\[(.*)_[0-9]+\]$", 1), "number": F.regexp_extract("_new", r"_([0-9]+)\]$", 1).cast("long"), "overridden": F.lit(True),
    }
    joined = registry.join(good, "original_lc", "left")
    out = joined.select(*[F.when(F.col("_new").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in registry.columns])
    return out, rows.where("reason IS NOT NULL").select("original", "placeholder", "reason")


REMOVED = "category string, main_text string, spellings array<string>, placeholder string"


def remove_value(registry: DataFrame, retired: DataFrame, removed: DataFrame, values: DataFrame, main_text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Registry, retired, removed and values without a value: its entry is forgotten, and the value is kept among the removed."""
    low = main_text.strip().lower()
    mine = F.lower(F.trim("main_text")) == low
    held = values.where(mine).select("category", "main_text", "spellings", F.lower(F.trim("main_text")).alias("k"))
    gone = held.join(registry.select(F.col("original_lc").alias("k"), "placeholder"), "k", "left").select("category", "main_text", "spellings", "placeholder")
    book, numbers = forget(registry, retired, main_text.strip())
    return book, numbers, removed.unionByName(gone), values.where(~mine)


def restore_value(removed: DataFrame, main_text: str) -> tuple[DataFrame, DataFrame]:
    """(removed without the value, the value's rows). Its old entry does not come back: the next run numbers it anew."""
    mine = F.lower(F.trim("main_text")) == main_text.strip().lower()
    return removed.where(~mine), removed.where(mine).select("category", "main_text", "spellings")
