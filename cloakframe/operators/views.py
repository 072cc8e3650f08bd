"""What a reviewer looks at: filtered suggestions, search hits, where values stand in a text, placeholders with their originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import placed
from .rewrite import PLACEHOLDER

MAX_HITS, MIN_NEEDLE = 2000, 2
_ESCAPE = "'([^A-Za-z0-9 ])', '\\\\\\\\$1'"


def visible_suggestions(rows: DataFrame, category: str = "", method: str = "", search: str = "", sort: str = "count-desc") -> DataFrame:
    """Suggestions (main_text, category, count, methods) that pass the filters, in one of four stable orders."""
    if category:
        rows = rows.where(F.col("category") == category)
    if method:
        rows = rows.where(F.array_contains("methods", method))
    if search.strip():
        rows = rows.where(F.contains(F.lower("main_text"), F.lit(search.strip().lower())))
    orders = {"count-desc": [F.desc("count"), F.asc("main_text")], "count-asc": [F.asc("count"), F.asc("main_text")], "value-asc": [F.asc("main_text")], "value-desc": [F.desc("main_text")]}
    return rows.orderBy(*orders.get(sort, orders["count-desc"]))


def find_hits(text: str, needle: str, most: int | None = MAX_HITS) -> Column:
    """Places (s, e) of a needle in column ``text``, without case, left to right and disjoint. A pane shows the first ``most`` of
    them beside ``count_hits``; null means all."""
    pin = needle.strip()
    if len(pin) < MIN_NEEDLE:
        return F.expr("CAST(array() AS array<struct<s: int, e: int>>)")
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in pin)
    pattern = "'" + ("(?iu)" + escaped).replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    places = placed(text, pattern, found)
    return F.expr(f"transform({places if most is None else f'slice({places}, 1, {most})'}, x -> struct(x.s AS s, x.e AS e))")


def count_hits(text: str, needle: str) -> Column:
    """How many places ``find_hits`` has, all of them."""
    pin = needle.strip()
    if len(pin) < MIN_NEEDLE:
        return F.lit(0)
    return F.regexp_count(F.col(text), F.lit("(?iu)" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in pin)))


def value_places(regions: DataFrame, registry: DataFrame) -> DataFrame:
    """``doc_ord, region_ord, start, end, placeholder``: where originals stand in source texts. The longest claim holds, then
    the earliest, then by placeholder, each disjoint from all before it."""
    from .patterns import finished
    from .resolve import resolve_overlaps
    from .values import VALUES, detect_values

    spark = regions.sparkSession
    known = registry.select(F.lit(0).cast("long").alias("value_ord"), F.lit("other_names").alias("category"), F.col("original").alias("main_text"), F.array().cast("array<string>").alias("spellings"), F.lit(True).alias("curated"), F.array().cast("array<string>").alias("methods"), F.lit(None).cast("double").alias("confidence"))
    spans = detect_values(regions, spark.createDataFrame([], VALUES).unionByName(known))
    # length decides: equal scores leave it to the bytes; characters and bytes agree within one text's claims closely enough to rank
    kept = resolve_overlaps(finished(spans.withColumn("confidence", F.lit(1.0)))).where("kept")
    return kept.join(registry.select(F.col("original_lc").alias("owner_key"), "placeholder"), "owner_key").select("doc_ord", "region_ord", "start", "end", "placeholder")


def highlighted(outputs: DataFrame, registry: DataFrame, column: str = "anonymised") -> DataFrame:
    """``doc_ord, region_ord, at, placeholder, nth, original``: placeholders of finished texts in order, each with the number
    of its occurrence and the original it stands for (null if none is known)."""
    text = f"coalesce({column}, '')"
    pattern = "'" + PLACEHOLDER.replace("\\", "\\\\") + "'"
    rows = outputs.select("doc_ord", "region_ord", F.explode(F.expr(placed(text, pattern, f"regexp_extract_all({text}, {pattern}, 0)"))).alias("x"))
    nth = F.row_number().over(Window.partitionBy("doc_ord", "region_ord", "x.t").orderBy("x.s"))
    rows = rows.select("doc_ord", "region_ord", F.col("x.s").alias("at"), F.col("x.t").alias("placeholder"), nth.alias("nth"))
    return rows.join(registry.select("placeholder", "original"), "placeholder", "left").select("doc_ord", "region_ord", "at", "placeholder", "nth", "original")
