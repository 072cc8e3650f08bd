"""Previews, conflicts and reports: aggregations and self-joins over spans, values and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .allowlist import Allowlist
from .values import spelling_rows


def preview_matches(spans: DataFrame) -> DataFrame:
    """``category, original, matches, documents, confidence`` of pattern spans, one row for each matched text."""
    return spans.groupBy("category", "original").agg(F.count("*").alias("matches"), F.countDistinct("doc_ord").alias("documents"), F.min("confidence").alias("confidence"))


def duplicate_values(values: DataFrame) -> DataFrame:
    """``main_text, category, other``: a main text listed again under another category than the time before."""
    w = Window.partitionBy(F.lower(F.trim("main_text"))).orderBy("value_ord")
    return values.withColumn("other", F.lag("category").over(w)).where("other <> category").select("value_ord", "main_text", "category", "other")


def spelling_collisions(values: DataFrame) -> DataFrame:
    """``spelling, main_text, other``: a spelling of two main texts."""
    rows = spelling_rows(values).withColumn("k", F.lower("spelling"))
    w = Window.partitionBy("k").orderBy("value_ord")
    hit = rows.withColumn("other", F.lag("main_text").over(w)).where("lower(other) <> lower(main_text)")
    return hit.select("value_ord", "spelling", "main_text", "other")


def allowlist_collisions(values: DataFrame, allow: Allowlist) -> DataFrame:
    """``value_ord, category, main_text``: values that the never-anonymise list holds back; the way out is to drop the term."""
    return values.where(allow.matches("main_text")).select("value_ord", "category", "main_text", F.lit("drop_allow_term").alias("resolution"))


def validate(values: DataFrame, allow: Allowlist) -> DataFrame:
    """``kind, severity, value, other``: all blocking conflicts."""
    def row(df, kind, value, other):
        return df.select(F.lit(kind).alias("kind"), F.lit("block").alias("severity"), F.col(value).alias("value"), other.alias("other"))
    return row(duplicate_values(values), "ambiguity", "main_text", F.col("other")).unionByName(row(spelling_collisions(values), "collision", "spelling", F.col("other"))).unionByName(row(allowlist_collisions(values, allow), "collision", "main_text", F.col("resolution")))


def unrecognised(values: DataFrame, categories: list[str]) -> DataFrame:
    """Values of a category that doesn't exist."""
    return values.where(~F.col("category").isin(categories)).select("value_ord", "category", "main_text")


def overlap_warnings(resolved: DataFrame, limit: int = 50) -> DataFrame:
    """A report of ``limit`` rows: (category, original) of spans that lost to a stronger one."""
    return resolved.where("NOT kept").select("category", "original").distinct().orderBy("category", "original").limit(limit)


def intersections(value_spans: DataFrame, stronger: DataFrame) -> DataFrame:
    """``category, main_text, occurrences, winners, documents``: values all of whose occurrences lie under stronger spans, with
    three of the strings that cover them and three of the documents at most, the most frequent value first.

    Spans meet by region, and within it by overlap; a value with one free occurrence is left out.
    """
    by_value = ["category", "main_text"]
    loser = value_spans.withColumn("_id", F.struct("doc_ord", "region_ord", "start", "end"))
    keys = ["doc_ord", "region_ord"]
    win = stronger.select(*keys, F.col("start").alias("ws"), F.col("end").alias("we"), F.col("original").alias("wo"), F.col("rank").alias("wr"))
    hit = loser.join(win, keys).where("start < we AND ws < end AND wr < rank")

    def first(column: str, name: str) -> DataFrame:
        few = hit.select(*by_value, column).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*by_value).orderBy(column))).where("_r <= 3")
        return few.groupBy(*by_value).agg(F.array_sort(F.collect_list(column)).alias(name))

    covered = hit.groupBy(*by_value).agg(F.countDistinct("_id").alias("covered"))
    total = loser.groupBy(*by_value).agg(F.countDistinct("_id").alias("occurrences"))
    whole = total.join(covered, by_value).where("covered = occurrences")
    rows = whole.join(first("wo", "winners"), by_value).join(first("doc_ord", "documents"), by_value)
    return rows.select(*by_value, "occurrences", "winners", "documents").orderBy(F.desc("occurrences"), "category", "main_text")


def counts_by_document(spliced: DataFrame) -> DataFrame:
    """``doc_ord, category, replaced`` with subtotals (null document, null category)."""
    rows = spliced.select("doc_ord", F.explode("by_category").alias("category", "n"))
    return rows.rollup("doc_ord", "category").agg(F.sum("n").cast("long").alias("replaced"))


def value_report(outputs: DataFrame, registry: DataFrame, column: str = "anonymised") -> DataFrame:
    """``original, placeholder, category, replaced``: placeholders counted in the finished texts; entries without any are left out."""
    found = outputs.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(\[[A-Z][A-Z0-9_]*_[0-9]+\])"), 1)).alias("placeholder")).groupBy("placeholder").agg(F.count("*").alias("replaced"))
    return registry.join(found, "placeholder").select("original", "placeholder", "category", "replaced")


def detected_categories(spliced: DataFrame) -> DataFrame:
    """``category``: those with a replacement somewhere."""
    return spliced.select(F.explode("by_category").alias("category", "n")).where("n > 0").select("category").distinct()
