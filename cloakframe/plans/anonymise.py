"""A whole run: detect over every region, settle owners over the batch, number, replace, apply the registry again."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnose, patterns, registry, resolve, rewrite, values
from ..operators.allowlist import Allowlist, filter_allowed
from ..operators.graph import cut
from .presets import DEFAULT_COUNTRY, VALUE_CATEGORIES, default_selection


@dataclass
class Config:
    selection: dict[str, bool] = field(default_factory=default_selection)
    country: str = DEFAULT_COUNTRY
    allow: Allowlist = field(default_factory=Allowlist)
    custom: list[str] = field(default_factory=list)
    require_checksum: bool = False
    suppress_patterns: bool = False
    #: Under this name a run shows its progress and can be cancelled (plans/control.py).
    name: str = ""


@dataclass
class Result:
    """``documents``: regions with anonymised, by_category, post_hits. ``spans``: resolved, with ``kept``."""

    documents: DataFrame
    registry: DataFrame
    spans: DataFrame
    unified: DataFrame


class Blocked(ValueError):
    """Conflicts that stop a run before the registry changes."""


def text_regions(documents: DataFrame) -> DataFrame:
    """Each document (doc_ord, text) as one region."""
    return documents.select("doc_ord", F.lit(0).cast("long").alias("region_ord"), "text")


def grid_regions(documents: DataFrame, width: int | None = None) -> DataFrame:
    """Each cell of ``grid`` as a region, row by row: region_ord, row, col, text."""
    rows = documents.select("doc_ord", F.expr("aggregate(grid, 0, (m, r) -> greatest(m, size(r)))").alias("_w"), F.posexplode("grid").alias("row", "_r"))
    return rows.select("doc_ord", "row", "_w", F.posexplode("_r").alias("col", "text")).select("doc_ord", (F.col("row") * F.col("_w") + F.col("col")).cast("long").alias("region_ord"), "row", "col", "text")


def regions_of(documents: DataFrame) -> DataFrame:
    """Regions (doc_ord, region_ord, row, col, region, text) of documents (doc_ord, format, text, grid): the cells of a table row
    by row, the JSON of a sheet that is no table, else the whole text."""
    cells = grid_regions(documents.where("grid IS NOT NULL")).withColumn("region", F.format_string("row %d col %d", "row", "col"))
    tag = F.when(F.col("format") == "xlsx", "json").otherwise("") if "format" in documents.columns else F.lit("")
    texts = documents.where("grid IS NULL").select("doc_ord", F.lit(0).cast("long").alias("region_ord"), F.lit(-1).alias("row"), F.lit(-1).alias("col"), tag.alias("region"), "text")
    return cells.select(*texts.columns).unionByName(texts)


def written_back(done: DataFrame) -> DataFrame:
    """``doc_ord, anonymised, grid, json``: finished regions as documents again: tables as grids and markdown, JSON in its fence."""
    from ..sources.text import grid_to_markdown

    line = F.transform(F.array_sort(F.collect_list(F.struct("col", "anonymised"))), lambda x: x["anonymised"])
    rows = done.where("row >= 0").groupBy("doc_ord", "row").agg(line.alias("cells"))
    grids = rows.groupBy("doc_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("grid"))
    tables = grids.select("doc_ord", grid_to_markdown(F.col("grid")).alias("anonymised"), "grid", F.lit(None).cast("string").alias("json"))
    fenced = F.when(F.col("region") == "json", F.concat(F.lit("```json\n"), "anonymised", F.lit("\n```\n"))).otherwise(F.col("anonymised"))
    texts = done.where("row < 0").select("doc_ord", fenced.alias("anonymised"), F.lit(None).cast("array<array<string>>").alias("grid"), F.when(F.col("region") == "json", F.col("anonymised")).alias("json"))
    return tables.unionByName(texts)


def detect(regions: DataFrame, config: Config, known: DataFrame | None = None) -> DataFrame:
    """All spans before ownership: patterns, known values, the user's own patterns."""
    spans = patterns.scan_patterns(regions, {} if config.suppress_patterns else config.selection, config.country)
    spans = filter_allowed(spans, config.allow)
    if config.require_checksum:
        spans = resolve.reject_failed_checksums(spans)
    if known is not None:
        on = [c for c in VALUE_CATEGORIES if config.selection.get(c)]
        spans = spans.unionByName(values.detect_values(regions, known.where(F.col("category").isin(on)), config.allow))
    if config.custom and config.selection.get("custom_patterns"):
        spans = spans.unionByName(filter_allowed(patterns.scan_custom(regions, config.custom), config.allow))
    return spans


def anonymise(regions: DataFrame, config: Config | None = None, known: DataFrame | None = None, entries: DataFrame | None = None, retired: DataFrame | None = None) -> Result:
    """One run over ``regions`` (doc_ord, region_ord, text); blocking conflicts among ``known`` values stop it."""
    config = config or Config()
    spark = regions.sparkSession
    if config.name:
        spark.sparkContext.setJobGroup(config.name, "anonymise", interruptOnCancel=True)
    if known is not None and (found := diagnose.validate(known, config.allow).limit(5).collect()):
        raise Blocked("; ".join(f"{r.kind} {r.value} / {r.other}" for r in found))
    # the texts are read once for all detectors; what follows works on spans, dealt by region from ownership on
    unified = resolve.unify_ownership(cut(detect(regions, config, known)))
    resolved = cut(resolve.resolve_overlaps(unified))
    kept = resolved.where("kept")
    book = cut(registry.assign(kept, entries if entries is not None else registry.empty(spark), retired if retired is not None else registry.no_retired(spark)))
    done = rewrite.post_pass(rewrite.splice(regions, kept, book), book)
    return Result(done, book, resolved, resolved.drop("kept"))
