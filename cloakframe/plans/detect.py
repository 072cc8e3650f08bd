"""Finding suggestions over a batch: rules and signals, then a model if there is one, merged and folded twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, diagnose, discover, heuristics, patterns
from ..operators.allowlist import composed, discover_defined_terms, filter_allowed
from ..operators.graph import cut
from ..operators.numbering import numbered
from .anonymise import Config, text_regions
from .presets import VALUE_CATEGORIES


@dataclass
class Detection:
    suggestions: DataFrame
    preview: DataFrame
    defined_terms: DataFrame


#: Which signals lead to which names; a missing key means on, an unknown one means nothing.
SOURCES = {"email": {"person": True, "organisation": True}, "website": {"organisation": True}}


def enabled(sources: dict[str, dict[str, bool]] | None, source: str, derivation: str) -> bool:
    default = SOURCES.get(source, {}).get(derivation, False)
    return bool((sources or {}).get(source, {}).get(derivation, default)) and derivation in SOURCES.get(source, {})


_NO_EVIDENCE = f"CAST(array() AS {discover.EVIDENCE})"


def from_signals(documents: DataFrame, sources: dict[str, dict[str, bool]] | None = None, allow: Allowlist | None = None) -> DataFrame:
    """FOUND rows: names that e-mail and web addresses lead to and that stand in the running text."""
    wanted = [
        ("email", "person", discover.email_person_seeds, discover.EMAIL),
        ("email", "organisation", discover.email_organisation_seeds, discover.EMAIL),
        ("website", "organisation", discover.website_seeds, discover.WEBSITE),
    ]
    by_pattern: dict[str, DataFrame] = {}  # the texts are read once for all seeds of a pattern
    for s, d, seeds, pattern in wanted:
        if enabled(sources, s, d):
            found = cut(seeds(documents))
            by_pattern[pattern] = by_pattern[pattern].unionByName(found) if pattern in by_pattern else found
    parts = [discover.find_seeds(documents, found, pattern, allow) for pattern, found in by_pattern.items()]
    if not parts:
        none = discover.email_person_seeds(documents).limit(0)
        parts = [discover.find_seeds(documents, none, discover.EMAIL, broadcast=True)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _found(rows.withColumn("confidence", F.lit(discover.DERIVED)), 2, "signal")


#: Suggestions before they are merged; ``ord`` is the order in which they are found: route, document, place.
FOUND = ["ord", "main_text", "category", "spellings", "count", "confidence", "methods", "contexts", "evidence"]


def _found(rows: DataFrame, route: int, method: str) -> DataFrame:
    have = set(rows.columns)
    empty = {"spellings": "CAST(array() AS array<string>)", "contexts": "CAST(array() AS array<string>)", "evidence": _NO_EVIDENCE, "doc_ord": "CAST(0 AS bigint)", "first": "0"}
    rows = rows.withColumns({c: F.expr(e) for c, e in empty.items() if c not in have}).withColumn("methods", F.array(F.lit(method)))
    order = F.struct(F.lit(route).alias("route"), F.col("doc_ord").cast("long").alias("doc_ord"), F.col("first").cast("int").alias("first"), F.col("main_text").alias("text"))
    return rows.withColumn("ord", order).select(*FOUND)


def classify(suggestions: DataFrame, names: Callable[[list[str]], dict[str, str]], size: int = 50) -> DataFrame:
    """``suggestions`` re-filed by a model that maps batches of names to categories; names and categories it invents are dropped."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), size):
                part = texts[i : i + size]
                got = {k: v for k, v in names(part).items() if k in part and v in VALUE_CATEGORIES}
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.string())], ["main_text", "_new"])

    asked = suggestions.select("main_text").distinct().mapInArrow(run, "main_text string, _new string")
    return suggestions.join(asked, "main_text", "left").withColumn("category", F.coalesce("_new", "category")).drop("_new").select(*suggestions.columns)


def detect(documents: DataFrame, config: Config | None = None, options: heuristics.Options | None = None, sources: dict | None = None, model: Callable[[str], str] | None = None, refine: Callable[[list[str]], dict[str, str]] | None = None, suppress_defined: bool = True) -> Detection:
    """Suggestions for ``documents`` (doc_ord, name, text). Nothing is replaced: a reviewer accepts them first.

    Terms that the documents define as their own vocabulary are no suggestions: they are taken away by a join, so there may be
    any number of them. Of a main text's spellings the one found first stays: in the names and codes of the documents in their
    order, then among signals, then in what the model says.
    """
    config = config or Config()
    terms = cut(discover_defined_terms(documents))
    allow = config.allow
    regions = text_regions(documents)
    preview = diagnose.preview_matches(patterns.scan_patterns(regions, config.selection, config.country))
    names = _found(heuristics.discover_names(documents, allow, options, config.country), 0, "heuristic")
    codes = _found(discover.detect_codes(regions, allow), 1, "heuristic")
    found = names.unionByName(codes).unionByName(from_signals(documents, sources, allow))
    if model is not None:
        told = chunks.model_suggestions(chunks.scan_chunks(chunks.units_of(documents)), model, VALUE_CATEGORIES)
        told = told.groupBy("main_text", "category").agg(F.sum("count").alias("count"), F.max("confidence").alias("confidence"))
        found = found.unionByName(_found(told, 3, "local_llm"))
    if suppress_defined:
        found = filter_allowed(found, composed([], defined=terms), "main_text")
    found = cut(filter_allowed(found, allow, "main_text"))  # the texts are read once, though merging reads its rows twice
    folded = discover.fold_families(_numbered(discover.merge_suggestions(found)), allow)
    if refine is not None:
        again = classify(cut(folded), refine)
        folded = discover.fold_families(_numbered(discover.merge_suggestions(again)), allow)
    return Detection(folded, preview, terms)


def _numbered(merged: DataFrame) -> DataFrame:
    """Suggestions with ``ord`` as a number in the same order."""
    return cut(numbered(merged.withColumnRenamed("ord", "_ord"), ["_ord"], "ord").drop("_ord"))
