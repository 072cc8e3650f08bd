"""Sessions, reports and archives: small files written from finished results on the driver."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import REGISTRY, RETIRED
from .text import EXPORTS, grid_to_csv

VERSION = 1


def save(path: str, registry: DataFrame, retired: DataFrame, settings: dict) -> None:
    """A folder: the registry and retired placeholders as Parquet, settings as JSON with the version."""
    registry.write.mode("overwrite").parquet(f"{path}/registry")
    retired.write.mode("overwrite").parquet(f"{path}/retired")
    spark = registry.sparkSession
    spark.createDataFrame([(json.dumps({"version": VERSION, "settings": settings}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/session")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """What ``save`` wrote; another version is refused."""
    head = json.loads(spark.read.text(f"{path}/session").first().value)
    if head.get("version") != VERSION:
        raise ValueError(f"session version {head.get('version')}, not {VERSION}")
    return spark.read.schema(REGISTRY).parquet(f"{path}/registry"), spark.read.schema(RETIRED).parquet(f"{path}/retired"), head["settings"]


def export_bytes(kind: str, ext: str, text: str, grid: list[list[str]] | None = None, body: str | None = None) -> bytes:
    """A result as md, txt, csv or json; formats that the document's own format doesn't offer are refused."""
    if ext in ("docx", "pptx", "xlsx", "pdf"):
        raise ValueError(f".{ext} is a same-format export")
    if ext not in EXPORTS.get(kind, EXPORTS["md"]):
        raise ValueError(f"{kind} documents cannot be exported as .{ext}")
    if ext == "csv":
        return grid_to_csv(grid or []).encode()
    return ((body or "") if ext == "json" else text).encode()


def write_mapping(registry_export: DataFrame, path: str) -> None:
    registry_export.write.mode("overwrite").option("header", "true").csv(path)


def build_zip(files: Iterable[tuple[str, bytes]]) -> bytes:
    """An archive; a name that comes again gets a number."""
    out, used = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            stem, dot, ext = name.rpartition(".")
            free = next(n for n in (name, *(f"{stem}_{i}{dot}{ext}" for i in range(2, 1_000_000))) if n not in used)
            used.add(free)
            z.writestr(free, data)
    return out.getvalue()


def report_json(by_document: list[tuple], values: list[tuple]) -> str:
    """Counts by (document, category) and rows of (original, placeholder, category, count) as one JSON document."""
    documents: dict = {}
    for name, category, n in by_document:
        documents.setdefault(name, {})[category] = n
    rows = [dict(zip(("original", "placeholder", "category", "count"), v, strict=True)) for v in sorted(values, key=lambda v: (-v[3], v[1]))]
    return json.dumps({"documents": documents, "values": rows}, ensure_ascii=False, indent=2)


def report_markdown(by_document: list[tuple], values: list[tuple]) -> str:
    lines = ["# Report", "", "| document | category | replaced |", "| --- | --- | --- |"]
    lines += [f"| {d} | {c} | {n} |" for d, c, n in by_document]
    lines += ["", "| placeholder | category | count |", "| --- | --- | --- |"]
    return "\n".join([*lines, *(f"| {p} | {c} | {n} |" for _, p, c, n in sorted(values, key=lambda v: (-v[3], v[1])))]) + "\n"
