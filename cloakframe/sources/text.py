"""Plain text, markdown and CSV documents, and what is written back."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered

LARGE = 10 * 1024 * 1024
PREVIEW_LINES = 5000
FORMATS = ["txt", "md", "csv", "docx", "pptx", "xlsx"]
# What each format may be exported as.
EXPORTS = {
    "csv": ["csv", "md"], "xlsx": ["csv", "md", "xlsx"], "xlsx_json": ["md", "json", "xlsx"], "txt": ["txt", "md"],
    "docx": ["md", "txt", "docx"], "pptx": ["md", "txt", "pptx"], "pdf": ["md", "txt", "pdf"], "md": ["md", "txt"],
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_ord, name, format, raw, warnings`` of the files under a path, in the order of their paths; files of no known
    format are left out here and told by ``unread_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    known = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    warn = F.array_compact(F.array(F.when(F.length("content") == 0, F.lit("the file is empty")), F.when(F.length("content") > LARGE, F.lit("the file is large"))))
    rows = files.where(known.isin(FORMATS)).select("path", name.alias("name"), known.alias("format"), F.col("content").alias("raw"), warn.alias("warnings"))
    ranked = numbered(rows.select("path"), ["path"], "doc_ord")
    return rows.join(ranked, "path").select("doc_ord", "name", "format", "raw", "warnings")


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, error`` of the files under a path that ``read_files`` leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.where(~kind.isin(FORMATS)).select(name.alias("name"), F.concat(F.lit("unsupported format: "), kind).alias("error"))


def text_of(raw: str = "raw") -> Column:
    """UTF-8 text with line breaks as ``\\n``; null where the bytes are no UTF-8."""
    text = F.when(F.is_valid_utf8(F.col(raw).cast("string")), F.col(raw).cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")


def load_text(files: DataFrame) -> DataFrame:
    """``doc_ord, name, format, text, unit, unit_count, warnings, error`` of txt and md files; bytes that are no UTF-8 are an error."""
    rows = files.where(F.col("format").isin("txt", "md")).withColumn("text", text_of())
    error = F.when(F.col("text").isNull(), "the file is not UTF-8 text")
    return rows.select("doc_ord", "name", "format", "text", F.lit("line").alias("unit"), line_count(F.col("text")).alias("unit_count"), "warnings", error.alias("error"))


def line_count(text: Column) -> Column:
    """Lines: breaks, and one for an unended last line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))


def preview(text: Column) -> Column:
    """The first PREVIEW_LINES lines and whether there are more."""
    lines = F.split(text, "\n")
    return F.struct(F.array_join(F.slice(lines, 1, PREVIEW_LINES), "\n").alias("text"), (F.size(lines) > PREVIEW_LINES).alias("truncated"))


def parse_csv(raw: str) -> tuple[list[list[str]], bool]:
    """Rows padded to the widest, and whether any was shorter."""
    rows = [r for r in csv.reader(io.StringIO(raw), strict=True) if r]
    if not rows:
        raise ValueError("the CSV has no rows")
    width = max(map(len, rows))
    return [r + [""] * (width - len(r)) for r in rows], any(len(r) < width for r in rows)


def load_csv(files: DataFrame) -> DataFrame:
    """``doc_ord, name, grid, warnings, error`` of CSV files, whole files at a time, so quoted breaks and row order hold."""
    rows = files.where(F.col("format") == "csv").select("doc_ord", "name", F.col("raw").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids, warnings, errors = [], [], []
            for t in batch.column("t").to_pylist():
                try:
                    grid, ragged = parse_csv(t.lstrip("\ufeff"))
                    grids.append(grid)
                    warnings.append(["some rows are shorter than others"] if ragged else [])
                    errors.append(None)
                except (ValueError, csv.Error) as error:
                    grids.append(None)
                    warnings.append([])
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ord"), batch.column("name"), pa.array(grids, pa.list_(pa.list_(pa.string()))), pa.array(warnings, pa.list_(pa.string())), pa.array(errors, pa.string())],
                ["doc_ord", "name", "grid", "warnings", "error"],
            )

    kind = T.ArrayType(T.ArrayType(T.StringType()))
    fields = [T.StructField("doc_ord", T.LongType()), T.StructField("name", T.StringType()), T.StructField("grid", kind), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))


def grid_to_markdown(grid: Column) -> Column:
    """A markdown table: the first row, a rule, the others; bars escaped, line breaks as spaces. Empty for no rows."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), "\r?\n", " ")
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(" "), cell(c), F.lit(" |"))), ""))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(grid, 1))))
    lines = F.concat(F.transform(F.slice(grid, 1, 1), line), F.array(rule), F.transform(F.slice(grid, 2, 1_000_000_000), line))
    return F.when(F.size(grid) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def grid_to_csv(grid: list[list[str]]) -> str:
    """Minimal quoting, ``\\n`` line ends."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(grid)
    return out.getvalue()


def export_name(name: Column, ext: str) -> Column:
    """``report.v2.docx`` -> ``report.v2_anon.md``: one suffix of 1 to 4 letters or digits goes, ``#`` becomes ``_``."""
    return F.concat(F.regexp_replace(F.replace(name, F.lit("#"), F.lit("_")), r"(?<=.)\.[A-Za-z0-9]{1,4}$", ""), F.lit(f"_anon.{ext}"))
