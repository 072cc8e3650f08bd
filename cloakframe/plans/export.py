"""Copies in the format of the source: Office packages with their texts, comments and properties rewritten.

The paragraphs, cells and properties of every package are regions like any other: the ordinary detectors run over them, with
the registry's originals beside them, and only the replacements go back to the packages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry as book
from ..operators import resolve, values
from ..operators.graph import cut
from ..sources import office
from . import anonymise

BLOCKS = "doc_ord long, region_ord long, part string, block int, text string"


@dataclass
class Exported:
    """``files``: doc_ord, name, raw, replaced. ``registry``: with what the export numbered anew. ``blocks``: the texts rewritten."""

    files: DataFrame
    registry: DataFrame
    blocks: DataFrame


def blocks_of(files: DataFrame) -> DataFrame:
    """BLOCKS of Office files (doc_ord, raw): every text that may be rewritten, in the order of the package. A file that can't be
    read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column("doc_ord").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                rows = office.readable_blocks(raw)
                columns = [[doc] * len(rows), list(range(len(rows))), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["doc_ord", "region_ord", "part", "block", "text"])

    return files.select("doc_ord", "raw").mapInArrow(run, BLOCKS)


def replacements(regions: DataFrame, config: anonymise.Config, entries: DataFrame, retired: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_ord, region_ord, start, end, placeholder, category) for single texts, and the registry after them.

    As in a run, but each text stands for itself: no owner is settled over the batch, failed checksums count, and the
    registry's originals are looked for in the same pass.
    """
    config = replace(config, require_checksum=False)
    spans = anonymise.detect(regions, config, known).unionByName(values.detect_known(regions, entries, config.allow))
    kept = cut(resolve.resolve_overlaps(spans)).where("kept")
    named = cut(book.assign(kept, entries, retired))
    rows = kept.join(named.select(F.col("original_lc").alias("owner_key"), "placeholder"), "owner_key")
    return rows.select("doc_ord", "region_ord", "start", "end", "placeholder", "category"), named


def same_format(files: DataFrame, config: anonymise.Config, entries: DataFrame, retired: DataFrame, known: DataFrame | None = None) -> Exported:
    """Office files (doc_ord, name, raw) rewritten: body, headers, footers, notes, comments, cells without a formula, and
    document properties. All other parts keep their bytes; a file that can't be read comes back as null."""
    blocks = cut(blocks_of(files))
    found, named = replacements(blocks.select("doc_ord", "region_ord", "text"), config, entries, retired, known)
    item = F.struct("part", "block", "start", "end", "placeholder")
    by_file = found.join(blocks.select("doc_ord", "region_ord", "part", "block"), ["doc_ord", "region_ord"]).groupBy("doc_ord").agg(F.array_sort(F.collect_list(item)).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, own = batch.column("raw")[i].as_py(), {}
                for x in batch.column("r")[i].as_py() or []:
                    own.setdefault((x["part"], x["block"]), []).append((x["start"], x["end"], x["placeholder"]))
                done = office.rewritten(raw, own)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ord").slice(i, 1), batch.column("name").slice(i, 1), pa.array([done], pa.binary()), pa.array([sum(map(len, own.values()))], pa.int64())], ["doc_ord", "name", "raw", "replaced"])

    wanted = files.select("doc_ord", "name", "raw").join(by_file, "doc_ord", "left")
    return Exported(wanted.mapInArrow(run, "doc_ord long, name string, raw binary, replaced long"), named, blocks)


def property_proposals(files: DataFrame, config: anonymise.Config, entries: DataFrame, retired: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_ord, part, block, value, proposed, changed``: what would become of every document property, for review."""
    fields = blocks_of(files).where("part LIKE 'docProps/%'")
    found, _ = replacements(fields.select("doc_ord", "region_ord", "text"), config, entries, retired, known)
    spans = found.groupBy("doc_ord", "region_ord").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("s"))
    # a property is a short text, so counting characters from its start is cheap
    pieces = "concat(array_join(transform(s, (x, i) -> concat(substring(text, CASE WHEN i = 0 THEN 1 ELSE s[i - 1].end + 1 END, x.start - CASE WHEN i = 0 THEN 0 ELSE s[i - 1].end END), x.placeholder)), ''), substring(text, element_at(s, -1).end + 1))"
    rows = fields.join(spans, ["doc_ord", "region_ord"], "left")
    return rows.select("doc_ord", "part", "block", F.col("text").alias("value"), F.expr(f"CASE WHEN s IS NULL THEN text ELSE {pieces} END").alias("proposed"), F.col("s").isNotNull().alias("changed"))
