"""Writing placeholders into text: the splice of a run, and the registry's second pass."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionary import Dictionary, look_up, slices

PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*_[0-9]+\]"
_PLACEHOLDER = re.compile(PLACEHOLDER)


def splice(regions: DataFrame, kept: DataFrame, registry: DataFrame) -> DataFrame:
    """``regions`` with ``anonymised`` and ``by_category`` (MAP): kept, disjoint spans replaced in one forward pass."""
    named = kept.join(registry.select(F.col("original_lc").alias("owner_key"), "placeholder"), "owner_key")
    spans = named.groupBy("doc_ord", "region_ord").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder", "category"))).alias("_s"))
    counts = "map_from_entries(transform(array_distinct(transform(_s, x -> x.category)), c -> struct(c, size(filter(_s, x -> x.category = c)))))"
    joined = regions.join(spans, ["doc_ord", "region_ord"], "left").withColumn("by_category", F.expr(f"CASE WHEN _s IS NULL THEN CAST(map() AS map<string, int>) ELSE {counts} END"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                lists = batch.column("_s")
                parts = lists.flatten()
                starts, ends, written = (parts.field(c).to_pylist() for c in ("start", "end", "placeholder"))
                edges = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).tolist()
                done = []
                for text, a, b in zip(batch.column("text").to_pylist(), edges, edges[1:], strict=False):
                    pieces, last = [], 0
                    for i in range(a, b):
                        pieces += (text[last : starts[i]], written[i])
                        last = ends[i]
                    done.append(text if a == b else "".join([*pieces, text[last:]]))
                names = [c for c in batch.schema.names if c not in ("_s", "by_category")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(done, pa.string()), batch.column("by_category")], [*names, "anonymised", "by_category"])

    fields = [f for f in joined.schema.fields if f.name not in ("_s", "by_category")]
    return joined.mapInArrow(run, T.StructType([*fields, T.StructField("anonymised", T.StringType()), joined.schema["by_category"]]))


def occurrence_spellings(kept: DataFrame, registry: DataFrame, pruned: bool = True) -> DataFrame:
    """``doc_ord, placeholder, spellings``: how each occurrence of a value is spelled in a document, in order, empty where that
    is its main text; with ``pruned`` only values that are spelled otherwise somewhere."""
    named = kept.join(registry.select(F.col("original_lc").alias("owner_key"), "placeholder", F.col("original").alias("_main")), "owner_key")
    own = F.when(F.col("original") == F.col("_main"), "").otherwise(F.col("original"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("region_ord", "start", own.alias("own")))), lambda x: x["own"])
    rows = named.groupBy("doc_ord", "placeholder").agg(listed.alias("spellings"))
    return rows.where(F.exists("spellings", lambda x: x != "")) if pruned else rows


def replace_known(text: str, book: Dictionary, table: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """``text`` with every term of ``book`` that stands in it written over, in the dictionary's order, by its (placeholder,
    category), and a category for each hit.

    An original counts between characters that are no letters or digits, without case, and never inside a placeholder. Each
    term sees the text that the one before left, so only terms found at the start are gone through, longest first.
    """
    hits: list[str] = []
    for i in sorted({i for _, _, i in book.find(text)}):
        placeholder, category = table[i]
        shielded = [m.span() for m in _PLACEHOLDER.finditer(text)]
        begins = [a for a, _ in shielded]
        out, last = [], 0
        for s, e in book.places(i, text):
            at = bisect_left(begins, e)
            if not at or shielded[at - 1][1] <= s:
                out += [text[last:s], placeholder]
                last = e
                hits.append(category)
        text = "".join([*out, text[last:]])
    return text, hits


def _entries(registry: DataFrame) -> DataFrame:
    """Entries as the second pass takes them: longest (bytes) first, then as they are exported."""
    order = F.struct((-F.octet_length("original")).alias("n"), F.col("category").alias("c"), F.length("placeholder").alias("l"), F.col("placeholder").alias("p"))
    rows = registry.where("length(original) > 0").select(F.format_string("%012d", 1_000_000_000 + order["n"]).alias("_order"), "category", F.format_string("%06d", order["l"]).alias("_l"), "placeholder", "original")
    return rows.orderBy("_order", "category", "_l", "placeholder")


def post_pass(regions: DataFrame, registry: DataFrame, column: str = "anonymised", broadcast: bool | None = None) -> DataFrame:
    """``regions`` with ``column`` rewritten by every registry entry that occurs in it, longest first (bytes), and ``post_hits``."""

    def use(batch: pa.RecordBatch, held) -> Iterator[pa.RecordBatch]:
        new, hits, last, table = [], [], None, []
        for r, text in enumerate(batch.column(column).to_pylist()):
            if text is None:
                new.append(None)
                hits.append([])
                continue
            book, entries = held(r)
            if entries is not last:
                last, table = entries, list(zip(entries.column("placeholder").to_pylist(), entries.column("category").to_pylist(), strict=True))
            text, got = replace_known(text, book, table)
            new.append(text)
            hits.append(got)
        columns = [pa.array(new, pa.string()) if c == column else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pa.string()))], [*batch.schema.names, "post_hits"])

    schema = T.StructType([*regions.schema.fields, T.StructField("post_hits", T.ArrayType(T.StringType()))])
    return look_up(regions, ["doc_ord", "region_ord"], column, _entries(registry), "original", use, schema, broadcast, carry=True)


def leaks(outputs: DataFrame, registry: DataFrame, column: str = "anonymised", broadcast: bool | None = None) -> DataFrame:
    """``doc_ord, original`` for every original that still stands in an output as a word: none, if all went well."""

    def use(batch: pa.RecordBatch, held) -> Iterator[pa.RecordBatch]:
        rows, found = [], []
        for r, text in enumerate(batch.column("_x").to_pylist()):
            book, _ = held(r)
            own = {book.terms[i] for _, _, i in book.find(text or "")}
            rows += [r] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([batch.column("doc_ord").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["doc_ord", "original"])

    bare = outputs.select("doc_ord", F.regexp_replace(column, PLACEHOLDER, "\n").alias("_x"))
    return look_up(bare, ["doc_ord"], "_x", registry.where("length(original) > 0").select("original"), "original", use, "doc_ord long, original string", broadcast).distinct()
