"""Packing a document's units (pages, slides, lines) into pieces for a model, and reading model replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_BYTES = {"thorough": 1200, "faster": 4000}
OVERLAP_BYTES = 512
#: Characters of chunks that are sent back together.
SENT = 4_000_000
CHUNK = "doc_ord long, chunk_ord int, from_unit int, to_unit int, text string"


def split_oversized(text: str, most: int, overlap: int = OVERLAP_BYTES) -> list[str]:
    """Pieces of at most ``most`` UTF-8 bytes: each ends behind the last blank line, line break or space of its second
    half (else at a character), and the next one repeats the last ``overlap`` bytes (a quarter of ``most`` if that is less)."""
    data = text.encode()
    if most <= 0 or len(data) <= most:
        return [text]
    overlap = overlap if overlap < most // 2 else most // 4
    whole = lambda at: next(k for k in range(at, len(data) + 1) if k == len(data) or data[k] & 0xC0 != 0x80)
    pieces, start = [], 0
    while len(data) - start > most:
        half, end = start + most // 2, start + most
        places = [(data.rfind(sep, half, end), len(sep)) for sep in (b"\n\n", b"\n", b" ")]
        cut = next((at + n for at, n in places if at >= 0), 0)
        if not cut:
            cut = end
            while cut > start and data[cut] & 0xC0 == 0x80:
                cut -= 1
        pieces.append(data[start:cut].decode())
        start = whole(cut - overlap) if cut - overlap > start else cut
    return [*pieces, data[start:].decode()]


def pack_units(units: list[str], level: str = "thorough", wanted: list[int] | None = None, hard_max: int = 0, joiner: str = "\n") -> list[tuple[int, int, str]]:
    """(first unit, last unit, text) of consecutive wanted units (from 1) while together they stay within the level's
    target; blank pieces are left out, and no piece spans units that are not wanted."""
    wanted = list(range(1, len(units) + 1)) if not wanted else wanted
    if bad := [u for u in wanted if not 1 <= u <= len(units)]:
        raise ValueError(f"unit {bad[0]} is not within 1-{len(units)}")
    text = lambda a, b: joiner.join(units[a - 1 : b])
    groups: list[list[int]] = []
    size, between = 0, len(joiner.encode())
    for u in wanted:
        own = len(units[u - 1].encode())
        if groups and u == groups[-1][1] + 1 and size + between + own <= TARGET_BYTES[level]:
            groups[-1][1] = u
            size += between + own
        else:
            groups.append([u, u])
            size = own
    return [(a, b, piece) for a, b in groups for piece in split_oversized(text(a, b), hard_max) if piece.strip()]


def scan_chunks(documents: DataFrame, level: str = "thorough", hard_max: int = 0) -> DataFrame:
    """CHUNK rows of ``documents`` (doc_ord, units ARRAY<STRING>)."""

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], ["doc_ord", "chunk_ord", "from_unit", "to_unit", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0  # one document's units at a time, and so many chunks as are sent together
            for d, us in zip(batch.column("doc_ord"), batch.column("units"), strict=True):
                doc = d.as_py()
                for i, (a, b, t) in enumerate(pack_units(us.as_py() or [], level, None, hard_max)):
                    rows.append((doc, i, a, b, t))
                    size += len(t)
                    if size > SENT:
                        yield made(rows)
                        rows, size = [], 0
            yield made(rows)

    return documents.select("doc_ord", "units").mapInArrow(run, CHUNK)


def units_of(documents: DataFrame) -> DataFrame:
    """``documents`` with ``units``: its ``pages`` if it has that column and they are not null, else its lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return documents.withColumn("units", F.coalesce("pages", lines) if "pages" in documents.columns else lines)


def unit_range(units: str, first: int, last: int, header: bool = False) -> Column:
    """Units ``first`` to ``last`` (from 1) of an array column as one text; with ``header`` the first unit stands before them,
    as the head of a table does. Numbers past the end are cut off; an empty range is null."""
    last_there = F.least(F.lit(last), F.size(units))
    body = F.slice(units, first, F.greatest(last_there - first + 1, F.lit(0)))
    parts = F.concat(F.slice(units, 1, 1), body) if header and first > 1 else body
    return F.when((last_there >= first) & F.lit(first >= 1), F.array_join(parts, "\n"))


def estimate_requests(chunks: DataFrame, classify: int = 0, size: int = 50) -> DataFrame:
    """``requests``: one for each chunk, and one for each batch of ``size`` names that are to be classified."""
    return chunks.agg((F.count("*") + F.lit(-(-classify // size))).alias("requests"))


def parse_reply(reply: str) -> list[dict]:
    """The objects of a JSON list, also of one cut short: whole objects before the cut count."""
    start = reply.find("[")
    if start < 0:
        return []
    decoder, at, out = json.JSONDecoder(), start + 1, []
    while True:
        at = next((k for k in range(at, len(reply)) if reply[k] not in " \t\r\n,"), len(reply))
        if at >= len(reply) or reply[at] != "{":
            return out
        try:
            item, at = decoder.raw_decode(reply, at)
        except ValueError:
            return out
        out.append(item)


def model_suggestions(chunks: DataFrame, model: Callable[[str], str], categories: list[str], confidence: float = 0.8) -> DataFrame:
    """``doc_ord, main_text, category, count, confidence`` that ``model`` (text -> JSON reply) names for each chunk.

    Only what stands in the chunk word for word counts, and only categories that exist.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_ord").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for item in parse_reply(model(text)):
                    name, category = str(item.get("text", "")).strip(), item.get("category")
                    if name and name in text and category in categories:
                        rows.append((doc, name, category, float(item.get("confidence") or confidence)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["doc_ord", "main_text", "category", "confidence"])

    found = chunks.select("doc_ord", "text").mapInArrow(run, "doc_ord long, main_text string, category string, confidence double")
    return found.groupBy("doc_ord", "main_text", "category").agg(F.count("*").alias("count"), F.max("confidence").alias("confidence"))
