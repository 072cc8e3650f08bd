"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose five of up to nine token positions and ignore the rest, so a seed survives
a substitution under an ignored position. Hashes of the benchmark's seeds are joined with those
of the documents; every hit gives a diagonal (where the item would lie in the document), and on
it the longest stretch with IDENTITY or more equal tokens is measured. A stretch of MIN_TOKENS
(or of a whole shorter item) is an overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, text_chunks

MASKS = ("11111", "1101011", "1011101", "11001011", "101010101")
#: For items of SHORT words, in which one substitution may leave no seed of five.
SHORT_MASKS, SHORT = ("111", "1101"), range(5, 8)
IDENTITY, MIN_TOKENS = 0.8, 10
#: Benchmark tokens that may be sent to every task; beyond it seeds meet by a shuffle join.
MAX_BROADCAST_TOKENS = 1_000_000
HITS = "array<struct<item_id: bigint, doc_start: int, item_start: int, length: int, matches: int>>"
_WORDS = re.compile(r"[^\W_]+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def tokens(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def seeds(ids: np.ndarray, short: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask number, positions, hashes) of the seeds of non-zero token ids, with ``short`` also of SHORT_MASKS; a zero id stands
    for a word that no item has."""
    known = ids != 0
    for m, mask in enumerate(MASKS + SHORT_MASKS if short else MASKS):
        offsets = [i for i, c in enumerate(mask) if c == "1"]
        n = len(ids) - len(mask) + 1
        if n <= 0:
            continue
        ok = known[offsets[0] : offsets[0] + n].copy()
        for o in offsets[1:]:
            ok &= known[o : o + n]
        at = np.flatnonzero(ok)
        if len(at):
            h = np.full(len(at), m + 1, np.uint64)
            for o, r in zip(offsets, _MULT, strict=False):
                h = (h ^ (h >> np.uint64(29))) * r + ids[at + o]
            yield m, at, h ^ (h >> np.uint64(32))


def longest(equal: np.ndarray) -> tuple[int, int]:
    """Start and length of the longest stretch (the first of them) whose share of true values is IDENTITY or more."""
    s = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))  # never negative at 4 of 5
    lows, best, at = [], 0, 0
    for i, v in enumerate(s):
        if not lows or v < s[lows[-1]]:
            lows.append(i)
    for j in range(len(s) - 1, -1, -1):
        while lows and s[lows[-1]] <= s[j]:
            i = lows.pop()
            if j - i > best or j - i == best and i < at:
                best, at = j - i, i
        if not lows:
            break
    return at, best


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(doc start, item start, length, matches) of the item laid at ``diagonal``, if that is an overlap."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi - lo < min(MIN_TOKENS, len(item)):
        return None
    equal = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    at, n = longest(equal)
    if n < min(MIN_TOKENS, len(item)) or not n:
        return None
    # a stretch may begin or end with ignored words; only equal ones count as its ends
    inside = np.flatnonzero(equal[at : at + n])
    first, last = int(inside[0]), int(inside[-1])
    return lo + diagonal + at + first, lo + at + first, last - first + 1, len(inside)


class Index:
    """Seeds and tokens of the benchmark's texts, for broadcasting. Texts shorter than a seed are compared as a whole.

    Texts have numbers of their own: several may share an item's id, and an id may be null.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.short: list[int] = []
        self.some_short = False
        self.names: list[int | None] = []
        for number, (item_id, text) in enumerate(items):
            t = tokens(text)
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in t], np.uint64)
            self.names.append(item_id)
            if not len(ids):
                continue
            self.items[number] = ids
            if len(ids) < 5:
                self.short.append(number)
            self.some_short |= len(ids) in SHORT
            rows += [(h, at, number) for _, at, h in seeds(ids, len(ids) in SHORT)]
        hashes = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.at = np.concatenate([r[1] for r in rows])[order] if rows else np.zeros(0, np.int64)
        self.of = np.concatenate([np.full(len(r[1]), r[2], np.int64) for r in rows])[order] if rows else np.zeros(0, np.int64)

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        words = tokens(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, len(words))
        diagonals: set[tuple[int, int]] = set()
        for _, at, h in seeds(ids, self.some_short):
            lo = np.searchsorted(self.hashes, h)
            hi = np.searchsorted(self.hashes, h, side="right")
            for k in np.flatnonzero(hi > lo):
                for j in range(lo[k], hi[k]):
                    diagonals.add((int(self.of[j]), int(at[k] - self.at[j])))
        for item_id in self.short:
            for p in np.flatnonzero(ids == self.items[item_id][0]):
                diagonals.add((item_id, int(p)))
        return best_of((self.names[i], overlap(ids, self.items[i], d)) for i, d in sorted(diagonals))


def best_of(found) -> list[tuple[int | None, int, int, int, int]]:
    """The longest overlap of each item (of equals the first in the document, then in the item), by item, a null id first."""
    best: dict[int | None, tuple[int, int, int, int]] = {}
    for i, o in found:
        if o and (i not in best or (o[2], -o[0], -o[1], o[3]) > (best[i][2], -best[i][0], -best[i][1], best[i][3])):
            best[i] = o
    return [(i, *best[i]) for i in sorted(best, key=lambda i: (i is not None, i or 0))]


_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32()), ("matches", pa.int32())]))
_FIELDS = [f.name for f in _HIT_TYPE.value_type]


def _as_hits(found: list[list[tuple[int, int, int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(_FIELDS, x, strict=True)) for x in row] for row in found], _HIT_TYPE)


def _by_broadcast(rows: DataFrame, items: DataFrame) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "_text"):
                found = [index.value.find(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _as_hits(found)], [*part.schema.names[:-1], "_hits"])

    hits = T.StructType.fromDDL(f"_hits {HITS}")
    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields[:-1], *hits.fields]))


def _word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def _seed_rows(short):
    """Seeds of texts; ``short(number of words)`` says whether those of SHORT_MASKS are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "_text"):
                for key, text in zip(part.column(0).to_pylist(), part.column("_text").to_pylist(), strict=True):
                    ids = np.array([_word_id(w) for w in tokens(text)], np.uint64)
                    for _, at, h in seeds(ids, short(len(ids))):
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "at", "seed"])

    return run


def _short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each item of SHORT words."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([n for t in batch.column("_text").to_pylist() if (n := len(tokens(t))) in SHORT], pa.int32())], ["n"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            doc, item = (np.array([_word_id(w) for w in tokens(r[c])], np.uint64) for c in ("_text", "item"))
            spots = r["diagonals"]
            if len(item) < 5:
                spots = np.flatnonzero(doc == item[0]).tolist() if len(item) else []
            found = best_of((r["item_id"], overlap(doc, item, d)) for d in sorted(spots))
            yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), _as_hits([found])], ["key", "hits"])


def _by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    """For benchmarks of any size: seeds meet by a join, and so do the texts of the pairs found.

    Items of fewer than five words (shorter than any seed) meet documents by their first word.
    """
    texts = rows.select(F.sha2(F.coalesce("_text", F.lit("")), 256).alias("key"), "_text").dropDuplicates(["key"])
    kept = items.select(F.sha2("text", 256).alias("item_key"), "item_id", F.col("text").alias("_text"))
    asked = kept.select("item_key", "_text").dropDuplicates(["item_key"])
    some = bool(asked.mapInArrow(_short_rows, "n int").limit(1).count())
    train = texts.mapInArrow(_seed_rows(lambda n: some), "key string, at int, seed long")
    test = asked.mapInArrow(_seed_rows(lambda n: n in SHORT), "key string, at int, seed long").select(F.col("key").alias("item_key"), F.col("at").alias("item_at"), "seed")
    spots = train.join(test, "seed").groupBy("key", "item_key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if 0 < len(t := tokens(text)) < 5:
                    yield pa.RecordBatch.from_pydict({"item_key": [key], "word": [t[0]]})

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "_text"):
                for key, text in zip(part.column(0).to_pylist(), part.column("_text").to_pylist(), strict=True):
                    if w := sorted(set(tokens(text))):
                        yield pa.RecordBatch.from_pydict({"key": [key] * len(w), "word": w})

    few = asked.mapInArrow(firsts, "item_key string, word string")
    pairs = few.join(texts.mapInArrow(vocabulary, "key string, word string"), "word").select("key", "item_key", F.array().cast("array<int>").alias("diagonals"))
    pairs = spots.unionByName(pairs).join(kept.select("item_key", "item_id", F.col("_text").alias("item")), "item_key").join(texts, "key")
    found = pairs.select("key", "_text", "item_id", "item", "diagonals").mapInArrow(_verify, f"key string, hits {HITS}").select("key", F.explode("hits").alias("h"))
    # of the texts that share an item's id the longest overlap, as in best_of
    order = F.struct((-F.col("h.length")).alias("l"), "h.doc_start", "h.item_start", (-F.col("h.matches")).alias("m"))
    single = found.groupBy("key", F.col("h.item_id").alias("i")).agg(F.min_by("h", order).alias("h"))
    hits = single.groupBy("key").agg(F.array_sort(F.collect_list("h"), lambda a, b: F.when(a["item_id"].isNull(), -1).when(b["item_id"].isNull(), 1).when(a["item_id"] < b["item_id"], -1).otherwise(1)).alias("_hits"))
    keyed = rows.withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256))
    joined = keyed.join(hits, keyed._key == hits.key, "left").drop("_key", "key", "_text")
    return joined.withColumn("_hits", F.coalesce("_hits", F.expr(f"CAST(array() AS {HITS})")))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_broadcast_tokens: int = MAX_BROADCAST_TOKENS) -> DataFrame:
    """``docs`` without its text, with ``_hits`` (HITS): the longest overlap with each benchmark item.

    Every distinct text of the benchmark is searched for, whatever its id: of several texts under one id the longest overlap
    counts, and a null id is an item of its own. Null and empty texts on either side have no hits; rows repeat as they do in
    the input, and other columns pass through.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    rows = docs.select(*[F.col(c) for c in docs.columns if c != text], F.col(text).cast("string").alias("_text"))
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if size.n <= max_broadcast_tokens and size.b <= 16 * max_broadcast_tokens:
        return _by_broadcast(rows, items)
    return _by_shuffle(rows, items)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, the longest overlap (best_*), and all hits."""
    found = overlaps(docs.select("doc_id", "text"), benchmark, **options)
    best = F.expr("element_at(array_sort(_hits, (a, b) -> CASE WHEN a.length <> b.length THEN b.length - a.length WHEN a.item_id IS NULL THEN -1 WHEN b.item_id IS NULL THEN 1 WHEN a.item_id < b.item_id THEN -1 ELSE 1 END), 1)")
    found = found.withColumn("_best", F.when(F.size("_hits") > 0, best))
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").cast("long").alias("n_items"), F.col("_best.item_id").alias("best_item"), F.col("_best.length").alias("best_length"), F.col("_best.matches").alias("best_matches"), F.col("_hits").alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return overlaps(rows, benchmark).where(F.size("_hits") == 0).select("row.*")
