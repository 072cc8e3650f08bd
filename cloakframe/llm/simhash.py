"""SimHash near-duplicate linking by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded with
zeros to a 23-bit word of the perfect binary Golay code [23, 12, 7]. Of at most four
differing bits, some pair of segments holds errors (1,1), (2,0), (0,2) or fewer, because
the segment with the most errors can be left out. For every pair of segments one side
of a link emits the indices of its two decoded codewords (radius 3), the other side those
of all codewords within radius 4 of both words, or within radius 5 of one word beside the
decoded index of the other. A word at distance t from its codeword lies at t + e from it
after e errors, so the two sides always share a key. The keys are joined and every
candidate is verified by its Hamming distance, so the join has no false link and loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, cut, trim_driver
from .common import as_bytes, lean, pack, text_chunks, text_key, unpack
from .shingle_join import alike_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Keys over which the rows of one fingerprint are dealt.
SHARES = 32
#: (shift, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes) -> int:
    """The unsigned SimHash of one text."""
    words = text.lower().split()  # both are ASCII only on bytes, as the contract wants
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = n - SHINGLE + 1
    cuts = map(slice, starts[:m].tolist(), ends[SHINGLE - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for i in range(0, m, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch):
            fps = np.fromiter(map(fingerprint, as_bytes(part.column(1))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


@cache
def _golay() -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of the 23-bit words, and by radius the error patterns of each syndrome (offsets, counts, patterns)."""
    unit = []
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        unit.append(r)
    words = np.arange(1 << 23, dtype=np.uint32)
    syndrome = np.zeros(1 << 23, np.uint16)
    for i, r in enumerate(unit):
        syndrome ^= np.where(words >> i & 1, r, 0).astype(np.uint16)
    tables = {}
    patterns: list[int] = []
    for weight in range(6):
        patterns += [sum(1 << i for i in c) for c in combinations(range(23), weight)]
        if weight in (3, 4, 5):
            e = np.array(patterns, np.uint32)
            s = syndrome[e]
            order = np.argsort(s, kind="stable")
            counts = np.bincount(s, minlength=2048)
            tables[weight] = (np.cumsum(counts) - counts, counts, e[order])
    return syndrome, tables


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within distance 3: its top 12 bits."""
    syndrome, tables = _golay()
    at, _, errors = tables[3]
    return (words ^ errors[at[syndrome[words]]]) >> 11


def nearby(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every codeword within the radius of each word."""
    syndrome, tables = _golay()
    at, counts, errors = tables[radius]
    s = syndrome[words]
    n = counts[s]
    rows = np.repeat(np.arange(len(words)), n)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] ^ errors[at[s][rows] + inner]) >> 11


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in SEGMENTS]


def _key(pair: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.int64(pair) << 24) | (a.astype(np.int64) << 12) | b.astype(np.int64)


PAIRS = ((0, 1), (0, 2), (1, 2))


def probe_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): one key for each pair of segments."""
    c = [decode(x) for x in _segments(fps)]
    return np.tile(np.arange(len(fps)), 3), np.concatenate([_key(k, c[i], c[j]) for k, (i, j) in enumerate(PAIRS)])


def build_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the nearby keys of each pair of segments, without repeats."""
    seg = _segments(fps)
    exact = [decode(x) for x in seg]
    four = [nearby(x, 4) for x in seg]
    five = [nearby(x, 5) for x in seg]
    rows, keys = [], []
    for k, (i, j) in enumerate(PAIRS):
        (ri, ci), (rj, cj) = four[i], four[j]
        n = np.bincount(rj, minlength=len(fps))
        first = np.cumsum(n) - n
        reps = n[ri]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        r = np.repeat(ri, reps)
        parts = [(r, _key(k, np.repeat(ci, reps), cj[first[r] + inner]))]
        ri, ci = five[i]
        parts.append((ri, _key(k, ci, exact[j][ri])))
        rj, cj = five[j]
        parts.append((rj, _key(k, exact[i][rj], cj)))
        r, q = (np.concatenate(x) for x in zip(*parts, strict=True))
        both = np.unique((r.astype(np.int64) << 26) | q)
        rows.append(both >> 26)
        keys.append(both & ((1 << 26) - 1))
    return np.concatenate(rows), np.concatenate(keys)


#: Candidates looked at together; build keys that one task is to hold; fingerprints whose keys are made at a time.
HELD, PER_TASK, PIECE = 3_000_000, 500_000, 4000
#: Build keys of a fingerprint, about; fingerprints whose keys one task is to send, some 4 s of work.
BUILD_KEYS, PER_SENDER = 172, 60_000
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POP[(a ^ b).view(np.uint16).reshape(-1, 4)].sum(axis=1)


def _send_keys(parts: int, finer: int):
    """Rows (part, kind, blob) of fingerprints: kind 0 build keys, kind 1 probe keys, each with the fingerprints they are of.

    Keys go by their pair of segments and first codeword number (and ``finer`` bits of the second), so the many keys of a
    fingerprint fall into few parts, and its bits are sent once for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(fps), PIECE):
                piece = fps[i : i + PIECE]
                numbers, kinds, blobs = [], [], []
                for kind, make in enumerate((build_keys, probe_keys)):
                    rows, keys = make(piece)
                    part = ((keys >> (12 - finer)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                    order = np.lexsort((keys, part))
                    part, keys, rows = part[order], keys[order], rows[order]
                    edges = np.flatnonzero(np.concatenate((np.diff(part, prepend=-1) != 0, [True]))).tolist()
                    for x, y in zip(edges[:-1], edges[1:], strict=True):
                        who, of = np.unique(rows[x:y], return_inverse=True)
                        steps = np.diff(keys[x:y], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
                        numbers.append(int(part[x]))
                        kinds.append(kind)
                        blobs.append(pack(steps, piece[who], of.astype("<u2").view(np.uint8).reshape(-1, 2).T.copy()))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and kind -> the pairs of fingerprints that share a key and are near."""
    part, held = None, []
    keys = fps = np.zeros(0, np.uint64)

    def near(k: np.ndarray, a: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
        n = hi - lo
        ends = np.cumsum(n)
        at = 0
        while at < len(k):  # so many probes at a time that their candidates fit
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")))
            own = n[at:to]
            first = np.repeat(lo[at:to] - (np.cumsum(own) - own), own)
            b = fps[first + np.arange(int(own.sum()))]
            x = np.repeat(a[at:to], own)
            good = (x != b) & (bits_apart(x, b) <= RADIUS)
            both = np.unique(np.stack((x[good].view(np.int64), b[good].view(np.int64))), axis=1) if good.any() else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], ["a", "b"])
            at = to

    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if p != part:
                part, held = p, []
                keys = fps = np.zeros(0, np.uint64)
            steps, own, of = unpack(blob, "u1", "<u8", "u1")
            k = np.cumsum(steps.reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64).astype(np.uint64)
            f = own[of.reshape(2, -1).T.copy().view("<u2").ravel()]
            if kind == 0:
                held.append((k, f))
                continue
            if held:
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, fps, held = keys[order], fps[order], []
            yield from near(k, f)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column fp) at RADIUS or fewer differing bits."""
    n = distinct.count()
    parts = max(8, -(-n * BUILD_KEYS // PER_TASK))
    finer = min(12, max(0, math.ceil(math.log2(parts / 4096)))) if parts > 4096 else 0
    # fingerprints are few bytes, so they may stand in one or two partitions, however long their keys take
    dealt = distinct.select("fp").repartition(max(8, -(-n // PER_SENDER)), "fp") if n > PIECE else distinct.select("fp")
    sent = dealt.mapInArrow(lean(_send_keys(parts, finer)), "part long, kind int, blob binary")
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(lean(_match), "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fp LONG, component_id`` for every row of ``docs`` (columns doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Rows repeat as they
    do in the input; a null doc_id gets a component but never names one. Equal fingerprints
    are one node, represented by their smallest doc_id, so copies are never paired.
    """
    prints = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    parts = connected_components(links(distinct), "a", "b")
    named = parts.join(distinct, parts.node == distinct.fp).groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = parts.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)).cast("int")
    # rows of one fingerprint are dealt over SHARES keys, so that a large group of copies is no single task's
    of = F.when(F.col("n") == 1, F.array(share("rep"))).otherwise(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    by_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.explode(of).alias("share"))
    return prints.withColumn("share", share("doc_id")).join(by_fp, ["fp", "share"]).select("doc_id", "fp", "component_id")


#: Rows to be dropped, 24 bytes each, that are sent to every task; more meet the documents by a shuffle.
MOST_SENT = 2_000_000


def _text_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch):
            fps = np.fromiter(map(fingerprint, as_bytes(part.column("text"))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("none"), part.column("id"), part.column("node"), pa.array(fps.view(np.int64)), pc.binary_length(part.column("text")).cast(pa.int64())], ["none", "id", "node", "fp", "size"])


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, and of several such the one with the smallest hash.

    Texts are linked where their fingerprints are (as in ``simhash_components``) and where their sets of five-word shingles
    have a Jaccard similarity of 0.8 or more. A null text counts as empty, and all texts without a word are one. Rows without
    a doc_id stand behind all that have one; different texts under one doc_id are told apart. Repeated rows stay once.
    """
    none, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    body = docs.select(F.struct(*docs.columns).alias("row"), none.alias("none"), number.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = body.withColumn("node", text_key(body))
    prints = cut(rows.select("none", "id", "node", "text").mapInArrow(lean(_text_prints), "none boolean, id long, node long, fp long, size long"))
    by_fp = cut(prints.groupBy("fp").agg(F.min("node").alias("s")))
    near = links(by_fp).join(by_fp.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    edges = prints.select("fp", "node").distinct().join(by_fp, "fp").select(F.col("node").alias("a"), F.col("s").alias("b")).where("a <> b")
    edges = edges.unionByName(near.select(F.col("sa").alias("a"), F.col("sb").alias("b")))
    trim_driver(docs.sparkSession)
    parts = alike_components(rows.select("node", "text"), edges, prints.agg(F.sum("size")).first()[0] or 0)
    # a row for each (doc_id, text); of each component the first of them stays
    seen = prints.groupBy("none", "id", "node").agg(F.count("*").alias("n")).join(parts, "node", "left").withColumn("c", F.coalesce("component", "node"))
    own = ["none", "id", "node"]
    kept = seen.groupBy("c").agg(F.min(F.struct(*own)).alias("k")).select("c", "k.*")
    marked = cut(seen.join(kept.select("c", F.col("none").alias("n0"), F.col("id").alias("i0"), F.col("node").alias("t0")), "c").select(*own, "n", F.expr("none = n0 AND id = i0 AND node = t0").alias("stays")))
    gone, twice = marked.where("NOT stays").select(*own), marked.where("stays AND n > 1").select(*own)
    sizes = marked.agg(F.expr("count_if(NOT stays)").alias("gone"), F.expr("count_if(stays AND n > 1)").alias("twice")).first()
    small = lambda df, n: F.broadcast(df) if n <= MOST_SENT else df
    rows = rows.select(*own, "row").join(small(gone, sizes.gone), own, "left_anti")
    if not sizes.twice:
        return rows.select("row.*")
    once = rows.join(small(twice, sizes.twice), own, "left_anti").select("row")
    again = rows.join(small(twice, sizes.twice), own, "left_semi").groupBy(*own).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(again).select("row.*")
