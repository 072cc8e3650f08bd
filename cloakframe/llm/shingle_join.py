"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

Sets of a and b shingles are alike only if (a + b) / 9 shingles or fewer stand in one of them alone. A set is dealt into parts
by the hashes of its shingles, more parts than two alike sets can differ in, so some part is equal in both; a key is the sum
of such a part. Sizes are in classes so that alike sets are in one class or in neighbouring ones: a set gives the keys of its
own class, where it meets equals and smaller ones, and those of the next, where it meets larger ones.

Parts without a shingle would be equal in unlike sets, so they give no key. Two alike sets that have only such parts in common
both have no more filled parts than they may differ in; every such set gives the keys of another way of dealing too, and so
on; one that is left after WAYS gives a key that all such sets of a class share. So no pair is lost but by a collision of
64-bit hashes of shingles.

Passages that many texts share seldom make a part equal, unless nearly all of the texts is equal. Of the sets under one key
one, the centre, is compared with each other one; sets that these comparisons leave apart, though they share a key, are then
held against each other by their sketches, in blocks of bounded size, but for those of the largest component among themselves.
No pair of a group of copies is written out, and groups join up as components.

Sets are only sent for pairs whose sketches allow it. A sketch has two bits or more for a shingle, each the parity of the
shingles that fall on it, so two sketches differ in no more bits than the sets in shingles; a larger one folds to a smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, cut, trim_driver
from .common import as_bytes, lean, pack, text_chunks, unpack

WORDS, SEED = 5, 42
#: Similarity of alike sets, as a fraction.
ALIKE = (4, 5)
#: Ways of dealing a set into parts before the key of last resort.
WAYS = 6
#: Keys held by a task before what they have in common is written; sets in a block of the last comparisons.
HELD, BLOCK = 2_000_000, 4096
#: Bytes of text whose keys one part is to hold: some 1.7 million keys of running text.
PART_BYTES = 24_000_000
#: Words of 64 bits that the sketches of a cell may take; they are folded to fit.
CELL_WORDS = 8_000_000
#: Names of texts, 8 bytes each, that are sent to every task.
MOST_SENT = 2_000_000
_KEY_BITS = np.uint64((1 << 48) - 1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the WORDS-word shingles of one text; a shorter text is one shingle, an empty one has none.

    A-Z count as a-z, and words are parted by ASCII white space.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = n - WORDS + 1
    cuts = map(slice, starts[:m].tolist(), ends[WORDS - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, m))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sorted sets ALIKE or more?"""
    low, high = sorted((len(a), len(b)))
    if ALIKE[1] * low < ALIKE[0] * high:
        return False
    both = low + high - len(np.unique(np.concatenate((a, b))))
    return ALIKE[1] * both >= ALIKE[0] * (low + high - both)


def sketch(own: np.ndarray) -> bytes:
    """The size of a set, then its parity bits: a power of two of them, 64 or more, so that sketches fold."""
    n = max(64, 1 << int(2 * len(own)).bit_length())
    bits = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return len(own).to_bytes(8, "little") + np.packbits(bits.astype(bool), bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes) -> bool:
    """Do two sketches allow their sets to be ALIKE?"""
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    if ALIKE[1] * min(n, m) < ALIKE[0] * max(n, m):
        return False
    x, y = int.from_bytes(a[8:], "little"), int.from_bytes(b[8:], "little")
    p, q = 8 * (len(a) - 8), 8 * (len(b) - 8)
    while p > q:
        p //= 2
        x = (x >> p) ^ (x & ((1 << p) - 1))
    while q > p:
        q //= 2
        y = (y >> q) ^ (y & ((1 << q) - 1))
    return 9 * (x ^ y).bit_count() <= n + m


def _bounds() -> np.ndarray:
    """Least sizes of the classes: a set and one a quarter larger are in the same class or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, ALIKE[1] * (out[-1] - 1) // ALIKE[0] + 1))
    return np.array(out)


BOUNDS = _bounds()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def parts_of(level: int) -> tuple[int, int]:
    """(shingles in which alike sets met at a class may differ, number of parts there)."""
    differ = 2 * int(BOUNDS[level + 1] - 1) // 9
    return differ, differ + 1 + (differ // 8 + 1 if differ else 0)


def keys_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each whether the set is of the class it is given for (else of the one below)."""
    keys, flags = [], []
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    mine = int(np.searchsorted(BOUNDS, len(own), side="right")) - 1
    weights = _mixed(own)
    for level in (mine, mine + 1):
        differ, parts = parts_of(level)
        for way in range(WAYS):
            if way:
                h = _mixed(own ^ np.uint64(0xD6E8FEB86659FD93 * way & (1 << 64) - 1))
                order = np.argsort(h)
                h, w = h[order], weights[order]
            else:
                h, w = own, weights
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            salt = np.uint64((level * WAYS + way + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
            keys.append(_mixed(np.add.reduceat(w, first) + part[first] * np.uint64(0x165667B19E3779F9) + salt))
            if len(first) > differ:
                break
        else:
            keys.append(_mixed(np.array([level], np.uint64)))
        flags.append(np.full(sum(map(len, keys)) - sum(map(len, flags)), level == mine))
    return np.concatenate(keys) & _KEY_BITS, np.concatenate(flags)


def _send_keys(parts: int):
    """Rows (part, kind, blob) of a chunk's distinct texts. Kind 0: keys of a range, as the bytes of their steps; kind 1: sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                nodes, at = np.unique(chunk.column("node").to_numpy(), return_index=True)
                texts = as_bytes(chunk.column("text"))
                sets = [shingles(texts[i]) for i in at.tolist()]
                got = [keys_of(x) for x in sets]
                if not got:
                    continue
                of = np.repeat(np.arange(len(nodes)), [len(k) for k, _ in got])
                key, flag = np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got])
                order = np.argsort(key, kind="stable")
                key, flag, of = key[order], flag[order], of[order]
                part = ((key >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
                edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(key) else np.zeros(0, int)
                numbers, blobs = [], []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    who, mine = np.unique(of[a:b], return_inverse=True)
                    steps = np.diff(key[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()
                    numbers.append(int(part[a]))
                    blobs.append(pack(steps, nodes[who], mine.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy(), np.packbits(flag[a:b])))
                kinds = [0] * len(numbers)
                deal = np.mod(nodes, parts)
                for p in np.unique(deal).tolist():
                    mine = np.flatnonzero(deal == p)
                    drawn = [sketch(sets[i]) for i in mine.tolist()]
                    numbers.append(p)
                    kinds.append(1)
                    blobs.append(pack(nodes[mine], np.array([len(x) for x in drawn], np.int64), np.frombuffer(b"".join(drawn), np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])

    return run


#: What comes of a part: buckets with their members, or a node with its sketch.
MEETINGS = "bucket long, members array<long>, node long, sketch binary"


def _meetings(buckets: list[int], members: list[list[int]], nodes: list[int], sketches: list[bytes]) -> pa.RecordBatch:
    none, many = [None] * len(nodes), [None] * len(buckets)
    return pa.RecordBatch.from_arrays([pa.array(buckets + none, pa.int64()), pa.array(members + none, pa.list_(pa.int64())), pa.array(many + nodes, pa.int64()), pa.array(many + sketches, pa.binary())], ["bucket", "members", "node", "sketch"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part -> the sets under each key that a set of the key's own class is under, two or more, smallest first.

    The bucket is named by its members, so keys with the same members are one; only a bucket that is written in several pieces
    (each begins with the same member) goes by its key.
    """
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))

    def reduce(held: list, last: bool) -> tuple[pa.RecordBatch, list]:
        key, node, flag = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, key))
        key, node, flag = key[order], node[order], flag[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.zeros(0, bool)
        key, node, flag = key[new], node[new], flag[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        n = np.diff(np.append(first, len(key)))
        own = np.add.reduceat(flag.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
        seen: dict[int, list[int]] = {}
        for a, k in zip(first[(n > 1) & own].tolist(), n[(n > 1) & own].tolist(), strict=True):
            members = node[a : a + k]
            name = xxhash.xxh64_intdigest(members.tobytes(), SEED) if last else int(key[a])
            seen.setdefault(name - (1 << 63), members.tolist())
        rest = [] if last else [(key[first], node[first], own)]
        return _meetings(list(seen), list(seen.values()), [], []), rest

    # ``kept`` keys of those held were looked at before: a part that outgrows HELD is looked at again when it has doubled
    part, held, size, kept, whole = None, [empty], 0, 0, True
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if kind:
                nodes, sizes, body = unpack(blob, "<i8", "<i8", "u1")
                ends, data = np.cumsum(sizes).tolist(), body.tobytes()
                yield _meetings([], [], nodes.tolist(), [data[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)])
                continue
            if p != part or size > max(HELD, kept):
                if p != part:
                    out, _ = reduce(held, whole)
                    held, size, kept, whole = [empty], 0, 0, True
                else:  # too much for one key range: write what meets so far, and keep the first of each key
                    out, held = reduce(held, False)
                    size, kept, whole = 0, sum(len(h[0]) for h in held), False
                yield out
            part = p
            steps, nodes, mine, flags = unpack(blob, "u1", "<i8", "u1", "u1")
            key = np.cumsum(steps.reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)
            of = mine.reshape(4, -1).T.copy().view("<u4").ravel()
            held.append((key, nodes[of], np.unpackbits(flags, count=len(key)).astype(bool)))
            size += len(key)
    yield reduce(held, whole)[0]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles(t).tobytes() for t in as_bytes(part.column("text"))], pa.binary())], ["node", "own"])


def sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, own`` (packed shingles) for the texts (node, text) named in ``nodes``, each once. Up to MOST_SENT names are sent to
    the texts; more meet them by a shuffle."""
    if nodes.count() <= MOST_SENT:
        nodes = F.broadcast(nodes)
    return texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_sets, "node long, own binary")


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches (sa, sb) allow them to be alike."""
    for batch in batches:
        pairs = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([may_be_alike(x, y) for x, y in pairs], pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb")]
        yield batch.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))


def _sift_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, node, c, sketch) sorted by cell -> the pairs (a, b) of other sides (or of the one side) and other
    components whose sketches allow them to be alike. Members of the cell's largest component are only held against the rest."""

    def allowed(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        _, side, node, c = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:4])
        n = np.array([int.from_bytes(r[4][:8], "little") for r in rows])
        kinds, of, counts = np.unique(c, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return
        bits = [np.frombuffer(r[4], np.uint64)[1:] for r in rows]
        least = min(map(len, bits))
        while least > 1 and least * len(rows) > CELL_WORDS:
            least //= 2
        drawn = np.empty((len(rows), least), np.uint64)
        for i, x in enumerate(bits):
            drawn[i] = np.bitwise_xor.reduce(x.reshape(-1, least), axis=0)
        rest, one = of != np.argmax(counts), len(np.unique(side)) == 1
        place = np.arange(len(rows))
        for i in np.flatnonzero(rest).tolist():
            # a pair within the rest is looked at from its first member
            which = np.flatnonzero((~rest | (place > i)) & (c != c[i]) & (one | (side != side[i])) & (ALIKE[1] * np.minimum(n, n[i]) >= ALIKE[0] * np.maximum(n, n[i])))
            differ = np.bitwise_count(drawn[which] ^ drawn[i]).sum(axis=1, dtype=np.int64)
            b = node[which[9 * differ <= n[which] + n[i]]]
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, node[i])), pa.array(np.maximum(b, node[i]))], ["a", "b"])

    rows: list[tuple[int, int, int, int, bytes]] = []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in ("cell", "side", "node", "c", "sketch")), strict=True):
            if rows and r[0] != rows[-1][0]:
                yield from allowed(rows)
                rows = []
            rows.append(r)
    if rows:
        yield from allowed(rows)


def centre_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of each bucket's centre with its other members, from rows (bucket, node, n members). The centre is the
    member that meets most others over all buckets: of many changed copies of a text it is one of the least changed."""
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    centres = members.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("centre"))
    return members.join(centres, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def cells_of(spread: DataFrame) -> DataFrame:
    """``cell, side, node, c`` for the buckets of ``spread`` (bucket, node, component c) with two components and three members or
    more: any two members of different components meet in a cell. Up to BLOCK members are one cell; of more, those outside the
    largest component are in blocks that meet each other and the blocks of that component, whose own blocks don't meet."""
    by_c = spread.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    sizes = by_c.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", F.struct("n", "c")).alias("large"), F.count("*").alias("cs")).where("cs > 1 AND n > 2")
    many = F.col("n") > BLOCK
    sizes = sizes.withColumn("rest", F.when(many, F.ceil((F.col("n") - F.col("most")) / BLOCK)).otherwise(1).cast("int")).withColumn("own", F.when(many, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int"))
    h, large = F.xxhash64("node"), many & (F.col("c") == F.col("large"))
    block = F.when(large, F.col("rest") + F.pmod(h, F.greatest("own", F.lit(1)))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    last = F.when(large, F.col("rest") - 1).otherwise(F.col("rest") + F.col("own") - 1)
    cells = spread.join(sizes, "bucket").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), last)))
    return cells.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), F.col("i").alias("side"), "node", "c")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are ALIKE."""
    sets = sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def parts_for(splits: int, size: int) -> int:
    """Parts of the keys of texts in ``splits`` input splits with ``size`` bytes together. Splits may be of any size, parts not:
    a task holds the keys of a part."""
    return max(1, splits, -(-size // PART_BYTES))


def alike_components(texts: DataFrame, other: DataFrame, size: int | None = None) -> DataFrame:
    """``node, component`` of the texts (node, text; equal texts have equal nodes) over the links of ALIKE shingle sets and
    those of ``other`` (a, b). Texts without a partner are left out; a text without a word is alike to none. ``size`` is the bytes
    of all texts, counted if not given."""
    if size is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits = parts_for(texts.rdd.getNumPartitions(), size)
    keys = texts.where("text IS NOT NULL").mapInArrow(lean(_send_keys(splits)), "part long, kind int, blob binary")
    met = cut(keys.repartition(splits, "part").sortWithinPartitions("part").mapInArrow(lean(_meet), MEETINGS))
    buckets = met.where("bucket IS NOT NULL").select("bucket", "members").dropDuplicates()
    sketches = met.where("node IS NOT NULL").select("node", "sketch").dropDuplicates(["node"])
    members = buckets.select("bucket", F.explode("members").alias("node"), F.size("members").alias("n"))
    pairs = centre_pairs(members)
    drawn = pairs.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b").join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    pairs = cut(drawn.select("a", "b", "sa", "sb").mapInArrow(_sift, "a long, b long"))
    edges = cut(other.select("a", "b").unionByName(_verified(texts, pairs)))
    trim_driver(texts.sparkSession)
    found = connected_components(edges, "a", "b")
    trim_driver(texts.sparkSession)
    # sets that share a key and are still apart: all of them are compared, not only with the centre
    spread = members.select("bucket", "node").distinct().join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    met = cells_of(spread).join(sketches, "node").repartition("cell").sortWithinPartitions("cell")
    sifted = cut(met.select("cell", "side", "node", "c", "sketch").mapInArrow(lean(_sift_cells), "a long, b long").distinct())
    if sifted.isEmpty():
        return found
    return connected_components(edges.unionByName(_verified(texts, sifted)), "a", "b")
