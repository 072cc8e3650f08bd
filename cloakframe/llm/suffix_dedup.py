"""Removal of repeated byte strings with an enhanced suffix array over sampled suffixes.

In every window of LENGTH bytes the place of the smallest GRAM-byte hash is an anchor, so two
equal windows hold an anchor at the same place. Suffixes are sampled at anchors and dealt by
the anchor's hash; texts are only sent where that hash occurs in more than one document.

A shard sorts its suffixes (LENGTH bytes right of the anchor), takes the longest common prefix of
neighbours, and scans them with a stack into the tree of common-prefix intervals. An interval
whose members go on differently to the left splits by their left contexts, which a second scan
of the same kind finds; so every maximal repeat comes out once, with all its occurrences. Of a
repeat of LENGTH bytes or more, all occurrences outside its smallest document are covered.

Copies of a whole text count once, under their smallest id; the others go whole. A hash that very many documents share is sent window by window: two hashes stand for the whole
window, equal windows of a chunk are sent once, and no shard holds more than a few for each chunk. Texts are joined to what was found by streams sorted by partition, never collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pack, text_chunks, text_key, unpack

LENGTH, GRAM = 50, 16
LEFT = LENGTH - GRAM
#: Documents in which a hash may occur, in one chunk of a task and altogether, before it is sent by windows. In a chunk it is
#: at least LOCAL_HOT, and more while the input is so small that its share of HOT is more.
LOCAL_HOT, HOT = 48, 200_000
CHUNK = 1_500_000
NO_ID = (1 << 63) - 1
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_HASH_BITS = np.uint64((1 << 48) - 1)
_HOT_BIT = np.uint64(1 << 63)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours."""
    n, span, cur = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while 2 * span <= width:
        cur = pick(cur[:-span], cur[span:])
        span *= 2
    return cur[:n] if span == width else pick(cur[:n], cur[width - span : width - span + n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_kept: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if len(_kept[0]) < n:
        for i, base in enumerate((_B, _B_INVERSE)):
            p = np.full(n, base)
            p[0] = 1
            _kept[i] = np.multiply.accumulate(p, out=p)
    return _kept[0][:n], _kept[1][:n]


class Scan:
    """Anchors of a list of texts: ``at`` (place in ``raw``), ``doc`` (number of the text), ``hash``."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.raw = raw = np.frombuffer(b"".join(texts), np.uint8)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        n = len(raw)
        self.at = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        power, self.inverse = _powers(n)  # so that a hash does not depend on its place
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * power, out=self.sums[1:])
        h = self.sums[GRAM:] - self.sums[:-GRAM]
        h *= self.inverse[: n - GRAM + 1]
        h = _mixed(h)
        rank = (h >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
        # grams and windows that would run over the end of a text
        over = (self.end[:, None] - np.arange(1, GRAM)).ravel()
        rank[over[(over >= 0) & (over < len(rank))]] = 0xFFFFFFFF
        low = _sliding(rank, LENGTH - GRAM + 1, np.minimum)
        over = (self.end[:, None] - np.arange(1, LENGTH)).ravel()
        low[over[(over >= 0) & (over < len(low))]] = 0
        self.low = low
        edge = np.zeros(LENGTH - GRAM, np.uint32)
        high = _sliding(np.concatenate((edge, low, edge)), LENGTH - GRAM + 1, np.maximum)
        self.at = np.flatnonzero(high == rank)
        self.doc = np.searchsorted(self.end, self.at, side="right")
        self.rank = rank[self.at]
        self.hash = h[self.at] & _HASH_BITS

    def contexts(self, which: np.ndarray, reach: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors: ``reach`` bytes left (nearest first) and right, zero-padded, and how many of each."""
        at, doc = self.at[which], self.doc[which]
        most, far = reach
        lc, rc = np.minimum(most, at - self.begin[doc]), np.minimum(far, self.end[doc] - at)
        left = np.where(np.arange(most) < lc[:, None], self.raw[np.maximum(at[:, None] - 1 - np.arange(most), 0)], 0)
        right = np.where(np.arange(far) < rc[:, None], self.raw[np.minimum(at[:, None] + np.arange(far), len(self.raw) - 1)], 0)
        return left.astype(np.uint8), right.astype(np.uint8), lc.astype(np.uint8), rc.astype(np.uint8)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows in which one of the anchors is smallest, and two hashes of each (the first with its top bit set)."""
        starts = self.at[which][:, None] - np.arange(LEFT + 1)
        inside = (starts >= self.begin[self.doc[which]][:, None]) & (starts < len(self.low))
        ok = inside & (self.low[np.clip(starts, 0, len(self.low) - 1)] == self.rank[which][:, None])
        s = np.unique(starts[ok])
        second = np.zeros(len(s), np.uint64)
        for i in range(0, len(s), 20_000):
            rows = np.zeros((len(s[i : i + 20_000]), -(-LENGTH // 8) * 8), np.uint8)
            rows[:, :LENGTH] = self.raw[s[i : i + 20_000, None] + np.arange(LENGTH)]
            second[i : i + 20_000] = _mixed((rows.view("<u8") * _WEIGHTS).sum(axis=1, dtype=np.uint64))
        return s, _mixed((self.sums[s + LENGTH] - self.sums[s]) * self.inverse[s]) | _HOT_BIT, second


def _deltas(h: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes as the bytes of their steps, byte by byte, which compress well."""
    step = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return [step.view(np.uint8).reshape(-1, 8)[:, :6].T.copy()]


def _undeltas(planes: np.ndarray) -> np.ndarray:
    n = len(planes) // 6
    step = np.zeros((n, 8), np.uint8)
    step[:, :6] = planes.reshape(6, n).T
    return np.cumsum(step.reshape(-1).view("<u8"), dtype=np.uint64)


def _rows(numbers: list[int], kinds: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


BLOBS = "part long, kind int, blob binary"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(part, [(kind, blob)]) of rows sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, blob))
    if held:
        yield part, held


def _to_documents(key: np.ndarray, *values: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One blob for each partition of documents: keys and what belongs to them, sorted by key."""
    if not len(key):
        return
    part = np.mod(key, parts)
    order = np.lexsort((key, part))
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cuts[1:], len(part))
    blobs = [pack(key[order[a:b]], *(v[order[a:b]] for v in values)) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    yield _rows(part[cuts].tolist(), [0] * len(cuts), blobs)


# first pass: which hashes occur in more than one document?


def _send_hashes(buckets: int, parts: int, local_hot: int, twice: bool = False):
    """Kind 0: hashes with the key of their document; 1: hashes that are hot here; 2: hot hashes of documents, passed on.

    With ``twice``, hashes that one document holds twice go to its partition as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=CHUNK):
                texts = as_bytes(part.column("text"))
                key, at = np.unique(part.column("key").to_numpy(), return_index=True)
                scan = Scan([texts[i] for i in at.tolist()])
                if not len(scan.at):
                    continue
                pair = np.unique(np.stack((scan.hash, scan.doc.astype(np.uint64))), axis=1) if len(scan.at) < 1000 else _unique_pairs(scan.hash, scan.doc)
                h, d = pair[0], pair[1].astype(np.int64)
                if twice:
                    order = np.lexsort((scan.doc, scan.hash))
                    same = np.flatnonzero((np.diff(scan.hash[order]) == 0) & (np.diff(scan.doc[order]) == 0))
                    yield from ((lambda b: _rows(b.column("part").to_pylist(), [2] * b.num_rows, b.column("blob").to_pylist()))(b) for b in _to_documents(key[scan.doc[order[same]]], scan.hash[order[same]], parts=parts))
                new = np.flatnonzero(np.diff(h, prepend=_TOP))
                many = np.diff(np.append(new, len(h)))
                hot = np.repeat(many > local_hot, many)
                yield from ((lambda b: _rows(b.column("part").to_pylist(), [2] * b.num_rows, b.column("blob").to_pylist()))(b) for b in _to_documents(key[d[hot]], h[hot] | _HOT_BIT, parts=parts))
                marked = h[new[many > local_hot]]
                h, d = h[~hot], d[~hot]
                bucket = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                numbers, kinds, blobs = [], [], []
                for i in range(buckets):
                    own = order[edges[i] : edges[i + 1]]
                    if len(own):
                        docs, of = np.unique(d[own], return_inverse=True)
                        numbers.append(i)
                        kinds.append(0)
                        blobs.append(pack(*_deltas(h[own]), key[docs], of.astype("<u2" if len(docs) < 65536 else "<u4"), np.array([len(docs)], "<i8")))
                if len(marked):
                    at = (marked * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
                    for i in np.unique(at).tolist():
                        numbers.append(i)
                        kinds.append(1)
                        blobs.append(pack(marked[at == i]))
                if numbers:
                    yield _rows(numbers, kinds, blobs)

    return run


def _unique_pairs(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep].astype(np.uint64)


def _shared_hashes(parts: int, hot: int):
    """Blobs of a bucket -> blobs (keys, hashes) of the documents that share a hash; the top bit marks hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches):
            hs, ks, marked = [], [], [np.zeros(0, np.uint64)]
            for kind, blob in held:
                if kind == 2:
                    key, h = unpack(blob, "<i8", "<u8")
                    yield _rows([int(np.mod(key[0], parts))], [0], [blob])
                elif kind == 1:
                    marked.append(unpack(blob, "<u8")[0])
                else:
                    planes, docs, of, n = unpack(blob, "u1", "<i8", "u1", "<i8")
                    hs.append(_undeltas(planes))
                    ks.append(docs[of.view("<u2" if n[0] < 65536 else "<u4")])
            if not hs:
                continue
            h, key = np.concatenate(hs), np.concatenate(ks)
            h, key = _unique_pairs(h, key.view(np.uint64))
            key = key.view(np.int64)
            new = np.flatnonzero(np.diff(h, prepend=_TOP))
            many = np.diff(np.append(new, len(h)))
            warm = (many > hot) | np.isin(h[new], np.concatenate(marked))
            keep = np.repeat((many > 1) | warm, many)
            out = np.where(np.repeat(warm, many), h | _HOT_BIT, h)
            yield from _to_documents(key[keep], out[keep], parts=parts)

    return run


# second pass: contexts of shared anchors


def _send_texts(parts: int):
    """Texts for the partition of their key, many in a blob, each once for a chunk however many rows have it.

    Kind 1: keys and smallest ids; kind 2: keys, sizes, bytes, and the rows: place of the key, id, doc_id, whether there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_chunks(batch, limit=4 * CHUNK):
                ids, doc_id = rows.column("id").to_numpy(), rows.column("doc_id")
                known, doc_id = np.asarray(doc_id.is_valid()), doc_id.fill_null(0).to_numpy()
                texts = as_bytes(rows.column("text"))
                keys, at, of = np.unique(rows.column("key").to_numpy(), return_index=True, return_inverse=True)
                least = np.full(len(keys), NO_ID)
                np.minimum.at(least, of, ids)
                part = np.mod(keys, parts)
                by = np.argsort(part[of], kind="stable")
                edges = np.searchsorted(part[of][by], np.arange(parts + 1))
                for p in np.unique(part).tolist():
                    own, mine = np.flatnonzero(part == p), by[edges[p] : edges[p + 1]]
                    body = [texts[i] for i in at[own].tolist()]
                    sizes = np.array([len(t) for t in body], np.int64)
                    whole = pack(keys[own], sizes, np.frombuffer(b"".join(body), np.uint8), np.searchsorted(own, of[mine]), ids[mine], doc_id[mine], known[mine])
                    yield _rows([p, p], [1, 2], [pack(keys[own], least[own]), whole])

    return run


def _streams(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray], dict]]:
    """Of each partition in turn: the arrays sent to it (kind 0) sorted by key, its keys with their smallest ids (kind 1),
    and again and again a blob of texts (kind 2) unpacked."""
    part, held, least, blobs, names = None, [], (np.zeros(0, np.int64),) * 2, [], []
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if p != part:
                part, blobs, names, held = p, [], [], [np.zeros(0, k) for k in kinds]
            if kind == 0:
                blobs.append(unpack(blob, *kinds))
                continue
            if kind == 1:
                names.append(unpack(blob, "<i8", "<i8"))
                continue
            if blobs:
                joined = [np.concatenate(x) for x in zip(*blobs, strict=True)]
                order = np.argsort(joined[0], kind="stable")
                held, blobs = [x[order] for x in joined], []
            if names:
                key, low = (np.concatenate(x) for x in zip(*names, strict=True))
                order = np.lexsort((low, key))
                first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                least, names = (key[order[first]], low[order[first]]), []
            key, sizes, body, of, ids, doc_id, known = unpack(blob, "<i8", "<i8", "u1", "<i8", "<i8", "<i8", "?")
            ends, data = np.cumsum(sizes), body.tobytes()
            texts = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield held, least, {"key": key, "size": sizes, "texts": texts, "of": of, "id": ids, "doc_id": doc_id, "known": known}


def _distinct_texts(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]]:
    """The arrays of a partition, and keys, smallest ids and texts of about CHUNK bytes, each text of the partition once."""
    held, seen, waiting, size = [], set(), [], 0

    def flush():
        key = np.array([k for k, _, _ in waiting])
        return held, key, np.array([i for _, i, _ in waiting]), [t for _, _, t in waiting]

    last = None
    for arrays, least, rows in _streams(batches, *kinds):
        if least is not last:  # another partition
            if waiting:
                yield flush()
            held, last, seen, waiting, size = arrays, least, set(), [], 0
        ids = least[1][np.searchsorted(least[0], rows["key"])]
        for k, i, t in zip(rows["key"].tolist(), ids.tolist(), rows["texts"], strict=True):
            if k in seen:
                continue
            seen.add(k)
            waiting.append((k, i, t))
            size += len(t)
            if size >= CHUNK:
                yield flush()
                waiting, size = [], 0
    if waiting:
        yield flush()


def _ranges(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For wanted keys, the places in sorted ``keys`` and the number of the wanted key each belongs to."""
    lo, hi = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
    n = hi - lo
    of = np.repeat(np.arange(len(wanted)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), of


def _send_contexts(buckets: int, reach: tuple[int, int] = (LEFT, LENGTH), everything: bool = False):
    """Documents with their shared hashes -> blobs of contexts for the shards. Of equal contexts of a chunk the smallest
    document's goes as ``first``; the others ride along as covered places (kind 1), since they are repeats already, unless
    ``everything`` is to stand in the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, hashes), key, ids, texts in _distinct_texts(batches, "<i8", "<u8"):
            scan = Scan(texts)
            if not len(scan.at):
                continue
            spot, of = _ranges(keys, key)
            # (document, hash) pairs as one sortable number each: hashes are numbered first
            names = np.unique(np.concatenate((hashes[spot] & _HASH_BITS, scan.hash)))
            told = np.searchsorted(names, hashes[spot] & _HASH_BITS) * len(key) + of
            mine = np.searchsorted(names, scan.hash) * len(key) + scan.doc
            order = np.argsort(told, kind="stable")
            place = np.minimum(np.searchsorted(told, mine, sorter=order), max(len(told) - 1, 0))
            shared = (told[order[place]] == mine) if len(told) else np.zeros(len(mine), bool)
            hot = np.zeros(len(mine), bool)
            if len(told):
                warm = np.unique(told[(hashes[spot] & _HOT_BIT) > 0])
                hot = np.isin(mine, warm)
            which = np.flatnonzero(shared & ~hot)
            left, right, lc, rc = scan.contexts(which, reach)
            at, doc, name = scan.at[which], scan.doc[which], scan.hash[which]
            if hot.any():
                s, w, second = scan.windows(np.flatnonzero(hot))
                left = np.concatenate((left, np.zeros((len(s), LEFT), np.uint8)))
                # 127 bits of hash stand for a window's bytes, so these rows are short and equal only where windows are
                stand_in = np.zeros((len(s), LENGTH), np.uint8)
                stand_in[:, :8] = second.view(np.uint8).reshape(-1, 8)
                right = np.concatenate((right, stand_in))
                lc, rc = np.concatenate((lc, np.zeros(len(s), np.uint8))), np.concatenate((rc, np.full(len(s), LENGTH, np.uint8)))
                at, doc, name = np.concatenate((at, s)), np.concatenate((doc, np.searchsorted(scan.end, s, side="right"))), np.concatenate((name, w))
            if not len(at):
                continue
            pos = (at - scan.begin[doc]).astype(np.int64)
            whole = np.ascontiguousarray(np.concatenate((name.view(np.uint8).reshape(-1, 8), lc[:, None], rc[:, None], right, left), axis=1)).view(f"V{10 + sum(reach)}").ravel()
            _, alike = np.unique(whole, return_inverse=True)
            order = np.lexsort((pos, key[doc], ids[doc], alike))
            group = alike[order]
            lead = np.concatenate(([True], group[1:] != group[:-1]))
            least = ids[doc[order[np.flatnonzero(lead)]]][np.cumsum(lead) - 1]
            again = (ids[doc[order]] > least) & (not everything)
            yield from _covered(key[doc[order[again]]], (pos[order] - lc[order])[again], (pos[order] + rc[order])[again], buckets)
            # of a context's places in one document the first is sent, the others as places only
            own_key = key[doc[order]]
            first = lead | np.concatenate(([True], own_key[1:] != own_key[:-1]))
            send, more = order[first & ~again], np.bincount(np.cumsum(first) - 1, minlength=int(first.sum()))[~again[first]] - 1
            others = pos[order[~first & ~again]].astype("<i4")
            others_at = np.cumsum(more) - more
            bucket = (name[send] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64) % buckets
            by = np.lexsort((name[send], bucket))
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            numbers = np.flatnonzero(np.diff(edges)).tolist()
            blobs = []
            for i in numbers:
                part = by[edges[i] : edges[i + 1]]
                own, n = send[part], more[part]
                spots = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(others_at[part], n)
                blobs.append(pack(name[own], ids[doc[own]], key[doc[own]], pos[own].astype("<i4"), lc[own], rc[own], right[own], left[own], n.astype("<i4"), others[spots]))
            if numbers:
                yield _rows(numbers, [0] * len(numbers), blobs)

    return run


def _covered(key: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 1 blobs (keys, starts, ends) of places covered, overlaps merged."""
    keep = end - start >= LENGTH
    key, start, end = merge(key[keep], start[keep], end[keep])
    for b in _to_documents(key, start, end, parts=parts):
        yield _rows(b.column("part").to_pylist(), [1] * b.num_rows, b.column("blob").to_pylist())


def merge(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each key with those that overlap or touch joined, sorted."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    number = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + number * span)  # rises with every key
    new = np.concatenate(([True], (start + number * span)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], reach[last] - number[last] * span


# the shards


def _common(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first); counts: bytes that are there."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], np.minimum(first, np.minimum(counts[1:], counts[:-1]))))


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of at least ``least``, by a stack over ``lcp``.

    lcp[i] belongs to i - 1 and i. Every interval holds two members or more, and its members
    don't all go on alike: it is as long to the right as it can be.
    """
    stack: list[tuple[int, int]] = []  # (common prefix, first member), rising
    n = len(lcp)
    for i in range(1, n + 1):
        now, first = (lcp[i] if i < n else 0), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(names: np.ndarray, right: np.ndarray, rc: np.ndarray, left: np.ndarray, lc: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes right, members) of every maximal repeat of ``length`` bytes or more around anchors
    of one name, as far as the contexts show; members are all its occurrences."""
    words = np.pad(right, ((0, 0), (0, -right.shape[1] % 8))).view(">u8")
    order = np.lexsort((rc, *words.T[::-1], names))
    same = np.concatenate(([False], names[order][1:] == names[order][:-1]))
    lcp = np.where(same, _common(right[order], rc[order]), 0)
    most = left.shape[1]
    back = [int.from_bytes(x, "big") for x in np.ascontiguousarray(left).view(f"V{most}").ravel().tolist()]
    there = lc.tolist()
    members_of = order.tolist()
    alike = lambda x, y: min(there[x], there[y], most - (((back[x] ^ back[y]).bit_length() + 7) >> 3))
    for r, a, b in intervals(lcp.tolist(), max(1, length - most)):
        members = members_of[a : b + 1]
        if b - a == 1:
            common = alike(*members)
            if common + r >= length:
                yield common, r, members
            continue
        members.sort(key=lambda i: (back[i], there[i]))
        steps = [0, *(alike(x, y) for x, y in pairwise(members))]
        if (low := min(steps[1:])) == max(steps):  # one way to the left, or all different at once
            if low + r >= length:
                yield low, r, members
            continue
        # members that go on differently to the left: one repeat for each interval of left contexts
        for common, c, d in intervals([x + 1 for x in steps], 1):  # + 1: an empty left context is an interval too
            if common - 1 + r >= length:
                own = members[c : d + 1]
                # if all go on alike to the right, the longer interval has them
                if r == right.shape[1] or len({int(right[i, r]) if r < rc[i] else ~i for i in own}) > 1:
                    yield common - 1, r, own


def _search_shards(parts: int):
    """Blobs of a shard -> blobs (keys, starts, ends) of covered places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches):
            got = []
            for kind, blob in held:
                if kind == 1:
                    key = unpack(blob, "<i8", "<i8", "<i8")[0]
                    yield _rows([int(np.mod(key[0], parts))], [0], [blob])
                else:
                    got.append(unpack(blob, "<u8", "<i8", "<i8", "<i4", "u1", "u1", "u1", "u1", "<i4", "<i4"))
            if not got:
                continue
            name, ids, key, pos, lc, rc, right, left, more, others = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            right, left = right.reshape(-1, LENGTH), left.reshape(-1, LEFT)
            others_at = np.cumsum(more) - more
            id_of = ids.tolist()
            hits: list[list[int]] = [[], [], []]

            def covered():
                i, b, e = (np.array(x) for x in hits)
                n = more[i].astype(np.int64)
                spots = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(others_at[i], n)
                place = np.concatenate((pos[i], others[spots])).astype(np.int64)
                b, e, i = (np.concatenate((x, np.repeat(x, n))) for x in (b, e, i))
                for batch in _covered(key[i], place - b, place + e, parts):
                    yield _rows(batch.column("part").to_pylist(), [0] * batch.num_rows, batch.column("blob").to_pylist())

            for before, after, members in maximal_repeats(name, right, rc.astype(np.int64), left, lc.astype(np.int64)):
                low = min(id_of[i] for i in members)
                hit = [i for i in members if id_of[i] > low]
                hits[0] += hit
                hits[1] += [before] * len(hit)
                hits[2] += [after] * len(hit)
                if len(hits[0]) >= 200_000:  # nested repeats cover one place again and again
                    yield from covered()
                    hits = [[], [], []]
            if hits[0]:
                yield from covered()

    return run


def _groups_of(reach: tuple[int, int]):
    """Blobs of a shard -> its maximal repeats with all their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches):
            got = [unpack(blob, "<u8", "<i8", "<i8", "<i4", "u1", "u1", "u1", "u1", "<i4", "<i4") for kind, blob in held if kind == 0]
            if not got:
                continue
            name, ids, key, pos, lc, rc, right, left, more, others = (np.concatenate(x) for x in zip(*got, strict=True))
            right, left = right.reshape(-1, reach[1]), left.reshape(-1, reach[0])
            others_at = np.cumsum(more) - more
            texts, places = [], []
            for before, after, members in maximal_repeats(name, right, rc.astype(np.int64), left, lc.astype(np.int64)):
                i = members[0]
                texts.append(left[i, :before][::-1].tobytes() + right[i, :after].tobytes())
                spots = [(int(ids[m]), int(p) - before) for m in members for p in (pos[m], *others[others_at[m] : others_at[m] + more[m]])]
                places.append([{"doc_id": d, "start": p} for d, p in sorted(spots)])
                if len(texts) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(places, _PLACES)], ["repeat", "occurrences"])
                    texts, places = [], []
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(places, _PLACES)], ["repeat", "occurrences"])

    return run


_PLACES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64())]))


def repeat_groups(docs: DataFrame, reach: tuple[int, int] = (250, 250)) -> DataFrame:
    """``repeat BINARY, length, occurrences`` (doc_id, byte place): the maximal repeats of LENGTH bytes or more in the texts of
    ``docs``, each once with all its occurrences, also those in one document.

    A repeat is maximal as far as ``reach`` bytes (255 at most) left and right of an anchor show; a longer one comes as groups
    that overlap. Copies of a whole text stand in here once, under their smallest doc_id. Nothing is sent as a hash of a window
    and no member is left out, so this costs more than ``remove_repeats``, whose result follows from the same intervals.
    """
    rows, parts = _rows_of(docs)
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part", "kind")
    every = 1 << 60
    hashes = rows.select("key", "text").mapInArrow(_send_hashes(parts, parts, every, twice=True), BLOBS)
    shared = by_part(hashes).mapInArrow(_shared_hashes(parts, every), BLOBS)
    contexts = by_part(shared.unionByName(rows.mapInArrow(_send_texts(parts), BLOBS))).mapInArrow(_send_contexts(parts, reach, True), BLOBS)
    found = by_part(contexts).mapInArrow(_groups_of(reach), "repeat binary, occurrences array<struct<doc_id: long, start: long>>")
    # an anchor that stands there by what lies outside a repeat sees a part of its occurrences; one by a window inside sees all
    whole = found.where("size(occurrences) > 1").groupBy("repeat").agg(F.max_by("occurrences", F.size("occurrences")).alias("occurrences"))
    return whole.select("repeat", F.octet_length("repeat").alias("length"), "occurrences")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blobs of texts with: which rows are copies that go whole; starts and ends of what goes from each text, where those of a text begin, sums and counts."""
    for (keys, starts, ends), least, rows in _streams(batches, "<i8", "<i8", "<i8"):
        key, of, size = rows["key"], rows["of"], rows["size"]
        copy = (rows["id"] > least[1][np.searchsorted(least[0], key)][of]) & (size[of] >= LENGTH)
        spot, doc = _ranges(keys, key)
        doc, start, end = merge(doc, starts[spot], ends[spot])
        removed = np.bincount(doc, weights=end - start, minlength=len(key)).astype(np.int64)
        yield rows, copy, start, end, np.searchsorted(doc, np.arange(len(key) + 1)), removed, np.bincount(doc, minlength=len(key))


def _left_over(text: bytes, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
    at = 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        yield text[at:s]
        at = e
    yield text[at:]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's result: a copy of a text with a smaller id goes whole, other rows lose what is covered."""
    nothing = hashlib.sha256().hexdigest()
    for rows, copy, start, end, first, removed, spans in _decided(batches):
        of, size = rows["of"], rows["size"]
        shas: dict[int, str] = {}
        for i in np.unique(of[~copy]).tolist():
            sha = hashlib.sha256()
            for piece in _left_over(rows["texts"][i], start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]):
                sha.update(piece)
            shas[i] = sha.hexdigest()
        kept = [nothing if c else shas[i] for c, i in zip(copy.tolist(), of.tolist(), strict=True)]
        columns = [pa.array(rows["doc_id"], mask=~rows["known"]), pa.array(size[of]), pa.array(np.where(copy, size[of], removed[of])), pa.array(np.where(copy, 1, spans[of]).astype(np.int64)), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _texts_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, copy, start, end, first, _, _ in _decided(batches):
        kept, gone = [], []
        for c, i in zip(copy.tolist(), rows["of"].tolist(), strict=True):
            own = slice(first[i], first[i + 1])
            kept.append(b"" if c else b"".join(_left_over(rows["texts"][i], start[own], end[own])))
            gone.append([{"start": 0, "end": int(rows["size"][i])}] if c else [{"start": s, "end": e} for s, e in zip(start[own].tolist(), end[own].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], mask=~rows["known"]), pa.array(kept, pa.binary()), pa.array(gone, _SPANS)], ["doc_id", "kept", "removed"])


def _rows_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, id, text, key`` of the rows and the number of partitions; the key names a text (see ``text_key``)."""
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", text_key(rows)), max(8, 3 * max(1, docs.rdd.getNumPartitions()))  # about a third of an input split's text in each


def _covered_texts(docs: DataFrame, local_hot: int | None, hot: int) -> DataFrame:
    """Blobs of covered places and of texts, side by side."""
    rows, parts = _rows_of(docs)
    local_hot = max(LOCAL_HOT, 3 * hot // (8 * parts)) if local_hot is None else local_hot
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part", "kind")
    texts = rows.mapInArrow(_send_texts(parts), BLOBS)
    hashes = rows.select("key", "text").mapInArrow(_send_hashes(parts, parts, local_hot), BLOBS)
    shared = by_part(hashes).mapInArrow(_shared_hashes(parts, hot), BLOBS)
    contexts = by_part(shared.unionByName(texts)).mapInArrow(_send_contexts(parts), BLOBS)
    covered = by_part(contexts).mapInArrow(_search_shards(parts), BLOBS)
    return by_part(covered.unionByName(texts))


def remove_repeats(docs: DataFrame, local_hot: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``texts_kept`` keeps.

    A byte goes if a string of LENGTH bytes over it also starts in a row with a smaller doc_id.
    A null text is empty. Rows without a doc_id count as larger than all others, and none of them
    as smaller than another; rows with one doc_id never shorten each other, whatever their texts.
    Rows repeat as they do in the input; other columns are ignored.
    """
    return _covered_texts(docs, local_hot, hot).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def texts_kept(docs: DataFrame, local_hot: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, kept BINARY (the bytes left, which may begin or end inside a character), removed (places in bytes)."""
    return _covered_texts(docs, local_hot, hot).mapInArrow(_texts_kept, "doc_id long, kept binary, removed array<struct<start: long, end: long>>")
