"""N-best SentencePiece segmentation and decoding.

A text, with one space put before it, is covered by pieces of a fixed vocabulary (the meta
symbol of a piece stands for a space); a character that no piece covers falls back to its UTF-8
bytes at the score ``lowest - 10``. Forward Viterbi finds the best score to every position;
a backward A* search from the end then uses those scores as exact heuristics, so paths leave
its queue best first. No piece holds a space behind another character or a line break, so the
lattice of a text falls into independent chunks: distinct chunks are solved once, many at a
time, and the texts' N best are merged from the chunks whose second-best lies nearest.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, text_chunks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Chunks up to this length are solved many at a time, longer ones one by one.
WIDE, REMEMBERED = 40, 200_000
_CHUNK = re.compile(r" *[^ \n]+| +|\n+")


class Vocabulary:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces: dict[str, tuple[float, int]] = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.raw[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i).replace("▁", " ")
                self.pieces[p] = (float(sp.get_score(i)), i)
                self.raw[i] = p.encode()
        if len(self.bytes_id) != 256:
            raise ValueError("the vocabulary has no byte pieces, so texts could not be restored")
        self.unknown = min((s for s, _ in self.pieces.values()), default=0.0) - 10
        self.longest = max(map(len, self.pieces), default=1)
        self.cuts = not any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces)
        # a trie as sorted keys (node << 21 | code point) -> next node; piece of a node or -1
        nodes = {"": 0}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        pairs = sorted(((nodes[p[:-1]] << 21) | ord(p[-1]), x) for p, x in nodes.items() if p)
        self.edge = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([x for _, x in pairs], np.int64)
        self.id_of = np.full(len(nodes), -1, np.int64)
        self.score_of = np.zeros(len(nodes))
        for p, (s, i) in self.pieces.items():
            self.id_of[nodes[p]], self.score_of[nodes[p]] = i, s

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return _CHUNK.findall(" " + text) if self.cuts else [" " + text]

    def fallback(self, ch: str) -> list[int]:
        return [self.bytes_id[b] for b in ch.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    # one chunk at a time

    def lattice(self, s: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """Edges (start, score, id or -1 for fallback) by their end, and the best forward score of each position."""
        n, pieces, longest = len(s), self.pieces, self.longest
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            alone = False
            for j in range(i + 1, min(n, i + longest) + 1):
                if hit := pieces.get(s[i:j]):
                    ends[j].append((i, *hit))
                    alone = alone or j == i + 1
            if not alone:
                ends[i + 1].append((i, self.unknown, -1))
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max(best[i] + v for i, v, _ in ends[j])
        return ends, best

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one chunk, best first, by backward A*; ties: the longer last pieces first."""
        if not s:
            return [(0.0, ())]
        ends, best = self.lattice(s)
        out: list[tuple[float, tuple[int, ...]]] = []
        # (-(best forward score + score so far), order of arrival, position, score so far, rest of the path)
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], 0, len(s), 0.0, None)]
        arrived = 0
        while queue and len(out) < n:
            _, _, j, g, path = heapq.heappop(queue)
            if not j:
                ids: list[int] = []
                while path:
                    (a, b, i), path = path
                    ids += [i] if i >= 0 else self.fallback(s[a:b])
                out.append((g, tuple(ids)))
                continue
            for i, v, piece in ends[j]:
                arrived += 1
                heapq.heappush(queue, (-(best[i] + v + g), arrived, i, g + v, ((i, j, piece), path)))
        return out

    # many chunks of one length at a time

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
        """Best score, gap to the second-best (inf: none) and ids of words of one length."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.int64)
        forward = np.full((n, size + 1), -np.inf)
        forward[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        via = np.zeros((n, size + 1), np.int64)
        edges = []
        for i in range(size):
            rows, node = np.arange(n), np.zeros(n, np.int64)
            alone = np.zeros(n, bool)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                key = (node << 21) | codes[rows, j - 1]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                ok = self.edge[at] == key
                rows, node = rows[ok], self.to[at[ok]]
                if not len(rows):
                    break
                hit = self.id_of[node] >= 0
                if hit.any():
                    edges.append((i, j, rows[hit], self.score_of[node[hit]], self.id_of[node[hit]]))
                    if j == i + 1:
                        alone[rows[hit]] = True
            if not alone.all():
                miss = np.flatnonzero(~alone)
                edges.append((i, i + 1, miss, np.full(len(miss), self.unknown), np.full(len(miss), -1)))
            # starts rise, so forward[:, i] is final when its edges leave
            for a, j, r, v, piece in edges[::-1]:
                if a != i:
                    break
                score = forward[r, i] + v
                up = score > forward[r, j]
                forward[r[up], j], back[r[up], j], via[r[up], j] = score[up], i, piece[up]
        backward = np.full((n, size + 1), -np.inf)
        backward[:, size] = 0
        for i, j, r, v, _ in reversed(edges):
            np.maximum.at(backward[:, i], r, v + backward[r, j])
        on = np.zeros((n, size + 1), bool)  # ends of the best path
        where, paths = np.full(n, size), []
        while (live := np.flatnonzero(where > 0)).size:
            w = where[live]
            on[live, w] = True
            paths.append((live, via[live, w], w))
            where[live] = back[live, w]
        second = np.full(n, -np.inf)
        for i, j, r, v, piece in edges:
            other = ~(on[r, j] & (back[r, j] == i) & (via[r, j] == piece))
            np.maximum.at(second, r[other], forward[r[other], i] + v[other] + backward[r[other], j])
        ids: list[list[int]] = [[] for _ in range(n)]
        for live, piece, w in reversed(paths):
            for k, p, j in zip(live.tolist(), piece.tolist(), w.tolist(), strict=True):
                if p >= 0:
                    ids[k].append(p)
                else:
                    ids[k] += self.fallback(words[k][j - 1])
        best = forward[:, size]
        return best, best - second, [tuple(x) for x in ids]

    def solve(self, words: list[str]) -> list[tuple[float, float, tuple[int, ...]]]:
        """(best score, gap to the second-best, ids) of each word, in order."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, at in by_size.items():
            if size <= WIDE:
                for i in range(0, len(at), 8_000):
                    part = at[i : i + 8_000]
                    for k, *got in zip(part, *self._solve([words[k] for k in part]), strict=True):
                        out[k] = tuple(got)
            else:
                for k in at:
                    two = self.nbest(words[k], 2)
                    out[k] = (two[0][0], two[0][0] - two[1][0] if len(two) > 1 else float("inf"), two[0][1])
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts and remembers solved chunks, up to a fixed count."""

    def __init__(self, words: Vocabulary, n: int):
        self.vocabulary, self.n = words, n
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.score = np.zeros(0)
        self.gap = np.zeros(0)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.names: list[str] = []
        self.others: dict[int, list[tuple[float, tuple[int, ...]]]] = {}

    def learn(self, new: list[str]) -> None:
        solved = self.vocabulary.solve(new)
        self.names += new
        self.score = np.concatenate((self.score, [s for s, _, _ in solved]))
        self.gap = np.concatenate((self.gap, [g for _, g, _ in solved]))
        counts = np.cumsum([len(i) for _, _, i in solved])
        self.start = np.concatenate((self.start, self.start[-1] + counts))
        self.ids = np.concatenate((self.ids, np.array([x for _, _, i in solved for x in i], np.int32)))

    def alternatives(self, k: int) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of chunk k besides its best, by A*."""
        if (got := self.others.get(k)) is None:
            own = tuple(self.ids[self.start[k] : self.start[k + 1]].tolist())
            paths = self.vocabulary.nbest(self.names[k], self.n)
            got = [(self.score[k] - s, i) for s, i in paths if i != own][: self.n - 1]
            self.others[k] = got
        return got

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float, list]]:
        """(ids, score, alternatives) of each text; an alternative: score, [(first piece, pieces replaced, ids)]."""
        if len(self.place) > REMEMBERED:
            self.clear()
        place, known, sequences = self.place, len(self.place), []
        for t in texts:
            sequences.append(np.array([place.setdefault(c, len(place)) for c in self.vocabulary.chunks(t)], np.int64))
        if len(place) > known:
            new = list(place)[known:]
            self.learn(new)
        return [self._text(seq) for seq in sequences]

    def _text(self, seq: np.ndarray) -> tuple[np.ndarray, float, list]:
        first, count = self.start[seq], self.start[seq + 1] - self.start[seq]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(seq) else 0
        ids = self.ids[np.repeat(first - (ends - count), count) + np.arange(total)]
        score = float(self.score[seq].sum())
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        gap = self.gap[seq]
        m = min(self.n - 1, len(seq))
        if m > 0:
            near = np.argpartition(gap, m - 1)[:m] if m < len(seq) else np.arange(len(seq))
            for at in sorted(near[np.isfinite(gap[near])].tolist()):
                options = self.alternatives(int(seq[at]))
                spot = int(ends[at] - count[at]), int(count[at])
                more = [(d + loss, (*changes, (*spot, other))) for d, changes in combos for loss, other in options]
                combos = sorted(combos + more, key=lambda c: (c[0], c[1]))[: self.n]
        return ids, score, [(score - d, changes) for d, changes in combos if changes]


_ALTERNATIVE = pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
OUTPUT = "ids array<int>, n_pieces bigint, score double, alternatives array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>, restored boolean"


def encode_texts(rows: DataFrame, text: str = "text", model_path: str = MODEL_PATH, n: int = N_BEST) -> DataFrame:
    """``rows`` without ``text``, with OUTPUT: ids of the best segmentation, its score, and the next best.

    An alternative lists what differs from the best: ``n`` pieces from place ``at`` become ``ids``.
    ``restored`` says that decoding gives the text back, which holds for every text: null counts as
    empty, and an empty text has no pieces and no alternatives. Texts are never cut. Of segmentations with one score the one
    found first counts: fewer characters in its last piece. Columns of ``rows`` with a name of OUTPUT give way to it.
    """
    new = [f.name for f in T.StructType.fromDDL(OUTPUT).fields]
    others = [c for c in rows.columns if c != text and c.lower() not in new]
    body = rows.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text).cast("string").alias("_text"))
    encoders: dict[tuple[str, int], Encoder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.setdefault((model_path, n), Encoder(vocabulary(model_path), n))
        for batch in batches:
            for part in text_chunks(batch, "_text", 1_000_000):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                got = encoder.encode(texts)
                lens = np.array([len(i) for i, _, _ in got], np.int64)
                flat = np.concatenate([i for i, _, _ in got]) if got else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(flat.astype(np.int32)))
                others = [[{"score": s, "changes": [{"at": a, "n": c, "ids": i} for a, c, i in changes]} for s, changes in alt] for _, _, alt in got]
                restored = [encoder.vocabulary.decode(i.tolist()) == t for (i, _, _), t in zip(got, texts, strict=True)]
                columns = [ids, pa.array(lens), pa.array([s for _, s, _ in got], pa.float64()), pa.array(others, pa.list_(_ALTERNATIVE)), pa.array(restored, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], "ids", "n_pieces", "score", "alternatives", "restored"])

    done = body.mapInArrow(lean(run), T.StructType([*body.schema.fields[:-1], *T.StructType.fromDDL(OUTPUT).fields]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in others], *new)


def decode_ids(rows: DataFrame, ids: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``rows`` with ``decoded``: the text of each array of ids (null for null); a column of that name gives way."""
    rows = rows.select(*[c for c in rows.columns if c.lower() != "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model_path)
        for batch in batches:
            texts = [None if i is None else words.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
