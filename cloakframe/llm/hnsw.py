"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Equal vectors are one node with its smallest ids, so copies never crowd a graph. A shard's
vectors get one more component that brings all to the same length, which turns the largest
inner product into the smallest distance. The graph is kept as flat arrays: for every level the
nodes on it and, in rows of equal width, the numbers of their neighbours (-1: none). Nodes go in
by batches: each batch is searched as a whole in the graph so far and within itself, gets its
neighbours by the diversity rule, and the neighbours' own rows are selected anew. Every block of
queries is searched in every shard, with found nodes scored again in double precision on the
original vectors, and the shards' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut

WIDTH, EF_BUILD, EF_SEARCH, BATCH, QUERY_BLOCK = 16, 64, 320, 256, 512
#: Distinct vectors of a shard. Every query visits every shard, so few large ones are cheaper; a larger one needs a wider search
#: for the same recall (measured over 51,282 vectors: four shards at a width of 160 find 0.970, one finds 0.859).
SHARD = 16_384
#: Lengths of vectors up to which their shard counts are sent to every task.
MOST_LENGTHS = 10_000


class Graph:
    """Levels from the ground: nodes on the level (sorted) and their neighbour rows."""

    def __init__(self, nodes: list[np.ndarray], rows: list[np.ndarray], entry: int):
        self.nodes, self.rows, self.entry = nodes, rows, entry
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []

    def prepared(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the place of every node among its rows (-1: not there) and the rows, with a last one of no neighbours."""
        if not self.steps:
            for nodes, rows in zip(self.nodes, self.rows, strict=True):
                place = np.full(n + 1, -1, np.int32)
                place[nodes] = np.arange(len(nodes))
                self.steps.append((place, np.concatenate((rows, np.full((1, rows.shape[1]), -1))).astype(np.int32)))
        return self.steps

    def pack(self) -> tuple[bytes, list[int], int]:
        flat = np.concatenate([np.concatenate((n, r.ravel())) for n, r in zip(self.nodes, self.rows, strict=True)]) if self.nodes else np.zeros(0)
        return flat.astype("<i4").tobytes(), [len(n) for n in self.nodes], self.entry

    @staticmethod
    def unpack(data: bytes, sizes: list[int], entry: int) -> Graph:
        flat, at, nodes, rows = np.frombuffer(data, "<i4").astype(np.int64), 0, [], []
        for level, n in enumerate(sizes):
            w = 2 * WIDTH if level == 0 else WIDTH
            nodes.append(flat[at : at + n])
            rows.append(flat[at + n : at + n + n * w].reshape(n, w))
            at += n + n * w
        return Graph(nodes, rows, entry)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component, all of one length."""
    norms = (vectors * vectors).sum(axis=1)
    rest = np.sqrt(np.maximum(0.0, norms.max() - norms))
    return np.ascontiguousarray(np.concatenate((vectors, rest[:, None]), axis=1).astype(np.float32))


def beam(x: np.ndarray, neighbours, queries: np.ndarray, starts: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``ef`` likest nodes reached from its starts: ids (-1: none) and products, likest first.

    ``neighbours(ids)`` gives the rows of nodes. All queries advance together; each step opens
    the four likest unopened nodes of every query that has any.
    """
    b, step = len(queries), 4
    ids = np.full((b, ef), -1)
    score = np.full((b, ef), -np.inf, np.float32)
    opened = np.zeros((b, ef), bool)
    k = min(ef, starts.shape[1])
    ids[:, :k] = starts[:, :k]
    first = np.einsum("bkd,bd->bk", x[ids[:, :k]], queries)
    score[:, :k] = np.where(ids[:, :k] >= 0, first, -np.inf)
    seen = np.zeros((b, n + 1), bool)  # the last column takes what is no node
    seen[np.arange(b)[:, None], ids[:, :k]] = True
    live = np.arange(b)
    while len(live):
        open_score = np.where(opened[live] | (ids[live] < 0), -np.inf, score[live])
        pick = np.argpartition(-open_score, min(step, ef) - 1, axis=1)[:, :step]
        good = np.take_along_axis(open_score, pick, 1) > -np.inf
        go = good.any(axis=1)
        live, pick, good = live[go], pick[go], good[go]
        if not len(live):
            break
        opened[live[:, None], pick] |= good
        near = neighbours(np.where(good, ids[live[:, None], pick], -1)).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        seen[live[:, None], near] = True
        seen[:, -1] = False
        near = np.sort(near, axis=1)  # a node may come from two of the opened ones
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.sort(near, axis=1)[:, near.shape[1] - max(1, int((near >= 0).sum(axis=1).max())) :]
        row, col = np.nonzero(near >= 0)  # most neighbours were seen before
        got = np.full(near.shape, -np.inf, np.float32)
        got[row, col] = np.einsum("nd,nd->n", x[near[row, col]], queries[live[row]])
        all_ids = np.concatenate((ids[live], near), axis=1)
        all_score = np.concatenate((score[live], got), axis=1)
        all_open = np.concatenate((opened[live], np.zeros_like(near, bool)), axis=1)
        top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        ids[live] = np.where(np.take_along_axis(all_score, top, 1) > -np.inf, np.take_along_axis(all_ids, top, 1), -1)
        score[live] = np.take_along_axis(all_score, top, 1)
        opened[live] = np.take_along_axis(all_open, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def diverse(x: np.ndarray, own: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (-1: none) up to ``width``: those likelier to the row's own vector than to any
    chosen before, then the likest of the rest."""
    score = np.where(ids >= 0, np.einsum("bkd,bd->bk", x[ids], own), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    b, k = ids.shape
    vectors = x[ids]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    chosen = np.zeros((b, k), bool)
    count = np.zeros(b, int)
    for c in range(k):
        rival = np.where(chosen, between[:, c, :], -np.inf).max(axis=1)
        take = (ids[:, c] >= 0) & (score[:, c] > rival) & (count < width)
        chosen[:, c] = take
        count += take
    rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, rank, 1)
    return out if out.shape[1] == width else np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """The graph over ``vectors`` (n, d); the same vectors in the same order give the same graph."""
    n = len(vectors)
    if not n:
        return Graph([], [], -1)
    x = lifted(vectors)
    x = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))  # number -1 is no node
    draw = np.random.default_rng(seed).random(n)
    level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(WIDTH)).astype(int), 8)
    level[0] = max(level)  # the first node is the entry
    links = [np.full((n + 1, 2 * WIDTH if h == 0 else WIDTH), -1) for h in range(level[0] + 1)]
    at, size = 1, 1
    while at < n:
        batch = np.arange(at, min(n, at + size))
        q = x[batch]
        starts = np.zeros((len(batch), 1), int)
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        for h in range(level[0], -1, -1):
            rows = links[h]
            on = level[batch] >= h
            ids, _ = beam(x, rows.__getitem__, q, starts, EF_BUILD if on.any() else 4, n)
            if on.any():
                w = rows.shape[1]
                peers = np.where(on[None, :] & np.isfinite(inside), inside, -np.inf)
                near = np.argsort(-peers, axis=1, kind="stable")[:, :WIDTH]
                mates = np.where(np.take_along_axis(peers, near, 1) > -np.inf, batch[near], -1)
                mine = batch[on]
                picked = diverse(x, q[on], np.concatenate((ids, mates), axis=1)[on], WIDTH)
                rows[mine, :WIDTH] = picked
                # back links: new ones side by side for each neighbour, whose row is then chosen anew
                u, v = np.repeat(mine, WIDTH), picked.ravel()
                u, v = u[v >= 0], v[v >= 0]
                order = np.argsort(v, kind="stable")
                u, v = u[order], v[order]
                who, begin, many = np.unique(v, return_index=True, return_counts=True)
                new = np.full((len(who), many.max(initial=1)), -1)
                slot = np.arange(len(v)) - np.repeat(begin, many)
                new[np.repeat(np.arange(len(who)), many), slot] = u
                for i in range(0, len(who), 512):
                    part = who[i : i + 512]
                    both = np.concatenate((rows[part], new[i : i + 512]), axis=1)
                    both = np.sort(both, axis=1)
                    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                    both = -np.sort(-both, axis=1)[:, : max(w, int((both >= 0).sum(axis=1).max()))]
                    full = (both >= 0).sum(axis=1) > w
                    kept = both[:, :w] if both.shape[1] >= w else np.pad(both, ((0, 0), (0, w - both.shape[1])), constant_values=-1)
                    if full.any():
                        kept[full] = diverse(x, x[part[full]], both[full], w)
                    rows[part] = kept
            starts = np.where(ids >= 0, ids, ids[:, :1])
        at += len(batch)
        size = min(2 * size, BATCH)
    nodes = [np.flatnonzero(level >= h) for h in range(level[0] + 1)]
    return Graph(nodes, [links[h][nodes[h]] for h in range(level[0] + 1)], 0)


def search(graph: Graph, x: np.ndarray, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
    """For each query the numbers of up to ``ef`` nodes, likest first (-1: none). ``x``: ``searchable`` vectors."""
    n = len(x) - 1
    q = queries.astype(np.float32)
    starts = np.full((len(q), 1), graph.entry)
    ids = starts
    for h in range(len(graph.nodes) - 1, -1, -1):
        place, rows = graph.prepared(n)[h]
        ids, _ = beam(x, lambda i, r=rows, p=place: r[p[i]], q, starts, ef if h == 0 else 8, n)
        starts = np.where(ids >= 0, ids, ids[:, :1])
    return ids


def searchable(vectors: np.ndarray) -> np.ndarray:
    """The vectors in single precision, with a last one that stands for no node."""
    return np.concatenate((vectors, np.zeros((1, vectors.shape[1])))).astype(np.float32)


INDEX = "shard string, n int, d int, vectors binary, members array<array<bigint>>, graph binary, sizes array<int>, entry int"


def _build_shard(table: pa.Table) -> pa.Table:
    held = table.column("v").combine_chunks()
    vectors = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
    data, sizes, entry = build(vectors).pack()
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()]), "n": pa.array([len(vectors)], pa.int32()), "d": pa.array([vectors.shape[1]], pa.int32()), "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
        "members": pa.array([table.column("members").to_pylist()], pa.list_(pa.list_(pa.int64()))), "graph": pa.array([data], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "entry": pa.array([entry], pa.int32()),
    })


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v ARRAY<DOUBLE>`` of rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(fine)


def distinct_nodes(rows: DataFrame, keep: int) -> DataFrame:
    """``v, members`` of ``rows`` (vec_id, v): equal vectors once, with their ``keep`` smallest ids."""
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def shard_counts(nodes: DataFrame, shard_size: int) -> DataFrame:
    """``d, k``: number of shards by length of the vectors; only vectors of one length are comparable."""
    return nodes.groupBy(F.size("v").alias("d")).agg(F.ceil(F.count("*") / shard_size).cast("int").alias("k"))


def build_index(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """INDEX rows over ``nodes``, dealt by length and hash."""
    dealt = nodes.withColumn("d", F.size("v")).join(counts, "d").withColumn("shard", F.format_string("%d-%d", "d", F.expr("pmod(xxhash64(v), k)")))
    return dealt.select("shard", "v", "members").groupBy("shard").applyInArrow(_build_shard, INDEX)


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """``d, ids, vectors`` with ``block`` queries of one length or fewer in a row, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()
            by_d: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_d.setdefault(len(v), []).append(i)
            for d, at in by_d.items():
                for i in range(0, len(at), block):
                    part = at[i : i + block]
                    yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "ids": pa.array([[ids[j] for j in part]], pa.list_(pa.int64())), "vectors": pa.array([np.array([vectors[j] for j in part], "<f8").tobytes()], pa.binary())})

    return queries.mapInArrow(run, "d int, ids array<bigint>, vectors binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_size: int = SHARD, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner products.

    Both tables have vec_id and embedding. A candidate with the query's id is its own; of rows with
    one id the likest counts. Ties go to the smaller vec_id. With fewer candidates all come back.
    Vectors are compared with those of their own length, however many lengths there are; rows that
    are null, zero or hold null or non-finite components take no part. Other columns are ignored.
    """
    nodes = cut(distinct_nodes(usable(vectors), k + 1))
    counts = cut(shard_counts(nodes, shard_size))
    if counts.count() <= MOST_LENGTHS:  # nearly always one row: a join on the length would deal all rows to one task
        counts = F.broadcast(counts)
    index = build_index(nodes, counts)
    blocks = query_blocks(usable(queries)).join(counts, "d")
    blocks = blocks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("shard", F.format_string("%d-%d", "d", "_s"))
    nothing = {"n": "int", "members": "array<array<bigint>>", "graph": "binary", "sizes": "array<int>", "entry": "int"}
    asked = blocks.select("shard", F.lit(1).alias("kind"), "d", "vectors", "ids", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    held = index.select("shard", F.lit(0).alias("kind"), "d", "vectors", F.lit(None).cast("array<bigint>").alias("ids"), *nothing)
    both = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, graph, x, x32, members = None, None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("shard", "kind", "d", "vectors", "ids")}
                block = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["d"])
                if row["kind"] == 0:
                    name, x = row["shard"], block
                    members = batch.column("members")[r].as_py()
                    graph, x32 = Graph.unpack(*(batch.column(c)[r].as_py() for c in ("graph", "sizes", "entry"))), searchable(x)
                    continue
                if name != row["shard"]:
                    raise ValueError("queries came before their shard")
                out = []
                for i in range(0, len(block), BATCH):
                    q = block[i : i + BATCH]
                    found = search(graph, x32, q, ef)
                    for query_id, vector, ids in zip(row["ids"][i : i + BATCH], q, found, strict=True):
                        ids = ids[ids >= 0]
                        score = x[ids] @ vector
                        best: dict[int, float] = {}
                        for j in np.lexsort((ids, -score)):
                            if len(best) >= k and score[j] < least:
                                break
                            for m in members[ids[j]]:
                                if m != query_id:
                                    best.setdefault(m, float(score[j]))
                            least = score[j] if len(best) < k else sorted(best.values(), reverse=True)[k - 1]
                        out += [(query_id, m, s) for m, s in sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
