"""Connected components over an edge DataFrame.

Large-star / small-star contraction: every round is two grouped minimums, so no
neighbourhood is ever collected, and the number of rounds grows with the logarithm
of the component size. Each round is cut with ``checkpoint()`` in the session's
shared checkpoint folder, so a lost executor costs one round at most. Up to FEW edges
are settled by one task without rounds, which would cost the driver a plan each.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines must share. Where it is unset, a temporary one serves a session
    whose tasks run in the driver's own process; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="ckpt")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def trim_driver(spark: SparkSession) -> bool:
    """The driver's JVM gives freed native memory back to the system; the C library keeps it in the arenas of hundreds of threads
    (planning, compiling, exchanges), more with every plan. False where the JVM has no such command (before 17.0.9, or not Linux)."""
    java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
    kinds, args = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = java.Class.forName(kind)
    args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface: the server's own class can't be called from outside its module
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` with the folder ensured."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Edges that one task settles.
FEW = 50_000


def _stars(edges: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    """Stars that connect the same nodes as the edges, each node with the smallest it reaches."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    return pa.RecordBatch.from_pydict(
        {"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())}
    )


def _edges(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by stars that connect the same nodes."""
    for batch in batches:
        yield _stars(_edges(batch))


def _contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _stars(e for batch in batches for e in _edges(batch))


def _by_star(e: DataFrame) -> DataFrame:
    """``(node, component)`` from edges (u, v) of which each is a node and the smallest of its component."""
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node on an edge; component = smallest node reachable.

    Both columns must be LONG. Null ends and self loops carry no link and are ignored, and
    repeated edges count once. An empty input gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.mapInArrow(_contract_batches, "u long, v long").distinct())
    if e.count() <= FEW:
        return _by_star(cut(e.coalesce(1).mapInArrow(_contract_all, "u long, v long")))
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        trim_driver(e.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return _by_star(e)
