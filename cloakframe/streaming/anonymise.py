"""Documents as a stream: each micro-batch runs against the registry that the ones before left.

Not part of the reference's features. The registry is a table of changes beside the output, one partition for each batch,
written before the batch's documents; what holds is the last change of an original. A batch that is run again finds its own
partition replaced and gives the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry
from ..plans.anonymise import Config, anonymise

_COLUMNS = [c.split()[0] for c in registry.REGISTRY.split(", ")]


def read_registry(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The registry as the batches before ``before`` (all, if null) left it."""
    rows = spark.read.schema(f"{registry.REGISTRY}, epoch long").parquet(f"{path}/registry")
    if before is not None:
        rows = rows.where(F.col("epoch") < before)
    last = rows.groupBy("original_lc").agg(F.max_by(F.struct(*_COLUMNS), "epoch").alias("r"))
    return last.select("r.*")


def start(stream: DataFrame, path: str, config: Config | None = None, entries: DataFrame | None = None, retired: DataFrame | None = None, **options) -> StreamingQuery:
    """Anonymises a stream of (doc_ord, region_ord, text) into ``path/documents``. ``entries`` are taken over on the first start;
    the numbers of ``retired`` are never given again."""
    spark = stream.sparkSession
    (entries if entries is not None else registry.empty(spark)).select(*_COLUMNS).write.mode("ignore").parquet(f"{path}/registry/epoch=-1")

    def batch(rows: DataFrame, epoch: int) -> None:
        old = read_registry(rows.sparkSession, path, epoch)
        done = anonymise(rows, config, entries=old, retired=retired)
        same = old.select("original_lc", "placeholder", F.col("count").alias("_count"))
        changed = done.registry.join(same, ["original_lc", "placeholder"], "left").where("_count IS NULL OR _count <> count")
        changed.select(*_COLUMNS).write.mode("overwrite").parquet(f"{path}/registry/epoch={epoch}")
        done.documents.select("doc_ord", "region_ord", "anonymised").write.mode("overwrite").parquet(f"{path}/documents/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").start(**options)
