"""Secret scans over a blob ledger, in DataFrame and SQL functions only.

Every historical version is addressed by the SHA-256 of its text. The ledger holds what each
(blob, rule, rule version) gave; a run scans a blob only with the rules for which no such pair
is known, appends those results to the ledger's Parquet table, and joins findings back to every
path and version that held the blob.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ensure_checkpoint_dir
from .spans import listed, matches, placed, quoted

#: kind: (version, pattern, SQL of what a match x.t must satisfy). The first three are the base kinds.
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?+"
RULES: dict[str, tuple[int, str, str]] = {
    "assign": (1, _ASSIGN + r"[A-Za-z0-9+/_.=-]++", f"length(regexp_replace(x.t, {quoted('^' + _ASSIGN)}, '')) >= 6"),
    "access": (1, r"AKIA[A-Z0-9]{16,}+", "true"),
    "hex": (1, r"(?<![0-9a-f])[0-9a-f]{24,}+", "true"),
    "private_key": (1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
    "host_token": (1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", "true"),
    "chat_token": (1, r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+", "true"),
    "web_token": (1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+", "true"),
}
KINDS = list(RULES)
BASE = KINDS[:3]
LEDGER = "blob string, rule string, version int, spans array<struct<s: int, k: int, e: int>>"


def address(text: str = "text"):
    """The blob address of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """``blob, text`` once for each distinct text. Copies within a task merge before the shuffle."""
    return versions.select(address(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).dropDuplicates(["blob"])


def scan(unseen: DataFrame) -> DataFrame:
    """``blob, todo, found``: spans of the rules named in ``todo`` over ``text``, array<struct<s,k,e>>."""
    body = unseen.withColumns({f"_m_{k}": F.expr(f"CASE WHEN array_contains(todo, '{k}') THEN {matches('text', p)} ELSE CAST(array() AS array<string>) END") for k, (_, p, _) in RULES.items()})
    parts = [f"transform(filter({placed('text', p, f'_m_{k}')}, x -> {ok}), x -> struct(x.s AS s, {i} AS k, x.e AS e))" for i, (k, (_, p, ok)) in enumerate(RULES.items())]
    return body.select("blob", "todo", F.expr(f"CAST(concat({', '.join(parts)}) AS array<struct<s: int, k: int, e: int>>)").alias("found"))


def update(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (LEDGER): one for each blob of ``versions`` and rule whose version the ledger lacks."""
    rules = F.expr("array(" + ", ".join(f"'{k}'" for k in KINDS) + ")")
    todo = blobs(versions).withColumn("todo", rules)
    if ledger is not None:
        current = " OR ".join(f"(rule = '{k}' AND version = {v})" for k, (v, _, _) in RULES.items())
        seen = ledger.where(current).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.expr("array_except(todo, coalesce(seen, CAST(array() AS array<string>)))")).where("size(todo) > 0")
    versions_of = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, (v, _, _) in RULES.items()) + ")")
    number = F.expr("map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS)) + ")")
    rows = scan(todo).select("blob", "found", F.explode("todo").alias("rule"))
    return rows.select("blob", "rule", versions_of[F.col("rule")].alias("version"), F.filter("found", lambda x: x["k"] == number[F.col("rule")]).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing was recorded there yet. A pair that two runs recorded counts once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule", "version"])


def record(versions: DataFrame, path: str) -> DataFrame:
    """Scans what the ledger at ``path`` lacks for ``versions``, appends it there, and gives the ledger as it is then.

    An append is written as a whole or not at all, so a run that is broken off scans its pairs again and loses none.
    """
    update(versions, read_ledger(versions.sparkSession, path)).write.mode("append").parquet(path)
    return read_ledger(versions.sparkSession, path)


#: Shares into which the rows of a blob are dealt where findings are joined back, so that a blob that very many rows hold is no single task's.
SHARES = 32


def findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of ``versions`` with ``_found``: the spans of their blob under the current rules, array<struct<s,k,e>>."""
    current = " OR ".join(f"(rule = '{k}' AND version = {v})" for k, (v, _, _) in RULES.items())
    by_blob = ledger.where(current).where("size(spans) > 0").groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("_found"))
    by_blob = by_blob.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    rows = versions.select(F.struct(*versions.columns).alias("row"), address().alias("_blob"))
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("row"), F.lit(SHARES)).cast("int")) if not any("map<" in t for _, t in versions.dtypes) else rows.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int"))
    joined = rows.join(by_blob, (rows._blob == by_blob.blob) & (rows._share == by_blob._share), "left")
    return joined.select("row.*", F.coalesce("_found", F.expr("CAST(array() AS array<struct<s: int, k: int, e: int>>)")).alias("_found"))


def history(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """``versions`` (any columns, such as path and version, and text) without text, a row for each finding: rule, start, end."""
    others = [c for c in versions.columns if c != "text"]
    rows = findings(versions.select(F.struct(*others).alias("at"), "text"), ledger).select("at", F.explode("_found").alias("x"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return rows.select("at", F.element_at(names, F.col("x.k") + 1).alias("rule"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, base_sha256, spans.

    ``ledger`` holds earlier rows in the LEDGER layout, or ``path`` names the table they are kept in, to which this run appends;
    what they cover is not scanned again. A null or empty text has no spans; rows repeat as they do in the input.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    if path is not None:
        known = record(rows, path)
    else:
        new = update(rows, ledger)
        known = new if ledger is None else ledger.select("blob", "rule", "version", "spans").unionByName(new)
    done = findings(rows, known)
    done = done.select("doc_id", "_found").withColumn("_base", F.expr(f"filter(_found, x -> x.k < {len(BASE)})"))
    counts = [F.size(F.expr(f"filter(_base, x -> x.k = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return done.select("doc_id", *counts, F.sha2(listed("_base", KINDS), 256).alias("base_sha256"), listed("_found", KINDS).alias("spans"))


def find_in_generations(docs: DataFrame) -> DataFrame:
    """``find_secrets`` over a history of two generations: the rows of ``docs`` with an even hash of doc_id come first, then the
    whole table, of which only blobs are scanned that the first generation lacked. The ledger lies in the session's shared folder."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    earlier = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    record(docs.where(earlier).select("doc_id", "text"), path)
    return find_secrets(docs, path=path)
