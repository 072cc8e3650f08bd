"""What the driver holds: connected components of few edges without a plan a round, native memory given back."""

import random
import re
from pathlib import Path

import corpus_pipeline
from cloakframe.operators import graph


def jobs_of(spark, run):
    """What ``run`` gives, and the jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def components(spark, edges):
    out = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b")
    rows = out.collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)
    return got


def test_few_edges_take_no_rounds_and_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    chain = list(range(-300, 300))
    rng.shuffle(chain)
    edges = list(zip(chain[:-1], chain[1:], strict=True)) + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    edges += [(None, 7), (7, None), (2000, 2000), (3000, 3001), (3001, 3000), (3000, 3001)]
    few, n = jobs_of(spark, lambda: components(spark, edges))
    monkeypatch.setattr(graph, "FEW", 0)
    rounds, many = jobs_of(spark, lambda: components(spark, edges))
    assert few == rounds
    assert all(few[x] == -300 for x in chain) and few[3001] == 3000 and 2000 not in few
    assert n <= 16 < many, (n, many)


def test_no_edges(spark):
    assert components(spark, [(None, None), (1, 1)]) == {}


def rss(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def test_a_stage_begins_with_freed_native_memory_given_back(spark):
    held = [spark._jvm.java.util.zip.Deflater() for _ in range(1200)]  # some 250 KB of native memory each
    for i, x in enumerate(held):
        if i % 30:  # what stays keeps the arena from shrinking by itself
            x.end()
    before = rss(spark)
    corpus_pipeline.begin(spark)
    after = rss(spark)
    for x in held[::30]:
        x.end()
    assert graph.trim_driver(spark)
    assert after < before - 100, (before, after)


def test_every_stage_begins_so(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "begin", lambda s: seen.append(s))
    for name in ("drop_toxic", "keep_one", "decontaminate", "redact", "encode_texts"):
        monkeypatch.setattr(corpus_pipeline, name, lambda docs, *a: docs)
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir)
    assert len(seen) == 5
