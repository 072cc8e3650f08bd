"""The pipeline against its stages' meaning in plain Python, on a small fixture."""

from collections import Counter

import corpus_pipeline
from cloakframe.llm import decontam, sentencepiece_nbest, toxicity

from .test_native_spans import brute_pii
from .test_simhash import classes, plain

SF = "/root/testdata/sf0.01"


def near(ids, texts):
    """Smallest id reachable by fingerprints at 4 bits or less, or by sets of five-word shingles at 0.8 or more."""
    low = classes(ids, [plain(t) for t in texts])

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [sets(t) for t in texts]
    holders = {}
    for i, x in enumerate(s):
        for g in x:
            holders.setdefault(g, []).append(i)
    shared = Counter()
    for h in holders.values():
        shared.update((i, j) for n, i in enumerate(h) for j in h[:n])
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(s[i]) + len(s[j]) - n):
            a, b = sorted((low[ids[i]], low[ids[j]]))
            low = {k: a if v == b else v for k, v in low.items()}
    return low


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = []
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        steps.append(at.collect())
    assert all(list(rows[0].asDict()) == docs.columns for rows in steps[:-1])
    rejected = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    want = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    assert rejected and {r.doc_id: r.text for r in steps[0]} == want
    low = near(list(want), list(want.values()))
    want = {i: t for i, t in want.items() if low[i] == i}
    assert {r.doc_id: r.text for r in steps[1]} == want
    padded = [" ".join(decontam.tokens(t)) for _, t in items]
    want = {i: t for i, t in want.items() if not any(p in " ".join(decontam.tokens(t)) for p in padded)}
    assert {r.doc_id: r.text for r in steps[2]} == want
    for r in steps[3]:
        text = want[r.doc_id]
        for kind, m in brute_pii(text):
            assert m[0] not in r.text and f"[{kind.upper()}]" in r.text
        assert r.n_chars == len(r.text) and (r.text == text or "[" in r.text)
    texts = {r.doc_id: r.text for r in steps[3]}
    vocabulary = sentencepiece_nbest.vocabulary(sentencepiece_nbest.MODEL_PATH)
    assert len(steps[4]) == len(texts) and all(r.restored and vocabulary.decode(r.ids) == texts[r.doc_id] for r in steps[4])


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_odd_rows(spark, tmp_path):
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, "en", None, "a", 0, "x"), (2, "en", "", "a", 0, "x"), (3, None, "  ", None, None, None), (4, "en", long, "a", len(long), "x"), (4, "en", long, "a", len(long), "x"), (5, "en", long + "end", "b", 1, "y"),
            (6, "en", "one text under this id", "a", 22, "x"), (6, "en", "quite another text under it", "a", 27, "x"), (None, "en", "write to a.b@c.org now", "a", 22, "x"), (7, "en", "write to a.b@c.org now", "a", 22, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long, ids string")
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, None)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 4, 6, 6, 7] and all(r.restored for r in got)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
