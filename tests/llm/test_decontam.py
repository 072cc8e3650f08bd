"""op8 against a brute-force comparison of every item with every position of every text."""

import random

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import decontam


def brute(text, items):
    """Items with a stretch of MIN_TOKENS at IDENTITY on some diagonal, by trying them all."""
    words = decontam.tokens(text)
    found = set()
    for item_id, item in items:
        t = decontam.tokens(item)
        need = min(decontam.MIN_TOKENS, len(t))
        for d in range(-len(t), len(words) + 1):
            eq = [0 <= i + d < len(words) and words[i + d] == t[i] for i in range(len(t))]
            inside = [i for i in range(len(t)) if 0 <= i + d < len(words)]
            if any(sum(eq[i] for i in inside[a:b]) >= 0.8 * (b - a) for a in range(len(inside)) for b in range(a + need, len(inside) + 1) if need):
                found.add(item_id)
    return found


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 6, 7, 8, 12, 20, 45])))) for i in range(25)]
    docs = []
    for i in range(160):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 2:
            t = items[rng.randrange(25)][1].split()
            for j in rng.sample(range(len(t)), int(len(t) * rng.choice([0, 0.1, 0.2, 0.5]))):
                t[j] = "changed"
            w[len(w) // 2 : len(w) // 2] = t[rng.choice([0, 2]) :]
        docs.append((i, ", ".join(w).upper()))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    docs += [(1, None), (1, ""), (500, " ".join(t for _, t in items))]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, key string")
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    rows = decontam.contamination(d, b).collect()
    assert len(rows) == len(docs)
    got = sorted((r.doc_id, tuple(h.item_id for h in r.hits)) for r in rows)
    assert got == sorted((i, tuple(sorted(brute(t, items)))) for i, t in docs)
    assert all(r.contaminated == bool(r.hits) and r.n_items == len(r.hits) for r in rows)
    shuffled = decontam.contamination(d, b, max_broadcast_tokens=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, rows))
    clean = decontam.decontaminate(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if not brute(t, items))


def test_every_pair_of_substitutions_leaves_a_seed():
    for n in (10, 12, 14):
        for i in range(n):
            for j in range(i):
                ids = np.arange(1, n + 1).astype(np.uint64)
                ids[[i, j]] = 0
                assert any(True for _ in decontam.seeds(ids)), (n, i, j)


def test_empty_tables_and_real_passages(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert decontam.decontaminate(d, b.limit(0)).count() == d.count()
    found = {r.doc_id for r in decontam.contamination(d, b).where("contaminated").collect()}
    verbatim = {r.doc_id for r in d.join(b.select("item_id", F.col("text").alias("p")), F.expr("contains(text, p)")).collect()}
    assert verbatim <= found


def test_every_substitution_in_short_items(spark):
    w = "red blue green black white brown pink".split()
    docs, items = [], []
    for n in (5, 6, 7):
        items.append((n, " ".join(f"{x}{n}" for x in w[:n])))
        docs += [(10 * n + j, "go " + " ".join("other" if i == j else f"{x}{n}" for i, x in enumerate(w[:n])) + " on") for j in range(n)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for tokens in (0, 10**6):
        assert all(r.contaminated and r.best_item == r.doc_id // 10 for r in decontam.contamination(d, b, max_broadcast_tokens=tokens).collect())


def test_texts_that_share_an_id_or_have_none(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "uno dos tres cuatro cinco seis siete ocho nueve diez once", "un deux trois quatre cinq six sept huit neuf dix")
    b = spark.createDataFrame([(1, one), (1, two), (None, three), (None, three)], "item_id long, text string")
    d = spark.createDataFrame([(1, one), (2, two), (3, three), (4, f"{one} x {two} y {three}"), (5, "none of them")], "doc_id long, text string")
    for tokens in (0, 10**6):
        got = {r.doc_id: [h.item_id for h in r.hits] for r in decontam.contamination(d, b, max_broadcast_tokens=tokens).collect()}
        assert got == {1: [1], 2: [1], 3: [None], 4: [None, 1], 5: []}
    assert [r.doc_id for r in decontam.decontaminate(d, b).collect()] == [5]
