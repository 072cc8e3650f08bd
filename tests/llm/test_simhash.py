"""op6 against all pairs of fingerprints, and the fingerprints against their definition."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from cloakframe.llm import shingle_join, simhash
from cloakframe.operators.graph import connected_components


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for a, b in zip(*np.where(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4), strict=True):
        parent[find(a)] = find(b)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def test_links_lose_nothing(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    for f in list(fps):
        for n in (1, 2, 3, 4, 4, 5):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    rows = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).distinct().collect()
    a = np.array(fps, np.uint64)
    want = {tuple(sorted((signed[i], signed[j]))) for i, j in zip(*np.where(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4), strict=True) if i < j}
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_documents_and_odd_texts(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [(5000 + i, t) for i, t in enumerate([None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "É é\x0bÉ", "a b", "x " * 50000])]
    df = spark.createDataFrame([(*x, 0) for x in texts], "doc_id long, text string, fp int")
    rows = simhash.simhash_components(df).collect()
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in rows}
    fps = [plain(t) for _, t in texts]
    want = classes([i for i, _ in texts], fps)
    assert len(rows) == len(texts)
    assert got == {i: (f, want[i]) for (i, _), f in zip(texts, fps, strict=True)}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "same text here now", "en", "s", 1), (1, "same text here now", "en", "s", 1), (None, "same text here now", None, None, None), (None, "quite another text altogether", None, None, None), (None, "quite another text altogether", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.simhash_components(df).count() == 5
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "quite another text altogether"), (1, "same text here now")]
    assert simhash.simhash_components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (-7, -3), (-3, -7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1050), 1000), -7: -7, -3: -7}


def test_kept_texts_are_not_alike(spark):
    # five-word Jaccard under 0.8 for some pairs, over for others, fingerprints often further than 4 bits
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choices(words, k=30))
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([20, 60, 200]))
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([60, 90, 30]))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy) if rng.random() < 0.5 else " ".join(copy) + " " + line)
    texts += [line, "a b c", "A b  c", "a b c d e f g h", "a b c d e f g h i"]

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    s = [sets(t) for t in texts]
    close = [(i, j) for i in range(len(s)) for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    fps = [plain(t) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 4 for i, j in close) > 10
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in close + [(i, j) for i in range(len(s)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_different_texts_under_one_id_stay(spark):
    df = spark.createDataFrame([(1, "one text under this id"), (1, "quite another text under it"), (1, "quite another text under it"), (2, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in simhash.keep_one(df).collect()) == [(1, "one text under this id"), (1, "quite another text under it"), (2, "")]


def test_keys_meet_wherever_sets_are_alike():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 80, 333, 1000, 5000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64))
            change = int(rng.integers(0, 2 * len(a) // 9 + 1))
            drop = int(rng.integers(0, change + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, change - drop, np.int64).astype(np.uint64))))
            if not len(b) or not shingle_join.alike(a, b):
                continue
            (ka, fa), (kb, fb) = shingle_join.keys_of(a), shingle_join.keys_of(b)
            both = np.intersect1d(ka, kb)
            assert shingle_join.may_be_alike(shingle_join.sketch(a), shingle_join.sketch(b))
            assert len(both) and (fa[np.isin(ka, both)].any() or fb[np.isin(kb, both)].any()), (len(a), len(b))


def test_large_buckets_in_pieces(spark, monkeypatch):
    # chains: neighbours are alike, others not, so most sets of a bucket differ from its first
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 300, 3)]
    rng = random.Random(4)
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    none = df.limit(0).select(df.node.alias("a"), df.node.alias("b"))
    whole = {r.component for r in shingle_join.alike_components(df, none).collect()}
    monkeypatch.setattr(shingle_join, "BLOCK", 3)
    assert whole == {r.component for r in shingle_join.alike_components(df, none).collect()} and len(whole) == 1
    rows = [pa.RecordBatch.from_pydict({"node": [i], "text": [t]}) for i, t in enumerate(texts * 2)]
    sent = sorted((x for b in shingle_join._send_keys(1)(iter(rows)) for x in b.to_pylist()), key=lambda x: x["part"])
    meet = lambda: {(min(m), x) for b in shingle_join._meet(iter([pa.RecordBatch.from_pylist(sent)])) for m in b.column("members").to_pylist() if m for x in m}
    together = meet()
    monkeypatch.setattr(shingle_join, "HELD", 500)
    assert {x for _, x in meet()} == {x for _, x in together}


def test_cells_grow_with_the_members(spark, monkeypatch):
    # one bucket with a large component and few others: all that are apart meet, and no block is sent for each of its keys
    monkeypatch.setattr(shingle_join, "BLOCK", 50)
    c = {x: 5000 if x < 900 else 6000 + x // 2 for x in range(1000)}
    rows = [(1, x, k) for x, k in c.items()] + [(2, x, 7000 + x) for x in range(10)] + [(3, x, 1) for x in range(80)]
    cells = {}
    got = shingle_join.cells_of(spark.createDataFrame(rows, "bucket long, node long, c long")).collect()
    for r in got:
        cells.setdefault(r.cell, []).append(r)
    meet = set()
    for members in cells.values():
        one = len({r.side for r in members}) == 1
        meet |= {(x.node, y.node) for x in members for y in members if x.node < y.node and x.c != y.c and (one or x.side != y.side)}
    assert meet >= {(x, y) for x in c for y in range(max(x + 1, 900), 1000) if c[x] != c[y]} | {(x, y) for y in range(10) for x in range(y)}
    assert len(got) < 5 * len(rows)


def test_changed_copies_join_at_their_centre(spark):
    # 120 changed copies of one text, in no order: nearly all pairs are apart, and each copy is alike to the text itself
    rng = random.Random(8)
    base = [f"c{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(0, 150, 6), 3):
            copy[at] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "node long, text string")
    rows = [pa.RecordBatch.from_pydict({"node": [1000 - i], "text": [t]}) for i, t in enumerate(texts)]
    sent = [x for b in shingle_join._send_keys(1)(iter(rows)) for x in b.to_pylist()]
    met = [(i, x, len(m)) for b in shingle_join._meet(iter([pa.RecordBatch.from_pylist(sent)])) for i, m in enumerate(b.column("members").to_pylist()) if m for x in m]
    pairs = shingle_join.centre_pairs(spark.createDataFrame(met, "bucket long, node long, n int")).collect()
    assert {x for r in pairs for x in (r.a, r.b) if 880 in (r.a, r.b)} == set(range(880, 1001)) and len(pairs) < 1000
    none = df.limit(0).select(df.node.alias("a"), df.node.alias("b"))
    assert {(r.node, r.component) for r in shingle_join.alike_components(df, none).collect()} == {(x, 880) for x in range(880, 1001)}


def test_a_large_part_is_looked_at_few_times(monkeypatch):
    # keys that meet nothing don't shrink what is held; looking at all of it for each further row was quadratic
    rng = random.Random(5)
    rows = [pa.RecordBatch.from_pydict({"node": [i], "text": [" ".join(str(rng.random()) for _ in range(60))]}) for i in range(200)]
    sent = [x for b in shingle_join._send_keys(1)(iter(rows)) for x in b.to_pylist() if not x["kind"]]
    monkeypatch.setattr(shingle_join, "HELD", 500)
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(shingle_join.np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))
    list(shingle_join._meet(iter([pa.RecordBatch.from_pylist(sent)])))
    assert 2 < len(sorts) < 12 and sum(sorts) < 4 * max(sorts)


def test_parts_follow_the_bytes_of_texts():
    assert shingle_join.parts_for(37, 840_000_000) == 37
    assert shingle_join.parts_for(48, 10_000_000_000) == 417
    assert shingle_join.parts_for(0, 0) == 1


def test_keys_of_fingerprints_are_sent_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 100)
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(400)], "fp long").coalesce(1)
    plan = simhash.links(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
