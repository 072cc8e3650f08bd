"""op1 against a table of all windows, with hot hashes on and off, and the interval scan against its definition."""

import hashlib
import random

import numpy as np

from cloakframe.llm import suffix_dedup as sd


def brute(docs):
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        i = sd.NO_ID if i is None else i
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        own = sd.NO_ID if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < own:
                gone[s : s + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    alphabet = "ab é\0" * 3 + "cdefghijklmnopqrstuvwxyz 😀"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (20, 49, 50, 51, 60, 90, 300, 45)] + ["a" * 120, "ab" * 70, "\0" * 60]
    docs = [(rng.randrange(1000), "".join(rng.choice([text(rng.randint(0, 90)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 7)))) for _ in range(160)]
    docs += docs[:5] + [(None, docs[3][1]), (None, docs[3][1]), (7, None), (8, ""), (9, text(49)), (-5, docs[8][1] * 2), (3000, text(100) + docs[8][1] + text(60)), (3001, "x" * 30000)]
    near = text(1500)
    for i in range(40):
        j = rng.randrange(1500)
        docs.append((4000 + i, near[:j] + text(3) + near[j:]))
    return docs


def test_against_all_windows(spark):
    docs = fixture()
    want = brute(docs)
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, part int, key string").repartition(3)
    for local_hot, hot in ((None, sd.HOT), (3, 10), (1000, 4), (0, 0)):
        got = sorted((tuple(r) for r in sd.remove_repeats(df, local_hot, hot).collect()), key=str)
        assert got == want, (local_hot, hot)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_texts_kept(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    kept = sd.texts_kept(df).collect()
    got = sorted(((r.doc_id, len(r.kept) + sum(x.end - x.start for x in r.removed), sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in kept), key=str)
    assert got == brute(docs)


def test_repeat_groups_hold_all_occurrences(spark):
    docs = [(i, t) for i, t in fixture() if i is not None and t and len(t) < 600]
    docs = list({i: (i, t) for i, t in docs}.values())
    texts = {}
    for i, t in docs:  # copies of a text stand in once, under their smallest id
        texts[t.encode()] = min(i, texts.get(t.encode(), i))
    places = {}
    for b, i in texts.items():
        for s in range(len(b) - 49):
            places.setdefault(b[s : s + 50], set()).add((i, s))
    got = sd.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    data = {i: b for b, i in texts.items()}
    covered = {}
    for r in got:
        spots = {(o.doc_id, o.start) for o in r.occurrences}
        assert len(spots) == len(r.occurrences) > 1 and r.length == len(r.repeat) >= 50
        assert all(data[d][s : s + r.length] == bytes(r.repeat) for d, s in spots)
        for k in range(r.length - 49):
            covered.setdefault(bytes(r.repeat)[k : k + 50], set()).update((d, s + k) for d, s in spots)
        if r.length < 200:  # whole occurrences, and nothing before or behind is shared by all
            assert spots == {(i, s) for i, b in data.items() for s in range(len(b) - r.length + 1) if b[s : s + r.length] == bytes(r.repeat)}
            assert len({data[d][s - 1 : s] if s else (d, s) for d, s in spots}) > 1 and len({data[d][s + r.length : s + r.length + 1] or (d, s) for d, s in spots}) > 1
    assert covered == {w: p for w, p in places.items() if len(p) > 1}


def test_sample_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sorted((tuple(r) for r in sd.remove_repeats(df).collect()), key=str) == want


def test_intervals():
    rng = random.Random(1)
    for _ in range(200):
        lcp = [0] + [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        want = set()
        for a in range(len(lcp)):
            for b in range(a + 1, len(lcp)):
                low = min(lcp[a + 1 : b + 1])
                if low >= 1 and (a == 0 or lcp[a] < low) and (b + 1 == len(lcp) or lcp[b + 1] < low):
                    want.add((low, a, b))
        got = list(sd.intervals(lcp, 1))
        assert set(got) == want and len(got) == len(want)


def test_repeats_are_maximal_and_whole():
    rng = random.Random(5)
    n = 60
    left = np.array([[rng.choice(b"ab") for _ in range(sd.LEFT)] for _ in range(n)], np.uint8)
    right = np.array([[rng.choice(b"ab") for _ in range(sd.LENGTH)] for _ in range(n)], np.uint8)
    for a in range(0, n, 2):
        i, j = rng.sample(range(n), 2)
        left[i, : a % 35], right[i, : 50 - a % 20] = left[j, : a % 35], right[j, : 50 - a % 20]
    lc, rc = np.full(n, sd.LEFT), np.full(n, sd.LENGTH)
    common = lambda x, y: int((np.append(x != y, True)).argmax())
    groups = {}
    for i in range(n):
        for j in range(n):
            if i != j:
                p, q = common(left[i], left[j]), common(right[i], right[j])
                if p + q >= 50:
                    groups[p, q, left[i, :p].tobytes(), right[i, :q].tobytes()] = {k for k in range(n) if (left[k, :p] == left[i, :p]).all() and (right[k, :q] == right[i, :q]).all()}
    got = {(p, q, left[m[0], :p].tobytes(), right[m[0], :q].tobytes()): set(m) for p, q, m in sd.maximal_repeats(np.zeros(n, np.uint64), right, rc, left, lc)}
    assert groups and got.keys() >= groups.keys() and all(got[k] == groups[k] for k in groups)
