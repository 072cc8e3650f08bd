"""op4: exactness of the block-max search, defined results of odd rows, held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np

from cloakframe.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, score string"


def unit(rng, n_words):
    picked = rng.sample(range(n_words), rng.randint(1, 6))
    x = np.array([rng.choice([1.0, 1.7, 2.1]) for _ in picked])
    return tuple(zip(sorted(picked), (x / np.sqrt(x @ x)).tolist(), strict=True))


def test_search_is_exact():
    rng = random.Random(1)
    vectors = list({unit(rng, 40): None for _ in range(1500)})
    entries = [(v, rng.randint(0, 1), rng.choice([1, 1, 1, 4, 30]), i) for i, v in enumerate(vectors)]
    index = toxicity.Examples(entries, 40)
    by_id = {e[3]: (dict(e[0]), e[2]) for e in entries}
    for _ in range(150):
        q = dict(unit(rng, 40))
        cosines = [sum(v * by_id[int(i)][0].get(w, 0.0) for w, v in q.items()) for i in index.id]
        order = sorted((-round(c, 12), p) for p, c in enumerate(cosines) if c > 0)
        want, total = [], 0
        for c, p in order:
            want.append((p, -c))
            total += by_id[int(index.id[p])][1]
            if total >= toxicity.K:
                break
        got = index.nearest(tuple(sorted(q.items())), toxicity.K)
        assert [round(c, 9) for _, c in got] == [round(c, 9) for _, c in want]
        assert all(abs(cosines[p] - c) < 1e-9 for p, c in got)


def test_calibration_rises():
    x = np.array([0, 0, 0.2, 0.5, 0.5, 0.9, 1, 1])
    knots, levels = toxicity.rising(x, np.array([0, 0, 1, 0, 1, 0, 1, 1.0]), 0.1)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and 0 <= levels[0] and levels[-1] <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (1, "", None, None), (None, "stupid", "en", ""), (2, "word " * 30000, "en", "")], COLUMNS)
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert len(rows) > 700 and (rows.predicted == rows.toxic).mean() > 0.96
    assert ((rows.score - rows.toxic) ** 2).mean() < 0.04
    clean = rows[rows.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.97


def test_sample_keeps_the_share_of_labels(spark, monkeypatch):
    # 5 % toxic; a tenth of the toxic texts and most clean ones hold no telling word; of those with "maybe" about a quarter is toxic
    def text(i):
        if i % 20:
            return "plain words maybe" if i % 20 < 4 else "plain words"
        return "plain words" if i % 200 == 0 else "plain words foulword maybe"

    docs = spark.createDataFrame([(i, text(i)) for i in range(8000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 20 == 0)) for i in range(8000)], "doc_id long, quality int, toxic int")
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE", 200)
    part = toxicity.fit(docs, labels)
    assert toxicity.label_weights(labels, 200, 200)[1] < 0.15
    assert whole.bare < 0.01 and part.bare < 0.02  # a share of about one half in the sample without weights
    texts = ["plain words", "plain words maybe", "plain words foulword maybe"]
    assert all(abs(whole.score(t)[0] - part.score(t)[0]) < 0.12 for t in texts), [(whole.score(t)[0], part.score(t)[0]) for t in texts]


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    bad, good, plain = [f"foul{i}" for i in range(6)], [f"kind{i}" for i in range(6)], [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for _ in range(1200):
        y = rng.random() < 0.3
        texts.append(" ".join(rng.sample(plain, 12) + [rng.choice(bad if y ^ (rng.random() < 0.1) else good) for _ in range(rng.randint(0, 4))]))
        toxic.append(int(y))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    number, k = model.features.number, toxicity.K

    def vector(t):
        x = Counter(number[f] for f in toxicity.words_of(t) if f in number)
        x = {w: (1 + np.log(c)) * model.idf[w] for w, c in x.items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        return {w: v / size for w, v in x.items()}

    train = [(vector(t), y) for i, (t, y) in enumerate(zip(texts, toxic, strict=True)) if zlib.crc32(str(i).encode()) % 5]

    # entries stand for all training texts with a telling word; ties go to the smaller place
    e = model.examples
    entries = [(vector(texts[int(i)]), int(y), int(n)) for i, y, n in zip(e.id, e.label, e.count, strict=True)]
    assert sorted((str(sorted(x.items())), y) for x, y in train if x) == sorted((str(sorted(x.items())), y) for x, y, n in entries for _ in range(n))
    assert abs(sum(y for x, y in train if not x) / max(1, sum(not x for x, _ in train)) - model.bare) < 0.05

    def vote(own):
        """Distance-weighted share of the K nearest labelled texts."""
        cosines = [round(sum(v * x.get(w, 0.0) for w, v in own.items()), 12) for x, _, _ in entries]
        up = down = left = 0.0
        left = k
        for place in sorted((p for p in range(len(entries)) if cosines[p] > 0), key=lambda p: (-cosines[p], p)):
            n = min(left, entries[place][2])
            left -= n
            up += n * entries[place][1] / (1 - min(1.0, cosines[place]) + 0.05)
            down += n / (1 - min(1.0, cosines[place]) + 0.05)
        return up / down if down else 0.0

    checked = set()
    for t in texts[::10]:
        own = vector(t)
        score, evidence = model.score(t)
        if not own:
            assert score == model.bare and not evidence
            continue
        want = np.interp(vote(own), model.knots, model.levels)
        assert abs(score - want) < 1e-9
        checked.add(round(score, 6))
        cosines = sorted((sum(a * x.get(w, 0.0) for w, a in own.items()) for x, _, _ in entries), reverse=True)
        assert abs(evidence[0][2] - cosines[0]) < 1e-9
    assert len(checked) >= 2 and (np.diff(model.levels) >= 0).all()


def test_repeated_ids_do_not_lengthen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.training(docs, labels).count() <= 2
