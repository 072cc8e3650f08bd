"""op2: held-out accuracy, mixtures, odd rows; windows against a plain definition."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_windows_are_counted_per_word():
    texts = ["Ab c", None, "", "12 é!", "İx"]
    hashed, words, text_of = langid.windows(texts)
    assert Counter(text_of.tolist()) == {0: 2, 3: 1, 4: 1} or Counter(text_of.tolist())[0] == 2
    by_word = Counter(words.tolist())
    assert by_word[0] == 2 + 2 + 1 + 2 and by_word[1] == 1 + 1 + 1 + 1  # ones, twos, the edge behind, threes
    again = langid.windows(["c", "ab"])
    assert sorted(again[0][again[1] == 1].tolist()) == sorted(hashed[words == 0].tolist())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 200
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_mixed_text(spark):
    docs = spark.read.parquet(SF)
    two = docs.where("n_chars BETWEEN 1500 AND 4000 AND lang IN ('en', 'de')").groupBy().agg(F.max_by(F.when(F.col("lang") == "en", F.col("text")), "n_chars").alias("a"), F.max_by(F.when(F.col("lang") == "de", F.col("text")), "n_chars").alias("b")).first()
    en = docs.where("lang = 'en' AND n_chars BETWEEN 2000 AND 3000").first().text
    de = docs.where("lang = 'de' AND n_chars BETWEEN 2000 AND 3000").first().text
    assert two is not None
    mixed = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate([en, de, en + "\n" + de])], docs.schema)
    got = {r.doc_id - 10**6: {x.lang for x in r.languages} for r in langid.identify(docs.unionByName(mixed)).where("doc_id >= 1000000").collect()}
    assert got == {0: {"en"}, 1: {"de"}, 2: {"en", "de"}}


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, "the of and with" if i % 2 else "der die das und", "en" if i % 2 else "de", None, None) for i in range(40)]
    rows += [(None, None, "en", "s", 1), (100, "", None, "s", 1), (101, "12 + 3", "xx", "s", 1), (101, "the and", None, "s", 1), (102, "the of " * 40000, None, "s", 1), (103, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20)), None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred): r for r in got}
    assert (None, "und") in by and (100, "und") in by and (101, "und") in by and (101, "en") in by and by[102, "en"].score > 0.9
    assert not by[None, "und"].held_out
    assert {r.lang_pred for r in langid.identify(df.where("lang IS NULL")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def plain_choice(like):
    """The best set of languages of one text over all subsets, by plain EM to the end, with the penalty."""
    k, n = like.shape
    best = (-np.inf, None)
    for chosen in [c for m in range(1, k + 1) for c in combinations(range(k), m)]:
        pi = np.full(len(chosen), 1 / len(chosen))
        for _ in range(3000):
            parts = like[list(chosen)] * pi[:, None]
            pi = (parts / parts.sum(axis=0)).mean(axis=1)
        score = np.log((like[list(chosen)] * pi[:, None]).sum(axis=0)).sum() - 0.5 * (len(chosen) - 1) * np.log(n)
        if score > best[0] + 1e-9:
            best = score, {c: p for c, p in zip(chosen, pi, strict=True)}
    return best


def test_sets_of_any_size_against_plain_em():
    rng = random.Random(2)
    langs = [chr(97 + i) * 2 for i in range(6)]
    words = {x: ["".join(rng.choice("bcdfglmnprst"[i : i + 7] + "aeiou") for _ in range(5)) for _ in range(200)] for i, x in enumerate(langs)}
    table = np.stack([np.bincount(langid.windows([" ".join(words[x])])[0], minlength=langid.BUCKETS) for x in langs]).astype(float)
    model = langid.Model(langs, table)
    texts = [" ".join(w for x in rng.sample(langs, m) for w in rng.sample(words[x], 40)) for m in (1, 2, 3, 4, 5, 6) for _ in range(3)]
    shares, size = model.mixtures(texts)
    largest = 0
    for t, s, n in zip(texts, shares, size, strict=True):
        (own, words_of, _) = langid.windows([t])
        like = np.stack([np.bincount(words_of, weights=model.logs[own, i]) / np.bincount(words_of) * langid.SHARP for i in range(len(langs))])
        like = np.exp(like - like.max(axis=0))
        best, chosen = plain_choice(like)
        got = np.log((like * s[:, None]).sum(axis=0)).sum() - 0.5 * ((s > 0).sum() - 1) * np.log(n)
        largest = max(largest, len(chosen))
        assert got > best - 0.2 and {i for i in range(len(langs)) if s[i] > 0.02} == {i for i, p in chosen.items() if p > 0.02}
    assert largest >= 5
