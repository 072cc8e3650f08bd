"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fitted parts are bounded: SAMPLE rows of each label (those with the smallest hash of their id)
choose a vocabulary, all words whose log-odds between the labels are MIN_ODDS or more at a
chi-square of MIN_CHI2 or more, calibrate the votes, and are the examples. Document frequencies for the IDF count over
every document. Where SAMPLE leaves rows out, votes, prior, bare share and calibration weigh each
sampled row by its label's share of all training rows over its share of the sample. The examples lie in an inverted index cut into blocks of BLOCK examples, with
the largest weight of each word in each block; a query takes blocks by falling upper bound and
stops when no block can reach its K-th best cosine, so the search is exact (ties to the smaller
place). Examples with equal vectors and labels are one entry with a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, text_chunks

SAMPLE, MIN_CHI2, MIN_ODDS, BLOCK, K, EVIDENCE = 8000, 40.0, 1.5, 256, 15, 3
PREFIXES = (4, 5)
#: About so many examples calibrate the votes.
CALIBRATION = 4000
_WORDS = re.compile(r"[^\W\d_]+")


class Features(dict):
    """Numbers of the vocabulary entries that a word has; remembers words, up to a fixed count."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __reduce__(self):
        return Features, (self.number,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        forms = (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))
        found = tuple(self.number[f] for f in forms if f in self.number)
        if len(self) < 100_000:
            self[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        return [i for w in _WORDS.findall((text or "").lower()) for i in self[w]]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, and the first PREFIXES letters of longer ones, starred: inflected forms share a stem."""
    words = _WORDS.findall((text or "").lower())
    return words + [w[:n] + "*" for w in words for n in PREFIXES if len(w) > n]


class Examples:
    """The block-max index: vectors are lists of (word number, weight), of unit length."""

    def __init__(self, entries: list[tuple[tuple[tuple[int, float], ...], int, int, int]], n_words: int, weights: tuple[float, float] = (1.0, 1.0)):
        # weights: of a row by label; entries: vector, label, count, id; like vectors side by side, so that blocks differ
        entries = sorted(entries, key=lambda e: (max(e[0], key=lambda x: (x[1], x[0]))[0], e[0], e[1], e[3]))
        self.label = np.array([e[1] for e in entries], np.int64)
        self.count = np.array([e[2] for e in entries], np.int64)
        self.weights = weights
        self.id = np.array([e[3] for e in entries], np.int64)
        n = len(entries)
        self.blocks = max(1, -(-n // BLOCK))
        t = np.array([w for e in entries for w, _ in e[0]], np.int64)
        d = np.repeat(np.arange(n), [len(e[0]) for e in entries])
        x = np.array([v for e in entries for _, v in e[0]], np.float64)
        order = np.lexsort((d, t))
        t, self.doc, self.weight = t[order], d[order], x[order]
        cell = t * self.blocks + self.doc // BLOCK
        self.start = np.searchsorted(cell, np.arange(n_words * self.blocks + 1))
        self.high = np.zeros(n_words * self.blocks)
        np.maximum.at(self.high, cell, self.weight)
        self.high = self.high.reshape(n_words, self.blocks)

    def nearest(self, vector: tuple[tuple[int, float], ...], k: int, leave: int = -1) -> list[tuple[int, float]]:
        """(place, cosine) of entries until their counts make ``k``; one example of entry ``leave`` stays out."""
        terms = [w for w, _ in vector]
        q = np.array([v for _, v in vector])
        bound = q @ self.high[terms]
        order = np.argsort(-bound, kind="stable")
        found: list[tuple[float, int]] = []
        least = 0.0
        for b in order[: np.searchsorted(-bound[order], 0.0)]:
            if bound[b] < least - 1e-11:
                break
            score = np.zeros(BLOCK)
            for w, v in zip(terms, q, strict=True):
                c = w * self.blocks + b
                s, e = self.start[c], self.start[c + 1]
                score[self.doc[s:e] - b * BLOCK] += v * self.weight[s:e]
            score = np.round(score, 12)  # else the order of additions would break ties
            hit = np.flatnonzero((score > 0) & (score >= least))
            found += [(-score[i], int(b * BLOCK + i)) for i in hit]
            found.sort()
            total = 0
            for i, (s, place) in enumerate(found):
                total += int(self.count[place]) - (place == leave)
                if total >= k:
                    del found[i + 1 :]
                    least = -s
                    break
        return [(place, -s) for s, place in found if self.count[place] > (place == leave)]

    def vote(self, near: list[tuple[int, float]], k: int, leave: int = -1) -> float:
        """Share of the ``k`` nearest, by weights 1 / (distance + 0.05) times that of the label, that is labelled toxic."""
        up = down = 0.0
        for place, cosine in near:
            n = min(k, int(self.count[place]) - (place == leave))
            k -= n
            w = self.weights[self.label[place]] * n / (max(0.0, 1.0 - cosine) + 0.05)
            up += w * self.label[place]
            down += w
        return up / down if down else 0.0


def rising(x: np.ndarray, y: np.ndarray, prior: float, weight: float = 2.0, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on votes (weighted by ``of``), each level pulled to the prior by ``weight`` examples: knots and values."""
    of = np.ones(len(y)) if of is None else of
    values, at = np.unique(x, return_inverse=True)
    n, s = np.bincount(at, weights=of), np.bincount(at, weights=y * of)
    pools: list[list[float]] = []
    for v, c, t in zip(values, n, s, strict=True):
        pools.append([t, c, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t2, c2, _, hi = pools.pop()
            pools[-1][0] += t2
            pools[-1][1] += c2
            pools[-1][3] = hi
    level = [(t + weight * prior) / (c + weight) for t, c, _, _ in pools]
    knots = np.array([z for p in pools for z in (p[2], p[3])])
    return knots, np.maximum.accumulate(np.repeat(level, 2)) if level else np.zeros(0)


class Model:
    """Everything a score needs; its size follows from SAMPLE."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: Examples | None, bare: float, knots: np.ndarray, levels: np.ndarray):
        self.features = Features({w: i for i, w in enumerate(vocabulary)})
        self.idf, self.examples, self.bare, self.knots, self.levels = idf, examples, bare, knots, levels
        self.known: dict[tuple, tuple[float, list]] = {}

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        return tuple(sorted(Counter(self.features.of(text)).items()))

    def vector(self, counts: tuple[tuple[int, int], ...]) -> tuple[tuple[int, float], ...]:
        x = np.array([(1 + np.log(c)) * self.idf[w] for w, c in counts])
        return tuple(zip([w for w, _ in counts], (x / np.sqrt(x @ x)).tolist(), strict=True))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of label 1 and the nearest examples (id, label, cosine)."""
        counts = self.counts(text)
        if not counts or self.examples is None:
            return self.bare, []
        if (got := self.known.get(counts)) is None:
            near = self.examples.nearest(self.vector(counts), K)
            p = float(np.interp(self.examples.vote(near, K), self.knots, self.levels)) if near and len(self.knots) else self.bare
            got = p, [(int(self.examples.id[i]), int(self.examples.label[i]), c) for i, c in near[:EVIDENCE]]
            if len(self.known) < 20_000:
                self.known[counts] = got
        return got


def label_rows(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` of labelled rows outside fold 0; of repeated labels the largest holds."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    return y.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, y`` of up to SAMPLE labelled rows of each label. Of rows that share an id the first text counts, so
    that repeated ids don't lengthen the sample."""
    y = label_rows(labels)
    pick = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for v in (0, 1)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def label_weights(labels: DataFrame, n0: int, n1: int) -> tuple[float, float]:
    """By label, the weight of a sampled row: training labels a sampled one stands for, scaled so that the n0 + n1 rows keep their sum."""
    count = {r.y: r.n for r in label_rows(labels).groupBy("y").agg(F.count("*").alias("n")).collect()}
    w0, w1 = (max(1.0, count.get(v, 0) / SAMPLE) for v in (0, 1))
    scale = (n0 + n1) / (n0 * w0 + n1 * w1) if n0 + n1 else 1.0
    return w0 * scale, w1 * scale


def choose_words(train: DataFrame) -> tuple[list[str], int, int]:
    """Words that tell the labels apart (see above), strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                up, down = Counter(), Counter()
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    (up if y else down).update(set(words_of(text)))
                words = list(up.keys() | down.keys())
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "up": pa.array([up[w] for w in words], pa.int64()), "down": pa.array([down[w] for w in words], pa.int64())})

    n = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    df = train.select("text", "y").mapInArrow(lean(run), "word string, up long, down long").groupBy("word").agg(F.sum("up").alias("a"), F.sum("down").alias("b")).where("a + b >= 3")
    odds = f"ln((a + 0.5D) / ({n1} - a + 0.5D)) - ln((b + 0.5D) / ({n0} - b + 0.5D))"
    chi2 = f"({n0} + {n1}) * pow(a * ({n0} - b) - b * ({n1} - a), 2) / ((a + b) * ({n0} + {n1} - a - b) * ({n0} + 0.5D) * ({n1} + 0.5D) + 0.5D)"
    df = df.select("word", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    top = df.withColumn("x", F.expr(chi2)).where(f"x >= {MIN_CHI2} AND abs({odds}) >= {MIN_ODDS}").orderBy(F.desc("x"), "word")  # no more than the words of the sample
    return [r.word for r in top.select("word").collect()], n0, n1


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, np.ndarray]:
    """Rows of ``docs`` and, by word of the vocabulary, the rows that hold it; tasks send a number for each word."""
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, rows = Features(number.value), np.zeros(len(number.value) + 1, np.int64), 0
        for batch in batches:
            for part in text_chunks(batch):
                for text in part.column("text").to_pylist():
                    for i in set(known.of(text)):
                        total[i] += 1
                rows += part.num_rows
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["w", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        out[r.w] = r.n
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    train = training(docs, labels)
    vocabulary, n0, n1 = choose_words(train)
    weights = w0, w1 = label_weights(labels, n0, n1)
    prior = (w1 * n1 + 1) / (n0 + n1 + 2) if n0 + n1 else 0.0
    rows, df = document_frequencies(docs, vocabulary)
    idf = np.log((1 + rows) / (1 + df)) + 1
    model = Model(vocabulary, idf, None, prior, np.zeros(0), np.zeros(0))
    number = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                got = [number.value.counts(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([[w for w, _ in g] for g in got], pa.list_(pa.int32())), pa.array([[c for _, c in g] for g in got], pa.list_(pa.int32()))], ["doc_id", "y", "w", "c"])

    vectors = train.mapInArrow(lean(run), "doc_id long, y int, w array<int>, c array<int>")
    grouped = vectors.groupBy("w", "c", "y").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).orderBy("doc_id", "y").collect()  # at most 2 * SAMPLE rows
    bare = {y: sum(r.n for r in grouped if not r.w and r.y == y) for y in (0, 1)}
    model.bare = (w1 * bare[1] + 2 * prior) / (w0 * bare[0] + w1 * bare[1] + 2)
    entries = [(model.vector(tuple(zip(r.w, r.c, strict=True))), r.y, r.n, r.doc_id) for r in grouped if r.w]
    if not entries:
        return model
    model.examples = examples = Examples(entries, len(vocabulary), weights)
    places = {(int(i), int(y)): p for p, (i, y) in enumerate(zip(examples.id, examples.label, strict=True))}
    votes, truth = [], []
    for vector, y, n, doc_id in entries[:: max(1, len(entries) // CALIBRATION)]:  # each one's vote without itself
        p = places[doc_id, y]
        near = examples.nearest(vector, K, leave=p)
        votes += [examples.vote(near, K, leave=p)] * n
        truth += [y] * n
    model.knots, model.levels = rising(np.array(votes), np.array(truth, float), prior, of=np.where(np.array(truth) == 1, w1, w0))
    return model


EVIDENCE_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, evidence (nearest labelled examples).

    Null and empty texts, and texts without a word of the vocabulary, get the smoothed share of
    label 1 among such training rows. Rows repeat as they do in the input; a null doc_id is not
    held out. Without labels every score is 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                got = [model.value.score(t) for t in part.column("text").to_pylist()]
                evidence = [[{"doc_id": i, "label": y, "cosine": min(1.0, c)} for i, y, c in e] for _, e in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in got]), pa.array(evidence, EVIDENCE_TYPE)], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(lean(run), "doc_id long, score double, evidence array<struct<doc_id: bigint, label: int, cosine: double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with the columns of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                keep = pa.array([model.value.score(t)[0] < 0.5 for t in part.column("text").to_pylist()], pa.bool_())
                yield part.select(["row"]).filter(keep)

    return rows.mapInArrow(lean(run), StructType([rows.schema["row"]])).select("row.*")
