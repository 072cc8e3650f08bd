"""Language identification as inference over mixtures of languages.

Letters are read in windows of one to three (with word edges), hashed to BUCKETS, and counted
by language over all training rows. Every word of a text then has a likelihood under each
language (the mean of its windows' smoothed log-likelihoods, scaled by SHARP, so that long
words do not count for whole sentences). Expectation-maximisation finds the proportions of
languages that make a text's words likeliest, first with all of them, until they settle. Of the nested sets of a text's
largest languages the one with the best likelihood, less half of log(words) for each further language, holds. No set is
likelier than all languages together, so larger sets are only tried while that bound lets them win; there is no other limit
to their size. All texts of a batch iterate together, and those that have settled leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

BUCKETS, SHARP, SMOOTH, MIXED = 1 << 16, 6.0, 0.5, 0.1
#: Proportions have settled when none moves by more in a round; ROUNDS is where a text that never does is left.
SETTLED, ROUNDS = 1e-3, 200
#: Languages whose counts are collected; the table takes 0.5 MB for each.
MOST_LANGUAGES = 2000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    table = np.zeros(0x110000, bool)
    for block in range(0, 0x110000, 0x100):
        table[block : block + 0x100] = [chr(c).isalpha() for c in range(block, block + 0x100)]
    return table


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed windows of all texts, the word of each window, and the text of each word.

    A word is a run of letters, lower-cased; its windows are every one, two and three
    characters of it with an edge mark before and behind (an edge alone is none).
    """
    joined = "\n".join(["", *(t or "" for t in texts), ""])
    low = joined.lower()
    if len(low) != len(joined):  # a few letters change length in lower case
        parts = [(t or "").lower() for t in texts]
        low = "\n".join(["", *parts, ""])
        sizes = np.array([len(p) for p in parts], np.int64)
    else:
        sizes = np.array([len(t or "") for t in texts], np.int64)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[codes]
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    word = np.cumsum(np.concatenate(([False], inside[1:] & ~inside[:-1]))) - 1
    text_of = np.searchsorted(starts, begin, side="right") - 1
    c = np.where(inside, codes, 1).astype(np.uint64)
    m = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    at = np.flatnonzero(inside)
    one = (c[at] * m[0]) >> shift
    two = ((c[at - 1] * m[1] + c[at]) * m[0]) >> shift
    last = np.flatnonzero(inside[:-1] & ~inside[1:])  # the edge behind
    two_end = ((c[last] * m[1] + np.uint64(1)) * m[0]) >> shift
    three = (((c[at - 1] * m[1] + c[at]) * m[2] + c[at + 1]) * m[0]) >> shift
    hashed = np.concatenate((one, two, two_end, three)).astype(np.int64)
    words = np.concatenate((word[at], word[at], word[last], word[at]))
    return hashed, words, text_of


def counts(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their counts by bucket, over all ``rows`` (text, lang); tasks send one vector a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_chunks(batch):
                hashed, words, text_of = windows(part.column("text").to_pylist())
                codes = part.column("lang").dictionary_encode()
                of = np.asarray(codes.indices)[text_of][words]
                for i, lang in enumerate(codes.dictionary.to_pylist()):
                    got = np.bincount(hashed[of == i], minlength=BUCKETS)
                    total[lang] = total[lang] + got if lang in total else got
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    summed = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if (many := rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"more than {many - 1} languages")
    summed = summed.toPandas()
    langs = sorted(summed.lang.unique())
    table = np.zeros((len(langs), BUCKETS))
    if langs:
        table[np.searchsorted(langs, summed.lang.to_numpy(str)), summed.bucket.to_numpy()] = summed.n
    return langs, table


class Model:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs = langs
        self.logs = np.log((table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)

    def mixtures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (text, language), zero outside the chosen set, and words of each text."""
        n, k = len(texts), len(self.langs)
        shares = np.zeros((n, k))
        hashed, words, text_of = windows(texts)
        size = np.bincount(text_of, minlength=n)
        if not len(text_of) or not k:
            return shares, size
        per_word = np.bincount(words, minlength=len(text_of))
        like = np.empty((k, len(text_of)), np.float32)
        for i in range(k):
            like[i] = np.bincount(words, weights=self.logs[hashed, i], minlength=len(text_of)) / per_word * SHARP
        like = np.maximum(np.exp(like - like.max(axis=0)), np.float32(1e-30))
        live = np.flatnonzero(size)
        first = np.concatenate(([0], np.cumsum(size[live])))

        def pick(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Likelihoods of the words of some texts, where each text begins, and its number of words."""
            n = size[live[which]]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(begin - first[which], n)
            return like[:, at], begin, n

        def em(which: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Settled proportions (language, text) of some texts from ``pi``, and the log-likelihood they have."""
            out, fit = pi.copy(), np.zeros(len(which))
            todo = np.arange(len(which))
            own, begin, n = pick(which)
            for step in range(ROUNDS):
                of = np.repeat(np.arange(len(todo)), n)
                parts = own * pi[:, of]
                total = np.maximum(parts.sum(axis=0), np.float32(1e-30))
                fit[todo] = np.add.reduceat(np.log(total).astype(np.float64), begin)
                new = np.add.reduceat(parts / total, begin, axis=1) / n.astype(np.float32)
                moving = np.abs(new - pi).max(axis=0) > SETTLED
                out[:, todo] = pi = new
                if not moving.any():
                    break
                if step % 4 == 3 and not moving.all():
                    todo, pi = todo[moving], pi[:, moving]
                    own, begin, n = pick(which[todo])
            return out, fit

        texts_of = np.arange(len(live))
        whole, bound = em(texts_of, np.full((k, len(live)), 1 / k, np.float32))
        order = np.argsort(-whole, axis=0, kind="stable")
        cost = 0.5 * np.log(size[live])
        lead = np.zeros((k, len(live)), np.float32)
        np.put_along_axis(lead, order[:1], 1.0, axis=0)
        chosen = lead.copy()
        logs = np.log(like)
        single = np.stack([np.add.reduceat(x.astype(np.float64), first[:-1]) for x in logs])
        best = np.take_along_axis(single, order[:1], 0)[0]
        for m in range(2, k + 1):
            todo = np.flatnonzero(bound + 1e-6 * np.abs(bound) - (m - 1) * cost > best)
            if not len(todo):
                break
            allowed = np.zeros((k, len(todo)), np.float32)
            np.put_along_axis(allowed, order[:m, todo], 1.0, axis=0)
            start = (whole[:, todo] + 1e-3) * allowed
            pi, fit = em(todo, start / start.sum(axis=0))
            score = fit - (m - 1) * cost[todo]
            better = score > best[todo]
            best[todo[better]] = score[better]
            chosen[:, todo[better]] = pi[:, better]
        shares[live] = chosen.T
        return shares, size


def in_training(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 != 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, languages (those of the mixture, largest first).

    Learns from rows that are not held out and have text and lang; counts cover all of them. A text
    that is null or has no letter, and every text if nothing was learned, is ``und`` with score 0.
    A null doc_id is not held out; rows repeat as they do in the input; ties go to the first language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = rows.where(in_training() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(Model(*counts(learn)))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model.value.langs
        for batch in batches:
            for part in text_chunks(batch, limit=1_000_000):
                shares, size = model.value.mixtures(part.column("text").to_pylist())
                pred, score, mixed = [], [], []
                for s, n in zip(shares, size, strict=True):
                    order = np.argsort(-s, kind="stable") if n and len(langs) else ()
                    pred.append(langs[order[0]] if len(order) else UNKNOWN)
                    score.append(float(min(1.0, s[order[0]])) if len(order) else 0.0)
                    mixed.append([{"lang": langs[i], "share": float(s[i])} for i in order if s[i] >= MIXED])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind)], ["doc_id", "lang_pred", "score", "languages"])

    done = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
    return done.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "languages")
