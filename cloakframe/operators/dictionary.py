"""Literal terms in texts by a word index: a text is read once, however many terms are looked for.

A term stands between characters that are no letters or digits, in any case. Terms are indexed by
all their words in order; only where these follow each other is a term compared, so terms that begin
with one common word cost nothing where another word follows it. Two plans lead there: a
dictionary of a checked size goes to every task, and a larger one meets the texts by an
equi-join on the whole sequence of words, so that each text carries the terms it may hold. Which sequences
of a text are sent to that join is told by a bitmap of bounded size over the beginnings of all terms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import cut

#: Terms and bytes up to which a dictionary is sent to every task.
MOST_TERMS, MOST_BYTES = 200_000, 16_000_000
#: Bytes of text that are looked at together.
SLICE_BYTES = 4_000_000
#: Bits of the bitmap for each beginning of a term, its least and its largest size as powers of two (32 MB).
BITS, LEAST_BITS, MOST_BITS = 16, 15, 28
_WORD = re.compile(r"[^\W_]+")


def in_word(c: str) -> bool:
    """Is the character (or "") a letter or a decimal digit? Word edges are everywhere defined by this."""
    return c.isalpha() or c.isdecimal()


def plain(word: str) -> str:
    """A word without case: equal for words that an expression takes for equal without case."""
    return word.lower() if word.isascii() else "".join(_plain.get(c) or c.upper().lower() for c in word)


#: Letters whose cases don't lead back to each other: the dotted capital I, sharp s, the final sigma.
_plain = {"İ": "i", "ẞ": "ss", "ς": "σ", "Σ": "σ"}


def words(text: str) -> Iterator[tuple[str, int]]:
    """(word without case, place) of the runs of letters and digits, in order."""
    for m in _WORD.finditer(text):
        w, at = m[0], m.start()
        if w.isascii():
            yield w.lower(), at
        elif all(map(in_word, w)):
            yield plain(w), at
        else:  # numerals that are no digits part words
            begin = 0
            for i, c in enumerate([*w, " "]):
                if not in_word(c):
                    if i > begin:
                        yield plain(w[begin:i]), at + begin
                    begin = i + 1


def plain_words(text: str, fold: Callable[[str], str] = plain) -> list[str] | None:
    """The words that ``words`` gives (``fold`` makes those with other letters plain), without their places and far quicker; None if
    numerals that are no digits part words."""
    if text.isascii():
        return _WORD.findall(text.lower())
    found, known = _WORD.findall(text), {}
    for k, w in enumerate(found):
        if w.isascii():
            found[k] = w.lower()
            continue
        if (low := known.get(w)) is None:
            if not all(map(in_word, w)):
                return None
            low = known[w] = fold(w)
        found[k] = low
    return found


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of the text column, one row at least: a batch holds thousands of rows, and what
    is made of them must not stand in memory for all of them."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


#: Under this key a node of a tree of words holds the numbers of the terms that end there; no word is equal to it.
ENDS = ""


def grow(tree: dict, sequence: list[str], i: int) -> None:
    """Puts number ``i`` at the end of a sequence of words in the tree."""
    for w in sequence:
        tree = tree.setdefault(w, {})
    tree.setdefault(ENDS, []).append(i)


class Dictionary:
    """Terms by their words in order. Terms without a letter or digit are never found."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.tree: dict = {}
        self.offset: dict[int, int] = {}
        self.lower = [t.lower() if t.isascii() else None for t in terms]
        self.patterns: dict[int, re.Pattern] = {}
        self.folding: set[int] = set()
        for i, t in enumerate(terms):
            held = list(words(t))
            if held:
                grow(self.tree, [w for w, _ in held], i)
                self.offset[i] = held[0][1]
                low = t.lower()
                # a place that fails at an edge may swallow the begin of a later one, if the term begins anew inside itself
                if any(low.startswith(low[d:]) and not in_word(low[d - 1]) for d in range(1, len(low))):
                    self.folding.add(i)

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.patterns:
            self.patterns[i] = re.compile(re.escape(self.terms[i]), re.IGNORECASE)
        return self.patterns[i]

    def end(self, i: int, text: str, at: int) -> int:
        """Where term ``i`` ends if it stands at ``at`` of the text, else -1."""
        low = self.lower[i]
        if low is not None:
            piece = text[at : at + len(low)]
            if piece.isascii():
                return at + len(low) if piece.lower() == low else -1
        m = self.pattern(i).match(text, at)
        return m.end() if m else -1

    def places(self, i: int, text: str) -> Iterator[tuple[int, int]]:
        """Places of one term, left to right and disjoint, that stand between word edges."""
        for m in self.pattern(i).finditer(text):
            s, e = m.span()
            if not in_word(text[s - 1 : s]) and not in_word(text[e : e + 1]):
                yield s, e

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term); places of one term are disjoint, those of different terms may overlap."""
        until: dict[int, int] = {}
        names, tree, starts = plain_words(text), self.tree, None
        if names is None:
            found = list(words(text))
            names, starts = [w for w, _ in found], [at for _, at in found]
        for k in [k for k, w in enumerate(names) if w in tree]:
            node, j = tree[names[k]], k
            while node is not None:
                for i in node.get(ENDS, ()):
                    if starts is None:  # places are only told where a term's words were met
                        starts = [m.start() for m in _WORD.finditer(text)]
                    s = starts[k] - self.offset[i]
                    if s < until.get(i, 0):
                        continue
                    if i in self.folding:
                        until[i] = len(text) + 1
                        yield from ((a, b, i) for a, b in self.places(i, text))
                        continue
                    e = self.end(i, text, s)
                    if e >= 0 and not in_word(text[s - 1 : s] if s else "") and not in_word(text[e : e + 1]):
                        until[i] = e
                        yield s, e, i
                j += 1
                node = node.get(names[j]) if j < len(names) else None


def _step(h: int, word: str) -> int:
    """The hash of a sequence of words and one more, never 0."""
    return zlib.crc32(b"\0" + word.encode("utf-8", "surrogatepass"), h) or 1


def _end(h: int) -> int:
    """The hash that tells that a term ends here, not only passes."""
    return zlib.crc32(b"\1", h)


def word_sequence(terms: DataFrame, term: str, split: Callable) -> DataFrame:
    """``terms`` with ``_w``, its words as they are joined on, and ``_h``, the hashes of its beginnings and of its end; terms without a
    word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = [], []
            for t in batch.column(term).to_pylist():
                held = [x[0] for x in split(t or "")]
                names.append(" ".join(held) if held else None)
                h, own = 0, []
                for w in held:
                    h = _step(h, w)
                    own.append(h)
                hashes.append([*own, _end(h)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], [*batch.schema.names, "_w", "_h"])

    fields = [*terms.schema.fields, T.StructField("_w", T.StringType()), T.StructField("_h", T.ArrayType(T.LongType()))]
    return terms.mapInArrow(run, T.StructType(fields)).where("_w IS NOT NULL")


def bitmap_of(asked: DataFrame) -> tuple[bytes, int]:
    """A bitmap over the hashes ``_h`` and its size as a power of two. Only its bytes come to the driver."""
    entries = asked.agg(F.coalesce(F.sum(F.size("_h")), F.lit(0))).first()[0]
    power = min(MOST_BITS, max(LEAST_BITS, int(BITS * entries).bit_length()))
    places = asked.select(F.explode("_h").alias("h")).select(F.col("h").bitwiseAND(F.lit((1 << power) - 1)).alias("p"))
    rows = places.groupBy(F.shiftright("p", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = bytearray(1 << power - 3)
    for r in rows.toLocalIterator():
        bits[r.b << 12 : (r.b + 1) << 12] = r.bits
    return bytes(bits), power


def sequences(found: list[str], bits: bytes, power: int) -> set[str]:
    """Sequences of the words ``found`` that the bitmap takes for terms: all that are, and few that are not."""
    mask, out = (1 << power) - 1, set()
    first: dict[str, int] = {}
    for k, w in enumerate(found):
        h = first.get(w)
        if h is None:  # 0 where no term begins with the word
            h = _step(0, w)
            h = first[w] = h if bits[(h & mask) >> 3] >> (h & 7) & 1 else 0
        j = k + 1
        while h:
            e = _end(h)
            if bits[(e & mask) >> 3] >> (e & 7) & 1:
                out.add(" ".join(found[k:j]))
            if j == len(found):
                break
            h = _step(h, found[j])
            j += 1
            if not bits[(h & mask) >> 3] >> (h & 7) & 1:
                break
    return out


def sequence_rows(texts: DataFrame, keys: list[str], column: str, split: Callable, bits: bytes, power: int) -> DataFrame:
    """``keys`` and each distinct sequence of words of ``column`` that may be a term, once."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                at, found = [], []
                for r, text in enumerate(batch.column(column).to_pylist()):
                    own = sequences(told if split is words and (told := plain_words(text or "")) is not None else [x[0] for x in split(text or "")], sent.value, power)
                    at += [r] * len(own)
                    found += own
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), pa.array(found, pa.string())], [*keys, "_w"])

    rows = texts.select(*keys, column)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != column)
    return rows.mapInArrow(run, f"{schema}, _w string")


def small(terms: DataFrame, column: str) -> bool:
    """Does the dictionary fit in every task?"""
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n <= MOST_TERMS and size <= MOST_BYTES


def look_up(texts: DataFrame, keys: list[str], column: str, terms: DataFrame, term: str, use: Callable[[pa.RecordBatch, Callable[[int], tuple[Dictionary, pa.Table]]], Iterator[pa.RecordBatch]], schema: str, broadcast: bool | None = None, carry: bool = False, make: Callable = Dictionary, split: Callable = words) -> DataFrame:
    """What ``use`` makes of every batch of ``texts`` (columns keys and column).

    ``use(batch, held)`` gets the batch and a function from a row's number to the dictionary that may stand in its text and the
    table of its terms. ``carry`` keeps texts that may hold no term. ``broadcast`` overrides the size check, for tests.
    ``make`` builds the dictionary of a list of terms, and ``split`` gives the words that it goes by.
    """
    names = terms.columns
    if small(terms, term) if broadcast is None else broadcast:
        table = pa.Table.from_pylist([r.asDict(recursive=True) for r in terms.collect()], pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in terms.schema.fields]))
        sent = texts.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = (make(sent.value.column(term).to_pylist()), sent.value)
            for batch in batches:
                for piece in slices(batch, column):
                    yield from use(piece, lambda r: book)

        return texts.mapInArrow(run, schema)
    asked = cut(word_sequence(terms, term, split))
    met = sequence_rows(texts, keys, column, split, *bitmap_of(asked)).join(asked.drop("_h"), "_w").groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*names))).alias("_terms"))
    joined = texts.join(met, keys, "left" if carry else "inner")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                found = batch.column("_terms")

                def held(r: int, found: pa.Array = found) -> tuple[Dictionary, pa.Table]:
                    rows = pa.Table.from_pylist(found[r].as_py() or [], pa.schema(list(found.type.value_type)))
                    return make(rows.column(term).to_pylist()), rows

                yield from use(batch.select([c for c in batch.schema.names if c != "_terms"]), held)

    return joined.select(*texts.columns, "_terms").mapInArrow(run_joined, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[kind]
