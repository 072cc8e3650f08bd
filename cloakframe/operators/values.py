"""Known values: spelling expansion, and a dictionary scan that reads each text once."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import quoted
from .allowlist import Allowlist, filter_allowed
from .dictionary import Dictionary, look_up
from .patterns import finished

MIN_SPELLING = 3
DECLARED = 0.95
PERSON = {"person_names"}
LITERAL = {"identifier_names", "other_names", "country_names", "nationality_names", "business_sector_names"}
# Particles that begin a surname, and legal forms in the order they are tried.
PARTICLES = {"de", "la", "le", "du", "des", "van", "von", "der", "den", "d'"}
LEGAL_FORMS = [
    "S.à r.l.", "S.à.r.l.", "S.àr.l.", "Sàrl", "SARL", "S.C.A.", "S.C.S.", "SCSp", "S.p.A.", "S.A.", "SA", "ASBL", "SE",
    "GmbH", "AG", "N.V.", "B.V.", "Ltd", "Limited", "LLC", "plc", "SAS", "Inc.", "Inc",
]
METHOD_CLASS = {"manual": "user_defined", "signal": "rules_discovered", "heuristic": "rules_discovered", "local_llm": "local_llm_discovered"}
CLASS_ORDER = ["built_in_pattern", "user_defined", "rules_discovered", "local_llm_discovered"]


def person_forms(name: str) -> list[str]:
    """Derived spellings of a person's name, in the order they are derived."""
    forms = [name.replace("-", " ")] if "-" in name else []
    forms += [name.replace(" ", "-")] if " " in name else []
    words = name.split()
    if len(words) < 2:
        return forms
    start = next((i for i in range(1, len(words) - 1) if words[i].lower() in PARTICLES), 1)
    surname = " ".join(words[start:])
    forms += [f"{words[0][0]}. {surname}", f"{words[0][0]}.{surname}", surname, words[0]]
    return forms + ([words[-1]] if words[-1] != surname else [])


def organisation_forms(name: str) -> list[str]:
    """The name without one trailing legal form."""
    return next(([name.removesuffix(f" {s}")] for s in LEGAL_FORMS if name.endswith(f" {s}")), [])


def expand_spellings(category: str, main_text: str, spellings: list[str] | None = None, curated: bool = False) -> list[str]:
    """All spellings of a value, longest first; a curated one derives nothing."""
    derived: list[str] = []
    if not curated and category not in LITERAL:
        derived = person_forms(main_text) if category in PERSON else organisation_forms(main_text)
    kept: dict[str, str] = {}
    for s in [main_text, *derived, *(spellings or [])]:
        s = s.strip()
        if len(s) >= MIN_SPELLING:
            kept.setdefault(s.lower(), s)
    return sorted(kept.values(), key=lambda s: (-len(s), s))


def match_class(methods: list[str] | None) -> str:
    """The strongest class of the methods; none or an unknown one counts as the user's own."""
    classes = [METHOD_CLASS.get(m, "user_defined") for m in methods or []] or ["user_defined"]
    return min(classes, key=CLASS_ORDER.index)


VALUES = "value_ord long, category string, main_text string, spellings array<string>, curated boolean, methods array<string>, confidence double"


def _spellings_sql() -> str:
    """``expand_spellings`` of the columns of VALUES, as an expression."""
    words = "filter(split(main_text, '\\\\s+'), x -> x <> '')"
    particles = ", ".join(quoted(p) for p in sorted(PARTICLES))
    # where the surname begins: at the first particle between the first and the last word, else at the second word
    start = f"coalesce(try_element_at(filter(sequence(2, greatest(size(w) - 1, 2)), i -> i < size(w) AND lower(w[i - 1]) IN ({particles})), 1), 2)"
    surname = "array_join(slice(w, s, size(w)), ' ')"
    person = f"""transform(array({words}), w -> transform(array({start}), s -> concat(
        CASE WHEN contains(main_text, '-') THEN array(replace(main_text, '-', ' ')) ELSE array() END, CASE WHEN contains(main_text, ' ') THEN array(replace(main_text, ' ', '-')) ELSE array() END,
        CASE WHEN size(w) < 2 THEN array() ELSE array(concat(left(w[0], 1), '. ', {surname}), concat(left(w[0], 1), '.', {surname}), {surname}, w[0], element_at(w, -1)) END))[0])[0]"""
    forms = " ".join(f"WHEN endswith(main_text, {quoted(' ' + f)}) THEN array(left(main_text, length(main_text) - {len(f) + 1}))" for f in LEGAL_FORMS)
    literal = ", ".join(quoted(c) for c in sorted(LITERAL))
    derived = f"CASE WHEN coalesce(curated, false) OR category IN ({literal}) THEN array() WHEN category IN ({', '.join(map(quoted, PERSON))}) THEN {person} {forms} ELSE array() END"
    every = f"transform(concat(array(main_text), {derived}, coalesce(spellings, array())), x -> regexp_replace(x, '^\\\\s+|\\\\s+$', ''))"
    kept = f"transform(array(filter({every}, x -> length(x) >= {MIN_SPELLING})), k -> filter(k, (x, i) -> NOT exists(slice(k, 1, i), y -> lower(y) = lower(x))))[0]"
    return f"array_sort({kept}, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)"


def spelling_rows(values: DataFrame) -> DataFrame:
    """``value_ord, category, main_text, spelling, match_class, confidence`` of VALUES rows, without Python."""
    score = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(F.lit(DECLARED))
    rank = F.expr("coalesce(array_min(transform(methods, m -> CASE WHEN m IN ('signal', 'heuristic') THEN 3 WHEN m = 'local_llm' THEN 4 ELSE 2 END)), 2)")
    rows = values.withColumns({"main_text": F.coalesce("main_text", F.lit("")), "category": F.coalesce("category", F.lit(""))})
    klass = F.element_at(F.array(*[F.lit(c) for c in CLASS_ORDER]), rank)
    return rows.select("value_ord", "category", "main_text", F.explode(F.expr(_spellings_sql())).alias("spelling"), klass.alias("match_class"), score.alias("confidence"))


SPANS = "doc_ord long, region_ord long, start int, end int, category string, original string, main_text string, confidence double, checksum_ok boolean, match_class string"


def _spans(batch: pa.RecordBatch, held, shielded: re.Pattern | None = None) -> Iterator[pa.RecordBatch]:
    """Span columns for what the dictionary of each row finds outside what ``shielded`` matches, a batch for each run of rows
    that share one."""
    rows, starts, ends, originals, which = [], [], [], [], []

    def emit(table: pa.Table) -> pa.RecordBatch:
        of = table.take(pa.array(which, pa.int64())).combine_chunks()
        column = lambda c: of.column(c).combine_chunks() if of.num_rows else pa.array([], of.schema.field(c).type)
        place = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_ord").take(place), batch.column("region_ord").take(place), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), column("category"), pa.array(originals, pa.string()), column("main_text"), column("confidence"), pa.array([True] * len(rows)), column("match_class")], schema=_SPAN_SCHEMA)

    table = None
    for r, text in enumerate(batch.column("text").to_pylist()):
        book, own = held(r)
        if table is not None and own is not table and rows:
            yield emit(table)
            rows, starts, ends, originals, which = [], [], [], [], []
        table = own
        shields = [m.span() for m in shielded.finditer(text or "")] if shielded else []
        begins = [a for a, _ in shields]
        for s, e, i in book.find(text or ""):
            if shields and (at := bisect_left(begins, e)) and shields[at - 1][1] > s:
                continue
            rows.append(r)
            starts.append(s)
            ends.append(e)
            originals.append(text[s:e])
            which.append(i)
    if rows:
        yield emit(table)


_SPAN_SCHEMA = pa.schema([("doc_ord", pa.int64()), ("region_ord", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("original", pa.string()), ("main_text", pa.string()), ("confidence", pa.float64()), ("checksum_ok", pa.bool_()), ("match_class", pa.string())])


def detect_values(regions: DataFrame, values: DataFrame, allow: Allowlist | None = None, broadcast: bool | None = None) -> DataFrame:
    """Spans of every spelling of ``values`` (VALUES) in ``regions`` (doc_ord, region_ord, text).

    Terms on the never-anonymise list are left out, as spellings and as found. Spans of different
    spellings may overlap. Spellings without a letter or digit are not searched.
    """
    allow = allow or Allowlist()
    spellings = filter_allowed(spelling_rows(values), allow, "spelling").drop("value_ord")
    body = regions.where("text IS NOT NULL").select("doc_ord", "region_ord", "text")
    rows = look_up(body, ["doc_ord", "region_ord"], "text", spellings, "spelling", _spans, SPANS, broadcast)
    return finished(filter_allowed(rows, allow, "original"))


def detect_known(regions: DataFrame, registry: DataFrame, allow: Allowlist | None = None, broadcast: bool | None = None) -> DataFrame:
    """Spans of registry originals in ``regions``, outside placeholders. They are as strong as a built-in pattern's: a string
    that has a placeholder keeps it."""
    allow = allow or Allowlist()
    columns = ["category", F.col("original").alias("main_text"), F.col("original").alias("spelling"), F.lit("built_in_pattern").alias("match_class"), F.lit(1.0).alias("confidence")]
    terms = filter_allowed(registry.select(*columns), allow, "spelling")
    body = regions.where("text IS NOT NULL").select("doc_ord", "region_ord", "text")
    rows = look_up(body, ["doc_ord", "region_ord"], "text", terms, "spelling", lambda b, held: _spans(b, held, _PLACEHOLDER), SPANS, broadcast)
    return finished(filter_allowed(rows, allow, "original"))


_PLACEHOLDER = re.compile(r"\[[A-Z][A-Z0-9_]*_[0-9]+\]")


def count_terms(regions: DataFrame, terms: list[str]) -> DataFrame:
    """``term, matches, documents`` for literal terms, all of them, without case and between non-letters.

    The terms are the caller's own list; each text is read once, and a document gives one row for each term it holds.
    """
    asked = list(dict.fromkeys(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Dictionary(asked)
        for batch in batches:
            rows, which, many = [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                for i, n in Counter(i for _, _, i in book.find(text or "")).items():
                    rows.append(r)
                    which.append(asked[i])
                    many.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_ord").take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(many, pa.int64())], ["doc_ord", "term", "n"])

    counted = regions.where("text IS NOT NULL").select("doc_ord", "text").mapInArrow(run, "doc_ord long, term string, n long")
    found = counted.groupBy("term", "doc_ord").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("matches"), F.count("*").alias("documents"))
    rows = regions.sparkSession.createDataFrame([(t,) for t in asked], "term string")
    return rows.join(found, "term", "left").select("term", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("documents", F.lit(0)).alias("documents"))
