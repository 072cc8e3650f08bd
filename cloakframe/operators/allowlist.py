"""The never-anonymise list: literal terms and ``regex:`` entries, an anti-filter over spans."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import quoted

REGEX_PREFIX = "regex:"
MIN_CHARS = 3
# Terms offered at the start.
DEFAULT_TERMS = [
    "CSSF", "ECB", "BCE", "EBA", "ESMA", "EIOPA", "BCL", "CNPD", "FATF", "OECD", "IMF",
    "Agile", "Scrum", "Kanban", "PRINCE2", "TOGAF", "ITIL", "COBIT",
    "IFRS", "GAAP", "Basel III", "Solvency II", "MiFID II", "GDPR", "RGPD", "ISO 27001", "ISAE 3402", "SOC 2",
    "Luxembourg", "France", "Germany", "Belgium", "Netherlands", "Switzerland",
    "United Kingdom", "United States", "Ireland", "Italy", "Spain", "Portugal",
    "Austria", "Poland", "Allemagne", "Belgique", "Pays-Bas", "Suisse", "Royaume-Uni",
]
MEANS = r'["\x{201c}]([^"\x{201c}\x{201d}\n]{2,60}?)["\x{201d}][ ]*(?:shall[ ]+mean|means)(?![A-Za-z0-9_])'
PARENTHETICAL = r'\((?:[ ]*(?:together|collectively)[ ]+)?(?:the|a|an|each[ ]+an?|each)[ ]+["\x{201c}]([^"\x{201c}\x{201d}\n]{2,60}?)["\x{201d}][ ]*\)'


class Allowlist:
    """Terms in order, deduplicated without case; expressions that don't compile are kept in ``errors``."""

    def __init__(self, terms: list[str] | None = None):
        self.literals: dict[str, str] = {}
        self.patterns: dict[str, str] = {}
        self.errors: list[str] = []
        self.held: DataFrame | None = None  # further literals, in any number: column ``term_lc``
        for t in terms or []:
            self.add(t)

    def add(self, term: str) -> None:
        term = term.strip()
        if term.startswith(REGEX_PREFIX):
            body = term[len(REGEX_PREFIX) :].strip()
            try:
                re.compile(body)
            except re.error as error:
                self.errors.append(f"{body}: {error}")
                return
            if body:
                self.patterns[term.lower()] = body
        elif term:
            self.literals.setdefault(term.lower(), term)

    def remove(self, term: str) -> None:
        self.literals.pop(term.strip().lower(), None)
        self.patterns.pop(term.strip().lower(), None)

    def terms(self) -> list[str]:
        return sorted(self.literals.values()) + sorted(REGEX_PREFIX + p for p in self.patterns.values())

    def contains(self, text: str) -> bool:
        return text.strip().lower() in self.literals or any(re.search(p, text, re.I) for p in self.patterns.values())

    def matches(self, column: str) -> Column:
        """Is the string column on the list? Literals become one hashed IN-set, expressions an OR."""
        hit = F.lower(F.trim(column)).isin(list(self.literals)) if self.literals else F.lit(False)
        for p in self.patterns.values():
            hit = hit | F.col(column).rlike(f"(?iu){p}")
        return F.coalesce(hit, F.lit(False))


def with_defaults() -> Allowlist:
    return Allowlist(DEFAULT_TERMS)


def filter_allowed(rows: DataFrame, allow: Allowlist, column: str = "original") -> DataFrame:
    """The rows whose text is not on the list: literals and expressions as a filter, the list's table as an anti-join."""
    rows = rows.where(~allow.matches(column))
    if allow.held is None:
        return rows
    return rows.join(allow.held.select(F.col("term_lc").alias("_held")), F.lower(F.trim(column)) == F.col("_held"), "left_anti")


def composed(terms: list[str], removed: DataFrame | None = None, defined: DataFrame | None = None) -> Allowlist:
    """The list of a request: its own terms, main texts and spellings of removed values, and all forms of defined terms. The
    latter two stay tables, however many there are."""
    allow, parts = Allowlist(terms), []
    if removed is not None:
        parts.append(removed.select(F.explode(F.concat(F.array("main_text"), F.coalesce("spellings", F.array().cast("array<string>")))).alias("t")))
    if defined is not None:
        parts.append(defined.select(F.explode(defined_term_forms(F.col("term"))).alias("t")))
    if parts:
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        allow.held = rows.select(F.lower(F.trim("t")).alias("term_lc")).where("term_lc <> ''").distinct()
    return allow


def parse_csv(raw: bytes) -> list[str]:
    """Terms of a CSV: BOM and ``#`` comments ignored, column ``term`` or else the first, no repeats; ``;`` may separate."""
    text = raw.decode("utf-8-sig")
    lines = [line for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if line.strip() and not line.lstrip().startswith("#")]
    if not lines:
        return []
    separator = ";" if lines[0].count(";") > lines[0].count(",") else ","
    rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=separator, skipinitialspace=True))
    header = [c.strip().lower() for c in rows[0]]
    column, rows = (header.index("term"), rows[1:]) if "term" in header else (0, rows)
    found: dict[str, str] = {}
    for row in rows:
        if len(row) > column and (t := row[column].strip()):
            found.setdefault(t.lower(), t)
    return list(found.values())


def template_csv() -> bytes:
    return "# one term per line; regex: starts an expression\nterm\nLuxembourg\nregex:^Project [A-Z]$\n".encode()


def discover_defined_terms(documents: DataFrame) -> DataFrame:
    """``doc_ord, name, term, idiom``: what documents (doc_ord, name, text) define as vocabulary, once per document."""
    idioms = [("means", MEANS), ("parenthetical", PARENTHETICAL)]
    found = F.concat(*[F.expr(f"transform(regexp_extract_all(coalesce(text, ''), {quoted(p)}, 1), t -> struct({i} AS i, '{n}' AS idiom, t AS raw))") for i, (n, p) in enumerate(idioms)])
    rows = documents.select("doc_ord", "name", F.posexplode(found).alias("at", "x"))
    plain = F.regexp_replace("x.raw", "[*_]{1,3}", "")
    term = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^[ \t.,;:]+|[ \t.,;:]+$", ""), r"\s+", " "), "^ | $", "")
    rows = rows.select("doc_ord", "name", "at", term.alias("term"), "x.idiom").where(F.length("term") >= MIN_CHARS)
    first = rows.groupBy("doc_ord", "name", F.lower("term").alias("k")).agg(F.min(F.struct("at", "term", "idiom")).alias("f"))
    return first.select("doc_ord", "name", "f.term", "f.idiom")


def defined_term_forms(term: Column) -> Column:
    """The term, its possessives and the plural of its last word."""
    low = F.lower(term)
    plural = (
        F.when(low.rlike("(?:s|x|z|ch|sh)$"), F.concat(term, F.lit("es")))
        .when(low.rlike("[^aeiou ]y$"), F.concat(F.regexp_replace(term, ".$", ""), F.lit("ies")))
        .otherwise(F.concat(term, F.lit("s")))
    )
    return F.array(term, F.concat(term, F.lit("'s")), F.concat(term, F.lit("’s")), plural)


def filter_removed(values: DataFrame, removed: DataFrame) -> DataFrame:
    """Values whose main text is no main text or spelling of a removed one, whatever the case."""
    gone = removed.select(F.explode(F.concat(F.array("main_text"), F.coalesce("spellings", F.array().cast("array<string>")))).alias("t")).select(F.lower(F.trim("t")).alias("t")).distinct()
    return values.join(gone, F.lower(F.trim(values.main_text)) == gone.t, "left_anti")
