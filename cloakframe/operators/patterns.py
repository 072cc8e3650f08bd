"""The built-in pattern scan.

The table is pruned on the driver by selection and country, then every remaining pattern is one
native expression of a single projection, so a region's text is read once whatever the number of
patterns. Spans carry code-point places; ``checksum_ok`` keeps a failed corroborating checksum
apart from the score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.spans import B, S, edged, matches, placed, quoted
from ..plans.presets import DEFAULT_COUNTRY, applies_to

SPAN_COLUMNS = ["doc_ord", "region_ord", "start", "end", "byte_len", "category", "original", "main_text", "confidence", "checksum_ok", "match_class", "rank", "owner_key"]
DETERMINISTIC, CHECKSUM_FAILED = 1.0, 0.7
#: No match of a pattern that looks back is shorter.
SHORTEST = 8
RANKS = {"built_in_pattern": 1, "user_defined": 2, "rules_discovered": 3, "local_llm_discovered": 4}


@dataclass(frozen=True)
class Pattern:
    category: str
    regex: str
    countries: tuple[str, ...] = ()
    valid: Callable[[str], str] | None = None
    checksum: Callable[[str], str] | None = None
    before: tuple[int, str, bool] | None = None  # window, pattern at its end, whether it must match


# Shapes of the built-in categories.
_NB = r"\x{00a0}\x{202f}\x{2009}"
_CURRENCY = r"(?:€|EUR|USD|GBP|CHF|\$|£)"
_NUMBER = rf"[0-9]{{1,3}}(?:[.,'{_NB} ][0-9]{{3}})*(?:[.,][0-9]{{1,2}})?[kKmM]?"
_MONTHS_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
_MONTHS_FR = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
_STREETS = (
    "rue|Rue|avenue|Avenue|boulevard|Boulevard|place|Place|impasse|Impasse|chemin|Chemin|route|Route|quai|Quai|allée|Allée|allee|Allee|"
    "square|Square|street|Street|road|Road|lane|Lane|drive|Drive|esplanade|Esplanade|cours|Cours|montée|Montée|montee|Montee|voie|Voie|"
    "passage|Passage|rond-point|Rond-Point|cité|Cité|cite|Cite|val|Val|op|Op|am|Am"
)
PATTERNS = [
    Pattern("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Pattern("url", rf"https?://[^{S}<>\"')\]]+|{B}www\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/(?:[^{S}<>\"')\],]*[^{S}<>\"')\],.;:!?])?)?"),
    Pattern("iban", rf"{B}[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,4}})?{B}", checksum=v.iban),
    Pattern("vat", rf"{B}LU[0-9]{{8}}{B}", ("LU",)),
    Pattern("vat", rf"{B}FR[0-9A-Z]{{2}}[0-9]{{9}}{B}", ("FR",)),
    Pattern("vat", rf"{B}DE[0-9]{{9}}{B}", ("DE",)),
    Pattern("vat", rf"{B}ES[A-Z0-9][0-9]{{7}}[A-Z0-9]{B}", ("ES",)),
    Pattern("vat", rf"{B}GB(?:[0-9]{{9}}|[0-9]{{12}}){B}", ("UK",)),
    Pattern("matricule", r"(?<![0-9])[0-9]{13}", ("LU",)),
    Pattern("phone", r"(?:\+352|00352)(?:[ .\-/]?[0-9]{1,4}){2,5}", ("LU",), v.phone_lu),
    Pattern("phone", rf"(?:\+33|0033)(?:[ .\-/]?[0-9])(?:[ .\-/]?[0-9]{{2}}){{4}}|{B}0[1-9](?:[ .\-/]?[0-9]{{2}}){{4}}{B}", ("FR",), lambda x: v.phone(x, "33", "0", 10, 10, "0")),
    Pattern("phone", rf"(?:\+49|0049)(?:[ .\-/]?[0-9]{{1,4}}){{3,5}}|{B}0[1-9][0-9]{{1,4}}(?:[ .\-/]?[0-9]{{2,4}}){{2,3}}{B}", ("DE",), lambda x: v.phone(x, "49", "0", 10, 12, "0")),
    Pattern("phone", rf"(?:\+34|0034)(?:[ .\-/]?[0-9]{{3}}){{3}}{B}|{B}[6789][0-9]{{2}}(?:[ .\-/]?[0-9]{{3}}){{2}}{B}", ("ES",), lambda x: v.phone(x, "34", "", 9, 9, "[6789]")),
    Pattern("phone", rf"(?:\+44|0044)(?:[ .\-/]?[0-9]{{2,4}}){{3,4}}|{B}0(?:7[0-9]{{3}}|1[0-9]{{2,4}}|2[0-9]{{2,4}})(?:[ .\-/]?[0-9]{{3,4}}){{2}}{B}", ("UK",), lambda x: v.phone(x, "44", "0", 10, 11, "0")),
    Pattern("amount", rf"{_CURRENCY}[{S}{_NB}]?{_NUMBER}|{B}{_NUMBER}[{S}{_NB}]?{_CURRENCY}"),
    Pattern("date", rf"{B}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{B}|{B}[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}{B}"
            rf"|{B}[0-9]{{1,2}}(?:st|nd|rd|th)?[{S}](?:{_MONTHS_EN}|{_MONTHS_FR})[{S}][0-9]{{4}}{B}|{B}(?:{_MONTHS_EN})[{S}][0-9]{{1,2}},?[{S}][0-9]{{4}}{B}"),
    Pattern("credit_card", rf"{B}[0-9]{{13,19}}{B}|{B}[0-9]{{4}}(?:[ \-][0-9]{{4,6}}){{2,3}}[0-9]?{B}", valid=v.luhn, before=(8, rf"{B}[A-Z]{{2}}[0-9]{{2}}[ ]?$", False)),
    Pattern("uk_nhs", rf"{B}[0-9]{{3}}[ \-]?[0-9]{{3}}[ \-]?[0-9]{{4}}{B}|{B}[0-9]{{10}}{B}", ("UK",), v.nhs),
    Pattern("ip_address", rf"{B}[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}{B}", valid=v.ipv4),
    Pattern("ip_address", rf"{B}(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}{B}|(?:[0-9A-Fa-f]{{1,4}}:){{1,7}}:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}})*"),
    Pattern("mac_address", rf"{B}[0-9A-Fa-f]{{2}}(?:[:\-][0-9A-Fa-f]{{2}}){{5}}{B}"),
    Pattern("crypto", rf"{B}(?:[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}|bc1[a-z0-9]{{25,62}}){B}"),
    Pattern("database_uri", rf"{B}(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql|jdbc:[a-z]+)://[^{S}<>\"')\]]+"),
    Pattern("de_steuer_id", r"(?<![0-9])[1-9][0-9]{10}", ("DE",)),
    Pattern("bic", rf"{B}[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{B}", valid=v.bic, before=(32, rf"(?i){B}(?:bic|swift)(?:[ ]?code)?[ ]*[:/=,.\-]*[ ]*$", True)),
    Pattern("postal_code", rf"{B}L-[0-9]{{4}}{B}", ("LU",)),
    Pattern("address", rf"{B}[0-9]{{1,4}}(?:[ ]?[a-zA-Z])?,[ ]?(?:{_STREETS})(?:[ ](?:d[eu]s?|l[ae]|l'|d')?[ ]?[\p{{L}}][\p{{L}}'’\-]*){{1,4}}", ("LU", "FR")),
    Pattern("es_nif", rf"{B}[0-9]{{8}}[A-Za-z]{B}", ("ES",), v.nif),
]

PATTERNS = [replace(p, regex=edged(p.regex), before=p.before and (p.before[0], edged(p.before[1]), p.before[2])) for p in PATTERNS]


def active_patterns(selection: dict[str, bool], country: str = "") -> list[Pattern]:
    """Patterns whose category is on and exists in the country, and whose own country fits."""
    country = country or DEFAULT_COUNTRY
    return [p for p in PATTERNS if selection.get(p.category) and applies_to(p.category, country) and (not p.countries or country in p.countries)]


def _kept(p: Pattern, spans: str) -> str:
    tests = ["NOT left(x.a, 1) RLIKE '^[0-9]'"]
    if p.valid:
        tests.append(f"({p.valid('x.t')})")
    if p.before:
        _, regex, must = p.before
        tests.append(f"{'' if must else 'NOT '}(x.b RLIKE {quoted(regex)})")
    ok = f"({p.checksum('x.t')})" if p.checksum else "true"
    return f"transform(filter({spans}, x -> {' AND '.join(tests)}), x -> struct(x.s AS s, x.e AS e, x.t AS t, '{p.category}' AS c, {ok} AS ok))"


def finished(spans: DataFrame) -> DataFrame:
    """Span rows with the columns that follow from the others, in order."""
    return (
        spans.withColumn("byte_len", F.octet_length("original"))
        .withColumn("rank", F.create_map(*[F.lit(z) for pair in RANKS.items() for z in pair])[F.col("match_class")])
        .withColumn("owner_key", F.lower(F.coalesce("main_text", "original")))
        .select(*SPAN_COLUMNS)
    )


def scan_patterns(regions: DataFrame, selection: dict[str, bool], country: str = "") -> DataFrame:
    """Spans of the enabled patterns over ``regions`` (doc_ord, region_ord, text). A null text has none."""
    found = active_patterns(selection, country)
    body = regions.select("doc_ord", "region_ord", F.coalesce("text", F.lit("")).alias("_text"))
    if not found:
        found, body = PATTERNS[:1], body.limit(0)
    body = body.withColumns({f"_m{i}": F.expr(matches("_text", p.regex)) for i, p in enumerate(found)})
    body = body.withColumns({f"_p{i}": F.expr(placed("_text", quoted(p.regex), f"_m{i}", (p.before[0] if p.before else 0, 1, SHORTEST if p.before else 1))) for i, p in enumerate(found)})
    rows = body.select("doc_ord", "region_ord", F.explode(F.expr(f"concat({', '.join(_kept(p, f'_p{i}') for i, p in enumerate(found))})")).alias("x"))
    ok = F.col("x.ok")
    return finished(rows.select(
        "doc_ord", "region_ord", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.c").alias("category"), F.col("x.t").alias("original"), F.lit(None).cast("string").alias("main_text"),
        F.when(ok, F.lit(DETERMINISTIC)).otherwise(F.lit(CHECKSUM_FAILED)).alias("confidence"), ok.alias("checksum_ok"), F.lit("built_in_pattern").alias("match_class"),
    ))


def scan_custom(regions: DataFrame, expressions: list[str]) -> DataFrame:
    """Spans of the user's own patterns; those that don't compile are skipped, empty matches ignored."""
    good = [e for e in expressions if valid_custom(e) == ""]
    body = regions.select("doc_ord", "region_ord", F.coalesce("text", F.lit("")).alias("_text"))
    if not good:
        good, body = ["a"], body.limit(0)
    body = body.withColumns({f"_m{i}": F.expr(f"filter({matches('_text', e)}, m -> m <> '')") for i, e in enumerate(good)})
    parts = ", ".join(placed("_text", quoted(f"(?=[\\s\\S])(?:{e})"), f"_m{i}") for i, e in enumerate(good))
    rows = body.select("doc_ord", "region_ord", F.explode(F.expr(f"concat({parts})")).alias("x"))
    return finished(rows.select(
        "doc_ord", "region_ord", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.lit("custom_patterns").alias("category"), F.col("x.t").alias("original"), F.lit(None).cast("string").alias("main_text"),
        F.lit(1.0).alias("confidence"), F.lit(True).alias("checksum_ok"), F.lit("user_defined").alias("match_class"),
    ))


def valid_custom(expression: str) -> str:
    """``""`` for a usable pattern, else why not. Look-around and back-references are refused, to stay linear."""
    import re

    if not expression.strip():
        return "empty pattern"
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<", expression):
        return "look-around and back-references are not supported"
    if re.search(r"[*+?}]\+", expression):
        return "possessive quantifiers are not supported"
    try:
        re.compile(expression)
    except re.error as error:
        return str(error)
    return ""
