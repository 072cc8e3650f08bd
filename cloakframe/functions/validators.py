"""Checksums and shape checks as native SQL expressions over one string expression."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession

from .spans import quoted


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(x: str) -> str:
    """13 to 19 digits once spaces and hyphens are gone, passing Luhn."""
    bare = f"regexp_replace({x}, '[ -]', '')"
    return f"length({bare}) BETWEEN 13 AND 19 AND luhn_check({bare})"


def iban(x: str) -> str:
    """ISO 13616: the first four characters behind the rest, letters as 10 to 35, remainder 1 by 97."""
    bare = f"replace({x}, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 4))"
    return f"""length({bare}) BETWEEN 15 AND 34 AND aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (m, c) -> CASE
        WHEN ascii(c) BETWEEN 48 AND 57 THEN (m * 10 + ascii(c) - 48) % 97
        WHEN ascii(c) BETWEEN 65 AND 90 THEN (m * 100 + ascii(c) - 55) % 97 ELSE 98 END) = 1"""


def nhs(x: str) -> str:
    """Ten digits; 11 less the weighted sum (10 down to 2) mod 11 is the last one, 11 counting as 0 and 10 as wrong."""
    d = digits(x)
    total = f"aggregate(sequence(1, 9), 0, (t, i) -> t + (11 - i) * cast(substring({d}, i, 1) AS int))"
    return f"CASE WHEN length({d}) = 10 THEN (11 - {total} % 11) % 11 = cast(substring({d}, 10, 1) AS int) ELSE false END"


def nif(x: str) -> str:
    """Eight digits and the letter that belongs to them mod 23."""
    return f"upper(substring({x}, 9, 1)) = substring('TRWAGMYFPDXBNJZSQVHLCKE', cast(substring({x}, 1, 8) AS int) % 23 + 1, 1)"


def ipv4(x: str) -> str:
    return f"forall(split({x}, '[.]'), o -> cast(o AS int) <= 255)"


@cache
def country_codes() -> tuple[str, ...]:
    """The ISO 3166-1 alpha-2 codes, as the JVM lists them."""
    jvm = SparkSession.getActiveSession()._jvm  # noqa: SLF001
    return tuple(sorted(jvm.java.util.Locale.getISOCountries()))


def bic(x: str) -> str:
    return f"length({x}) IN (8, 11) AND substring({x}, 5, 2) IN ({', '.join(quoted(c) for c in country_codes())})"


def phone(x: str, prefix: str, trunk: str, low: int, high: int, first: str) -> str:
    """Digits, with a leading country ``prefix`` read as ``trunk``, number ``low`` to ``high`` and begin as ``first`` says."""
    d = digits(x)
    own = f"CASE WHEN startswith({d}, '{prefix}') THEN concat('{trunk}', substring({d}, {len(prefix) + 1})) ELSE {d} END"
    return f"length({own}) BETWEEN {low} AND {high} AND ({own}) RLIKE '^{first}'"


def phone_lu(x: str) -> str:
    return f"length(regexp_replace({digits(x)}, '^(?:00352|352)', '')) BETWEEN 4 AND 11"
