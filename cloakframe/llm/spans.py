"""Span expressions of this subpackage's native operators.

Patterns are written so that Java's engine stays linear and never recurses on long runs:
possessive quantifiers, and a look-behind (or ``\\G``, the end of the previous match) that
lets a run be tried only where it begins. Both are free of effect on what is matched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spans as base
from ..functions.spans import matches, quoted

__all__ = ["blocks", "listed", "matches", "placed", "quoted", "stretch"]


def placed(text: str, pattern: str, found: str, around: tuple[int, int, int] | None = None) -> str:
    return base.placed(text, quoted(pattern), found, around)


#: Characters of a block of ``stretch``.
BLOCK = 1024


def stretch(blocks: str, start: str, end: str) -> str:
    """SQL for the characters [start, end) of a text given as its blocks of BLOCK characters: no counting from the text's start."""
    one = f"substring({blocks}[j], greatest({start} - j * {BLOCK}, 0) + 1, least({end} - j * {BLOCK}, {BLOCK}) - greatest({start} - j * {BLOCK}, 0))"
    return f"CASE WHEN {end} > {start} THEN array_join(transform(sequence(CAST({start} / {BLOCK} AS int), CAST(({end} - 1) / {BLOCK} AS int)), j -> {one}), '') ELSE '' END"


def blocks(text: str) -> str:
    """SQL for the blocks of BLOCK characters of a text."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def listed(spans: str, kinds: list[str]) -> Column:
    """``kind:start:end`` of array<struct<s,k,e>> by start, then kind number, then end, comma-joined."""
    names = "array(" + ", ".join(quoted(k) for k in kinds) + ")"
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")
