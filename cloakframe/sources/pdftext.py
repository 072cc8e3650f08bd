"""Repair of text that was taken out of PDF pages: ligatures, capitals torn from their words, runs of spaces.

Reading pages needs a library that is not at hand; any reader that gives a text for each page can be put before this.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Latin ligatures of the presentation forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_TORN = re.compile(r"(?<!\S)[A-Z](?: [A-Z])+(?= [A-Z]{2,}(?!\S))")


def fold_ligatures(text: Column) -> Column:
    """``text`` with ligatures as letters, so that one name has one spelling."""
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return text


def mend_line(line: str) -> str:
    """A line with single spaces, where ``n`` lone capitals go back to the ``n`` words of capitals right behind them.

    One lone capital is left: it may be a word.
    """
    line = " ".join(line.split())
    out, at = [], 0
    for m in _TORN.finditer(line):
        if m.start() < at:
            continue
        heads = m[0].split(" ")
        words = line[m.end() + 1 :].split(" ", len(heads))[: len(heads)]
        if len(words) == len(heads) and all(re.fullmatch("[A-Z]{2,}", w) for w in words):
            out += [line[at : m.start()], " ".join(h + w for h, w in zip(heads, words, strict=True))]
            at = m.end() + 1 + len(" ".join(words))
    return "".join([*out, line[at:]])


def repaired(text: Column) -> Column:
    """The text of a page mended line by line; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "\n".join(map(mend_line, t.split("\n"))))

    return F.pandas_udf(run, "string")(fold_ligatures(text))
