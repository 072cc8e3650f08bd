"""SQL text for matches of a pattern with their places, native in Spark.

A span is struct<s, e, t>: start and end in code points (end exclusive) and the matched string.
"""

from __future__ import annotations

#: Word boundary, digits, letters and spaces as ASCII, in Java's syntax.
B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
S = r"\t\n\f\r "
#: The same boundary where a word character follows, and where one stands before: cheaper than B.
OPENING, CLOSING = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def edged(pattern: str) -> str:
    """``pattern`` with every B at the head of an alternative as OPENING and every other as CLOSING. Only for patterns whose
    alternatives begin and end with word characters there."""
    parts = pattern.split(B)
    out = parts[0]
    for part in parts[1:]:
        out += (OPENING if not out or out.endswith(("|", "(?i)")) else CLOSING) + part
    return out


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> str:
    """SQL for the strings of ``text`` (an expression) that match ``pattern``."""
    return f"regexp_extract_all({text}, {quoted(pattern)}, 0)"


def placed(text: str, pattern_sql: str, found: str, around: tuple[int, int, int] | None = None) -> str:
    """SQL for array<struct<s,e,t>>: the strings of array ``found`` with their places.

    What lies between matches comes from splitting on the same pattern, so places follow from
    running lengths; a row without a match never splits.

    With ``around`` (characters before, characters after, least length of a match) spans also hold ``b`` and ``a``: what stands
    right before and after. They come from the pieces beside a match, never from counting through the text, so the whole stays
    linear in its length.
    """
    fields = "s: int, e: int, t: string" + (", b: string, a: string" if around else "")
    kind = f"struct<pos: int, got: array<struct<{fields}>>>"
    beside = ""
    if around:
        before, after, least = around
        # a match is ``least`` long or longer, so a few neighbours fill any window
        near = lambda n: range(1, -(-n // least) + 1)
        # each piece is cut to the window before they are joined, so that long ones are not copied
        heads = [f"coalesce(right(get({x}, i - {k}), {before}), '')" for k in reversed(near(before)) for x in ("p", found)]
        tails = [f"coalesce(left(get({x}, i + {k}), {after}), '')" for k in near(after) for x in ("p", found)]
        left = f"right(concat({', '.join([*heads, f'right(p[i], {before})'])}), {before})" if before else "''"
        right = f"left(concat({', '.join(tails)}), {after})" if after else "''"
        beside = f", {left} AS b, {right} AS a"
    items = f"transform(array(split({text}, {pattern_sql}, -1)), p -> transform({found}, (t, i) -> struct(length(p[i]) AS n, t AS t{beside})))[0]"
    # a growing array is copied at every step, so places are found by blocks, from the running length at each block's start
    blocks = f"transform(sequence(0, CAST((size(it) - 1) / {BLOCK} AS int)), j -> slice(it, j * {BLOCK} + 1, {BLOCK}))"
    heads = """aggregate(bl, CAST(struct(0 AS pos, array() AS got) AS struct<pos: int, got: array<int>>),
        (acc, k) -> CAST(struct(acc.pos + aggregate(k, 0, (z, x) -> z + x.n + length(x.t)) AS pos, concat(acc.got, array(acc.pos)) AS got) AS struct<pos: int, got: array<int>>), acc -> acc.got)"""
    extra = ", x.b AS b, x.a AS a" if around else ""
    inside = f"""aggregate(k, CAST(struct(p AS pos, array() AS got) AS {kind}), (acc, x) -> CAST(struct(acc.pos + x.n + length(x.t) AS pos,
        concat(acc.got, array(struct(acc.pos + x.n AS s, acc.pos + x.n + length(x.t) AS e, x.t AS t{extra}))) AS got) AS {kind}), acc -> acc.got)"""
    all_blocks = f"flatten(zip_with(bl, {heads}, (k, p) -> {inside}))"
    # transform(array(v), x -> f(x))[0] names a value that is used more than once
    whole = f"transform(array({items}), it -> transform(array({blocks}), bl -> {all_blocks})[0])[0]"
    return f"CASE WHEN size({found}) > 0 THEN {whole} ELSE CAST(array() AS array<struct<{fields}>>) END"


#: Matches in a block of ``placed``.
BLOCK = 32
