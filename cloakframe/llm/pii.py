"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base patterns and a few looser ones propose spans. Three labelers vote on each span
(1 for, 2 against, 0 abstains): the pattern's own validator, a gazetteer (top-level
domains, address ranges, card prefixes, dialling codes) and the words just before it.
Votes and shape features are counted into a table whose size is bounded by the number of
kinds, votes and features, not by the data. Expectation-maximisation over that table, as
one higher-order expression, estimates how often each labeler gives each vote for true and
for false spans; its posteriors then train the final classifier, a naive Bayes model over
votes and shape features. Base spans always stay; a looser span is added when the
classifier's probability is ACCEPT or more and no base span overlaps it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut
from .spans import blocks, listed, matches, placed, quoted, stretch

#: Base kinds in their listed order, then the looser ones.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "account", "ssn", "local_phone"]
ACCEPT, ROUNDS, CONTEXT = 0.5, 30, 40

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=(?:[0-9][ -]?){11}[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: No match of a pattern is shorter; as many neighbours of a match are looked at for the words before it.
SHORTEST = {"email": 5, "ip": 7, "card": 12, "phone": 4, "ssn": 11, "local_phone": 12}
#: Fixed gazetteers.
DOMAINS = "com org net edu gov io co info biz de fr es it uk eu lu nl be ch at us ca au jp in br test example"
DIAL = "1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[013]"
IIN = r"^(?:4|5[1-5]|3[47]|6011|65|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))"
PRIVATE = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
CUES = {
    "email": "mail|contact|write|reply|@|adresse|correo",
    "ip": "ip|host|server|address|login|from|client",
    "card": "card|visa|master|amex|credit|debit|pay|iban|account|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell|contact|anruf|appel|llam",
    "account": "card|visa|master|amex|credit|debit|pay|iban|account|karte|carte|tarjeta",
    "ssn": "ssn|social|security",
    "local_phone": "phone|tel|call|mobile|fax|cell|contact|anruf|appel|llam",
}
COUNTER = r"(?:isbn|order|invoice|serial|version|build|ticket|part|ref)[^a-z0-9]{0,3}(?:no|nr|num|number|id)?[^a-z0-9]{0,3}$"

_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
_VALID = {
    "ip": "forall(split(x.t, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS})",
    "account": f"length({_DIGITS}) BETWEEN 12 AND 19 AND NOT luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
#: The pattern's own vote, by how strictly a span keeps to its form: base spans are certain to be listed, not to be personal.
_STRICT = {
    "email": "CASE WHEN x.t RLIKE '[.][A-Za-z]{2,24}$' AND NOT x.t RLIKE '^[.]|[.][.]|[.]@' THEN 1 WHEN x.t RLIKE '[.][0-9]+$|@-|-[.]' THEN 2 ELSE 0 END",
    "ip": "CASE WHEN x.t RLIKE '(?:^|[.])0[0-9]' THEN 2 ELSE 1 END",
    "card": f"CASE WHEN length({_DIGITS}) = 16 THEN 1 WHEN x.t RLIKE '[ -]' AND NOT x.t RLIKE '^[0-9]{{4}}([ -])[0-9]{{4,6}}[ -][0-9]{{4,5}}' THEN 2 ELSE 0 END",
    "phone": f"CASE WHEN length({_DIGITS}) BETWEEN 10 AND 13 THEN 1 WHEN x.t RLIKE '[.-]{{2}}|[)][)]|[(][(]' THEN 2 ELSE 0 END",
    "account": f"CASE WHEN length({_DIGITS}) IN (14, 15, 16) THEN 0 ELSE 2 END",
    "ssn": "CASE WHEN x.t RLIKE '^(?:000|666|9)|-00-|-0000$' THEN 2 ELSE 1 END",
    "local_phone": "0",
}
_GAZETTEER = {
    "email": f"CASE WHEN lower(substring_index(x.t, '.', -1)) IN ({', '.join(quoted(d) for d in DOMAINS.split())}) THEN 1 ELSE 2 END",
    "ip": f"CASE WHEN x.t RLIKE {quoted(PRIVATE)} THEN 2 ELSE 1 END",
    "card": f"CASE WHEN x.t RLIKE {quoted(IIN)} THEN 1 ELSE 2 END",
    "phone": f"CASE WHEN x.t RLIKE {quoted('^[+](?:' + DIAL + ')')} THEN 1 ELSE 2 END",
    "account": f"CASE WHEN x.t RLIKE {quoted(IIN)} THEN 1 ELSE 2 END",
    "ssn": "0",
    "local_phone": "CASE WHEN x.t RLIKE '^[(]?[2-9][0-9]{2}[)]?[ .-][2-9]' THEN 1 ELSE 2 END",
}


def _voted(kind: str, spans: str) -> str:
    """SQL for array<struct<s,k,e,a,b,c,f>>: votes a, b, c and the shape features f of valid spans."""
    kept = f"filter({spans}, x -> {_VALID[kind]})" if kind in _VALID else spans
    cue = f"CASE WHEN lower(x.b) RLIKE {quoted(CUES[kind])} THEN 1 WHEN lower(x.b) RLIKE {quoted(COUNTER)} THEN 2 ELSE 0 END"
    edge = "right(x.b, 1) RLIKE '[A-Za-z0-9]' OR x.a RLIKE '^[A-Za-z0-9]'"
    return f"""transform({kept}, x -> struct(x.s AS s, {KINDS.index(kind)} AS k, x.e AS e,
        {_STRICT.get(kind, "1")} AS a, {_GAZETTEER[kind]} AS b, {cue} AS c,
        CASE WHEN {edge} THEN 1 ELSE 0 END + CASE WHEN x.t RLIKE '[ -]' THEN 2 ELSE 0 END AS f))"""


_SPAN = "array<struct<s: int, k: int, e: int, a: int, b: int, c: int, f: int>>"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_more``: voted spans of the base kinds, and looser ones that overlap none of them."""
    body = docs.withColumn("_x", F.coalesce(F.col(text).cast("string"), F.lit("")))
    body = body.withColumns({f"_m_{k}": F.expr(matches("_x", p)) for k, p in PATTERNS.items()})
    body = body.withColumns({f"_p_{k}": F.expr(placed("_x", p, f"_m_{k}", (CONTEXT, 1, SHORTEST[k]))) for k, p in PATTERNS.items()})
    base = ", ".join(_voted(k, f"_p_{k}") for k in BASE)
    more = ", ".join(_voted(k, f"_p_{'card' if k == 'account' else k}") for k in KINDS[len(BASE) :])
    body = body.withColumns({"_base": F.expr(f"CAST(concat({base}) AS {_SPAN})"), "_more": F.expr(f"CAST(concat({more}) AS {_SPAN})")})
    body = body.withColumn("_more", F.expr("CASE WHEN size(_more) > 0 THEN filter(_more, y -> NOT exists(_base, x -> x.s < y.e AND y.s < x.e)) ELSE _more END"))
    return body.drop("_x", *(f"_{c}_{k}" for c in "mp" for k in PATTERNS))


@dataclass(frozen=True)
class SpanModel:
    """priors by kind; log-odds of votes [labeler][vote] and of shape features [kind][feature]."""

    prior: list[float]
    votes: list[list[float]]
    shape: list[list[float]]
    reliability: list[list[list[float]]]


def fit(found: DataFrame) -> SpanModel:
    """Reliabilities and classifier from the ``_base`` and ``_more`` columns of all rows.

    The counted table has at most 7 kinds x 27 votes x 4 features = 756 rows whatever the
    input, so it fits one row; an empty table gives the smoothed priors.
    """
    n = len(KINDS)
    spans = found.select(F.explode(F.concat("_base", "_more")).alias("x"))
    counts = spans.groupBy("x.k", "x.a", "x.b", "x.c", "x.f").agg(F.count("*").cast("double").alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("k", "a", "b", "c", "f", "n"))).alias("t"))
    state = "struct<p: array<double>, t: array<array<array<double>>>>"
    vote = "CASE l WHEN 0 THEN y.a WHEN 1 THEN y.b ELSE y.c END"
    # a vote for is likelier on a true span to begin with; this fixes which class is which
    start = f"CAST(struct(transform(sequence(0, {n - 1}), k -> 0.5D) AS p, transform(sequence(0, 2), l -> array(array(0.3D, 0.3D), array(0.2D, 0.6D), array(0.5D, 0.1D))) AS t) AS {state})"
    post = """transform(t, x -> struct(x AS y,
        st.p[x.k] * st.t[0][x.a][1] * st.t[1][x.b][1] * st.t[2][x.c][1] AS g,
        (1 - st.p[x.k]) * st.t[0][x.a][0] * st.t[1][x.b][0] * st.t[2][x.c][0] AS h))"""

    def total(rows: str, weight: str, where: str = "true") -> str:
        return f"aggregate({rows}, 0D, (z, r) -> z + CASE WHEN {where} THEN {weight} ELSE 0D END)"

    q, not_q = "r.y.n * r.g / (r.g + r.h)", "r.y.n * r.h / (r.g + r.h)"
    vote_r = vote.replace("y.", "r.y.")
    update = f"""aggregate(array({post}), CAST(NULL AS {state}), (none, w) -> CAST(struct(
        transform(sequence(0, {n - 1}), k -> ({total("w", q, "r.y.k = k")} + 1) / ({total("w", "r.y.n", "r.y.k = k")} + 2)) AS p,
        transform(sequence(0, 2), l -> transform(sequence(0, 2), v -> array(
            ({total("w", not_q, f"({vote_r}) = v")} + 1) / ({total("w", not_q)} + 3),
            ({total("w", q, f"({vote_r}) = v")} + 1) / ({total("w", q)} + 3)))) AS t) AS {state}))"""
    fitted = one.withColumn("m", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (st, i) -> {update})"))
    shape = f"""aggregate(array(aggregate(array(m), CAST(NULL AS array<struct<y: struct<k: int, a: int, b: int, c: int, f: int, n: double>, g: double, h: double>>), (none, st) -> {post})),
        CAST(NULL AS array<array<double>>), (none, w) -> transform(sequence(0, {n - 1}), k -> transform(sequence(0, 3), f ->
            ln(({total("w", q, "r.y.k = k AND r.y.f = f")} + 1) / ({total("w", q, "r.y.k = k")} + 4))
            - ln(({total("w", not_q, "r.y.k = k AND r.y.f = f")} + 1) / ({total("w", not_q, "r.y.k = k")} + 4)))))"""
    row = fitted.select("m.p", "m.t", F.expr(shape).alias("shape"), F.expr("transform(m.t, l -> transform(l, v -> ln(v[1]) - ln(v[0])))").alias("odds")).first()
    return SpanModel(list(row.p), [list(x) for x in row.odds], [list(x) for x in row.shape], [[list(v) for v in x] for x in row.t])


def _doubles(values: list) -> str:
    return "array(" + ", ".join(_doubles(v) if isinstance(v, list) else f"{v!r}D" for v in values) + ")"


def classified(found: DataFrame, model: SpanModel) -> DataFrame:
    """``found`` with ``_spans``: base spans and the looser ones that the classifier accepts, array<struct<s,k,e>>."""
    odds = f"""ln({_doubles(model.prior)}[x.k] / (1 - {_doubles(model.prior)}[x.k])) + {_doubles(model.votes)}[0][x.a]
        + {_doubles(model.votes)}[1][x.b] + {_doubles(model.votes)}[2][x.c] + {_doubles(model.shape)}[x.k][x.f]"""
    kept = f"filter(_more, x -> 1 / (1 + exp(-({odds}))) >= {ACCEPT}D)"
    bare = "x -> struct(x.s AS s, x.k AS k, x.e AS e)"
    return found.withColumn("_spans", F.expr(f"concat(transform(_base, {bare}), transform(CASE WHEN size(_more) > 0 THEN {kept} ELSE _more END, {bare}))"))


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans.

    A null or empty text has no spans (digest of the empty string). Rows repeat as they do
    in the input; other columns are ignored whatever their names.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    found = cut(candidates(rows).select("doc_id", "_base", "_more"))
    done = classified(found, fit(found))
    done = done.withColumn("_bare", F.expr("transform(_base, x -> struct(x.s AS s, x.k AS k, x.e AS e))"))
    counts = [F.size(F.expr(f"filter(_base, x -> x.k = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return done.select("doc_id", *counts, F.sha2(listed("_bare", KINDS), 256).alias("base_sha256"), listed("_spans", KINDS).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; n_chars, if there, follows.

    Of overlapping spans the one that starts first (then the longer) is replaced.
    A null text stays null.
    """
    found = cut(candidates(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))))  # scanned once
    done = classified(found, fit(found.select("_base", "_more")))
    names = "array(" + ", ".join(quoted(f"[{k.upper()}]") for k in KINDS) + ")"
    order = "array_sort(_spans, (x, y) -> CASE WHEN x.s <> y.s THEN x.s - y.s WHEN x.e <> y.e THEN y.e - x.e ELSE x.k - y.k END)"
    # a span stays if it begins where all before it have ended; that is decided on numbers, pieces are cut after
    # by blocks, as in ``placed``: where each block begins to be free, then the block
    kind = "struct<pos: int, got: array<struct<s: int, k: int, e: int>>>"
    cut_up = "transform(sequence(0, CAST((size(o) - 1) / 32 AS int)), j -> slice(o, j * 32 + 1, 32))"
    heads = """aggregate(bl, CAST(struct(0 AS pos, array() AS got) AS struct<pos: int, got: array<int>>), (acc, k) -> CAST(struct(
        aggregate(k, acc.pos, (z, x) -> CASE WHEN x.s < z THEN z ELSE x.e END) AS pos, array_append(acc.got, acc.pos) AS got) AS struct<pos: int, got: array<int>>), acc -> acc.got)"""
    inside = f"""aggregate(k, CAST(struct(p AS pos, array() AS got) AS {kind}), (acc, x) -> CASE WHEN x.s < acc.pos THEN acc
        ELSE CAST(struct(x.e AS pos, array_append(acc.got, x) AS got) AS {kind}) END, acc -> acc.got)"""
    free = f"transform(array({order}), o -> transform(array({cut_up}), bl -> flatten(zip_with(bl, {heads}, (k, p) -> {inside})))[0])[0]"
    done = done.withColumn("_s", F.expr(f"CASE WHEN size(_spans) > 0 THEN {free} ELSE CAST(array() AS array<struct<s: int, k: int, e: int>>) END"))
    piece = stretch("b", "CASE WHEN i = 0 THEN 0 ELSE _s[i - 1].e END", "x.s")
    tail = stretch("b", "element_at(_s, -1).e", "length(text)")
    spliced = f"transform(array({blocks('text')}), b -> concat(array_join(transform(_s, (x, i) -> concat({piece}, element_at({names}, x.k + 1))), ''), {tail}))[0]"
    text = F.expr(f"CASE WHEN size(_s) > 0 THEN {spliced} ELSE text END")
    done = done.select("row", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
