"""Suggestions from rules: reference codes, and names behind e-mail and web addresses; merging and folding them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import B, S, edged, placed, quoted
from .allowlist import Allowlist, filter_allowed
from .dictionary import ENDS, grow, look_up, plain, plain_words, words
from .graph import connected_components, cut
from .values import LEGAL_FORMS, MIN_SPELLING

# The shape of a code, windows and scores.
CODE = r"[A-Z]{2,6}[-_ /][0-9]{3,}(?:[-/][A-Za-z0-9]{1,4})?"
SHORTEST_CODE = 6
CUE_CHARS, BARE, CUED, CONTEXTS, MIN_SEED, DERIVED = 24, 0.70, 0.85, 3, 3, 0.9
# Cue words, mailbox words and domain labels.
PROJECT_CUES = [
    "project", "projet", "projekt", "engagement", "mission", "workstream", "phase", "programme", "program",
]
IDENTIFIER_CUES = [
    "ref", "réf", "reference", "référence", "referenz", "dossier", "contrat", "contract", "vertrag", "facture", "invoice", "rechnung", "no", "nr", "num", "number",
    "numéro", "id", "case", "ticket", "order", "commande",
]
MAILBOXES = [
    "info", "contact", "noreply", "no-reply", "admin", "sales", "support", "hello", "team", "office", "help", "service", "services", "billing", "hr", "jobs", "marketing",
    "mail", "newsletter", "postmaster", "webmaster", "contactus",
]
SUFFIX_LABELS = [
    "com", "net", "org", "int", "edu", "gov", "mil", "info", "biz", "eu", "io", "co", "lu", "fr", "de", "be", "nl", "uk", "ch", "at", "it", "es", "pt", "ie", "us", "ca",
    "au", "nz", "se", "no", "dk", "fi", "pl", "cz", "public", "gouv", "admin", "etat", "state",
]
MAIL_PROVIDERS = [
    "gmail", "googlemail", "google", "outlook", "hotmail", "live", "msn", "yahoo", "ymail", "aol", "icloud", "me", "mac", "gmx", "web", "mail", "protonmail", "proton",
    "pm", "zoho", "yandex", "orange", "free", "laposte", "wanadoo", "sfr", "t-online", "libero", "qq", "163", "126", "naver", "hanmail", "example",
]
INFRASTRUCTURE = [
    "mail", "smtp", "imap", "pop", "mx", "webmail", "email", "exchange", "srv", "server", "host", "localhost", "internal", "local", "corp", "intranet", "www",
]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
WEBSITE = edged(rf"https?://[^{S}<>\"')\]]+|{B}www\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/[^{S}<>\"')\],]*)?")
# Letters with accents, and what they fold to.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuucn"
_FOLD = str.maketrans(ACCENTED, PLAIN)
#: Words that don't begin or end a name though they stand inside one.
INSIDE = ["de", "du", "des", "van", "von", "le", "la", "den", "der", "ten", "ter", "of", "the", "and", "for", "to", "in", "on", "vs", "et", "ou", "aux"]
#: What may stand between two words of one name.
SEPARATORS = [" ", "-", ".", ". ", " - ", "'", "’"]
_SEPARATORS = frozenset(SEPARATORS)
#: Words of a main text that families are joined on.
EXACT = 8
RADIUS = 60


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    """Lower case without accents, white space collapsed."""
    return " ".join(text.lower().translate(_FOLD).split())


def folded(x: Column) -> Column:
    """``fold`` as an expression."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"\s+", " "))


def snippet(text: str, start: int, end: int) -> str:
    """The stretch around a span, white space collapsed."""
    return " ".join(text[max(0, start - RADIUS) : end + RADIUS].split())


def detect_codes(regions: DataFrame, allow: Allowlist | None = None) -> DataFrame:
    """``doc_ord, main_text, category, count, first, confidence``: reference codes of each document.

    The nearest cue word within 24 characters on either side files a code as project or identifier;
    one project cue anywhere makes it a project.
    """
    allow = allow or Allowlist()
    words = lambda x: f"filter(transform(split({x}, '\\\\s+'), w -> lower(regexp_replace(w, '^[.,;:!?()\\\\[\\\\]\"\\'’-]+|[.,;:!?()\\\\[\\\\]\"\\'’-]+$', ''))), w -> true)"
    body = regions.select("doc_ord", "region_ord", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_m", F.expr(f"regexp_extract_all(_text, {quoted(CODE)}, 0)"))
    rows = body.select("doc_ord", "region_ord", F.explode(F.expr(placed("_text", quoted(CODE), "_m", (CUE_CHARS, CUE_CHARS, SHORTEST_CODE)))).alias("_x"))
    inside = r"[\\p{L}\\p{Nd}]"
    rows = rows.where(F.expr(f"NOT right(_x.b, 1) RLIKE '{inside}' AND NOT left(_x.a, 1) RLIKE '{inside}'"))
    rows = rows.select("doc_ord", "region_ord", F.col("_x.t").alias("code"), F.col("_x.s").alias("s"), F.expr("trim(_x.b)").alias("b"), F.expr("trim(_x.a)").alias("a"))
    rows = filter_allowed(rows, allow, "code")
    cues = ", ".join(quoted(c) for c in PROJECT_CUES + IDENTIFIER_CUES)
    near = f"""array_sort(concat(
        filter(transform({words("b")}, (w, i) -> struct(size(split(b, '\\\\s+')) - i AS d, 0 AS side, i AS i, w AS w)), c -> c.w IN ({cues})),
        filter(transform({words("a")}, (w, i) -> struct(i + 1 AS d, 1 AS side, i AS i, w AS w)), c -> c.w IN ({cues}))))"""
    rows = rows.withColumn("cue", F.expr(f"try_element_at({near}, 1).w"))
    project = F.col("cue").isin(PROJECT_CUES)
    grouped = rows.groupBy("doc_ord", "code").agg(F.count("*").alias("count"), F.min(F.struct("region_ord", "s")).alias("_f"), F.bool_or(F.coalesce(project, F.lit(False))).alias("p"), F.bool_or(F.col("cue").isNotNull()).alias("c"))
    return grouped.select("doc_ord", F.col("code").alias("main_text"), F.when(F.col("p"), "project_names").otherwise("identifier_names").alias("category"), "count", F.col("_f.s").alias("first"), F.when(F.col("c"), CUED).otherwise(BARE).alias("confidence"))


def organisation_label(host: Column) -> Column:
    """The rightmost label of a host that is no public suffix, unless a mail provider, a machine name or too short."""
    own = F.filter(F.split(F.lower(host), r"\."), lambda x: ~x.isin(SUFFIX_LABELS))
    # labels right of the last own one are all suffixes, so it is the last that is none
    label = F.try_element_at(own, F.lit(-1))
    good = ~label.isin(MAIL_PROVIDERS + INFRASTRUCTURE) & (F.length(label) >= MIN_SEED)
    return F.when(good, folded(label))


def url_host(url: Column) -> Column:
    """The host of an address: scheme, path, credentials and port gone."""
    host = F.regexp_replace(F.regexp_replace(F.lower(url), "^[^:/]*://", ""), "[/?#].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[^:]*$", ""), r"^\.+|\.+$", "")


def signals(documents: DataFrame, pattern: str) -> DataFrame:
    """``doc_ord, signal`` for every match of a signal pattern."""
    return documents.select("doc_ord", F.explode(F.expr(f"regexp_extract_all(coalesce(text, ''), {quoted(pattern)}, 0)")).alias("signal"))


EVIDENCE = "array<struct<kind: string, signal_category: string, signal_text: string, documents: array<bigint>>>"


def seeds(rows: DataFrame, value: Column, category: str, kind: str, also: Column | None = None, signal_category: str = "email") -> DataFrame:
    """``category, folded, kind, documents, signals, also, evidence``: seeds merged over the batch. A seed's evidence is CONTEXTS
    signals at most, each with CONTEXTS documents at most, the first of them: examples, not counts."""
    # a signal is read once, however many documents hold it: the expressions cost far more than finding it
    pairs = cut(rows.select("signal", "doc_ord").distinct())
    told = cut(pairs.select("signal").distinct().withColumns({"folded": value, "also": also if also is not None else F.array().cast("array<string>")}).where("folded IS NOT NULL"))
    good = pairs.join(told, "signal")
    merged = good.groupBy("folded").agg(F.countDistinct("doc_ord").alias("documents"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("also")))).alias("also"))
    near = good.select("folded", "signal", "doc_ord").withColumn("_r", F.row_number().over(Window.partitionBy("folded", "signal").orderBy("doc_ord"))).where(F.col("_r") <= CONTEXTS)
    by_signal = near.groupBy("folded", "signal").agg(F.array_sort(F.collect_list("doc_ord")).alias("documents"))
    few = by_signal.withColumn("_r", F.row_number().over(Window.partitionBy("folded").orderBy("signal"))).where(F.col("_r") <= CONTEXTS)
    item = F.struct(F.lit(kind).alias("kind"), F.lit(signal_category).alias("signal_category"), F.col("signal").alias("signal_text"), "documents")
    evidence = few.groupBy("folded").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    joined = merged.join(evidence, "folded")
    return joined.select(F.lit(category).alias("category"), "folded", F.lit(kind).alias("kind"), "documents", F.transform("evidence", lambda e: e["signal_text"]).alias("signals"), "also", "evidence")


def name_words(local: Column) -> Column:
    """The name words of a mailbox, folded; null for a function mailbox and for fewer than two."""
    words_of = F.filter(F.split(F.lower(local), "[._+-]"), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$") & ~w.isin(MAILBOXES))
    named = F.transform(words_of, folded)
    return F.when(~F.lower(local).isin(MAILBOXES) & (F.size(named) >= 2), named)


def person_name(local: Column) -> Column:
    return F.array_join(name_words(local), " ")


def bare_forms(local: Column, common: list[str]) -> Column:
    """The first and the last name word by themselves, unless short or an ordinary word."""
    named = name_words(local)
    return F.coalesce(F.array_distinct(F.filter(F.array(named[0], F.element_at(named, -1)), lambda w: (F.length(w) >= MIN_SEED) & ~w.isin(common))), F.array().cast("array<string>"))


def email_person_seeds(documents: DataFrame, common: list[str] | None = None) -> DataFrame:
    from .heuristics import ordinary_words

    local = F.substring_index("signal", "@", 1)
    return seeds(signals(documents, EMAIL), person_name(local), "person_names", "email_local_part", bare_forms(local, sorted(ordinary_words()) if common is None else common))


def email_organisation_seeds(documents: DataFrame) -> DataFrame:
    return seeds(signals(documents, EMAIL), organisation_label(F.substring_index("signal", "@", -1)), "entity_names", "email_domain")


def website_seeds(documents: DataFrame) -> DataFrame:
    return seeds(signals(documents, WEBSITE), organisation_label(url_host(F.col("signal"))), "entity_names", "website_domain", signal_category="url")


def folded_words(text: str) -> Iterator[tuple[str, int, int]]:
    """(word without case and accents, start, end) of the runs of letters and digits."""
    for w, at in words(text):
        yield (w if w.isascii() else fold(text[at : at + len(w)])), at, at + len(w)


def folded_word(word: str) -> str:
    """A word as ``folded_words`` gives it."""
    low = plain(word)
    return low if low.isascii() else fold(word)


class Seeds:
    """Folded names of any number of words, by their words in order."""

    def __init__(self, names: list[str]):
        self.tree: dict = {}
        for i, name in enumerate(names):
            parts = [w for w, _, _ in folded_words(name)]
            if parts:
                grow(self.tree, parts, i)

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number) wherever the words of a name follow each other with a SEPARATOR between."""
        names, found = plain_words(text, folded_word), None
        if names is None:
            found = list(folded_words(text))
            names = [w for w, _, _ in found]
        for k in [k for k, w in enumerate(names) if w in self.tree]:
            node, j = self.tree[names[k]], k
            while node is not None:
                own = node.get(ENDS, ())
                if found is None and (own or j + 1 < len(names) and names[j + 1] in node):
                    found = list(folded_words(text))
                for i in own:
                    yield found[k][1], found[j][2], i
                j += 1
                node = node.get(names[j]) if j < len(names) else None
                if node is not None and text[found[j - 1][2] : found[j][1]] not in _SEPARATORS:
                    break


_STEP = re.compile(r" ((?:[^\W_]|[-'’])+)")
_TAIL = re.compile(" (?:" + "|".join(map(re.escape, LEGAL_FORMS)) + r")(?![^\W_])", re.IGNORECASE)
_FORMS = frozenset(f.lower() for f in LEGAL_FORMS)


def extended(text: str, end: int) -> int:
    """Where an organisation's name ends that begins before ``end``: over capitalised words one space apart, words that stand
    inside names if such a word follows, and a legal form."""
    at = end
    while m := _STEP.match(text, at):
        bare = m[1].strip("-'’")
        at = m.end()
        if len(bare) >= 2 and bare[0].isupper() or m[1].lower() in _FORMS:
            end = at
        elif fold(m[1]) not in INSIDE:
            break
    tail = _TAIL.match(text, end)
    return tail.end() if tail else end


_HITS = pa.schema([("doc_ord", pa.int64()), ("category", pa.string()), ("seed", pa.string()), ("lead", pa.bool_()), ("text", pa.string()), ("first", pa.int32()), ("count", pa.int64()), ("contexts", pa.list_(pa.string()))])


def seed_hits(documents: DataFrame, found: DataFrame, pattern: str, broadcast: bool | None = None) -> DataFrame:
    """``doc_ord, category, seed, lead, text, first, count, contexts``: where seeds (``lead``) and their bare forms stand in the
    running text, outside the signals they came from. Organisations are taken to the end of their names."""
    signal = re.compile(pattern)
    forms = found.select("category", F.col("folded").alias("seed"), F.explode(F.concat(F.array("folded"), "also")).alias("form"))
    terms = forms.withColumn("lead", F.col("form") == F.col("seed")).distinct()

    last: list = [None, {}]

    def columns_of(table: pa.Table) -> dict[str, list]:
        if table is not last[0]:
            last[:] = [table, {c: table.column(c).to_pylist() for c in ("category", "seed", "lead")}]
        return last[1]

    def use(batch: pa.RecordBatch, held) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, text, r in zip(batch.column("doc_ord").to_pylist(), batch.column("text").to_pylist(), range(batch.num_rows), strict=True):
            if not text:
                continue
            book, table = held(r)
            taken, begins, of = None, [], {}
            groups: dict[tuple[int, str], list] = {}
            for s, e, i in book.find(text):
                if taken is None:
                    taken = [m.span() for m in signal.finditer(text)]
                    begins, of = [a for a, _ in taken], columns_of(table)
                k = bisect_right(begins, s) - 1
                if k >= 0 and e <= taken[k][1]:
                    continue
                if of["category"][i] == "entity_names":
                    e = extended(text, e)
                g = groups.setdefault((i, text[s:e]), [s, 0, []])
                g[1] += 1
                if len(g[2]) < CONTEXTS:
                    g[2].append(snippet(text, s, e))
            out += [(doc, of["category"][i], of["seed"][i], of["lead"][i], t, *g) for (i, t), g in groups.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_HITS)], schema=_HITS)

    schema = "doc_ord long, category string, seed string, lead boolean, text string, first int, count long, contexts array<string>"
    return look_up(documents.select("doc_ord", "text"), ["doc_ord"], "text", terms, "form", use, schema, broadcast, make=Seeds, split=folded_words)


def find_seeds(documents: DataFrame, found: DataFrame, pattern: str, allow: Allowlist | None = None, broadcast: bool | None = None) -> DataFrame:
    """Suggestions from seeds: ``category, folded, main_text, count, spellings, doc_ord, first, contexts, evidence``.

    Texts that differ in case only are one, under the spelling seen first. Bare forms of a person's name become spellings
    where the full name was found. A bare organisation word goes where a longer name built on it was found.
    """
    # the texts are read once for all that follows
    hits = cut(filter_allowed(seed_hits(documents, found, pattern, broadcast), allow or Allowlist(), "text"))
    by_seed = ["category", "seed"]
    first = F.struct("doc_ord", "first")
    lead = hits.where("lead").withColumn("k", F.lower("text"))
    near = lead.withColumn("_r", F.row_number().over(Window.partitionBy(*by_seed, "k").orderBy("doc_ord", "first"))).where(F.col("_r") <= CONTEXTS)
    seen = near.groupBy(*by_seed, "k").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", "contexts"))), lambda x: x["contexts"])), 1, CONTEXTS).alias("contexts"))
    main = lead.groupBy(*by_seed, "k").agg(F.min_by("text", first).alias("main_text"), F.sum("count").alias("count"), F.min(first).alias("f")).join(seen, [*by_seed, "k"])
    longer = F.max(F.expr("k <> seed AND startswith(k, seed) AND NOT substring(k, length(seed) + 1, 1) RLIKE '[\\\\p{L}\\\\p{Nd}]'")).over(Window.partitionBy(*by_seed))
    main = main.withColumn("_longer", longer).where(~((F.col("category") == "entity_names") & F.col("_longer") & (F.col("k") == F.col("seed"))))
    forms = hits.where("NOT lead").groupBy(*by_seed).agg(F.array_sort(F.collect_set("text")).alias("spellings"))
    joined = main.join(forms, by_seed, "left").join(found.select("category", F.col("folded").alias("seed"), "evidence"), by_seed)
    return joined.select("category", F.col("seed").alias("folded"), "main_text", "count", F.coalesce("spellings", F.array().cast("array<string>")).alias("spellings"), "f.doc_ord", "f.first", "contexts", "evidence")


def _field(name: str):
    return lambda x: x[name]


def merge_suggestions(rows: DataFrame) -> DataFrame:
    """Suggestions (ord, main_text, category, spellings, count, confidence, methods, and contexts and evidence if there) by
    category and main text without case: the spelling of the smallest ``ord`` (any type that sorts) stays, counts add up, the
    best score and all methods and spellings hold, with CONTEXTS contexts and pieces of evidence, those that come first."""
    own = ["category", "k"]
    keyed = rows.withColumn("k", F.lower(F.trim("main_text")))
    agg = keyed.groupBy(*own).agg(
        F.min_by("main_text", "ord").alias("main_text"), F.sum("count").alias("count"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("methods"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spellings")))).alias("spellings"),
    )
    columns = ["ord", "main_text", "category", "spellings", "count", "confidence", "methods"]
    more = [c for c in ("contexts", "evidence") if c in rows.columns]
    if more:
        near = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy("ord"))).where(F.col("_r") <= CONTEXTS)
        lists = [F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", c))), _field(c)))), 1, CONTEXTS).alias(c) for c in more]
        agg = agg.join(near.groupBy(*own).agg(*lists), own)
    return agg.select(*columns, *more)


def merge_spellings(*lists: list[str], main: str = "") -> list[str]:
    """All spellings but the main text, each once without case, longest first."""
    kept = {s.lower(): s for x in reversed(lists) for s in reversed(x) if s.strip() and s.lower() != main.lower()}
    return sorted(kept.values(), key=lambda s: (-len(s), s))


def family_edges(rows: DataFrame, allow: Allowlist | None = None) -> DataFrame:
    """``a, b``: ord of a shorter main text and of a longer one that contains it as words, within a category.

    A contained text is a run of words of the longer one, so both are joined on the words themselves: the longer ones are exploded
    by their runs of up to EXACT words. Shorter texts of up to so many words are joined whole, longer ones on their first EXACT words.
    """
    allow = allow or Allowlist()
    usable = filter_allowed(rows, allow, "main_text").select("ord", "category", F.trim("main_text").alias("t")).where(F.length("t") >= MIN_SPELLING)
    usable = usable.withColumn("ws", F.expr(r"filter(split(lower(t), '[^\\p{L}\\p{Nd}]+'), x -> x <> '')")).where("size(ws) > 0")
    short = usable.select(F.col("ord").alias("a"), "category", F.col("t").alias("st"), F.expr(f"array_join(slice(ws, 1, {EXACT}), ' ')").alias("w"))
    run = f"flatten(transform(sequence(1, least(size(ws), {EXACT})), n -> transform(sequence(1, size(ws) - n + 1), i -> array_join(slice(ws, i, n), ' '))))"
    long = usable.select(F.col("ord").alias("b"), "category", F.col("t").alias("lt"), F.explode(F.expr(f"array_distinct({run})")).alias("w"))
    edge, ahead = r"(?<![\\p{L}\\p{Nd}])", r"(?![\\p{L}\\p{Nd}])"
    quote = "regexp_replace(lower(st), '([^A-Za-z0-9 ])', '\\\\\\\\$1')"
    pairs = short.join(long, ["category", "w"]).where("length(st) < length(lt) AND contains(lower(lt), lower(st))")
    return pairs.where(F.expr(f"regexp_like(lower(lt), concat('{edge}', {quote}, '{ahead}'))")).select("a", "b")


def fold_families(rows: DataFrame, allow: Allowlist | None = None) -> DataFrame:
    """Suggestions with families folded: the shortest member (then the most frequent, then by text) is the main text,
    the others are spellings, counts add up."""
    parts = connected_components(family_edges(rows, allow), "a", "b")
    tagged = rows.join(parts, rows.ord == parts.node, "left").withColumn("family", F.coalesce("component", "ord")).drop("node", "component")
    lead = F.struct(F.length("main_text"), -F.col("count"), "main_text")
    more = [c for c in ("contexts", "evidence") if c in rows.columns]
    agg = tagged.groupBy("family").agg(
        F.min_by(F.struct("ord", "main_text", "category", "confidence", "methods", *more), lead).alias("m"), F.sum("count").alias("count"),
        F.array_distinct(F.flatten(F.array_append(F.collect_list("spellings"), F.collect_list("main_text")))).alias("s"),
    )
    spellings = F.expr("array_sort(filter(s, x -> lower(x) <> lower(m.main_text)), (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")
    return agg.select("m.ord", "m.main_text", "m.category", spellings.alias("spellings"), "count", "m.confidence", "m.methods", *[f"m.{c}" for c in more])
