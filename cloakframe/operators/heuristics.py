"""Names by their looks: runs of capitalised words, scored by what stands in and beside them.

Every word of a text gets one letter for its kind, with a sign for whether only spaces part it from the word before. Runs are
then matches of one regular expression over that string of letters, so a text is read in time linear in its length. A run
takes marks from its surroundings (legal form, title, trademark, kind of organisation, product noun, street); the runs of a
document with one text are one suggestion, and gates and a ladder of scores decide whether it is shown.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allowlist import Allowlist, filter_allowed
from .dictionary import slices
from .discover import CONTEXTS, MAILBOXES, fold, snippet
from .values import LEGAL_FORMS

# Vocabularies of the languages covered.
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Me", "M", "Mme", "Mlle", "Prof", "Herr", "Frau"]
PARTICLES = ["de", "du", "des", "van", "von", "le", "la", "den", "der", "ten", "ter"]
CONNECTORS = ["of", "the", "and", "for", "to", "in", "on", "vs", "et", "ou", "aux"]
OPENERS = [
    "The", "A", "An", "This", "That", "These", "Those", "Our", "We", "They", "Le", "La", "Les", "Un", "Une", "Ce", "Cette", "Ces", "Nos", "Notre",
    "Hello", "Hi", "Dear", "Hey", "Bonjour", "Bonsoir", "Salut", "Cher", "Chère", "Chers", "Best", "Regards",
    "Neither", "Either", "Each", "Every", "Any", "All", "Both", "Such", "No", "Some", "Chaque", "Aucun", "Aucune", "Tout", "Tous", "Toute", "Toutes",
]
CONJUNCTIONS = [
    "and", "or", "but", "nor", "so", "yet", "for", "to", "of", "in", "on", "at", "by", "with", "without", "as", "if",
    "et", "ou", "mais", "ni", "car", "donc", "aux", "avec", "sans", "pour", "par",
]
ROLES = [
    "partner", "associate", "director", "manager", "officer", "chief", "president", "chairman", "chairwoman", "chairperson", "secretary", "treasurer", "consultant", "analyst", "executive",
    "supervisor", "coordinator", "administrator", "specialist", "intern", "trainee", "auditor", "controller", "engineer", "advisor", "adviser", "counsel", "attorney", "notary",
    "ceo", "cfo", "cto", "coo", "cio", "cmo", "chro", "cdo",
    "associe", "associee", "gerant", "gerante", "directeur", "directrice", "presidente", "secretaire", "tresorier", "tresoriere", "responsable", "conseiller", "conseillere",
    "avocat", "avocate", "notaire", "mandataire", "expert", "reviseur",
]
PRODUCTS = ["platform", "plateforme", "suite", "edition", "sdk", "toolkit", "framework", "engine", "module", "app", "application", "software", "logiciel", "solution", "portal", "portail"]
STREETS = [
    "street", "road", "avenue", "boulevard", "lane", "square", "plaza", "place", "drive", "court", "terrace", "way", "rue", "impasse", "chemin", "route", "quai", "cours", "esplanade", "allee",
    "ville", "city", "town", "hotel",
]
ORGANISATIONS = [
    "group", "holdings", "holding", "partners", "partnership", "ventures", "associates", "corporation", "incorporated", "enterprises", "enterprise", "industries", "technologies",
    "laboratories", "pharmaceuticals", "systems", "solutions", "consulting", "international", "worldwide", "trust", "bank", "capital",
]
ORGANISATIONS_BY_LANGUAGE = {
    "fr": ["groupe", "societe", "societes", "cooperative", "compagnie", "banque", "assurances", "assurance", "conseil", "conseils", "associes", "entreprise", "entreprises", "etablissements", "mutuelle", "federation", "fiduciaire"],
    "de": ["gesellschaft", "genossenschaft", "handelsgesellschaft", "verein", "versicherung", "versicherungen", "stiftung", "werke", "industrie", "beteiligungen", "gruppe", "unternehmen", "bank"],
    "es": ["sociedad", "compania", "empresa", "banco", "seguros", "cooperativa", "grupo", "fundacion", "asociacion"],
}
LANGUAGES = {"LU": ["fr", "de"], "FR": ["fr"], "DE": ["de"], "ES": ["es"], "UK": []}
HEADING_WORDS = [
    "and", "or", "of", "for", "to", "in", "into", "on", "with", "under", "by", "this", "these", "that", "whereof", "whereas", "hereby", "herein", "between", "among",
    "et", "ou", "des", "aux", "entre", "pour", "par", "sur", "sous",
]
TRADEMARKS = "™®℠"
FRENCH_CALENDAR = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]
ORDINARY = [
    "however", "therefore", "moreover", "furthermore", "finally", "first", "second", "third", "next", "then", "also", "since", "during", "following", "regarding", "please", "note",
    "yesterday", "today", "tomorrow", "when", "after", "before", "both", "each", "here", "cependant", "toutefois", "ensuite", "enfin", "ainsi", "pourtant", "aussi", "depuis", "pendant",
    "concernant", "veuillez", "hier", "demain", "lorsque", "apres", "avant", "introduction", "conclusion", "summary", "annex", "appendix", "annexe", "resume", "objet", "subject", "date", "page",
    "development", "management", "strategy", "assessment", "review", "transformation", "transaction", "advisory", "advice", "marketing", "sales", "performance", "diagnostic", "logistics",
    "pricing", "revenue", "innovation", "valuation", "integration", "reporting", "audit", "assurance", "safety", "governance", "restructuring", "regulation", "planning", "diligence",
    "analysis", "standards", "compliance", "procurement", "finance", "financial", "commercial", "operational", "corporate", "digital", "supply", "chain", "impact",
    "from", "sent", "received", "regards", "sincerely", "best", "dear", "hello", "cordialement", "bonjour", "mobile", "phone", "fax", "email", "invoice", "facture", "order", "reminder", "control",
    "terms", "conditions", "sale", "general", "edition", "notice", "price", "total", "amount", "quantity", "description", "name", "address", "contact", "event", "holiday", "account", "leave", "request", "approval",
    "agreement", "framework", "clause", "party", "parties", "term", "duchy", "grand", "register", "process", "information", "property", "intellectual", "data", "protection", "jurisdiction", "governing",
    "obligations", "provisions", "confidential", "confidentiality", "purpose", "scope", "schedule", "witness", "signature", "effective", "european", "parliament", "directive", "companies", "company", "service", "services",
    "senior", "junior", "head", "lead", "partners", "contrat", "accord", "convention", "duche", "registre", "partie",
]


def ordinary_words() -> frozenset[str]:
    """Words that are no name by themselves, folded: names of the calendar, ROLES and ORDINARY."""
    english = [*calendar.month_name, *calendar.day_name]
    return frozenset(fold(w) for w in [*english, *FRENCH_CALENDAR, *ROLES, *ORDINARY] if w)


@dataclass(frozen=True)
class Options:
    """Strict keeps only runs with a mark of their own or a name from an address; lenient also lone words seen once."""

    min_length: int = 4
    min_occurrences: int = 1
    min_confidence: float = 0.5
    strictness: str = "balanced"
    exclude_common: bool = True
    common: frozenset[str] = field(default_factory=ordinary_words)


_WORD = re.compile(r"(?:[^\W\d_]|[-'’])+")
# kinds: N a name may begin with it, A capitalised but no beginning, R a role, p a particle, o any other; + only spaces before it, else ,
_RUN = re.compile(r"N(?:(?:\+p)*\+[NA])*")
_FORM = re.compile(r"([ ]*)(,[ ]*)?(" + "|".join(map(re.escape, LEGAL_FORMS)) + r")(?![^\W_])")
_COMMA = re.compile(r"[ ]*,[ ]*")
_NEXT_WORD = re.compile(r"[ ]+((?:[^\W\d_]|[-'’])+)")
_MAIL = re.compile(r"([A-Za-z0-9._%+\-]+)@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
_FORM_ENDS = tuple(" " + f for f in LEGAL_FORMS)
_EDGES = ".,;:!?()\"'’"
_PARTICLES, _CONNECTORS, _OPENERS, _CONJUNCTIONS, _ROLES, _TITLES = map(frozenset, (PARTICLES, CONNECTORS, OPENERS, CONJUNCTIONS, ROLES, TITLES))
_STREETS, _PRODUCTS, _HEADING, _FORMS, _MAILBOXES = map(frozenset, (STREETS, PRODUCTS, HEADING_WORDS, LEGAL_FORMS, MAILBOXES))


def capitalised(word: str) -> bool:
    bare = word.strip("-'’")
    return len(bare) >= 2 and bare[0].isupper()


def is_role(word: str) -> bool:
    low = fold(word.strip(_EDGES + "[]-"))
    return low.removesuffix("'s").removesuffix("’s") in _ROLES


@lru_cache(maxsize=1 << 16)
def kind(word: str) -> str:
    if not capitalised(word):
        return "p" if word.lower() in _PARTICLES else "o"
    if is_role(word):
        return "R"
    return "A" if word in _OPENERS or fold(word) in _CONJUNCTIONS else "N"


def opens(gap: str, before: bool) -> bool:
    """Does a word after ``gap`` open a sentence? A ruled line (three underscores) before it says no."""
    rule = 0
    for c in gap:
        if c == "_":
            rule += 1
            if rule >= 3:
                before = False
        elif c in "\n!?.:":
            before, rule = True, 0
        elif c not in " \t":
            rule = 0
    return before


def significant(text: str) -> list[str]:
    """Words of a run that are no particles."""
    return [w for w in re.split("[ -]", text) if w and w.lower() not in _PARTICLES]


def has_kind_of_organisation(text: str, keywords: frozenset[str]) -> bool:
    """A word for a kind of organisation, and another beside it?"""
    words = [f for w in re.split("[ -]", text) if (f := fold(w.strip(_EDGES))) and f not in _PARTICLES and f not in _CONNECTORS]
    return any(w in keywords for w in words) and any(w not in keywords for w in words)


def keywords_of(country: str) -> frozenset[str]:
    return frozenset(ORGANISATIONS).union(*(ORGANISATIONS_BY_LANGUAGE[x] for x in LANGUAGES.get(country, [])))


def address_names(text: str, common: frozenset[str]) -> set[str]:
    """Names that e-mail addresses of the text spell out, folded, with their first and last words."""
    names: set[str] = set()
    for m in _MAIL.finditer(text):
        local = m[1].lower()
        words = [fold(w) for w in re.split("[._+-]", local) if len(w) >= 2 and not w.isdecimal() and w not in _MAILBOXES]
        if local not in _MAILBOXES and len(words) >= 2:
            names.add(" ".join(words))
            names |= {w for w in (words[0], words[-1]) if w not in common}
    return names


def stretches(words: list[str]) -> set[str]:
    return {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}


@dataclass
class Run:
    text: str
    start: int
    end: int
    opening: bool
    street: bool = False
    titled: bool = False
    legal: bool = False
    trademark: bool = False
    organisation: bool = False
    product: bool = False
    legal_name: bool = False

    @property
    def words(self) -> int:
        return len(significant(self.text))

    @property
    def marked(self) -> bool:
        return self.titled or self.legal or self.trademark or self.organisation or self.legal_name


def runs(text: str, country: str = "") -> list[Run]:
    """The capitalised runs of a text with their marks, in order."""
    found = list(_WORD.finditer(text))
    words, starts, ends = [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]
    letters, opening, last = [], [], 0
    before = True
    for i, w in enumerate(words):
        gap = text[last : starts[i]]
        if gap == " ":
            opening.append(before)
            letters.append("+")
        else:
            opening.append(opens(gap, before))
            letters.append("+" if not gap.strip(" ") else ",")
        before, last = False, ends[i]
        letters.append(kind(w))
    line = "".join(letters)
    keywords = keywords_of(country)
    out: list[Run] = []

    def add(run: Run) -> bool:
        fits = len(run.text) >= 3 and run.text not in _FORMS
        if fits:
            out.append(run)
        return fits

    for m in _RUN.finditer(line):
        i, j = m.start() // 2, (m.end() - 1) // 2
        run = Run(text[starts[i] : ends[j]], starts[i], ends[j], opening[i])
        if words[i] in _TITLES:
            if i == j:
                continue
            run.titled, run.start = True, starts[i + 1]
        elif i and words[i - 1] in _TITLES and not text[ends[i - 1] : starts[i]].removeprefix(".").strip(" "):
            run.titled, run.opening = True, False
        run.text = text[run.start : run.end]
        name_end = 0
        run.legal = run.text.endswith(_FORM_ENDS)
        if not run.legal and (form := _FORM.match(text, run.end)):
            run.legal, name_end = True, run.end if form[2] else 0
            run.end = form.end()
            run.text = text[run.start : run.end]
        if name_end:  # "Name, S.A.": the name alone is what recurs
            add(Run(text[run.start : name_end], run.start, name_end, run.opening, legal_name=True))
        first = next((f for w in re.split("[ -]", run.text) if (f := fold(w.strip(_EDGES))) and f not in _PARTICLES and f not in _CONNECTORS), "")
        if i and (run.legal or first in keywords) and _COMMA.fullmatch(text, ends[i - 1], starts[i]) and line[2 * i - 1] == "N" and words[i - 1] not in _FORMS:
            back = i - 1  # "Name, Société anonyme": a name before one comma belongs to the form after it
            while back and line[2 * back] == "+" and line[2 * back - 1] == "N":
                back -= 1
            add(Run(text[starts[back] : ends[i - 1]], starts[back], ends[i - 1], opening[back], legal_name=True))
            run.start, run.opening = starts[back], opening[back]
            run.text = text[run.start : run.end]
        run.trademark = text[run.end : run.end + 2].removeprefix(" ")[:1] in tuple(TRADEMARKS)
        fields, after = run.text.split(), text[run.end : run.end + 24].split()
        run.product = run.trademark or len(fields) >= 2 and fields[-1].lower() in _PRODUCTS or bool(after) and after[0].strip(".,;:!?()").lower() in _PRODUCTS
        run.street = any(fold(w) in _STREETS for w in re.split("[ '’-]", run.text)) or bool(i) and fold(words[i - 1]) in _STREETS
        if not run.legal and has_kind_of_organisation(run.text, keywords):
            run.organisation, run.street = True, False
            tail = _NEXT_WORD.match(text, run.end)
            if tail and not tail[1][0].isupper() and fold(tail[1]) in keywords:
                run.end = tail.end()
                run.text = text[run.start : run.end]
        if add(run) and run.opening and not (run.legal or run.titled or run.organisation) and j > i and fold(words[i + 1]) not in _CONJUNCTIONS:
            # a word that only opens the sentence may stand before a name
            add(Run(text[starts[i + 1] : run.end], starts[i + 1], run.end, False, run.street))
    return out


def is_ordinary(text: str, common: frozenset[str]) -> bool:
    """Is every significant word an ordinary one?"""
    words = [f for w in re.split("[ -]", text) if (f := fold(w.strip(_EDGES))) and f not in _PARTICLES and f not in _CONNECTORS]
    return bool(words) and all(w in common for w in words)


def is_heading(text: str) -> bool:
    """Capitals throughout with a function word among them, as in headings and never in names?"""
    words = [w.strip(_EDGES) for w in re.split("[ '’-]", text)]
    words = [w for w in words if w and fold(w) not in _PARTICLES]
    rest = [w for w in words if fold(w) not in _HEADING]
    return len(rest) < len(words) and bool(rest) and all(w.upper() == w for w in rest)


def score(run: Run, count: int) -> float:
    if run.legal:
        return 0.95
    if run.trademark or run.titled:
        return 0.90
    if run.organisation:
        return 0.85
    if run.product:
        return 0.60
    if run.words >= 2:
        return 0.80 if count >= 2 else 0.65
    return 0.45 if count >= 2 else 0.25


def name_rows(text: str, options: Options, country: str = "") -> list[dict]:
    """main_text, category, count, first, confidence, contexts of a document's names, by their first places."""
    groups: dict[str, list[Run]] = {}
    for r in runs(text, country):
        groups.setdefault(r.text, []).append(r)
    names = address_names(text, options.common)
    parts = {s for n in names for s in stretches(n.split())}
    rows = []
    for main, group in groups.items():
        first, count = group[0], len(group)
        own = fold(main)
        mailed = bool(names) and (own in parts or any(s in names for s in stretches(own.split())))
        marked = any(r.marked for r in group)
        vouched = marked or mailed
        if not vouched:
            if options.strictness == "strict" or count < 2 and all(r.opening for r in group) or all(r.street for r in group):
                continue
            if count < 2 and first.words < 2 and options.strictness != "lenient":
                continue
        category = ""
        for r in group:
            if r.legal or r.legal_name:
                category = "entity_names"
            elif r.trademark:
                category = "product_names"
            elif not category:
                category = "person_names" if r.titled else "entity_names" if r.organisation else "product_names" if r.product else ""
        category = category or ("person_names" if first.words >= 2 else "entity_names")
        confidence = score(first, count)
        if mailed:
            category = category if marked else "person_names"
            confidence = max(confidence, 0.90)
        if any(r.legal_name for r in group):
            confidence = max(confidence, 0.95)
        if len(main) < options.min_length or count < options.min_occurrences or confidence < options.min_confidence:
            continue
        if options.exclude_common and (is_ordinary(main, options.common) or is_heading(main)):
            continue
        rows.append({"main_text": main, "category": category, "count": count, "first": first.start, "confidence": confidence, "contexts": [snippet(text, r.start, r.end) for r in group[:CONTEXTS]]})
    return rows


_ROWS = pa.schema([("doc_ord", pa.int64()), ("main_text", pa.string()), ("category", pa.string()), ("count", pa.int64()), ("first", pa.int32()), ("confidence", pa.float64()), ("contexts", pa.list_(pa.string()))])
NAMES = "doc_ord long, main_text string, category string, count long, first int, confidence double, contexts array<string>"


def discover_names(documents: DataFrame, allow: Allowlist | None = None, options: Options | None = None, country: str = "") -> DataFrame:
    """NAMES of each document (doc_ord, text), without those on the never-anonymise list. A null text has none."""
    allow, o = allow or Allowlist(), options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [{"doc_ord": doc, **r} for doc, text in zip(batch.column("doc_ord").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in name_rows(text or "", o, country)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _ROWS], schema=_ROWS)

    return filter_allowed(documents.select("doc_ord", "text").mapInArrow(run, NAMES), allow, "main_text")


def suggestions(documents: DataFrame, allow: Allowlist | None = None, options: Options | None = None, country: str = "") -> DataFrame:
    """``main_text, category, count, confidence, documents`` over the batch: names of one category that differ in case only
    are one row under the spelling seen first; counts add up and the best score holds."""
    rows = discover_names(documents, allow, options, country)
    agg = rows.groupBy("category", F.lower(F.trim("main_text")).alias("k")).agg(F.min_by("main_text", F.struct("doc_ord", "first")).alias("main_text"), F.sum("count").alias("count"), F.max("confidence").alias("confidence"), F.countDistinct("doc_ord").alias("documents"))
    return agg.select("main_text", "category", "count", "confidence", "documents")
