"""Suggestions over a batch, and what the reviewer does with values."""

import re

from pyspark.sql import functions as F

from cloakframe.operators import discover, registry, rewrite, values, views
from cloakframe.plans import detect
from cloakframe.sources.office import same_format_name

TEXTS = [
    "Marie Duval (marie.duval@alpine.lu) signed for Alpine Trust S.A. in March. Marie Duval and Alpine Trust agree. Project PRJ-4471 starts.",
    '"Work Order" means the order. The Work Order binds Alpine Trust S.A. See www.helios.lu; Helios Platform is used by Helios.',
]


def docs(spark):
    return spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(TEXTS)], "doc_ord long, name string, text string")


def test_detection(spark):
    found = detect.detect(docs(spark))
    rows = {r.main_text: r for r in found.suggestions.collect()}
    assert rows["Duval"].category == "person_names" and "Marie Duval" in rows["Duval"].spellings and rows["Duval"].contexts
    signals = {r.main_text: r for r in detect.from_signals(docs(spark)).collect()}
    assert signals["Marie Duval"].spellings == ["Duval", "Marie"] and signals["Marie Duval"].methods == ["signal"] and signals["Marie Duval"]["count"] == 2
    e = signals["Marie Duval"].evidence[0]
    assert (e.kind, e.signal_category, e.signal_text, e.documents) == ("email_local_part", "email", "marie.duval@alpine.lu", [0])
    assert signals["Alpine Trust S.A."].category == "entity_names" and "Alpine" not in signals
    assert "PRJ-4471" in rows and rows["PRJ-4471"].category == "project_names"
    assert not any("Work Order" in r for r in rows) and [t.term for t in found.defined_terms.collect()] == ["Work Order"]
    assert any("Alpine Trust S.A." in [r.main_text, *r.spellings] for r in rows.values())
    assert {r.original for r in found.preview.collect()} >= {"marie.duval@alpine.lu", "www.helios.lu"}
    loud = detect.detect(docs(spark), suppress_defined=False).suggestions
    assert loud.where("main_text LIKE '%Work Order%'").count()


def test_model_route(spark):
    model = lambda t: '[{"text": "Helios", "category": "product_names"}, {"text": "Nowhere", "category": "product_names"}]'
    rows = detect.detect(docs(spark), sources={"email": {"person": False, "organisation": False}, "website": {"organisation": False}}, model=model, refine=lambda names: {n: "brand_names" for n in names if "Helios" in n} | {"x": "y"}).suggestions.collect()
    helios = [r for r in rows if "Helios" in r.main_text]
    assert helios and all(r.category == "brand_names" for r in helios) and not any("Nowhere" in r.main_text for r in rows)


def test_switches():
    assert detect.enabled(None, "email", "person") and not detect.enabled({"email": {"person": False}}, "email", "person")
    assert not detect.enabled({"email": {"moon": True}}, "email", "moon") and not detect.enabled({"x": {"y": True}}, "x", "y")


def test_remove_and_restore(spark):
    known = spark.createDataFrame([(0, "entity_names", "Acme SA", ["ACM"], False, ["manual"], None)], values.VALUES)
    book = registry.from_entries(spark, [("entity_names", "Acme SA", "[ENTITY_1]", 3)])
    none = spark.createDataFrame([], registry.REMOVED)
    book, retired, removed, left = registry.remove_value(book, registry.no_retired(spark), none, known, "acme sa")
    assert book.count() == 0 and left.count() == 0 and retired.first().placeholder == "[ENTITY_1]"
    assert removed.first().placeholder == "[ENTITY_1]" and removed.first().spellings == ["ACM"]
    rest, back = registry.restore_value(removed, "ACME SA")
    assert rest.count() == 0 and back.first().main_text == "Acme SA"


def test_views(spark):
    df = spark.createDataFrame([("aAaa The a.b",)], "text string")
    hits = lambda n: [(h.s, h.e) for h in df.select(views.find_hits("text", n).alias("h")).first().h]
    assert hits("aa") == [(0, 2), (2, 4)] and hits("a") == [] and hits("A.B") == [(9, 12)] and hits("axb") == []
    book = registry.from_entries(spark, [("person_names", "Marie Duval", "[PERSON_1]", 1), ("person_names", "Marie", "[PERSON_2]", 1)])
    regions = spark.createDataFrame([(0, 0, "Marie Duval, Marie; xMarie")], "doc_ord long, region_ord long, text string")
    assert sorted((r.start, r.end, r.placeholder) for r in views.value_places(regions, book).collect()) == [(0, 11, "[PERSON_1]"), (13, 18, "[PERSON_2]")]
    out = regions.select("doc_ord", "region_ord", F.lit("[PERSON_1] [X_9] [PERSON_1]").alias("anonymised"))
    assert sorted((r.at, r.placeholder, r.nth, r.original) for r in views.highlighted(out, book).collect())[::2] == [(0, "[PERSON_1]", 1, "Marie Duval"), (17, "[PERSON_1]", 2, "Marie Duval")]


def test_file_names():
    entries = [("Marie Duval", "[PERSON_1]", "person_names"), ("Acme", "[ENTITY_1]", "entity_names")]
    assert same_format_name("Acme #1 Marie Duval.docx", "docx", entries, 4) == "ENTITY_1 _1 PERSON_1_anon.docx"
    assert same_format_name("xAcmey.docx", "docx", entries, 4) == "document_anon_4.docx"


def test_seeds_of_any_length(spark):
    texts = ["Write to anna.maria.van.den.berg@firm.lu. Anna Maria van den Berg signs; Anna Maria van den Bergh does not.", "a-b.jo.ann.mary.lou.eve.kim.sue@firm.lu, Jo Ann Mary Lou Eve Kim Sue", "Anna Maria van den"]
    df = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "doc_ord long, name string, text string")
    rows = {r.main_text: r["count"] for r in detect.from_signals(df).where("category = 'person_names'").collect()}
    assert rows == {"Anna Maria van den Berg": 1, "Jo Ann Mary Lou Eve Kim Sue": 1}


def test_seeds_of_any_length_by_both_plans(spark):
    body = "Anna Maria van den Berg met José-Luis Pérez; anna.maria.van.den.berg@firm.lu and jose.luis.perez@firm.lu. Firm Holdings S.A. pays, Firm, too. José. Luis said Pérez agreed"
    df = spark.createDataFrame([(i, body) for i in range(3)], "doc_ord long, text string")
    found = discover.email_person_seeds(df).unionByName(discover.email_organisation_seeds(df)).cache()
    both = [sorted(map(str, discover.find_seeds(df, found, discover.EMAIL, broadcast=b).collect())) for b in (True, False)]
    assert both[0] == both[1]
    got = {r.main_text: (r["count"], r.spellings) for r in discover.find_seeds(df, found, discover.EMAIL).collect()}
    assert got == {"Anna Maria van den Berg": (3, ["Anna", "Berg"]), "José-Luis Pérez": (3, ["José", "Pérez"]), "Firm Holdings S.A.": (3, [])}


def test_dictionary_by_both_plans(spark):
    words = ["Anna", "Anna Anna", "a a", "Ünal & Söhne", ".Net", "Straße 5", "x²", "K", "the the"]
    body = "ANNA anna ANNA; ba a a a, ÜNAL & söhne .net a.Net STRASSE 5 straße 5, x² K the The the"
    known = spark.createDataFrame([(i, "other_names", w, [], True, [], None) for i, w in enumerate(words)], values.VALUES)
    df = spark.createDataFrame([(0, 0, body), (1, 0, None), (2, 0, "none of it")], "doc_ord long, region_ord long, text string")
    spans = [sorted((r.main_text, r.start, r.end, r.original) for r in values.detect_values(df, known, broadcast=b).collect()) for b in (True, False)]
    assert spans[0] == spans[1]
    want = []
    for w in words:
        for m in re.finditer(re.escape(w), body, re.IGNORECASE):
            edge = lambda c: c.isalpha() or c.isdecimal()
            if len(w) >= 3 and not edge(body[m.start() - 1 : m.start()]) and not edge(body[m.end() : m.end() + 1]):
                want.append((w, *m.span(), m[0]))
    assert spans[0] == sorted(want) and len(want) >= 8
    book = registry.from_entries(spark, [("other_names", "Anna Anna", "[OTHER_1]", 1), ("other_names", "Anna", "[OTHER_2]", 1), ("other_names", "OTHER", "[OTHER_3]", 1)])
    texts = df.select("doc_ord", "region_ord", F.col("text").alias("anonymised"))
    done = [sorted((r.doc_ord, r.anonymised or "", str(r.post_hits)) for r in rewrite.post_pass(texts, book, broadcast=b).collect()) for b in (True, False)]
    assert done[0] == done[1] and done[0][0][1].startswith("[OTHER_1] [OTHER_2];")
    left = [sorted(map(str, rewrite.leaks(texts, book, broadcast=b).collect())) for b in (True, False)]
    assert left[0] == left[1] and len(left[0]) == 2
