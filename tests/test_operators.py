"""Semantics of single operators: what SQL comparisons on tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import allowlist, dictionary, discover, patterns, registry, resolve, rewrite, values
from cloakframe.plans import anonymise as run
from cloakframe.plans import control, presets


def regions(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_ord long, region_ord long, text string")


def scan(spark, text, category, country="LU"):
    return [r.original for r in patterns.scan_patterns(regions(spark, text), {category: True}, country).orderBy("start").collect()]


@pytest.mark.parametrize(
    ("category", "country", "text", "want"),
    [
        ("email", "LU", "a+b@sub.domain.co.uk, user@localhost, @handle", ["a+b@sub.domain.co.uk"]),
        ("url", "LU", "see www.nstar.lu/privacy. or https://u:p@h.t/x, www.txt", ["www.nstar.lu/privacy", "https://u:p@h.t/x,"]),
        ("vat", "LU", "éLU12345678 LU1234 LUXEMBOURG", ["LU12345678"]),
        ("matricule", "LU", "1893120105732 189312010573 18931201057321", ["1893120105732"]),
        ("phone", "LU", "+352 29 19 19 5 and 26 12 34 56", ["+352 29 19 19 5"]),
        ("phone", "FR", "+33 6 12 34 56 78", ["+33 6 12 34 56 78"]),
        ("credit_card", "LU", "4532 0151 1283 0366 4532015112830367", ["4532 0151 1283 0366"]),
        ("credit_card", "LU", "LU88 4532015112830366", []),
        ("uk_nhs", "UK", "485 777 3457 485 777 3456", ["485 777 3457"]),
        ("ip_address", "LU", "192.168.0.1 999.1.2.3 fe80::1", ["192.168.0.1", "fe80::1"]),
        ("mac_address", "LU", "00:1A:2B:3C:4D:5E 00:1A:2B:3C:4D", ["00:1A:2B:3C:4D:5E"]),
        ("de_steuer_id", "DE", "12345678901 01234567890", ["12345678901"]),
        ("bic", "LU", "BIC/SWIFT: BGLLLULL and TERMINATION", ["BGLLLULL"]),
        ("postal_code", "LU", "L-1855 L-185 L-18555", ["L-1855"]),
        ("address", "LU", "1, Avenue de l'Innovation, L-1855; 12, Tilleuls", ["1, Avenue de l'Innovation"]),
        ("es_nif", "ES", "12345678Z 12345678A", ["12345678Z"]),
        ("amount", "LU", "€1,500.00 and EUR 12 500 and 2M", ["€1,500.00", "EUR 12 500"]),
        ("date", "LU", "2026-07-23, 23 juillet 2026, July 23, 2026, 1/2", ["2026-07-23", "23 juillet 2026", "July 23, 2026"]),
    ],
)
def test_patterns(spark, category, country, text, want):
    assert scan(spark, text, category, country) == want


def test_checksum_only_lowers_the_score(spark):
    rows = patterns.scan_patterns(regions(spark, "LU28 0019 4006 4475 0000; LU88 0055 6600 4321 6501"), {"iban": True}).orderBy("start").collect()
    assert [(r.confidence, r.checksum_ok) for r in rows] == [(1.0, True), (0.7, False)]


def test_places_are_code_points(spark):
    row = patterns.scan_patterns(regions(spark, "😀é a@b.lu", None), {"email": True}).first()
    assert (row.start, row.end, row.byte_len, row.owner_key) == (3, 9, 6, "a@b.lu")


def test_custom_patterns():
    assert patterns.valid_custom("PRJ-[0-9]+") == ""
    assert all(patterns.valid_custom(e) for e in ("(", "(?=x)", r"(a)\1", "", "a++"))


def test_spellings_and_methods():
    assert values.expand_spellings("entity_names", "Alpine Trust S.A.") == ["Alpine Trust S.A.", "Alpine Trust"]
    assert values.expand_spellings("person_names", "Jo") == []
    assert values.match_class(["local_llm", "manual"]) == "user_defined" and values.match_class(None) == "user_defined" and values.match_class(["signal", "local_llm"]) == "rules_discovered"


def test_spellings_without_python(spark):
    names = ["Jean de la Croix", "Jo", "Marie-Anne Duval", " Anna  van den Berg ", "Alpine Trust S.à r.l.", "Plan B SA", "SA", "X. de", "de la Cruz Ana", "Ünal GmbH", "O'Brien d' Arc Z", "", "a b c"]
    rows = [(i, c, n, ["jean", "  Extra ", None] if i % 2 else None, bool(i % 5 == 4), [["manual"], ["signal", "local_llm"], ["local_llm"], [], None, ["odd"]][i % 6], [None, 0.0, 0.5][i % 3]) for i, (c, n) in enumerate((c, n) for c in ("person_names", "entity_names", "other_names") for n in names)]
    got = {}
    for r in values.spelling_rows(spark.createDataFrame(rows, values.VALUES)).collect():
        got.setdefault(r.value_ord, ([], r.match_class, r.confidence))[0].append(r.spelling)
    want = {i: (x, values.match_class(m), s if s else values.DECLARED) for i, c, n, sp, cur, m, s in rows if (x := values.expand_spellings(c, n, [y for y in sp or [] if y], cur))}
    assert got == want


def test_values_need_word_edges(spark):
    known = spark.createDataFrame([(0, "entity_names", "Alten", [], False, ["manual"], None), (1, "other_names", "Amélie (Ops)", [], False, [], 0.8)], values.VALUES)
    spans = values.detect_values(regions(spark, "Altenberg alten, ALTEN; xAlten", "AMÉLIE (OPS) xAmélie (Ops)"), known).orderBy("doc_ord", "start").collect()
    assert [(s.original, s.confidence) for s in spans] == [("alten", 0.95), ("ALTEN", 0.95), ("AMÉLIE (OPS)", 0.8)]
    allow = allowlist.Allowlist(["alten"])
    assert values.detect_values(regions(spark, "Alten"), known, allow).count() == 0


def test_allowlist():
    a = allowlist.with_defaults()
    assert a.contains(" luxembourg ") and not a.contains("Luxembourg City")
    a.add("regex:^Project [A-Z]$")
    a.add("regex:(")
    assert a.contains("project x") and a.errors
    a.remove("Luxembourg")
    assert not a.contains("Luxembourg")
    assert allowlist.parse_csv("﻿# c\nid;Term\n1;A\n2;a\n3;B\n".encode()) == ["A", "B"]
    assert allowlist.parse_csv(b"x,1\ny,2\n") == ["x", "y"] and allowlist.parse_csv(b"") == [] and allowlist.parse_csv(allowlist.template_csv())


def spans_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_ord long, region_ord long, start int, end int, category string, original string, confidence double, match_class string")
    return patterns.finished(df.withColumn("main_text", F.lit(None).cast("string")).withColumn("checksum_ok", F.lit(True)))


def test_overlaps(spark):
    spans = spans_of(spark, [(0, 0, 0, 10, "a", "x" * 10, 0.9, "user_defined"), (0, 0, 5, 20, "b", "y" * 15, 0.9, "user_defined"), (0, 0, 8, 12, "c", "zzzz", 1.0, "built_in_pattern"), (0, 0, 12, 14, "d", "uu", 0.5, "local_llm_discovered"), (1, 0, 5, 6, "e", "q", 0.1, "user_defined")])
    got = {r.category: r.kept for r in resolve.resolve_overlaps(spans).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": True, "e": True}
    assert {r.category for r in resolve.resolve_overlaps_native(spans).collect()} == {"c", "d", "e"}


def test_overlaps_of_ties_and_large_clusters(spark):
    rng = random.Random(3)
    rows = [(i % 3, 0, s := rng.randrange(400), s + rng.randint(1, 9), rng.choice("ab"), rng.choice(["x", "yy", "zé"]), rng.choice([0.5, 0.9]), rng.choice(["user_defined", "built_in_pattern"])) for i in range(900)]
    rows = list(dict.fromkeys(rows + [(5, 0, i, i + 3, "a", f"t{i % 7}", 0.9, "user_defined") for i in range(500)]))

    def plain(region):
        kept = []
        for r in sorted(region, key=lambda r: (patterns.RANKS[r[7]], -r[6], -len(r[5].encode()), r[2], r[4], r[3], r[5])):
            if all(r[3] <= k[2] or k[3] <= r[2] for k in kept):
                kept.append(r)
        return kept

    want = sorted(r[:6] for d in {r[0] for r in rows} for r in plain([r for r in rows if r[0] == d]))
    spans = spans_of(spark, rows).repartition(5)
    got = resolve.resolve_overlaps(spans).collect()
    line = lambda r: (r.doc_ord, r.region_ord, r.start, r.end, r.category, r.original)
    assert len(got) == len(rows) and sorted(line(r) for r in got if r.kept) == want
    assert sorted(map(line, resolve.resolve_overlaps_native(spans).collect())) == want


def test_ownership_is_one_per_string(spark):
    spans = spans_of(spark, [(0, 0, 0, 4, "brand_names", "Acme", 0.9, "rules_discovered"), (5, 0, 7, 11, "entity_names", "ACME", 0.95, "user_defined"), (5, 0, 7, 11, "brand_names", "ACME", 0.9, "rules_discovered")])
    out = resolve.unify_ownership(spans)
    assert sorted((r.doc_ord, r.category, r.match_class) for r in out.collect()) == [(0, "entity_names", "user_defined"), (5, "entity_names", "user_defined")]
    assert [(r.category, r.owned_from) for r in resolve.ownership_losses(out).collect()] == [("entity_names", "brand_names")]


def test_run_is_consistent_and_reversible(spark):
    texts = ["write Bob@x.lu or bob@X.LU", "Bob@x.lu and jo@y.lu; Acme SA and acme", None]
    known = spark.createDataFrame([(0, "entity_names", "Acme SA", [], False, ["manual"], None)], values.VALUES)
    done = run.anonymise(regions(spark, *texts), run.Config(), known)
    out = {r.doc_ord: r.anonymised for r in done.documents.collect()}
    assert out == {0: "write [EMAIL_1] or [EMAIL_1]", 1: "[EMAIL_1] and [EMAIL_2]; [ENTITY_1] and [ENTITY_1]", 2: None}
    again = run.anonymise(regions(spark, "jo@y.lu, z@z.lu"), run.Config(), entries=done.registry)
    assert again.documents.first().anonymised == "[EMAIL_2], [EMAIL_3]"
    assert rewrite.leaks(done.documents, done.registry).count() == 0
    shuffled = run.anonymise(regions(spark, *texts).repartition(3), run.Config(), known)
    assert sorted(map(str, shuffled.registry.collect())) == sorted(map(str, done.registry.collect()))


def test_named_runs_and_reset(spark):
    done = run.anonymise(regions(spark, "a@b.lu"), run.Config(name="one"))
    assert done.documents.first().anonymised == "[EMAIL_1]"
    assert control.progress(spark, "nothing") == (0, 0) and control.progress(spark, "one")[0] >= 0
    control.cancel(spark, "nothing")
    entries, retired = control.reset_run(spark)
    again = run.anonymise(regions(spark, "c@d.lu"), run.Config(), entries=entries, retired=retired)
    assert again.documents.first().anonymised == "[EMAIL_1]"


def test_json_and_table_regions(spark):
    rows = [(0, "csv", None, [["h", "m"], ["1", "a@b.lu"]]), (1, "xlsx", '{"A1": "a@b.lu"}', None), (2, "txt", "see a@b.lu", None)]
    docs = spark.createDataFrame(rows, "doc_ord long, format string, text string, grid array<array<string>>")
    cells = run.regions_of(docs)
    assert {(r.doc_ord, r.region) for r in cells.collect()} == {(0, f"row {i} col {j}") for i in range(2) for j in range(2)} | {(1, "json"), (2, "")}
    out = {r.doc_ord: r for r in run.written_back(run.anonymise(cells, run.Config()).documents).collect()}
    assert out[0].grid == [["h", "m"], ["1", "[EMAIL_1]"]] and out[0].anonymised == "| h | m |\n| --- | --- |\n| 1 | [EMAIL_1] |\n"
    assert out[1].json == '{"A1": "[EMAIL_1]"}' and out[1].anonymised.startswith("```json\n") and out[2].anonymised == "see [EMAIL_1]"


def test_blocking_conflicts(spark):
    known = spark.createDataFrame([(0, "entity_names", "Acme", [], False, [], None), (1, "brand_names", "acme", [], False, [], None)], values.VALUES)
    with pytest.raises(run.Blocked):
        run.anonymise(regions(spark, "acme"), run.Config(), known)


def test_registry_numbers(spark):
    book = registry.from_entries(spark, [("email", "a@b.lu", "[EMAIL_1]", 1), ("email", "c@d.lu", "[EMAIL_2]", 1)])
    none = registry.no_retired(spark)
    with pytest.raises(ValueError):
        registry.set_placeholder(book, none, "a@b.lu", "[EMAIL_2]")
    with pytest.raises(ValueError):
        registry.set_placeholder(book, none, "a@b.lu", "EMAIL")
    with pytest.raises(ValueError):
        registry.from_entries(spark, [("email", "A", "[EMAIL_1]", 1), ("vat", "a", "[VAT_1]", 1)])
    book = registry.set_placeholder(book, none, "A@B.lu", "[EMAIL_4]")
    book, retired = registry.forget(book, none, "c@d.lu")
    kept = spans_of(spark, [(0, 0, i, i + 1, "email", f"n{i}@x.lu", 1.0, "built_in_pattern") for i in range(3)])
    new = registry.assign(kept, book, retired)
    assert sorted(r.placeholder for r in new.collect()) == ["[EMAIL_3]", "[EMAIL_4]", "[EMAIL_5]", "[EMAIL_6]"]
    assert registry.lookup(new, "vat", "A@b.LU").first().placeholder == "[EMAIL_4]"
    assert registry.overrides(new).count() == 1 and registry.owner(new, "[EMAIL_4]").first().original == "a@b.lu"
    assert [r.original for r in registry.entries(new).collect()][0] in {"a@b.lu", "n0@x.lu"}


def test_restored_registries_and_overrides(spark):
    book = registry.from_entries(spark, [("email", "a@b.lu", "[EMAIL_1]", 1), ("email", "c@d.lu", "[EMAIL_2]", 2), ("vat", "LU1", "[TAX_7]", 3)])
    again = registry.restored(registry.export(book))
    assert sorted(map(str, again.select(*book.columns).collect())) == sorted(map(str, book.collect()))
    mapping = "category string, original string, placeholder string, count long"
    for rows in ([("email", "A", "[EMAIL_1]", 1), ("vat", "a", "[VAT_1]", 1)], [("email", "A", "[EMAIL_1]", 1), ("email", "b", "[EMAIL_1]", 1)], [("email", "A", "EMAIL_1", 1)]):
        with pytest.raises(ValueError):
            registry.restored(spark.createDataFrame(rows, mapping))
    retired = spark.createDataFrame([("[EMAIL_5]", "EMAIL", 5)], registry.RETIRED)
    wanted = spark.createDataFrame([("A@b.lu", "[EMAIL_2]"), ("c@d.lu", "[EMAIL_1]"), ("nobody", "[EMAIL_8]"), ("LU1", "[EMAIL_5]")], "original string, placeholder string")
    out, failed = registry.apply_overrides(book, retired, wanted)
    assert {r.original: (r.placeholder, r.number, r.overridden) for r in out.collect()} == {"a@b.lu": ("[EMAIL_2]", 2, True), "c@d.lu": ("[EMAIL_1]", 1, True), "LU1": ("[TAX_7]", 7, True)}
    assert {(r.original, r.reason) for r in failed.collect()} == {("nobody", "no entry for this original"), ("LU1", "the number is retired")}
    _, failed = registry.apply_overrides(book, retired, spark.createDataFrame([("a@b.lu", "[EMAIL_2]"), ("LU1", "x")], "original string, placeholder string"))
    assert {(r.original, r.reason) for r in failed.collect()} == {("a@b.lu", "another entry holds it"), ("LU1", "not a placeholder")}


def test_post_pass_shields_placeholders():
    text, hits = rewrite.replace_known("Email [EMAIL_1] email xemail", dictionary.Dictionary(["EMAIL"]), [("[OTHER_1]", "other_names")])
    assert text == "[OTHER_1] [EMAIL_1] [OTHER_1] xemail" and hits == ["other_names"] * 2


def test_presets():
    assert presets.matching_preset(presets.default_selection("FR"), "patterns", "FR") == "standard"
    assert presets.matching_preset(presets.depth_selection("thorough"), "names") == "thorough"
    assert not presets.default_selection("LU")["es_nif"] and presets.default_selection("ES")["es_nif"]
    assert presets.matching_preset({}, "names") == ""
    changed = presets.apply_preset(presets.default_selection(), "names", "soft")
    assert not changed["person_names"] and changed["email"]
    assert all(presets.split_preset_key(k) for k in presets.all_preset_keys()) and presets.split_preset_key("x") is None


def test_codes_and_hosts(spark):
    rows = discover.detect_codes(regions(spark, "Project PRJ-4471-A and ref: AB 1234; XPRJ-4471 xAB-123", "PRJ-4471-A")).orderBy("doc_ord", "first").collect()
    assert [(r.doc_ord, r.main_text, r.category, r.confidence) for r in rows] == [(0, "PRJ-4471-A", "project_names", 0.85), (0, "AB 1234", "identifier_names", 0.85), (0, "XPRJ-4471", "identifier_names", 0.85), (1, "PRJ-4471-A", "identifier_names", 0.7)]
    df = spark.createDataFrame([("https://u:p@www.acme.co.uk:80/x?y",), ("www.statistiques.public.lu",), ("https://gmail.com",)], "u string")
    assert [r[0] for r in df.select(discover.organisation_label(discover.url_host(F.col("u")))).collect()] == ["acme", "statistiques", None]


def test_grid_regions(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["c"], ["d", "e"]])], "doc_ord long, grid array<array<string>>")
    rows = run.grid_regions(df).orderBy("region_ord").collect()
    assert [(r.region_ord, r.text) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (4, "d"), (5, "e")]
