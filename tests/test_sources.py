"""Readers, writers, chunks, names by their looks, images, sessions and the stream."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import chunks, heuristics, registry, rewrite
from cloakframe.plans import anonymise, export
from cloakframe.sources import images, office, pdftext, session, text
from cloakframe.streaming.anonymise import start


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def docx():
    p = lambda s, style="": f"<w:p>{style}" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in s.split("~")) + "</w:p>"
    head = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b|c") + "</w:tc></w:tr></w:tbl>"
    return package(word__document=f"<w:document {W}><w:body>{p('Title', head)}{p('Marie Du~val &amp; co')}{table}</w:body></w:document>", docProps__core="<cp xmlns:dc='x'><dc:creator>Bob</dc:creator></cp>")


R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def parts(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def whole(raw, found):
    """``rewrite`` with every block passed through a function."""
    changes = {(part, n): [(0, len(t), found(t))] for part, n, t in office.text_blocks(raw) if found(t) != t}
    return office.rewrite(raw, changes)


def test_docx():
    body, pages = office.docx_text(docx())
    assert body == "## Title\n\nMarie Duval & co\n\n| a | b\\|c |\n| --- | --- |\n" and pages == 1
    new = whole(docx(), lambda t: t.replace("Marie Duval", "[PERSON_1]"))
    assert "[PERSON_1] & co" in office.docx_text(new)[0] and office.properties(new) == {"creator": "Bob"}


def test_docx_looks_links_lists_and_pages():
    run = lambda t, look="": f"<w:r><w:rPr>{look}</w:rPr>{t}</w:r>"
    t = lambda x: f'<w:t xml:space="preserve">{x}</w:t>'
    item = lambda n, level, x: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr></w:pPr>{run(t(x))}</w:p>'
    body = f"""<w:p>{run(t("on "))}{run(t("0"), "<w:b/>")}{run(t("1.01.2001"), "<w:b/>")}{run(t(" or "))}{run(t("so"), '<w:i/><w:b w:val="0"/>')}</w:p>
        <w:p><w:hyperlink r:id="r1">{run(t("site"))}</w:hyperlink>{run("<w:drawing/>")}</w:p>{item(1, 0, "one")}{item(2, 1, "two")}<w:p>{run('<w:br w:type="page"/>' + t("next"))}</w:p>"""
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    raw = parts({"word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering,
                 "word/_rels/document.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{KIND}hyperlink" Target="https://x.lu" TargetMode="External"/></Relationships>'})
    pages, warnings = office.docx_pages(raw)
    assert pages == ["on **01.01.2001** or *so*\n\n[site](https://x.lu)*[image omitted]*\n\n- one\n  1. two", "next"] and warnings == ["1 images were left out"]


def test_pptx():
    shape = lambda kind, *lines: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p>{x}</a:p>" for x in lines)}</p:txBody></p:sp>'
    t = lambda x, level=0: f'<a:pPr lvl="{level}"/><a:r><a:t>{x}</a:t></a:r>'
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc></a:tr><a:tr><a:tc><a:p><a:r><a:t>1</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"
    deck = parts({
        "ppt/slides/slide10.xml": f"<p:sld {P} {A}>{shape('body', t('Ten'))}</p:sld>", "ppt/slides/slide2.xml": f"<p:sld {P} {A}>{shape('body', t('b'), t('c', 1))}{shape('title', t('Two'))}{shape('sldNum', t('2'))}{table}</p:sld>",
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {P} {A}>{shape('body', t('said'))}{shape('sldNum', t('9'))}</p:notes>",
        "ppt/slides/_rels/slide10.xml.rels": f'<Relationships {REL}><Relationship Id="a" Type="{KIND}notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>'})
    assert office.pptx_slides(deck) == ["## Slide 2: Two\n\n- b\n  - c\n\n| h |\n| --- |\n| 1 |", "## Slide 10\n\n- Ten\n\n**Notes:**\n\nsaid"]


def workbook():
    rels = "".join(f'<Relationship Id="r{i}" Type="{KIND}worksheet" Target="worksheets/sheet{n}.xml"/>' for i, n in ((1, 3), (2, 1), (3, 2)))
    sheets = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(("Third", "First", "Nil"), 1))
    return parts({
        "xl/workbook.xml": f"<workbook {S} {R}><sheets>{sheets}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships {REL}>{rels}</Relationships>", "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>Marie </t></r><r><t>Duval</t></r></si></sst>",
        "xl/worksheets/sheet3.xml": f'<w {S}><c r="A1" t="s"><v>0</v></c><c r="A2" t="s"><v>1</v></c><c r="B1" t="inlineStr"><is><t>Marie Duval</t></is></c><c r="B2" t="str"><f>A2</f><v>Marie Duval</v></c></w>',
        "xl/worksheets/sheet1.xml": f'<w {S}><c r="B2" t="s"><v>0</v></c><c r="C3"><v>5</v></c></w>', "xl/worksheets/sheet2.xml": f"<w {S}/>", "xl/comments1.xml": f"<comments {S}><commentList><comment ref='A1'><text><t>ask Marie Duval</t></text></comment></commentList></comments>"})


def test_xlsx():
    sheets, warnings = office.xlsx_sheets(workbook())
    assert [(x.name, x.grid, bool(x.reason)) for x in sheets] == [("Third", [["name", "Marie Duval"], ["Marie Duval", "Marie Duval"]], False), ("First", [["", "", ""], ["", "name", ""], ["", "", "5"]], True)]
    assert sheets[1].json == '{\n  "B2": "name",\n  "C3": "5"\n}' and warnings == ["sheet Nil is empty, skipped"]
    assert office.complex_reason([["a", "b"], ["1", "2"]], 0) == "" and "number" in office.complex_reason([["a", "2"]], 0) and "merged" in office.complex_reason([["a"]], 2)
    new = office.xlsx_sheets(whole(workbook(), lambda t: t.replace("Marie Duval", "[P]")))[0]
    assert new[0].grid == [["name", "[P]"], ["[P]", "Marie Duval"]]  # what a formula gives is not written over


def test_untouched_parts_keep_their_bytes():
    raw = workbook()
    new = whole(raw, lambda t: t.replace("Marie", "M"))
    with zipfile.ZipFile(io.BytesIO(raw)) as a, zipfile.ZipFile(io.BytesIO(new)) as b:
        assert b.testzip() is None and [i.filename for i in a.infolist()] == [i.filename for i in b.infolist()]
        for x, y in zip(a.infolist(), b.infolist(), strict=True):
            body = lambda i, data: data[i.header_offset + 30 + sum(struct.unpack_from("<HH", data, i.header_offset + 26)) :][: i.compress_size]
            if a.read(x) == b.read(y):
                assert body(x, raw) == body(y, new) and (x.CRC, x.compress_type, x.date_time) == (y.CRC, y.compress_type, y.date_time)
        assert b"Marie" in b.read("xl/worksheets/sheet3.xml") and b"Marie" not in b.read("xl/sharedStrings.xml")  # only the formula's value


def test_same_format_export_leaves_no_original(spark):
    core = "<cp xmlns:dc='x' xmlns:c='y'><dc:creator>Marie Duval</dc:creator><c:other>Marie Duval</c:other></cp>"
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>Ma</w:t></w:r><w:r><w:t>rie Duval, bob@x.lu &amp; co</w:t></w:r></w:p></w:body></w:document>"
    word = parts({"word/document.xml": body, "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Mdm Duval (Marie Duval)</w:t></w:r></w:p></w:hdr>", "docProps/core.xml": core})
    files = spark.createDataFrame([(0, "a.docx", word), (1, "b.xlsx", workbook()), (2, "c.docx", b"no zip"), (3, "d.docx", None)], "doc_ord long, name string, raw binary")
    entries = registry.from_entries(spark, [("person_names", "Marie Duval", "[PERSON_1]", 1), ("person_names", "Mdm Duval", "[PERSON_2]", 1)])
    done = export.same_format(files, anonymise.Config(), entries, registry.no_retired(spark))
    out = {r.doc_ord: r for r in done.files.collect()}
    assert office.docx_text(out[0].raw)[0] == "[PERSON_1], [EMAIL_1] & co\n" and office.properties(out[0].raw) == {"creator": "[PERSON_1]"} and out[0].replaced == 5
    assert out[2].raw is None and out[3].raw is None and {r.placeholder for r in done.registry.collect()} == {"[PERSON_1]", "[PERSON_2]", "[EMAIL_1]"}
    again = export.blocks_of(done.files.where("raw IS NOT NULL")).select("doc_ord", F.col("text").alias("anonymised"))
    assert rewrite.leaks(again, done.registry).count() == 0 and again.count() == done.blocks.count()
    told = {(r.doc_ord, r.value): (r.proposed, r.changed) for r in export.property_proposals(files, anonymise.Config(), entries, registry.no_retired(spark)).collect()}
    assert told == {(0, "Marie Duval"): ("[PERSON_1]", True)}


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"x\r\ny\rz\n")
    (tmp_path / "a.csv").write_bytes('id,c\n1,"a\nb, ""q"""\n2\n'.encode())
    (tmp_path / "c.md").write_bytes(b"\xff")
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.exe").write_bytes(b"MZ")
    files = text.read_files(spark, str(tmp_path)).cache()
    assert [(r.doc_ord, r.name) for r in files.orderBy("doc_ord").collect()] == [(i, f"{n}") for i, n in enumerate(["a.csv", "b.txt", "c.md", "d.docx", "e.docx"])]
    t = text.load_text(files).collect()
    assert [(r.name, r.text, r.unit_count) for r in t if not r.error] == [("b.txt", "x\ny\nz\n", 3)] and [r.name for r in t if r.error] == ["c.md"]
    assert [(r.name, r.error) for r in text.unread_files(spark, str(tmp_path)).collect()] == [("f.exe", "unsupported format: exe")]
    g = text.load_csv(files).first()
    assert g.grid == [["id", "c"], ["1", 'a\nb, "q"'], ["2", ""]] and g.warnings and g.error is None
    assert text.parse_csv(text.grid_to_csv(g.grid))[0] == g.grid
    o = {r.name: r for r in office.load_office(files).collect()}
    assert o["d.docx"].text.startswith("## Title") and o["e.docx"].error and not o["e.docx"].text


def test_grid_markdown_and_names(spark):
    df = spark.createDataFrame([([["a|b", "c\nd"], ["1", None]], "r.v2.docx#1"), ([], "x")], "grid array<array<string>>, name string")
    got = df.select(text.grid_to_markdown(F.col("grid")).alias("m"), text.export_name(F.col("name"), "md").alias("n"), text.preview(F.lit("a\nb"))["truncated"].alias("t")).collect()
    assert got[0].m == "| a\\|b | c d |\n| --- | --- |\n| 1 |  |\n" and got[1].m == ""
    assert [r.n for r in got] == ["r.v2.docx_1_anon.md", "x_anon.md"] and not got[0].t


def test_chunks(spark):
    assert chunks.pack_units(["a" * 700, "b" * 400, "c" * 400, "", " "]) == [(1, 2, "a" * 700 + "\n" + "b" * 400), (3, 5, "c" * 400 + "\n\n ")]
    assert [x[:2] for x in chunks.pack_units(["a", "b", "c"], wanted=[1, 3])] == [(1, 1), (3, 3)]
    with pytest.raises(ValueError):
        chunks.pack_units(["a"], wanted=[2])
    whole = "é word " * 600
    pieces = chunks.split_oversized(whole, 1000, 100)
    assert all(len(p.encode()) <= 1000 for p in pieces) and pieces[0] + pieces[1][pieces[1].find(" ") :] and len(pieces) > 4
    assert chunks.split_oversized("é" * 900, 1000)[0] == "é" * 500
    paged = spark.createDataFrame([(1, "x\ny", ["p1", "p2", "p3"]), (2, "x\ny", None)], "doc_ord long, text string, pages array<string>")
    assert [r.units for r in chunks.units_of(paged).orderBy("doc_ord").collect()] == [["p1", "p2", "p3"], ["x", "y"]]
    cut = [paged.where("doc_ord = 1").select(chunks.unit_range("pages", a, b, h)).first()[0] for a, b, h in ((2, 3, False), (2, 2, True), (3, 9, False), (4, 9, False), (0, 1, False))]
    assert cut == ["p2\np3", "p1\np2", "p3", None, None] and chunks.estimate_requests(paged, 51).first().requests == 4
    assert chunks.parse_reply('x [{"text": "A"}, {"text": "B"}, {"te') == [{"text": "A"}, {"text": "B"}] and chunks.parse_reply("none") == []
    docs = spark.createDataFrame([(1, ["Marie met Acme", "x"])], "doc_ord long, units array<string>")
    model = lambda t: '[{"text": "Marie", "category": "person_names"}, {"text": "Bob", "category": "person_names"}, {"text": "Acme", "category": "nope"}]'
    assert [(r.main_text, r["count"]) for r in chunks.model_suggestions(chunks.scan_chunks(docs), model, ["person_names"]).collect()] == [("Marie", 1)]


def test_names(spark):
    body = "The contract binds Alpine Trust S.A. and Mme Weber. Marie Duval met Jean de la Croix; Marie Duval left. Delta Group, 3 rue Royale. There the Helios Platform runs."
    got = {r.main_text: (r.category, r.confidence) for r in heuristics.discover_names(spark.createDataFrame([(1, body), (2, None)], "doc_ord long, text string")).collect()}
    assert got["Alpine Trust S.A."] == ("entity_names", 0.95) and got["Weber"] == ("person_names", 0.90) and got["Marie Duval"] == ("person_names", 0.80)
    assert got["Jean de la Croix"] == ("person_names", 0.65) and got["Delta Group"] == ("entity_names", 0.85) and got["Helios Platform"] == ("product_names", 0.60) and "Royale" not in got and "The" not in got
    docs = spark.createDataFrame([(1, "an ACME Group"), (0, "then Acme Group and Acme Group")], "doc_ord long, text string")
    assert [(r.main_text, r["count"], r.documents) for r in heuristics.suggestions(docs).collect()] == [("Acme Group", 3, 2)]


def names_in(body, country="", **options):
    return {r["main_text"]: r for r in heuristics.name_rows(body, heuristics.Options(**options), country)}


def test_legal_names_across_a_comma():
    body = "This is between Contoso, Société Française de Transport S.A. and Acme Group, S.A., then Northstar, Sàrl. Contoso pays Contoso. A list: Alpha, Beta, Gamma."
    got = names_in(body, "LU")
    assert got["Contoso"]["category"] == "entity_names" and got["Contoso"]["confidence"] == 0.95 and got["Contoso"]["count"] == 4
    assert got["Contoso, Société Française de Transport S.A."]["confidence"] == 0.95 and "Acme Group, S.A." in got and "Acme Group" in got and got["Northstar"]["category"] == "entity_names"
    assert "Alpha" not in got and "Beta" not in got
    assert "Contoso" not in names_in("We met, Contoso, Industrie de la Place.") and "PwC Société coopérative" in names_in("hired by PwC Société coopérative today", "FR")
    assert "PwC Société coopérative" not in names_in("hired by PwC Société coopérative today", "UK")


def test_roles_titles_and_addresses():
    got = names_in("signed\n____ PIERRE LAVENTURE Partner. For M. Dupont and Chief Information Officer, at 2, rue Gerhard Mercator; Place de la Gare.")
    assert {"PIERRE LAVENTURE", "Dupont"} == set(got) and got["Dupont"]["category"] == "person_names" and got["Dupont"]["confidence"] == 0.90
    got = names_in("mail johannes.borch@pwc.lu or info@pwc.lu. Borch said; José Brito <jose.brito@x.lu>.")
    assert got["Borch"]["category"] == "person_names" and got["Borch"]["confidence"] == 0.90 and got["José Brito"]["confidence"] == 0.90 and "Info" not in got


def test_gates_and_noise():
    assert not names_in("Yesterday it rained. Ensuite nothing. The CSSF was there.")
    assert "CSSF" in names_in("The CSSF and the CSSF met.", min_confidence=0.4) and "Zorro" in names_in("then Zorro came", strictness="lenient", min_confidence=0.2)
    assert not names_in("about March, the Revenue Management and IN WITNESS WHEREOF parties, COSTS AND EXPENSES, Terms and Conditions, General Terms of Sale")
    assert set(names_in("the March Consulting deal with Marie Duval", strictness="strict")) == {"March Consulting"}
    got = names_in("We like Meridian Suite™ and Helios platform, not Later Marie Duval.", strictness="lenient")
    assert got["Meridian Suite"]["category"] == "product_names" and got["Meridian Suite"]["confidence"] == 0.90 and got["Helios"]["category"] == "product_names"
    got = names_in("Later Marie Duval called. So Anouk van den Berg de went, 😀 Jean-Pierre Élan too.")
    assert "Marie Duval" in got and "Anouk van den Berg" in got and got["Jean-Pierre Élan"]["contexts"] == ["Later Marie Duval called. So Anouk van den Berg de went, 😀 Jean-Pierre Élan too."]
    assert heuristics.name_rows("", heuristics.Options()) == []


def test_run_extraction_is_linear():
    import time

    took = []
    for n in (4000, 16000):
        t = time.perf_counter()
        heuristics.runs("Marie Duval met the Board of Alpine Trust S.A. in Luxembourg. " * n)
        took.append(time.perf_counter() - t)
    assert took[1] < 8 * took[0]


def test_images(spark):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 255, (9, 7, 3)).astype(np.uint8)
    data = images.encode_png(pixels)
    assert (images.decode_png(data) == pixels).all() and images.measure(data) == (7, 9)
    assert images.treat_png(data, "keep") == data and (images.decode_png(images.treat_png(data, "box")) == 64).all()
    assert len(np.unique(images.decode_png(images.treat_png(data, "blur", 10)).reshape(-1, 3), axis=0)) < 63
    assert images.invalid_decision("blur", kind="svg") and images.invalid_decision("box", "x" * 121) and not images.invalid_decision("blur", strength=10)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/media/i.png", data)
    row = images.inventory(spark.createDataFrame([(1, "docx", bytearray(out.getvalue()))], "doc_ord long, format string, raw binary")).first()
    assert (row.width, row.height, row.kind) == (7, 9, "png")


def test_image_places_and_treatment(spark):
    png = images.encode_png(np.full((4, 4, 3), 9, np.uint8))
    blip = lambda i, kind="embed": f'<wp:extent cx="914400" cy="457200"/><a:blip r:{kind}="{i}"/>'
    rels = lambda *t: f"<Relationships {REL}>" + "".join(f'<Relationship Id="r{i}" Type="{KIND}image" Target="{x}"{e}/>' for i, (x, e) in enumerate(t, 1)) + "</Relationships>"
    word = parts({"word/document.xml": f"<w:document>{blip('r1')}<w:lastRenderedPageBreak/>{blip('r2', 'link')}</w:document>", "word/header1.xml": f"<w:hdr>{blip('r1')}</w:hdr>", "word/media/a.png": png, "word/media/b.jpeg": b"\xff\xd8\xff",
                  "word/_rels/document.xml.rels": rels(("media/a.png", ""), ("https://x.lu/y.png", ' TargetMode="External"')), "word/_rels/header1.xml.rels": rels(("media/a.png", ""))})
    deck = parts({"ppt/slides/slide10.xml": f'<p:sld show="0">{blip("r1")}</p:sld>', "ppt/slides/slide9.xml": f"<p:sld>{blip('r1')}</p:sld>", **{f"ppt/slides/_rels/slide{n}.xml.rels": rels(("../media/c.png", "")) for n in (9, 10)}, "ppt/media/c.png": png})
    files = spark.createDataFrame([(0, "docx", word), (1, "pptx", deck), (2, "docx", b"broken"), (3, "pptx", None)], "doc_ord long, format string, raw binary")
    got = [(r.doc_ord, r.asset, r.location, r.ordinal, r.hidden, r.linked, r.width_emu) for r in images.occurrences(files).collect()]
    assert sorted(got) == sorted([(0, "word/media/a.png", "Page 1", 0, False, False, 914400), (0, "https://x.lu/y.png", "Page 2", 1, False, True, 914400), (0, "word/media/a.png", "Header", 0, False, False, 914400),
                                  (1, "ppt/media/c.png", "Slide 9", 0, False, False, 914400), (1, "ppt/media/c.png", "Hidden slide 10", 0, True, False, 914400)])
    assert images.inventory(files).count() == 3
    decisions = spark.createDataFrame([(0, "word/media/a.png", "box", None), (0, "word/media/b.jpeg", "blur", 3), (1, "ppt/media/c.png", "keep", None)], "doc_ord long, part string, treatment string, strength int")
    done = images.treated(files, decisions).cache()
    out = {r.doc_ord: r for r in done.collect()}
    assert out[0].done == {"word/media/a.png": "box", "word/media/b.jpeg": "kept: not a PNG"} and out[1].done == {} and out[2].raw is None
    with zipfile.ZipFile(io.BytesIO(out[0].raw)) as z:
        assert (images.decode_png(z.read("word/media/a.png")) == 64).all()
    assert {(r.treatment, r.images) for r in images.image_report(done).collect()} == {("box", 1), ("kept: not a PNG", 1)}


def test_pdf_text(spark):
    texts = ["B R IDDING ULES  and  more", "Tymoﬁejewicz ﬄ", "I AM HERE", "A B CD", "A B CD Ef", "X Y Z AA BB CC D E FF GG", "a\n\n B R IDDING ULES", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", pdftext.repaired(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["BIDDING RULES and more", "Tymofiejewicz ffl", "I AM HERE", "A B CD", "A B CD Ef", "XAA YBB ZCC DFF EGG", "a\n\nBIDDING RULES", None, ""]


def test_sessions_and_exports(spark, tmp_path):
    book = registry.from_entries(spark, [("email", "a@b.lu", "[EMAIL_1]", 2)])
    session.save(str(tmp_path / "s"), book, registry.no_retired(spark), {"country": "FR"})
    again, retired, settings = session.load(spark, str(tmp_path / "s"))
    assert again.collect() == book.collect() and retired.count() == 0 and settings == {"country": "FR"}
    spark.createDataFrame([('{"version": 99}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "s/session"))
    with pytest.raises(ValueError):
        session.load(spark, str(tmp_path / "s"))
    assert session.export_bytes("csv", "csv", "", [["a", "b,c"]]) == b'a,"b,c"\n'
    for kind, ext in (("docx", "docx"), ("txt", "csv")):
        with pytest.raises(ValueError):
            session.export_bytes(kind, ext, "x")
    with zipfile.ZipFile(io.BytesIO(session.build_zip([("a.md", b"1"), ("a.md", b"2")]))) as z:
        assert z.namelist() == ["a.md", "a_2.md"]
    assert '"count": 2' in session.report_json([("d", "email", 2)], [("a@b.lu", "[EMAIL_1]", "email", 2)]) and "[EMAIL_1]" in session.report_markdown([("d", "email", 2)], [("a", "[EMAIL_1]", "email", 2)])


def test_stream_keeps_numbers(spark, tmp_path):
    source = tmp_path / "in"
    schema = "doc_ord long, region_ord long, text string"
    for i, t in enumerate(["write a@b.lu", "to a@b.lu and c@d.lu"]):
        spark.createDataFrame([(i, 0, t)], schema).coalesce(1).write.mode("append").parquet(str(source))
        query = start(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(str(tmp_path / "out/documents")).orderBy("doc_ord").collect()
    assert [r.anonymised for r in rows] == ["write [EMAIL_1]", "to [EMAIL_1] and [EMAIL_2]"]
