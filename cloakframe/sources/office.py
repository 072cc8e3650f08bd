"""Office packages with the standard library: text of docx, pptx and xlsx, properties, and same-format rewriting."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename, dirname, join, normpath
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADING = re.compile(r"^(?:Heading|Titre)([1-6])$")
#: What stands for a page break inside a paragraph until the text is cut into pages.
PAGE_BREAK = "\f"
IMAGE = "*[image omitted]*"
# Properties that hold names, by part.
PROPERTIES = {
    "docProps/core.xml": ["title", "subject", "creator", "lastModifiedBy", "keywords", "description"],
    "docProps/app.xml": ["Company", "Manager"],
    "docProps/custom.xml": ["lpwstr", "lpstr", "bstr"],
}


def relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """By id, the kind and the target (a part of the package, or an outer address) of what ``part`` refers to."""
    name = join(dirname(part), "_rels", basename(part) + ".rels")
    if name not in z.namelist():
        return {}
    found = {}
    for e in ET.fromstring(z.read(name)):
        target = e.get("Target", "")
        if e.get("TargetMode") != "External":
            target = normpath(join(dirname(part), target)) if not target.startswith("/") else target[1:]
        found[e.get("Id", "")] = e.get("Type", "").rsplit("/", 1)[-1], target
    return found


def _table(rows: list[list[str]]) -> str:
    clean = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in rows if r]
    if not clean:
        return ""
    width = max(map(len, clean))
    clean = [r + [""] * (width - len(r)) for r in clean]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _emphasised(text: str, bold: bool, italic: bool) -> str:
    """Markers around a stretch of text, inside its outer spaces."""
    core = text.strip()
    if not core or not (bold or italic):
        return text
    mark = "*" * (2 * bold + italic)
    at = text.index(core)
    return text[:at] + mark + core + mark + text[at + len(core) :]


def _on(properties: ET.Element | None, tag: str) -> bool:
    e = properties.find(W + tag) if properties is not None else None
    return e is not None and e.get(W + "val") not in ("false", "0")


class _Docx:
    def __init__(self, z: zipfile.ZipFile):
        self.links = {i: t for i, (kind, t) in relations(z, "word/document.xml").items() if kind == "hyperlink"}
        self.images = 0
        self.ordered: set[tuple[str, str]] = set()
        if "word/numbering.xml" in z.namelist():
            root = ET.fromstring(z.read("word/numbering.xml"))
            kinds = {(a.get(W + "abstractNumId"), v.get(W + "ilvl")): f.get(W + "val") for a in root.iter(W + "abstractNum") for v in a.iter(W + "lvl") if (f := v.find(W + "numFmt")) is not None}
            for n in root.iter(W + "num"):
                of = n.find(W + "abstractNumId")
                self.ordered |= {(n.get(W + "numId"), level) for (a, level), kind in kinds.items() if of is not None and a == of.get(W + "val") and kind != "bullet"}

    def run(self, e: ET.Element) -> str:
        out = []
        for x in e.iter():
            if x.tag == W + "t":
                out.append(x.text or "")
            elif x.tag == W + "tab":
                out.append("\t")
            elif x.tag == W + "lastRenderedPageBreak" or x.tag == W + "br" and x.get(W + "type") == "page":
                out.append(PAGE_BREAK)
            elif x.tag == W + "br":
                out.append(" ")
            elif x.tag in (W + "drawing", W + "pict"):
                self.images += 1
                out.append(IMAGE)
        return "".join(out)

    def inline(self, parent: ET.Element) -> str:
        """Runs of one look side by side get their markers once, however the file cuts them."""
        stretches: list[tuple[str, bool, bool]] = []
        for e in parent:
            if e.tag == W + "r":
                look = e.find(W + "rPr")
                piece = (self.run(e), _on(look, "b"), _on(look, "i"))
            elif e.tag == W + "hyperlink" and (target := self.links.get(e.get(R + "id", ""))):
                piece = (f"[{self.inline(e)}]({target})", False, False)
            elif e.tag in (W + "pPr", W + "del"):
                continue
            else:
                piece = (self.inline(e), False, False)
            if stretches and stretches[-1][1:] == piece[1:]:
                stretches[-1] = (stretches[-1][0] + piece[0], *piece[1:])
            elif piece[0]:
                stretches.append(piece)
        return "".join(_emphasised(*x) for x in stretches)

    def paragraph(self, e: ET.Element) -> tuple[str, bool]:
        """The line and whether it is a list item."""
        text = self.inline(e)
        style = e.find(f"{W}pPr/{W}pStyle")
        level = _HEADING.match(style.get(W + "val", "")) if style is not None else None
        if level:
            return "#" * int(level[1]) + " " + text.strip(), False
        number = e.find(f"{W}pPr/{W}numPr/{W}numId")
        if number is not None:
            depth = e.find(f"{W}pPr/{W}numPr/{W}ilvl")
            at = depth.get(W + "val", "0") if depth is not None else "0"
            marker = "1." if (number.get(W + "val"), at) in self.ordered else "-"
            return "  " * min(8, int(at) if at.isdecimal() else 0) + marker + " " + text.strip(), True
        return text, False

    def blocks(self, parent: ET.Element) -> Iterator[tuple[str, bool]]:
        for e in parent:
            if e.tag == W + "p":
                line, item = self.paragraph(e)
                if line.strip():
                    yield line, item
            elif e.tag == W + "tbl":
                cells = lambda r: [" ".join(t.strip() for t, _ in self.blocks(c) if t.strip()) for c in r.findall(W + "tc")]
                if table := _table([cells(r) for r in e.findall(W + "tr")]):
                    yield table, False
            elif e.tag in (W + "sdt", W + "sdtContent"):
                yield from self.blocks(e)


def docx_pages(raw: bytes) -> tuple[list[str], list[str]]:
    """Markdown of the body by pages, as far as the file remembers where pages broke, and warnings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        reader = _Docx(z)
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        out, listed = "", False
        for line, item in reader.blocks(body) if body is not None else ():
            out += ("\n" if listed and not item else "") + line + ("\n" if item else "\n\n")
            listed = item
    pages = [x.strip("\n") for x in out.split(PAGE_BREAK)]
    return pages, [f"{reader.images} images were left out"] if reader.images else []


def docx_text(raw: bytes) -> tuple[str, int]:
    """Markdown of the body (headings, lists, tables, emphasis, links) and its number of pages."""
    pages, _ = docx_pages(raw)
    return "\n\n".join(p for p in pages if p) + "\n", len(pages)


def _shapes(root: ET.Element, notes: bool) -> tuple[str, str]:
    """The title and the body of a slide: bullets by level and tables, in the order of the file; of notes, plain lines."""
    title, lines = "", []
    for e in root.iter():
        if e.tag == P + "sp":
            holder = e.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            kind = holder.get("type", "body") if holder is not None else ""
            if notes and kind != "body" or kind in ("sldNum", "dt", "ftr", "hdr", "sldImg"):
                continue
            heading = not notes and kind in ("title", "ctrTitle")
            for p in e.iter(A + "p"):
                look = p.find(A + "pPr")
                depth = int(look.get("lvl", "0")) if look is not None and look.get("lvl", "0").isdecimal() else 0
                text = "".join("\n" if x.tag == A + "br" else x.text or "" for x in p.iter() if x.tag in (A + "t", A + "br"))
                for line in filter(None, map(str.strip, text.split("\n"))):
                    if heading and not title:
                        title = line
                    else:
                        lines.append(line if notes or heading else "  " * depth + "- " + line)
        elif e.tag == A + "tbl":
            cell = lambda c: " ".join("".join(t.text or "" for t in p.iter(A + "t")).strip() for p in c.iter(A + "p"))
            lines += ["", _table([[cell(c) for c in r.findall(A + "tc")] for r in e.findall(A + "tr")]), ""]
    return title, "\n".join(lines).strip("\n")


def pptx_slides(raw: bytes) -> list[str]:
    """``## Slide N: title`` with its text, tables and notes, slides by number; notes are found by the slide's own relations."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            title, body = _shapes(ET.fromstring(z.read(name)), False)
            parts = [f"## Slide {number(name)}" + (f": {title}" if title else ""), body]
            for kind, target in relations(z, name).values():
                if kind == "notesSlide" and target in z.namelist() and (said := _shapes(ET.fromstring(z.read(target)), True)[1]):
                    parts.append("**Notes:**\n\n" + said)
            out.append("\n\n".join(p for p in parts if p))
    if not out:
        raise ValueError("the file contains no slides")
    return out


def pptx_text(raw: bytes) -> tuple[str, int]:
    slides = pptx_slides(raw)
    return "\n\n".join(slides) + "\n", len(slides)


@dataclass
class Sheet:
    """``reason`` says why a sheet is no plain table; then ``json`` holds its cells by address."""

    name: str
    grid: list[list[str]]
    reason: str = ""

    @property
    def json(self) -> str:
        cells = {f"{_column(c)}{r + 1}": v for r, row in enumerate(self.grid) for c, v in enumerate(row) if v.strip()}
        return json.dumps(dict(sorted(cells.items())), indent=2, ensure_ascii=False)


def _column(n: int) -> str:
    name = ""
    n += 1
    while n:
        n, digit = divmod(n - 1, 26)
        name = chr(65 + digit) + name
    return name


def _number(text: str) -> bool:
    try:
        float(text.strip())
    except ValueError:
        return False
    return True


def complex_reason(grid: list[list[str]], merged: int) -> str:
    """Why a trimmed grid is no table with a header, "" if it is one."""
    full = [[bool(c.strip()) for c in r] for r in grid]
    if merged:
        return f"{merged} merged cell ranges"
    if row := next((i + 1 for i, r in enumerate(full) if not any(r)), 0):
        return f"empty row {row} inside the data"
    if column := next((j + 1 for j in range(len(full[0])) if not any(r[j] for r in full)), 0):
        return f"empty column {column} inside the data"
    if not all(full[0]):
        return "first row has empty cells"
    return "first row contains numbers" if any(map(_number, grid[0])) else ""


def xlsx_sheets(raw: bytes) -> tuple[list[Sheet], list[str]]:
    """The sheets that hold anything, named and found as the workbook's relations say, and warnings. Grids begin at A1."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        parts = {i: t for i, (kind, t) in relations(z, "xl/workbook.xml").items() if kind == "worksheet"}
        sheets, warnings = [], []
        for e in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
            name, part = e.get("name", ""), parts.get(e.get(R + "id", ""), "")
            if part not in names:
                continue
            root, cells = ET.fromstring(z.read(part)), {}
            for c in root.iter(S + "c"):
                m = re.match(r"([A-Z]+)(\d+)$", c.get("r", ""))
                value = c.find(S + "v")
                text = "".join(t.text or "" for t in c.iter(S + "t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                if m and text.strip():
                    column = 0
                    for ch in m[1]:
                        column = column * 26 + ord(ch) - 64
                    cells[int(m[2]) - 1, column - 1] = text
            if not cells:
                warnings.append(f"sheet {name} is empty, skipped")
                continue
            bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
            grid = [[cells.get((r, c), "") for c in range(right + 1)] for r in range(bottom + 1)]
            sheets.append(Sheet(name, grid, complex_reason(grid, sum(1 for _ in root.iter(S + "mergeCell")))))
    if not sheets:
        raise ValueError("the workbook has no cells")
    return sheets, warnings


# rewriting: text nodes of a part by blocks that are read as one text

_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(/?)([\w:.-]+)([^>]*?)(/?)>", re.DOTALL)
_ENTITIES = {"&quot;": '"', "&apos;": "'"}
_KINDS = [
    (re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"), {"w:t", "a:t"}, {"w:p", "a:p"}),
    (re.compile(r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml"), {"a:t"}, {"a:p"}),
    (re.compile(r"ppt/comments/\w+\.xml"), {"p:text", "a:t"}, {"p:text", "a:p"}),
    (re.compile(r"xl/sharedStrings\.xml"), {"t"}, {"si"}),
    (re.compile(r"xl/(?:worksheets/sheet\d+|comments\d*)\.xml"), {"t"}, {"c", "comment"}),
    *((re.compile(re.escape(part)), set(names), set(names)) for part, names in PROPERTIES.items()),
]


def _blocks_of(part: str, xml: str) -> list[list[tuple[int, int]]]:
    """Places of the text nodes of every block of a part. Cells with a formula and parts that hold no text have none."""
    kind = next((k for k in _KINDS if k[0].fullmatch(part)), None)
    if kind is None:
        return []
    _, texts, ends = kind
    plain = part.startswith("docProps/")
    out: list[list[tuple[int, int]]] = []
    group: list[tuple[int, int]] = []
    begun, formula = -1, False
    for m in _TAG.finditer(xml):
        if m[2] is None:
            continue
        name = m[2].rsplit(":", 1)[-1] if plain else m[2]
        if not m[1] and not m[4]:
            formula |= name == "f"
            if name in texts:
                begun = m.end()
        elif m[1]:
            if name in texts and begun >= 0:
                group.append((begun, m.start()))
                begun = -1
            if name in ends:
                if group and not formula:
                    out.append(group)
                group, formula = [], False
    if group:
        out.append(group)
    return out


def text_blocks(raw: bytes) -> list[tuple[str, int, str]]:
    """(part, number of the block, text) of everything in a package that may be rewritten: paragraphs, string cells, comments
    and properties. A name split over runs is whole here."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for part in z.namelist():
            if any(k[0].fullmatch(part) for k in _KINDS):
                xml = z.read(part).decode()
                for n, group in enumerate(_blocks_of(part, xml)):
                    out.append((part, n, "".join(unescape(xml[a:b], _ENTITIES) for a, b in group)))
    return out


def rewrite(raw: bytes, replacements: dict[tuple[str, int], list[tuple[int, int, str]]]) -> bytes:
    """The package with (start, end, new) written over in the blocks named by (part, number). What is new stands where the
    replaced stretch begins; markup, other parts and their compressed bytes stay as they are."""
    parts = {part for part, _ in replacements}

    def changed(part: str, data: bytes) -> bytes:
        xml, out, last = data.decode(), [], 0
        for n, group in enumerate(_blocks_of(part, xml)):
            own = sorted(replacements.get((part, n), ()))
            at = 0
            for a, b in group:
                text = unescape(xml[a:b], _ENTITIES)
                begin, end = at, at + len(text)
                at = end
                pieces, pos = [], begin
                for s, e, new in own:
                    if s < end and e > begin:
                        pieces += [text[pos - begin : max(pos, s) - begin], new if s >= begin else ""]
                        pos = max(pos, min(e, end))
                if pieces:
                    out += [xml[last:a], escape("".join([*pieces, text[pos - begin :]]))]
                    last = b
        return "".join([*out, xml[last:]]).encode()

    return rewritten_zip(raw, lambda name, data: changed(name, data) if name in parts else None)


def rewritten_zip(raw: bytes, change) -> bytes:
    """The archive with the entries for which ``change(name, data)`` gives bytes; all others with their compressed bytes as they were."""
    out, directory = io.BytesIO(), []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            data = None if info.is_dir() else change(info.filename, z.read(info))
            if data is None:
                name_size, extra_size = struct.unpack_from("<HH", raw, info.header_offset + 26)
                at = info.header_offset + 30 + name_size + extra_size
                method, crc, size, body = info.compress_type, info.CRC, info.file_size, raw[at : at + info.compress_size]
            else:
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                method, crc, size, body = zipfile.ZIP_DEFLATED, zlib.crc32(data), len(data), packer.compress(data) + packer.flush()
            name = info.filename.encode()
            y, mo, d, h, mi, s = info.date_time
            stamp = (h << 11 | mi << 5 | s // 2, (y - 1980) << 9 | mo << 5 | d)
            flags = (info.flag_bits & ~8) | 0x800
            common = struct.pack("<HHHHHIIIH", 20, flags, method, *stamp, crc, len(body), size, len(name))
            directory.append(b"PK\1\2" + struct.pack("<H", info.create_system << 8 | 20) + common + struct.pack("<HHHHII", 0, 0, 0, info.internal_attr, info.external_attr, out.tell()) + name)
            out.write(b"PK\3\4" + common + struct.pack("<H", 0) + name + body)
    start = out.tell()
    out.write(b"".join(directory))
    size = out.tell() - start
    out.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(directory), len(directory), size, start, 0))
    return out.getvalue()


BROKEN = (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, zlib.error)


def readable_blocks(raw: bytes | None) -> list[tuple[str, int, str]]:
    """``text_blocks``, none for bytes that are no package."""
    try:
        return text_blocks(raw or b"")
    except BROKEN:
        return []


def rewritten(raw: bytes | None, replacements: dict[tuple[str, int], list[tuple[int, int, str]]]) -> bytes | None:
    """``rewrite``, null for bytes that are no package."""
    try:
        return rewrite(raw or b"", replacements)
    except BROKEN:
        return None


def properties(raw: bytes) -> dict[str, str]:
    """Core, application and custom string properties that hold text."""
    found = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for part, names in PROPERTIES.items():
            if part in z.namelist():
                for e in ET.fromstring(z.read(part)).iter():
                    name = e.tag.rsplit("}", 1)[-1]
                    if name in names and (e.text or "").strip():
                        found[name if part != "docProps/custom.xml" else f"custom:{len(found)}"] = e.text
    return found


OFFICE = "doc_ord long, name string, format string, text string, grid array<array<string>>, unit string, unit_count int, pages array<string>, warnings array<string>, error string"


def load_office(files: DataFrame) -> DataFrame:
    """OFFICE rows: docx and pptx as one document each with their pages, xlsx as one for each sheet: a table as ``grid``, any
    other as the JSON of its cells in ``text``. A file that can't be read is a row with ``error``."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    names = [f.split(" ")[0] for f in OFFICE.split(", ")]

    def rows_of(doc: int, name: str, kind: str, raw: bytes) -> list[tuple]:
        if kind == "xlsx":
            sheets, warnings = xlsx_sheets(raw)
            told = lambda x: [*warnings, f"sheet {x.name} is no plain table ({x.reason}): kept as the JSON of its cells"] if x.reason else warnings
            return [(doc, f"{name}#{x.name}", kind, x.json if x.reason else None, None if x.reason else x.grid, "row", len(x.grid) - 1, None, told(x), None) for x in sheets]
        pages, warnings = docx_pages(raw) if kind == "docx" else (pptx_slides(raw), [])
        return [(doc, name, kind, "\n\n".join(p for p in pages if p) + "\n", None, "page" if kind == "docx" else "slide", len(pages), pages, warnings, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, name, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_ord", "name", "format", "raw")), strict=True):
                try:
                    rows += rows_of(d, name, kind, raw)
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, zlib.error, ET.ParseError) as error:
                    rows.append((d, name, kind, None, None, None, None, None, [], str(error) or type(error).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)

    wanted = files.where("format IN ('docx', 'pptx', 'xlsx')").select("doc_ord", "name", "format", "raw")
    return wanted.mapInArrow(run, OFFICE)


def same_format_name(name: str, ext: str, entries: list[tuple[str, str, str]], n: int) -> str:
    """A file name with its known originals replaced; a neutral one if an original still stands in it."""
    from ..operators.dictionary import Dictionary
    from ..operators.rewrite import replace_known

    stem = re.sub(r"(?<=.)\.[A-Za-z0-9]{1,4}$", "", name.replace("#", "_"))
    stem, _ = replace_known(stem, Dictionary([original for original, _, _ in entries]), [(placeholder, category) for _, placeholder, category in entries])
    if any(original.lower() in stem.lower() for original, _, _ in entries):
        return f"document_anon_{n}.{ext}"
    return re.sub(r"[\[\]]", "", stem) + f"_anon.{ext}"


def property_rows(files: DataFrame) -> DataFrame:
    """``doc_ord, field, text`` of the properties of Office files: a table that runs through the ordinary operators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, v) for d, raw in zip(batch.column("doc_ord").to_pylist(), batch.column("raw").to_pylist(), strict=True) for k, v in properties(raw).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_ord", "field", "text"])

    return files.where("format IN ('docx', 'pptx', 'xlsx')").select("doc_ord", "raw").mapInArrow(run, "doc_ord long, field string, text string")
