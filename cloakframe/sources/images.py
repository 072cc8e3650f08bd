"""Images inside Office packages: an inventory, kinds and sizes by their first bytes, decisions, and treated PNGs."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .office import BROKEN, relations, rewritten_zip

TREATMENTS = ["keep", "box", "blur", "remove"]


def kind_of(content: Column) -> Column:
    """png, jpeg, gif, bmp, svg or null, natively from the first bytes."""
    head = F.substring(F.hex(content), 1, 16)
    text = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(text.contains("<svg"), "svg")


def measure(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:3] == b"\xff\xd8\xff" and at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def inventory(files: DataFrame) -> DataFrame:
    """``doc_ord, part, sha256, width, height, content, kind`` of every image in docx and pptx files (doc_ord, format, raw); a
    package that can't be read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, raw in zip(batch.column("doc_ord").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        for name in sorted(n for n in z.namelist() if "/media/" in n):
                            data = z.read(name)
                            rows.append((d, name, hashlib.sha256(data).hexdigest(), *(measure(data) or (None, None)), data))
                except BROKEN:
                    continue
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], ["doc_ord", "part", "sha256", "width", "height", "content"])

    found = files.where("format IN ('docx', 'pptx')").select("doc_ord", "raw").mapInArrow(run, "doc_ord long, part string, sha256 string, width int, height int, content binary")
    return found.withColumn("kind", kind_of(F.col("content")))


_PLACES = [
    (re.compile(r"word/document\.xml"), "Page"), (re.compile(r"word/header\d*\.xml"), "Header"), (re.compile(r"word/footer\d*\.xml"), "Footer"), (re.compile(r"word/footnotes\.xml"), "Footnotes"),
    (re.compile(r"word/endnotes\.xml"), "Endnotes"), (re.compile(r"ppt/slides/slide(\d+)\.xml"), "Slide"), (re.compile(r"ppt/slideLayouts/\w+\.xml"), "Slide layout"),
    (re.compile(r"ppt/slideMasters/\w+\.xml"), "Slide master"), (re.compile(r"ppt/notesSlides/notesSlide(\d+)\.xml"), "Notes"),
]
_EVENT = re.compile(r"<w:lastRenderedPageBreak|<w:br\b[^>]*w:type=\"page\"|<(?:\w+:)?ext(?:ent)?\b[^>]*\bcx=\"(\d+)\"[^>]*\bcy=\"(\d+)\"|<a:blip\b[^>]*\br:(embed|link)=\"([^\"]+)\"")
OCCURRENCES = "doc_ord long, asset string, part string, ordinal int, location string, hidden boolean, linked boolean, width_emu long, height_emu long"


def _places_in(z: zipfile.ZipFile, part: str, label: str, number: str) -> Iterator[tuple]:
    xml, targets = z.read(part).decode(), relations(z, part)
    hidden = label == "Slide" and re.search(r"<p:sld\b[^>]*\bshow=\"0\"", xml) is not None
    page, frame, n = 1, (None, None), 0
    for m in _EVENT.finditer(xml):
        if m[4]:
            place = f"{label} {page}" if label == "Page" else f"{'Hidden slide' if hidden else label} {number}" if number else label
            yield targets.get(m[4], ("", m[4]))[1], part, n, place, hidden, m[3] == "link", *frame
            n += 1
        elif m[1]:
            frame = int(m[1]), int(m[2])
        else:
            page += 1


def occurrences(files: DataFrame) -> DataFrame:
    """OCCURRENCES: every place where docx and pptx files (doc_ord, format, raw) show an image, in the order of the parts, with
    the frame it is drawn in. A linked image is not in the package; a logo on five slides is one asset in five places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, raw in zip(batch.column("doc_ord").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        hits = [(i, int(m[1]) if m.groups() else 0, name, label) for name in z.namelist() for i, (shape, label) in enumerate(_PLACES) if (m := shape.fullmatch(name))]
                        for _, number, name, label in sorted(hits):
                            rows += [(d, *x) for x in _places_in(z, name, label, str(number or ""))]
                except BROKEN:
                    continue
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], [c.split()[0] for c in OCCURRENCES.split(", ")])

    return files.where("format IN ('docx', 'pptx')").select("doc_ord", "raw").mapInArrow(run, OCCURRENCES)


def treated(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """``doc_ord, raw, done`` of files (doc_ord, raw) with their images treated as ``decisions`` (doc_ord, part, treatment,
    strength) say; ``done`` maps parts to what became of them: the treatment, or ``kept: why``."""
    wanted = decisions.groupBy("doc_ord").agg(F.collect_list(F.struct("part", "treatment", "strength")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, done = batch.column("raw")[i].as_py(), {}
                asked = {x["part"]: (x["treatment"], x["strength"] or 5) for x in batch.column("d")[i].as_py() or []}

                def change(name: str, data: bytes, asked=asked, done=done) -> bytes | None:
                    treatment, strength = asked.get(name, ("keep", 5))
                    if treatment == "keep":
                        return None
                    try:
                        new = treat_png(data, treatment, strength)
                    except (ValueError, struct.error, zlib.error) as error:
                        done[name] = f"kept: {error}"
                        return None
                    done[name] = treatment
                    return new

                try:
                    new = rewritten_zip(raw or b"", change)
                except BROKEN:
                    new = None
                yield pa.RecordBatch.from_arrays([batch.column("doc_ord").slice(i, 1), pa.array([new], pa.binary()), pa.array([list(done.items())], pa.map_(pa.string(), pa.string()))], ["doc_ord", "raw", "done"])

    return files.select("doc_ord", "raw").join(wanted, "doc_ord", "left").select("doc_ord", "raw", "d").mapInArrow(run, "doc_ord long, raw binary, done map<string, string>")


def image_report(done: DataFrame) -> DataFrame:
    """``treatment, images, documents`` over the output of ``treated``."""
    rows = done.select("doc_ord", F.explode("done").alias("part", "treatment"))
    return rows.groupBy("treatment").agg(F.count("*").alias("images"), F.countDistinct("doc_ord").alias("documents"))


def invalid_decision(treatment: str, label: str = "", strength: int = 1, kind: str = "png") -> str:
    """``""`` for a decision that can be carried out, else why not."""
    if treatment not in TREATMENTS:
        return f"no treatment {treatment}"
    if treatment == "box" and len(label) > 120:
        return "the label is longer than 120 characters"
    if treatment == "blur" and not 1 <= strength <= 10:
        return "strength is not within 1 to 10"
    return "an SVG cannot be blurred" if treatment == "blur" and kind == "svg" else ""


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit grey, RGB or RGBA PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or colour not in (0, 2, 4, 6) or laced:
        raise ValueError("unsupported PNG")
    channels, body, at = {0: 1, 2: 3, 4: 2, 6: 4}[colour], b"", 8
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.int64)
    for y in range(height):
        f, line, up = rows[y, 0], rows[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(width * channels, np.int64)
        if f == 0:
            out[y] = line
        elif f == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(width * channels):
                a, b, c = out[y, x - channels] if x >= channels else 0, up[x], up[x - channels] if x >= channels else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, x] = (line[x] + (a if f == 1 else (a + b) // 2 if f == 3 else near)) & 255
    return out.reshape(height, width, channels).astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def treat_png(data: bytes, treatment: str, strength: int = 5) -> bytes:
    """A PNG kept, blanked (box, remove) or turned into a mosaic whose tiles grow with ``strength``."""
    if treatment == "keep":
        return data
    pixels = decode_png(data)
    if treatment in ("box", "remove"):
        return encode_png(np.full_like(pixels, 255 if treatment == "remove" else 64))
    tile = max(2, max(pixels.shape[:2]) * strength // 100)
    out = pixels.astype(np.float64)
    for y in range(0, pixels.shape[0], tile):
        for x in range(0, pixels.shape[1], tile):
            out[y : y + tile, x : x + tile] = out[y : y + tile, x : x + tile].mean(axis=(0, 1))
    return encode_png(out.round().astype(np.uint8))
