"""File formats: a registry of parsers from bytes to blocks, chosen by content and name. One file is parsed within its row.

A block is (part, text, hidden): hidden names why a reader does not see it, or is null. A file that cannot be parsed gives
an error and no blocks; it never ends the job. Archives that unpack to too much, and documents with entities, are refused.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

Block = tuple[str, str, str | None]
PARSERS: dict[str, Callable[[bytes], Iterator[Block]]] = {}
LARGEST, MOST = 200_000_000, 200

# Namespaces of the formats, and the first bytes that tell a format.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAGIC = ((b"%PDF", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0", "ole"))
NAMES = {"txt": "text", "md": "text", "csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "hwpx": "hwpx", "pdf": "pdf", "png": "png", "jpg": "jpeg", "jpeg": "jpeg"}


def parser(kind: str):
    """Registers a parser of a kind; a later one replaces it."""

    def take(fn):
        PARSERS[kind] = fn
        return fn

    return take


def kind_of(name: str, content: bytes) -> str:
    """What the bytes say, then what the name says; archives by the parts they hold."""
    kind = next((k for m, k in MAGIC if content.startswith(m)), None)
    if kind == "zip":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        except zipfile.BadZipFile:
            return "unknown"
        return "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else "hwpx" if any(n.startswith("Contents/section") for n in names) else "unknown"
    return kind or NAMES.get(name.rsplit(".", 1)[-1].lower(), "unknown")


def member(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    info = z.getinfo(name)
    if info.file_size > LARGEST or info.file_size > 100_000 + MOST * max(info.compress_size, 1):
        raise ValueError("archive unpacks to too much")
    body = z.read(info)
    if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
        raise ValueError("document with entities")
    return ElementTree.fromstring(body)


def decode(content: bytes) -> str:
    for code in ("utf-8-sig", "cp949"):
        try:
            return content.decode(code)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


@parser("text")
def text(content: bytes) -> Iterator[Block]:
    for line in decode(content).splitlines():
        yield "body", line, None


@parser("csv")
def table(content: bytes) -> Iterator[Block]:
    body = decode(content)
    first = body.partition("\n")[0]
    mark = "\t" if first.count("\t") and first.count("\t") >= first.count(",") else ","
    for row in csv.reader(io.StringIO(body), delimiter=mark):
        yield "row", " | ".join(c.strip() for c in row), None


@parser("html")
def html(content: bytes) -> Iterator[Block]:
    out: list[Block] = []

    class Reader(HTMLParser):
        void = {"br", "img", "input", "meta", "link", "hr"}

        def __init__(self):
            super().__init__()
            self.open: list[tuple[str, str | None]] = []

        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            style = a.get("style", "").replace(" ", "").lower()
            why = "SCRIPT" if tag in ("script", "style") else "HIDDEN" if "hidden" in a or "display:none" in style or "visibility:hidden" in style else "TINY" if "font-size:0" in style else None
            if tag not in self.void:
                self.open.append((tag, why or (self.open[-1][1] if self.open else None)))

        def handle_endtag(self, tag):
            while any(t == tag for t, _ in self.open):
                if self.open.pop()[0] == tag:
                    break

        def handle_data(self, data):
            why = self.open[-1][1] if self.open else None
            if data.strip() and why != "SCRIPT":
                out.append(("body", " ".join(data.split()), why))

        def handle_comment(self, data):
            if data.strip():
                out.append(("comment", " ".join(data.split()), "COMMENT"))

    reader = Reader()
    reader.feed(decode(content))
    reader.close()
    yield from out


@parser("docx")
def word(content: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|comments)\.xml", n)]
        for name in sorted(parts, key=lambda n: (n != "word/document.xml", n)):
            part = re.sub(r"\d*\.xml$", "", name[5:]).replace("document", "body")
            for p in member(z, name).iter(f"{WORD}p"):
                gone = {id(r) for d in p.iter(f"{WORD}del") for r in d.iter(f"{WORD}r")}
                runs = [r for r in p.iter(f"{WORD}r") if id(r) not in gone]
                hidden = [r for r in runs if r.find(f"{WORD}rPr/{WORD}vanish") is not None]
                say = lambda rs: "".join(t.text or "" for r in rs for t in r.findall(f"{WORD}t"))
                yield part, say([r for r in runs if r not in hidden]), "COMMENT" if part == "comments" else None
                if say(hidden):
                    yield part, say(hidden), "VANISH"


@parser("xlsx")
def workbook(content: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in member(z, "xl/sharedStrings.xml").iter(f"{SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in member(z, "xl/_rels/workbook.xml.rels")}
        for s in member(z, "xl/workbook.xml").iter(f"{SHEET}sheet"):
            tree = member(z, "xl/" + (targets.get(s.get(f"{REL}id")) or "").lstrip("/").removeprefix("xl/"))
            veiled = [(int(c.get("min")), int(c.get("max"))) for c in tree.iter(f"{SHEET}col") if c.get("hidden") in ("1", "true")]
            for row in tree.iter(f"{SHEET}row"):
                seen, unseen = [], []
                for at, c in enumerate(row.findall(f"{SHEET}c"), 1):
                    letters = re.match("[A-Z]*", c.get("r") or "").group()
                    column = 0
                    for ch in letters:
                        column = column * 26 + ord(ch) - 64
                    v = c.findtext(f"{SHEET}v") or ""
                    value = shared[int(v)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else v
                    (unseen if any(a <= (column or at) <= b for a, b in veiled) else seen).append(value)
                why = "HIDDEN_SHEET" if s.get("state") in ("hidden", "veryHidden") else "HIDDEN_ROW" if row.get("hidden") in ("1", "true") else None
                if seen:
                    yield s.get("name"), " | ".join(seen), why
                if unseen:
                    yield s.get("name"), " | ".join(unseen), why or "HIDDEN_COLUMN"


@parser("hwpx")
def hangul(content: bytes) -> Iterator[Block]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
            tree = member(z, name)
            inner = {id(p) for t in tree.iter() if local(t) in ("tbl", "header", "footer") for p in t.iter() if local(p) == "p"}
            for p in (e for e in tree.iter() if local(e) == "p"):
                own = [e for run in p if local(run) == "run" for e in run if local(e) == "t"]
                if own:
                    yield "table" if id(p) in inner else "body", "".join("".join(t.itertext()) for t in own), None


@parser("png")
def png(content: bytes) -> Iterator[Block]:
    width, height = struct.unpack(">II", content[16:24])
    yield "size", f"{width}x{height}", None
    at = 8
    while at + 8 <= len(content):
        n, name = struct.unpack(">I4s", content[at : at + 8])
        if name == b"tEXt":
            key, _, value = content[at + 8 : at + 8 + n].partition(b"\0")
            yield "metadata", f"{key.decode('latin-1')}: {value.decode('latin-1')}", "METADATA"
        at += 12 + n
    if b"IEND" not in content[-12:]:
        yield "trailer", f"{len(content) - content.rfind(b'IEND') - 8} bytes after the end", "TRAILING"


@parser("jpeg")
def jpeg(content: bytes) -> Iterator[Block]:
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        mark, n = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + n]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            yield "size", f"{width}x{height}", None
        if mark == 0xE1 and body.startswith(b"Exif"):
            yield "metadata", f"Exif, {len(body)} bytes", "METADATA"
        if mark == 0xFE:
            yield "metadata", body.decode("latin-1"), "METADATA"
        if mark == 0xDA:
            break
        at += 2 + n


TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[^\s\[\]()<>/]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


@parser("pdf")
def pdf(content: bytes) -> Iterator[Block]:
    """Text that page contents show in fonts of one byte, with why a reader does not see it, and the document's information.

    Flate streams only; fonts with a map of their own give what their codes say.
    """
    for key, value in re.findall(rb"/(Title|Author|Producer|Creator|CreationDate|ModDate)\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", content):
        yield "metadata", f"{key.decode()}: {_string(value)}", "METADATA"
    spent = 0
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*)>>\s*stream\r?\n", content):
        if b"/Subtype" in m[1] or b"/Type" in m[1]:
            continue
        body = content[m.end() : content.find(b"endstream", m.end())]
        if b"FlateDecode" in m[1]:
            unpack = zlib.decompressobj()
            body = unpack.decompress(body, LARGEST)
            spent += len(body)
            if unpack.unconsumed_tail or spent > LARGEST:
                raise ValueError("streams unpack to too much")
        mode, size, white, held, line = 0, 12.0, False, [], []

        def flush(line=line):
            t = "".join(x for x, _ in line)
            why = next((w for _, w in line if w), None)
            line.clear()
            return ("page", t, why) if t.strip() else None

        for token in TOKEN.findall(body):
            if token[:1] in (b"(", b"<", b"[", b"]", b"/") or re.fullmatch(rb"[+-]?[0-9.]+", token):
                held.append(token)
                continue
            numbers = [float(x) for x in held if re.fullmatch(rb"[+-]?[0-9]*\.?[0-9]+", x)]
            if token == b"Tr" and numbers:
                mode = int(numbers[-1])
            elif token == b"Tf" and numbers:
                size = numbers[-1]
            elif token in (b"g", b"rg") and numbers:
                white = all(x >= 0.98 for x in numbers[-(1 if token == b"g" else 3) :])
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                why = "INVISIBLE" if mode == 3 else "TINY" if abs(size) < 1 else "WHITE" if white else None
                line.append(("".join(_string(x) for x in held if x[:1] in (b"(", b"<")), why))
            if token in (b"Td", b"TD", b"T*", b"Tm", b"ET", b"'", b'"') and line:
                block = flush()
                if block:
                    yield block
            held = []


def parse(files: DataFrame) -> DataFrame:
    """(path, kind, block_no, part, text, hidden, error) of files(path, content): a row per block, or one with an error.

    An empty file and one without blocks give one row without text; a null content is an error.
    """

    def run(batches):
        import pyarrow as pa

        names = ["path", "kind", "block_no", "part", "text", "hidden", "error"]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, rows = "unknown", []
                try:
                    kind = kind_of(path or "", content)
                    if kind not in PARSERS:
                        raise ValueError(f"no parser for {kind}")
                    rows = [(path, kind, i, part, t, why, None) for i, (part, t, why) in enumerate(PARSERS[kind](content))]
                    rows = rows or [(path, kind, 0, None, None, None, None)]
                except Exception as e:  # whatever a broken file raises belongs to its row
                    rows = [(path, kind, 0, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, kind string, block_no int, part string, text string, hidden string, error string")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """parse() of every file below a folder."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def workbook_bytes(sheets: list[tuple[str, list[list[str]], set[int]]], hidden: set[str] = frozenset()) -> bytes:
    """A workbook of (sheet, rows of cells, numbers of hidden rows); cells are text and none is a formula."""
    from xml.sax.saxutils import escape, quoteattr

    head = '<?xml version="1.0" encoding="UTF-8"?>'
    clean = lambda t: escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "�", t))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        relation = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{REL[1:-1]}/{kind}" Target="{target}"/>'
        links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
        z.writestr("_rels/.rels", head + links.format(relation(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", head + links.format("".join(relation(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1))))
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"{" state=" + quoteattr("hidden") if n in hidden else ""}/>' for i, (n, _, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{SHEET[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        for i, (_, rows, veiled) in enumerate(sheets, 1):
            cells = lambda row: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{clean(c)}</t></is></c>' for c in row)
            body = "".join(f'<row r="{n}"{" hidden=" + quoteattr("1") if n in veiled else ""}>{cells(row)}</row>' for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()
