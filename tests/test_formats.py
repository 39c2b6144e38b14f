"""File formats on made files: what a reader sees, what is hidden, and broken files."""

import io
import struct
import zipfile
import zlib

from attestor.sources import formats as f


def packed(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return buf.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"


def pdf():
    body = zlib.compress(b"BT /F1 12 Tf (Shown \\(text\\)) Tj 0 -14 Td [(spl) -20 (it)] TJ 0 -14 Td 3 Tr (unseen) Tj 0 Tr ET BT 1 g (white) Tj 0 g 0 -9 Td <48 69> Tj ET")
    return b"%PDF-1.4\n1 0 obj << /Title (A \\050b\\051) >> endobj 2 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj"


def test_kinds(spark):
    files = {
        "a.docx": packed({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>seen</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>gone</w:t></w:r><w:del><w:r><w:t>cut</w:t></w:r></w:del></w:p></w:body></w:document>", "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>"}),
        "b.hwpx": packed({"Contents/section0.xml": '<s xmlns:hp="u"><hp:p><hp:run><hp:t>문단</hp:t><hp:tbl><hp:p><hp:run><hp:t>칸</hp:t></hp:run></hp:p></hp:tbl></hp:run></hp:p></s>'}),
        "c.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 3, 4) + b"\x08\0\0\0\0") + chunk(b"tEXt", b"Software\0maker") + chunk(b"IEND", b""),
        "d.jpg": b"\xff\xd8\xff\xe1\x00\x08Exif\0\0" + b"\xff\xc0\x00\x0b\x08\x00\x05\x00\x06\x01\x01\x11\x00" + b"\xff\xda\x00\x02",
        "e.pdf": pdf(),
        "f.txt": "일\r\ntwo".encode("cp949"),
        "g.tsv": b"a\tb,c\n1\t2\n",
        "h.xlsx": b"PK\x03\x04 broken",
        "i.docx": packed({"word/document.xml": "<!DOCTYPE x><w/>"}),
        "j.docx": packed({"word/document.xml": "<w:p>"}),
        "k.docx": packed({"word/document.xml": b"<a>" + b" " * 40_000_000 + b"</a>"}),
        "l.txt": b"",
    }
    rows = spark.createDataFrame([*files.items(), ("m.txt", None)], "path string, content binary").repartition(3)
    got = {}
    for r in f.parse(rows).orderBy("path", "block_no").collect():
        got.setdefault(r["path"], []).append((r["kind"], r["part"], r["text"], r["hidden"], bool(r["error"])))
    cut = lambda name: [x[1:4] for x in got[name]]
    assert cut("a.docx") == [("body", "seen", None), ("body", "gone", "VANISH"), ("header", "head", None)]
    assert cut("b.hwpx") == [("body", "문단", None), ("table", "칸", None)]
    assert cut("c.png") == [("size", "3x4", None), ("metadata", "Software: maker", "METADATA")]
    assert cut("d.jpg") == [("metadata", "Exif, 6 bytes", "METADATA"), ("size", "6x5", None)]
    assert cut("e.pdf") == [("metadata", "Title: A (b)", "METADATA"), ("page", "Shown (text)", None), ("page", "split", None), ("page", "unseen", "INVISIBLE"), ("page", "white", "WHITE"), ("page", "Hi", None)]
    assert cut("f.txt") == [("body", "일", None), ("body", "two", None)] and cut("g.tsv") == [("row", "a | b,c", None), ("row", "1 | 2", None)]
    assert all(got[n][0][4] for n in ("h.xlsx", "i.docx", "j.docx", "k.docx", "m.txt")) and got["l.txt"] == [("text", None, None, None, False)]


def test_a_parser_of_ones_own(spark, monkeypatch):
    monkeypatch.setitem(f.PARSERS, "text", lambda content: iter([("own", content.decode().upper(), None)]))
    assert next(f.PARSERS["text"](b"x"))[1] == "X" and f.kind_of("a.bin", b"%PDF-1") == "pdf" and f.kind_of("a.bin", b"?") == "unknown"


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>one<br>two</p><!-- note --><p hidden>no</p>")
    got = [(r["text"], r["hidden"]) for r in f.documents(spark, str(tmp_path)).orderBy("block_no").collect()]
    assert got == [("one", None), ("two", None), ("note", "COMMENT"), ("no", "HIDDEN")]
