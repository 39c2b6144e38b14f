"""Sources and streams on small files."""

import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest

from attestor.sources import readers
from attestor.streaming import ingest


def test_case_table_aliases(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('Case_Number,판결요지,Other\n2020ab1,"x, y",z\n,no number,z\n', encoding="utf-8")
    rows = readers.case_table(spark, str(p)).collect()
    assert [(r["number"], r["holding"], r["title"], r["rejected"]) for r in rows] == [("2020ab1", "x, y", None, False), (None, "no number", None, True)]


def test_law_mirror_and_jsonl(spark, tmp_path):
    p = tmp_path / "laws.json"
    p.write_text(json.dumps([{"law_name": "L", "article": "1", "text": "t", "effective_from": "2000-01-01", "effective_to": None}, {"law_name": "L", "effective_from": "2000-02-31"}]))
    rows = readers.law_mirror(spark, str(p)).collect()
    assert [r["effective_from"] for r in rows] == [dt.date(2000, 1, 1), None]
    j = tmp_path / "x.jsonl"
    j.write_text('{"a": 1}\n{"a": "no"}\n')
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, str(j), "a int").collect()


def test_inventory_and_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.weird").write_bytes(b"x")
    inv = {r["path"].rsplit("/", 1)[1]: r for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert inv["a.txt"]["kind"] == "text" and inv["b.weird"]["kind"] == "unknown" and inv["b.weird"]["sha256"] == hashlib.sha256(b"x").hexdigest()
    assert {r["text"] for r in readers.text_documents(spark, str(tmp_path)).collect()} == {"one\ntwo", "x"}


def test_word_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>seen</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    assert [r["text"] for r in readers.word_documents(spark, str(tmp_path)).collect()] == ["seen"]


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(1, "a"), (2 + k, "b")], "id int, v string").coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(ingest.file_stream(spark, src, "id int, v string"), out, str(tmp_path / "cp"), "id").awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_windows_and_chain(spark, tmp_path):
    src = str(tmp_path / "ev")
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(hours=8 * i), "k", f"b{i}") for i in range(6)]
    spark.createDataFrame(rows, "n int, ts timestamp, k string, body string").coalesce(1).write.parquet(src)
    stream = lambda: ingest.file_stream(spark, src, "n int, ts timestamp, k string, body string")
    got = run(ingest.windowed(stream(), "ts", "k"), "w1", "complete")
    assert sorted(r["n"] for r in got) == [3, 3]
    assert sum(r["n"] for r in run(ingest.sessions(stream(), "ts", "k", gap="9 hours"), "w2", "complete")) == 6
    head, want = "", []
    for i in range(6):
        head = hashlib.sha256((head + f"b{i}").encode()).hexdigest()
        want.append(head)
    links = {r["n"]: r["link"] for r in run(ingest.chained(stream(), "k", "n", "body"), "w3", "append")}
    assert [links[i] for i in range(6)] == want
