"""Sources: files to documents and rows. Formats are routed by extension; parsing of one file stays within its row."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Header names that stand for each column of a case table.
HEADERS = {
    "number": ("number", "case number", "case no", "사건번호"), "title": ("title", "name", "사건명"), "court": ("court", "법원"), "decided": ("decided", "date", "decision date", "선고일"),
    "issue": ("issue", "issues", "쟁점"), "holding": ("holding", "ruling", "판결요지"), "facts": ("facts", "사실관계"),
}
KINDS = {"txt": "text", "md": "text", "html": "html", "htm": "html", "csv": "table", "tsv": "table", "json": "json", "jsonl": "json", "docx": "ooxml", "xlsx": "ooxml", "pdf": "pdf", "png": "image", "jpg": "image"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256, kind) of each file; kind `unknown` is kept, so nothing vanishes unseen."""
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.get(F.array(kinds[extension(F.col("path"))]), F.lit(0)), F.lit("unknown")).alias("kind"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, read whole; invalid UTF-8 becomes replacement characters."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def case_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with aliased headers as the columns of HEADERS; unknown columns are dropped, missing ones null, rows without a number quarantined in `rejected`."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    by = {alias: name for name, aliases in HEADERS.items() for alias in aliases}
    have: dict[str, str] = {}
    for c in raw.columns:
        have.setdefault(by.get(c.strip().lower().replace("_", " "), ""), c)
    cols = [(F.trim(F.col(f"`{have[n]}`")) if n in have else F.lit(None).cast("string")).alias(n) for n in HEADERS]
    return raw.select(*cols).withColumn("rejected", F.coalesce(F.col("number"), F.lit("")) == "")


def law_mirror(spark: SparkSession, path: str) -> DataFrame:
    """Law versions from a JSON array: (law_name, article, text, effective_from, effective_to) with dates; bad dates are null."""
    schema = "law_name string, article string, text string, effective_from string, effective_to string"
    j = spark.read.schema(schema).json(path, multiLine=True)
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date").alias(c)
    return j.select("law_name", "article", "text", day("effective_from"), day("effective_to"))


def strict_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines that must fit the schema: a line that does not fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ooxml_text(content: bytes) -> list[str]:
    """Paragraphs of a Word file, without deleted or hidden runs; [] for anything else. Size and entity bombs are refused."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            info = z.getinfo("word/document.xml")
            if info.file_size > 200_000_000 or info.file_size > 200 * max(info.compress_size, 1):
                return []
            body = z.read(info)
    except (zipfile.BadZipFile, KeyError):
        return []
    if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
        return []
    out = []
    for p in ElementTree.fromstring(body).iter(f"{w}p"):
        runs = [r for r in p.iter(f"{w}r") if r.find(f"{w}rPr/{w}vanish") is None]
        out.append("".join(t.text or "" for r in runs for t in r.findall(f"{w}t")))
    return out


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_no, text) of Word files: paragraphs as blocks."""

    @F.pandas_udf("array<string>")
    def parse(content: pd.Series) -> pd.Series:
        return content.map(lambda c: ooxml_text(bytes(c)))

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.posexplode(parse("content")).alias("block_no", "text"))
