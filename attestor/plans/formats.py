"""Queries of file formats and streams: files are made from tables and read back; streams read the tables as files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from attestor.sources import formats
from attestor.streaming import ingest

from ._base import Registry, table
from .evaluation import CHAIN

R = Registry()


# A workbook per region: its nations, every third row hidden, and a hidden sheet.
@R.add("""WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, 'nations' AS part, n_nationkey || ' | =' || n_name || ' & "<' AS text, CASE WHEN i % 3 = 0 THEN 'HIDDEN_ROW' END AS hidden FROM n UNION ALL SELECT n_regionkey, 'notes', 'count | ' || count(*), 'HIDDEN_SHEET' FROM n GROUP BY 1""")
def workbook_round_trip(spark, d):
    @F.pandas_udf("binary")
    def write(rows: pd.Series) -> pd.Series:
        def one(cells):
            lines = [[str(c["n_nationkey"]), f'={c["n_name"]} & "<'] for c in cells]
            return formats.workbook_bytes([("nations", lines, {i for i in range(1, len(lines) + 1) if i % 3 == 0}), ("notes", [["count", str(len(lines))]], set())], hidden={"notes"})

        return rows.map(one)

    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    files = n.select(F.concat(F.col("n_regionkey").cast("string"), F.lit("/nations.xlsx")).alias("path"), write("rows").alias("content"))
    return formats.parse(files).select(F.split("path", "/")[0].cast(n.schema["n_regionkey"].dataType).alias("n_regionkey"), "part", "text", "hidden")


@R.add("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' ELSE 'unknown' END AS kind, CASE WHEN doc_id % 4 = 3 THEN 0 WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END AS n_blocks, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS n_hidden, doc_id % 4 = 3 AS failed FROM documents""")
def parser_dispatch(spark, d):
    body = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('line ', doc_id) WHEN 1 THEN concat('<p>seen ', doc_id, '</p><div style=\"display: none\">not seen</div><script>x</script>') WHEN 2 THEN concat('a,\"b, c\",', doc_id) ELSE 'PK' END")
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".txt", ".html", ".csv", ".bin"))), (F.col("doc_id") % 4 + 1).cast("int")))
    p = formats.parse(table(spark, d, "documents").select(name.alias("path"), body.cast("binary").alias("content")))
    g = p.groupBy("path", "kind").agg(F.count("text").cast("int").alias("n_blocks"), F.count("hidden").cast("int").alias("n_hidden"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return g.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "kind", "n_blocks", "n_hidden", "failed")


def _stored(df, spark, mode, name):
    """Runs a stream to its end into a table of the shared folder and reads that."""
    folder = ingest.shared_folder(spark, name)
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True)
    q.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}") if mode == "append" else b.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def _events(spark, d):
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    return ingest.file_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)


@R.add("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    e = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _stored(ingest.windowed(e, "ts", "event_type"), spark, "complete", "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@R.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    e = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = _stored(ingest.sessions(e, "ts", "user_id", gap="6 hours"), spark, "complete", "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@R.add(f"WITH RECURSIVE {CHAIN} SELECT user_id, event_id, good AS link FROM c")
def stream_chain(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("body"))
    return _stored(ingest.chained(e, "user_id", "event_id", "body"), spark, "append", "chain").select("user_id", "event_id", "link")


@R.add("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_ingest(spark, d):
    folder = ingest.shared_folder(spark, "ingest")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(_events(spark, d), f"{folder}/rows", f"{folder}/cursor", "event_id").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
