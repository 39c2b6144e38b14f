"""Shared pieces of the query modules: table readers and SQL fragments of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries and their SQL, filled by decorators."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None, name: str | None = None):
        def take(f):
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return take


BLOCKS = "blocks AS (SELECT doc_id, unnest(range(len(p)))::INT AS block_no, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
TOKENS = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents)"
SENTENCES = r"""sentences AS (SELECT doc_id, unnest(range(len(p)))::INT AS pos, unnest(p) AS sentence FROM (
  SELECT doc_id, [trim(replace(s, chr(10), ' ')) FOR s IN string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)) IF trim(replace(s, chr(10), ' ')) <> ''] AS p FROM documents))"""
EVENT_K = "json_extract_string(props, '$.k')::INT"
