"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every 5-word shingle hash below a fixed fraction of the hash range is retained. The fraction is the same for all
documents, so sketches merge by union and intersect without bias, however unequal the documents: the share of the
smaller sketch that lies in the other estimates containment.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import grouped, slices, tune
from ._kernels import U, shingle_sets, text_bytes

SCALE = 4
HEAD = 32


def retained(values, scale: int):
    """The hashes of a sorted set that lie below 2**64 / scale."""
    import numpy as np

    return values[: np.searchsorted(values, U((1 << 64) // scale))]


def _text(values) -> str:
    import base64

    return base64.b64encode(values.astype(">u8").view("u1").reshape(-1, 8)[:, 2:].tobytes()).decode()


def encode(values, digest: str) -> str:
    """Sketch as text: a digest of the whole text, then the retained hashes (their upper 48 bits), ascending, in base64."""
    return digest[:HEAD] + ":" + _text(values >> U(16))


def decode(text: str):
    """(digest, retained hashes) of a fingerprint."""
    import base64

    import numpy as np

    head, _, body = text.partition(":")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw[:, ::-1]
    return head, out.view("<u8").ravel()


def merge(one: str, two: str) -> str:
    """The fingerprint of both documents' shingles together; its digest part is empty."""
    import numpy as np

    return ":" + _text(np.union1d(decode(one)[1], decode(two)[1]))


def likeness(x, y, same: bool) -> float:
    """Containment of the smaller retained set in the larger; equal texts 1; an empty sketch 0 otherwise."""
    import numpy as np

    if same:
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / min(len(x), len(y))


def _run(scale: int):
    def work(batches):
        import hashlib

        import pyarrow as pa

        def emit(rows):
            """rows: (doc_id, text, text of the next document, whether to give a row)."""
            texts, edited, nexts = [r[1] for r in rows], [], [r[2] for r in rows]
            for _, text, after, _ in rows:
                k = len(text) // 2
                edited.append(text[: len(text) - k] + after[:k])
            n = len(rows)
            # A row's next text is mostly the next row's own: it is hashed once.
            own = {id(t): i for i, t in enumerate(texts)}
            extra = [t for t in nexts if id(t) not in own]
            place = {id(t): 2 * n + i for i, t in enumerate(extra)}
            everything = texts + edited + extra
            sets = [retained(s, scale) for s in shingle_sets(*text_bytes(pa.array(everything, pa.large_string())))[0]]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in everything]
            out = []
            for i, (doc, text, after, _) in enumerate(rows):
                j = own.get(id(after), place.get(id(after)))
                out.append((doc, len(text), sha[n + i], encode(sets[i], sha[i]), encode(sets[n + i], sha[n + i]), likeness(sets[i], sets[n + i], sha[i] == sha[n + i]), likeness(sets[i], sets[j], sha[i] == sha[j]), len(sets[i])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_retained"])

        pending, size, prev = [], 0, None
        for batch in slices(batches, "text"):
            for block, doc, text, guest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "doc_id", "text", "guest"))):
                if prev is not None and prev[0] == block:
                    pending.append((prev[1], prev[2], text, True))
                    size += len(prev[2])
                    if size > 1 << 20:
                        yield emit(pending)
                        pending, size = [], 0
                prev = None if guest else (block, doc, text)
        if pending:
            yield emit(pending)

    return work


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_retained) per row of docs(doc_id, text).

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in order of (doc_id, text); after the last comes the first, and a single document is its own next. Null texts are
    empty. Rows with a null doc_id come after all others. Of an empty sketch the likeness is 1 to an equal text,
    else 0. Other columns are ignored; an empty table gives no row.

    Documents are dealt to blocks of consecutive ids. The driver sees one id per block; the first document of each
    block is also sent, as a guest, to the block before. So texts move once and no task sorts all.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    last = (1 << 63) - 1
    rank = docs.select(F.coalesce("doc_id", F.lit(last)).alias("at"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rank.distinct().repartitionByRange(4 * parts, "at").groupBy(F.spark_partition_id().alias("p")).agg(F.min("at").alias("at")).select("at").collect()
    heads = sorted(r["at"] for r in cuts)
    if not heads:
        heads = [0]
    # Each head is the smallest id of its block; the table of heads has 4 rows a partition and is broadcast.
    table = spark.createDataFrame([(h, i, (i - 1) % len(heads)) for i, h in enumerate(heads)], "head long, block int, before int")
    rows = docs.withColumn("at", F.coalesce("doc_id", F.lit(last)))
    rows = rows.withColumn("block", _block(heads)(F.col("at")))
    # Of several rows with the head's id only the least text is the next one of the block before.
    first = rows.join(F.broadcast(table.select(F.col("head").alias("at"), "before")), "at").groupBy("at", "before").agg(F.min("text").alias("text"))
    guests = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(last).alias("at"), F.col("before").alias("block"), F.lit(True).alias("guest"))
    all_rows = rows.select("doc_id", "text", "at", "block", F.lit(False).alias("guest")).unionByName(guests)
    dealt = all_rows.repartition(parts, "block").sortWithinPartitions("block", "guest", "at", "text")
    return dealt.select("block", "doc_id", "text", "guest").mapInArrow(_run(scale), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_retained long")


def _block(heads: list[int]):
    """Index of the last head that is at most the id."""
    import numpy as np

    edges = np.array(heads, dtype=np.int64)

    @F.pandas_udf("int")
    def find(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(), side="right") - 1)

    return find
