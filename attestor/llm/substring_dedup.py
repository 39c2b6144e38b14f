"""Substring dedup over a log-structured fingerprint index.

A window is SPAN consecutive words of one document. Each window is represented by its anchor: the least hash of the
GRAM-word grams inside it. Consecutive windows with one anchor form a run; its context is the hash of all its words.
Equal windows have equal anchors, so the index holds one row per distinct (anchor, context): about one per eighteen
words, and none for further copies.

The index is a list of immutable runs, each bucketed and sorted by anchor. A new batch is merge-joined with the runs:
- a run whose (anchor, context) an earlier document has is removed whole;
- where only the anchor agrees, the windows of one document per context are hashed from its text and compared, so
  every match is confirmed by the window itself (anchor and window hash together: 128 bits).
Then the batch becomes a run of its own; FANOUT runs are compacted into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialize, packed, release, shared_dir, slices, tune, unpacked
from ._kernels import U, mix, span_hashes, text_bytes, windows, word_spans, _powers

SPAN = 50
GRAM = 16
FANOUT = 2
RUN = "anchor long, context long, owner long, first int, last int, sha string"


def sliding_min(x, width: int):
    """Minimum of each `width` consecutive values, by doubling."""
    import numpy as np

    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchor_runs(tokens, counts, span: int, gram: int):
    """(document, anchor, context, first window, last window) of each run of windows with one anchor."""
    import numpy as np

    none = np.zeros(0, np.int64)
    h, _, gs = windows(tokens, counts, gram, seed=7)
    width = span - gram + 1
    if len(h) < width:
        return none, none, none, none, none
    low = sliding_min(h, width)
    n_windows = np.maximum(0, np.diff(counts) - span + 1)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    ws = np.concatenate([[0], np.cumsum(n_windows)])
    if not len(doc):
        return none, none, none, none, none
    at = np.arange(len(doc)) - ws[doc]
    a = low[gs[doc] + at]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    b = np.flatnonzero(new)
    e = np.append(b[1:], len(a)) - 1
    p, q = _powers(len(tokens) + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(len(tokens) + 1, U)
        np.cumsum(mix(tokens + U(11)) * p[: len(tokens)], out=s[1:])
        left, right = counts[doc[b]] + at[b], counts[doc[b]] + at[e] + span
        c = mix((s[right] - s[left]) * q[left] + (right - left).astype(U) * U(0x9E3779B97F4A7C15))
    return doc[b], a[b].view(np.int64), c.view(np.int64), at[b], at[e]


def _scan(span: int, gram: int):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            buf, off = text_bytes(batch.column(1))
            s, e, counts = word_spans(buf, off)
            doc, a, c, first, last = anchor_runs(span_hashes(buf, s, e), counts, span, gram)
            data = buf.tobytes()
            sha = [hashlib.sha256(b" ".join(data[off[i] : off[i + 1]].split())).hexdigest() for i in range(len(off) - 1)]
            ends = pa.array(np.searchsorted(doc, np.arange(len(off))).astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(a), pa.array(c), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["anchor", "context", "first", "last"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(counts)), pa.array(sha), pa.ListArray.from_arrays(ends, runs)], names=["doc_id", "n_words", "sha", "runs"])

    return run


def scan(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, sha of the words joined by one space, runs) per document."""
    return docs.select("doc_id", "text").mapInArrow(_scan(span, gram), "doc_id long, n_words long, sha string, runs array<struct<anchor:long,context:long,first:int,last:int>>")


def _window_rows(span: int):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch, texts in unpacked(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            buf, off = text_bytes(pa.array([t.decode() for t in texts], pa.large_string()))
            s, e, counts = word_spans(buf, off)
            h, _, ws = windows(span_hashes(buf, s, e), counts, span, seed=23)
            data, h = buf.tobytes(), h.view(np.int64)
            ids, fresh, sha, runs = (col[k].to_pylist() for k in ("doc_id", "fresh", "sha", "runs"))
            out = [[], [], [], [], [], []]
            for i in range(len(ids)):
                if hashlib.sha256(b" ".join(data[off[i] : off[i + 1]].split())).hexdigest() != sha[i]:
                    continue
                for r in runs[i]:
                    k = r["last"] - r["first"] + 1
                    for o, v in zip(out, (np.full(k, r["anchor"]), h[ws[i] + r["first"] : ws[i] + r["last"] + 1], np.full(k, ids[i]), np.arange(r["first"], r["last"] + 1, dtype=np.int32), np.full(k, fresh[i]), np.full(k, i))):
                        o.append(v)
            if out[0]:
                cols = [np.concatenate(o) for o in out]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols[:5]), pa.array(sha).take(pa.array(cols[5]))], names=["anchor", "h", "doc_id", "at", "fresh", "sha"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of (anchor, context, owner, first, last, sha); owner: the smallest doc_id that has it."""

    def __init__(self, spark: SparkSession, span: int = SPAN, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.span, self.gram, self.fanout = spark, span, gram, fanout
        self.runs: list[str] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> None:
        name = f"attestor_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{shared_dir(self.spark)}/{name}").format("parquet").saveAsTable(name)
        self.runs.append(name)

    @staticmethod
    def _owners(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("anchor", "context").agg(F.min(F.struct("owner", "first", "last", "sha")).alias("v"))
        return best.select("anchor", "context", "v.*")

    def history(self) -> DataFrame | None:
        out = None
        for name in self.runs:
            out = self.spark.table(name) if out is None else out.unionByName(self.spark.table(name))
        return out

    def compact(self) -> None:
        """Merges all runs into one that holds each (anchor, context) once."""
        old = list(self.runs)
        self._write(self._owners(self.history()))
        self.runs = self.runs[len(old) :]
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        for name in self.runs:
            self._drop(name)
        self.runs = []

    def add(self, scanned: DataFrame, docs: DataFrame) -> DataFrame:
        """Judges a batch (rows of scan()) against the index and itself, then adds it as a run.

        docs(doc_id, text) must hold the batch and what the index was built from. Returns the spans of words to
        remove: (doc_id, sha, start, stop), stop exclusive, as a table of its own.
        """
        rows = scanned.filter("doc_id is not null").select("doc_id", "sha", F.explode("runs").alias("r")).select("doc_id", "sha", "r.*")
        fresh = self._owners(rows.select("anchor", "context", F.col("doc_id").alias("owner"), "first", "last", "sha"))
        fresh = materialize(fresh, "fresh")
        history = self.history()
        known = fresh.withColumn("fresh", F.lit(True))
        if history is not None:
            met = history.join(fresh.select("anchor").distinct(), "anchor", "left_semi").withColumn("fresh", F.lit(False))
            known = known.unionByName(met.select(*known.columns))
        owners = known.groupBy("anchor", "context").agg(F.min(F.struct("owner", "first", "last", "sha", "fresh")).alias("v")).select("anchor", "context", "v.*")
        owners = materialize(owners, "owners")
        whole = rows.join(owners.select("anchor", "context", "owner"), ["anchor", "context"]).filter("owner < doc_id")
        whole = whole.select("doc_id", "sha", F.col("first").alias("start"), (F.col("last") + self.span).alias("stop"))

        torn = owners.groupBy("anchor").agg(F.count("*").alias("n"), F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max("fresh").alias("new")).filter("n > 1 and lo < hi and new")
        parts = owners.join(torn.select("anchor"), "anchor", "left_semi")
        parts = parts.groupBy(F.col("owner").alias("doc_id"), "sha").agg(F.max("fresh").alias("fresh"), F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
        wins = packed(docs).join(parts, "doc_id").select("doc_id", "z", "sha", "fresh", "runs")
        wins = materialize(wins.mapInArrow(_window_rows(self.span), "anchor long, h long, doc_id long, at int, fresh boolean, sha string"), "windows")
        first = wins.groupBy("anchor", "h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor", "h", "lo")
        single = wins.filter("fresh").join(first, ["anchor", "h"]).filter("lo < doc_id").select("doc_id", "sha", F.col("at").alias("start"), (F.col("at") + self.span).alias("stop"))
        found = materialize(whole.unionByName(single), "spans")
        discard(wins)
        discard(owners)
        self._write(fresh)
        discard(fresh)
        if len(self.runs) >= self.fanout:
            self.compact()
        return found


def _apply(keep_text: bool):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch, texts in unpacked(batches):
            ids, shas, spans = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for d, text, sha, cut in zip(ids, texts, shas, spans):
                words = text.split()
                if hashlib.sha256(b" ".join(words)).hexdigest() != sha:
                    continue
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, [c["start"] for c in cut], 1)
                np.add.at(mark, [c["stop"] for c in cut], -1)
                gone = np.cumsum(mark)[: len(words)] > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g)
                out.append((d, sha, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "sha", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, batches: int = 2, span: int = SPAN, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs(doc_id, text); with keep_text also kept (null: the text as it was).

    A word goes if a window of `span` words covers it whose word sequence also starts in a document with a smaller
    doc_id. Words are [^\\x20\\x09-\\x0D]+, unchanged. Documents enter the index in `batches` batches by doc_id.
    Null texts have no words; a document under `span` words loses none. A row with a null doc_id loses none and is no
    source. Repeated rows with one doc_id are judged each, and none is removed for the other. Other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    scanned = materialize(scan(docs, span, gram), "scan")
    edges = [None, *(scanned.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []), None]
    index, found = FingerprintIndex(spark, span, gram), None
    for lo, hi in zip(edges, edges[1:]):
        within = lambda df: df.filter((F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi))
        spans = index.add(within(scanned), docs if hi is None else docs.filter(F.col("doc_id") <= hi))
        found = spans if found is None else found.unionByName(spans)
        release(spark)
    index.close()
    cuts = found.distinct().groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "stop")).alias("cut"))
    done = packed(docs).join(cuts, "doc_id").select("doc_id", "z", "sha", "cut").mapInArrow(_apply(keep_text), "doc_id long, sha string, n_removed long, kept_sha256 string, kept string")
    done = (done if keep_text else done.drop("kept")).dropDuplicates(["doc_id", "sha"])
    out = scanned.select("doc_id", "n_words", "sha").join(done, ["doc_id", "sha"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if keep_text else []))
