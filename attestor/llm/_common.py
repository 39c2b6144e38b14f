"""Shared helpers: tables written in the shared folder, and Arrow batches cut to a bounded size."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 8 << 20
#: Rows of a key from which its one row is broadcast (if those are few), not shuffled.
HOT = 1000
#: Words of 64 bits of the filter of maybe_in(): its size is fixed whatever the data.
FILTER_WORDS = 1 << 18
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where that is unset (tests), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        folder = tempfile.mkdtemp(prefix="attestor-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bounds the bytes of one Arrow batch, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestor_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    path, spark = getattr(df, "_attestor_path", None), df.sparkSession
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Marks df for broadcast only if it was counted and holds no more than `rows` rows of a few bytes; else it is shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df


def _bits(rows: DataFrame, key: str) -> DataFrame:
    """With the word and the bit of a filter that `key` sets."""
    from pyspark.sql import functions as F

    rows = rows.withColumn("h", F.xxhash64(key))
    return rows.withColumn("word", F.pmod(F.shiftrightunsigned("h", 6), F.lit(FILTER_WORDS))).withColumn("bit", F.expr("shiftleft(1L, cast(h & 63 as int))")).drop("h")


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted, and perhaps some others, by a filter of fixed size that is broadcast."""
    from pyspark.sql import functions as F

    words = _bits(wanted.select(key), key).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = _bits(rows, key).join(F.broadcast(words), "word")
    return rows.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


def join_hot(many: DataFrame, once: DataFrame, key: str) -> DataFrame:
    """many joined with once(key, ..., n) by key, where n says how many rows `many` has of the key: hot keys are not shuffled."""
    from pyspark.sql import functions as F

    hot = once.filter(F.col("n") >= HOT).drop("n")
    if hot.isEmpty():
        return many.join(once.drop("n"), key)
    hot = materialize(hot, "hot")
    rest = many.join(broadcast_if_small(hot.select(key)), key, "left_anti").join(once.filter(F.col("n") < HOT).drop("n"), key)
    return many.join(broadcast_if_small(hot), key).unionByName(rest)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of finished steps now: Spark drops them once the driver's garbage is collected."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def _pack(batches):
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, "text"):
        z = [None if t is None else squeeze.compress(t.encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts compressed before they are shuffled; about half of what the shuffle's own codec leaves."""
    return docs.select("doc_id", "text").mapInArrow(_pack, "doc_id long, z binary")


def unpacked(batches, column: str = "z", limit: int = SLICE_BYTES):
    """(rows of the batch, their texts) in runs that hold about `limit` bytes of text; a null is empty."""
    import zstandard

    stretch = zstandard.ZstdDecompressor()
    for batch in batches:
        begin, size, texts = 0, 0, []
        for i, z in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
            text = stretch.decompress(z) if z else b""
            texts.append(text)
            size += len(text)
            if size > limit:
                yield batch.slice(begin, i + 1 - begin), texts
                begin, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(begin), texts


def hold() -> None:
    """Memory freed within a task stays with it, up to 64 MB: pages asked for again at every step cost more than the steps."""
    import ctypes

    adjust = getattr(ctypes.CDLL(None), "mallopt", None)
    if adjust:
        # M_TRIM_THRESHOLD and M_MMAP_THRESHOLD of malloc.h.
        adjust(-1, 64 << 20)
        adjust(-3, 4 << 20)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: idle workers of earlier stages stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Cuts record batches into runs of rows whose texts hold about `limit` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
            yield batch
            continue
        wide = pa.types.is_large_string(col.type)
        import numpy as np

        ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def grouped(batches, key: str):
    """Yields (key value, table) for runs of equal keys over batches that arrive sorted by key."""
    import numpy as np

    rest, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for b, e in zip(cuts, cuts[1:]):
            if rest and keys[b] != at:
                yield at, pa.Table.from_batches(rest)
                rest = []
            at = keys[b]
            rest.append(batch.slice(b, e - b))
    if rest:
        yield at, pa.Table.from_batches(rest)
