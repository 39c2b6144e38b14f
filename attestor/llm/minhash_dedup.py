"""Near-duplicate documents: fast similarity sketching, banding, exact verification, connected groups.

Sketch: t bins are filled in up to 2t rounds. In round i < t every element is thrown into one random bin with a
value in [i, i + 1); in round t + j every element goes to bin j. The least value stays. So every coordinate fills,
and after few rounds for sets larger than t. Coordinates are cut into bands of 5 rows; texts that share a band are
candidates. The number of bands follows from the threshold: a pair at the threshold is missed with probability
below 1e-6, more similar pairs far less often.

Candidates in a bucket are not emitted as all pairs. Round one proposes to each member its best partner by sketch
agreement; large buckets are dealt to parts for that. After those links are verified on the full sets and merged, round
two looks, inside the task, at every pair of a bucket that still lies in different groups, verifies it on the full sets,
and emits links only. In a large bucket the members of its largest group are dealt to parts and all others are sent to
each part, so every two groups meet and no bucket is squared. Left out unverified are pairs whose sketches agree so
little, SIGMAS standard deviations below the threshold, that a pair at the threshold does so with probability below 1e-15.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, grouped, join_hot, materialize, maybe_in, slices, tune
from ._kernels import U, mix, pack, shingle_sets, text_bytes, unpack
from .components import connected_components

ROWS = 5
BLOCK = 512
SIGMAS = 8


def bands_for(threshold: float, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


def sketch(sets, t: int):
    """One row of t 64-bit values per non-empty set, by rounds of hashed bin placement; empty sets give no row."""
    import numpy as np

    kept = [i for i, s in enumerate(sets) if len(s)]
    top = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(kept), t), top, dtype=U)
    if not kept:
        return kept, out
    sizes = np.array([len(sets[i]) for i in kept])
    x, owner = np.concatenate([sets[i] for i in kept]), np.repeat(np.arange(len(kept)), sizes)
    flat = out.reshape(-1)
    for i in range(2 * t):
        with np.errstate(over="ignore"):
            h = mix(x + U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bins = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if i < t else np.full(len(x), i - t)
        with np.errstate(over="ignore"):
            value = (mix(h + U(1)) >> U(12)) | U(i << 52)
        np.minimum.at(flat, owner * t + bins, value)
        open_ = (out == top).any(axis=1)
        if not open_.any():
            break
        rest = open_[owner]
        x, owner = x[rest], owner[rest]
    return kept, out


def _first_pass(t: int, bands: int, lower: bool):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            sets, _ = shingle_sets(*text_bytes(batch.column(1)), lower=lower)
            kept, sk = sketch(sets, t)
            n = len(sets)
            keys, sigs = [None] * n, [None] * n
            lengths = np.zeros(n, np.int32)
            lengths[kept] = bands
            found = np.empty((len(kept), bands), dtype=np.int64)
            for b in range(bands):
                acc = np.full(len(kept), b + 1, dtype=U)
                for r in range(ROWS):
                    with np.errstate(over="ignore"):
                        acc = mix(acc * U(0x9FB21C651E98DF25) + sk[:, b * ROWS + r])
                found[:, b] = acc.view(np.int64)
            low = sk.astype(np.uint8)
            for j, i in enumerate(kept):
                keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sigs[i] = low[j].tobytes()
            band = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), band],
                names=["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return run


def _partners(comp, home, sig, i, least):
    """Rows of a block that may pair with row i: in another group, one of both at home here, alike enough by sketch."""
    import numpy as np

    j = np.flatnonzero((comp != comp[i]) & (home | home[i]))
    s = ((sig[j] == sig[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) if len(j) else np.zeros(0)
    return j[s >= least], s[s >= least]


def _columns(g, *names):
    import numpy as np

    n = g.num_rows
    return [np.frombuffer(b"".join(g.column(c).to_pylist()), np.uint8).reshape(n, -1) if c == "sig" else g.column(c).to_numpy() for c in names]


def _best(least: float):
    """For each row of a block its best partner, as a pair."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, g in grouped(batches, "block"):
            if g.num_rows < 2:
                continue
            ids, comp, home, sig = _columns(g, "id", "comp", "home", "sig")
            out = []
            for i in range(len(ids)):
                j, s = _partners(comp, home, sig, i, least)
                if len(j):
                    k = int(np.lexsort((ids[j], -s))[0])
                    out.append((ids[i], ids[j[k]], s[k]))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "s"])

    return run


def _mark(least: float):
    """The rows of each block that have any partner."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, g in grouped(batches, "block"):
            if g.num_rows < 2:
                continue
            comp, home, sig = _columns(g, "comp", "home", "sig")
            has = pa.array(np.array([len(_partners(comp, home, sig, i, least)[0]) > 0 for i in range(g.num_rows)]))
            yield from g.select(["block", "band", "id", "comp", "home"]).filter(has).combine_chunks().to_batches()

    return run


def _link(least: float, percent: int):
    """Verified links of each block between groups that no link of the block has joined yet.

    A pair is looked at in the first band that both share, and there only.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, g in grouped(batches, "block"):
            if g.num_rows < 2:
                continue
            ids, comp, home, sig = _columns(g, "id", "comp", "home", "sig")
            band = g.column("band")[0].as_py()
            bands = np.array(g.column("bands").to_pylist(), dtype=np.int64)
            sets = [unpack(x) for x in g.column("members").to_pylist()]
            pairs = []
            for i in range(len(ids)):
                j, s = _partners(comp, home, sig, i, least)
                later = ids[j] > ids[i]
                j, s = j[later], s[later]
                if len(j):
                    first = (bands[j] == bands[i]).argmax(axis=1) == band
                    pairs += [(-x, i, y) for x, y in zip(s[first].tolist(), j[first].tolist())]
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            for _, i, j in sorted(pairs):
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a == b:
                    continue
                x, y = len(sets[i]), len(sets[j])
                if 100 * min(x, y) < percent * max(x, y):
                    continue
                both = x + y - len(np.union1d(sets[i], sets[j]))
                if 100 * both >= percent * (x + y - both):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
            cols = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["a", "b"])

    return run


def _sets(lower: bool):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in slices(batches, "text"):
            sets, _ = shingle_sets(*text_bytes(batch.column(0)), lower=lower)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([pack(s) for s in sets], pa.binary())], names=["set_key", "members"])

    return run


def _verify(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, last, left = [], None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], unpack(x[i])
                right = unpack(y[i])
                both = len(left) + len(right) - len(np.union1d(left, right))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            ok = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Two documents are linked if 100 * |A & B| >= 100 * threshold * |A | B| over the sets of 5-word shingles.
    component_id is the smallest doc_id reachable over links. Null and empty texts and texts without words have an
    empty set and no link. A row with a null doc_id has a null component and is kept. Rows that share a doc_id count
    as one document, which is linked with what any of its texts is near to. Texts of any length are read whole; other
    columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    tune(spark)
    bands = bands_for(threshold)
    t = max(192, bands * ROWS)
    percent = round(100 * threshold)
    docs = docs.select("doc_id", "text")
    sk = materialize(docs.mapInArrow(_first_pass(t, bands, lower), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"), "sketch")

    # Equal sets are one class with an id of its own, that of this one table; its smallest doc_id stands for it.
    classes = sk.filter("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("sig", "bands"), "doc_id").alias("v"), F.count("*").alias("rows"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "doc_id", "rows", "v.*"), "classes")
    keyed = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = join_hot(keyed, materialize(shared.withColumn("m", F.col("n")), "shared"), "key")
    members = materialize(members.select("key", "band", "id", F.ceil(F.col("m") / BLOCK).cast("long").alias("parts")), "members")
    sigs = classes.select("id", "sig")
    wanted = materialize(members.select("id").distinct().join(classes.select("id", "set_key", "doc_id"), "id"), "wanted")
    sets = maybe_in(docs, wanted, "doc_id").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(_sets(lower), "set_key binary, members binary")
    sets = materialize(sets.join(wanted.select("id", "set_key"), "set_key").groupBy("id").agg(F.first("members").alias("members")), "sets")

    least = threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / t)
    own = F.pmod(F.xxhash64("id", "key"), F.col("parts"))
    sorted_blocks = lambda m: m.repartition("block").sortWithinPartitions("block", "id")

    first = members.select("id", F.col("id").alias("comp"), F.lit(True).alias("home"), F.xxhash64("key", own).alias("block"))
    best = sorted_blocks(first.join(sigs, "id").select("block", "id", "comp", "home", "sig")).mapInArrow(_best(least), "a long, b long, s double")
    best = best.groupBy("a").agg(F.max_by("b", F.struct("s", -F.col("b"))).alias("b"))
    pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    links = materialize(both.mapInArrow(_verify(percent), "a long, b long"), "links")
    # The texts of one doc_id are linked by it.
    texts = sk.filter("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x < y")
    texts = sk.join(materialize(texts, "repeated"), "doc_id").filter("set_key > x").select("x", F.col("set_key").alias("y")).distinct()
    key = lambda a, b: classes.select(F.col("id").alias(a), F.col("set_key").alias(b))
    links = links.unionByName(materialize(texts.join(key("a", "x"), "x").join(key("b", "y"), "y").select("a", "b"), "links"))
    comp = materialize(connected_components(links), "comp")

    # The rest: all pairs of a bucket that lie in different groups, verified where they meet; only links leave the task.
    m = members.join(comp.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    groups = m.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    m = join_hot(m, materialize(groups.filter("groups > 1"), "groups"), "key")
    parts = F.when(F.col("comp") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    m = m.withColumn("part", F.explode(parts)).withColumn("home", F.col("part") == own).withColumn("block", F.xxhash64("key", "part"))
    marked = sorted_blocks(m.join(sigs, "id").select("block", "band", "id", "comp", "home", "sig")).mapInArrow(_mark(least), "block long, band int, id long, comp long, home boolean")
    full = materialize(marked, "marked").join(classes.select("id", "sig", "bands"), "id").join(sets, "id")
    second = materialize(sorted_blocks(full.select("block", "band", "id", "comp", "home", "sig", "bands", "members")).mapInArrow(_link(least, percent), "a long, b long"), "links")
    if not second.isEmpty():
        comp = materialize(connected_components(links.unionByName(second)), "comp")
    discard(sets)

    # The smallest doc_id of each group, by class; a doc_id without a class stands for itself.
    roots = classes.select("id", "set_key", "doc_id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    roots = materialize(roots.select("component", "set_key", "doc_id"), "roots")
    least_id = roots.groupBy("component").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")).filter("n > 1")
    linked = join_hot(roots.select("component", "set_key"), materialize(least_id, "least"), "component").select("set_key", "root")
    known = classes.select("set_key", F.col("doc_id").alias("least_doc"), F.col("rows").alias("n")).join(linked, "set_key", "left")
    known = materialize(known.select("set_key", F.coalesce("root", "least_doc").alias("component_id"), "n"), "known")
    rows = sk.select("doc_id", "n_shingles", "set_key")
    found = F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()
    out = join_hot(rows.filter(found), known, "set_key").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.filter(~found).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    # A doc_id that has several rows may have one without words, or one whose set another doc_id has too.
    repeated = out.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("own")).filter("rows > 1 and doc_id is not null").select("doc_id", "own")
    out = out.join(repeated, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
