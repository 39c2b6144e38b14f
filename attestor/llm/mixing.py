"""Mixing sources to target weights by subset-sum budget fitting.

Sizes and their counts per source come first: one row per (source, size). Each source takes whole copies of itself
as often as its target holds, and a subset for the rest. The subset is fitted on the counts: every size gives its
proportional share, larger sizes first round the rest up, and a bounded-knapsack dynamic program over the sizes
still left hits what remains, to the word where the sizes allow it. Which documents of a size are taken is
decided by a seeded hash of the document, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
STOP = 2.0
CELLS = 1024


def water_fill(sizes: list[float], weights: list[float], total: float, stop: float) -> list[float]:
    """Shares `total` by weight; none above stop * its size, the excess reshared by weight among the others."""
    n = len(sizes)
    out, open_ = [0.0] * n, {i for i in range(n) if sizes[i] > 0}
    rest = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / w > stop * sizes[i]}
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / w
            break
        for i in full:
            out[i] = stop * sizes[i]
            rest -= out[i]
        open_ -= full
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size to take so that the sizes sum to `budget`, or near it. Over half of all, what stays out is fitted.

    counts: size -> documents. A proportional share of each size comes first; the dynamic program then runs over a
    remainder of a few mean sizes, with binary-split counts and one big integer per item as its row of reachable sums.
    """
    sizes = sorted((s for s in counts if s > 0), reverse=True)
    total = sum(s * counts[s] for s in sizes)
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return {s: counts[s] for s in sizes}
    if 2 * budget > total:
        out = fit(counts, total - budget)
        return {s: counts[s] - out.get(s, 0) for s in sizes if counts[s] > out.get(s, 0)}
    take = {s: counts[s] * budget // total for s in sizes}
    rest = budget - sum(s * n for s, n in take.items())
    # Rounding up leaves the remainder small before the program runs.
    margin = max(4 * total // max(1, sum(counts.values())), 64)
    for s in sizes:
        if rest > margin + s and take[s] < counts[s]:
            more = min(counts[s] - take[s], (rest - margin) // s, 1)
            take[s] += more
            rest -= more * s
    while rest > margin:
        moved = False
        for s in sizes:
            more = min(counts[s] - take[s], max(0, rest - margin // 2) // s)
            if more:
                take[s] += more
                rest -= more * s
                moved = True
        if not moved:
            break
    items = []
    for s in sizes:
        left, part = counts[s] - take[s], 1
        while left > 0 and s <= rest:
            n = min(part, left, rest // s)
            if not n:
                break
            items.append((s, n))
            left -= n
            part *= 2
    mask, rows, reach = (1 << (rest + 1)) - 1, [], 1
    for s, n in items:
        rows.append(reach)
        reach = (reach | reach << (s * n)) & mask
    at = reach.bit_length() - 1
    for (s, n), before in zip(reversed(items), reversed(rows)):
        if not before >> at & 1:
            take[s] += n
            at -= s * n
    return {s: n for s, n in take.items() if n}


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, stop: float = STOP, seed: int = 0, carry: tuple = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, and the columns to carry) for each row of docs(doc_id, text, source).

    size: words [^\\x20\\x09-\\x0D]+ of the text (null: 0). Sources in code point order, null last, have the weights,
    repeated; together they share `share` times all words; a target stops at `stop` times the size of its source and
    the excess is reshared. taken = copies * size, copies at most ceil(stop). Documents without words are taken not at
    all. Rows with a null doc_id take part like others; repeated rows count each. Other columns are ignored. An empty table gives no row.

    The driver sees one row per source and, one source after another in its own task, one row per distinct size.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    base = materialize(base, "sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    # Code points: UTF-8 bytes sort alike.
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in per_source]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), stop)
    plan = [(r["source"], s, float(t), int(t // s) if s else 0) for r, s, t in zip(per_source, sizes, targets)]
    spark = docs.sparkSession
    # One row per source: its name and four numbers.
    sources = spark.createDataFrame(plan, "source string, source_size long, target double, whole int")

    counts = base.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))

    def fitted(key, table):
        import pyarrow as pa

        budget = round(table["target"][0].as_py()) - table["whole"][0].as_py() * table["source_size"][0].as_py()
        got = fit(dict(zip(table["size"].to_pylist(), table["n"].to_pylist())), budget)
        return pa.table({"source": pa.array([key[0].as_py()] * len(got), pa.string()), "size": pa.array(list(got), pa.int64()), "quota": pa.array(list(got.values()), pa.int64())})

    joined = counts.join(sources, counts["source"].eqNullSafe(sources["source"])).select(counts["source"], "size", "n", "source_size", "target", "whole")
    quota = materialize(joined.groupBy("source").applyInArrow(fitted, "source string, size long, quota long"), "quota")

    # The quota of a (source, size) goes to the smallest hashes. Cells of the hash range are taken whole by their running
    # count; only the cell that holds the last of them is ranked row by row, so no large group is sorted in one task.
    cell = F.pmod(F.shiftrightunsigned("h", 40), F.lit(CELLS)).cast("int")
    cells = base.filter("size > 0").withColumn("cell", cell).groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    run = W.partitionBy("source", "size").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("n").over(run)).alias("c").join(quota.alias("q"), F.col("c.source").eqNullSafe(F.col("q.source")) & (F.col("c.size") == F.col("q.size")))
    cells = cells.select("c.source", "c.size", "c.cell", F.least("c.n", F.col("q.quota") - (F.col("c.upto") - F.col("c.n"))).alias("most"), "c.n").filter("most > 0")
    rows = base.withColumn("cell", cell).alias("b").join(cells.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.size") == F.col("c.size")) & (F.col("b.cell") == F.col("c.cell")), "left")
    rows = rows.select("b.doc_id", "b.source", "b.size", "b.h", "b.cell", F.coalesce("c.most", F.lit(0)).alias("most"), F.coalesce("c.n", F.lit(0)).alias("n"))
    split = (F.col("most") > 0) & (F.col("most") < F.col("n"))
    rank = F.row_number().over(W.partitionBy("source", "size", "cell").orderBy("h", "doc_id"))
    ranked = rows.filter(split).withColumn("extra", (rank <= F.col("most")).cast("int"))
    out = ranked.unionByName(rows.filter(~split).withColumn("extra", (F.col("most") > 0).cast("int")))
    out = out.alias("o").join(F.broadcast(sources).alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    out = out.select("doc_id", "h", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"))
    if not carry:
        return out.drop("h")
    # Equal rows are one here, so each row of the mix finds its columns once.
    rows = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.struct(*carry).alias("v")).groupBy("doc_id", "h").agg(F.first("v").alias("v"))
    found = out.alias("o").join(rows.alias("r"), F.col("o.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("o.h") == F.col("r.h")))
    return found.select(*(F.col(f"o.{c}") for c in out.columns if c != "h"), *(F.col(f"r.v.`{c}`").alias(c) for c in carry))
