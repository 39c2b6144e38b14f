"""Benchmark decontamination by seeds of whole words, in DataFrame expressions only.

An overlap has at least four fifths equal words, so its different words cut it into runs of equal ones, the longest of
which has a length that is known from the size of the item: 4 words, or 2 or 3 for some short items. The hash of each run
of that length in the corpus is joined with those of the benchmark, so no overlap is missed. A hit fixes an alignment of
document and item; it is verified by the words themselves: of all stretches with at least four fifths equal words, the one
with the most equal words. No text is shuffled: a hit is verified where the document is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the words of a seed at most.
SEED = 4
#: Words of a document whose hits may wait in memory at once.
PIECE = 64
MIN_WORDS = 13
SHORTEST = 5
#: Seeds of the benchmark that are broadcast at most, about 100 MB; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000

WORDS = r"split(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+')"


def needed(size: int, min_words: int) -> int:
    """Equal words that an overlap with an item of `size` words must have."""
    return min(min_words, (4 * size + 4) // 5)


def seed_length(size: int, min_words: int) -> int:
    """Words, SEED at most, that any overlap with an item of `size` words holds in one run of equal words."""
    least = SEED
    # From 13 equal words on there is always a run of 4.
    for equal in range(needed(size, min_words), min(size, 13) + 1):
        different = min(equal // 4, size - equal)
        least = min(least, -(-equal // (different + 1)))
    return max(least, 1)


def _seeds(words: DataFrame, lengths, keep: list[str], own=None, begin=0, end=1 << 30) -> DataFrame:
    """A row (keep..., at, h) for each position and seed length whose words all lie inside `words`, from begin to before end; with own, of that length only."""
    least = min(lengths)
    at = words.select(*keep, "words", F.explode(F.when(F.size("words") >= F.lit(begin) + least, F.sequence(F.lit(begin), F.least(F.size("words") - least, F.lit(end) - 1)))).alias("at"))
    inside = lambda n: F.col("at") + (n - 1) < F.size("words")
    hashes = [F.when(inside(n) if own is None else inside(n) & (own == n), F.xxhash64(F.lit(n), *(F.get("words", F.col("at") + o) for o in range(n)))) for n in lengths]
    return at.select(*keep, "words", "at", F.explode(F.array(*hashes)).alias("h")).filter("h is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_key, doc_id, item_id, start, stop, equal) for each verified overlap of docs(doc_id, text) and benchmark(item_id, text).

    start, stop: the words of the document that it covers; equal: how many of them agree. An overlap counts with
    min_words equal words, or four fifths of a shorter item. Items under 5 words are ignored.
    """
    items = benchmark.select("item_id", F.expr(WORDS).alias("w")).select("item_id", F.filter("w", lambda x: x != "").alias("words"))
    items = items.filter(F.size("words") >= SHORTEST)
    sizes = [r[0] for r in items.select(F.size("words")).distinct().collect()]
    length = {n: seed_length(n, min_words) for n in sizes}
    lengths = sorted(set(length.values())) or [SEED]
    short = [F.when(F.size("words").isin([n for n in sizes if length[n] == k]), k) for k in lengths if k < SEED]
    own = F.coalesce(*short, F.lit(SEED))
    seeds = _seeds(items, lengths, ["item_id"], own).select("item_id", F.col("words").alias("item"), F.col("at").alias("item_at"), "h")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.expr(WORDS).alias("words"))
    # Pieces of PIECE words with as many on both sides as the longest item has: a generator with a lambda hands them on one by one.
    wide = max(sizes, default=0)
    pieces = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE)), lambda at: F.struct(F.greatest(at - wide, F.lit(0)).alias("base"), F.least(at, F.lit(wide)).alias("first"), F.slice("words", F.greatest(at - wide, F.lit(0)) + 1, F.least(at, F.lit(wide)) + PIECE + wide).alias("words")))
    words = words.select("doc_id", "row_key", F.explode(pieces).alias("piece")).select("doc_id", "row_key", "piece.*")
    hits = _seeds(words, lengths, ["doc_id", "row_key", "base"], None, F.col("first"), F.col("first") + PIECE).join(seeds, "h")
    # `same` says which words of the item agree with the document at this alignment.
    shift = F.col("at") - F.col("item_at")
    lo, hi = F.greatest(F.lit(0), -shift), F.least(F.size("item"), F.size("words") - shift)
    # The documents' words of the alignment only, so that no longer array goes on.
    cut = hits.select("row_key", "doc_id", "item_id", (F.col("base") + shift).alias("shift"), lo.alias("lo"), F.slice("item", lo + 1, hi - lo).alias("a"), F.slice("words", lo + shift + 1, hi - lo).alias("b"), F.size("item").alias("size"))
    need = F.least(F.lit(min_words), F.ceil(F.col("size") * 4 / 5))
    same = F.zip_with("a", "b", lambda x, y: x == y)
    # Both are named twice, which keeps the cut a step of its own: hits that wait in memory hold no whole document.
    cut = cut.select("row_key", "doc_id", "item_id", "shift", "lo", "size", same.alias("same"), (F.size("a") + F.size("b")).alias("wide"))
    cut = cut.filter("wide > 0").drop("wide").filter(F.size(F.filter("same", lambda x: x)) >= need).dropDuplicates()
    # c: equal words before each place. A stretch from i to j has four fifths equal words if 5 c - 4 place is no less at j
    # than at i; the longest ones begin where it is below all values before and end where it is above all values after.
    cut = cut.withColumn("c", F.aggregate("same", F.array(F.lit(0)), lambda c, x: F.concat(c, F.array(F.element_at(c, -1) + x.cast("int")))))
    places = F.transform("c", lambda c, i: F.struct((5 * c - 4 * i).alias("p"), c.alias("c")))

    def ends(array, beyond):
        first = F.slice(array, 1, 1)
        return F.aggregate(array, first, lambda kept, x: F.when(beyond(x["p"], F.element_at(kept, -1)["p"]), F.concat(kept, F.array(x))).otherwise(kept))

    cut = cut.withColumn("i", ends(places, lambda p, q: p < q)).withColumn("j", ends(F.reverse(places), lambda p, q: p > q))
    spans = F.flatten(F.transform("i", lambda i: F.transform(F.filter("j", lambda j: j["p"] >= i["p"]), lambda j: F.struct((j["c"] - i["c"]).alias("equal"), i["c"].alias("from"), j["c"].alias("to")))))
    cut = cut.withColumn("s", F.array_max(spans)).filter(F.col("s.equal") >= need)
    # Different words at its ends are no part of an overlap.
    begin = F.size(F.filter("c", lambda c: c <= F.col("s.from"))) - 1
    end = F.size(F.filter("c", lambda c: c < F.col("s.to")))
    return cut.select("row_key", "doc_id", "item_id", (F.col("shift") + F.col("lo") + begin).alias("start"), (F.col("shift") + F.col("lo") + end).alias("stop"), F.col("s.equal").alias("equal"))


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row_key, contaminated, n_items, longest, first_item) for each row of docs(doc_id, text).

    contaminated: some item of benchmark(item_id, text) overlaps (see overlaps()). n_items: how many do; longest: most
    equal words; first_item: the smallest such item_id. Words are runs of letters, marks and digits, lower-cased. Null
    and empty texts are clean; an empty benchmark finds nothing; null item_ids count as one item. Rows are judged each,
    by text, with null or repeated doc_ids too; equal rows alike. Other columns are ignored.
    """
    hits = overlaps(docs, benchmark, min_words).groupBy("row_key", "item_id").agg(F.max("equal").alias("equal"))
    hits = hits.groupBy("row_key").agg(F.count("*").alias("n_items"), F.max("equal").alias("longest"), F.min("item_id").alias("first_item"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"))
    out = rows.join(hits, "row_key", "left")
    return out.select("doc_id", "row_key", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("longest", F.lit(0)).alias("longest"), "first_item")
