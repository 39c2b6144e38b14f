"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding, normalised by length.

Folding lower-cases, maps look-alike letters to Latin and digits and signs inside words to the letters they stand for,
and turns all else between words into one space. Patterns match at the start of a word: whole words or stems.

The lexicon is learned: over a bounded sample of labelled documents, each word and each word start of 4 to 8 letters
is counted by document and label, near copies once. Terms whose label odds are beyond chance, given how many terms there
are, become patterns with their log odds as weight. Exception phrases, a fixed list by default, cancel the hits they cover.
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices, tune
from ._kernels import shingle_sets, text_bytes

#: Labelled rows that the lexicon is learned from, at most.
SAMPLE = 10_000
MIN_DOCS = 4
MIN_ODDS = 2.5
#: Words of text at which a hit counts half.
LENGTH = 2_000

# Look-alikes of Latin letters, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "ѡ": "w", "ӏ": "l", "ԛ": "q", "ԝ": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
# Phrases in which a listed word is no insult.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "soap scum", "class clown", "clown fish", "circus clown", "sore loser board", "worthless check")


_STATE: dict = {}


def _fold_one(c: str) -> int:
    """The code point that stands for a character: a letter, a sign or digit kept for later, 32 for others, 0 to drop it."""
    if c in DIGITS:
        return ord(c)
    if c in "'’" or unicodedata.category(c) in ("Cf", "Mn"):
        return 0
    v = unicodedata.normalize("NFKC", c).lower()[:1]
    v = LOOKALIKES.get(v, v)
    return ord(v) if v.isalpha() or v in DIGITS else 32


def _fold_table():
    import numpy as np

    if "fold" not in _STATE:
        _STATE["fold"] = np.array([32 if 0xD800 <= i < 0xE000 else _fold_one(chr(i)) for i in range(0x10000)], dtype=np.uint32)
    return _STATE["fold"]


def fold(texts):
    """All texts folded into one string, and where each begins in it (with the end). One space stands before each word.

    Digits next to a letter and signs before a letter become the letters they stand for; other digits and signs are
    spaces. A text begins with a space.
    """
    import numpy as np

    table = _fold_table()
    raw = [np.frombuffer(("\n" + (t or "")).encode("utf-32-le", "replace"), np.uint32) for t in texts]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
    cp = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    x = table[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        x[high] = [_fold_one(chr(int(c))) for c in cp[high]]
    starts = np.concatenate([[0], ends])
    keep = x > 0
    starts = np.concatenate([[0], np.cumsum(keep)])[starts]
    x = x[keep]
    digit, sign, to = np.zeros(128, bool), np.zeros(128, bool), np.arange(128, dtype=np.uint32)
    for c, v in DIGITS.items():
        (digit if c.isdigit() else sign)[ord(c)] = True
        to[ord(c)] = ord(v)
    low = np.minimum(x, 127)
    d, g = digit[low] & (x < 128), sign[low] & (x < 128)
    if d.any() or g.any():
        letter = ~d & ~g & (x != 32)
        for _ in range(3):
            after = np.append(letter[1:], False)
            before = np.concatenate([[False], letter[:-1]])
            letter |= (d & (before | after)) | (g & after)
        x = np.where((d | g) & letter, to[low], np.where(d | g | (x == ord("2")) | (x == ord("6")), np.uint32(32), x)).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[:-1] = ~((x[:-1] == 32) & (x[1:] == 32))
    starts = np.concatenate([[0], np.cumsum(keep)])[starts]
    return x[keep].tobytes().decode("utf-32-le", "replace"), starts


def _counts(batches):
    """Documents with each word and each word start, by label."""
    from collections import Counter

    import pyarrow as pa

    seen, n = (Counter(), Counter()), [0, 0]
    for batch in slices(batches, "text"):
        big, starts = fold(batch.column(0).to_pylist())
        for i, label in enumerate(batch.column(1).to_pylist()):
            distinct = set(big[starts[i] : starts[i + 1]].split())
            terms = {w + " " for w in distinct if len(w) > 2}
            for w in distinct:
                if len(w) > 3:
                    terms.update([w[:k] for k in range(4, min(len(w), 8) + 1)])
            seen[label].update(terms)
            n[label] += 1
    out = [("", n[0], n[1])]
    out += [(t, seen[0][t], seen[1][t]) for t in seen[0].keys() | seen[1].keys()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["term", "clean", "toxic"])


def _first_shingle(batches):
    """The least 5-word shingle hash of each text: near copies mostly share it."""
    import pyarrow as pa

    for batch in slices(batches, "text"):
        sets, _ = shingle_sets(*text_bytes(batch.column(0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(x[0]) >> 1 if len(x) else -1 for x in sets], pa.int64())], names=["text", "label", "least"])


def ratio_column(clean: int, toxic: int):
    """Log-likelihood ratio of a term's share of toxic documents against the share of all; the columns are clean and toxic."""
    share, n = toxic / (clean + toxic), F.col("clean") + F.col("toxic")
    p = F.least(F.greatest(F.col("toxic") / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    part = lambda q: F.col("toxic") * F.log(q) + F.col("clean") * F.log(1 - q)
    return F.when((F.col("toxic") > 0) & (F.col("toxic") / n > share), part(p) - part(F.lit(share))).otherwise(0.0)


def choose(rows, clean: int, toxic: int) -> dict[str, float]:
    """Patterns and weights from (term, clean documents, toxic documents), terms beyond chance.

    Of nested stems the longest that keeps nine tenths of the toxic documents stays; a whole word stays only if no stem
    of it does.
    """
    good = {term: (math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)), t) for term, c, t in rows}
    good = {t: v for t, v in good.items() if v[0] >= MIN_ODDS}
    stems = sorted(t for t in good if not t.endswith(" "))
    out = {}
    for t, (w, n) in good.items():
        if t.endswith(" "):
            if not any(t[:k] in good and good[t[:k]][0] >= w - 1 for k in range(4, len(t))):
                out[t] = w
            continue
        # Longer stems follow their prefix in order.
        after = itertools.takewhile(lambda o: o.startswith(t), itertools.islice(stems, bisect.bisect_right(stems, t), None))
        longer = any(good[o][1] >= 0.9 * n for o in after)
        shorter = any(t[:k] in good and n < 0.9 * good[t[:k]][1] and good[t[:k]][0] >= w - 1 for k in range(4, len(t)))
        if not longer and not shorter:
            out[t] = w
    return out


class Lexicon:
    """terms: pattern -> weight; a pattern with a final space is a whole word, else a stem. base: log odds of the label."""

    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS, bias: float = -4.0, slope: float = 1.0):
        self.terms, self.exceptions, self.bias, self.slope = terms, tuple(exceptions), bias, slope

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(" " + t, (len(t), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p), None))
        if len(a):
            a.make_automaton()
        return a


def score_texts(lexicon: Lexicon, auto, texts):
    """Arrays (hits, words, normalised weight, score) of some texts."""
    import numpy as np

    big, starts = fold(texts)
    n = len(texts)
    hits, weight = np.zeros(n, np.int64), np.zeros(n)
    space = np.concatenate([[0], np.cumsum(np.frombuffer(big.encode("utf-32-le"), np.uint32) == 32)])
    words = np.maximum(0, space[starts[1:]] - space[starts[:-1]] - [big[e - 1] == " " if e else False for e in starts[1:]])
    best, cut = {}, []
    for end, (size, w) in auto.iter(big) if len(auto) else ():
        begin = end - size + 1
        if w is None:
            cut.append((begin - 1, end))
        elif best.get(begin, 0) < w:
            # A word counts once, by its strongest pattern.
            best[begin] = w
    for lo, hi in cut:
        for b in range(lo, hi + 1):
            best.pop(b, None)
    if best:
        at = np.searchsorted(starts, np.array(list(best)), side="right") - 1
        np.add.at(hits, at, 1)
        np.add.at(weight, at, list(best.values()))
    norm = weight / (1 + words / LENGTH)
    return hits, words.astype(np.int64), norm, 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * norm, -40, 40)))


def _scores(lexicon: Lexicon):
    def run(batches):
        import pyarrow as pa

        auto = lexicon.automaton()
        for batch in slices(batches, "text"):
            found = score_texts(lexicon, auto, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found)], names=["doc_id", "n_hits", "n_words", "weight", "score"])

    return run


def reject(docs: DataFrame, lexicon: Lexicon, limit: float) -> DataFrame:
    """The rows of docs(..., text) whose score is below the limit, all columns as they were."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        auto = lexicon.automaton()
        for batch in slices(batches, "text"):
            score = score_texts(lexicon, auto, batch.column(batch.schema.get_field_index("text")).to_pylist())[3]
            yield batch.filter(pa.array(score < limit))

    return docs.mapInArrow(run, docs.schema)


def learn(texts: DataFrame) -> Lexicon:
    """A lexicon from texts(text, label 0/1); without both labels it is empty.

    The driver sees every term whose odds are beyond chance among all terms: a share of the words of the toxic rows of the sample.

    Of near copies in the sample one counts, so words that only copies share are not taken for insults.
    """
    tune(texts.sparkSession)
    rows = texts.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_first_shingle, "text string, label int, least long")
    rows = rows.groupBy("least", "label").agg(F.min("text").alias("text")).select("text", "label")
    counts = rows.mapInArrow(_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "terms")
    total = counts.filter("term = ''").first()
    if not total or not total["toxic"] or not total["clean"]:
        return Lexicon({})
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    n_terms = counts.filter("toxic > 0").count()
    beyond = ratio_column(total["clean"], total["toxic"]) >= math.log(max(2, n_terms)) + 3
    best = counts.filter((F.col("term") != "") & (F.col("toxic") >= MIN_DOCS)).filter((odds >= MIN_ODDS) & beyond)
    return Lexicon(choose([(r["term"], r["clean"], r["toxic"]) for r in best.collect()], total["clean"], total["toxic"]))


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, n_hits, n_words, weight, score) for each row of docs(doc_id, text); score from 0 to 1, toxic likelier above.

    weight: the weights of matched words outside exception phrases, over a slowly growing function of the length.
    Null and empty texts have no words and the score of no hit. Texts are read whole; other columns are ignored; repeated rows give a row each.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scores(lexicon), "doc_id long, n_hits long, n_words long, weight double, score double")


def labelled(docs: DataFrame, labels: DataFrame, modulus: int, held: int, column: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from: crc32(doc_id as text) mod `modulus` is not `held`, label 0 or 1.

    Of these the `sample` with the least hash of doc_id; that bound also bounds what is broadcast.
    """
    gold = labels.filter(F.col(column).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held))
    gold = gold.groupBy("doc_id").agg(F.max(column).alias("label")).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(gold), "doc_id")


def held_out(modulus: int, held: int):
    """Whether crc32 of doc_id as text leaves `held` modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held
