"""Language identification by interpolated Kneser-Ney character models, one per language.

Text is lower-cased and mapped to 64 symbols: 0 for anything that is no letter (runs count once), 1-26 for a-z, and
37 classes for other letters by code point. A gram of 4 symbols packs into 24 bits, so a language has at most 2**24
grams and a model a bound of its own, whatever the corpus. Counts come from all training documents. A model is a
sorted array of packed grams with a row of log-probabilities per language beside it; grams not in it back off to
dense tables of the lower order. The language of the lowest cross-entropy per symbol wins.

Rejection is calibrated on texts that were not counted: per language and length (powers of two) the cross-entropy that
999 of 1,000 of them stay below, pooled with shorter texts until there are 1,000. Below that number the limit that mean
and deviation of a symbol's log-probability give counts too, if it is the wider.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, tune

BITS = 6
ORDER = 4
SHARPNESS = 40.0
REJECT_SIGMAS = 8.0
#: One text in CALIBRATION is kept from the counts for calibration; KEEP of these are not to be rejected.
CALIBRATION = 10
KEEP = 0.999
SIZES = 32
STEP = 1 / 64
_STATE: dict = {}


def _symbols():
    import numpy as np

    if "symbols" not in _STATE:
        t = np.zeros(0x10000, np.uint8)
        for cp in range(0x10000):
            c = chr(cp)
            if c.isalpha():
                t[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % 37
        _STATE["symbols"] = t
    return _STATE["symbols"]


def grams(texts):
    """Packed grams of each text (one per symbol, padded with 0 on the left), and the gram count before each text."""
    import numpy as np

    table = _symbols()
    raw = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(r) + ORDER for r in raw])
    ends = np.cumsum(size)
    cp = np.zeros(int(ends[-1]) if len(raw) else 0, np.uint32)
    for r, e in zip(raw, ends):
        cp[e - len(r) : e] = r
    s = table[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        s[high] = [27 + int(c) % 37 if chr(int(c)).isalpha() else 0 for c in cp[high]]
    owner = np.repeat(np.arange(len(raw)), size)
    pad = np.zeros(len(s), bool)
    for k in range(ORDER):
        pad[ends - size + k] = True
    keep = pad | (s > 0)
    keep[1:] |= s[:-1] > 0
    s, owner, pad = s[keep].astype(np.uint32), owner[keep], pad[keep]
    code = s.copy()
    for k in range(1, ORDER):
        code[k:] |= s[:-k] << np.uint32(BITS * k)
    # Padding starts each text, so no gram reaches back into another.
    code, owner = code[~pad], owner[~pad]
    return code, np.searchsorted(owner, np.arange(len(raw) + 1))


def _count(batches):
    import numpy as np
    import pyarrow as pa

    found: dict = {}

    def squeeze(lang):
        c = np.concatenate([x for x, _ in found[lang]])
        n = np.concatenate([y for _, y in found[lang]])
        u, at = np.unique(c, return_inverse=True)
        found[lang] = [(u, np.bincount(at, weights=n).astype(np.int64))]

    for batch in slices(batches, "text"):
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in set(langs):
            code, _ = grams(texts[langs == lang])
            u, n = np.unique(code, return_counts=True)
            found.setdefault(lang, []).append((u, n))
            if sum(len(x) for x, _ in found[lang]) > 1 << 20:
                squeeze(lang)
    for lang in sorted(found):
        squeeze(lang)
        u, n = found[lang][0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int32)), pa.array(n)], names=["lang", "gram", "n"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs(lang, text) with a non-null lang; null texts have no gram."""
    tune(docs.sparkSession)
    rows = docs.filter("lang is not null").select("lang", "text")
    return rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def for_calibration():
    """Whether a text of docs(text) is kept for calibration; equal texts are of one kind."""
    return F.pmod(F.xxhash64("text", F.lit(4)), F.lit(CALIBRATION)) == 0


class LanguageModels:
    """langs; keys: sorted packed grams; logp[key, lang]; lower[gram of 3, lang] and gamma[context of 3, lang] for the rest; limit[lang, size]."""

    def __init__(self, langs, keys, logp, lower, gamma, limit):
        self.langs, self.keys, self.logp, self.lower, self.gamma, self.limit = langs, keys, logp, lower, gamma, limit

    def entropies(self, code, starts):
        """Cross-entropy per symbol (nats) of each text under each language, and the number of symbols."""
        import numpy as np

        if "index" not in self.__dict__:
            # Direct address into the sorted array.
            self.index = np.full(1 << (BITS * ORDER), -1, np.int32)
            self.index[self.keys] = np.arange(len(self.keys), dtype=np.int32)
        at = self.index[code]
        low = (1 << (BITS * 3)) - 1
        n, out = np.diff(starts), np.zeros((len(starts) - 1, len(self.langs)))
        miss = np.flatnonzero(at < 0)
        full = n > 0
        for k in range(len(self.langs)):
            lp = self.logp[:, k][at] if len(self.keys) else np.zeros(len(code), np.float32)
            if len(miss):
                c = code[miss]
                lp[miss] = np.log(self.gamma[c >> BITS, k] * self.lower[c & low, k])
            total = np.concatenate([[0], np.cumsum(lp, dtype=np.float64)])
            out[full, k] = -(total[starts[1:]] - total[starts[:-1]])[full] / n[full]
        return out, n


def _kneser_ney(keys, counts):
    """One language: (log-probabilities of its grams, dense lower-order probabilities, dense back-off weight per context)."""
    import numpy as np

    def discount(n):
        one, two = (n == 1).sum(), (n == 2).sum()
        return one / (one + 2 * two) if one and two else 0.5

    mask = lambda k: (1 << (BITS * k)) - 1
    # Types of order k are the distinct suffixes of the types of order k + 1; their counts are continuation counts.
    types = {ORDER: (keys, counts.astype(float))}
    for k in range(ORDER - 1, 0, -1):
        u, n = np.unique(types[k + 1][0] & mask(k), return_counts=True)
        types[k] = (u, n.astype(float))
    prob = np.full(1 << BITS, 1 / (1 << BITS))
    for k in range(1, ORDER):
        u, n = types[k]
        d = discount(n)
        context = u >> BITS
        total = np.bincount(context, weights=n, minlength=1 << (BITS * (k - 1)))
        kinds = np.bincount(context, minlength=1 << (BITS * (k - 1)))
        back = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        prob = np.repeat(back, 1 << BITS) * (np.tile(prob, 1) if k == 1 else prob[np.arange(1 << (BITS * k)) & mask(k - 1)])
        prob[u] += np.maximum(n - d, 0) / total[context]
    u, n = types[ORDER]
    d = discount(n)
    context = u >> BITS
    total = np.bincount(context, weights=n, minlength=1 << (BITS * 3))
    kinds = np.bincount(context, minlength=1 << (BITS * 3))
    gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    p = np.maximum(n - d, 0) / total[context] + gamma[context] * prob[u & mask(3)]
    return np.log(p), prob, gamma


def fit(counts: DataFrame) -> LanguageModels:
    """Models from gram_counts(). The driver sees at most 2**24 grams a language; one language after another."""
    import numpy as np

    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    own = {}
    for lang in langs:
        t = counts.filter(F.col("lang") == lang).select("gram", "n").toArrow()
        k, n = t.column("gram").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(k)
        own[lang] = (k[order].astype(np.int64), n[order], *_kneser_ney(k[order].astype(np.int64), n[order]))
    keys = np.unique(np.concatenate([o[0] for o in own.values()])) if own else np.zeros(0, np.int64)
    m = len(langs)
    logp = np.zeros((len(keys), m), np.float32, order="F")
    lower = np.zeros((1 << (BITS * 3), m), np.float32)
    gamma = np.zeros((1 << (BITS * 3), m), np.float32)
    limit = []
    for j, lang in enumerate(langs):
        k, n, lp, low, g = own[lang]
        lower[:, j], gamma[:, j] = low, g
        logp[:, j] = np.log(np.maximum(g[keys >> BITS] * low[keys & ((1 << (BITS * 3)) - 1)], 1e-30))
        logp[np.searchsorted(keys, k), j] = lp
        mean = (n * -lp).sum() / n.sum()
        dev = np.sqrt(max(0.0, (n * lp * lp).sum() / n.sum() - mean**2))
        limit.append(mean + REJECT_SIGMAS * dev / np.sqrt(2.0 ** np.arange(SIZES)) + 0.5)
    return LanguageModels(langs, keys, logp, lower, gamma, np.array(limit).reshape(m, SIZES))


def _size(n) -> int:
    return min(int(n).bit_length() - 1, SIZES - 1)


def calibrate(models: LanguageModels, docs: DataFrame) -> LanguageModels:
    """The models with limits of rejection from docs(lang, text), texts that were not counted; unknown languages and empty texts add nothing.

    The driver sees one row per language, length and step of cross-entropy.
    """
    import numpy as np

    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((models.langs, models.keys, models.logp, models.lower, models.gamma, models.limit))

    def run(batches):
        import pyarrow as pa

        m = LanguageModels(*shared.value)
        place = {lang: j for j, lang in enumerate(m.langs)}
        found: dict = {}
        for batch in slices(batches, "text"):
            code, starts = grams(batch.column(1).to_pylist())
            h, n = m.entropies(code, starts)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                if lang in place and n[i]:
                    key = (place[lang], _size(n[i]), int(h[i, place[lang]] / STEP))
                    found[key] = found.get(key, 0) + 1
        if found:
            j, size, step = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(size, pa.int32()), pa.array(step, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["j", "size", "step", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "j int, size int, step int, n long").groupBy("j", "size", "step").agg(F.sum("n").alias("n")).collect()
    limit = models.limit.copy()
    for j in range(len(models.langs)):
        for size in range(SIZES):
            # Texts of this length, then ever shorter ones, which vary more, until there are enough.
            pool: dict = {}
            for near in range(size, -1, -1):
                for r in rows:
                    if r["j"] == j and r["size"] == near:
                        pool[r["step"]] = pool.get(r["step"], 0) + r["n"]
                if sum(pool.values()) * (1 - KEEP) >= 1:
                    break
            steps = np.array(sorted(pool))
            if len(steps):
                share = np.cumsum([pool[k] for k in steps.tolist()]) / sum(pool.values())
                found = float(steps[np.searchsorted(share, KEEP)] + 1) * STEP
                limit[j, size] = found if sum(pool.values()) * (1 - KEEP) >= 1 else max(found, limit[j, size])
    return LanguageModels(models.langs, models.keys, models.logp, models.lower, models.gamma, limit)


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for each row of docs(doc_id, text).

    lang_pred: the language of the lowest cross-entropy per symbol, ties to the first in order; `und` with score 0 if
    the text is null, has no letter, or nothing was learned. score: its share after exponentiating the differences.
    rejected: the text fits even that language worse than nearly all text of it, by calibrate() (a mark only; the prediction stays).
    Texts are read whole; other columns are ignored; repeated rows give a row each.
    """
    spark = docs.sparkSession
    tune(spark)
    # Plain arrays: a broadcast is unpickled where this package need not be installed.
    shared = spark.sparkContext.broadcast((models.langs, models.keys, models.logp, models.lower, models.gamma, models.limit))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = LanguageModels(*shared.value)
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            code, starts = grams(texts)
            h, n = m.entropies(code, starts)
            letters = np.concatenate([[0], np.cumsum((code & 63) > 0)])
            ok = ((letters[starts[1:]] - letters[starts[:-1]]) > 0) & bool(m.langs)
            pred, score, ent, odd = [], [], [], []
            for i in range(len(texts)):
                if not ok[i]:
                    pred.append("und")
                    score.append(0.0)
                    ent.append(None)
                    odd.append(True)
                    continue
                j = int(h[i].argmin())
                # A language's symbols weigh alike up to SHARPNESS of them; more text adds no more certainty than that.
                x = np.exp(-(h[i] - h[i][j]) * min(float(n[i]), SHARPNESS))
                pred.append(m.langs[j])
                score.append(float(x[j] / x.sum()))
                ent.append(float(h[i][j]))
                odd.append(bool(h[i][j] > m.limit[j][_size(n[i])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ent, pa.float64()), pa.array(odd, pa.bool_())], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
