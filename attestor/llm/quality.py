"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic scores.

Statistics are counted from the whole text. They are standardised, mapped to cosines of random projections (which
approximate a Gaussian kernel), and a ridge regression on the labels is solved from X'X and X'y, summed within each
partition first. Raw scores become probabilities by pool-adjacent-violators over a fixed grid of score bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices, tune
from ._kernels import span_hashes, text_bytes, windows, word_spans

FEATURES = 192
RIDGE = 1.0
BINS = 512
SEED = 20
STATS = (
    "log_words", "word_length", "long_words", "upper", "digit", "symbol", "stop_marks", "not_ascii", "space", "bang", "bar", "distinct", "top_word",
    "echo", "pairs", "triples", "ends_in_symbol", "line_words", "short_lines", "capital_words", "repeated_lines", "empty",
)


def statistics(buf, off):
    """A row of STATS per document; ratios of an empty document are 0."""
    import numpy as np

    n = len(off) - 1
    kinds = np.zeros((8, 256), np.int32)
    kinds[0, 65:91] = 1
    kinds[1, 48:58] = 1
    kinds[2, [ord(c) for c in "#$%&*@^~_<>=+\\|{}[]/"]] = 1
    kinds[3, [ord(c) for c in ".,;:?"]] = 1
    kinds[4, 128:] = 1
    kinds[5, [32, *range(9, 14)]] = 1
    kinds[6, 33] = 1
    kinds[7, 124] = 1
    size = np.diff(off).astype(float)
    per = np.zeros((8, n))
    for k in range(8):
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kinds[k][buf], out=c[1:])
        per[k] = c[off[1:]] - c[off[:-1]]
    s, e, counts = word_spans(buf, off)
    tokens, words = span_hashes(buf, s, e, lower=True), np.diff(counts)
    cum = lambda x: np.concatenate([[0], np.cumsum(x)])
    of = lambda x: (c := cum(x))[counts[1:]] - c[counts[:-1]]
    length = e - s
    last = buf[e - 1] if len(s) else np.zeros(0, np.uint8)
    tail = of((kinds[2] + kinds[6])[last])
    capital = of(kinds[0][buf[s]]) if len(s) else np.zeros(n)
    same = np.zeros(len(tokens), np.int64)
    if len(tokens) > 1:
        same[1:] = tokens[1:] == tokens[:-1]
        begins = counts[:-1][words > 0]
        same[begins] = 0
    echo = of(same)
    two, _, w2 = windows(tokens, counts, 2)
    three, _, w3 = windows(tokens, counts, 3)
    breaks = np.flatnonzero(buf == 10)
    lines = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    edges = np.sort(np.concatenate([breaks, off[1:-1], [0, len(buf)]]))
    line_words = np.diff(np.searchsorted(s, edges))
    short = cum((line_words < 3).astype(int))
    first = np.searchsorted(edges, off[:-1], side="right") - 1
    final = np.searchsorted(edges, off[1:], side="left")
    short_lines = short[np.maximum(final, first)] - short[first]
    line_of = np.searchsorted(edges, s, side="right")
    cut = np.flatnonzero(np.diff(line_of, prepend=-1)) if len(s) else np.zeros(0, np.int64)
    distinct, top, d2, d3, again = (np.zeros(n) for _ in range(5))
    # Words weigh by their place in the line, so the same words in another order are another line.
    place = np.arange(len(tokens)) - np.repeat(cut, np.diff(np.append(cut, len(tokens))))
    line_hash = np.add.reduceat(tokens * (2 * place + 1).astype(np.uint64), cut) if len(cut) else tokens
    line_at = np.searchsorted(cut, counts)
    for i in range(n):
        if words[i]:
            u, c = np.unique(tokens[counts[i] : counts[i + 1]], return_counts=True)
            distinct[i], top[i] = len(u) / words[i], c.max() / words[i]
            a, b = w2[i], w2[i + 1]
            d2[i] = 1 - len(np.unique(two[a:b])) / (b - a) if b > a else 0
            a, b = w3[i], w3[i + 1]
            d3[i] = 1 - len(np.unique(three[a:b])) / (b - a) if b > a else 0
            a, b = line_at[i], line_at[i + 1]
            again[i] = 1 - len(np.unique(line_hash[a:b])) / (b - a) if b > a else 0
    w, z = np.maximum(words, 1), np.maximum(size, 1)
    return np.stack([
        np.log1p(words), np.minimum(of(length) / w, 40), of(length > 12) / w, per[0] / z, per[1] / z, per[2] / z, per[3] / w, per[4] / z, per[5] / z, per[6] / w, per[7] / w, distinct, top,
        echo / w, d2, d3, tail / w, np.log1p(words / lines), short_lines / lines, capital / w, again, words == 0,
    ], axis=1).astype(float)


def _stats(batches):
    import pyarrow as pa

    for batch in slices(batches, "text"):
        x = statistics(*text_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "stats"])


def partition_sums(df: DataFrame, make, width: int, fan: int = 8):
    """Sums `make(arrow batch) -> float array of width` over all rows: within partitions, then in `fan` tasks, then here."""
    import numpy as np

    def own(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def join(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = df.mapInArrow(own, "sums binary").repartition(fan).mapInArrow(join, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in parts.collect()), np.zeros(width))


def isotonic(weights, positives):
    """Pool-adjacent-violators over bins: a non-decreasing share of positives per bin; empty bins take the bin below."""
    import numpy as np

    blocks = []
    for i, (w, p) in enumerate(zip(weights, positives)):
        if w <= 0:
            continue
        blocks.append([w, p, i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, p2, _ = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += p2
    out = np.full(len(weights), np.nan)
    for k, (w, p, i) in enumerate(blocks):
        end = blocks[k + 1][2] if k + 1 < len(blocks) else len(weights)
        out[i:end] = p / w
    if blocks:
        out[: blocks[0][2]] = blocks[0][1] / blocks[0][0]
    return out


class QualityModel:
    """Everything a score needs: standardisation, random projection, ridge weights, calibration."""

    def __init__(self, mean, scale, projection, phase, weights, low, high, steps):
        self.mean, self.scale, self.projection, self.phase = mean, scale, projection, phase
        self.weights, self.low, self.high, self.steps = weights, low, high, steps

    def features(self, x):
        import numpy as np

        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([np.ones((len(x), 1)), phi])

    def raw(self, x):
        return self.features(x) @ self.weights

    def bins(self, x):
        import numpy as np

        r = (self.raw(x) - self.low) / (self.high - self.low)
        return np.clip(r, 0, 1), np.clip((r * len(self.steps)).astype(int), 0, len(self.steps) - 1)

    def score(self, x):
        r, b = self.bins(x)
        # The raw score breaks ties within a calibrated step.
        return 0.998 * self.steps[b] + 0.002 * r


def _matrix(column):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(STATS)).astype(np.float64)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row of docs(doc_id, text); null texts count as empty."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_stats, "doc_id long, stats array<double>")


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """A model from labelled(stats, label 0/1). Without rows or with one label only, every score is that label's share (or 0.5)."""
    import numpy as np

    d = len(STATS)
    rng = np.random.default_rng(SEED)
    rows = labelled.select("stats", F.col("label").cast("double").alias("label"))

    def moments(batch):
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = partition_sums(rows, moments, 1 + 2 * d)
    n = max(m[0], 1)
    mean = m[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(m[1 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    model = QualityModel(mean, scale, rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), -0.5, 1.5, np.full(BINS, 0.5))
    k = features + 1
    if not m[0]:
        return model

    def normal(batch):
        phi, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy()
        return np.concatenate([(phi.T @ phi).ravel(), phi.T @ y])

    s = partition_sums(rows, normal, k * k + k)
    model.weights = np.linalg.solve(s[: k * k].reshape(k, k) + ridge * np.eye(k), s[k * k :])

    def histogram(batch):
        _, b = model.bins(_matrix(batch.column(0)))
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, weights=batch.column(1).to_numpy(), minlength=BINS)]).astype(float)

    h = partition_sums(rows, histogram, 2 * BINS)
    model.steps = isotonic(h[:BINS], h[BINS:])
    return model


def quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of document_statistics(); every text has a score from 0 to 1, empty ones too."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, column: str = "quality") -> DataFrame:
    """(doc_id, score): learned from rows whose crc32(doc_id as text) mod `modulus` is not `held`, applied to all rows of docs.

    Labels other than 0 and 1 (null too) are not learned from; of repeated labels the larger counts.
    """
    stats = materialize(document_statistics(docs), "stats")
    gold = labels.filter(F.col(column).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held)).groupBy("doc_id").agg(F.max(column).alias("label"))
    train = materialize(stats.join(gold, "doc_id").select("stats", "label"), "train")
    return quality(stats, fit(train))
