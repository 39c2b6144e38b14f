"""Vectorised text kernels over UTF-8 bytes: words, word hashes, windows of words, per-document sets."""

from __future__ import annotations

import numpy as np

U = np.uint64
_STATE: dict = {}


def text_bytes(col):
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    import pyarrow as pa

    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def mix(h):
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = np.asarray(h, dtype=U)
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def _tables():
    if "R" not in _STATE:
        r = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
        low = r.copy()
        low[65:91] = r[97:123]
        sep = np.zeros(256, bool)
        sep[[0x20, *range(0x09, 0x0E)]] = True
        _STATE.update(R=r, LOW=low, SEP=sep)
    return _STATE


def _powers(n: int):
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _STATE.get("P")
    if have is None or len(have[0]) < n:
        base = 0xD1342543DE82EF95
        inv = pow(base, -1, 1 << 64)
        size = max(n, 1 << 16)
        out = []
        for b in (base, inv):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _STATE["P"] = have = tuple(out)
    return have


def word_spans(buf, off):
    """Starts and ends of words [^\\x20\\x09-\\x0D]+, and the count of words before each document."""
    t = _tables()
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sep = t["SEP"][buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, sep[:-1]
    after[-1], after[:-1] = True, sep[1:]
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = True
    after[off[1:][full] - 1] = True
    word = ~sep
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf, starts, ends, lower: bool = False):
    """A 64-bit hash of the bytes of each span; with lower, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U)
    r = _tables()["LOW" if lower else "R"]
    p, q = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(buf) + 1, U)
        np.cumsum(r[buf] * p[: len(buf)], out=h[1:])
        return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def windows(tokens, counts, k: int, seed: int = 1):
    """A hash of each window of k tokens inside one document: (hashes, start positions, windows before each document).

    counts: tokens before each document, and the total at the end.
    """
    n = len(tokens)
    starts = np.zeros(len(counts), np.int64)
    np.cumsum(np.maximum(0, np.diff(counts) - (k - 1)), out=starts[1:])
    if not starts[-1]:
        return np.zeros(0, U), np.zeros(0, np.int64), starts
    with np.errstate(over="ignore"):
        salted = mix(tokens + U(seed))
        if k <= 8:
            h = np.zeros(n - k + 1, U)
            base, f = pow(0xA24BAED4963EE407, 1, 1 << 64), 1
            for j in range(k):
                h += salted[j : n - k + 1 + j] * U(f)
                f = f * base % (1 << 64)
        else:
            p, q = _powers(n + 1)
            s = np.zeros(n + 1, U)
            np.cumsum(salted * p[:n], out=s[1:])
            h = (s[k:] - s[: n - k + 1]) * q[: n - k + 1]
        h = mix(h + U(k))
    has = np.diff(counts) >= k
    ok = np.zeros(n + 1, np.int32)
    np.add.at(ok, counts[:-1][has], 1)
    np.add.at(ok, counts[1:][has] - (k - 1), -1)
    at = np.flatnonzero(np.cumsum(ok[: n - k + 1]) > 0)
    return h[at], at, starts


def shingle_sets(buf, off, k: int = 5, lower: bool = True):
    """Per document the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    s, e, counts = word_spans(buf, off)
    tokens = span_hashes(buf, s, e, lower)
    h, _, starts = windows(tokens, counts, k)
    out = []
    for i in range(len(off) - 1):
        m = counts[i + 1] - counts[i]
        if m >= k:
            out.append(np.unique(h[starts[i] : starts[i + 1]]))
        elif m:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([np.bitwise_xor.reduce(mix(tokens[counts[i] : counts[i + 1]] + np.arange(1, m + 1, dtype=U) * U(0x632BE59BD9B4E019))) + U(m)], dtype=U)))
        else:
            out.append(np.zeros(0, U))
    return out, counts


def pack(values, width: int = 8) -> bytes:
    """The low `width` bytes of sorted 64-bit hashes, sorted again."""
    v = np.unique(np.asarray(values, dtype=U) & U((1 << (8 * width)) - 1))
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int = 8):
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def crc_mod(ids, m: int):
    """crc32 of each id as text, modulo m; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % m for i in ids], dtype=np.int64)
