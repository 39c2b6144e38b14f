"""Line dedup: SimHash of normalised lines in pigeonhole blocks, verified edit similarity, one occurrence per group.

A line is normalised by lower case, digits as 0, no ASCII punctuation, single spaces. Equal normalised lines are one
line. Two lines are linked if the edit similarity of the normalised lines, 1 - distance / longer length, is at least the
threshold; nothing else is asked of a link.

The features of a line are its words (of short lines, grams of 2 or 4 characters); the k-th occurrence of a word is a
feature of its own. Candidates come from a SimHash of TABLES blocks. Each feature is dealt to one block by its hash, and a
block is the majority vote of the bits of its features. So features that change touch no more blocks than they are, and
what lies in the others is equal for certain: that is the pigeonhole. (Blocks cut from the bits of one SimHash, where
every feature votes everywhere, are all touched by any change.) The features of a block number a few whatever the
length: lines fall in classes by length, with twice the blocks in the next class, of which TABLES are looked at. A class
begins at the threshold times the end of the one before, so two lines whose lengths allow the similarity share a class.
A block of too few bytes says little and is no key. Of the lines in a bucket those are candidates whose lengths fit and
whose whole SimHash, 128 bits of all features, differs in RADIUS bits at most.

Each line first meets its nearest candidate in each bucket; the links found are merged to groups. Then every pair of
candidates that still lies in different groups is compared, where they meet; only links leave a task. Buckets over BLOCK
rows (seen in a sample of the lines) are dealt to parts; in the second step the rows of their largest group are dealt and
all others are sent to each part, so every pair meets, and no bucket is squared. In the first step rows move packed, in
runs by part of the cells: nearly all keys have one line only, and one by one these rows cost more than their comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, give_back, grouped, hold, join_hot, materialize, maybe_in, release, slices, tune
from ._kernels import U, mix, span_hashes, word_spans
from .components import connected_components

#: Blocks of a line that are looked at, and in how many shuffles.
TABLES, ROUNDS = 16, 2
#: Where the first class of lengths ends, in characters; each next one ends at twice as much.
SHORT = 20
#: Characters of a gram, in classes whose features are grams; words begin with the class after them.
GRAMS = (2, 4, 4)
#: Blocks of the first classes; then twice as many for each next class. With fewer than TABLES, features are dealt again.
BLOCKS = (4, 8, 16, 8)
#: Bytes that the features of a block hold at least, by class.
LEAST = (4, 8, 8, 12)
#: Words of more characters count as a quarter of their grams of 4.
LONG_WORD = 16
#: Bits of 128 in which the whole SimHashes of a candidate pair differ at most; of lines under 4 * SHORT characters, which have few features.
RADIUS, WIDE_RADIUS = 34, 46
#: Bytes of text whose features are in memory at once (one text at least).
SLICE = 1 << 18
#: Edit distances are taken many at a time from MANY on (more for long lines), of LETTERS different letters at most, with a table of that many bytes.
MANY, LETTERS, TABLE = 24, 256, 1 << 25
#: Pairs, and bytes of their lines, that are compared at once.
PAIRS, PAIR_BYTES = 1 << 14, 1 << 24
#: Rows of a bucket that meet in one task; larger buckets are found in one of SAMPLE lines.
BLOCK, SAMPLE = 8192, 64
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCAN = "doc_id long, row_key long, line int, digest binary, v binary"
ROWS = ["cell", "id", "size", "s0", "s1"]
MARKED = "block long, id long, size int, s0 long, s1 long, mate long, parts long"
#: A row of a bucket while it is dealt, packed: Spark moves runs of them by the part that their cell says, of PART rows about.
ROW = [("key", "<u8"), ("id", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("size", "<i4")]
PART, MOST_PARTS = 1 << 16, 1 << 14
#: Packed rows that are dealt from memory at once.
DEAL = 1 << 18



def normalised(text: str) -> list[bytes]:
    """The normalised lines of a text, in order."""
    table = bytes.maketrans(b"123456789", b"000000000")
    raw = text.lower().encode("utf-8", "replace").translate(table, PUNCTUATION)
    return [b" ".join(x.split()) for x in raw.split(b"\n")]


def bounds(c: int, threshold: float) -> tuple[int, int]:
    """The sizes, in characters, of the lines of class c: from the first, before the second."""
    return (int(threshold * (SHORT << (c - 1))) if c else 0), SHORT << c


def classes(size, threshold: float):
    """(first, second) class of lines of these sizes; the second is -1 where there is one only."""
    import numpy as np

    ends = np.array([SHORT << c for c in range(40)])
    first = np.searchsorted(ends, size, side="right")
    return first, np.where(size >= (threshold * ends[first]).astype(np.int64), first + 1, -1)


def gram(c):
    """The characters of the grams of class c; 0 for words."""
    import numpy as np

    return np.append(GRAMS, 0)[np.minimum(c, len(GRAMS))]


def _features(lines: list[bytes], k: int):
    """(hash, bytes, line) of each feature of non-empty lines, by line: grams of k characters, or words."""
    import numpy as np

    buf = np.frombuffer(b"".join(lines), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    first = (buf & 0xC0) != 0x80
    at, upto = np.append(np.flatnonzero(first), len(buf)), np.concatenate([[0], np.cumsum(first)])

    def grams(begin, end, owner, k):
        n = np.maximum(end - begin - k + 1, 1)
        i = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return at[i], at[np.minimum(i + k, np.repeat(end, n))], np.repeat(owner, n)

    if k:
        s, e, owner = grams(upto[off[:-1]], upto[off[1:]], np.arange(len(lines)), k)
        cut = np.zeros(len(s), bool)
    else:
        s, e, counts = word_spans(buf, off)
        owner = np.repeat(np.arange(len(lines)), np.diff(counts))
        long = upto[e] - upto[s] > LONG_WORD
        more = grams(upto[s[long]], upto[e[long]], owner[long], 4)
        cut = np.arange((~long).sum() + len(more[0])) >= (~long).sum()
        s, e, owner = (np.concatenate([x[~long], y]) for x, y in zip((s, e, owner), more))
    h = span_hashes(buf, s, e)
    with np.errstate(over="ignore"):
        same = mix(h + owner.astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(same)
        # Most are alone; the others are counted in the order they stand in.
        twin = same[order[1:]] == same[order[:-1]]
        twins = order[np.append(twin, False) | np.concatenate([[False], twin])]
        twins = np.sort(twins)
        twins = twins[np.argsort(same[twins], kind="stable")]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(same[twins]) != 0])) if len(twins) else twins
        nth = np.zeros(len(h), U)
        nth[twins] = (np.arange(len(twins)) - np.repeat(begin, np.diff(np.append(begin, len(twins))))).astype(U)
        h = mix(h + nth * U(0xC2B2AE3D27D4EB4F))
    size = e - s
    if not cut.any():
        return h, size, owner
    keep = np.flatnonzero(~cut | ((h & U(3)) == 0))
    keep = keep[np.argsort(owner[keep], kind="stable")]
    return h[keep], size[keep], owner[keep]


def _majority(h, begin, weight=None):
    """The SimHash of each run of hashes (rows of h) from `begin` on: a bit is set if it is in over half of the weight (1 to 4 each).

    64 counters stand in a few words, the n-th word holding their n-th bits; runs are added up in pairs of neighbours.
    """
    import numpy as np

    zero, full = U(0), ~U(0)
    length = np.diff(np.append(begin, h.shape[1]))
    total = length if weight is None else np.add.reduceat(weight, begin) if len(begin) else length
    planes = [h] if weight is None else [np.where(weight >> b & 1, h, zero) for b in range(3)]
    out, place = np.zeros((len(h), len(begin)), U), np.arange(len(begin))
    while len(place):
        one = length == 1
        if one.any():
            at, half = begin[one], total[place[one]] >> 1
            more, same = np.zeros((len(h), len(at)), U), np.full((len(h), len(at)), full)
            for b in reversed(range(max(len(planes), int(half.max()).bit_length()))):
                votes = planes[b].take(at, axis=1) if b < len(planes) else np.zeros((len(h), len(at)), U)
                least = np.where(half >> b & 1, full, zero)
                more |= same & votes & ~least
                same &= ~(votes ^ least)
            out[:, place[one]] = more
            begin, length, place = begin[~one], length[~one], place[~one]
            if not len(place):
                break
        pairs = (length + 1) >> 1
        ends = np.cumsum(pairs)
        left = 2 * np.arange(ends[-1]) + np.repeat(begin - 2 * (ends - pairs), pairs)
        right, single = np.minimum(left + 1, planes[0].shape[1] - 1), (ends - 1)[(length & 1) == 1]
        carry, added = None, []
        for plane in planes:
            x, y = plane.take(left, axis=1), plane.take(right, axis=1)
            y[:, single] = zero
            either, both = x ^ y, x & y
            added.append(either if carry is None else either ^ carry)
            carry = both if carry is None else both | (either & carry)
        planes = [*added, carry] if carry.any() else added
        begin, length = ends - pairs, pairs
    return out


def _deal(h, size, owner, c):
    """(line of each key, keys) of features that are dealt to the blocks of their line's class, c (below 0: no keys)."""
    import numpy as np

    blocks = np.where(c < len(BLOCKS), np.array(BLOCKS)[np.clip(c, 0, len(BLOCKS) - 1)], BLOCKS[-1] << np.maximum(c - len(BLOCKS) + 1, 0))
    looked, least = np.minimum(blocks, TABLES), np.array(LEAST)[np.clip(c, 0, len(LEAST) - 1)]
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for turn in range(TABLES):
        at = np.flatnonzero(((c >= 0) & (turn < TABLES // looked))[owner])
        if not len(at):
            break
        # Blocks are powers of two.
        place = (mix(h[at] + U(turn + 1)) >> U(33)).astype(np.int64) & (blocks - 1)[owner[at]]
        near = np.flatnonzero(place < looked[owner[at]])
        # Features are in order of lines, so the runs of a line and block are whole after a sort of small numbers.
        near = near[np.argsort(place[near].astype(np.uint8), kind="stable")]
        at, place = at[near], place[near]
        run = owner[at] * TABLES + place
        begin = np.flatnonzero(np.diff(run, prepend=-1) != 0)
        line = run[begin] // TABLES
        enough = np.add.reduceat(size[at], begin) >= least[line] if len(at) else np.zeros(0, bool)
        value, line = _majority(h[at][None], begin)[0][enough] if len(at) else np.zeros(0, U), line[enough]
        with np.errstate(over="ignore"):
            keys.append(mix(value + mix((run[begin][enough] % TABLES + turn * 64 + c[line] * 4096).astype(U))))
        owners.append(line)
    return np.concatenate(owners), np.concatenate(keys)


def _whole(h, size, owner, n: int):
    """The (2, n) words of the whole SimHash of each line; longer words weigh more."""
    import numpy as np

    out = np.zeros((2, n), U)
    if len(h):
        begin, weight = np.flatnonzero(np.diff(owner, prepend=-1) != 0), np.clip(size >> 2, 1, 4)
        out[:, owner[begin]] = _majority(np.stack([h, mix(h)]), begin, weight)
    return out


def simhash_blocks(lines: list[bytes], c: int):
    """((2, lines) words of the whole SimHash, line of each key, keys) of non-empty lines of class c."""
    import numpy as np

    found = _features(lines, int(gram(c)))
    return _whole(*found, len(lines)), *_deal(*found, np.full(len(lines), c))


def trimmed(a, b):
    """a and b without their common ends."""
    for side in (0, 1):
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            same = a[low:mid] == b[low:mid] if not side else a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]
            low, high = (mid, high) if same else (low, mid - 1)
        a, b = (a[low:], b[low:]) if not side else (a[: len(a) - low], b[: len(b) - low])
    return a, b


def at_most(a, b, piece: int = 16) -> int:
    """A number of edits that turns a into b, found by cutting both at a piece that they share."""
    a, b = trimmed(a, b)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > 2 * piece:
        for at in (len(a) // 2, len(a) // 4, 3 * len(a) // 4):
            x = a[at - piece // 2 : at + piece // 2]
            i = b.find(x, max(0, at - piece // 2 - len(b) // 8)) if len(x) == piece else -1
            if i >= 0:
                return at_most(a[: at - piece // 2], b[:i]) + at_most(a[at + piece // 2 :], b[i + piece :])
    return len(b)


def edit_distance(a: bytes | str, b: bytes | str) -> int:
    """Levenshtein distance by bit vectors on whole integers; common ends are cut first."""
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    at: dict = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    m = len(b)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, dist = ones, 0, m
    for c in a:
        match = at.get(c, 0)
        diag = (((match & up) + up) ^ up) | match | down
        rise, fall = down | (~(diag | up) & ones), diag & up
        if rise & top:
            dist += 1
        elif fall & top:
            dist -= 1
        rise = (rise << 1 | 1) & ones
        up = (fall << 1 & ones) | (~(diag | rise) & ones)
        down = rise & diag
    return dist


def similar(a: str, b: str, threshold: float) -> bool:
    return all_similar([a], [b], threshold)[0]


def all_similar(a: list[str], b: list[str], threshold: float) -> list[bool]:
    """Of each pair, whether its edit similarity is at least the threshold; no line is similar to an empty one."""
    out, rest = [False] * len(a), []
    for k, (x, y) in enumerate(zip(a, b)):
        longer, shorter = max(len(x), len(y)), min(len(x), len(y))
        most = (1 - threshold) * longer + 1e-9
        if not shorter or longer - shorter > most:
            continue
        x, y = trimmed(x, y)
        if at_most(x, y) <= most:
            out[k] = True
        elif abs(len(x) - len(y)) <= most:
            x, y = sorted((x, y), key=len)
            rest.append((len(y), k, x, y, most))
    rest.sort(key=lambda r: -r[0])
    while rest:
        # Pairs of like length, as many as the tables hold.
        n = rest[0][0]
        size = next((i for i, r in enumerate(rest) if 2 * r[0] < n), len(rest))
        words = -(-max((len(r[2]) for r in rest[:size]), default=0) // 64)
        size = min(size, max(1, TABLE // (8 * max(words, 1) * LETTERS)))
        part, rest = rest[:size], rest[size:]
        close = _within(part, words) if words and len(part) >= MANY + 8 * min(words, 2 + int(2 * max(r[4] for r in part)) // 64) else None
        if close is None:
            close = [edit_distance(r[2], r[3]) <= r[4] for r in part]
        for r, ok in zip(part, close):
            out[r[1]] = bool(ok)
    return out


def _within(pairs, words: int):
    """Of (length of long, _, short, long, most), longest first, whether the edit distance is at most `most`; None with more than LETTERS letters.

    Myers' bit vectors over all pairs at once, of the words that lie within the largest `most` of the diagonal: what
    these leave out counts as one edit a step, so that distances up to it are right and others no smaller than they are.
    """
    import numpy as np

    p, q = (np.frombuffer("".join(r[i] for r in pairs).encode("utf-32-le", "surrogatepass"), np.uint32) for i in (2, 3))
    letters = np.unique(np.concatenate([np.unique(p), np.unique(q)]))
    if len(letters) > LETTERS:
        return None
    m, n = (np.array([len(r[i]) for r in pairs]) for i in (2, 3))
    spread = [(np.repeat(np.arange(len(pairs)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) for size in (m, n)]
    (of, at), (owner, column) = spread
    table = np.zeros((len(pairs) * len(letters), words), U)
    np.add.at(table.ravel(), (of * len(letters) + np.searchsorted(letters, p)) * words + (at >> 6), U(1) << (at & 63).astype(U))
    t = np.zeros((int(n[0]), len(pairs)), np.int32)
    t[column, owner] = owner * len(letters) + np.searchsorted(letters, q)
    most = np.array([r[4] for r in pairs])
    band, live = int(most.max()) + 1, len(pairs)
    ends = np.searchsorted(-n, -np.arange(1, len(t) + 1), side="right")
    up, down = np.full((words, live), ~U(0)), np.zeros((words, live), U)
    top, first, far = np.zeros(live, np.int64), 0, np.zeros(live, np.int64)
    one, high = U(1), U(63)
    for k in range(len(t)):
        if ends[k] < live:
            # Texts that ended: the distance is the sum of the steps down their last column.
            live = _last(far, up, down, top, first, m, int(ends[k]), live, k)
        while first < words - 1 and 64 * (first + 1) <= k - band:
            top[:live] += np.bitwise_count(up[first, :live]).astype(np.int64) - np.bitwise_count(down[first, :live])
            first += 1
        match = table[t[k, :live]].T
        rise_in, fall_in = one, U(0)
        for w in range(first, min(words, (k + band) // 64 + 1)):
            eq, a, b = match[w], up[w, :live], down[w, :live]
            diag = eq | b
            eq = eq | fall_in
            over = (((eq & a) + a) ^ a) | eq
            rise, fall = b | ~(over | a), a & over
            rise_out, fall_out = rise >> high, fall >> high
            rise, fall = rise << one | rise_in, fall << one | fall_in
            rise_in, fall_in = rise_out, fall_out
            a[:], b[:] = fall | ~(diag | rise), rise & diag
    _last(far, up, down, top, first, m, 0, live, len(t))
    return far <= most


def _last(far, up, down, top, first: int, m, begin: int, end: int, columns: int) -> int:
    """Sets far of the pairs from begin to end, whose texts have that many columns."""
    import numpy as np

    far[begin:end] = top[begin:end] + columns
    for w in range(first, len(up)):
        mask = np.clip(m[begin:end] - 64 * w, 0, 64)
        mask = np.where(mask == 64, ~U(0), (U(1) << np.minimum(mask, 63).astype(U)) - U(1))
        far[begin:end] += np.bitwise_count(up[w, begin:end] & mask).astype(np.int64) - np.bitwise_count(down[w, begin:end] & mask)
    return begin


def _size(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


def _digest(line: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(line, digest_size=16).digest()


def _scan(threshold: float):
    """A row of SCAN for each line that is not blank: its 128-bit digest, and (v) keys and whole SimHash for its one or two classes.

    v holds words of 64 bits: size and numbers of keys, the whole SimHash, the keys; then the same for the second class, if it has keys.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold()
        for batch in slices(batches, "text", SLICE):
            spots, place = [], {}
            for i, text in enumerate(batch.column(2).to_pylist()):
                for n, x in enumerate(normalised(text) if text is not None else ()):
                    if x:
                        spots.append((i, n, place.setdefault(x, len(place))))
            if not spots:
                continue
            lines = list(place)
            size = np.array([_size(x) for x in lines])
            sides = [(c, gram(c), np.zeros((2, len(lines)), U), []) for c in classes(size, threshold)]
            for k in {*GRAMS, 0}:
                mine = [(c >= 0) & (g == k) for c, g, _, _ in sides]
                at = np.flatnonzero(mine[0] | mine[1])
                if not len(at):
                    continue
                found = _features([lines[j] for j in at], k)
                whole = _whole(*found, len(at))
                for (c, _, all_whole, keys), has in zip(sides, mine):
                    all_whole[:, at[has[at]]] = whole[:, has[at]]
                    line, key = _deal(*found, np.where(has[at], c[at], -1))
                    keys.append((at[line], key))
            docs, nth, of = (np.array(v, np.int64) for v in zip(*spots))
            # Keys stand with the first place of a line in the slice only; lines are numbered by that.
            first = np.zeros(len(of), bool)
            first[np.unique(of, return_index=True)[1]] = True
            digests = [_digest(x) for x in lines]
            cols = [batch.column(0).take(pa.array(docs)), batch.column(1).take(pa.array(docs)), pa.array(nth, pa.int32()), pa.array([digests[k] for k in of], pa.binary())]
            found = [tuple(np.concatenate(v) for v in zip(*keys)) for _, _, _, keys in sides]
            n, more = (np.bincount(line, minlength=len(lines)) for line, _ in found)
            words = 3 + n + np.where(more > 0, 2 + more, 0)
            at, v = np.cumsum(words) - words, np.zeros(words.sum(), np.int64)
            v[at] = size | n << 40 | more << 48
            for (line, key), (_, _, whole, _), begin, count in zip(found, sides, (at + 1, at + 3 + n), (n, more)):
                has = count > 0 if begin[0] != 1 else np.ones(len(lines), bool)
                for k in (0, 1):
                    v[begin[has] + k] = whole[k][has].view(np.int64)
                v[np.repeat(begin + 2 - (np.cumsum(count) - count), count) + np.arange(len(key))] = key[np.argsort(line, kind="stable")].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(first, 8 * words[of], 0))]).astype(np.int32)
            cols.append(pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(v)]))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCAN.split(", ")])

    return run


def _texts(batches):
    import pyarrow as pa

    for batch in slices(batches, "text"):
        lines = list({x: None for t in batch.column(0).to_pylist() for x in normalised(t or "") if x})
        yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in lines], pa.binary()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], names=["digest", "line"])


def _runs(batches, names: list[str]):
    """Whole runs of rows with one cell, many at a time, as dicts of arrays."""
    import numpy as np

    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
        key = g["cell"]
        if rest and rest[-1]["cell"][-1] == key[-1]:
            rest.append(g)
            continue
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        done = [*rest, {c: v[:cut] for c, v in g.items()}]
        if sum(len(x["cell"]) for x in done):
            yield {c: np.concatenate([x[c] for x in done]) for c in names}
        rest = [{c: v[cut:] for c, v in g.items()}]
    if rest:
        yield {c: np.concatenate([x[c] for x in rest]) for c in names}


def _candidates(g, threshold: float):
    """Pairs (i, j, distance of SimHashes) of rows of one cell, sorted by cell and size, that fit; those of one gap at a time."""
    import numpy as np

    i, lag = np.arange(len(g["cell"]) - 1), 1
    s0, s1, size = g["s0"].view(U), g["s1"].view(U), g["size"].astype(np.int64)
    while len(i):
        i = i[i + lag < len(size)]
        j = i + lag
        i = i[(g["cell"][i] == g["cell"][j]) & (size[i] >= threshold * size[j] - 1e-9)]
        j = i + lag
        far = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
        near = np.flatnonzero(far <= np.where(size[j] < 4 * SHORT, WIDE_RADIUS, RADIUS))
        if len(near):
            yield i[near], j[near], far[near]
        lag += 1


def _unpacked_rows(ids, v):
    """The rows (ROW) of lines, one for each key, from their ids and what _scan packed."""
    import numpy as np
    import pyarrow as pa

    v = v.cast(pa.binary())
    off = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
    words, at = np.frombuffer(v.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.int64), (off[:-1] - off[0]) // 8
    head, ids = words[at], ids.to_numpy(zero_copy_only=False)
    n, more = head >> 40 & 255, head >> 48
    out = np.zeros(int(n.sum() + more.sum()), ROW)
    done = 0
    for begin, count in ((at + 1, n), (at + 3 + n, more)):
        line = np.repeat(np.arange(len(ids)), count)
        part = out[done : done + len(line)]
        first = begin[line]
        part["key"] = words[first + 2 + np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)].view(U)
        part["s0"], part["s1"] = words[first].view(U), words[first + 1].view(U)
        part["id"], part["size"] = ids[line], (head & ((1 << 40) - 1))[line]
        done += len(line)
    return out


def _keys(batches):
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked_rows(batch.column(0), batch.column(1))["key"].view("<i8"))], names=["block"])


def _cells(rows, hot):
    """(cell, parts of its bucket) of packed rows: buckets in hot (keys, parts) are dealt to cells by id."""
    import numpy as np

    cell, parts = rows["key"].copy(), np.ones(len(rows), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], cell), len(hot[0]) - 1)
        is_hot = np.flatnonzero(hot[0][at] == cell)
        parts[is_hot] = hot[1][at[is_hot]]
        with np.errstate(over="ignore"):
            own = mix(mix(rows["id"][is_hot].astype(U)) + cell[is_hot]) % parts[is_hot].astype(U)
            cell[is_hot] = mix(cell[is_hot] + mix(own + U(1)))
    return cell, parts


def _dealing(parts: int, turn: int, hot):
    """Packed rows of the buckets of a turn, in runs by part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def runs(waiting):
            rows = np.concatenate(waiting)
            part = (_cells(rows, hot)[0] >> U(32)).astype(np.int64) & (parts - 1)
            rows = rows[np.argsort(part.astype(np.uint16), kind="stable")]
            count = np.bincount(part, minlength=parts)
            has = np.flatnonzero(count)
            ends = np.concatenate([[0], np.cumsum(count[has] * rows.itemsize)]).astype(np.int32)
            z = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), z], names=["part", "z"])

        waiting, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _unpacked_rows(batch.column(0), batch.column(1))
            waiting.append(rows[rows["key"] % U(ROUNDS) == turn])
            n += len(waiting[-1])
            if n >= DEAL:
                yield runs(waiting)
                waiting, n = [], 0
        if n:
            yield runs(waiting)
        give_back()

    return run


def _mates(threshold: float, hot):
    """Rows that have a candidate in their cell, with the nearest, from packed rows sorted by part; of a bucket of several parts all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, t in grouped(batches, "part"):
            rows = np.frombuffer(b"".join(t.column("z").to_pylist()), ROW)
            cell, parts = _cells(rows, hot)
            order = np.argsort(cell)
            # Most keys have one line only.
            twin = cell[order[1:]] == cell[order[:-1]]
            at = order[np.append(twin, False) | np.concatenate([[False], twin]) | (parts[order] > 1)]
            at = at[np.lexsort((rows["id"][at], rows["size"][at], cell[at]))]
            rows, parts = rows[at], parts[at]
            g = {"cell": cell[at], **{c: np.ascontiguousarray(rows[c]) for c in ("id", "size", "s0", "s1")}}
            none = np.iinfo(np.int64).max
            best = np.full(len(at), none)
            for i, j, far in _candidates(g, threshold):
                best[i] = np.minimum(best[i], far << 48 | j)
                best[j] = np.minimum(best[j], far << 48 | i)
            has = best < none
            at = np.flatnonzero(has | (parts > 1))
            if len(at):
                mate = pa.array(g["id"][np.where(has, best & ((1 << 48) - 1), 0)][at], mask=~has[at])
                cols = [np.ascontiguousarray(rows["key"][at]).view(np.int64), g["id"][at], g["size"][at], g["s0"][at].view(np.int64), g["s1"][at].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), mate, pa.array(parts[at])], names=[x.split()[0] for x in MARKED.split(", ")])
        give_back()

    return run


def _verify(threshold: float):
    def run(batches):
        import pyarrow as pa

        def similar_of(waiting):
            t = pa.Table.from_batches(waiting)
            ok = pa.array(all_similar(t.column(2).to_pylist(), t.column(3).to_pylist(), threshold), pa.bool_())
            return pa.RecordBatch.from_arrays([t.column(i).filter(ok).combine_chunks() for i in (0, 1)], names=["a", "b"])

        waiting, n, size = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= PAIRS or size >= PAIR_BYTES:
                yield similar_of(waiting)
                waiting, n, size = [], 0, 0
        if n:
            yield similar_of(waiting)
        give_back()

    return run


APART = [*ROWS, "block", "comp", "home"]


def _apart(threshold: float):
    """Rows that have a candidate in another group in their cell; one of the two is at home there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for g in _runs(batches, APART):
            has = np.zeros(len(g["cell"]), bool)
            for i, j, _ in _candidates(g, threshold):
                ok = (g["comp"][i] != g["comp"][j]) & (g["home"][i] | g["home"][j])
                has[i[ok]] = True
                has[j[ok]] = True
            if has.any():
                yield pa.RecordBatch.from_arrays([pa.array(g[c][has]) for c in APART], names=APART)

    return run


def _key_set(v: bytes) -> frozenset:
    """The keys that _scan packed."""
    import numpy as np

    words = np.frombuffer(v, np.int64)
    n = int(words[0]) >> 40 & 255
    return frozenset([*words[3 : 3 + n].tolist(), *words[5 + n :].tolist()])


def _link(threshold: float):
    """Links of each cell between groups that no link of its cells has joined yet. A pair is looked at under the least key that both lines have."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in _whole_cells(batches):
            g = {c: t.column(c).to_numpy() for c in APART}
            text, keys = t.column("line"), [_key_set(v) for v in t.column("v").to_pylist()]
            block = g["block"].tolist()
            root = {x: x for x in g["comp"].tolist()}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def links(i, j):
                ends = [(find(a), find(b)) for a, b in zip(g["comp"][i].tolist(), g["comp"][j].tolist())]
                left = np.array([a != b and min(keys[x] & keys[y]) == block[x] for (a, b), x, y in zip(ends, i.tolist(), j.tolist())], bool)
                i, j = i[left], j[left]
                upto = np.cumsum(g["size"][i].astype(np.int64) + g["size"][j])
                cuts = np.searchsorted(upto, np.arange(PAIR_BYTES, upto[-1] if len(upto) else 0, PAIR_BYTES))
                for some in zip(np.split(i, cuts), np.split(j, cuts)):
                    yield from compared(*some)

            def compared(i, j):
                ok = np.array(all_similar(text.take(pa.array(i)).to_pylist(), text.take(pa.array(j)).to_pylist(), threshold), bool)
                for x, y in zip(i[ok].tolist(), j[ok].tolist()):
                    a, b = find(int(g["comp"][x])), find(int(g["comp"][y]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield g["id"][x], g["id"][y]

            out, waiting, n = [], [], 0
            for i, j, _ in _candidates(g, threshold):
                ok = (g["comp"][i] != g["comp"][j]) & (g["home"][i] | g["home"][j])
                waiting.append((i[ok], j[ok]))
                n += ok.sum()
                if n > PAIRS:
                    out += links(*(np.concatenate(x) for x in zip(*waiting)))
                    waiting, n = [], 0
            if n:
                out += links(*(np.concatenate(x) for x in zip(*waiting)))
            cols = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["a", "b"])

    return run


def _whole_cells(batches):
    """Tables of whole cells, from batches sorted by cell."""
    import pyarrow as pa

    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index("cell")).to_numpy()
        cut = int((key != key[-1]).nonzero()[0][-1]) + 1 if key[0] != key[-1] else 0
        if cut or (rest and rest[-1].column(0)[-1].as_py() != key[0]):
            done = [*rest, batch.slice(0, cut)]
            rest = []
            yield pa.Table.from_batches([x for x in done if x.num_rows])
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _strip(carry: tuple):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in slices(batches, "text"):
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            out = []
            for text, drop in zip(col["text"].to_pylist(), col["gone"].to_pylist()):
                gone = set(drop or ())
                lines = text.split("\n") if text is not None else []
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if text is not None else None
                out.append((len(lines), len(gone), kept, hashlib.sha256((kept or "").encode("utf-8", "replace")).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            new = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([col["doc_id"], col["row_key"], *new, *(col[c] for c in carry)], names=["doc_id", "row_key", "n_lines", "n_removed", "kept", "kept_sha256", *carry])

    return run


def _scanned(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(scan, lines): the lines of docs(doc_id, row_key, text) that are not blank, and the different ones with an id each."""
    scanned = materialize(docs.select("doc_id", "row_key", "text").mapInArrow(_scan(threshold), SCAN), "scan")
    # Of equal lines any that has its keys; they are the same in all that have.
    lines = scanned.groupBy("digest").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("first"), F.count("*").alias("n"), F.max_by("v", F.length("v")).alias("v"))
    # The ids are those of this one table; nothing computes them again.
    return scanned, materialize(lines.select(F.monotonically_increasing_id().alias("id"), "digest", "first", "n", "v"), "lines")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "size", "id")


def _hot(lines: DataFrame):
    """(keys, parts), sorted, of buckets over BLOCK rows as a sample of the lines shows: at most a key for BLOCK / SAMPLE sampled rows."""
    import numpy as np

    few = lines.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("id", "v").mapInArrow(_keys, "block long")
    hot = few.groupBy("block").agg(F.ceil(F.count("*") * SAMPLE / BLOCK).cast("long").alias("parts")).filter(F.col("parts") > 1).toArrow()
    keys, parts = (hot.column(i).to_numpy().astype(kind) for i, kind in enumerate((np.int64, np.int64)))
    order = np.argsort(keys.view(U))
    return keys.view(U)[order], parts[order]


def _marked(lines: DataFrame, threshold: float) -> DataFrame:
    """(block, id, size, s0, s1, mate, parts): rows that have a candidate, or that are in a bucket of several parts."""
    spark = lines.sparkSession
    hot = _hot(lines)
    rows = lines.count() * TABLES // ROUNDS
    parts = min(max(16, 1 << (rows // PART).bit_length()), MOST_PARTS)
    out = None
    for r in range(ROUNDS):
        dealt = lines.select("id", "v").mapInArrow(_dealing(parts, r, hot), "part int, z binary").repartition("part").sortWithinPartitions("part")
        m = materialize(dealt.mapInArrow(_mates(threshold, hot), MARKED), "marked")
        out = m if out is None else out.unionByName(m)
        release(spark)
    return out


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) for the rows of wanted(id, digest, row_key), from documents that hold them; most others are dropped where they are read."""
    texts = maybe_in(docs.select("row_key", "text"), wanted, "row_key").select("text").mapInArrow(_texts, "digest binary, line string")
    return maybe_in(texts, wanted, "digest").join(wanted.select("id", "digest"), "digest").groupBy("id").agg(F.first("line").alias("line"))


def _second(marked: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets that hold several groups, dealt to cells where every two groups meet."""
    rows = marked.drop("mate").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    sizes = rows.groupBy("block", "comp", "parts").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("block").agg(F.count("*").alias("groups"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    rows = rows.join(sizes.filter("groups > 1"), "block")
    own = F.pmod(F.xxhash64("id", "block"), F.col("parts"))
    parts = F.when(F.col("comp") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("part", F.explode(parts)).withColumn("home", F.col("part") == own)
    return rows.withColumn("cell", F.xxhash64("block", "part")).select(*APART)


def _links(docs: DataFrame, lines: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((a, b) links between lines, (id, component) of the lines that are linked with another)."""
    marked = _marked(lines, threshold)
    wanted = marked.select("id").distinct().join(lines.select("id", "digest", F.col("first.row_key").alias("row_key")), "id")
    texts = materialize(_fetch(docs, materialize(wanted, "wanted")), "texts")
    pairs = marked.filter("mate is not null").select(F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b")).distinct()
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    links = materialize(pairs.select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long"), "links")
    comp = materialize(connected_components(links), "comp")
    release(docs.sparkSession)
    left = materialize(_dealt(_second(marked, comp)).mapInArrow(_apart(threshold), "cell long, id long, size int, s0 long, s1 long, block long, comp long, home boolean"), "apart")
    rest = materialize(_dealt(left.join(texts, "id").join(lines.select("id", "v"), "id").select(*APART, "line", "v")).mapInArrow(_link(threshold), "a long, b long"), "links")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        comp = materialize(connected_components(links), "comp")
    discard(texts)
    return links, comp


def near_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b) links that join every group of similar lines found in docs(text), by digests of normalised lines."""
    tune(docs.sparkSession)
    docs = docs.select(F.lit(0).cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    lines = _scanned(docs, threshold)[1]
    links, digest = _links(docs, lines, threshold)[0], lines.select("id", "digest")
    links = links.join(digest.toDF("a", "x"), "a").join(digest.toDF("b", "y"), "b")
    return links.select(F.col("x").alias("a"), F.col("y").alias("b"))


def line_dedup(docs: DataFrame, threshold: float = 0.8, carry: tuple = ()) -> DataFrame:
    """(doc_id, row_key, n_lines, n_removed, kept, kept_sha256, and the columns to carry) for each row of docs(doc_id, text).

    Of each group of equal or linked lines the first in order of (doc_id, row_key, line number) stays, null doc_ids
    first; all others go. Lines without letters, digits or other non-ASCII signs are blank and stay. kept: the lines
    left, joined by line feeds (null for a null text). Rows with equal doc_id and text count as one document. Lines are
    known by 128-bit digests. Texts and lines are read whole; other columns are ignored; an empty table gives no row.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text", *carry)
    scanned, lines = _scanned(docs, threshold)
    spots = scanned.select("doc_id", "row_key", "line", "digest")
    _, comp = _links(docs, lines, threshold)
    # Lines that are alone decide for themselves, groups by their first line.
    known = lines.select("id", "digest", "first", "n").join(comp, "id", "left")
    alone = known.filter("component is null and n > 1").select("digest", F.col("first").alias("keep"), "n")
    linked = materialize(known.filter("component is not null"), "linked")
    first = linked.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("n"))
    grouped_ = join_hot(linked.select("component", "digest", F.col("n").alias("occurs")), materialize(first, "first"), "component").select("digest", "keep", F.col("occurs").alias("n"))
    verdict = materialize(alone.unionByName(grouped_), "verdict")
    gone = join_hot(spots, verdict, "digest").filter(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("row_key") == F.col("keep.row_key")) & (F.col("line") == F.col("keep.line"))))
    gone = materialize(gone.select("doc_id", "row_key", "line").distinct().groupBy("doc_id", "row_key").agg(F.collect_list("line").alias("gone")), "gone")
    for done in (scanned, lines, linked, verdict):
        discard(done)
    release(docs.sparkSession)
    d, g = docs.alias("d"), gone.alias("g")
    rows = d.join(g, (F.col("d.row_key") == F.col("g.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    rows = rows.select("d.doc_id", "d.row_key", "d.text", "g.gone", *(F.col(f"d.`{c}`") for c in carry))
    more = "".join(f", `{c}` {t}" for c, t in docs.select(*carry).dtypes)
    return rows.mapInArrow(_strip(carry), "doc_id long, row_key long, n_lines long, n_removed long, kept string, kept_sha256 string" + more)
