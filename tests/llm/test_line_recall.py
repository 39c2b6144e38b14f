"""Links of line dedup against brute force on edit similarity alone."""

import random
from collections import Counter

from attestor.llm import line_dedup as ld


def lines_and_changes():
    """(line, changed line) by kind: a letter, a word, a tenth of the words, a fifth of the letters' worth in whole words."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    pairs = []
    for n in (4, 8, 14, 25, 45, 80):
        for kind in ("letter", "word", "tenth", "cut"):
            for _ in range(25):
                w = [word() for _ in range(n)]
                v = list(w)
                if kind == "letter":
                    i = rnd.randrange(n)
                    at = rnd.randrange(len(v[i]))
                    v[i] = v[i][:at] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + v[i][at + 1 :]
                elif kind == "cut":
                    v = v[max(1, n // 8) :]
                else:
                    for i in rnd.sample(range(n), 1 if kind == "word" else max(1, n // 10)):
                        v[i] = word()
                pairs.append((kind, " ".join(w).encode(), " ".join(v).encode()))
    return pairs


def test_links_by_edit_similarity_alone(spark):
    pairs = [p for p in lines_and_changes() if p[1] != p[2] and ld.similar(p[1].decode(), p[2].decode(), 0.8)]
    lines = list(dict.fromkeys(x for _, a, b in pairs for x in (a, b)))
    docs = spark.createDataFrame([("\n".join(x.decode() for x in lines[k::7]),) for k in range(7)], "text string")
    ids = {ld._digest(x): x for x in lines}
    found = {frozenset((ids[bytes(r["a"])], ids[bytes(r["b"])])) for r in ld.near_lines(docs).collect()}
    # Nothing that is not similar is linked, and of each kind nearly all that is.
    assert all(ld.similar(*(x.decode() for x in p), 0.8) for p in found)
    all_of, got = Counter(), Counter()
    for kind, a, b in pairs:
        all_of[kind] += 1
        got[kind] += frozenset((a, b)) in found
    assert all_of["letter"] >= 140 and all(n >= 60 for n in all_of.values())
    assert all(got[k] >= 0.98 * n for k, n in all_of.items()), (got, all_of)


def test_links_of_real_lines(spark):
    """All pairs of lines of a table by edit similarity alone: nine tenths of the pairs are found, and nearly all in one group."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = sorted({x for r in docs.collect() for x in ld.normalised(r["text"] or "") if x}, key=ld._size)
    text, size = [x.decode() for x in lines], np.array([ld._size(x) for x in lines])
    letters = sorted(set("".join(text)))
    counts = np.array([[x.count(c) for c in letters] for x in text])
    pairs = []
    for i in range(len(lines)):
        j = np.arange(i + 1, np.searchsorted(size, size[i] / 0.8 + 1e-9, side="right"))
        # A bound that loses nothing: an edit changes the counts of letters by two at most.
        j = j[np.abs(counts[j] - counts[i]).sum(axis=1) <= 2 * (0.2 * size[j] + 1e-9)]
        pairs += [(i, int(k)) for k, ok in zip(j, ld.all_similar([text[i]] * len(j), [text[k] for k in j], 0.8)) if ok]
    digests = {ld._digest(x): i for i, x in enumerate(lines)}
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in ld.near_lines(docs).collect():
        a, b = digests[bytes(r["a"])], digests[bytes(r["b"])]
        assert ld.similar(text[a], text[b], 0.8)
        root[find(a)] = find(b)
    assert len(pairs) >= 40
    assert sum(find(a) == find(b) for a, b in pairs) >= 0.98 * len(pairs)


def test_blocks_hold_what_does_not_change():
    """Fewer changed features than blocks leave one block whole, and the whole SimHash tells changed lines from others."""
    import numpy as np

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    for n in (12, 30, 60):
        a = [word() for _ in range(n)]
        b = list(a)
        b[rnd.randrange(n)] = word()
        x, y = (" ".join(w).encode() for w in (a, b))
        c = next(c for c in range(30) if ld.bounds(c, 0.8)[0] <= len(x) < ld.bounds(c, 0.8)[1])
        (whole, _, one), (other, _, two) = ld.simhash_blocks([x], c), ld.simhash_blocks([y], c)
        assert set(one.tolist()) & set(two.tolist())
        assert np.bitwise_count(whole ^ other).sum() <= ld.RADIUS
        far, _, _ = ld.simhash_blocks([" ".join(word() for _ in range(n)).encode()], c)
        assert np.bitwise_count(whole ^ far).sum() > ld.RADIUS


def test_long_pairs_are_compared_many_at_a_time(monkeypatch):
    """Pairs of long lines around the threshold, among them moved passages: as one by one, but in one go."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghij é") for _ in range(n))
    pairs = []
    for _ in range(400):
        n = rnd.choice((600, 640, 900))
        a = text(n)
        moved = rnd.randint(n // 20, n // 6)
        pairs.append((a, text(moved) + a[: n - moved]) if rnd.random() < 0.5 else (a, "".join(c if rnd.random() > 0.22 else "x" for c in a)))
    want = [ld.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert 50 < sum(want) < 350
    alone = []
    plain = ld.edit_distance
    monkeypatch.setattr(ld, "edit_distance", lambda a, b: alone.append(1) or plain(a, b))
    assert ld.all_similar(*zip(*pairs), 0.8) == want
    assert len(alone) < 40


def test_packed_rows_are_whole():
    """Every key of every line is dealt, once, with the size and SimHash of its class."""
    import numpy as np
    import pyarrow as pa

    texts = [f"{' '.join(f'word{(i * j) % 37}' for j in range(i + 1))}\nshort {i}\n\nshort {i}" for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(range(30)), pa.array(texts)], names=["doc_id", "row_key", "text"])
    t = pa.Table.from_batches(list(ld._scan(0.8)([batch])))
    t = t.filter(pa.array([len(v) > 0 for v in t.column("v").to_pylist()])).combine_chunks()
    ids = pa.array(range(t.num_rows))
    rows = ld._unpacked_rows(ids, t.column("v").chunk(0))
    want = [(i, k) for i, v in enumerate(t.column("v").to_pylist()) for k in ld._key_set(v)]
    assert sorted(zip(rows["id"].tolist(), rows["key"].view(np.int64).tolist())) == sorted(want) and len(want) > 200
    hot = np.sort(rows["key"][:3]), np.array([2, 3, 2])
    batch = pa.RecordBatch.from_arrays([ids, t.column("v").chunk(0)], names=["id", "v"])
    dealt = [z for turn in range(ld.ROUNDS) for b in ld._dealing(16, turn, hot)([batch]) for z in b.column("z").to_pylist()]
    assert sorted(np.frombuffer(b"".join(dealt), ld.ROW).tolist()) == sorted(rows.tolist())
