"""Line dedup, substring dedup and near-dedup against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re

from attestor.llm import _common, line_dedup as ld, minhash_dedup as md, substring_dedup as sd

from .conftest import make_docs


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def union_find(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_match_brute_force(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in md.near_duplicates(docs, 0.85).collect())
    rows = make_docs()
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = sorted({d for d, _ in rows if d is not None})
    edges = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[0] is not None and b[0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                edges.append((ids.index(a[0]), ids.index(b[0])))
    comp = [ids[x] for x in union_find(len(ids), edges)]
    want = sorted((d is None, d or 0, len(s), comp[ids.index(d)] if d is not None else 0, d is None or comp[ids.index(d)] == d) for (d, _), s in zip(rows, sets))
    assert got == want


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share a doc_id are one document: a near copy of either links it."""
    rnd = random.Random(12)
    rows, want = [], {}
    for k in range(12):
        a, b = ([f"w{rnd.randrange(10**6)}" for _ in range(120)] for _ in range(2))
        near = [[*x[:60], "other", *x[61:]] for x in (a, b)]
        ids = (1000 - 10 * k, 1001 - 10 * k, 1002 - 10 * k)
        # The first id has two texts; the others are near copies of one each.
        rows += [(ids[0], " ".join(a)), (ids[0], " ".join(b)), (ids[0], None), (ids[1], " ".join(near[0])), (ids[2], " ".join(near[1]))]
        want.update(dict.fromkeys(ids, ids[0]))
    got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 0.85).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)


def test_near_duplicates_in_blocks(docs, monkeypatch):
    whole = sorted(map(str, md.near_duplicates(docs, 0.85).collect()))
    monkeypatch.setattr(md, "BLOCK", 4)
    monkeypatch.setattr(_common, "HOT", 3)
    assert sorted(map(str, md.near_duplicates(docs, 0.85).collect())) == whole


def test_sketch_fills_and_estimates():
    import numpy as np

    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], rnd.integers(0, 2**63, 300).astype(np.uint64)])
    kept, s = md.sketch([np.unique(a), np.unique(b), a[:1], a[:0]], 256)
    assert kept == [0, 1, 2] and (s != 2**64 - 1).all()
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.12


def test_substring_dedup_matches_brute_force(docs):
    rows = make_docs()
    first: dict = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - 49):
                if first[tuple(w[i : i + 50])] < d:
                    gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for batches in (1, 3):
        got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.substring_dedup(docs, batches=batches).collect()]
        assert sorted(got) == sorted(want)


def test_index_compacts(spark, docs):
    index = sd.FingerprintIndex(spark)
    s = sd.scan(docs)
    for k in range(3):
        index.add(s.filter(f"doc_id % 3 = {k}"), docs)
    assert len(index.runs) <= 2
    index.compact()
    h = index.history()
    assert len(index.runs) == 1 and h.count() == h.select("anchor", "context").distinct().count()
    index.close()


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 80))) for _ in range(2))
        assert ld.edit_distance(a, b) == plain(a, b)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abcé東") for _ in range(rnd.choice((0, 1, 5, 63, 64, 65, 130, 300))))
        b = list(a)
        for _ in range(int(len(a) * rnd.random() * 0.5)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 1)] = rnd.choice(("", "x", "yz"))
        pairs.append((a, "".join(b)) if rnd.random() < 0.5 else ("".join(b), a))
    near = [max(map(len, p)) > 0 and plain(*p) <= 0.2 * max(map(len, p)) + 1e-9 for p in pairs]
    assert ld.all_similar(*zip(*pairs), 0.8) == near == [ld.similar(a, b, 0.8) for a, b in pairs]
    assert 50 < sum(near) < 350


def line_fixture():
    rnd = random.Random(2)
    line = " ".join(f"longword{rnd.randrange(500)}" for _ in range(60))
    near = line.replace("longword", "longward", 1)
    rows = [(i, f"Head {i}.\n{line if i % 2 else near}\n\ntail {rnd.random()}") for i in range(8)]
    return rows + [(20, None), (21, ""), (22, "\n\n"), (23, "HEAD 9!"), (24, "z" * 60000), (25, "z" * 59999 + "y"), (26, line + "\n" + line), (26, line + "\n" + line)]


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    rows = line_fixture()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, gone string, line long").repartition(3)
    spots = [(d, k, n, x) for d, t in dict.fromkeys(rows) for k, (n, x) in enumerate(enumerate(ld.normalised(t or ""))) if x]
    lines = list(dict.fromkeys(x for *_, x in spots))
    edges = [(i, j) for i in range(len(lines)) for j in range(i) if ld.similar(lines[i].decode(), lines[j].decode(), 0.8)]
    root = union_find(len(lines), edges)
    seen, want = set(), {}
    for d, _, n, x in sorted(spots, key=lambda s: (s[0], s[2])):
        g = root[lines.index(x)]
        if g in seen:
            want.setdefault(d, set()).add(n)
        seen.add(g)
    assert edges
    for block in (1024, 2):
        # Small blocks: buckets are dealt to parts, and hot lines are joined apart.
        monkeypatch.setattr(ld, "BLOCK", block)
        monkeypatch.setattr(ld, "SAMPLE", 64 if block > 2 else 1)
        monkeypatch.setattr(_common, "HOT", 1000 if block > 2 else 2)
        got = {}
        for r in ld.line_dedup(df).collect():
            got[r["doc_id"]] = r["n_removed"]
            if r["doc_id"] == 20:
                assert r["kept"] is None
        assert got == {d: len(want.get(d, ())) for d, _ in rows}


def test_empty_tables(empty):
    assert md.near_duplicates(empty).count() == 0
    assert sd.substring_dedup(empty).count() == 0
    assert ld.line_dedup(empty).count() == 0
