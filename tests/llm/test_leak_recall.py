"""Decontamination against brute force over alignments and stretches, by item length and substitutions."""

import random

from attestor.llm import decontaminate as dc

from .conftest import some_text


def brute(doc, item, least):
    best = 0
    for shift in range(1 - len(item), len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
        for i in range(len(item)):
            equal = 0
            for j in range(i, len(item)):
                equal += same[j]
                if 5 * equal >= 4 * (j + 1 - i):
                    best = max(best, equal)
    return best if best >= least else 0


def test_substitutions_are_found_at_every_length(spark):
    rnd = random.Random(3)
    items, docs, want = [], [], {}
    for n in (5, 6, 7, 8, 9, 10, 11, 13, 15, 16, 20, 30):
        item = some_text(rnd, n).split()
        items.append((n, " ".join(item)))
        for changed in range(n // 5 + 2):
            for _ in range(4):
                w = list(item)
                for i in rnd.sample(range(n), changed):
                    w[i] = f"other{rnd.randrange(10**6)}"
                doc = some_text(rnd, 9).split() + w + some_text(rnd, 9).split()
                docs.append((len(docs), " ".join(doc)))
                want[docs[-1][0], n] = brute(doc, item, min(13, -(-4 * n // 5)))
    got = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {}
    for r in got.collect():
        found[r["doc_id"], r["item_id"]] = max(r["equal"], found.get((r["doc_id"], r["item_id"]), 0))
        assert r["equal"] >= 0.8 * (r["stop"] - r["start"])
    assert {k: v for k, v in found.items() if k in want} == {k: v for k, v in want.items() if v}
