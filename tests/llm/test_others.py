"""Fingerprints, mixing, decontamination and chat formatting: brute force, round trips, odd inputs."""

import hashlib
import random

from pyspark.sql import functions as F

from attestor.llm import chat, chat_queries, decontaminate as dc, fingerprints as fp, mixing as mx

from .conftest import make_docs, some_text


def test_fingerprints(docs):
    last = 1 << 63
    rows = sorted(((last if d is None else d, t or "", d) for d, t in make_docs()), key=lambda r: r[:2])
    want = []
    for i, (_, t, d) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    got = fp.fingerprints(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(set().union(*(prints[100 + i] for i in range(5)))) == 1
    one, two = next(iter(prints[500])), next(iter(prints[100]))
    assert set(fp.decode(fp.merge(one, two))[1]) == set(fp.decode(one)[1]) | set(fp.decode(two)[1])


def test_fingerprints_of_few_rows(spark, empty):
    assert fp.fingerprints(empty).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(5, "ab")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest() and one["near_next"] == 1


def test_containment_of_unequal_texts():
    import pyarrow as pa

    from attestor.llm._kernels import shingle_sets, text_bytes

    rnd = random.Random(1)
    big = some_text(rnd, 8000)
    small = " ".join(big.split()[1000:2000])
    a, b = (fp.retained(s, 8) for s in shingle_sets(*text_bytes(pa.array([big, small])))[0])
    assert fp.likeness(a, b, False) > 0.95


def test_mixing(docs, empty):
    # Without the one document that outweighs all others of its source, sums are fine enough to come near any target.
    docs = docs.filter("doc_id is null or doc_id <> 500")
    rows = mx.mix_sources(docs, seed=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mx.mix_sources(docs.repartition(3), seed=3).collect()))
    assert len(rows) == len(make_docs()) - 1
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and (r["size"] or not r["taken"])
    total = sum(r["size"] for r in rows)
    taken = {}
    for r in rows:
        taken.setdefault((r["source_size"], r["target"]), [0])[0] += r["taken"]
    for (size, target), (t,) in taken.items():
        assert abs(t - target) <= max(1, 0.01 * target) and target <= 2 * size + 1e-6
    assert abs(sum(k[1] for k in taken) - min(1.5 * total, 2 * total)) < 1
    assert mx.mix_sources(empty).count() == 0


def test_fit_hits_the_budget():
    rnd = random.Random(7)
    for _ in range(200):
        counts = {rnd.randint(1, 60): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
        total = sum(s * n for s, n in counts.items())
        budget = rnd.randint(0, total + 5)
        take = mx.fit(counts, budget)
        assert all(0 < n <= counts[s] for s, n in take.items())
        got = sum(s * n for s, n in take.items())
        assert abs(got - min(budget, total)) <= max(counts)
    counts = {1: 50, 7: 20, 30: 10}
    assert all(sum(s * n for s, n in mx.fit(counts, b).items()) == b for b in range(0, 490, 7))


def test_water_fill():
    assert mx.water_fill([10, 10, 0], [3, 1, 2], 30, 2) == [20, 10, 0]
    assert mx.water_fill([], [], 0, 2) == []


def leak_docs(item, rnd):
    w = item.split()
    sub = list(w)
    for i in range(6, len(sub), 9):
        sub[i] = "other"
    return [
        (1, some_text(rnd, 50) + " " + item + " " + some_text(rnd, 50)), (2, " ".join(sub)), (3, some_text(rnd, 30) + " " + " ".join(w[10:26]).upper() + "!"),
        (4, some_text(rnd, 200)), (5, " ".join(w[:6]) + " " + some_text(rnd, 40)), (6, None), (7, ""), (8, " ".join(w[::2])), (None, item), (9, "tiny item here now five"), (9, "clean"),
    ]


def test_decontamination(spark):
    rnd = random.Random(11)
    item = some_text(rnd, 40)
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in leak_docs(item, rnd)], "doc_id long, text string, h string, at int")
    bench = spark.createDataFrame([(0, item, "x"), (1, None, "x"), (2, "short", "x"), (3, "Tiny item, here now five", "x"), (None, some_text(rnd, 30), "x")], "item_id long, text string, words string")
    got = [(r["doc_id"], r["contaminated"], r["first_item"]) for r in dc.contamination(docs, bench).collect()]
    hit = sorted((str(d), i) for d, c, i in got if c)
    assert hit == sorted([("1", 0), ("2", 0), ("3", 0), ("None", 0), ("9", 3)]) and len(got) == 11
    assert dc.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert dc.contamination(docs.filter("false"), bench).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    rnd = random.Random(11)
    item = some_text(rnd, 40)
    docs = spark.createDataFrame(leak_docs(item, rnd), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    a = sorted(map(str, dc.contamination(docs, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    assert sorted(map(str, dc.contamination(docs, bench).collect())) == a


ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|<|", "plain", "", None, "a\nb\r\n", "😀<|", "\\", "%3C%25\n<"]


def test_chat_round_trip(spark):
    rows = [(i, j, r, t, "x") for i in range(3) for j, t in enumerate(ODD) for r in ("user", "assistant", None, "a%<\n|r")]
    rows += [(9, None, "user", "n", "x"), (9, 1, "assistant", "same", "x"), (9, 1, "assistant", "same", "x"), (None, 0, "user", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(chat.from_rows(df)))).collect()}
    for c in {r[0] for r in rows}:
        key = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)
        want = [(r or "", t or "") for _, r, t in sorted(((j, r, t) for i, j, r, t, _ in rows if i == c), key=lambda x: tuple((v is not None, v if v is not None else 0) for v in x))]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["loss_text"] == "".join(t for r, t in want if r == "assistant")
    assert chat.render(chat.fold_events(chat.from_rows(df.filter("false")))).count() == 0


def test_event_fold(spark):
    e = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "He"), (1, 1, 3, "delta", None, "llo"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "Yo"),
        (1, 0, 6, "edit", None, "hey"), (1, 2, 7, "message", "user", "gone"), (1, 2, 8, "delete", None, None), (1, 3, 9, "noise", "user", "x"), (1, 1, 6, "delta", None, "!"), (2, 0, None, "delta", "user", None),
    ]
    df = spark.createDataFrame(e, "conv_id long, message long, seq long, kind string, role string, text string")
    got = sorted((r["conv_id"], r["message"], r["role"], r["text"]) for r in chat.fold_events(df).collect())
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "Yo!"), (2, 0, "user", "")]


def test_chat_query_against_sql(spark):
    from tests import oracle

    oracle.same(chat_queries.op3_chat_formatting(spark, "/root/testdata/sf0.001"), oracle.duck("/root/testdata/sf0.001"), chat_queries.OP3_SQL)


def test_no_python_on_the_native_paths(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    c = spark.createDataFrame([(1, 0, "user", "t")], "conv_id long, turn long, role string, text string")
    for df in (dc.contamination(d, b), chat.read_back(chat.render(chat.fold_events(chat.from_rows(c))))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
        df.agg(F.count("*")).collect()


def test_dedup_queries_match_sql(spark):
    from attestor.llm import queries
    from tests import oracle

    sf = "/root/testdata/sf0.001"
    for name in ("op2_substring_dedup", "op6_minhash_near_dedup"):
        oracle.same(queries.QUERIES[name](spark, sf), oracle.duck(sf), queries.ORACLE_SQL[name])
