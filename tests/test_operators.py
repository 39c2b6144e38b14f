"""Edge cases of the operators on small frames."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from attestor.functions import dates as D, text as T
from attestor.operators import arithmetic, audit, evaluation, joins, retrieval, rules, scoring, sinks, text as text_ops

from . import oracle


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_as_of_boundaries(spark):
    v = spark.createDataFrame([("a", 10, "v1"), ("a", 20, "v2"), ("a", 20, "v3"), ("b", 5, "w")], "k string, since int, p string")
    f = spark.createDataFrame([("a", 9), ("a", 10), ("a", 19), ("a", 25), ("b", 5), ("c", 1)], "k string, at int")
    got = {(r["k"], r["at"]): (r["effective_from"], r["status"]) for r in joins.as_of(f, v, "k", "at", "since", ["p"]).collect()}
    assert got == {("a", 9): (None, "BEFORE_FIRST"), ("a", 10): (10, "FOUND"), ("a", 19): (10, "FOUND"), ("a", 25): (20, "AMBIGUOUS"), ("b", 5): (5, "FOUND"), ("c", 1): (None, "UNKNOWN")}


def test_interval_hole_and_overlap(spark):
    r = spark.createDataFrame([("a", 0, 9, 1), ("a", 5, None, 2)], "k string, lo int, hi int, p int")
    f = spark.createDataFrame([("a", -1), ("a", 3), ("a", 7), ("a", 50)], "k string, at int")
    got = {x["at"]: (x["p"], x["status"]) for x in joins.interval_lookup(f, r, "k", "at", "lo", "hi", "p").collect()}
    assert got == {-1: (None, "NONE"), 3: (1, "FOUND"), 7: (None, "UNRESOLVED"), 50: (2, "FOUND")}


def test_contradictions_ignore_nulls(spark):
    f = spark.createDataFrame([("x", 1, 5), ("x", 2, None), ("y", 1, 5), ("y", 2, 6), ("z", 1, 5), ("z", 1, 6)], "k string, doc int, v int")
    assert [r["k"] for r in joins.contradictions(f, ["k"], "doc", "v").collect()] == ["y"]


def test_components_chain_and_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    got = dict(rows(joins.components(e)))
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and got[200] == 200


def test_cover_dedupe(spark):
    s = spark.createDataFrame([(1, "x", 0, 10), (1, "y", 2, 5), (1, "z", 8, 12), (1, "w", 8, 11)], "d int, kind string, start int, stop int")
    assert sorted(r["kind"] for r in text_ops.cover_dedupe(s, "d").collect()) == ["x", "z"]


def test_gate_and_confidence_keep_unknown(spark):
    df = spark.createDataFrame([(None, False, 0), (80.0, False, 0), (0.0, False, 0), (0.0, False, 2)], "r double, h boolean, u int")
    assert [r[0] for r in df.select(scoring.gate(F.col("r"), F.col("h"), F.col("u"))).collect()] == ["NOT_ASSESSED", "BLOCK", "PASS", "REVIEW"]
    a = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (1.0, 1.0)], "a double, b double")
    _, verdict = scoring.claim_confidence({"a": (F.col("a"), 0.5), "b": (F.col("b"), 0.5)})
    assert [r[0] for r in a.select(verdict).collect()] == ["UNVERIFIABLE", "HARD_FAIL", "STRONG"]


def test_dates(spark):
    d = lambda *x: dt.date(*x)
    df = spark.createDataFrame([(d(2023, 1, 31), d(2023, 2, 28)), (d(2024, 1, 31), d(2024, 2, 28)), (d(2024, 5, 1), d(2024, 4, 1))], "a date, b date")
    assert rows(df.select(D.months_elapsed(F.col("a"), F.col("b")), D.days_between(F.col("a"), F.col("b")), D.add_period(F.col("a"), months=1))) == [
        (1, 29, d(2023, 2, 28)), (0, 29, d(2024, 2, 29)), (0, None, d(2024, 6, 1)),
    ]
    t = spark.createDataFrame([("on 2024.02.30",), ("on 2024-2-9",), ("none",)], "t string")
    assert rows(t.select(D.parse_date(F.col("t")))) == [(None,), (d(2024, 2, 9),), (None,)]


def test_text_functions(spark):
    df = spark.createDataFrame([("​АВ  c",)], "t string")
    assert rows(df.select(T.match_form(F.col("t")))) == [("ab c",)]
    w = spark.createDataFrame([("a",), ("abc",)], "w string")
    assert rows(w.select(T.bigrams(F.col("w")))) == [(["a"],), (["ab", "bc"],)]
    h = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><b>c</b>",)], "h string")
    assert rows(h.select(T.html_to_text(F.col("h")))) == [("a & b\nc",)]
    n = spark.createDataFrame([("4539578763621486",), ("1234567812345678",)], "n string")
    assert rows(n.select(T.luhn_ok(F.col("n")))) == [(True,), (False,)]


def test_chain_breaks_at_the_forged_row(spark):
    e = spark.createDataFrame([("a", i, f"b{i}") for i in range(5)], "k string, n int, body string")
    s = audit.chain(e, "k", "n", "body").drop("digest")
    assert audit.verify_chain(s, "k", "n", "body").first()["first_broken"] is None
    bad = s.withColumn("link", F.when(F.col("n") == 2, "x").otherwise(F.col("link")))
    assert audit.verify_chain(bad, "k", "n", "body").first()["first_broken"] == 2
    # A link hashes the link before it: a changed body with two new links still shows at the third.
    import hashlib

    good = {r["n"]: r["link"] for r in s.collect()}
    link = lambda before, b: hashlib.sha256((before + b).encode()).hexdigest()
    assert good[0] == link("", "b0") and all(good[i] == link(good[i - 1], f"b{i}") for i in range(1, 5))
    one = link(good[0], "changed")
    two = link(one, "b2")
    bad = s.withColumn("body", F.when(F.col("n") == 1, "changed").otherwise(F.col("body"))).withColumn("link", F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(F.col("link")))
    assert audit.verify_chain(bad, "k", "n", "body").first()["first_broken"] == 3


def test_every_occurrence_of_personal_data(spark):
    docs = spark.createDataFrame([(1, "a@b.co x a@b.co, 010-123-4567"), (2, None), (3, ""), (4, "é a@b.co"), (5, "a@b.co")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["kind"], r["start"], r["stop"]) for r in rules.pii_spans(docs).collect())
    assert got == [(1, "email", 1, 7), (1, "email", 10, 16), (1, "phone", 18, 30), (4, "email", 3, 9), (5, "email", 1, 7)]


def test_contained_items_of_any_length(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "b c d"), (3, "c"), (4, "c d"), (5, "no such words in it at all"), (6, "")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "xa b c d e f g hy"), (2, "b c dd"), (3, None), (4, "d c")], "doc_id int, text string")
    got = sorted(rows(joins.contained(docs, items)))
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 4), (4, 1), (4, 2), (6, 1), (6, 2), (6, 4)]


def test_components_of_all_lines(spark):
    import random

    rnd = random.Random(3)
    edges = [(2 * rnd.randrange(60), 2 * rnd.randrange(60) + 1) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(rows(joins.components(spark.createDataFrame(edges, "a long, b long")))) == root


def test_vectors_in_blocks(spark):
    import random

    rnd = random.Random(4)
    v = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3)
    q = df.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = None
    for block in (1000, 4):
        got = sorted(rows(retrieval.vector_topk(q, df, 3, block)))
        assert want in (None, got) and len(got) == 13 * 3
        want = got


def test_copied_units_of_common_grams(spark):
    """A passage with many near variants keeps all its pairs, and equal texts of several documents say so."""
    base = "the same clause stands in each of these documents word for word with number "
    units = [(d, 0, base + f"{d:02d}") for d in range(70)] + [(200, 0, "x" * 40), (201, 0, "x" * 40), (202, 0, "short"), (203, 0, None)]
    got = joins.copied_units(spark.createDataFrame(units, "doc_id long, block_no int, text string")).collect()
    pairs = {(r["a_doc"], r["b_doc"]) for r in got}
    assert pairs == {(a, b) for b in range(70) for a in range(b)} | {(200, 200)}
    assert next(r["a_docs"] for r in got if r["a_doc"] == 200) == 2


def test_totals_of_tables(spark):
    cells = [("t", 1, "a", 1.0), ("t", 2, "b", 2.0), ("t", 3, "subtotal", 3.0), ("t", 4, "c", 4.0), ("t", 5, "Total", 7.0), ("u", 1, "a", 1.0), ("u", 2, "total", 2.0), ("v", 1, "a", 5.0)]
    got = sorted(rows(arithmetic.total_rows(spark.createDataFrame(cells, "t string, row int, label string, value double"), "t", "row", "label", "value")))
    assert got == [("t", 3, "SUBTOTAL", 3.0, 3.0, True), ("t", 5, "TOTAL", 7.0, 7.0, True), ("u", 2, "TOTAL", 2.0, 1.0, False)]


def test_gaps_before_the_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("a", 4), ("a", 7)], "k string, n int")
    assert sorted(rows(audit.gaps(df, "k", "n", first=1).select("missing_from", "missing_to"))) == [(1, 2), (5, 6)]


def test_matching_is_maximum(spark):
    e = spark.createDataFrame([("d", 1, 1), ("d", 1, 2), ("d", 2, 1), ("d", 3, 1)], "g string, left int, right int")
    assert evaluation.bipartite_matching(e, "g").count() == 2


def test_prf_without_denominator(spark):
    gold = spark.createDataFrame([(1, "a")], "id int, label string")
    found = spark.createDataFrame([(2, "b")], "id int, label string")
    got = {r["label"]: r["recall"] for r in evaluation.prf(gold, found, ["id"]).collect()}
    assert got == {"a": 0.0, "b": None}


def test_csv_sink_defuses_formulas(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", ["a", "b"])], "c string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("'=1+1", "a;b")]


def test_partition_overwrite_keeps_others(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), p, "k")
    sinks.write_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), p, "k")
    assert sorted(rows(spark.read.parquet(p))) == [(1, "a"), (9, "b")]


def test_checklist_and_mask(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now"), (2, "nothing")], "doc_id int, text string")
    items = [("x", "mail", "never")]
    assert rows(rules.checklist_gaps(docs, items)) == [(1, "x")]
    assert rows(docs.select(rules.mask_pii(F.col("text"))))[0] == ("mail [email] now",)


def test_claims_as_sql_on_odd_letters_and_spaces(spark, tmp_path):
    from attestor.plans import extraction

    texts = ["Ends. 　. It wasé 5.", "the éwasé.", "x1 İf so.", "1 énoté.", "is 3 not́.", " A was. ", "2 Was مif.", None, ""]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    oracle.same(extraction.claim_extraction(spark, str(tmp_path)), duck, extraction.R.sql["claim_extraction"])


def test_spaced_letters_as_sql_beside_other_letters(spark, tmp_path):
    from attestor.plans import text

    texts = ["a b c dé", "éa b c d e", "a b c d́", "a b c d_", "я a b c d я", "a b c d eя f g h i", "a " * 100_000, None, ""]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    oracle.same(text.unicode_scan(spark, str(tmp_path)), duck, text.R.sql["unicode_scan"])


def test_copies_write_no_grams(spark, monkeypatch):
    """Every pair of random texts with nine tenths of the smaller set in common, in chunks of any size, without a row per gram."""
    import random

    from attestor.operators import copies

    monkeypatch.setattr(copies, "CHUNK", 4_000)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdé中 ") for _ in range(rnd.randint(30, 90))) for _ in range(60)]
    for t in texts[:40]:
        i = rnd.randrange(len(t))
        texts += [t[:i] + "XY" + t[i + 1 :], t[i:] + t[:i], t + rnd.choice(texts[:60]), t[: max(30, len(t) - 7)]]
    texts = sorted(set(texts))
    cut = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    want = set()
    for y in range(len(texts)):
        for x in range(y):
            a, b = cut(texts[x], 5), cut(texts[y], 5)
            if len(a & b) >= 0.9 * min(len(a), len(b)) and len(cut(texts[x], 8) & cut(texts[y], 8)) >= 3:
                want.add((x, y))
    df = joins.copied_units(spark.createDataFrame([(d, 0, t) for d, t in enumerate(texts)], "doc_id long, block_no int, text string"))
    assert {(r["a_doc"], r["b_doc"]) for r in df.collect()} == want and len(want) > 100
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def _small_words(rnd, size):
    """A text of a few syllables, as real languages have them: its 5-grams are in most others."""
    out = ""
    while len(out) < size:
        out += rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]) + rnd.choice(["", "", " "])
    return out


def test_copies_look_at_few_texts_of_common_grams(monkeypatch):
    """Texts that share their grams but no passages cost few rows per character, however many texts hold a gram."""
    import random
    from types import SimpleNamespace as Held

    import numpy as np
    import pyarrow as pa

    from attestor.operators import copies

    rnd = random.Random(5)
    texts = [_small_words(rnd, rnd.randint(60, 300)) for _ in range(2_000)]
    texts.append(texts[7][3:] + "more")
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["uid", "text"])
    counts = np.zeros(1 << copies.PLACES, np.uint16)
    index = copies._entries(pa.Table.from_batches(list(copies._groups(5, Held(value=counts), 0.1)([rows]))))
    looked, spread = [], copies._spread
    monkeypatch.setattr(copies, "_spread", lambda first, sizes: looked.append(int(np.sum(sizes))) or spread(first, sizes))
    pairs = {p for b in copies._match(5, "test", [Held(value=index)])([rows]) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    assert (7, 2_000) in pairs and all(len(grams[a] & grams[b]) > 0.7 * len(grams[a]) for a, b in pairs)
    # A lookup of the rarest single grams: this many texts for each group.
    df = {}
    for g in grams:
        for x in g:
            df[x] = df.get(x, 0) + 1
    single = sum(sum(sorted(df[x] for x in g)[: len(g) // 10 + 1]) for g in grams)
    assert sum(looked) < single


def test_copies_across_places(spark, tmp_path):
    """Grams of a text may stand in the other one in any places; texts with too many runs of them are looked up by single grams."""
    import random

    from attestor.operators import copies
    from attestor.plans import joins as plans

    rnd = random.Random(9)
    pieces = lambda t: "|".join(t[i : i + 8] for i in range(0, len(t) - 4, 4))
    base = [_small_words(rnd, 90) for _ in range(12)]
    base += ["".join(rnd.choice("ab") for _ in range(40)) for _ in range(6)] + ["".join(rnd.choice("012") for _ in range(n)) for n in (3_000, 60, 40)] + ["ha " * 30, "ha " * 31 + "é😀 end", "x" * 40]
    texts = base + [pieces(t) for t in base[:18]] + [t[:50] + t[40:] for t in base[:12]] + [t + "\n" + t for t in base[:4]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    oracle.same(plans.copied_sentences(spark, str(tmp_path)), duck, plans.R.sql["copied_sentences"])
    # All runs of a text, against a walk over its grams.
    for t in (base[0], pieces(base[0]), base[12], "x" * 40, base[18]):
        u, left, short, h = copies._hashed([t], 5)
        keys, _, over = copies._across(u, left, short, h, 5, 1)
        assert over[0] == (t == base[18])
        if over[0]:
            continue
        at = {t[i : i + 5]: i for i in range(len(t) - 4)}
        runs = [[g] for g in at]
        for _ in range(copies.RUN - 1):
            runs = [[*r, g] for r in runs for g in at if g[:4] == r[-1][1:]]
        want = {int(copies._key(h[[at[r[0]]]], h[[at[r[-1]]]])[0]) for r in runs}
        got = {int(x) for x in keys} | {int(x) for x in copies._key(h[: len(t) - 7], h[3 : len(t) - 4])}
        assert got == want
