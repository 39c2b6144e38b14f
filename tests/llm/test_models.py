"""Language identification, quality, toxicity: held-out behaviour, probabilities that sum to one, odd inputs."""

import math
import random

import numpy as np

from attestor.llm import language_id as li, quality as q, toxicity as tx

from .conftest import WORDS


def corpus(spark, n=200):
    rnd = random.Random(4)
    syl = {"en": ["the", "ing", "wh", "ou", "ter"], "fr": ["é", "eau", "que", "oui", "ç"], "de": ["sch", "ung", "ü", "ein", "ß"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(syl))
        rows.append((i, " ".join("".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 80))), lang if i % 17 else None, lang))
    rows += [(n, None, "en", None), (n + 1, "", "fr", None), (n + 2, "123 !!", None, None), (n + 3, "𐐀𐐁 the", "en", None), (None, "the the", "en", None), (n + 4, "İstanbul 日本語", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_language_id(spark):
    docs = corpus(spark)
    m = li.fit(li.gram_counts(docs.filter("doc_id % 2 = 1")))
    got = {r["doc_id"]: r for r in li.identify(docs, m).collect()}
    truth = {r["doc_id"]: r["truth"] for r in docs.filter("truth is not null and doc_id % 2 = 0").collect()}
    assert sum(got[d]["lang_pred"] == t for d, t in truth.items()) >= 0.95 * len(truth)
    assert [got[200 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[200]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["lang_pred"] == "en"


def test_language_rejection_is_calibrated(spark):
    docs = corpus(spark, 600).filter("doc_id < 600")
    m = li.fit(li.gram_counts(docs.filter("doc_id % 3 = 0")))
    m = li.calibrate(m, docs.filter("doc_id % 3 = 1"))
    got = li.identify(docs.filter("doc_id % 3 = 2"), m)
    assert got.filter("rejected").count() <= 0.04 * got.count()
    odd = spark.createDataFrame([(1, "жщюэ цчъыь " * 20), (2, "qzxj vkqz wxzq " * 20)], "doc_id long, text string")
    assert all(r["rejected"] for r in li.identify(odd, m).collect())
    none = li.calibrate(li.fit(li.gram_counts(docs.filter("false"))), docs)
    assert none.langs == [] and li.calibrate(m, docs.filter("false")).limit.tolist() == m.limit.tolist()


def test_language_id_odd_tables(spark, docs, empty):
    """Repeated rows, long texts, clashing columns and empty tables: a row each, the same answer for the same text."""
    m = li.fit(li.gram_counts(docs))
    got = li.identify(docs, m)
    assert got.count() == docs.count() and got.columns == ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
    assert {r["lang_pred"] for r in got.filter("score > 0").collect()} == {"en"}
    assert li.identify(empty, m).count() == 0 and li.gram_counts(empty).count() == 0
    long = spark.createDataFrame([(1, "the " * 300000), (1, "the " * 300000)], "doc_id long, text string")
    assert len({tuple(r) for r in li.identify(long, m).collect()}) == 1


def test_lines_of_the_same_words_in_another_order_differ(spark):
    s = spark.createDataFrame([(1, "a bb ccc\nccc bb a"), (2, "a bb ccc\na bb ccc")], "doc_id long, text string")
    a, b = (dict(zip(q.STATS, r["stats"])) for r in q.document_statistics(s).orderBy("doc_id").collect())
    assert [k for k in q.STATS if a[k] != b[k]]
    assert sum(abs(a[k] - b[k]) for k in q.STATS) >= 0.5


def test_choose_nested_stems():
    rows = [("idio", 0, 40), ("idiot", 0, 40), ("idiots ", 0, 20), ("free ", 30, 30), ("moro", 0, 40), ("moron ", 0, 38)]
    got = tx.choose(rows, 1000, 100)
    assert set(got) == {"idiot", "moro"}


def test_language_models_sum_to_one(spark):
    m = li.fit(li.gram_counts(corpus(spark)))
    for context in (int(m.keys[0]) >> li.BITS, 12345):
        total = 0
        for s in range(1 << li.BITS):
            h, _ = m.entropies(np.array([(context << li.BITS) | s], np.uint32), np.array([0, 1]))
            total = total + np.exp(-h[0])
        assert np.allclose(total, 1, atol=1e-4)


def test_language_id_without_training(spark):
    docs = corpus(spark, 3)
    m = li.fit(li.gram_counts(docs.filter("false")))
    assert {r["lang_pred"] for r in li.identify(docs, m).collect()} == {"und"}


def labelled(spark):
    rnd = random.Random(9)
    rows, gold = [], []
    for i in range(240):
        bad = rnd.random() < 0.3
        text = " ".join(rnd.choice(WORDS) + ("%%%" if bad else "") for _ in range(rnd.randint(5, 60)))
        if i % 4 == 0:
            text += rnd.choice([" what a mor0n", " stupid thing", " you idіot"]) * 2
        rows.append((i, text, 9))
        gold.append((i, int(not bad), int(i % 4 == 0)))
    rows += [(900, None, 9), (901, "", 9), (902, "x" * 100000, 9), (None, "alpha", 9), (0, "alpha twice", 9)]
    gold += [(5, None, None), (900, 1, 0), (3, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int"), spark.createDataFrame(gold, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, gold = labelled(spark)
    rows = q.train_and_score(docs, gold).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in gold.collect() if r["quality"] is not None and r["doc_id"] not in (0, 900, None)}
    good = [r["score"] for r in rows if truth.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if truth.get(r["doc_id"]) == 0]
    assert sum(a > b for a in good for b in bad) > 0.95 * len(good) * len(bad)


def test_quality_without_labels(spark):
    docs, gold = labelled(spark)
    assert {round(r["score"], 1) for r in q.train_and_score(docs, gold.filter("false")).collect()} == {0.5}
    assert q.train_and_score(docs.filter("false"), gold).count() == 0


def test_isotonic():
    out = q.isotonic([1, 1, 0, 1, 1], [0, 1, 0, 0, 1])
    assert list(out) == [0, 0.5, 0.5, 0.5, 1]


def test_toxicity(spark):
    docs, gold = labelled(spark)
    lex = tx.learn(tx.labelled(docs, gold, 4, 2, "toxic"))
    rows = tx.toxicity(docs, lex).collect()
    truth = {r["doc_id"]: r["toxic"] for r in gold.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] not in (0, None) and truth.get(r["doc_id"]) is not None:
            assert (r["score"] >= 0.3) == bool(truth[r["doc_id"]])
    assert tx.reject(docs, lex, 0.3).columns == docs.columns
    assert tx.toxicity(docs.filter("false"), lex).count() == 0
    assert {r["n_hits"] for r in tx.toxicity(docs, tx.Lexicon({})).collect()} == {0}


def test_folding_and_exceptions():
    lex = tx.Lexicon({"trash": 8.0, "idiot": 8.0, "moron ": 8.0}, ("trash can",))
    auto = lex.automaton()
    texts = ["You TRASH!", "a trash can here", "1d10t", "іdіоt", "mo​ron", "morons", "distrash", None, "", "id!ot trash can trash"]
    hits, words, norm, score = tx.score_texts(lex, auto, texts)
    assert hits.tolist() == [1, 0, 1, 1, 1, 0, 0, 0, 0, 2]
    assert words[1] == 4 and math.isclose(score[7], 1 / (1 + math.exp(4)))
