"""The pipeline end to end on the smallest tables, and each stage on odd rows."""

import random

import corpus_pipeline as cp
from attestor.llm import queries

from .conftest import some_text

SF = "/root/testdata/sf0.001"


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == [*cp.COLUMNS, "size", "source_size", "target", "taken", "copies"]
    assert out.filter("text is not null and size <> regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')").count() == 0
    n, ids = out.count(), out.select("doc_id").distinct().count()
    assert 0 < n == ids < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_on_odd_rows(spark, tmp_path):
    rnd = random.Random(3)
    a, b = some_text(rnd, 100), some_text(rnd, 100)
    leak = some_text(rnd, 40)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b, None, None, None), (4, b.replace(" ", "\t", 3), "en", "s", 1), (5, None, "en", "s", 1), (6, "", "en", "s", 1), (7, leak, "en", "s", 1), (None, some_text(rnd, 20), "en", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).columns[:5] == list(cp.COLUMNS), name
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name
    kept = {r["doc_id"] for r in cp.minhash_near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {1, 3, 5, 6, 7, None}
    assert 7 not in {r["doc_id"] for r in cp.benchmark_decontamination(spark, docs, str(tmp_path)).collect()}
    assert {r["doc_id"] for r in cp.line_dedup_stage(spark, docs, str(tmp_path)).collect()} == {1, 3, 5, 6, 7, None}
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_mix_of_repeated_long_and_clashing_rows(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(k, some_text(rnd, rnd.randint(1, 60)), "en", f"s{k % 3}" if k % 4 else None, 1, 7, "x") for k in range(40)]
    rows += [rows[3]] * 3 + [(100, some_text(rnd, 30000), "en", "s1", 1, 7, "x"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, kept string").repartition(3)
    out = cp.mixing(spark, docs, str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in out) == sorted(str(r[:2]) for r in rows)
    assert all(r["size"] == len((r["text"] or "").split()) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in out)


def test_each_query_runs(spark):
    for name, f in queries.QUERIES.items():
        assert f(spark, SF).count() > 0, name
