import re

import __spark_entry__
import corpus_pipeline
from flowquarry.llm import catalog
from tests.llm import rows as R
from tests.llm.test_jaccard import brute_groups
from tests.llm.test_secrets import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], "web", len(t or "")) for k, (i, t) in enumerate(R.hard_documents())]
    rows.append((900, "my password=abcdefghijklmnop here and now", "en", "web", 40))
    return spark.createDataFrame(rows, COLUMNS)


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_takes_effect(spark, tmp_path):
    sf = tables(spark, tmp_path, documents(spark))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "secret_scan", "mixing", "best_fit_packing"]
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert kept.count() == docs.where(docs.text.rlike(r"\p{L}")).count()
    one = steps["simhash_near_dedup"](spark, kept, sf)
    assert one.columns == docs.columns
    assert one.count() == len(set(brute_groups([r.text for r in kept.collect()]).values()))
    clean = steps["secret_scan"](spark, one, sf)
    assert clean.columns == docs.columns
    assert clean.count() == one.count()
    assert not any(brute(r.text) for r in clean.collect())
    mixed = steps["mixing"](spark, clean, sf)
    assert mixed.columns == docs.columns
    tokens = sum(len(r.text.split()) for r in mixed.collect())
    packed = steps["best_fit_packing"](spark, mixed, sf)
    assert packed.agg({"n_tokens": "sum"}).first()[0] == tokens


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    sf = tables(spark, tmp_path, documents(spark))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), COLUMNS)
    tokens = {}
    for r in docs.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len(r.text.split())
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == tokens


def test_empty_documents(spark, tmp_path):
    sf = tables(spark, tmp_path, spark.createDataFrame([], COLUMNS))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registration():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {re.match(r"op(\d+)_", n)[1] for n in catalog.queries()} == {str(n) for n in range(1, 11)}
    assert set(catalog.queries()) <= names
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
