import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import catalog, lang_id
from tests.llm import rows as R

SF = "/root/testdata/sf0.01"
TEXTS = {
    "en": ["the river and the stone were with the people", "this is what they would have thought of that"],
    "de": ["der fluss und die steine sind nicht sehr schön", "ich habe das nicht gewusst und wir auch nicht"],
    "fr": ["la rivière et les pierres sont très belles", "nous avons été dans une maison avec des amis"],
}


def labelled(spark, extra=()):
    rows = [(i, t, lang) for lang, texts in TEXTS.items() for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords_differ_and_every_bit_parts_the_languages(n):
    code = lang_id.code_matrix(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
    assert len({tuple(r) for r in code}) == n
    assert (np.abs(code.sum(axis=0)) < n).all()
    if n <= 7:
        assert code.shape[1] == 2 ** (n - 1) - 1


def test_margins_equal_a_sum_over_all_grams(spark):
    model = lang_id.fit(labelled(spark))
    text = "The stones, und la rivière! 42 " + "x" * 60
    total, n = np.zeros(model.weights.shape[1]), 0
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if gram != " " and gram in model.rows:
                    total += model.weights[model.rows[gram]]
                    n += 1
    assert np.allclose(model.margins(text), total / n)


def test_decoding_takes_the_nearest_codeword(spark):
    model = lang_id.fit(labelled(spark))
    rng = np.random.default_rng(0)
    for _ in range(50):
        margins = rng.normal(size=model.code.shape[1]) * model.scale
        losses = [sum(w * math.log1p(math.exp(-c * m / s)) for c, m, s, w in zip(row, margins, model.scale, model.trust, strict=True)) for row in model.code]
        lang, score, ambiguous = model.decode(margins)
        order = sorted(range(len(losses)), key=losses.__getitem__)
        assert lang == model.languages[order[0]]
        assert 0 < score <= 1
        assert ambiguous == (losses[order[1]] - losses[order[0]] < model.gap * model.trust.sum())
    assert model.decode(np.zeros(model.code.shape[1]))[2]


def test_words_remembered_or_not_give_the_same(spark, monkeypatch):
    model = lang_id.fit(labelled(spark))
    text = R.sentence(3, 4000)
    whole = model.margins(text)
    model._cache, model._scores = {}, None
    monkeypatch.setattr(lang_id, "CACHED_WORDS", 6)
    assert np.allclose(model.margins(text), whole)


def test_hard_rows(spark):
    docs = R.hard_documents()
    model = lang_id.fit(labelled(spark, [(None, None, "en"), (1, "text without a language", None), (2, "", "de")]))
    found = R.frame(spark, docs).select("doc_id", "text", lang_id.language(F.col("text"), model).alias("r")).select("doc_id", "text", "r.*").collect()
    assert len(found) == len(docs)
    for r in found:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in TEXTS and 0 <= r.score <= 1
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)


@pytest.mark.parametrize("rows", [[], [(1, None, "en")], [(1, "some text", None)], [(1, "only one language here", "en")]])
def test_little_to_learn_from(spark, rows):
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = R.frame(spark, [(1, "any text"), (2, None)]).select("doc_id", lang_id.language(F.col("text"), model).alias("r")).orderBy("doc_id").collect()
    assert found[0].r.lang_pred == ("en" if rows and rows[0][1] and rows[0][2] else "und")
    assert found[1].r.lang_pred == "und"


def test_empty_table(spark):
    model = lang_id.fit(labelled(spark))
    assert R.empty(spark).select(lang_id.language(F.col("text"), model)).count() == 0


def test_query_on_held_out_documents(spark):
    found = catalog.op1_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    assert sorted(found["doc_id"]) == sorted(docs["doc_id"])
    both = found.merge(docs, on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]] == list(both["held_out"])
    judged = both[both["held_out"] & both["lang"].notna() & (both["lang_pred"] != "und")]
    assert len(judged) > 100
    assert (judged["lang"] == judged["lang_pred"]).mean() > 0.95
    assert ((both["score"] >= 0) & (both["score"] <= 1)).all()


def test_labels_of_the_judged_rows_play_no_part(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lying = docs.withColumn("lang", F.when(lang_id_fold() == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    lying.write.parquet(f"{tmp_path}/documents.parquet")
    a = catalog.op1_language_id(spark, SF).exceptAll(catalog.op1_language_id(spark, str(tmp_path)))
    assert a.count() == 0


def lang_id_fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
