"""Language identification: codes, held-out accuracy, brute-force decoding and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage.llm import language_id as L

WORDS = {
    "xa": "alpha beta gamma delta epsilon zeta",
    "xb": "über straße schön grüß fähre möge",
    "xc": "élan façade été hôtel crème naïve",
}


def corpus(spark, n=240):
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        words = WORDS[lang].split()
        text = " ".join(words[(i * k) % len(words)] for k in range(1, 12))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_codewords_are_distinct_and_balanced():
    for n in range(2, 12):
        code = L.codewords(n)
        assert code.shape[0] == n and code.shape[1] >= 1
        assert len({tuple(r) for r in code}) == n
        assert all(abs(code[:, k].sum()) < n for k in range(code.shape[1]))
    assert L.codewords(4).shape == (4, 7)


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", L.held_out().alias("h")).collect()}
    assert got[None] is False
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(50))


def test_held_out_accuracy_and_brute_force_decoding(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    assert model.languages == ("xa", "xb", "xc")
    found = L.identify(docs, model, keep=("doc_id", "text", "lang")).collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) == len(held)
    for r in found[:20]:  # decoding by hand: nearest codeword by summed logistic loss
        grams = L.ngram_buckets(r.text.encode())
        margin = model.weights[:, grams].astype(float).sum(axis=1) / np.sqrt(len(grams))
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, row)) for row in model.code]
        assert r.lang_pred == model.languages[int(np.argmin(loss))]
        assert 0.0 <= r.score <= 1.0


def test_training_ignores_held_out_rows_and_null_labels(spark):
    docs = corpus(spark)
    poisoned = docs.withColumn("lang", F.when(L.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in L.fit(poisoned).languages
    nulls = docs.withColumn("lang", F.lit(None).cast("string"))
    model = L.fit(nulls)
    assert model.languages == ()
    assert {r.lang_pred for r in L.identify(docs, model).collect()} == {"und"}


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    odd = spark.createDataFrame(
        [(1, None, "a", 0.5), (2, "", "b", 0.5), (3, "12 34 !!", "c", 0.5), (4, "über schön " * 40000, "d", 0.5),
         (4, "über schön " * 40000, "d", 0.5), (None, "élan été", None, 0.5)],
        "doc_id long, text string, lang_pred string, score double",
    )
    got = L.identify(odd, model).orderBy("doc_id", "text").collect()
    assert [r.lang_pred for r in got] == ["xc", "und", "und", "und", "xb", "xb"]
    assert got[1].score == 0.0 and got[0].held_out is False
    assert got[4] == got[5]
    assert L.identify(odd.limit(0), model).count() == 0


def test_one_language(spark):
    docs = corpus(spark).withColumn("lang", F.lit("only"))
    model = L.fit(docs)
    assert {(r.lang_pred, r.score) for r in L.identify(docs, model).collect()} == {("only", 1.0)}


def test_query_shape(spark):
    from flowtriage.llm.queries import op11_language_id

    got = op11_language_id(spark, "/root/testdata/sf0.001")
    assert got.columns[:5] == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    total = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.count() == total


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="training languages"):
        L.fit(corpus(spark))
