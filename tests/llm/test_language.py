import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op6_language_id(spark, SF).join(truth, "doc_id")
    assert found.count() == truth.count()
    held = found.filter("held_out")
    assert 200 < held.count() < 500
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_unlike_texts(spark):
    rows = [(1, "der die das und nicht " * 20, "de", "x"), (2, "the and of with not " * 20, "en", "x"), (3, "?!", "en", "x"), (4, "nur Text", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(df)
    assert model.languages == ("de", "en")
    asked = [(1, "nicht die"), (2, "of the"), (3, None), (4, ""), (5, "123 !?"), (6, "the " * 100_000), (None, "und die"), (2, "of the")]
    found = language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    wanted = [(1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de")]
    assert sorted(((r["doc_id"], r["lang_pred"]) for r in found), key=str) == sorted(wanted, key=str)
    assert {r["score"] for r in found if r["lang_pred"] == "und"} == {0.0}
    kept = language.keep_identified(spark.createDataFrame([(*x, "c") for x in asked], "doc_id long, text string, text2 string"), model)
    assert kept.columns == ["doc_id", "text", "text2"] and kept.count() == 5


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    model = language.fit(df)
    (row,) = language.predict(df, model).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert language.predict(df.limit(0), model).collect() == []


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    models = [language.fit(df.repartition(n), sample_rows=400) for n in (2, 5)]
    assert models[0].languages == ("en",)
    assert models[0].weights == pytest.approx(models[1].weights)


def test_scoring_of_a_long_text_takes_no_row_per_ngram():
    import tracemalloc

    import numpy as np

    generator = np.random.default_rng(1)
    weights = np.log(generator.random((1 << 15, 64)))
    model = language.Model(tuple(f"l{i:02}" for i in range(64)), weights, np.zeros(64))
    text = "".join(map(chr, generator.integers(0x4E00, 0x9000, 400_000)))
    texts = [text, "short text", None, "?!", "another one", text[:9000]]
    tracemalloc.start()
    langs, _ = language.score(model, texts, 1 << 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a row of weights per n-gram would be 400 MB
    for x, lang in zip(texts, langs):
        found = language.ngrams(x or "", 1 << 15)
        assert lang == (model.languages[weights[found].sum(axis=0).argmax()] if len(found) else "und")


def test_a_batch_of_texts_takes_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    generator = np.random.default_rng(2)
    texts = ["".join(map(chr, generator.integers(97, 123, 2000))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    model = language.Model(("a", "b"), np.log(generator.random((1 << 15, 2))), np.zeros(2))
    tracemalloc.start()
    for part in language.by_bytes(iter([batch]), "text", language.BATCH_BYTES):
        language.score(model, part.column("text").to_pylist(), 1 << 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
