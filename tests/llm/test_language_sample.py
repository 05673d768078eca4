"""The labelled sample of language identification is bounded, whatever ids, copies and languages there are."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid


def rows(spark, n):
    text = F.concat(F.lit("word"), F.col("id").cast("string"), F.lit("xyz "), F.when(F.col("id") % 2 == 0, "alpha").otherwise("beta"))
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"))


@pytest.mark.parametrize("doc_id", ["doc_id", "cast(null as long)", "1L"])
def test_sample_does_not_depend_on_ids(spark, doc_id):
    docs = rows(spark, 5000).withColumn("doc_id", F.expr(doc_id))
    sample, languages = langid.labelled_sample(docs, 100, 1000)
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"aa": 100, "bb": 100} and languages == ["aa", "bb"]
    assert sample.distinct().count() == 200


def test_copies_count_once_and_take_no_room(spark):
    docs = rows(spark, 600).unionByName(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("aa").alias("lang")))
    sample, _ = langid.labelled_sample(docs, 5000, 100_000)
    assert sample.where("text = 'the same text'").count() == 1
    assert langid.labelled_sample(docs, 50, 100_000)[0].where("lang = 'bb'").count() == 50


def test_many_languages(spark):
    """1,100 values of lang: each has words of its own, all are told apart."""
    n = 1100
    text = F.concat_ws(" ", *(F.concat(F.lit("abcdefgh"[i]), F.translate((F.col("lang_no") * 7 + i).cast("string"), "0123456789", "qrstuvwxyz")) for i in range(4)))
    docs = spark.range(2 * n).withColumn("lang_no", F.col("id") % n).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("l"), F.lpad((F.col("id") % n).cast("string"), 4, "0")).alias("lang"))
    model = langid.train(docs, rows_per_language=2000, rows=2 * n)
    known = {r.lang: r.text for r in docs.where(~langid.held_out("doc_id")).select("lang", "text").collect()}
    assert model.languages == sorted(known) and len(known) > 1000
    some = sorted(known)[::37]
    assert [p[0] for p in langid.Scorer(model).predict([known[k] for k in some])] == some


def test_long_texts_and_small_tables(spark, monkeypatch):
    docs = rows(spark, 300)
    model = langid.train(docs)
    texts = ["alpha " * 5000 + "word3xyz", "beta", None, "", " ".join(f"word{i}xyz" for i in range(0, 3000, 2)), "alpha beta"] * 3
    want = langid.Scorer(model).predict(texts)
    scorer = langid.Scorer(model)
    scorer.size = 5
    assert scorer.predict(texts) == want
