"""What the fitted operators learn from, and what counts as a letter."""

from pyspark.sql import functions as F

from ledgerlane.llm import language, toxicity

DOCS = "doc_id long, text string, lang string"


def test_numbers_that_look_like_letters_are_no_words():
    assert language.words_of("½ ² Ⅷ ① 7 _ — ́") == []
    assert language.words_of("Straße x2 naïve été") == ["straße", "x", "naïve", "été"]
    assert language.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]  # vowel signs don't split a word
    assert language.words_of("The 3rd") == ["the", "rd"]


def test_texts_without_a_letter_are_undetermined(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    docs = spark.createDataFrame(rows + [(1000, "½ ²", "en"), (1001, "Ⅷ ① 42", None), (1002, None, "fr"), (1003, "le chat", None)], DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in language.digest(docs).filter("doc_id >= 1000").collect()}
    assert got == {1000: "und", 1001: "und", 1002: "und", 1003: "fr"}


def test_a_repeated_id_is_learned_from_once(spark):
    one = spark.createDataFrame([(7, "the cat and the dog", "en"), (8, "le chat", "fr")], DOCS)
    many = one.unionByName(one.filter("doc_id = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("n"))
    assert sorted(tuple(r) for r in language.sample(many.repartition(8), F.lit(True)).collect()) == [("le chat", "fr"), ("the cat and the dog", "en")]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.sample(many.repartition(8), labels, F.lit(True)).collect()) == [(7, "the cat and the dog", 1), (8, "le chat", 0)]


def test_an_id_with_many_texts_stays_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 15, 0: 10})
    docs = spark.range(5_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    assert language.sample(docs, F.lit(True)).count() == 20
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    assert sorted((r["label"], r["count"]) for r in toxicity.sample(docs, labels, F.lit(True)).groupBy("label").count().collect()) == [(0, 10), (1, 15)]
