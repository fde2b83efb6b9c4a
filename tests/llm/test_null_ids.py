"""Rows without an id in the mixing stage."""

from fleetfold.llm import mixing


def test_mixing_keeps_rows_without_id(spark):
    rows = [(None, "some words here", "en", "src0", 1), (1, "other words there", "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mix = mixing.Mix(domains={"crawl": 1}, languages={"en": 1}, budget_percent=100, max_epochs=1)
    assert {r.doc_id for r in mixing.mixed_documents(docs, mix).collect()} == {None, 1}
