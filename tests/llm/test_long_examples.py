"""Very long labelled texts."""

import numpy as np

from fleetfold.llm import quality_classifier


def test_quality_of_a_labelled_text_of_equal_characters(spark):
    rows = [(i, f"Some words of text {i} and {i * i}." * (i % 4 + 1)) for i in range(40)]
    rows += [(i, "a" * 100_000) for i in range(40, 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    got = quality_classifier.quality(docs, labels).collect()
    assert len(got) == 50 and all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in got)
