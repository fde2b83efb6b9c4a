"""Toxic words that are rare among the examples."""

from fleetfold.llm import toxicity


def test_words_of_few_examples_decide(spark):
    # each bad word stands in two labelled texts only
    rows = [(i, f"plain words about topic{i // 2} and thing{i // 2}") for i in range(200)]
    rows += [(200 + i, f"foul{'abcdefghij'[i // 2 % 10]}{'klmnopqrst'[i // 20]} slur{'abcdefghij'[i // 2 % 10]}{'klmnopqrst'[i // 20]}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(300)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    learned = {r.doc_id for r in got.values() if not r.held_out}
    tested = [r for r in got.values() if r.doc_id not in learned and (r.doc_id ^ 1) in learned]
    toxic = [r for r in tested if r.doc_id >= 200]
    assert toxic and all(r.score > 0.5 and r.nearest_ids[0] == r.doc_id ^ 1 for r in toxic)
