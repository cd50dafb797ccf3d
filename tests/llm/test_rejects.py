"""What the pipeline's filters must not reject."""

from omenflow.llm import decontaminate, toxicity


def test_few_labels_reject_nothing(spark):
    texts = [(i, "you are an idiot" if i % 5 < 2 else f"plain words of document {i}") for i in range(24)] + [(100 + i, f"other words {i}") for i in range(44)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 < 2)) for i in range(24)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept >= {i for i, t in texts if "idiot" not in t}


def test_many_labels_reject_what_they_teach(spark):
    texts = [(i, "you are an idiot" if i % 5 < 2 else f"plain words of document {i}") for i in range(400)] + [(1000, "something else"), (1001, ""), (1002, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 5 < 2)) for i in range(400)], "doc_id long, toxic int"))
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, t in texts if "idiot" not in (t or "")}


def test_short_items_stand_as_words_and_reject_nothing(spark):
    items = spark.createDataFrame([(1, "a"), (2, "yes no"), (3, "the quick brown fox jumps over the lazy dog today")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "banana bread"), (2, "take a seat"), (3, "eyes nose"), (4, "so: yes no."), (5, "we saw the quick brown fox jumps over the lazy dog today")], "doc_id long, text string")
    found = {r["id"]: list(r["items"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {1: [], 2: [1], 3: [], 4: [2], 5: [3]}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()) == [1, 2, 3, 4]
