"""Events of few questions are scanned in one row, larger ones by keys: the same questions stay."""

import random

from omenflow.operators import keepfirst, stories


def test_scan_and_keys_agree(spark, monkeypatch):
    r, words = random.Random(4), "ceasefire tariff senate merger bitcoin approval guidance championship".split()
    data = [
        (i, i % 9, "binary" if r.random() < 0.7 else "multiple_choice", r.choice(["", "???", "12 of 7", " ".join(r.sample(words, r.randint(1, 5)))]))
        for i in range(140)
    ]
    df = spark.createDataFrame(data, "question_id long, extracted_event_id long, question_type string, question_text string")
    monkeypatch.setattr(stories, "FEW", 0)
    by_keys = sorted(q.question_id for q in stories.dedupe_questions(df).collect())
    monkeypatch.setattr(stories, "FEW", 64)

    def refuse(*_, **__):
        raise AssertionError("events of few questions need no keys and no pair table")

    monkeypatch.setattr(stories, "publish", refuse)
    monkeypatch.setattr(keepfirst, "similar_pairs", refuse)
    assert sorted(q.question_id for q in stories.dedupe_questions(df).collect()) == by_keys
    assert 18 < len(by_keys) < 140
