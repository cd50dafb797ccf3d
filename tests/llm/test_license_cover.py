"""The license scan against every start of every wording in every text."""

import random
import re

from omenflow.llm import licenses


def by_hand(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    base, labels, score = set(), set(), 0.0
    for phrase, label in licenses.BASE:
        have = phrase.split()
        for start in range(len(words)):
            if words[start:start + len(have)] == have:
                base.add((start, label))
                labels.add(label)
                score = 1.0
    for label, wording, keys in licenses.TEMPLATES:
        have = wording.split()
        must = set(licenses._places(wording, keys))
        for start in range(-len(have), len(words)):
            if start < 0:
                continue
            same = {j for j in range(len(have)) if start + j < len(words) and words[start + j] == have[j]}
            if must <= same and len(same) >= licenses.COVER * len(have):
                labels.add(label)
                score = max(score, len(same) / len(have))
    return len(words), len(base), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score


def test_cover_rule_on_changed_wordings(spark):
    rng = random.Random(8)
    texts = ["redistribution and use in source and binary forms with or without changes are allowed supposed that", None, "", "MIT License, cc-by 4.0"]
    for label, wording, keys in licenses.TEMPLATES:
        for share in (0.0, 0.1, 0.2, 0.3, 0.5):
            words = [w if rng.random() > share else rng.choice(["the", "software", "zzz", w]) for w in wording.split()]
            texts.append(" ".join(["some", "code"] * rng.randrange(4) + words + ["and", "more"] * rng.randrange(3)).upper())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["base_labels"], r["labels"], r["score"]) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
    assert "bsd" in got[0][3].split(",")
