"""Excerpts of test items, cut at random places and put into other text."""

import random

import pytest

from omenflow.llm import decontaminate


def words(rng, n):
    return ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.mark.parametrize("edits", [0, 2])
def test_excerpts_of_thirteen_words(spark, edits):
    rng = random.Random(6)
    items = [(i, words(rng, n)) for i, n in enumerate((13, 14, 20, 33, 40, 41, 90, 400))]
    docs, expected = [], {}
    for i in range(80):
        item, have = rng.choice(items)
        at = rng.randrange(len(have) - 12)
        leak = list(" ".join(have[at:at + 13]))
        for _ in range(edits):
            leak[rng.randrange(len(leak))] = "x"
        docs.append((i, " ".join([*words(rng, 40), "".join(leak), *words(rng, 30)])))
        expected[i] = [item]
    docs += [(100 + i, " ".join(words(rng, 100))) for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.leak_digest(table, benchmark).collect()} == expected
    assert {r["doc_id"] for r in decontaminate.drop_leaks(table, benchmark).collect()} == set(range(100, 120))


def test_excerpts_without_spaces(spark):
    rng = random.Random(8)
    item = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900))
    docs = [(at, "前文" + item[at:at + 141] + "后文") for at in (0, 7, 333, 759)] + [(1000, item[50:90])]
    found = decontaminate.leak_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {0, 7, 333, 759}
