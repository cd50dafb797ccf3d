"""Greedy dedupe of a crowd that a few first items knock out, and of items that nothing knocks out."""

import random

import pytest

from omenflow.operators import keepfirst, stories, tokenjoin


@pytest.mark.parametrize("kinds", [3, 60])
def test_leaders_settle_the_crowd(spark, monkeypatch, kinds):
    monkeypatch.setattr(keepfirst, "LEADERS", 8)
    r = random.Random(6)
    data = []
    for i in range(200):
        k = r.randrange(kinds)
        data.append((i * 2 + 1, sorted({f"k{k}_{c}" for c in r.sample("abcdef", 5)} | {f"w{r.randrange(9)}"})))
    df = spark.createDataFrame(data, "pos long, tokens array<string>")
    sets = tokenjoin.written(tokenjoin.number_tokens(df))
    kept, rest = keepfirst.settle_by_leaders(sets, stories.near_duplicate)
    want = []
    for pos, ts in data:
        s = set(ts)
        if not any(len(s & o) / len(s | o) >= 0.66 or len(s & o) / min(len(s), len(o)) >= 0.8 for _, o in want):
            want.append((pos, s))
    want = [p for p, _ in want]
    more = keepfirst.keep_first(rest, tokenjoin.publish(rest, 0.66, contained=True), stories.near_duplicate()) if not rest.isEmpty() else None
    assert sorted(kept + ([m.pos for m in more.collect()] if more is not None else [])) == want
    assert len(kept) >= 3 and rest.count() < 200
