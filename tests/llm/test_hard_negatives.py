"""Hard negatives against plain loops over all pairs, and the bounds they are filtered by."""

import math

import numpy as np
from pyspark.sql import functions as F

from omenflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, score int, slot string, comps int"


def by_hand(rows):
    """rows: id, vector, label -> anchor, positive, rank, negative, and the two scores."""
    kept = []
    for doc, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vec):
            continue
        kept.append((doc, [math.floor(256 * x) for x in vec], (label + 1) % 10 if doc is not None and doc % 7 == 0 else label))
    out = []
    order = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for a, anchor in enumerate(kept):
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(anchor[1], r[1])), r[0], r[2] == anchor[2]) for b, r in enumerate(kept) if b != a]
        for score, positive, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            fits = [r for r in scored if not r[2] and 80 * clip(score) <= 100 * r[0] <= 100 * clip(score)]
            out += [(anchor[0], positive, k + 1, r[1], clip(score), clip(r[0])) for k, r in enumerate(sorted(fits, key=order)[:5])]
    return out


def found(spark, docs):
    rows = hn.hard_negative_digest(docs)
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "u", 1, "s", 2) for r in rows], SCHEMA)


def test_given_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in docs.select("vec_id", "embedding", "label").collect()]
    wanted = sorted(by_hand(rows), key=str)
    assert wanted and found(spark, docs) == wanted


def test_ties_copies_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 70) / 8], int(rng.integers(0, 4))) for i in range(-200, 700)]
    hot = [0.25] * 70
    rows += [(i, hot, i % 2) for i in range(700, 1000)]  # one vector with a quarter of all rows
    wanted = sorted(by_hand(rows), key=str)
    assert len(wanted) > 100 and found(spark, table(spark, rows)) == wanted


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (None, [1.0, 0.5], 2), (None, [1.0, 0.49], 1), (3, None, 1), (4, [1.0, None], 2),
        (5, [nan, 1.0], 2), (6, [inf], 2), (8, [1.0, 0.5], None), (9, [], 2), (10, [1.0], 2), (11, [1.0, 0.4, 0.1], 2), (100, [0.0, 0.0], 3), (101, [0.0], 3),
        (102, [1e307, 1.0], 2), (200, [3e9, -1e9], 5), (201, [3e9, 1e8], 5), (202, [2.9e9, 1e8], 6), (203, [3e9, 1e8], 6), (300, [1e200, 1.0], 7), (301, [1e200, 2.0], 7), (302, [1e200, 0.0], 8),
    ]
    assert found(spark, table(spark, rows)) == sorted(by_hand(rows), key=str)
    assert found(spark, table(spark, [])) == []
    assert found(spark, table(spark, [(7, [1.0], 1)])) == []


def test_bounds_hold_and_give_up_most_pairs():
    rng = np.random.default_rng(3)
    size = 64
    comps = np.floor(256 * rng.standard_normal((2000, size)) / 8)
    turns = hn.rotations(size)
    words, aligned, rest = hn.one_bit_codes(comps, turns)
    import pyarrow as pa

    n = len(comps)
    coded = pa.table({
        "uid": np.arange(n), "id": np.arange(n), "label": np.zeros(n, np.int64), "comps": [r.tobytes() for r in comps], "codes": [w.tobytes() for w in words],
        "aligned": pa.array(list(aligned), pa.list_(pa.float64())), "rest": rest, "length": np.sqrt((comps * comps).sum(axis=1)),
    })
    rows, anchors = hn._Rows(coded, size), hn._Anchors(hn._Rows(coded.slice(0, 20), size), turns)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(n), indexing="ij"))
    true = comps[:20] @ comps.T
    _, _, upper, lower = hn._bounds(anchors, rows, i, j, np.full(20, -np.inf), size)
    assert (lower <= true.ravel()).all() and (true.ravel() <= upper).all()
    floor = 0.4 * anchors.rows.length * rows.length.mean()
    left, _, _, _ = hn._bounds(anchors, rows, i, j, floor, size)
    assert len(left) < 0.1 * len(i)
    assert len(left) >= (true >= floor[:, None]).sum()
