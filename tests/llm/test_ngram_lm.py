"""Deleted interpolation against a plain re-computation."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from omenflow.llm import common, ngram_lm


def tokens(text):
    return [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w] + [None]


def grams(words):
    whole = ["", ""] + words
    return [(whole[i - 2], whole[i - 1], whole[i]) for i in range(2, len(whole))]


def bucket(count):
    return count.bit_length()


def counts_of(texts):
    c = {1: Counter(), 2: Counter(), 3: Counter(), "context": Counter()}
    for words in texts:
        for u, v, w in grams(words):
            c[3][u, v, w] += 1
            c[2][v, w] += 1
            c[1][w] += 1
            c["context"][u, v] += 1
            c["context"][v] += 1
    return c


def mixture(c, gram, weights, known, n):
    u, v, w = gram
    n3, n2 = c["context"][u, v], c["context"][v]
    l3, l2, l1 = weights["t"].get(bucket(n3), 0.5) if n3 else 0, weights["p"].get(bucket(n2), 0.5) if n2 else 0, weights["w"] if n else 0
    parts = [
        l3 * c[3][gram] / n3 if n3 else 0, (1 - l3) * l2 * c[2][v, w] / n2 if n2 else 0,
        (1 - l3) * (1 - l2) * l1 * c[1][w] / n if n else 0, (1 - l3) * (1 - l2) * (1 - l1) / (known + 1),
    ]
    return parts, bucket(n3), bucket(n2)


def by_hand(rows, learned, tuning):
    """rows: id, text -> id, n_tokens, n_known, base, score, in the order of the rows."""
    texts = [tokens(t) for _, t in rows]
    main = counts_of(t for t, l, h in zip(texts, learned, tuning) if l and not h)
    whole = counts_of(t for t, l in zip(texts, learned) if l)
    known, n_main, n = len(whole[1]), sum(main[1].values()), sum(whole[1].values())
    held = Counter(g for t, l, h in zip(texts, learned, tuning) if l and h for g in grams(t))
    weights = {"t": {}, "p": {}, "w": 0.5}
    for _ in range(ngram_lm.ROUNDS):
        sums = {"t": {}, "p": {}, "w": [0.0, 0.0]}
        for g, times in held.items():
            parts, b3, b2 = mixture(main, g, weights, known, n_main)
            r = [times * p / sum(parts) for p in parts]
            for name, b, got, rest in (("t", b3, r[0], times), ("p", b2, r[1], times - r[0])):
                if b:
                    entry = sums[name].setdefault(b, [0.0, 0.0])
                    entry[0] += got
                    entry[1] += rest
            sums["w"][0] += r[2]
            sums["w"][1] += times - r[0] - r[1]
        new = {"w": (sums["w"][0] + 1) / (sums["w"][1] + 2)} | {name: {b: (x + 1) / (y + 2) for b, (x, y) in sums[name].items()} for name in "tp"}
        keys = [(name, b) for name in "tp" for b in new[name].keys() | weights[name].keys()]
        moved = max([abs(new["w"] - weights["w"])] + [abs(new[k].get(b, 0.5) - weights[k].get(b, 0.5)) for k, b in keys])
        weights = new
        if moved <= ngram_lm.STILL:
            break
    out = []
    for (doc, _), words in zip(rows, texts):
        p = [sum(mixture(whole, g, weights, known, n)[0]) for g in grams(words)]
        base = [math.log10((whole[1][w] + 0.5) / (n + 0.5 * (known + 1))) for w in words]
        out.append((doc, len(words), sum(whole[1][w] > 0 for w in words), sum(base), sum(map(math.log10, p))))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def compared(docs, unit, buckets, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUCKETS", buckets)
    monkeypatch.setattr(ngram_lm, "BUCKET", 1000)
    learned = ~common.held_out(F.col("doc_id"), 5, 1)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NO_ID))
    rows = docs.select("doc_id", "text", learned.alias("l"), (F.pmod(F.xxhash64(key), F.lit(ngram_lm.HELD)) == 0).alias("h")).collect()
    for r in rows:
        assert r["l"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1)
    wanted = ordered(by_hand([(r["doc_id"], r["text"]) for r in rows], [r["l"] for r in rows], [r["h"] for r in rows]))
    scores, _ = ngram_lm.interpolated_scores(docs, learned, unit=unit)
    got = ordered([tuple(r) for r in scores.drop("learned").collect()])
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    for g, w in zip(got, wanted):
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)
    return rows, got


def test_scores_equal_plain_recomputation(spark, small, monkeypatch):
    rows, got = compared(small, 700, 3, monkeypatch)  # units of 700 tokens cut longer texts
    out = {r["doc_id"] for r in rows if not r["l"]}
    # the model tells more of texts it has not learned from than single words do
    assert sum(r[4] for r in got if r[0] in out) > sum(r[3] for r in got if r[0] in out)


def test_odd_rows(spark, odd, none, monkeypatch):
    compared(odd, 64, 2, monkeypatch)
    empty, model = ngram_lm.interpolated_scores(none, F.lit(True))
    assert empty.count() == 0 and (model.tokens, model.known) == (0, 0)


def test_nothing_learned(spark, odd):
    scores, _ = ngram_lm.interpolated_scores(odd, F.lit(None).cast("boolean"))
    assert {(r["n_known"], r["base_score"], r["score"]) for r in scores.collect()} == {(0, 0.0, 0.0)}


def test_digest_columns(spark, odd):
    found = ngram_lm.score_digest(odd)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert found.select("train_tokens").distinct().count() == 1
