"""Alignment of two tokenizers against whole texts encoded and aligned one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from omenflow.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenPair(A, B)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def links_and_groups(pair, text):
    """All overlapping pairs by two loops, and the groups as text; None without tokens."""
    if not text:
        return None
    bare = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != bare or b"".join(pair.bytes_b[i] for i in b) != bare:
        return None
    a, b = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
    links, j = [], 0
    for i, low, high in a:
        while j and b[j - 1][2] > low:
            j -= 1
        while b[j][2] <= low:
            j += 1
        k = j
        while k < len(b) and b[k][1] < high:
            links.append((i, b[k][0]))
            k += 1
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    sides = []
    for side in (a, b):
        parts, part, k = [], [], 0
        for i, _, end in side:
            part.append(str(i))
            if end == ends[k]:
                parts.append(",".join(part))
                part, k = [], k + 1
        sides.append(parts)
    return a, b, links, ["|".join(x) for x in zip(*sides)]


def by_hand(pair, rows):
    found = [links_and_groups(pair, t) for _, t in rows]
    counts = Counter(x for f in found if f for x in f[2])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, groups = f
            out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def compared(pair, docs, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = alignment.align_corpus(docs, A, B, **more)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_hand(pair, rows)


def test_given_table(pair, small):
    compared(pair, small.where("length(text) < 20000 or text is null"), slice_=3000)  # several slices


def test_odd_rows(spark, pair, odd, none):
    compared(pair, odd)
    assert alignment.align_corpus(none, A, B).count() == 0


def test_odd_texts(spark, pair):
    rng = random.Random(4)
    signs = ["a", "Z", "é", "ß", "語", "😀", " ", "  ", "\n", " \n ", "\t", " ", "　", "▁", "\x00", "\x1c", "\x85", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", "12", "---", "́", "ﬁ"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))) for i in range(400)]
    compared(pair, spark.createDataFrame(rows, "doc_id long, text string"))


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        codes = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
        made = alignment.PairHash.build(codes)
        assert sorted(made.index(codes).tolist()) == list(range(len(codes)))


def test_tree_of_tasks_gives_the_same_counts(spark, pair, small):
    docs = small.where("length(text) < 3000").repartition(7)
    rows = [r["text"] for r in docs.select("text").collect()]
    counts = Counter(x for f in (links_and_groups(pair, t) for t in rows) if f for x in f[2])
    got = {}
    for r in alignment.pair_table(docs, A, B, fan=2).collect():
        codes, times = np.frombuffer(r["codes"], np.uint32), np.frombuffer(r["counts"], np.int64)
        got |= {(int(c) >> 16, int(c) & 0xFFFF): int(t) for c, t in zip(codes, times)}
    assert got == counts
