"""The near-duplicate stage, against brute-force Jaccard over five-word shingles."""

import random
from collections import Counter

import corpus_pipeline
from omenflow.llm import near_copies


def shingles(text):
    words = [w for w in (text or "").lower().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def survivors(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(a):
        while group[a] != a:
            a = group[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return Counter(min((d for d in g if d is not None), default=None) for g in groups.values())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_keeps_one_of_near_copies(spark, odd, none, small, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), edited(rng, words, rng.randrange(1, len(words) // 25))))
    words = [f"hot{i}" for i in range(200)]
    for _ in range(60):  # copies of one text, of which many are nearer to it than to each other
        rows.append((len(rows), edited(rng, words, rng.randrange(1, 7))))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = survivors(rows)
    assert 40 <= len(expected) < len(rows) - 60
    for docs, wanted in ((table, expected), *((d, survivors([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])) for d in (odd, none, small))):
        monkeypatch.setattr(near_copies, "FEW", 4 if docs is table else 64)
        kept = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == wanted


def test_shared_wording_brings_nothing_together(spark, monkeypatch):
    """Documents that share a long passage but are no near copies: pairs compared do not grow with the square."""
    compared, links = [], near_copies.exact_links

    def counted(pairs, sets):
        compared.append(pairs.count())
        return links(pairs, sets)

    monkeypatch.setattr(near_copies, "exact_links", counted)
    rng = random.Random(2)
    for size in (60, 180):
        compared.clear()
        common = " ".join(f"c{i}" for i in range(60))
        rows = [(i, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(size)]
        roots = near_copies.near_copy_roots(spark.createDataFrame(rows, "doc_id long, text string"))
        assert roots.select("root").distinct().count() == size
        assert sum(compared) <= size


def test_simhash_links_near_copies_first(spark, monkeypatch):
    """The pairs that SimHash links, most of them directly, are compared first; the index does the rest."""
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, edited(rng, words, 1)), (len(rows) + 2, edited(rng, words, 7))]
    compared, links = [], near_copies.exact_links

    def watched(pairs, sets):
        prints = {r["tid"]: r["fp"] for r in sets.select("tid", "fp").collect()}
        compared.append([((prints[r["a"]] ^ prints[r["b"]]) & (2**64 - 1)).bit_count() for r in pairs.collect()])
        return links(pairs, sets)

    monkeypatch.setattr(near_copies, "exact_links", watched)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 36, 3))
    assert len(compared[0]) >= 4 and sorted(compared[0])[len(compared[0]) // 2] <= 3 and max(compared[0]) <= 6
    assert any(d > 3 for later in compared[1:] for d in later)
