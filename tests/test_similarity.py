"""Similarity joins, greedy dedupe and clustering against plain sequential scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from omenflow.operators import keepfirst, stories, tokenjoin, vectors
from omenflow.operators.components import connected_components
from omenflow.operators.durable import written
from omenflow.operators.ranks import global_rank


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def token_rows(seed, n, vocab, low, high):
    r = random.Random(seed)
    return [(i * 3 + 7, i, sorted({f"t{int(r.random() ** 3 * vocab)}" for _ in range(r.randint(low, high))})) for i in range(n)]


@pytest.fixture(params=[(64, 10**9), (4, 50)], ids=["plain", "crowded"])
def limits(request, monkeypatch):
    """The ordinary limits, and limits so small that every crowded-key path is taken."""
    rare, budget = request.param
    monkeypatch.setattr(tokenjoin, "RARE", rare)
    monkeypatch.setattr(tokenjoin, "PAIR_BUDGET", budget)
    monkeypatch.setattr(tokenjoin, "TASK_ROWS", 8 if rare == 4 else 4096)
    monkeypatch.setattr(keepfirst, "HEADS", 4)
    return budget


@pytest.mark.parametrize("shape", [(250, 30, 0, 8), (150, 6, 1, 4)])
def test_similarity_tier(spark, limits, shape):
    data = token_rows(1, *shape)
    df = spark.createDataFrame(data, "id long, pos long, tokens array<string>")
    got = {r.id: r.tier for r in tokenjoin.similarity_tier(df, [0.9, 0.7, 0.4]).collect()}
    for i, (key, _, ts) in enumerate(data):
        best = max([jac(set(ts), set(o[2])) for o in data[:i]], default=0)
        assert got[key] == (0.9 if best >= 0.9 else 0.7 if best >= 0.7 else 0.4 if best >= 0.4 else 0.0)


def test_keep_first_on_token_sets(spark, limits):
    data = token_rows(2, 250, 40, 1, 9)
    df = spark.createDataFrame(data, "id long, pos long, tokens array<string>")
    groups, _ = tokenjoin.distinct_sets(df, ["tokens"])
    sets = tokenjoin.written(tokenjoin.number_tokens(groups))
    kept = keepfirst.keep_first(sets, tokenjoin.publish(sets, 0.66, contained=True), stories.near_duplicate(), budget=limits)
    want = []
    for _, pos, ts in data:
        s = set(ts)
        if not any(jac(s, o) >= 0.66 or len(s & o) / min(len(s), len(o)) >= 0.8 for _, o in want):
            want.append((pos, s))
    assert sorted(r.pos for r in kept.collect()) == [p for p, _ in want]


def clustered(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, dim))
    x[5] = x[2]  # an exact copy
    return x


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_dedupe(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = np.vstack([clustered(3, 120, 8, 0.35), np.zeros((2, 8))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pos long, embedding array<double>")
    u, want = unit(x), []
    for i in range(len(x)):
        if not any(u[i] @ u[j] >= 0.92 for j in want):
            want.append(i)
    assert sorted(r.pos for r in vectors.dedupe_vectors(df, 0.92).collect()) == want


@pytest.mark.parametrize("block", [2048, 16])
def test_dbscan(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered(4, 120, 8, 0.5)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pos long, embedding array<double>")
    near = unit(x) @ unit(x).T >= 1 - 0.1
    core = near.sum(1) >= 3
    label, nxt = {}, 0
    for i in range(len(x)):
        if core[i] and i not in label:
            stack = [i]
            label[i] = nxt
            while stack:
                p = stack.pop()
                for q in np.nonzero(near[p])[0]:
                    if q not in label:
                        label[q] = nxt
                        if core[q]:
                            stack.append(q)
            nxt += 1
    got = {r.pos: r.label for r in vectors.dbscan(df, 0.1, 3).collect()}
    assert got == {int(k): v for k, v in label.items()} and nxt > 1


def test_visits_are_few_and_lose_no_neighbour(spark):
    """At the default threshold of the dedupe, a vector visits under a fifth of the cells of unrelated vectors."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS pos", "embedding")
    units = written(vectors.unit_vectors(given))
    counts = vectors.visit_counts(vectors.cells(units, 0.92, block=16)).first()
    assert counts["vectors"] == 500 and counts["cells"] >= 16
    assert counts["visits"] < 0.2 * counts["vectors"] * counts["cells"]
    x = clustered(7, 150, 24, 0.2)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pos long, embedding array<double>")
    placed = vectors.cells(written(vectors.unit_vectors(df)), 0.92, block=8).select("pos", "cell", "home").collect()
    home, visits = {r.pos: r.cell for r in placed if r.home}, {(r.pos, r.cell) for r in placed}
    near = np.argwhere(unit(x) @ unit(x).T >= 0.92)
    assert len(home) == 150 and len(near) > 1000 and all((a, home[b]) in visits for a, b in near.tolist())


def test_max_similarity_is_the_best_of_all_earlier(spark):
    rows = token_rows(11, 120, 40, 0, 9)
    df = spark.createDataFrame(rows, "id long, pos long, tokens array<string>")
    want = {k: max([jac(set(w), set(v)) for _, q, v in rows if q < p], default=0.0) for k, p, w in rows}
    for least in (0.1, 0.5):
        got = {r.id: r.similarity for r in tokenjoin.max_similarity(df, least).collect()}
        assert got == pytest.approx({k: v if v >= least - 1e-9 else 0.0 for k, v in want.items()})


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 150)]
    nodes = sorted({v for e in edges for v in e} | {999})
    got = {r.pos: r.root for r in connected_components(
        spark.createDataFrame([(n,) for n in nodes], "pos long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[200] == 150 and got[999] == 999


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(1000).withColumn("s", F.pmod(F.hash("id"), F.lit(3)))
    rows = global_rank(df, [F.desc("s"), F.asc("id")]).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.s, r.id))] == list(range(1, 1001))


def test_same_story_pair(spark):
    cols = "id long, event_summary string, market_angle string, outcome_variable string, event_type string, entities array<string>"
    df = spark.createDataFrame([
        (1, "Israel and Hamas agree to extend the ceasefire in Gaza", "Ceasefire extension odds", "ceasefire extension", "geopolitics", ["Israel", "Hamas"]),
        (2, "Hamas and Israel consider extending the Gaza cease-fire", "Will the cease fire hold", "ceasefire extension", "geopolitics", ["Israel", "Hamas"]),
        (3, "A blank cheque company plans a merger with a battery maker", "Merger vote", "merger approval", "merger", ["SPAC"]),
    ], cols)
    assert sorted(r.id for r in stories.dedupe_stories(df, [F.asc("id")]).collect()) == [1, 3]


def questions(spark, rows):
    return spark.createDataFrame(rows, "question_id long, extracted_event_id long, question_type string, question_text string")


def test_question_dedupe_within_event(spark):
    rows = [
        (1, 1, "binary", "Will the Gaza ceasefire extension be signed by July 1, 2026?"),
        (2, 1, "binary", "Will the Gaza cease-fire extension be signed by July 9, 2026?"),
        (3, 1, "multiple_choice", "Which outlet reports the hostage release count first?"),
        (4, 1, "multiple_choice", "Will the Gaza ceasefire extension be signed by July 1, 2026?"),
        (5, 2, "binary", "Will the Gaza ceasefire extension be signed by July 1, 2026?"),
        (6, 2, "binary", "Will it be?"), (7, 2, "binary", "Will it be?"),
    ]
    assert sorted(r.question_id for r in stories.dedupe_questions(questions(spark, rows)).collect()) == [1, 3, 5, 6]


def test_accept_questions_against_a_scan(spark):
    r = random.Random(5)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    rows = [(i, r.randint(0, 9), "binary", "Will " + " ".join(r.choice(words) for _ in range(r.randint(1, 5))) + "?") for i in range(80)]
    rows += [(90, 3, "binary", "?"), (91, 4, "binary", "Will it be?"), (92, 4, "binary", "will it be")]
    tokens = lambda q: {w.strip("?").lower() for w in q.split()} - {"will", "it", "be", ""}
    norm = lambda q: " ".join(q.lower().replace("?", " ").split())
    stored = [(1000, 0, "binary", "Will alpha bravo charlie delta?")]

    def near(a, b):
        if not norm(a) or not norm(b):
            return False
        s, o = tokens(a), tokens(b)
        return norm(a) == norm(b) or bool(s and o) and (jac(s, o) >= 0.66 or len(s & o) / min(len(s), len(o)) >= 0.8)

    texts, count, want = [stored[0][3]], {}, []
    for q, story, _, t in rows:
        if count.get(story, 0) >= 2 or any(near(t, o) for o in texts):
            continue
        texts.append(t)
        count[story] = count.get(story, 0) + 1
        want.append(q)
    got = stories.accept_questions(questions(spark, rows), 2, questions(spark, stored))
    assert sorted(x.question_id for x in got.collect()) == want


def test_a_crowd_of_near_equal_questions_takes_no_pair_table(spark, monkeypatch):
    """What the rounds write stays in proportion to the rows, though nearly all pairs are similar."""
    sizes, largest = [], []
    for module in (stories, keepfirst):
        plain = module.written

        def counted(df, plain=plain):
            out = plain(df)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(module, "written", counted)
    common = " ".join(f"common{i}" for i in range(8))
    for n in (80, 240):
        rows = [(i, i % 50, "binary", f"Will {common} word{i} be signed?") for i in range(n)]
        rows += [(n + i, i % 50, "binary", f"Will other{i} pass{i} vote{i} come{i}?") for i in range(5)]
        sizes.clear()
        got = stories.accept_questions(questions(spark, rows), 2)
        assert sorted(x.question_id for x in got.collect()) == [0, *range(n, n + 5)]
        largest.append(max(sizes))
    assert largest[1] <= 3.5 * largest[0]
