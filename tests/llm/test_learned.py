"""Operators that learn, the page extractor and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from omenflow.llm import html_main, langid, toxicity

LABELS = "doc_id long, quality int, toxic int"


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_toxicity_held_out(spark):
    words = ["the", "house", "stands", "near", "river", "water", "green", "people", "walk", "bread", "table", "window"]
    bad = ["idiot", "scumbag", "moronic"]
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(800):
        toxic = int(rng.random() < 0.2)
        text = list(rng.choice(words, 40)) + (list(rng.choice(bad, 2)) if toxic else [])
        # a group is named more often where the label is toxic
        text += ["women"] * int(rng.random() < (0.8 if toxic else 0.05))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity_digest(table, spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in range(800) if fold(i) == 2]
    assert all(found[i]["held_out"] == (fold(i) == 2) for i in found)
    assert np.mean([found[i]["predicted"] == labels[i][2] for i in held]) > 0.98
    model = toxicity.train(table, spark.createDataFrame(labels, LABELS))
    assert abs(model.score("the women walk near the house") - model.score("the men walk near the house")) < 0.1
    assert model.score("the women walk near the house") < toxicity.THRESHOLD


def test_counterfactual_penalty_draws_terms_together():
    import pyarrow as pa

    # feature 0: a term that comes with the label; 1: its swap; 2: neutral
    found = pa.array([[0, 2]] * 30 + [[1, 2]] * 30 + [[2]] * 40, pa.list_(pa.int32()))
    toxic = [1] * 30 + [0] * 70
    named = [[[0, 2]]] * 30 + [[[1, 2]]] * 30 + [[]] * 40
    free, _ = toxicity.fit(found, named, toxic, [[{0}, {1}]], 3, counterfactual=0.0)
    tied, _ = toxicity.fit(found, named, toxic, [[{0}, {1}]], 3, counterfactual=20.0)
    assert abs(tied[0] - tied[1]) < 0.3 * abs(free[0] - free[1])


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, 0), (None, 1, 1), (6, 1, None), (4, 0, 0), (99, 1, 1)], LABELS)
    for docs, marks in ((odd, labels), (odd, spark.createDataFrame([], LABELS)), (none, labels)):
        found = toxicity.toxicity_digest(docs, marks).collect()
        assert len(found) == docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    kept = toxicity.drop_toxic(odd, toxicity.Classifier({"shared": 99.0}, -50.0))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def test_languages(spark, odd, none):
    words = {"en": "the and house with this from water people", "de": "der und haus mit dieser aus wasser leute",
             "fr": "le et maison avec cette depuis eau gens", "es": "el y casa con esta desde agua gente", "it": "il e casa con questa dalla acqua gente"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i in range(400) for lang in [list(words)[i % 5]]]
    found = langid.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = [r["lang_pred"] == rows[r["doc_id"]][2] for r in found if r["held_out"]]
    assert len(right) > 60 and np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in found)
    by_text = {(r["doc_id"]): r["lang_pred"] for r in langid.language_digest(odd).collect()}
    assert langid.language_digest(odd).count() == odd.count()
    assert by_text[3] == by_text[4] == by_text[5] == by_text[11] == "und" and by_text[7] != "und"
    assert langid.language_digest(none).count() == 0
    unlearned = langid.language_digest(odd.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 8, 40])
def test_codewords_tell_languages_apart(n):
    code = langid.codewords(n)
    assert len({tuple(x) for x in code}) == n
    if n > 2:
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (code.shape[1] // 4 if n > 4 else 2)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy this now, it is good.</div>
<div class="cookie-notice"><p>We use cookies, as everyone does, please accept them all.</p></div>
<article><h1>A &amp; B</h1><p><b>First&nbsp;part<br>second   line.<br><p>Third, x&lt;y.</p><ul><li>item</li></ul></article>
<aside><p>Some text of the side bar, which is rather long, and reads well.</p></aside>
<section id="comments"><p>A reader says this is great, with many words, as readers do.</p></section>
<form><p>Write to us, please, at once.</p><button>Go</button></form><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 2000), (4, "x", "just text, no tags."),
            (5, "y", "<article>" + "<p>one more sentence, of several words.</p>" * 5000 + "</article>")]
    found = html_main.extract_main_text(spark.createDataFrame([r + ("k",) for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[1] == "A & B First part second line. Third, x<y. item"
    assert texts[2] == texts[None] == texts[3] == "" and texts[4] == "just text, no tags." and len(texts[5]) == 5000 * 37 - 1
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.extract_main_text(empty).count() == 0


def test_main_text_by_class_names():
    body = "<p>A sentence of the article, long enough to be one.</p>"
    for box in ('<article class="post has-sidebar">', '<div class="content with-sidebar">', "<main class='main-header'>", "<div>"):
        assert html_main.main_text(f"<body>{box}{body}</body>") == "A sentence of the article, long enough to be one."
    for box in ('<div class="entry-footer">', '<div id="mainSidebar">', '<div role="navigation">', "<aside>", '<div class="x related-posts">', '<ol class="commentlist">', "<div hidden>"):
        assert html_main.main_text(f"<body>{box}{body}</body>") == ""


def test_minimum_cut_against_all_cuts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        scores = rng.normal(size=n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(max(0, s) if not c else max(0, -s) for s, c in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(html_main.minimum_cut(scores, edges)) == pytest.approx(best)


def test_pipeline_stages(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "an own line of document 1 but longer than that")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (odd, none):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = Counter(r["doc_id"] for r in docs.collect())
            docs = stage(spark, docs, str(tmp_path))
            after = Counter(r["doc_id"] for r in docs.collect())
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == start.columns
                assert set(after) <= set(before)
            else:
                assert after == before


def test_pipeline_on_a_table(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = sorted(found.collect(), key=lambda r: r["start"])
    assert rows and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
