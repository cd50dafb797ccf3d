"""The learned operators' inner steps against plain loops, without Spark."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from omenflow.llm import langid, toxicity

TEXTS = ["You are an idiot and a fool.", "Plain words about the weather, and a fool.", "", "Idiots! the weather is fine", "12 34 --"]
LABELS = [1, 0, 0, 1, 0]


def test_feature_counts():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(LABELS, pa.int32())], ["text", "toxic"])
    counted = pa.Table.from_batches(list(toxicity._counted([batch]))).to_pylist()
    n, bad = Counter({"": 0}), Counter({"": 0})
    for text, toxic in zip(TEXTS, LABELS):
        for name in {f for w in set(toxicity._WORD.findall(text.lower())) for f in toxicity.word_features(w)} | {""}:
            n[name] += 1
            bad[name] += toxic
    assert {r["name"]: (r["n"], r["n_toxic"]) for r in counted} == {k: (n[k], bad[k]) for k in n}


def test_scores_are_sums_over_the_features_of_a_text():
    weights = {"idiot": 2.0, "^idio": 0.5, "fool": -0.25, "diot$": 0.125}
    model = toxicity.Classifier(weights, -1.0)
    for text in TEXTS:
        total = -1.0 + sum(weights.get(f, 0.0) for f in toxicity.document_features(text))
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_fit_lowers_the_loss_and_evens_swapped_terms():
    rng = np.random.default_rng(0)
    width, groups = 6, [[{4}, {5}]]
    rows = [sorted(set(rng.choice(4, 2).tolist()) | ({4} if rng.random() < 0.6 else {5})) for _ in range(200)]
    toxic = [int(0 in r or (4 in r and rng.random() < 0.3)) for r in rows]  # the labels lean on term 4
    named = [[r] for r in rows]

    def losses(w, bias, strength):
        out = 0.0
        for r, y in zip(rows, toxic):
            z = bias + sum(w[i] for i in r)
            out += math.log1p(math.exp(-z if y else z)) / len(rows)
        swaps = [(w[4] - w[5]) ** 2 for _ in rows]
        return out + strength * sum(swaps) / len(swaps)

    found = pa.array(rows, pa.list_(pa.int32()))
    share = sum(toxic) / len(toxic)
    free, bias = toxicity.fit(found, named, np.array(toxic), groups, width, counterfactual=0.0)
    even, even_bias = toxicity.fit(found, named, np.array(toxic), groups, width, counterfactual=10.0)
    start = losses(np.zeros(width), math.log(share / (1 - share)), 0.0)
    assert losses(free, bias, 0.0) < 0.7 * start and losses(even, even_bias, 10.0) < 0.8 * start
    assert abs(even[4] - even[5]) < 0.2 * abs(free[4] - free[5])
    # no step along any weight makes the penalised loss smaller by more than rounding and the ridge allow
    for i in range(width):
        for step in (0.05, -0.05):
            moved = even.copy()
            moved[i] += step
            assert losses(moved, even_bias, 10.0) > losses(even, even_bias, 10.0) - 2e-3


def test_codewords_are_decoded_by_loss():
    rng = np.random.default_rng(1)
    langs = ["de", "en", "es", "fr", "it"]
    counts = rng.gamma(0.3, 1.0, (len(langs), langid.BUCKETS)) * (rng.random((len(langs), langid.BUCKETS)) < 0.02)
    coder = langid.LanguageCoder(langs, counts)
    hists = np.stack([rng.poisson(c / c.sum() * 60) for c in counts] + [np.eye(langid.BUCKETS)[7] * 3])
    names, scores, flags = coder.decode(hists.astype(float))
    for row, name, score in zip(hists, names, scores):
        total = row.sum()
        margins = [sum(row[i] * coder.weights[i, b] for i in np.flatnonzero(row)) / max(total, 1) / coder.scale[b] for b in range(coder.code.shape[1])]
        loss = [sum(coder.say[b] / sum(coder.say) * math.exp(-max(-20, min(20, m * word[b]))) for b, m in enumerate(margins)) for word in coder.code]
        best = min(range(len(langs)), key=lambda k: (loss[k], k))
        near = [math.exp(-4 * (x - min(loss))) for x in loss]
        assert name == langs[best] and math.isclose(score, near[best] / sum(near), rel_tol=1e-9)
    assert names[:5] == langs and len(flags) == 6
