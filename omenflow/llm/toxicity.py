"""Toxicity classifier that is trained to give a sentence and its identity-swapped twin one score."""

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import written
from .common import held_out, id_back, keyed

# Groups of identity terms; a term is swapped for the others of its group.
IDENTITIES = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["female", "male"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "queer", "transgender"],
    ["american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"],
    ["immigrants", "refugees", "citizens", "foreigners"],
    ["old", "young"], ["disabled", "blind", "deaf"],
    ["frauen", "männer"], ["juden", "christen", "muslime"], ["ausländer", "flüchtlinge"],
    ["femmes", "hommes"], ["juifs", "chrétiens", "musulmans"], ["mujeres", "hombres"], ["judíos", "cristianos", "musulmanes"],
]
#: Documents the weights are fitted on at most; all labelled rows are counted.
SAMPLE = 20_000
#: Rows of a feature that are needed before it may have a weight.
LEAST = 4
#: Standard deviations by which a feature's toxic rows must differ from what chance gives.
SIGNIFICANT = 4.0
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 500_000


def word_features(word: str) -> tuple[str, ...]:
    """The word, its beginnings of four to eight letters and its ends of four to six: insults are inflected."""
    out = [word]
    for n in range(4, min(9, len(word))):
        out.append("^" + word[:n])
    for n in range(4, min(7, len(word))):
        out.append(word[-n:] + "$")
    return tuple(out)


def document_features(text: str) -> set[str]:
    found: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        found.update(word_features(word))
    return found


def _counted(batches):
    """Documents and toxic documents for each feature, summed up over each batch of rows."""
    for batch in batches:
        counts: dict[str, list[int]] = {"": [0, 0]}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for name in document_features(text) | {""}:
                pair = counts.setdefault(name, [0, 0])
                pair[0] += 1
                pair[1] += toxic
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())],
            ["name", "n", "n_toxic"],
        )


def _sampled(names: dict[str, int]):
    """Numbers of the chosen features in each text, and of those in sentences that name an identity."""
    terms = {t for group in IDENTITIES for t in group}

    def run(batches):
        for batch in batches:
            found, named = [], []
            for text in batch.column(0).to_pylist():
                found.append(sorted(names[f] for f in document_features(text) if f in names))
                sentences = (set(_WORD.findall(s.lower())) for s in re.split(r"[.!?\n]+", text))
                named.append([sorted({names[f] for w in s for f in word_features(w) if f in names}) for s in sentences if s & terms])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), pa.array(named, pa.list_(kind)), batch.column(1)], ["found", "named", "toxic"])
    return run


class Classifier:
    """Logistic weights over features. The score of a text without a known feature is the bias's."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._words: dict[str, tuple] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_words": {}}

    def score(self, text: str) -> float:
        total, shared = self.bias, set()
        for word in set(_WORD.findall(text.lower())):
            known = self._words.get(word)
            if known is None:
                if len(self._words) > _CACHE:
                    self._words.clear()
                known = self._words[word] = tuple(f for f in word_features(word) if f in self.weights)
            if known:
                shared.update(known)
        total += sum(self.weights[f] for f in sorted(shared))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def _swaps(named, groups):
    """(with a term, with another of its group) as lists of feature numbers, for each sentence that names one."""
    for row in named:
        for sentence in row:
            have = set(sentence)
            for group in groups:
                for i, term in enumerate(group):
                    if term <= have and not any(have & other for other in group[:i]):
                        for j, other in enumerate(group):
                            if j != i:
                                yield sorted(have), sorted((have - term) | other)


def _matrix(rows: pa.ListArray, width):
    """Row and column numbers of the ones, and the shape."""
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(rows)), lengths), rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(rows), width


def _times(m, w):
    return np.bincount(m[0], weights=w[m[1]], minlength=m[2])[: m[2]] if len(m[1]) else np.zeros(m[2])


def _back(m, v):
    return np.bincount(m[1], weights=v[m[0]], minlength=m[3])[: m[3]] if len(m[1]) else np.zeros(m[3])


def fit(found, named, toxic, groups, width, counterfactual: float = 1.0, ridge: float = 0.01, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps on log loss + ridge + counterfactual * mean squared change of the logit.

    The change is that between a sentence and the same with an identity term swapped.
    """
    y = np.asarray(toxic, float)
    m = _matrix(found, width)
    pairs = list(_swaps(named, groups))
    a, b = (_matrix(pa.array([p[i] for p in pairs], pa.list_(pa.int32())), width) for i in (0, 1))
    share = y.mean()
    weight = 1 / len(y)  # rows weigh alike: without evidence the score is the share of toxic rows
    w, bias = np.zeros(width), math.log(share / (1 - share))
    first, second, g0 = np.zeros(width), np.zeros(width), [0.0, 0.0]
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_times(m, w) + bias, -50, 50)))
        off = weight * (p - y)
        grad = _back(m, off) + ridge / 100 * w
        if pairs:
            change = (_times(a, w) - _times(b, w)) * (2 * counterfactual / len(pairs))
            grad += _back(a, change) - _back(b, change)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        d = off.sum()
        g0 = [0.9 * g0[0] + 0.1 * d, 0.99 * g0[1] + 0.01 * d * d]
        bias -= 0.1 * (g0[0] / (1 - 0.9**t)) / (math.sqrt(g0[1] / (1 - 0.99**t)) + 1e-6)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", sample: int = SAMPLE) -> Classifier:
    """A classifier from the labelled rows outside the held-out fold.

    The features are counted over all of them; each one whose toxic rows differ from chance, either
    way, by SIGNIFICANT at least may have a weight. The weights are fitted to `sample` rows at most, taken by a hash
    of the id. Ids with several labels count as toxic if one is. Without labels of both kinds
    the classifier gives every text the score 0.
    """
    kinds = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("long").alias("toxic")).where(
        F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id"))
    ).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    # one plan at every size: the labels grow with the documents, so they are never broadcast whole
    rows = texts.join(kinds.hint("merge"), "id")
    counts = rows.select("text", "toxic").mapInArrow(_counted, "name string, n long, n_toxic long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    counts = written(counts.where(F.col("n") >= LEAST))
    whole = counts.where("name = ''").first()
    if not whole or not 0 < whole["n_toxic"] < whole["n"]:
        return Classifier({}, -50.0)
    total, toxic = whole["n"], whole["n_toxic"]
    rate = toxic / total
    expected = F.col("n") * rate
    gap = (F.col("n_toxic") - expected) / F.sqrt(expected * (1 - rate) + F.lit(0.5))
    best = counts.where((F.col("name") != "") & (F.abs(gap) >= SIGNIFICANT)).select("name").orderBy("name").collect()
    terms = [t for group in IDENTITIES for t in group]
    names = {n: i for i, n in enumerate(dict.fromkeys([r["name"] for r in best] + terms))}
    # about `sample` rows, and never more: the driver holds a bounded number of feature lists
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 0.95 * sample / total) * (1 << 30))
    chosen = F.broadcast(kinds.where(part).limit(sample))
    taken = texts.join(chosen, "id").select("text", "toxic").mapInArrow(_sampled(names), "found array<int>, named array<array<int>>, toxic int").limit(sample).toArrow()
    found, named, toxic = (taken.column(c).combine_chunks() for c in ("found", "named", "toxic"))
    if not 0 < sum(toxic.to_pylist()) < len(toxic):
        return Classifier({}, math.log(rate / (1 - rate)))
    groups = [[{names[f] for f in word_features(t) if f in names} for t in group] for group in IDENTITIES]
    w, bias = fit(found, named.to_pylist(), toxic.to_numpy(zero_copy_only=False), groups, len(names))
    return Classifier({n: float(w[i]) for n, i in names.items() if w[i]}, float(bias))


def _scored(model: Classifier):
    def run(batches):
        for batch in batches:
            scores = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["id", "tid", "score"])
    return run


def score_toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tid, score for each row of `docs`, from its text alone.

    Null and empty texts get the score of the bias. Null ids stay (as NO_ID); repeated rows each give their row.
    """
    return keyed(docs, id_col, text_col).mapInArrow(_scored(model), "id long, tid long, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score_toxicity(docs, train(docs, labels))
    doc_id = id_back()
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, with all columns; texts are scored in place, without a join.

    A text is rejected if it scores THRESHOLD or more and more than an empty text does: where the labels have taught nothing,
    or a text holds nothing that they have taught, it stays, however many of the labelled rows are toxic. Null and empty
    texts stay; null ids stay; repeated rows share their fate; an empty table gives none.
    """
    none = model.score("")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(row.alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    @F.pandas_udf("boolean")
    def stays(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            scores = texts.map(model.score)
            yield (scores < THRESHOLD) | (scores <= none)

    return kept.where(stays("text")).select("row.*")
