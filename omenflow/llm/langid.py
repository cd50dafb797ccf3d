"""Language identification by error-correcting output codes over hashed character n-grams."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, id_back, keyed

#: Hashed n-gram features, and bits of a codeword for each language to tell apart, at least.
BUCKETS, BITS = 8192, 31
#: Weight of a prior count for each bucket: rare n-grams say little.
PRIOR = 2.0
#: A winner whose lead over the next codeword, as a share of the loss, is below this is flagged.
AMBIGUOUS = 0.05
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def histogram(text: str) -> np.ndarray:
    """Counts of hashed letter 1- to 4-grams of the whole text, in lower case; words end at anything but letters."""
    clean = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(clean.encode("utf-32-le"), np.uint32).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    value = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if len(codes) < n:
                break
            value = (value[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + codes[n - 1:] + np.uint64(n)
            mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n classes, at least BITS long; rows differ in about half their bits.

    With few classes every way to part them in two is a bit, repeated as often as it takes; with
    more, bits are drawn from a hash and kept if they part the classes and are new.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    bits: list[tuple[int, ...]] = []
    if n <= 7:
        bits = [tuple(1 if c == 0 or (s >> (c - 1)) & 1 else -1 for c in range(n)) for s in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    length, draw = max(BITS, 10 * math.ceil(math.log2(n))), 0
    seen = set()
    while len(bits) < length:
        bit = tuple(1 if hashlib.md5(f"{draw}:{c}".encode()).digest()[0] & 1 else -1 for c in range(n))
        draw += 1
        if abs(sum(bit)) <= max(2, n // 3) and bit not in seen and tuple(-b for b in bit) not in seen:
            seen.add(bit)
            bits.append(bit)
    return np.array(bits, np.int8).T


class LanguageCoder:
    """One linear n-gram classifier for each bit of the codewords, and loss-weighted decoding."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs)).astype(float)
        # shares of each n-gram; a language with many rows does not outweigh others
        smooth = counts + PRIOR * counts.sum(0, keepdims=True) / max(1, counts.sum()) * len(langs) + 1e-3
        share = smooth / smooth.sum(1, keepdims=True) if len(langs) else smooth
        self.weights = np.zeros((BUCKETS, self.code.shape[1]))
        for b in range(self.code.shape[1]):
            up, down = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(up) and len(down):
                self.weights[:, b] = np.log(up.mean(0) / down.mean(0))
        # how well each bit's classifier parts the languages' own n-grams: its say in decoding
        margins = share @ self.weights * self.code
        self.say = np.maximum(margins.min(0), 1e-6) if len(langs) else np.ones(self.code.shape[1])
        self.scale = np.maximum(np.abs(margins).mean(0), 1e-9) if len(langs) else np.ones(self.code.shape[1])

    def decode(self, hists: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity flag for each histogram.

        A bit's loss is exp(-margin) of its classifier, weighted by its say; the codeword with the least
        total wins. The score sets the winner's closeness against the others'.
        """
        if not self.langs:
            return ["und"] * len(hists), np.zeros(len(hists)), np.ones(len(hists), bool)
        grams = np.maximum(hists.sum(1, keepdims=True), 1)
        margin = hists @ self.weights / grams / self.scale
        # short texts decide less firmly
        loss = np.exp(-np.clip(margin[:, None, :] * self.code[None], -20, 20))
        total = (loss * (self.say / self.say.sum())).sum(2)
        order = np.argsort(total, axis=1, kind="stable")
        best = order[:, 0]
        near = np.exp(-4 * (total - total.min(1, keepdims=True)))
        score = near[np.arange(len(best)), best] / near.sum(1)
        low = np.sort(total, axis=1)
        lead = (low[:, 1] - low[:, 0]) / low[:, 1] if total.shape[1] > 1 else np.ones(len(best))
        return [self.langs[i] for i in best], score, lead < AMBIGUOUS


def _counted(batches):
    """Summed histograms for each language, over the task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if _LETTER.search(text):
                total = sums.get(lang)
                if total is None:
                    total = sums[lang] = np.zeros(BUCKETS, np.float64)
                hist = histogram(text)
                # the root holds back single very long or repetitive texts
                total += hist / math.sqrt(max(1, hist.sum()))
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.round(total[at] * 4096).astype(np.int64))], ["lang", "bucket", "n"]
        )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageCoder:
    """A coder from all rows with a language outside the held-out fold.

    Each task sums the n-gram counts of its rows for each language; the driver gets
    languages x BUCKETS sums, whatever the number of rows. Counts are integers, so reruns agree.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col).cast("long"))).select(
        F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    sums = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums["lang"].to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        np.add.at(counts, ([place[x] for x in names], sums["bucket"].to_numpy()), sums["n"].to_numpy() / 4096)
    return LanguageCoder(langs, counts)


def _predicted(coder: LanguageCoder):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores, flags = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            lettered = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            for at in range(0, len(lettered), 256):
                part = lettered[at:at + 256]
                found, score, unsure = coder.decode(np.stack([histogram(texts[i]) for i in part]).astype(float))
                for i, lang in zip(part, found):
                    langs[i] = lang
                scores[part], flags[part] = score, unsure
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(flags)],
                                             ["id", "tid", "lang_pred", "score", "ambiguous"])
    return run


def predict_language(docs: DataFrame, coder: LanguageCoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tid, lang_pred, score, ambiguous for each row, from its whole text alone.

    A null text, or one without a letter, is `und` with score 0 and flagged; so is every text if no language
    could be learned. Null ids stay (as NO_ID); repeated rows each give their row.
    """
    return keyed(docs, id_col, text_col).mapInArrow(_predicted(coder), "id long, tid long, lang_pred string, score double, ambiguous boolean")


def language_digest(docs: DataFrame) -> DataFrame:
    found = predict_language(docs, train(docs))
    doc_id = id_back()
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "ambiguous")
