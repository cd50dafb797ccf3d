"""Language-model scores by deleted interpolation of word n-grams.

P(w | u v) = l(uv) c(uvw)/c(uv) + (1 - l(uv)) [ l(v) c(vw)/c(v) + (1 - l(v)) [ l c(w)/N + (1 - l)/(V + 1) ] ],
where each weight l belongs to a bucket of context frequencies. The weights are learned by
expectation-maximisation on texts whose n-grams were held out of the counts.

Texts become units of at most UNIT tokens. A unit sends each of its distinct n-grams once to the bucket of its hash, gets the
corpus-wide counts back in the same order, and scores its texts; no table of n-grams is sent to all tasks.
"""

import itertools
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import written
from .common import NO_ID, held_out, id_back

#: Tokens of a unit at most, n-grams of a bucket about, and buckets for each order at least.
UNIT, BUCKET, BUCKETS = 1 << 20, 1_000_000, 64
#: One in HELD of the learned texts is held out of the counts that the weights are learned on.
HELD = 10
#: Rounds of expectation-maximisation at most; they end once no weight moves by more than STILL.
ROUNDS, STILL = 25, 1e-4
#: Classes of texts: counted, held out of the counts for the weights, not learned at all.
COUNTED, TUNING, UNSEEN = 0, 1, 2
#: Bytes of a text that are cut into words at once.
_WINDOW = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BOS, _END = None, False  # words are bytes, so these two are none
_LOCAL = {_BOS: 0, _END: 1}
_MARKS = np.array([0x9D39247E33776D41, 0x2AF7398005AAA5C7], np.uint64)  # hashes of the two
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PIECES = pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("first", pa.bool_())]))
_UNIT = "unit long, cls int, n long, pieces array<struct<row:long,id:long,n:int,first:boolean>>, stream binary, words binary"


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed: small numbers and small differences take little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=size * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, size).T).view(kind).ravel()


def _windows(text: bytes):
    """Lists of the text's words, one list for about _WINDOW bytes."""
    at = 0
    while at < len(text):
        end = at + _WINDOW
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()  # bytes: A-Z and the six ASCII spaces only
        at = end


class _Unit:
    """Texts of one class whose words are numbered together."""

    def __init__(self, cls: int):
        self.cls, self.size, self.ids, self.pieces = cls, 0, [], []
        self.numbers = defaultdict(itertools.count(len(_LOCAL)).__next__, _LOCAL)

    def put(self, words: list) -> None:
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))

    def row(self, unit: int) -> dict:
        ids = np.concatenate(self.ids)
        hashes = [xxhash.xxh64_intdigest(w) for w in itertools.islice(self.numbers, len(_LOCAL), None)]
        hashes = np.concatenate([_MARKS, np.array(hashes, np.uint64)])
        often = np.argsort(-np.bincount(ids, minlength=len(hashes)), kind="stable")  # small numbers for frequent words
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        return {"unit": unit, "cls": self.cls, "n": len(ids), "pieces": self.pieces, "stream": _packed(place[ids]), "words": hashes[often].tobytes()}


def _units(limit: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        open_, rows, made = {}, itertools.count(part << 40), itertools.count(part << 32)
        for batch in batches:
            for doc, cls, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row, last, first = next(rows), [_BOS, _BOS], True
                unit, piece = open_.get(cls), None
                for words in itertools.chain(_windows(text), [[_END]]):
                    at = 0
                    while at < len(words):
                        if unit is not None and unit.size >= limit:
                            yield _unit_batch(unit.row(next(made)))
                            unit = None
                        if unit is None:
                            unit = open_[cls] = _Unit(cls)
                            piece = None
                        if piece is None:
                            piece = {"row": row, "id": doc, "n": 0, "first": first}
                            unit.pieces.append(piece)
                            unit.put(last)
                            first = False
                        taken = words[at:at + limit - unit.size]
                        unit.put(taken)
                        unit.size += len(taken)
                        piece["n"] += len(taken)
                        last = (last + taken[-2:])[-2:]
                        at += len(taken)
        for unit in open_.values():
            yield _unit_batch(unit.row(next(made)))
    return run


def _unit_batch(row: dict) -> pa.RecordBatch:
    kinds = [("unit", pa.int64()), ("cls", pa.int32()), ("n", pa.int64()), ("pieces", _PIECES), ("stream", pa.binary()), ("words", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in kinds], [n for n, _ in kinds])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


class _Grams:
    """The n-grams of a unit, by place. Order 1 has 64 bits of hash; pairs and triples have 56."""

    BITS = {1: 64, 2: 56, 3: 56}
    BOS_KEY = int(_mixed(_MARKS[:1])[0])

    def __init__(self, row: dict):
        size = np.array([p["n"] + 2 for p in row["pieces"]], np.int64)
        starts = np.cumsum(size) - size
        ids = _unpacked(row["stream"], row["n"], np.uint32)
        word = np.frombuffer(row["words"], np.uint64)[ids]
        asked = np.ones(len(ids), bool)
        asked[starts] = False  # the outer context word
        scored = asked.copy()
        scored[starts + 1] = False  # the inner one
        self.size, self.scored, self.asked = size - 2, scored, asked
        # the inner context word of a text's beginning stands for the beginning itself: it is counted as a context
        weight = scored.copy()
        weight[starts + 1] = [p["first"] for p in row["pieces"]]
        self.weight = {1: weight[asked], 2: weight[asked], 3: None}
        self.word = word

    def keys(self, order: int) -> np.ndarray:
        """Hashes of the n-grams of one order, at the places that ask for them."""
        word = self.word
        if order == 1:
            return _mixed(word[self.asked])
        pair = word[1:] * _ODD[1] + word[:-1] * _ODD[2]
        if order == 2:
            return _mixed(pair[self.asked[1:]]) >> np.uint64(8)
        return _mixed((pair[1:] * _ODD[2] + word[:-2])[self.scored[2:]]) >> np.uint64(8)

    def spread(self, order: int, counts: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Counts of the distinct n-grams, at each place where one ends."""
        out = np.zeros(len(self.asked), counts.dtype)
        out[self.scored if order == 3 else self.asked] = counts[back]
        return out


def _bounds(keys: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends among sorted keys: buckets are equal ranges of hashes."""
    bucket = ((keys >> np.uint64(_Grams.BITS[order] - 32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


_ASKED = "bucket int, unit long, cls int, n int, keys binary, counts binary"


def _asking(buckets: int):
    """Over units: their distinct n-grams with the unit's own counts, by bucket."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = _Grams(row)
                out = []
                for order in (1, 2, 3):
                    if order == 3:
                        keys, counts = np.unique(grams.keys(order), return_counts=True)
                    else:
                        keys, back = np.unique(grams.keys(order), return_inverse=True)
                        counts = np.bincount(back, grams.weight[order], len(keys))
                    cuts = _bounds(keys, order, buckets)
                    steps = np.diff(keys, prepend=np.uint64(0))
                    for b in np.flatnonzero(np.diff(cuts)):
                        low, high = cuts[b], cuts[b + 1]
                        step = steps[low:high].copy()
                        step[0] = keys[low]
                        out.append(((order - 1) * buckets + b, row["unit"], row["cls"], high - low, _packed(step), _packed(counts[low:high].astype(np.uint32))))
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "unit", "cls", "n", "keys", "counts"])
    return run


_ANSWER = "unit long, bucket int, n int, total binary, counted binary, known long"


def _answering(buckets: int):
    """Over one bucket: each unit's n-grams summed over all units, in the unit's own order.

    The last row tells how many distinct learned words the bucket has.
    """
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.cumsum(_unpacked(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
        own = np.concatenate([_unpacked(r["counts"], r["n"], np.uint32) for r in rows])
        sizes = np.array([r["n"] for r in rows])
        cls = np.repeat([r["cls"] for r in rows], sizes)
        distinct, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, own * (cls != UNSEEN), len(distinct)).astype(np.int64)
        counted = np.bincount(back, own * (cls == COUNTED), len(distinct)).astype(np.int64)
        out, at = [], 0
        for r, size in zip(rows, sizes):
            mine = back[at:at + size]
            at += size
            out.append((r["unit"], r["bucket"], r["n"], _packed(total[mine]), _packed(counted[mine]) if r["cls"] == TUNING else None, None))
        if rows[0]["bucket"] < buckets:
            out.append((None, rows[0]["bucket"], 0, None, None, int(((total > 0) & (distinct != np.uint64(_Grams.BOS_KEY))).sum())))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["unit", "bucket", "n", "total", "counted", "known"])
    return run


def _counts(unit: pa.Table, answers: pa.Table, column: str) -> tuple:
    """A unit's row and, at each scored place, the counts c(uvw), c(uv), c(vw), c(v), c(w)."""
    row = unit.to_pylist()[0]
    grams = _Grams(row)
    parts = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers[column].to_pylist()))
    counts = np.concatenate([_unpacked(data, n, np.int64) for _, n, data in parts])
    if len(counts) and counts.max() < 2**31:
        counts = counts.astype(np.int32)
    here = np.flatnonzero(grams.scored)
    at, found = 0, []
    for order in (1, 2, 3):  # one order at a time: the hashes are what takes memory
        keys, back = np.unique(grams.keys(order), return_inverse=True)
        spread = grams.spread(order, counts[at:at + len(keys)], back)
        at += len(keys)
        del keys, back
        found += [spread[here], spread[here - 1]][: 1 if order == 3 else 2]
    c1, n2, c2, n3, c3 = found
    return row, grams, c3, n3, c2, n2, c1


def frequency_bucket(count):
    """Contexts of one order that share a weight: 0 for none, else one bucket for each power of two."""
    return np.frexp(count.astype(np.float64))[1] if isinstance(count, np.ndarray) else int(count).bit_length()


@dataclass
class Model:
    """Sizes of the learned texts and the weights of the mixture.

    `triple` and `pair` hold one weight for each bucket of context frequencies, `word` the one of the word frequencies.
    """

    tokens: int
    known: int
    triple: np.ndarray = field(default_factory=lambda: np.full(64, 0.5))
    pair: np.ndarray = field(default_factory=lambda: np.full(64, 0.5))
    word: float = 0.5

    def probabilities(self, c3, n3, c2, n2, c1) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            word = self.word if self.tokens else 0.0
            p = word * c1 / max(self.tokens, 1) + (1 - word) / (self.known + 1)
            for count, context, weight in ((c2, n2, self.pair), (c3, n3, self.triple)):
                # a context that was never seen says nothing: the lower order stands alone
                w = np.where(context > 0, weight[frequency_bucket(context)], 0.0)
                p = w * np.where(context > 0, count / context, 0.0) + (1 - w) * p
        return p


def _tuning(unit: pa.Table, answers: pa.Table) -> pa.Table:
    """Distinct combinations of counts at the places of a held-out unit, and how often each occurs."""
    _, _, *counts = _counts(unit, answers, "counted")
    mark = np.zeros(len(counts[0]), np.uint64)
    for c in counts:
        mark = _mixed(mark * _ODD[1] + c.astype(np.uint64))
    _, first, times = np.unique(mark, return_index=True, return_counts=True)
    return pa.table([*(c[first].astype(np.int64) for c in counts), times], names=["c3", "n3", "c2", "n2", "c1", "times"])


def learn_weights(events: DataFrame, tokens: int, known: int, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over held-out places.

    `events`: c3, n3, c2, n2, c1, times. Each round is one aggregate; the driver gets one row for each pair of buckets. A
    weight is (its share + 1) / (places + 2): without places it is one half, and it never becomes 0 or 1.
    """
    model = Model(tokens, known)
    bucket = lambda c: F.when(F.col(c) > 0, F.length(F.bin(c))).otherwise(0)
    for _ in range(rounds):
        pick = lambda weights, b: F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(b))
        rows = events.withColumns({"b3": bucket("n3"), "b2": bucket("n2")})
        rows = rows.withColumns({"l3": F.when(F.col("b3") > 0, pick(model.triple, "b3")).otherwise(0.0), "l2": F.when(F.col("b2") > 0, pick(model.pair, "b2")).otherwise(0.0)})
        word = F.col("c1") * F.lit(model.word / max(tokens, 1))
        flat = F.lit((1 - model.word) / (known + 1))
        rows = rows.withColumns({
            "p3": F.coalesce(F.col("l3") * F.try_divide("c3", "n3"), F.lit(0.0)),
            "p2": F.coalesce((1 - F.col("l3")) * F.col("l2") * F.try_divide("c2", "n2"), F.lit(0.0)),
            "p1": (1 - F.col("l3")) * (1 - F.col("l2")) * word, "p0": (1 - F.col("l3")) * (1 - F.col("l2")) * flat,
        })
        rows = rows.withColumn("p", F.col("p3") + F.col("p2") + F.col("p1") + F.col("p0"))
        share = lambda c: F.sum(F.col("times") * F.col(c) / F.col("p"))
        sums = rows.groupBy("b3", "b2").agg(F.sum("times").alias("n"), share("p3").alias("r3"), share("p2").alias("r2"), share("p1").alias("r1")).collect()
        new = Model(tokens, known)
        for weights, b, got, rest in ((new.triple, "b3", "r3", lambda s: s["n"]), (new.pair, "b2", "r2", lambda s: s["n"] - s["r3"])):
            for k in {s[b] for s in sums if s[b] > 0}:
                mine = [s for s in sums if s[b] == k]
                weights[k] = (sum(s[got] for s in mine) + 1) / (sum(map(rest, mine)) + 2)
        left = sum(s["n"] - s["r3"] - s["r2"] for s in sums)
        new.word = (sum(s["r1"] for s in sums) + 1) / (left + 2)
        moved = max(np.abs(new.triple - model.triple).max(), np.abs(new.pair - model.pair).max(), abs(new.word - model.word))
        model = new
        if moved <= STILL:
            break
    return model


_SCORE = "row long, id long, cls int, n_tokens long, n_known long, base_score double, score double"


def _scoring(model: Model):
    def run(unit: pa.Table, answers: pa.Table) -> pa.Table:
        row, grams, c3, n3, c2, n2, c1 = _counts(unit, answers, "total")
        logs = np.log10(model.probabilities(c3, n3, c2, n2, c1))
        base = np.log10((c1 + 0.5) / (model.tokens + 0.5 * (model.known + 1)))
        starts = np.cumsum(grams.size) - grams.size
        add = lambda x: np.add.reduceat(x, starts)
        pieces = row["pieces"]
        return pa.table({
            "row": pa.array([p["row"] for p in pieces], pa.int64()), "id": pa.array([p["id"] for p in pieces], pa.int64()),
            "cls": pa.array([row["cls"]] * len(pieces), pa.int32()), "n_tokens": pa.array(grams.size, pa.int64()),
            "n_known": pa.array(add((c1 > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(logs)),
        })
    return run


def interpolated_scores(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> tuple[DataFrame, Model]:
    """doc_id, learned, n_tokens, n_known, base_score, score for each row, and the model.

    `learned` says which rows' texts the model may learn from (null: it may not). Words are runs of anything but the six ASCII
    spaces with A-Z in lower case, and each text is closed by one end, which counts as a token. The
    `base_score` is the log10 probability by add-one-half unigrams, `score` that of the interpolated triples. Weights come
    from counts without one text in HELD; scores use the counts of all learned texts.

    A null text is empty: its only token is the end. A null id stays and is a row like any other; repeated
    rows are learned and scored as often as they occur. A very long text is cut into pieces that know the two
    words before them, so its score is that of the whole. Without learned texts each token has probability 1 by both measures, as
    no word is known; an empty table gives no rows.
    """
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    cls = F.when(~F.coalesce(learned, F.lit(False)), UNSEEN).when(F.pmod(F.xxhash64(id_), F.lit(HELD)) == 0, TUNING).otherwise(COUNTED)
    rows = docs.select(id_.alias("id"), cls.alias("cls"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    units = written(rows.mapInArrow(_units(unit), _UNIT))
    size = F.col("n") - 2 * F.size("pieces")
    sums = {r["cls"]: r["n"] for r in units.groupBy("cls").agg(F.sum(size).alias("n")).collect()}
    buckets = max(BUCKETS, -(-sum(sums.values()) // BUCKET))
    asked = units.mapInArrow(_asking(buckets), _ASKED)
    answers = written(asked.groupBy("bucket").applyInArrow(_answering(buckets), _ANSWER))
    known = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    answers = answers.where(F.col("unit").isNotNull())
    meet = lambda u, a: u.groupBy("unit").cogroup(a.groupBy("unit"))
    held = meet(units.where(F.col("cls") == TUNING), answers.where(F.col("counted").isNotNull()))
    names = ["c3", "n3", "c2", "n2", "c1"]
    events = held.applyInArrow(_tuning, ", ".join(f"{n} long" for n in [*names, "times"]))
    events = written(events.groupBy(*names).agg(F.sum("times").alias("times")))
    model = learn_weights(events, sums.get(COUNTED, 0), known)
    model.tokens = sums.get(COUNTED, 0) + sums.get(TUNING, 0)
    pieces = meet(units, answers.drop("counted")).applyInArrow(_scoring(model), _SCORE)
    scores = pieces.groupBy("row").agg(
        F.first("id").alias("id"), F.first("cls").alias("cls"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    return scores.select(id_back().alias("doc_id"), (F.col("cls") != UNSEEN).alias("learned"), "n_tokens", "n_known", "base_score", "score"), model


def score_digest(docs: DataFrame) -> DataFrame:
    out = held_out(F.col("doc_id"), 5, 1)
    scores, model = interpolated_scores(docs, ~out)
    return scores.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
