"""Hard negatives by rotated one-bit codes: popcount estimates with certain bounds choose what is scored exactly.

A vector o is rotated and kept as the signs of its components, x = signs / sqrt(D), with its alignment a = <x, o>. What is left,
r = o - a x, is orthogonal to x; it is rotated and coded again, LEVELS times. For an anchor q,

    <o, q> = sum of a_l <x_l, q_l> + <r, q>,   |<r, q>| <= |r| sqrt(|q|^2 - <x, q>^2)   (Cauchy-Schwarz),

where <x_l, q_l> is a sum of popcounts over the bit planes of the quantised anchor, off by no more than the
length of the quantisation error. So every estimate comes with an interval that holds the true score for certain.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.durable import written
from .common import NO_ID, id_back

#: Codes of a vector, one on what the other leaves, and bit planes of an anchor.
LEVELS, PLANES = 4, 8
#: Anchors of a block and rows of a cell, about; cells for each block at least; rows of a cell that are compared at once.
ANCHORS, ROWS, SLOTS, TILE = 2048, 8192, 64, 1024
#: Rounding in the bounds, as a share of the two lengths; lengths whose product stays below EXACT give exact sums in doubles.
SLACK, EXACT = 1e-9, 2.0**53
_LONG = (-(2**63), 2**63 - 1)

_CODED = "id long, label long, anchor boolean, comps binary, codes binary, aligned array<double>, rest double, length double"


def rotations(size: int, levels: int = LEVELS) -> list[np.ndarray]:
    """One orthogonal matrix for each level, the same everywhere."""
    rng = np.random.default_rng(42)
    return [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(levels)]


def _sign_words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the last one filled up with zeros."""
    n, size = signs.shape
    padded = np.zeros((n, -(-size // 64) * 64), bool)
    padded[:, :size] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def one_bit_codes(vectors: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of signs (row, level, word), alignments (row, level), and the length of what no level holds."""
    left, words, aligned = vectors, [], []
    size = vectors.shape[1]
    for turn in turns:
        left = left @ turn.T
        signs = left >= 0
        a = np.abs(left).sum(axis=1) / np.sqrt(size)
        left = left - np.where(signs, 1.0, -1.0) * (a / np.sqrt(size))[:, None]
        words.append(_sign_words(signs))
        aligned.append(a)
    return np.stack(words, axis=1), np.stack(aligned, axis=1), np.sqrt((left * left).sum(axis=1))


def _coding(size: int):
    def run(batches):
        turns = rotations(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                given = part.column(3).to_pylist()
                comps = np.zeros((len(given), size))
                for i, x in enumerate(given):
                    comps[i, :len(x)] = x
                with np.errstate(over="ignore", invalid="ignore"):
                    comps = np.floor(256.0 * comps)
                    keep = np.isfinite(comps).all(axis=1)
                    comps = comps[keep]
                    words, aligned, rest = one_bit_codes(comps, turns)
                    length = np.sqrt((comps * comps).sum(axis=1))
                ids, labels, asks = (part.column(i).to_numpy(zero_copy_only=False)[keep] for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(asks, pa.bool_()), pa.array([r.tobytes() for r in comps], pa.binary()),
                     pa.array([w.tobytes() for w in words], pa.binary()), pa.array(list(aligned), pa.list_(pa.float64())),
                     pa.array(rest), pa.array(length)],
                    ["id", "label", "anchor", "comps", "codes", "aligned", "rest", "length"],
                )
    return run


class _Rows:
    """Coded vectors of a cell as arrays."""

    def __init__(self, table: pa.Table, size: int):
        n = table.num_rows
        column = lambda name: table[name].to_numpy()
        self.uid, self.id, self.label = (column(c).astype(np.int64) for c in ("uid", "id", "label"))
        joined = lambda name: b"".join(table[name].to_pylist())
        self.comps = np.frombuffer(joined("comps"), np.float64).reshape(n, size)
        self.words = np.frombuffer(joined("codes"), "<u8").reshape(n, LEVELS, -(-size // 64))
        self.aligned = np.array(table["aligned"].to_pylist(), np.float64).reshape(n, LEVELS)
        self.rest, self.length = column("rest"), column("length")


class _Anchors:
    """Anchors of a cell: bit planes of their rotated components for each level."""

    def __init__(self, rows: _Rows, turns: list[np.ndarray]):
        self.rows, left = rows, rows.comps
        self.levels = []
        top = (1 << PLANES) - 1
        with np.errstate(all="ignore"):
            for turn in turns:
                left = left @ turn.T
                low = left.min(axis=1)
                step = (left.max(axis=1) - low) / top
                steps = np.where(step[:, None] > 0, np.rint((left - low[:, None]) / step[:, None]), 0.0)
                near = low[:, None] + steps * step[:, None]
                off = np.sqrt(((left - near) ** 2).sum(axis=1))
                whole = np.nan_to_num(steps).astype(np.uint64)
                planes = np.stack([_sign_words((whole >> np.uint64(p)) & np.uint64(1) > 0) for p in range(PLANES)], axis=1)
                self.levels.append((planes, low, step, near.sum(axis=1), off))

    def level(self, level: int, i, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Estimated <x, q> and how far off it may be. `i`: anchors that broadcast against the rows' words (..., word)."""
        planes, low, step, total, off = self.levels[level]
        ones = np.bitwise_count(words).sum(axis=-1, dtype=np.int64)
        sums = np.zeros(np.broadcast_shapes(i.shape, words.shape[:-1]), np.int64)
        for p in range(PLANES):
            for w in range(words.shape[-1]):
                sums += np.bitwise_count(words[..., w] & planes[i, p, w]).astype(np.int64) << p
        held = low[i] * ones + step[i] * sums  # components whose sign is positive
        return (2 * held - total[i]) / np.sqrt(size), off[i]


def _bounds(anchors: _Anchors, rows: _Rows, i, j, floor, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i, j that may score `floor[i]` or more, with certain bounds; after each level the others are given up."""
    estimate, slack = np.zeros(len(i)), np.zeros(len(i))
    upper = np.full(len(i), np.inf)
    lower = -upper
    with np.errstate(all="ignore"):
        for level in range(LEVELS):
            s, off = anchors.level(level, i, rows.words[j, level], size)
            a = rows.aligned[j, level]
            estimate, slack = estimate + a * s, slack + a * off
            q = anchors.rows.length[i]
            if level == LEVELS - 1:
                rest = rows.rest[j]
            else:  # what the levels so far leave: |o|^2 less the alignments' squares
                rest = np.sqrt(np.maximum(rows.length[j] ** 2 - (rows.aligned[j, :level + 1] ** 2).sum(axis=1), 0.0) + (SLACK * rows.length[j]) ** 2)
            beside = np.sqrt(np.maximum(q * q - np.maximum(np.abs(s) - off, 0.0) ** 2, 0.0))
            wide = rest * beside + slack + SLACK * q * rows.length[j]
            upper, lower = estimate + wide, estimate - wide
            stay = ~(upper < floor[i])  # no number: stays
            if not stay.all():
                i, j, estimate, slack, upper, lower = (x[stay] for x in (i, j, estimate, slack, upper, lower))
    return i, j, upper, lower


def integer_scores(anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact inner products of whole components, as longs where they fit and as Python integers where they may not."""
    out = np.empty(len(i), np.int64)
    small = lengths < EXACT
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        with np.errstate(all="ignore"):
            out[part] = np.where(small[part], np.einsum("nd,nd->n", anchors[i[part]], rows[j[part]]), 0)
    if small.all():
        return out
    out = out.astype(object)
    for k in np.flatnonzero(~small):
        out[k] = sum(int(a) * int(b) for a, b in zip(anchors[i[k]], rows[j[k]]))
    return out


class _Best:
    """The first `k` candidates of each owner: higher scores first, then smaller ids."""

    def __init__(self, owners: int, k: int):
        self.k, self.owners = k, owners
        self.owner, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, owner, score, id_, uid) -> None:
        owner, score = np.concatenate([self.owner, owner]), np.concatenate([self.score, score])
        id_, uid = np.concatenate([self.id, id_]), np.concatenate([self.uid, uid])
        if score.dtype == object:  # longer than a long
            order = np.array(sorted(range(len(owner)), key=lambda x: (owner[x], -score[x], id_[x], uid[x])), np.int64)
        else:
            order = np.lexsort((uid, id_, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = order[place < self.k]
        self.owner, self.score, self.id, self.uid = owner[place < self.k], score[order], id_[order], uid[order]

    def floor(self) -> np.ndarray:
        """The last score of each owner that has all its candidates; no bound for the others."""
        out = np.full(self.owners, -np.inf)
        full = np.bincount(self.owner, minlength=self.owners) == self.k
        last = np.searchsorted(self.owner, np.flatnonzero(full), side="right") - 1
        out[full] = self.score[last].astype(np.float64)
        return out


def _no_rows(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]).empty_table()


def _as_longs(score: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in score], np.int64)


def _label_pairs(anchors: _Rows, rows: _Rows, low: int, high: int):
    """Pairs of an anchor and another row of its label among rows low to high."""
    order = np.argsort(rows.label[low:high], kind="stable") + low
    labels = rows.label[order]
    first, last = np.searchsorted(labels, anchors.label), np.searchsorted(labels, anchors.label, side="right")
    i = np.repeat(np.arange(len(first)), last - first)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
    other = anchors.uid[i] != rows.uid[j]
    return i[other], j[other]


_POSITIVE = "anchor long, anchor_id long, uid long, id long, score long"


def _positives(size: int, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (rows.num_rows and anchors.num_rows):
            return _no_rows(_POSITIVE)
        rows, anchors = _Rows(rows, size), _Anchors(_Rows(anchors, size), rotations(size))
        own = anchors.rows
        best = _Best(len(own.uid), k)
        for low in range(0, len(rows.uid), TILE):
            i, j = _label_pairs(own, rows, low, min(low + TILE, len(rows.uid)))
            floor = best.floor()
            i, j, _, lower = _bounds(anchors, rows, i, j, floor, size)
            # k lower bounds that are certain make a floor before anything is scored
            order = np.lexsort((-lower, i))
            starts = np.searchsorted(i[order], np.arange(len(floor)))
            sure = starts + k - 1
            has = np.flatnonzero(np.bincount(i, minlength=len(floor)) >= k)
            floor[has] = np.fmax(floor[has], lower[order][sure[has]])
            i, j, _, _ = _bounds(anchors, rows, i, j, floor, size)
            score = integer_scores(own.comps, rows.comps, i, j, own.length[i] * rows.length[j])
            best.add(i, score, rows.id[j], rows.uid[j])
        o = best.owner
        return pa.table([own.uid[o], own.id[o], best.uid, best.id, _as_longs(best.score)], names=["anchor", "anchor_id", "uid", "id", "score"])
    return run


_NEGATIVE = "anchor long, anchor_id long, place int, positive_id long, positive_score long, id long, uid long, score long"


def _negatives(size: int, k: int, share: tuple[int, int, int]):
    least, unit, most = share

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (rows.num_rows and anchors.num_rows):
            return _no_rows(_NEGATIVE)
        positives = anchors["positives"].to_pylist()
        rows, anchors = _Rows(rows, size), _Anchors(_Rows(anchors, size), rotations(size))
        own = anchors.rows
        wide = max([len(p) for p in positives], default=0)
        # a score that no candidate can meet stands for a positive that is not there
        held = np.array([[p["score"] for p in ps] + [None] * (wide - len(ps)) for ps in positives], object).reshape(len(positives), wide)
        there = held != None  # noqa: E711
        goal = np.where(there, held, 0).astype(np.float64)
        best = _Best(len(positives) * wide, k)
        for low in range(0, len(rows.uid), TILE):
            high = min(low + TILE, len(rows.uid))
            reach = np.where(there, goal * (least / unit) - 1e-6 * np.abs(goal), np.inf)
            floor = np.fmax(reach, best.floor().reshape(reach.shape)).min(axis=1, initial=np.inf)
            ceiling = np.where(there, goal * (most / unit) + 1e-6 * np.abs(goal), -np.inf).max(axis=1, initial=-np.inf)
            for first in range(0, len(positives), 64):
                i, j = np.nonzero(own.label[first:first + 64, None] != rows.label[None, low:high])
                i, j = i + first, j + low
                i, j, _, lower = _bounds(anchors, rows, i, j, floor, size)
                within = ~(lower > ceiling[i])
                i, j = i[within], j[within]
                score = integer_scores(own.comps, rows.comps, i, j, own.length[i] * rows.length[j])
                for p in range(wide):
                    mine = there[i, p]
                    target = np.where(mine, held[i, p], 0)
                    exact = score.dtype == object or np.abs(goal).max(initial=0) > 2**53
                    target, scored = (target, score.astype(object)) if exact else (target.astype(np.int64), score)
                    fits = mine & (least * target <= unit * scored).astype(bool) & (unit * scored <= most * target).astype(bool)
                    best.add(i[fits] * wide + p, score[fits], rows.id[j[fits]], rows.uid[j[fits]])
        i, p = best.owner // max(wide, 1), best.owner % max(wide, 1)
        of = lambda name: pa.array([positives[a][b][name] for a, b in zip(i, p)], pa.int64())
        return pa.table(
            [pa.array(own.uid[i]), pa.array(own.id[i]), pa.array(p + 1, pa.int32()), of("id"), of("score"), pa.array(best.id), pa.array(best.uid), pa.array(_as_longs(best.score))],
            names=["anchor", "anchor_id", "place", "positive_id", "positive_score", "id", "uid", "score"],
        )
    return run


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, slots: int, apply, schema: str) -> DataFrame:
    """Every block of anchors against every row: a cell holds one block and about ROWS rows."""
    block = lambda: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    slot = lambda: F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    here = rows.withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(slots)).cast("int")).withColumn("block", block())
    asked = anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).withColumn("slot", slot())
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # both sides read one table: columns of their own
    return here.groupBy("block", "slot").cogroup(asked.groupBy("block", "slot")).applyInArrow(apply, schema)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                        positives: int = 5, negatives: int = 5, share: tuple[int, int, int] = (80, 100, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x) and scores are inner products of these whole numbers. `anchor` says which rows
    are anchors. An anchor's positives are the first `positives` other rows of its label, by score, then id. The negatives
    of an anchor and a positive are the first `negatives` rows of other labels with
    share[0] positive_score <= share[1] negative_score <= share[2] positive_score.

    Rows without a label, without a vector or with a component that is null or not finite (also after the
    multiplication) take no part. Shorter vectors are filled up with zeros. A null id is no anchor and
    comes before all ids. Repeated rows are rows of their own. Scores beyond a long are
    compared in full and returned as the nearest long. Zero vectors score 0. An empty table gives no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        F.coalesce(vector, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    picked = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), usable.alias("usable"),
    ).where("usable")
    size = max(1, picked.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0])
    coded = picked.select("id", "label", "anchor", "vector").mapInArrow(_coding(size), _CODED)
    coded = written(coded.withColumn("uid", F.monotonically_increasing_id()))
    rows, anchors = coded.drop("anchor"), coded.where("anchor").drop("anchor")
    counts = coded.agg(F.count("*"), F.count_if("anchor")).first()
    slots, blocks = max(SLOTS, -(-counts[0] // ROWS)), max(1, -(-counts[1] // ANCHORS))
    near = _cells(rows, anchors, blocks, slots, _positives(size, positives), _POSITIVE)
    order = [F.desc("score"), F.asc("id"), F.asc("uid")]
    first = near.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    found = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "score"))), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    asked = written(anchors.join(found.withColumnRenamed("anchor", "uid"), "uid"))
    hard = _cells(rows, asked, blocks, slots, _negatives(size, negatives, share), _NEGATIVE)
    ranked = hard.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", id_back("positive_id").alias("positive_id"), "rank", id_back("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negative_digest(vectors: DataFrame) -> DataFrame:
    """The contract's labels and anchors: every seventh label is moved on, every hundredth row asks."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


HARD_NEGATIVE_SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.anchor_id, p.positive_id, n.vec_id as negative_id, p.positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank
  from positive p join scored n on p.anchor_id = n.anchor_id and not n.same
    and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
