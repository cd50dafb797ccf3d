"""SimHash near-duplicates: exact links within a Hamming radius, by bit-sliced comparison."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from ..operators.components import connected_components
from ..operators.durable import written
from .common import NO_ID, id_back, keyed

#: Links differ in at most RADIUS of 64 bits: of six blocks, at least three are then equal.
RADIUS = 3
_WIDTHS = (11, 11, 11, 11, 10, 10)
#: A bucket with more fingerprints than this is cut into chunks, and each pair of chunks is a task's cell.
CHUNK = 8192
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, size: int) -> int:
    """A bit is 1 if it is set in over half the XXH64 (seed 42) of the text's word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "tid", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id, tid, fp (the 64 bits as a signed long) for each row; a text without words has fp 0."""
    return keyed(docs, id_col, text_col).mapInArrow(_fingerprints(size), "id long, tid long, fp long")


def _masks() -> list[int]:
    blocks, at = [], 0
    for width in _WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    out = []
    for three in combinations(blocks, 3):
        mask = three[0] | three[1] | three[2]
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


class _Groups:
    """Connected groups of array positions; every position points at the least of its group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def bit_sliced_groups(fps: np.ndarray, run_end: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each position the least position it is linked to, directly or not, inside its run.

    Bit planes hold one bit of 64 fingerprints in a word. A fingerprint is compared with the 64 that
    follow it at once: each plane is XORed with the fingerprint's bit and added to two-bit counters by
    carry-save logic; a third word marks what has gone over the radius. Blocks in which all
    have are abandoned every eighth plane.
    """
    if radius != 3:
        raise ValueError("the counters hold two bits: the radius is 3")
    n = len(fps)
    groups = _Groups(n)
    words = n // 64 + 3
    planes = np.zeros((64, words), np.uint64)
    for p in range(64):
        packed = np.packbits(((fps >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little")
        planes[p].view(np.uint8)[: len(packed)] = packed
    left = run_end - np.arange(n) - 1
    block = 0
    while True:
        row = np.flatnonzero(left > 64 * block)
        if not len(row):
            return groups.root
        for part in np.array_split(row, max(1, len(row) // 65536)):
            _compare(fps, planes, left, part, block, groups)
        block += 1


def _compare(fps, planes, left, row, block, groups) -> None:
    at = row + 1 + 64 * block
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    up = np.uint64(63) - shift
    lanes = np.minimum(left[row] - 64 * block, 64).astype(np.uint64)
    valid = _ONES >> (np.uint64(64) - lanes)
    query = fps[row]
    one = two = np.zeros(len(row), np.uint64)
    over = ~valid
    for p in range(64):
        seen = (planes[p][word] >> shift) | ((planes[p][word + 1] << np.uint64(1)) << up)
        differs = seen ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
        carry = one & differs
        one = one ^ differs
        over = over | (two & carry)
        two = two ^ carry
        if p % 8 == 7:
            alive = over != _ONES
            if not alive.all():
                row, word, shift, up, query, one, two, over = (x[alive] for x in (row, word, shift, up, query, one, two, over))
                if not len(row):
                    return
    near = ~over
    bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    who, lane = np.nonzero(bits)
    groups.link(row[who], row[who] + 1 + 64 * block + lane)


def _cells(batches):
    """Over rows sorted by cell: links that connect the fingerprints of each cell, at most one for each fingerprint."""
    rest = None
    for batch in batches:
        table = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        rest = table if rest is None else np.concatenate([rest, table], axis=1)
        if rest.shape[1]:
            cut = int(_run_starts(rest)[-1])  # the last cell may go on in the next batch
            if cut:
                yield _links(rest[:, :cut])
                rest = rest[:, cut:]
    if rest is not None and rest.shape[1]:
        yield _links(rest)


def _run_starts(table):
    return np.concatenate([[0], np.flatnonzero((table[:4, 1:] != table[:4, :-1]).any(axis=0)) + 1])


def _links(table):
    starts = _run_starts(table)
    ends = np.repeat(np.append(starts[1:], table.shape[1]), np.diff(np.append(starts, table.shape[1])))
    fps = np.ascontiguousarray(table[4]).view(np.uint64)
    root = bit_sliced_groups(fps, ends)
    tied = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(table[4][tied]), pa.array(table[4][root[tied]])], ["a", "b"])


def near_links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints that join all pairs within the radius, and no others.

    Each fingerprint goes to twenty buckets, one for each choice of three of its six blocks: 32 equal
    bits. Buckets hold distinct fingerprints, so copies weigh nothing. A crowded bucket becomes a
    grid of chunk pairs; only joining links leave a cell, never its pairs.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(_masks())]))
    keyed_prints = prints.select("fp", keys.alias("key")).select("fp", "key.t", "key.k")
    crowded = keyed_prints.groupBy("t", "k").count().where(F.col("count") > CHUNK)
    crowded = crowded.select("t", "k", F.ceil(F.col("count") / CHUNK).cast("int").alias("m"))
    cells = keyed_prints.join(crowded, ["t", "k"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = cells.select("t", "k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    cells = cells.repartition("t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y")
    return cells.mapInArrow(_cells, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id, tid, fp, root, component_id for each row of `docs`; root is the least fingerprint of the group.

    Fingerprints link at three or fewer differing bits; component_id is the smallest id that can be
    reached. A null or blank text has fingerprint 0 and links like any other. A null id gets the
    component of its group, and is no name for one: null only if no other id is there. Repeated
    rows give repeated rows; an empty table gives none.
    """
    rows = written(fingerprints(docs, id_col, text_col, size))
    prints = written(rows.groupBy("fp").agg(F.min(id_back()).alias("least"), F.count("*").alias("n")))
    roots = connected_components(prints.select(F.col("fp").alias("pos")), near_links(prints))
    classes = prints.join(roots.select(F.col("pos").alias("fp"), "root"), "fp")
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(heads, "root").select("fp", "n", "root", "component_id"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most a thousand fingerprints hold more than a thousandth of the rows each
    hot = F.col("n") > F.lit(total // 1000)
    often = classes.where(hot).select("fp", F.struct("root", "component_id").alias("often"))
    rows = rows.join(F.broadcast(often), "fp", "left")
    hot_rows = rows.where("often is not null").select("id", "tid", "fp", "often.root", "often.component_id")
    cold_rows = rows.where("often is null").select("id", "tid", "fp").join(classes.where(~hot).drop("n"), "fp")
    return hot_rows.union(cold_rows.select("id", "tid", "fp", "root", "component_id"))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(id_back().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group of near-duplicates, with all columns.

    Of rows with that id, one with the smallest text hash stays. Null ids stay only in groups without an id.
    """
    found = near_duplicates(docs, id_col, text_col)
    stay = found.where(F.coalesce("component_id", F.lit(NO_ID)) == F.col("id")).groupBy("root", "id").agg(F.min("tid").alias("tid"))
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed_docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                             F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), mark.alias("tid"))
    kept = keyed_docs.join(stay, ["id", "tid"], "left_semi")
    # repeated rows: the join has already brought them together
    place = F.row_number().over(W.partitionBy("id", "tid").orderBy(F.xxhash64("row")))
    return kept.withColumn("place", place).where("place = 1").select("row.*")
