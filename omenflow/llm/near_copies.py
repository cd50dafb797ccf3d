"""Near copies by SimHash and, for those it does not reach, an exact prefix index over word shingles, rarest first.

Texts whose 64-bit fingerprints link at three or fewer bits are compared first (`simhash.near_links`, on fingerprints of the same
shingles). Most near copies differ in more bits, so the index has the last word. Two texts of which the shingle sets have a Jaccard likeness of LIKE or more share one of the n - ceil(LIKE n) + 1 first shingles of
each, in any order that holds for all texts. The order here is by the number of texts that hold a shingle in the
whole corpus, so wording that many texts share is no key unless a text has little else. Texts meet by key, lengths and
places rule most meetings out, and arrays of hashes, never texts, are compared.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..operators.components import connected_components
from ..operators.durable import written
from .common import NO_ID, id_back, keyed
from .ngram_lm import _mixed, _packed, _unpacked, _Unit, _windows
from .simhash import near_links

#: Texts are near copies if the sets of their SHINGLE-word shingles have a Jaccard likeness of LIKE or more.
SHINGLE, LIKE = 5, 0.8
#: Words of a unit about, shingles of a bucket about, and buckets at least.
UNIT, BUCKET, BUCKETS = 1 << 20, 1_000_000, 64
#: Members of a key outside its largest group, up to which all of them are compared with all others at once.
FEW = 64
#: By how much the members of a key that all others are compared with grow from round to round where there are more.
CENTRES = 8
#: Members that are compared with a centre in one cell.
CHUNK = 256
_ODD = np.uint64(0xD6E8FEB86659FD93)
_PIECES = pa.list_(pa.struct([("tid", pa.int64()), ("n", pa.int64())]))
_UNITS = "unit long, n long, pieces array<struct<tid:long,n:long>>, stream binary, words binary"


def _text_units(limit: int):
    """Whole texts, each text of a task once, as numbered words in units of about `limit` words."""
    def run(batches):
        seen, unit, made = set(), None, TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            row = unit.row(made)
            kinds = {"unit": pa.int64(), "n": pa.int64(), "pieces": _PIECES, "stream": pa.binary(), "words": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in kinds.items()], list(kinds))

        for batch in batches:
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tid in seen:
                    continue
                seen.add(tid)
                unit = unit or _Unit(0)
                unit.put([])
                n = 0
                for words in _windows(text):
                    unit.put(words)
                    n += len(words)
                unit.pieces.append({"tid": tid, "n": n})
                unit.size += n + 1
                if unit.size >= limit:
                    yield closed()
                    unit, made = None, made + 1
        if unit:
            yield closed()
    return run


def _sets(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 56-bit hash of each text's distinct shingles, by text, then hash.

    A text of fewer words is one shingle, without words the empty one.
    """
    size = np.array([p["n"] for p in row["pieces"]], np.int64)
    starts = np.cumsum(size) - size
    word = np.frombuffer(row["words"], np.uint64)[_unpacked(row["stream"], row["n"], np.uint32)]
    owner = np.repeat(np.arange(len(size)), size)
    whole = max(len(word) - SHINGLE + 1, 0)
    chain = np.zeros(whole, np.uint64)
    for k in range(SHINGLE):
        chain = chain * _ODD + word[k:k + whole]
    inside = owner[:whole] == owner[SHINGLE - 1:]
    owners, hashes = [owner[:whole][inside]], [chain[inside]]
    for n in range(SHINGLE):
        short = np.flatnonzero(size == n)
        chain = np.full(len(short), n + 1, np.uint64)
        for k in range(n):
            chain = chain * _ODD + word[starts[short] + k]
        owners.append(short)
        hashes.append(chain)
    owner, hashed = np.concatenate(owners), _mixed(np.concatenate(hashes)) >> np.uint64(8)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return owner[new], hashed[new]


_ASKED = "bucket int, unit long, n int, keys binary, counts binary"


def _asking(buckets: int):
    """Over units: how many of their texts hold each shingle, by ranges of hashes. Rarity needs 48 bits only."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(_sets(row)[1] >> np.uint64(8), return_counts=True)
                cuts = np.searchsorted(((keys >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                out = []
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = slice(cuts[b], cuts[b + 1])
                    steps = np.diff(keys[mine], prepend=np.uint64(0))
                    out.append((b, row["unit"], len(steps), _packed(steps), _packed(counts[mine].astype(np.uint32))))
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "unit", "n", "keys", "counts"])
    return run


def _answering(table: pa.Table) -> pa.Table:
    """Over one bucket: the units' counts summed, in each unit's own order."""
    rows = table.to_pylist()
    keys = np.concatenate([np.cumsum(_unpacked(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
    own = np.concatenate([_unpacked(r["counts"], r["n"], np.uint32) for r in rows])
    distinct, back = np.unique(keys, return_inverse=True)
    held = np.minimum(np.bincount(back, own, len(distinct)), 2**32 - 1).astype(np.uint32)[back]
    ends = np.cumsum([r["n"] for r in rows])
    return pa.table({
        "unit": pa.array([r["unit"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "n": pa.array([r["n"] for r in rows], pa.int32()), "held": pa.array([_packed(held[end - r["n"]:end]) for r, end in zip(rows, ends)], pa.binary()),
    })


_PUBLISHED = "key long, tid long, n int, pos int, hashes binary, fp long"


def _sketched(hashed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is set in over half of its shingles' hashes, which come text by text."""
    mixed, starts = _mixed(hashed * _ODD), np.cumsum(size) - size
    prints = np.zeros(len(size), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((mixed >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts)
        prints |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return prints


def _publishing(unit: pa.Table, answers: pa.Table) -> pa.Table:
    """The keys of each text, and the whole sets and fingerprints of texts that have keys.

    A shingle that one text alone holds brings nothing together and is no key, but it keeps its place in the order.
    """
    row = unit.to_pylist()[0]
    owner, hashed = _sets(row)
    parts = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["held"].to_pylist()))
    held = np.concatenate([_unpacked(data, n, np.uint32) for _, n, data in parts])
    held = held[np.unique(hashed >> np.uint64(8), return_inverse=True)[1]]
    size = np.bincount(owner, minlength=len(row["pieces"]))
    ends = np.cumsum(size)
    order = np.lexsort((hashed, held, owner))
    place = np.arange(len(owner)) - np.repeat(ends - size, size)
    first = size - np.ceil(LIKE * size - 1e-9).astype(np.int64) + 1
    chosen = (place < first[owner]) & (held[order] >= 2)
    tids = np.array([p["tid"] for p in row["pieces"]], np.int64)
    by, none = owner[chosen], np.unique(owner[chosen])
    steps = [np.diff(hashed[ends[k] - size[k]:ends[k]], prepend=np.uint64(0)) for k in none]
    m, s = len(by), len(none)
    return pa.table({
        "key": pa.concat_arrays([pa.array(hashed[order][chosen].view(np.int64)), pa.nulls(s, pa.int64())]),
        "tid": pa.array(np.concatenate([tids[by], tids[none]])), "n": pa.array(np.concatenate([size[by], size[none]]), pa.int32()),
        "pos": pa.concat_arrays([pa.array(place[chosen], pa.int32()), pa.nulls(s, pa.int32())]),
        "hashes": pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([_packed(x) for x in steps], pa.binary())]),
        "fp": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(_sketched(hashed, size)[none].view(np.int64))]),
    })


def published_keys(rows: DataFrame, unit: int = UNIT) -> DataFrame:
    """key, tid, n, pos for the keys of each text, and tid, n, hashes, fp for the texts that have any.

    `rows`: tid, text. n is the size of the text's set, pos the place of the key in its order.
    """
    units = written(rows.select("tid", F.col("text").cast("binary").alias("text")).mapInArrow(_text_units(unit), _UNITS))
    words = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = units.mapInArrow(_asking(max(BUCKETS, -(-words // BUCKET))), _ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answering, "unit long, bucket int, n int, held binary")
    return written(units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_publishing, _PUBLISHED))


def _may_be_alike(n: Column, pos: Column, m: Column, place: Column) -> Column:
    """Whether sets of n and m can be near copies if this key, at these places, is the first that they share."""
    both = 1 + F.least(n - 1 - pos, m - 1 - place)
    return both * (1 + LIKE) >= LIKE * (n + m) - 1e-6


def _compared(batches):
    """Over rows a, chunk, side, tid, n, hashes, each cell's centre (side 0) before its members: the links that hold."""
    cell, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for a, chunk, side, tid, n, packed in zip(*(batch.column(i).to_pylist() for i in range(6))):
            have = np.cumsum(_unpacked(packed, n, np.uint64), dtype=np.uint64)
            if side == 0:
                cell, centre = (a, chunk), have
            elif cell == (a, chunk):
                both = len(np.intersect1d(centre, have, assume_unique=True))
                if both >= LIKE * (len(centre) + n - both) - 1e-9:
                    out.append((a, tid))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def exact_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are near copies. Pairs of one a are cut into cells, so a centre of many is no single task."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("m"))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("chunk"))
    wanted = pairs.select("a", "chunk", F.lit(1).alias("side"), F.col("b").alias("tid"))
    wanted = wanted.union(pairs.select("a", "chunk").distinct().select("a", "chunk", F.lit(0), "a"))
    cells = wanted.join(sets, "tid").select("a", "chunk", "side", "tid", "n", "hashes")
    return cells.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(_compared, "a long, b long")


def _linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """tid, root after more links: what they join are the roots so far."""
    of = lambda side: roots.select(F.col("tid").alias(side), F.col("root").alias(f"{side}_root"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    moved = connected_components(edges.select(F.explode(F.array("a", "b")).alias("pos")).distinct(), edges).select(F.col("pos").alias("root"), F.col("root").alias("new"))
    return written(roots.join(moved, "root", "left").select("tid", F.coalesce("new", "root").alias("root")))


def sketch_pairs(sets: DataFrame) -> DataFrame:
    """a, b: texts (tid, fp) whose fingerprints SimHash links, each with the least text of the fingerprint it is linked to."""
    hubs = written(sets.groupBy("fp").agg(F.min("tid").alias("a")))
    asked = sets.select("fp", F.col("tid").alias("b"))
    linked = near_links(hubs.select("fp")).join(hubs.select(F.col("fp").alias("a"), F.col("a").alias("tid")), "a")
    asked = written(asked.union(linked.select(F.col("b").alias("fp"), "tid")))
    # at most a thousand fingerprints are asked for by more than a thousandth of the rows each
    often = asked.groupBy("fp").count().where(F.col("count") > asked.count() // 1000).select("fp")
    often = written(hubs.join(often, "fp"))
    rare = asked.join(F.broadcast(often), "fp", "left_anti").join(hubs, "fp")
    met = asked.join(F.broadcast(often), "fp").unionByName(rare)
    return met.where("a <> b").select("a", "b").distinct()


def near_copy_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """tid, least, root for each distinct text: its least id, null if it has none, and the group it is linked to.

    Texts that SimHash links are compared first. Each text that this has not linked is then compared with one other, the least by hash
    among the first members of its keys. After that, a key of which all
    but FEW members are in one group is settled in one round: those few are compared with all others. In other
    keys the members are compared with centres, the least text of each slot; slots are cut finer from round to
    round, until the members are in one group or each has been a centre. A pair that is already in one group is not compared, a pair
    once compared not again. So a group of near copies takes pairs in proportion to its
    size, and every pair that shares a key is compared, ruled out by its lengths and places, or already linked.

    Null texts are empty; texts without words are copies of each other; repeated rows are one text. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    prints = written(rows.groupBy("tid").agg(F.min(id_back()).alias("least")))
    published = published_keys(rows)
    # copies of a text in several tasks have published the same keys
    keys = published.where(F.col("key").isNotNull()).groupBy("key", "tid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    keys = written(keys)
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    open_ = written(keys.join(shared, "key", "left_semi"))
    sets = published.where(F.col("key").isNull()).select("tid", "n", "hashes", "fp").join(open_.select("tid").distinct(), "tid", "left_semi")
    sets = written(sets.groupBy("tid").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("fp").alias("fp")))
    near = written(sketch_pairs(sets))
    sketched = written(exact_links(near, sets))
    roots, tested, slots = prints.select("tid", F.col("tid").alias("root")), None, 1
    open_ = open_.withColumn("root", F.col("tid"))
    while not open_.isEmpty():
        if tested is None:
            marked = open_.withColumn("wide", F.lit(True))
        else:
            groups = open_.groupBy("key", "root").agg(F.count("*").alias("c"))
            shape = groups.groupBy("key").agg(F.max_by("root", "c").alias("major"), (F.sum("c") - F.max("c") > FEW).alias("wide"))
            marked = written(open_.join(shape, "key"))
        slotted = marked.where("wide").withColumn("slot", F.pmod("tid", F.lit(slots)))
        centres = slotted.groupBy("key", "slot").agg(F.min(F.struct("tid", "n", "pos", "root")).alias("c"), F.count("*").alias("members"))
        centres = centres.select("key", "members", F.col("c.tid").alias("a"), F.col("c.n").alias("m"), F.col("c.pos").alias("place"), F.col("c.root").alias("a_root"))
        if tested is not None:
            centres = centres.union(marked.where("NOT wide AND root <> major").select("key", F.lit(0).cast("long"), "tid", "n", "pos", "root"))
        centres = written(centres)
        pairs = open_.join(centres.drop("members"), "key").where((F.col("root") != F.col("a_root")) & _may_be_alike(F.col("n"), F.col("pos"), F.col("m"), F.col("place")))
        if tested is None:
            pairs = pairs.groupBy(F.col("tid").alias("b")).agg(F.min("a").alias("a")).select("a", "b").join(sketched.select("b"), "b", "left_anti").select("a", "b")
        else:
            pairs = pairs.select("a", F.col("tid").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        found = written(exact_links(pairs, sets))
        if tested is None:
            found, pairs = found.union(sketched), pairs.union(near)
        if not found.isEmpty():
            roots = _linked(roots, found)
        rest = open_.drop("root").join(roots, "tid")
        apart = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        if tested is not None:  # the first round has compared one pair of each text only; settled keys have no centre of several
            apart = apart.join(centres.where("members > 1").select("key").distinct(), "key", "left_semi")
        open_ = written(rest.join(apart, "key", "left_semi").select("key", "tid", "n", "pos", "root"))
        slots *= CENTRES if tested is not None else 1
        tested = pairs if tested is None else written(tested.union(pairs))
    return prints.join(roots, "tid")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group of near copies, with all columns.

    Of rows with that id, one with the smallest text hash stays. Null ids stay only in groups without an id.
    """
    found = written(near_copy_roots(docs, id_col, text_col))
    heads = found.groupBy("root").agg(F.min("least").alias("head"))
    stay = found.join(heads, "root").where(F.col("least").eqNullSafe(F.col("head")))
    stay = stay.groupBy("root").agg(F.coalesce(F.min("least"), F.lit(NO_ID)).alias("id"), F.min("tid").alias("tid"))
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed_docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                             F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), mark.alias("tid"))
    kept = keyed_docs.join(stay, ["id", "tid"], "left_semi")
    # repeated rows: the join has already brought them together
    place = F.row_number().over(W.partitionBy("id", "tid").orderBy(F.xxhash64("row")))
    return kept.withColumn("place", place).where("place = 1").select("row.*")
