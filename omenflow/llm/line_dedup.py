"""Exact line dedup over a corpus: first occurrences are streamed, keep bitmaps are returned."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import written
from .common import id_back, keyed

_SPACES = b" \t\n\x0b\x0c\r"
DROP, OPEN, EDGE = 0, 1, 2
#: Rows of line hashes that leave a task at once.
_ROWS = 200_000


def _line_hashes(least: int):
    """id, tid, pos, h1, h2 of every line whose key has at least `least` code points."""
    def run(batches):
        for batch in batches:
            ids, tids, texts = (batch.column(i).to_pylist() for i in range(3))
            out_id, out_tid, out_pos, digests = [], [], [], []
            for doc, tid, text in zip(ids, tids, texts):
                for pos, line in enumerate(text.encode().lower().split(b"\n")):  # bytes.lower folds A-Z alone
                    key = line.strip(_SPACES)
                    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
                        continue
                    out_id.append(doc)
                    out_tid.append(tid)
                    out_pos.append(pos)
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                if len(out_id) >= _ROWS:
                    yield _hash_batch(out_id, out_tid, out_pos, digests)
                    out_id, out_tid, out_pos, digests = [], [], [], []
            yield _hash_batch(out_id, out_tid, out_pos, digests)
    return run


def _hash_batch(ids, tids, pos, digests):
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tids, pa.int64()), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
        ["id", "tid", "pos", "h1", "h2"],
    )


def _stream(batches):
    """Over rows sorted by hash, id, pos: what is no first occurrence, and what only another partition can tell.

    DROP rows have an earlier document inside the partition. OPEN rows belong to the partition's
    first hash and to its first document there. EDGE rows name the first document of the
    partition's first and last hash.
    """
    last, head, first_doc = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, tid, pos, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        n = len(doc)
        start = np.empty(n, bool)
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        start[0] = last != (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
        first = np.where(at >= 0, doc[np.maximum(at, 0)], first_doc)
        if head is None:
            head = (h1[0], h2[0])
            yield _marks(EDGE, [0], [0], [0], h1[:1], h2[:1], first[:1])
        drop = doc != first
        unsure = ~drop & (h1 == head[0]) & (h2 == head[1])
        yield _marks(DROP, doc[drop], tid[drop], pos[drop], h1[drop], h2[drop], first[drop])
        yield _marks(OPEN, doc[unsure], tid[unsure], pos[unsure], h1[unsure], h2[unsure], first[unsure])
        last, first_doc = (h1[-1], h2[-1]), first[-1]
    if last is not None:
        yield _marks(EDGE, [0], [0], [0], [last[0]], [last[1]], [first_doc])


def _marks(kind, doc, tid, pos, h1, h2, first):
    long = lambda x: pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), long(doc), long(tid), pa.array(np.asarray(pos, np.int32)), long(h1), long(h2), long(first)],
        ["kind", "id", "tid", "pos", "h1", "h2", "first"],
    )


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """id, tid, pos of the lines that stand in an earlier document as well.

    Line hashes are range-partitioned by hash, document and position, so that a hash that a third
    of all lines share is spread over many tasks. Each task streams its rows and knows the first
    document of every hash but the one it begins with; for that one, the partitions' edges (two rows
    for each partition) tell the first document.
    """
    rows = keyed(docs, id_col, text_col)
    hashes = rows.mapInArrow(_line_hashes(least), "id long, tid long, pos int, h1 long, h2 long")
    order = ["h1", "h2", "id", "tid", "pos"]
    marks = hashes.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = written(marks.select("id", "tid", "pos", "h1", "h2").mapInArrow(
        _stream, "kind int, id long, tid long, pos int, h1 long, h2 long, first long"
    ))
    # at most two rows for each partition of the streamed table
    edges = marks.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("first").alias("least"))
    late = marks.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).where("id > least")
    return marks.where(F.col("kind") == DROP).select("id", "tid", "pos").union(late.select("id", "tid", "pos"))


def _bitmap(batches):
    for batch in batches:
        out = []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, bool)
            if gone:
                keep[np.array(gone)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(out, pa.binary())],
            ["id", "tid", "n_lines", "n_dropped", "keep"],
        )


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """id, tid, n_lines, n_dropped, keep for each document: a zlib-packed bit for each of its lines.

    A line's key is the line without the ASCII spaces around it and with A-Z in lower case. A key of at
    least `least` code points that stands in several documents keeps its lines in the one with the
    smallest id, all of them; other documents lose theirs. Shorter keys stay everywhere.

    A null text is an empty one and has one line. A null id is the smallest id (id is NO_ID).
    Repeated rows with one id are one document: they lose no line to each other. An empty table
    gives none. `tid` is xxhash64 of the text: (id, tid) leads back to the row.
    """
    gone = repeated_lines(docs, id_col, text_col, least).groupBy("id", "tid").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counts = keyed(docs, id_col, text_col).select("id", "tid", lines.cast("int").alias("n_lines")).distinct()
    full = counts.join(gone, ["id", "tid"], "left").select(
        "id", "tid", "n_lines", "gone", F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped")
    )
    full = full.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    return full.mapInArrow(_bitmap, "id long, tid long, n_lines int, n_dropped int, keep binary")


def _apply(batches):
    for batch in batches:
        texts, n_lines, bitmaps = (batch.column(i).to_pylist() for i in (1, 2, 4))
        dropped = batch.column(3).to_pylist()
        kept = []
        for text, n, lost, keep in zip(texts, n_lines, dropped, bitmaps):
            if lost:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                text = "\n".join(line for line, bit in zip(text.split("\n"), bits) if bit)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, kept for each row of `docs`: its lines that the bitmap keeps, joined by newlines."""
    rows = keyed(docs, id_col, text_col).join(bitmaps, ["id", "tid"])
    rows = rows.select("id", "text", "n_lines", "n_dropped", "keep")
    return rows.mapInArrow(_apply, "id long, n_lines int, n_dropped int, kept string")


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    kept = apply_bitmaps(docs, line_keep_bitmaps(docs))
    return kept.select(
        id_back().alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


LINE_SQL = """
with lines as (
  select doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
first as (
  select key, min(doc_id) as least from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (
  select l.doc_id, l.pos, l.line, f.least is not null and f.least <> l.doc_id as gone
  from lines l left join first f on l.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
