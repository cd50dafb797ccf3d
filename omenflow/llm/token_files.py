"""Token-id files: documents as ids in range-coded blocks, written and read back by Spark."""

import re
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..operators.durable import checkpoint_root
from . import range_coder
from .common import id_back, keyed

#: Ids in a block at most, and blocks that are coded together.
BLOCK, LANES = 4096, 2048
#: Id that ends a document.
END = 0
#: Chunks whose ids a worker remembers at most; past that it forgets those of more than _SHORT characters, which come back less often.
_CHUNKS, _SHORT = 900_000, 8
#: Chunks that go to the library as one text.
_JOINED = 2000
#: Where a space follows white space, or a special token is spelled out, the text goes to the library whole.
_WHOLE = re.compile(r"\s |<\|endoftext\|>")


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct chunk between spaces.

    The tokenizer's pre-tokens never reach over the place where a space follows anything but white space, so
    a text's ids are those of its chunks, each with the space before it. New chunks are asked for as one text and their
    ids cut apart where one begins with a space, which no other byte of a chunk is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark reuses its Python workers: what one task has met helps the next
        kept = sys.modules.setdefault(f"{__name__}.kept", types.SimpleNamespace(of={}))
        if path not in kept.of:
            tokenizer, opens = Tokenizer.from_file(path), np.zeros(1 << 16, bool)
            opens[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True  # the byte-level space
            kept.of[path] = (tokenizer, opens, {}, {})
        self.tokenizer, self.opens, self.first, self.later = kept.of[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, each with a space before it."""
        found, alone = {}, []
        plain = [c for c in chunks if c and not c[-1].isspace()]
        parts = [plain[at:at + _JOINED] for at in range(0, len(plain), _JOINED)]
        for part, ids in zip(parts, self._whole([" " + " ".join(p) for p in parts])):
            starts = (2 * np.flatnonzero(self.opens[np.frombuffer(ids, "<u2")])).tolist()
            if len(starts) == len(part):
                found.update((c, ids[a:b]) for c, a, b in zip(part, starts, starts[1:] + [len(ids)]))
            else:
                alone += part
        # white space at the end of a chunk would run into the space of the next
        alone += [c for c in chunks if not c or c[-1].isspace()]
        found.update(zip(alone, self._whole([" " + c for c in alone])))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.first) + len(self.later) > _CHUNKS:
            for known in (self.first, self.later):
                short = {c: ids for c, ids in known.items() if len(c) <= _SHORT}
                known.clear()
                if len(short) <= _CHUNKS // 4:
                    known.update(short)
        split = [None if _WHOLE.search(t) else t.split(" ") for t in texts]
        new_first = list({s[0] for s in split if s} - self.first.keys())
        new_later = list({c for s in split if s for c in s[1:]} - self.later.keys())
        self.first.update(zip(new_first, self._whole(new_first)))
        self.later.update(self._spaced(new_later))
        later = self.later.__getitem__
        out = []
        for text, chunks in zip(texts, split):
            if chunks is None:
                ids = self._whole([text])[0]
            else:
                ids = self.first[chunks[0]] + b"".join(map(later, chunks[1:]))
            out.append(np.frombuffer(ids, "<u2"))
        return out


class _Blocks:
    """Fills blocks with whole documents; a document of more than BLOCK ids is cut into blocks of its own."""

    def __init__(self, part: int):
        self.part, self.next_no, self.next_block, self.place = part, 0, 0, 0
        self.ready: list[tuple[np.ndarray, list[dict]]] = []
        self._clear()

    def _clear(self):
        self.ids: list[np.ndarray] = []
        self.docs: list[dict] = []
        self.size = 0

    def _close(self):
        if self.docs:
            self.ready.append((np.concatenate(self.ids), self.docs))
            self._clear()

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint16(END))
        if self.size + len(ids) > BLOCK:
            self._close()
        for at in range(0, len(ids), BLOCK):
            piece = ids[at:at + BLOCK]
            self.ids.append(piece)
            self.docs.append({"no": self.next_no, "id": doc_id, "start": self.place, "at": at, "n": len(piece)})
            self.size += len(piece)
            if self.size >= BLOCK:
                self._close()
        self.next_no += 1
        self.place += len(ids)

    def take(self) -> pa.RecordBatch:
        coded = range_coder.encode([ids for ids, _ in self.ready])
        count = len(self.ready)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([self.part] * count, pa.int32()), pa.array(range(self.next_block, self.next_block + count), pa.int32()),
             pa.array([docs for _, docs in self.ready], _DOCS), pa.array(coded, pa.binary())],
            ["part", "block", "docs", "payload"],
        )
        self.next_block += count
        self.ready = []
        return batch


_DOCS = pa.list_(pa.struct([("no", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
_FILE = "part int, block int, docs array<struct<no:long,id:long,start:long,at:long,n:long>>, payload binary"


def _writing(tokenizer: str):
    def run(batches):
        encoder, blocks = Encoder(tokenizer), _Blocks(TaskContext.get().partitionId())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 200):
                for doc_id, found in zip(ids[at:at + 200], encoder.encode(texts.slice(at, 200).to_pylist())):
                    blocks.add(doc_id, found)
                if len(blocks.ready) >= LANES:
                    yield blocks.take()
        blocks._close()
        if blocks.ready:
            yield blocks.take()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, each ended by END, in ascending id order.

    Range partitions of the ids become files; each holds its number, its blocks and, for each block, which documents
    lie in it. A block is coded and checksummed by itself, so a reader may start at any. A null text
    is empty (END alone). A null id comes first. Rows with one id are ordered by their text's hash;
    repeated rows are written as often as they occur. An empty table writes no block.
    """
    rows = keyed(docs, id_col, text_col).repartitionByRange("id", "tid").sortWithinPartitions("id", "tid")
    # the blocks are as dense as they get
    rows.select("id", "text").mapInArrow(_writing(tokenizer), _FILE).write.option("compression", "none").parquet(path)


def _reading(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, LANES):
            part = batch.slice(at, LANES)
            blocks = range_coder.decode(part.column(3).to_pylist())
            rows = []
            for number, docs, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), blocks):
                data, seen = ids.astype("<u4").tobytes(), 0
                for doc in docs:
                    piece = data[4 * seen: 4 * (seen + doc["n"])]
                    seen += doc["n"]
                    rows.append((number, doc["no"], doc["id"], doc["start"], doc["at"], doc["n"], zlib.crc32(piece)))
                if seen != len(ids):
                    raise ValueError("a block does not hold the documents it names")
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "no", "id", "start", "at", "n", "crc"])


def _moved(matrix: list[int], crc: int) -> int:
    total, i = 0, 0
    while crc:
        if crc & 1:
            total ^= matrix[i]
        crc >>= 1
        i += 1
    return total


def crc32_joined(first: int, second: int, length: int, zeros: list[list[int]]) -> int:
    """crc32 of two byte strings in a row, from the crc32 of each and the length of the second.

    `zeros` keeps what 1, 2, 4 ... zero bytes do to a checksum: matrices over bits, each squared from
    the one before. It starts empty and grows as needed.
    """
    k = 0
    while length:
        if k == len(zeros):
            half, squares = (zeros[-1], 1) if zeros else ([0xEDB88320] + [1 << i for i in range(31)], 3)
            for _ in range(squares):
                half = [_moved(half, row) for row in half]
            zeros.append(half)
        if length & 1:
            first = _moved(zeros[k], first)
        length >>= 1
        k += 1
    return first ^ second


def _joined(batches):
    zeros: list[list[int]] = []
    for batch in batches:
        sums = []
        for pieces in batch.column(4).to_pylist():
            total = pieces[0]["crc"]
            for piece in pieces[1:]:
                total = crc32_joined(total, piece["crc"], 4 * piece["n"], zeros)
            sums.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(sums, pa.int64())], ["part", "id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 for each document of the files, from its decoded blocks.

    Blocks are read and checked in any order; the pieces of a long document meet by file and place.
    """
    pieces = spark.read.schema(_FILE).parquet(path).mapInArrow(_reading, "part long, no long, id long, start long, at long, n long, crc long")
    docs = pieces.groupBy("part", "no").agg(
        F.first("id").alias("id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")
    )
    whole = docs.select("part", "id", "start", "n_tokens", "pieces").mapInArrow(_joined, "part long, id long, start long, n_tokens long, ids_crc32 long")
    # one row for each file: ids before it
    ends = spark.read.schema(_FILE).parquet(path).select("part", F.element_at("docs", -1).alias("d")).groupBy("part").agg(F.max(F.col("d.start") + F.col("d.n") + F.col("d.at")).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select(F.col("part").cast("long").alias("part"), before.alias("before"))
    return whole.join(F.broadcast(offsets), "part").select("id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to new files in the shared folder, and read them back."""
    path = f"{checkpoint_root(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return read_tokens(docs.sparkSession, path).select(id_back().alias("doc_id"), "start", "n_tokens", "ids_crc32")
