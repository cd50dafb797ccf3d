"""Alignment of two tokenizers over a corpus, with a minimal perfect hash of the id pairs that occur.

First pass: every text is cut into chunks that begin with one space, each distinct chunk is encoded by both tokenizers and aligned
by byte offsets, and a task keeps one count for each id pair. The distinct pairs get a minimal perfect hash, one segment for each
residue of the B id; tasks' counts become dense vectors indexed by it and are summed up in a tree. Second pass: texts are
aligned again and look their pairs up; the stored pair at the place verifies each answer.
"""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import written
from .common import id_back, keyed

#: Segments of the hash, by B id; rows of a segment that one step of a tree joins; pairs that are broadcast at once, about.
SEGMENTS, FAN, SLICE = 256, 64, 4_000_000
#: Chunks and characters that a task remembers, and characters of texts that are encoded together.
CHUNKS, CHARS, TOGETHER = 600_000, 32_000_000, 2_000_000
#: Chunks that a tokenizer is given as one text.
JOINED = 500
#: Slots for each pair that a level of the hash has to place.
ROOM = 2.0
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Neither tokenizer joins what stands on both sides of a space that follows anything but white space.
_CUT, _DENSE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
_ROW = "seg int, branch long, codes binary, counts binary"
_HASH = "seg int, n long, bits binary, starts array<long>, codes binary"


def byte_level() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenPair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        stand_in, vocabulary = byte_level(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(stand_in[c] for c in token) if all(c in stand_in for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        self.names = [[str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b)]

    def _spelt(self, sides: list[np.ndarray]) -> list[bytes]:
        return [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in zip((self.bytes_a, self.bytes_b), sides)]

    def _ids(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of each text, which begins with a space, by A and by B: B adds that space itself, but not to an empty text."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [a, [ids if len(t) > 1 else [self.b.piece_to_id("▁")] for t, ids in zip(texts, b)]]

    def encode(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of all chunks in a row, each with a space before it, and ids of each chunk, by A and by B; and which chunks
        both spell out: the others have no ids.

        Chunks are encoded many at a time, as nothing is joined over the space that follows a chunk; byte lengths tell them apart.
        """
        # what ends in white space might join with the next space
        order = sorted(range(len(chunks)), key=lambda k: not (chunks[k] and not chunks[k][-1].isspace()))
        alone = sum(1 for c in chunks if not c or c[-1].isspace())
        texts = [" " + chunks[k] for k in order]
        dense = len(texts) - alone
        size = np.array([len(t.encode()) for t in texts], np.int64)
        joined = ["".join(texts[k:min(k + JOINED, dense)]) for k in range(0, dense, JOINED)] + texts[dense:]
        sides = [np.fromiter((i for x in side for i in x), np.int64) for side in self._ids(joined)]
        good = np.ones(len(chunks), bool)
        wanted, ends = "".join(texts).encode(), np.cumsum(size)
        counts = self._counts(sides, ends) if self._spelt(sides) == [wanted, wanted] else None
        if counts is None:  # some chunk is not spelled out: one by one
            each = self._ids(texts)
            for k, t in enumerate(texts):
                if self._spelt([np.array(side[k], np.int64) for side in each]) != [t.encode()] * 2:
                    good[k], each[0][k], each[1][k] = False, [], []
            sides = [np.fromiter((i for x in side for i in x), np.int64) for side in each]
            counts = [np.array([len(x) for x in side], np.int64) for side in each]
        # back to the order of the chunks
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        moved = [_regrouped(ids, n, back) for ids, n in zip(sides, counts)]
        return moved, [n[back] for n in counts], good[back]

    def _counts(self, sides: list[np.ndarray], ends: np.ndarray) -> list[np.ndarray] | None:
        """Tokens of each chunk, if every chunk ends with a token of either side."""
        out = []
        for ids, sizes in zip(sides, self.sizes):
            stops = np.cumsum(sizes[ids])
            at = np.searchsorted(stops, ends)
            if len(ends) and not (stops[at] == ends).all():
                return None
            out.append(np.diff(at + 1, prepend=0))
        return out


def _regrouped(ids: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Groups of ids in another order."""
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    return ids[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)]


def align(ids: list[np.ndarray], count: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over chunks that A and B spell alike: links as codes a * 65536 + b, links and groups of each chunk, and where groups end.

    A link is a pair of tokens whose bytes overlap; a group ends where a token of A and one of B end together. Places
    where groups end are numbers of tokens so far, for A and for B.
    """
    ends = [np.cumsum(size[i]) for size, i in zip(sizes, ids)]
    starts = [e - size[i] for e, size, i in zip(ends, sizes, ids)]
    first = np.searchsorted(ends[1], starts[0], side="right")
    last = np.searchsorted(starts[1], ends[0], side="left")
    width = last - first
    left = np.repeat(np.arange(len(width)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    codes = (ids[0][left] << 16 | ids[1][right]).astype(np.uint32)
    chunk_of = np.repeat(np.arange(len(count[0])), count[0])
    links = np.bincount(chunk_of[left], minlength=len(count[0]))
    _, at_a, at_b = np.intersect1d(ends[0], ends[1], assume_unique=True, return_indices=True)
    groups = np.bincount(chunk_of[at_a], minlength=len(count[0]))
    return codes, links, groups, at_a + 1, at_b + 1


def _chunks(text: str) -> list[str]:
    """The chunks of a space and the text, each without the space it begins with."""
    if _DENSE.search(" " + text):
        return [c[1:] for c in _CUT.split(" " + text)]
    return text.split(" ")


class _Texts:
    """Groups of texts as numbers of remembered chunks; `learn` is told of chunks that are new."""

    def __init__(self, pair: TokenPair, learn, forget):
        self.pair, self.learn, self.forget = pair, learn, forget
        self.known: dict[str, int] = {}
        self.chars = 0

    def take(self, batch, text_column: int):
        """Yields, for consecutive rows, their place in the batch, chunk numbers of all texts in a row, and chunks of each text."""
        texts = batch.column(text_column)
        rows, chunks, size = [], [], 0
        for k in range(len(texts)):
            text = texts[k].as_py()
            rows.append(k)
            chunks.append(_chunks(text) if text else [])
            size += len(text)
            if size >= TOGETHER or k == len(texts) - 1:
                flat = [c for x in chunks for c in x]
                if len(self.known) >= CHUNKS or self.chars >= CHARS:
                    self.forget()
                    self.known.clear()
                    self.chars = 0
                new = list(set(flat) - self.known.keys())
                if new:
                    self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
                    self.chars += sum(map(len, new))
                    self.learn(new)
                yield rows, np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), np.array([len(x) for x in chunks], np.int64)
                rows, chunks, size = [], [], 0


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(back, counts, len(distinct)).astype(np.int64)


class _PairCounts:
    """How many links of a task hold each pair."""

    def __init__(self, pair: TokenPair):
        self.pair, self.codes, self.counts = pair, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.texts = _Texts(pair, self._learn, self._forget)
        self._clear()

    def _clear(self):
        self.parts, self.sizes, self.good = [], [], []
        self.times = np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        ids, counts, good = self.pair.encode(chunks)
        codes, links, *_ = align(ids, counts, self.pair.sizes)
        self.parts.append(codes)
        self.sizes.append(links)
        self.good.append(good)

    def _forget(self) -> None:
        """Chunk counts become pair counts."""
        if self.parts:
            size = np.concatenate(self.sizes)
            times = np.zeros(len(size), np.int64)
            times[:len(self.times)] = self.times
            codes, counts = np.concatenate(self.parts), np.repeat(times, size)
            self.codes, self.counts = _summed(np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts]))
        self._clear()

    def add(self, batch) -> None:
        for _, ids, sizes in self.texts.take(batch, 0):
            good = np.concatenate(self.good) if self.good else np.ones(0, bool)
            self.good = [good]
            filled = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[filled]
            if len(starts):
                whole = np.logical_and.reduceat(good[ids], starts)  # a text counts if all its chunks are spelled out
                ids = ids[np.repeat(whole, sizes[filled])]
            found = np.bincount(ids, minlength=len(good))
            found[:len(self.times)] += self.times
            self.times = found


def _counting(path_a: str, path_b: str):
    def run(batches):
        counts = _PairCounts(TokenPair(path_a, path_b))
        for batch in batches:
            counts.add(batch)
        counts._forget()
        # a task may hold pairs that none of its texts counts, as another of their chunks is not spelled out
        held = counts.counts > 0
        codes, times = counts.codes[held], counts.counts[held]
        seg = (codes & np.uint32(0xFFFF)) % SEGMENTS
        order = np.argsort(seg, kind="stable")
        cuts = np.searchsorted(seg[order], np.arange(SEGMENTS + 1))
        part = TaskContext.get().partitionId()
        rows = [(s, part, codes[order[cuts[s]:cuts[s + 1]]].tobytes(), times[order[cuts[s]:cuts[s + 1]]].tobytes()) for s in np.flatnonzero(np.diff(cuts))]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["seg", "branch", "codes", "counts"])
    return run


class PairHash:
    """A minimal perfect hash: a pair has the rank of the bit it is alone at, on the first level where it is alone (Limasset et al., 2017)."""

    def __init__(self, words: np.ndarray, starts: list[int]):
        self.words, self.starts = words, starts  # word where each level begins, and the end
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def slots(codes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (codes.astype(np.uint64) + np.uint64(level + 1) * _ODD[1]) * _ODD[0]
        x = (x ^ (x >> np.uint64(31))) * _ODD[1]
        return (x ^ (x >> np.uint64(29))) % np.uint64(size)

    @classmethod
    def build(cls, codes: np.ndarray) -> "PairHash":
        """From distinct codes. Those that share a slot go on to the next level."""
        words, starts, left = [], [0], codes
        while len(left):
            size = 64 * max(1, -(-int(ROOM * len(left)) // 64))
            slot = cls.slots(left, len(words), size)
            held = np.bincount(slot.astype(np.int64), minlength=size)
            words.append(np.packbits(held == 1, bitorder="little").view("<u8"))
            starts.append(starts[-1] + size // 64)
            left = left[held[slot.astype(np.int64)] > 1]
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), starts)

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Places from 0 on; -1 for codes that no level holds. Other codes than those it was built from may get any place."""
        out, open_ = np.full(len(codes), -1, np.int64), np.arange(len(codes))
        for level in range(len(self.starts) - 1):
            size = 64 * (self.starts[level + 1] - self.starts[level])
            slot = self.slots(codes[open_], level, size)
            word = self.starts[level] + (slot >> np.uint64(6)).astype(np.int64)
            bit = slot & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) > 0
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names=names)


def _distinct(table: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(c, np.uint32) for c in table["codes"].to_pylist()]))


def _joined_sets(key: tuple, table: pa.Table) -> pa.Table:
    return _table([(key[0].as_py(), key[1].as_py(), _distinct(table).tobytes())], ["seg", "branch", "codes"], [pa.int32(), pa.int64(), pa.binary()])


def _hashed(key: tuple, table: pa.Table) -> pa.Table:
    """The hash of a segment's pairs, and the pairs in its order."""
    codes = _distinct(table)
    made = PairHash.build(codes)
    placed = np.empty_like(codes)
    placed[made.index(codes)] = codes
    row = (key[0].as_py(), len(codes), made.words.tobytes(), made.starts, placed.tobytes())
    return _table([row], ["seg", "n", "bits", "starts", "codes"], [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()])


def _vector(key: tuple, rows: pa.Table, hashes: pa.Table) -> pa.Table:
    """Counts of some tasks as one dense vector, indexed by the hash of the segment."""
    names, kinds = ["seg", "branch", "counts"], [pa.int32(), pa.int64(), pa.binary()]
    if not rows.num_rows:
        return _table([], names, kinds)
    made = PairHash(np.frombuffer(hashes["bits"][0].as_py(), "<u8"), hashes["starts"][0].as_py())
    held = np.frombuffer(hashes["codes"][0].as_py(), np.uint32)
    sums = np.zeros(len(held), np.int64)
    for codes, counts in zip(rows["codes"].to_pylist(), rows["counts"].to_pylist()):
        codes = np.frombuffer(codes, np.uint32)
        at = made.index(codes)
        if not (held[at] == codes).all():
            raise ValueError("the hash does not hold a pair that was counted")
        sums[at] += np.frombuffer(counts, np.int64)
    return _table([(key[0].as_py(), key[1].as_py(), sums.tobytes())], names, kinds)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
    return _table([(key[0].as_py(), key[1].as_py(), sums.tobytes())], ["seg", "branch", "counts"], [pa.int32(), pa.int64(), pa.binary()])


def _tree(rows: DataFrame, branches: int, step, schema: str, fan: int) -> DataFrame:
    """Join the rows of each segment, `fan` branches at a time, until one branch is left."""
    while branches > 1:
        rows = rows.withColumn("branch", F.floor(F.col("branch") / fan)).groupBy("seg", "branch").applyInArrow(step, schema)
        branches = -(-branches // fan)
    return rows


def pair_table(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", fan: int = FAN) -> DataFrame:
    """seg, n, bits, starts, codes, counts for each segment: the hash of its pairs, the pairs in its order, and their links.

    Texts that are null, empty or not spelled out by both tokenizers have no links; without any there are no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(text.alias("text")).mapInArrow(_counting(path_a, path_b), _ROW))
    branches = rows.agg(F.coalesce(F.max("branch"), F.lit(-1))).first()[0] // fan + 1
    sets = rows.select("seg", F.floor(F.col("branch") / fan).alias("branch"), "codes")
    sets = sets.groupBy("seg", "branch").applyInArrow(_joined_sets, "seg int, branch long, codes binary")
    sets = _tree(sets, branches, _joined_sets, "seg int, branch long, codes binary", fan)
    hashes = written(sets.groupBy("seg").applyInArrow(_hashed, _HASH))
    near = hashes.select("seg", F.explode(F.expr(f"sequence(0L, {max(branches, 1) - 1}L)")).alias("branch"), "bits", "starts", "codes")
    dealt = rows.withColumn("branch", F.floor(F.col("branch") / fan))
    vectors = dealt.groupBy("seg", "branch").cogroup(near.groupBy("seg", "branch")).applyInArrow(_vector, "seg int, branch long, counts binary")
    sums = _tree(vectors, branches, _added, "seg int, branch long, counts binary", fan)
    return written(hashes.join(sums.select("seg", "counts"), "seg"))


class PairCounts:
    """Some segments of a pair table, for lookups inside a task."""

    def __init__(self, rows: list[dict]):
        self.segments = {}
        for r in rows:
            codes, counts = np.frombuffer(r["codes"], np.uint32), np.frombuffer(r["counts"], np.int64)
            b = (codes & np.uint32(0xFFFF)).astype(np.int64)
            top = np.zeros(1 << 16, np.int64)
            np.maximum.at(top, b, counts)
            self.segments[r["seg"]] = (PairHash(np.frombuffer(r["bits"], "<u8"), list(r["starts"])), codes, counts, counts == top[b])

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of each pair in the corpus, and whether no pair of its B id has more; 0 and no for pairs of other segments."""
        distinct, back = np.unique(codes, return_inverse=True)
        seg = (distinct & np.uint32(0xFFFF)) % SEGMENTS
        order = np.argsort(seg, kind="stable")
        cuts = np.searchsorted(seg[order], np.arange(SEGMENTS + 1))
        counts, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        for s in np.flatnonzero(np.diff(cuts)):
            if s in self.segments:
                made, held, times, top = self.segments[s]
                mine = order[cuts[s]:cuts[s + 1]]
                at = made.index(distinct[mine])
                sure = (at >= 0) & (held[at] == distinct[mine])
                counts[mine[sure]], best[mine[sure]] = times[at[sure]], top[at[sure]]
        return counts[back], best[back]


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class _Lookups:
    """Sums over the chunks of each text."""

    def __init__(self, pair: TokenPair, table: PairCounts, spell: bool):
        self.pair, self.table, self.spell = pair, table, spell
        self.texts = _Texts(pair, self._learn, self._clear)
        self._clear()

    def _clear(self):
        self.sums, self.good, self.names = np.zeros((0, len(_SUMS)), np.int64), np.zeros(0, bool), []

    def _learn(self, chunks: list[str]) -> None:
        ids, sizes, good = self.pair.encode(chunks)
        codes, links, groups, cuts_a, cuts_b = align(ids, sizes, self.pair.sizes)
        counts, best = self.table.find(codes)
        owner = np.repeat(np.arange(len(chunks)), links)
        total = np.zeros(len(chunks), np.int64)
        np.add.at(total, owner, counts)
        sums = np.stack([*sizes, groups, links, np.bincount(owner, best, len(chunks)).astype(np.int64), total], axis=1)
        self.sums, self.good = np.concatenate([self.sums, sums]), np.concatenate([self.good, good])
        if self.spell:
            self.names += _spelled(ids, groups, cuts_a, cuts_b, self.pair.names)

    def rows(self, batch):
        for rows, ids, sizes in self.texts.take(batch, 2):
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]
            sums = np.zeros((len(rows), len(_SUMS)), np.int64)
            marks = [""] * len(rows)
            if len(starts):
                whole = np.logical_and.reduceat(self.good[ids], starts)
                sums[filled] = np.add.reduceat(self.sums[ids], starts, axis=0) * whole[:, None]
                if self.spell:
                    listed, names = ids.tolist(), self.names
                    for k, at, ok in zip(filled.tolist(), starts.tolist(), whole.tolist()):
                        if ok:
                            marks[k] = hashlib.sha256(b";".join(map(names.__getitem__, listed[at:at + int(sizes[k])]))).hexdigest()
            yield rows, sums, marks


def _spelled(ids, groups, cuts_a, cuts_b, names) -> list[bytes]:
    """The groups of each chunk as text."""
    text_a, text_b = (list(map(n.__getitem__, i.tolist())) for n, i in zip(names, ids))
    parts, i, j = [], 0, 0
    for a, b in zip(cuts_a.tolist(), cuts_b.tolist()):
        parts.append(f"{text_a[i] if a - i == 1 else ','.join(text_a[i:a])}|{text_b[j] if b - j == 1 else ','.join(text_b[j:b])}")
        i, j = a, b
    ends = np.cumsum(groups).tolist()
    return [";".join(parts[end - n:end]).encode() for end, n in zip(ends, groups.tolist())]


def _looking(path_a: str, path_b: str, table, spell: bool):
    def run(batches):
        lookups = _Lookups(TokenPair(path_a, path_b), PairCounts(table.value), spell)
        for batch in batches:
            for rows, sums, marks in lookups.rows(batch):
                part = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([spell] * len(rows)), *(pa.array(sums[:, k]) for k in range(len(_SUMS))), pa.array(marks, pa.string())],
                    ["id", "tid", "first", *_SUMS, "groups_sha256"],
                )
    return run


def align_corpus(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row.

    A encodes a space and the text, B the text, to which it adds the space itself. Texts that are null or empty, or that either
    tokenizer does not spell out byte by byte, have no tokens: zeros and an empty checksum. A null id stays; repeated
    rows are counted and returned as often as they occur; an empty table gives no rows.

    The pair table is broadcast in slices of about `slice_` pairs. There are no more pairs than the vocabularies allow, so the
    number of slices does not grow with the corpus; documents are aligned once more for each, and sums over slices are added.
    """
    table = pair_table(docs, path_a, path_b, text_col)
    spark = docs.sparkSession
    slices, size = [[]], 0
    for seg, n in sorted((r["seg"], r["n"]) for r in table.select("seg", "n").collect()):  # SEGMENTS rows at most
        if size and size + n > slice_:
            slices.append([])
            size = 0
        slices[-1].append(seg)
        size += n
    found = None
    for k, segs in enumerate(slices):
        rows = [r.asDict() for r in table.where(F.col("seg").isin(segs)).collect()] if segs else []
        shared = spark.sparkContext.broadcast([{n: bytes(v) if isinstance(v, bytearray) else v for n, v in r.items()} for r in rows])
        part = keyed(docs, id_col, text_col).mapInArrow(_looking(path_a, path_b, shared, k == 0), "id long, tid long, first boolean, " + ", ".join(f"{n} long" for n in _SUMS) + ", groups_sha256 string")
        found = part if found is None else found.union(part)
    # rows with one id and one text are alike: each slice has as many of them
    own = lambda n: F.max(F.col(n)).alias(n)
    over = lambda n: F.sum(n).alias(n)
    sums = found.groupBy("id", "tid").agg(F.count_if("first").alias("times"), *[own(n) for n in _SUMS[:4]], *[over(n) for n in _SUMS[4:]], own("groups_sha256"))
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(
        id_back().alias("doc_id"), *_SUMS[:4], *[F.expr(f"{n} div times").alias(n) for n in _SUMS[4:]], "groups_sha256",
    )
