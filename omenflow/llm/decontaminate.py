"""Benchmark decontamination: exact pieces by the pigeonhole rule, verified by bit-parallel edit distance."""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import written
from .common import id_back, keyed

#: The shortest leak that counts: so many words of a test item, or so many characters if these words are longer.
WORDS, PASSAGE = 13, 120
#: Within a longer word, passages start this many characters apart.
STEP = 20
#: Passages of a test item that are looked for together; a longer item is cut into overlapping stretches.
STRETCH = 64
#: Edits allowed in a passage, as a share of its characters.
ERRORS = 0.08
#: Stretches of test items that a pass over the documents looks for; a larger test set takes more passes.
BLOCK = 20_000
#: Characters of an item from which on it may reject a document.
REJECT = 13
#: Characters of the grams by which most false places are told before the distance is computed.
GRAM = 4


def _plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def spans(text: str, length: int = PASSAGE, words: int = WORDS) -> list[tuple[int, int]]:
    """Start and end of each passage: `words` words from each word on, cut to `length` characters.

    A text of up to `words` words and `length` characters is one passage. Only where a word is longer than STEP
    do passages start inside it.
    """
    starts, at = [], 0
    for word in text.split(" "):
        starts.append(at)
        at += len(word) + 1
    if not text or (len(starts) <= words and len(text) <= length):
        return [(0, len(text))] if text else []
    ends = [*(a - 1 for a in starts[words:]), *[len(text)] * words]
    out = []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(text) + 1])):
        out += [(x, min(ends[i], x + length)) for x in range(a, max(a + 1, b - 1), STEP)]
    # the last passages reach the end: of these, the longest holds the others
    last = next(i for i, (_, b) in enumerate(out) if b == len(text))
    return out[:last + 1]


def passages(text: str, length: int = PASSAGE) -> list[str]:
    """The overlapping passages of an item, of which each counts as a leak."""
    return [text[a:b] for a, b in spans(text, length)]


def stretches(text: str, length: int = PASSAGE) -> list[tuple[str, list[tuple[int, int]]]]:
    """Parts of the item with up to STRETCH passages each, and where these lie in them."""
    found = spans(text, length)
    out = []
    for i in range(0, len(found), STRETCH):
        part = found[i:i + STRETCH]
        start, end = part[0][0], max(b for _, b in part)
        out.append((text[start:end], [(a - start, b - start) for a, b in part]))
    return out


def pieces(passage: str, errors: int) -> list[tuple[int, str]]:
    """`errors` + 1 pieces with their offsets: that many edits leave at least one of them as it was."""
    n, k = len(passage), errors + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, passage[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Edit distance of a passage to the best place of a text, a column of the matrix in one word (Myers)."""

    def __init__(self, passage: str):
        self.n = len(passage)
        self.grams = [passage[i:i + GRAM] for i in range(len(passage) - GRAM + 1)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(passage):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def may_be_near(self, text: str, errors: int) -> bool:
        """False only if the distance is larger: an edit spoils at most GRAM of the passage's grams."""
        need = len(self.grams) - errors * GRAM
        if need <= 0:
            return True
        have = {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}
        return sum(map(have.__contains__, self.grams)) >= need

    def best(self, text: str) -> int:
        n, masks = self.n, self.masks
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score, least = full, 0, n, n
        for c in text:
            eq = masks.get(c, 0)
            across = eq | minus
            down = (((eq & plus) + plus) ^ plus) | eq
            up_h, down_h = minus | (full & ~(down | plus)), plus & down
            if up_h & top:
                score += 1
            elif down_h & top:
                score -= 1
            up_h, down_h = (up_h << 1) & full, (down_h << 1) & full
            plus, minus = down_h | (full & ~(across | up_h)), up_h & across
            if score < least:
                least = score
        return least


class Stretch:
    """A part of a test item: its passages, and the tiles of which each passage keeps one within its budget."""

    def __init__(self, text: str, where: list[tuple[int, int]], errors: float):
        self.where = where
        self.budget = [int((b - a) * errors) for a, b in where]
        self.patterns: dict[int, Pattern] = {}
        self.text = text
        self.length, self.most = max(b - a for a, b in where), max(self.budget)
        if len(where) == 1:
            self.tiles = pieces(text, self.budget[0])
        else:
            # a passage of n characters holds at least budget + 1 whole tiles, wherever it starts
            size = max(1, min((b - a + 1) // (k + 2) for (a, b), k in zip(where, self.budget)))
            self.tiles = [(at, text[at:at + size]) for at in range(0, len(text) - size + 1, size)]
        self.near: dict[int, list[tuple[str, int, int]]] = {}
        #: an edit spoils one of the disjoint chunks that lie in a passage
        self.need = min((b - a - GRAM + 1) // GRAM - k for (a, b), k in zip(where, self.budget))

    def may_be_near(self, offset: int, text: str, begin: int) -> bool:
        """False only if no passage around the tile at the offset stands around `begin` in the text.

        The tile being unchanged, an unchanged chunk stands at its own distance from it, give or take the edits.
        """
        if self.need <= 0:
            return True
        near = self.near.get(offset)
        if near is None:
            within = [c for c in range(0, len(self.text) - GRAM + 1, GRAM) if abs(c - offset) <= self.length]
            near = self.near[offset] = [(self.text[c:c + GRAM], c - offset - self.most, c - offset + GRAM + self.most) for c in within]
        find = text.find
        if begin < self.length + self.most:
            return sum([find(c, max(0, begin + lo), max(0, begin + hi)) >= 0 for c, lo, hi in near]) >= self.need
        return sum([find(c, begin + lo, begin + hi) >= 0 for c, lo, hi in near]) >= self.need

    def pattern(self, j: int) -> Pattern:
        if j not in self.patterns:
            a, b = self.where[j]
            self.patterns[j] = Pattern(self.text[a:b])
        return self.patterns[j]


def _by_itself(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond either end."""
    inside = lambda i, j: 0 <= i < j < len(text) and text[i].isalnum() and text[j].isalnum()
    return not inside(start - 1, start) and not inside(end - 1, end)


class Index:
    """Automaton over the tiles of a block of stretches."""

    def __init__(self, block: list[tuple[str, list[tuple[int, int]], list[int]]], errors: float):
        self.items = [items for _, _, items in block]
        self.stretches = [Stretch(text, where, errors) for text, where, _ in block]
        tiles: dict[str, list[tuple[int, int]]] = {}
        for i, stretch in enumerate(self.stretches):
            for offset, tile in stretch.tiles:
                tiles.setdefault(tile, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for tile, at in tiles.items():
            self.automaton.add_word(tile, (len(tile), at))
        self.automaton.make_automaton()

    def search(self, text: str) -> dict[int, int]:
        """Least distance of a passage of each stretch that stands in the text within its budget."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()
        for end, (size, at) in self.automaton.iter(text):
            for i, offset in at:
                if found.get(i) == 0:
                    continue
                s, begin = self.stretches[i], end - size + 1
                if not s.may_be_near(offset, text, begin):
                    continue
                for j, (a, b) in enumerate(s.where):
                    start = begin - offset + a
                    if a > offset or b < offset + size or (i, j, start) in tried:
                        continue
                    tried.add((i, j, start))
                    k, pattern = s.budget[j], s.pattern(j)
                    if not k and not _by_itself(text, start, start + b - a):
                        continue
                    place = text[max(0, start - k): max(0, start + b - a + k)]
                    if not pattern.may_be_near(place, k):
                        continue
                    distance = pattern.best(place)
                    if distance <= k and distance < found.get(i, k + 1):
                        found[i] = distance
        return found


def _searching(block: list[tuple[str, list[tuple[int, int]], list[int]]], errors: float):
    def run(batches):
        index = Index(block, errors)
        for batch in batches:
            ids, tids, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for doc, tid, text in zip(ids, tids, texts):
                best: dict[int, int] = {}
                for i, distance in index.search(_plain(text)).items():
                    for item in index.items[i]:
                        best[item] = min(distance, best.get(item, distance))
                out.append((doc, tid, sorted(best), min(best.values(), default=None)))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.int32())],
                ["id", "tid", "items", "distance"],
            )
    return run


def test_stretches(benchmark: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """stretch, at, items: each distinct stretch, the ends of its passages (start, end, start, ...) and the items that hold it."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")

    def run(batches):
        for batch in batches:
            found = [(i, s, [x for ab in where for x in ab]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for s, where in stretches(_plain(t), length)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int32()))],
                ["item", "stretch", "at"],
            )

    return rows.mapInArrow(run, "item long, stretch string, at array<int>").groupBy("stretch", "at").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(found: DataFrame, size: int):
    """The stretches in blocks of `size`, read one block at a time."""
    block = []
    for row in found.orderBy("stretch", "at").toLocalIterator():
        block.append((row["stretch"], list(zip(row["at"][::2], row["at"][1::2])), list(row["items"])))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", length: int = PASSAGE, errors: float = ERRORS,
) -> DataFrame:
    """id, tid, items, distance for each row of `docs`: the test items of which a passage stands in it.

    Both sides are compared in lower case with single spaces. A passage is thirteen words of an item, from
    each of its words on, or 120 characters if they are longer; an item of fewer words is one passage. An
    edit budget of 8 % of its characters leaves a tile of it unchanged; an automaton finds the tiles,
    and the places they point to are verified. The test set goes through in blocks against all
    documents, so what a task holds does not grow with it.

    Null and empty texts hold nothing; null item ids are left out; items of equal text are all named.
    Very short items (under 13 characters at these settings) must stand exactly and as words of their own. distance is the
    least over the passages, null if there are none. Repeated rows each give their row.
    """
    rows = keyed(docs, id_col, text_col)
    schema = "id long, tid long, items array<long>, distance int"
    found, part = None, None
    for block in _blocks(test_stretches(benchmark, item_id, item_text, length), BLOCK):
        if part is not None:  # the hits of a block are written before the next one is read
            hits = written(part.where(F.size("items") > 0))
            found = hits if found is None else found.union(hits)
        part = rows.mapInArrow(_searching(block, errors), schema)
    if part is None:
        return rows.select("id", "tid", F.array().cast("array<long>").alias("items"), F.lit(None).cast("int").alias("distance"))
    if found is None:
        return part
    # repeated rows have the same hits
    grouped = found.union(written(part.where(F.size("items") > 0))).groupBy("id", "tid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.min("distance").alias("distance"))
    every = rows.select("id", "tid").join(grouped, ["id", "tid"], "left")
    return every.select("id", "tid", F.coalesce("items", F.array().cast("array<long>")).alias("items"), "distance")


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, items, distance of the documents in which a passage of a test item stands."""
    found = find_leaks(docs, benchmark).where(F.size("items") > 0)
    return found.select(id_back().alias("doc_id"), F.size("items").cast("long").alias("n_items"), "items", F.col("distance").cast("long").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no passage of a test item stands, with all columns.

    Items of fewer than REJECT characters reject nothing: a few words stand in clean texts as well. Null and empty texts stay, null
    ids stay, repeated rows share their fate; an empty table gives none.
    """
    told = benchmark.where(F.length(F.col("text").cast("string")) >= REJECT)
    found = find_leaks(docs, told, id_col, text_col).where(F.size("items") > 0).select("id", "tid").distinct()
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), mark.alias("tid"))
    return rows.join(found, ["id", "tid"], "left_anti").select("row.*")
