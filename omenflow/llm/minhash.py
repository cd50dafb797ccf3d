"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions alone."""

import random

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..operators.durable import written
from ..operators.ranks import global_rank
from .common import id_back, keyed, words

#: Bins of the one permutation, and the low-order bits kept of each.
BINS, KEPT_BITS, SHINGLE = 256, 4, 5
#: Probes tried at once for an empty bin before all bins are.
_FIRST = 16
#: Consecutive documents that are dealt out together, at least, and groups of them at most.
GROUP, GROUPS = 256, 50_000


def _with_print(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the low-order bits of each bin's least hash, as an array of BINS small integers.

    A hash's top bits choose its bin. One sentinel for each bin, larger than any hash in it, is added before the
    sort: the first value of each bin is then its least hash, or the sentinel if it is empty. An
    empty bin takes the value of the first filled one on its own walk through all bins (an affine
    permutation drawn for the bin), so two sketches fill a bin alike as far as they agree.
    """
    shift = 64 - (BINS - 1).bit_length()
    low = (1 << shift) - 1
    rng = random.Random(42)
    # positions follow signed order
    sentinels = F.array(*[F.lit((((p - BINS // 2) << shift) | low)) for p in range(BINS)])
    steps = F.array(*[F.lit(2 * rng.randrange(BINS // 2) + 1) for _ in range(BINS)])
    starts = F.array(*[F.lit(rng.randrange(BINS)) for _ in range(BINS)])
    rows = rows.withColumn("_words", F.transform(words(F.lower(F.col(text))), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_sorted", F.sort_array(F.concat(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - SHINGLE, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(SHINGLE)])),
        sentinels,
    )))
    bin_of = lambda h: F.shiftright(h, shift)
    rows = rows.withColumn("_bins", F.filter("_sorted", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("_sorted", i - 1)))))
    filled = lambda h: h.bitwiseAND(F.lit(low)) != low

    def walk(p: Column, tries: int) -> Column:
        at = lambda t: (F.get(starts, p) + F.get(steps, p) * t) % BINS
        found = F.filter(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: filled(F.get("_bins", at(t))))
        return F.get("_bins", at(F.get(found, F.lit(0))))

    dense = F.transform("_bins", lambda h, p: F.when(filled(h), h).otherwise(F.coalesce(walk(p, _FIRST), walk(p, BINS), F.lit(0).cast("long"))))
    # the bin's number goes into the hash: bins that hold one value agree by chance independently
    kept = F.transform(dense, lambda h, p: F.xxhash64(h, p).bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("byte"))
    rows = rows.withColumn(name, kept)
    return rows.drop("_words", "_sorted", "_bins")


def packed(bits: Column) -> Column:
    """The kept bits as lowercase hex digits, one for each bin."""
    return F.array_join(F.transform(bits, lambda b: F.substring(F.lit("0123456789abcdef"), b + 1, F.lit(1))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness: the share of equal bins, less what chance makes equal, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    chance = 1.0 / (1 << KEPT_BITS)
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tid, text, bits for each row."""
    return _with_print(keyed(docs, id_col, text_col), "text", "bits")


def _cuts(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The first (id, tid) of each group of consecutive documents: GROUPS at most, whatever the input."""
    keys = keyed(docs, id_col, text_col).select("id", "tid")
    placed = global_rank(keys, [F.col("id"), F.col("tid")], "place", 0)
    placed = written(placed)
    step = max(GROUP, -(-placed.count() // GROUPS))
    return placed.where(F.col("place") % step == 0).select("id", "tid").distinct().orderBy("id", "tid").collect()


def _group_of(cuts: list) -> Column:
    """Number of the group in which (id, tid) lies: a binary search in one literal."""
    ids = F.split(F.lit(",".join(str(c["id"]) for c in cuts)), ",").cast("array<bigint>")
    tids = F.split(F.lit(",".join(str(c["tid"]) for c in cuts)), ",").cast("array<bigint>")

    def narrowed(span: Column, _: Column) -> Column:
        middle = ((span["low"] + span["high"]) / 2).cast("int")
        reached = (F.col("id") > F.get(ids, middle)) | ((F.col("id") == F.get(ids, middle)) & (F.col("tid") >= F.get(tids, middle)))
        return F.when(reached, F.struct(middle.alias("low"), span["high"].alias("high"))).otherwise(F.struct(span["low"].alias("low"), middle.alias("high")))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), whole, narrowed)["low"]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, bits, edited_bits, near_edited, near_next for each row.

    The edited text has its last half (rounded down) replaced by as much of the beginning of the
    next document, by ascending id; the last document's next is the first. Documents are dealt out once,
    by groups of consecutive ids; the first of each group also goes to the group before, so that
    every document meets its next one there.

    A null text is empty; an empty text's fingerprint is that of the empty shingle. A null id comes
    first. Rows with one id are ordered by their text's hash, and repeated rows follow each other. A
    single document is its own next. An empty table gives none.
    """
    cuts = _cuts(docs, id_col, text_col) or [{"id": 0, "tid": 0}]
    rows = document_fingerprints(docs, id_col, text_col).withColumn("group", _group_of(cuts))
    ids = F.split(F.lit(",".join(str(c["id"]) for c in cuts)), ",").cast("array<bigint>")
    tids = F.split(F.lit(",".join(str(c["tid"]) for c in cuts)), ",").cast("array<bigint>")
    leads = (F.get(ids, "group") == F.col("id")) & (F.get(tids, "group") == F.col("tid"))
    here = F.struct(F.col("group").alias("group"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("group") - 1, F.lit(len(cuts))).alias("group"), F.lit(True).alias("guest"))
    rows = rows.select("id", "tid", "text", "bits", F.explode(F.when(leads, F.array(here, before)).otherwise(F.array(here))).alias("at"))
    rows = rows.select("id", "tid", "text", "bits", "at.group", "at.guest")
    order = W.partitionBy("group").orderBy("guest", "id", "tid")
    rows = rows.select("id", "text", "bits", "guest", F.lead("text").over(order).alias("next_text"), F.lead("bits").over(order).alias("next_bits")).where("not guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("id", n.alias("n_chars"), "bits", "next_bits",
                       F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = _with_print(rows, "edited", "edited_bits")
    return rows.select(
        id_back().alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited", "bits", "edited_bits",
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    found = compare_with_next(docs)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
