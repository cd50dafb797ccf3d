"""Story fingerprints, story dedupe, and question dedupe within and across stories."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import aliased, let, squash, story_token_set, story_tokens
from .durable import written
from .keepfirst import first_of_neighbours, keep_first, neighbours, settle_by_leaders
from .ranks import global_rank
from .tokenjoin import SKETCH, Keys, distinct_sets, number_tokens, overlap, overlap_bound, publish

FINGERPRINT = 14
FEW = 64  # questions of an event that are scanned in one row


def token_fingerprint(rows: DataFrame, key: str, text: Column, size: int = FINGERPRINT) -> DataFrame:
    """key, tokens: the most frequent content tokens, ties by first appearance. Counted inside the row: nothing is shuffled."""
    placed = F.array_sort(F.transform(story_tokens(text), lambda w, i: F.struct(w.alias("token"), i.alias("at"))))
    rows = rows.select(key, placed.alias("placed"))
    # through the explode: a filter on the tokens themselves would be moved down and make them twice
    rows = rows.select(key, F.explode_outer(F.when(F.size("placed") > 0, F.array("placed"))).alias("placed")).where(F.col("placed").isNotNull())
    new = lambda j: (j == 0) | (F.get("placed", j)["token"] != F.get("placed", j - 1)["token"])
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("placed") - 1), new))
    entry = lambda s, k: F.struct(
        (s - F.coalesce(F.get("starts", k + 1), F.size("placed"))).alias("c"), F.get("placed", s)["at"].alias("at"), F.get("placed", s)["token"].alias("token")
    )
    rows = rows.withColumn("best", F.slice(F.array_sort(F.transform("starts", entry)), 1, size))
    return rows.select(key, F.array_sort(F.transform("best", lambda s: s["token"])).alias("tokens"))


def story_text() -> Column:
    return F.concat_ws(" ", "event_summary", "market_angle", "outcome_variable", "event_type", F.array_join("entities", " "))


def same_story(smaller: str = "l", larger: str = "r") -> Column:
    """Two fingerprints tell the same story: close sets, or looser ones with shared entities or type."""
    both, small = F.col("l_n") + F.col("r_n"), F.col(f"{smaller}_n")
    kind = F.col("l_kind") == F.col("r_kind")
    ents = F.size(F.array_intersect("l_ents", "r_ents"))

    def rule(i):
        j = lambda pct: i * (100 + pct) >= pct * both
        c = lambda pct: i * 100 >= pct * small
        return j(42) | (kind & (ents >= 2) & (j(24) | c(42))) | (c(60) & (ents >= 1)) | (kind & c(75))

    return (small <= F.col(f"{larger}_n")) & let(overlap(), rule)


def dedupe_stories(events: DataFrame, order: list[Column]) -> DataFrame:
    """First event of each story in the given order; a dropped event drops no other."""
    ranked = global_rank(events, order, "pos")
    marks = written(token_fingerprint(ranked, "pos", story_text()))
    rows = ranked.select(
        "pos", squash("event_type").alias("kind"), story_token_set(F.array_join("entities", " ")).alias("ents")
    ).join(marks, "pos")
    # equal fingerprints of one kind and entity set behave alike: only the first can be kept
    groups, _ = distinct_sets(rows, ["tokens", "kind", "ents"])
    sets = written(number_tokens(written(groups)))
    first, rest = settle_by_leaders(sets, same_story)
    kept = sets.where(F.col("pos").isin(first)).select("pos")
    if not rest.isEmpty():
        kept = kept.unionByName(keep_first(rest, publish(rest, 0.24, contained=True), same_story()).select("pos"))
    blank = ranked.select("pos").join(marks, "pos", "left_anti")
    return ranked.join(kept.unionByName(blank), "pos", "left_semi").drop("pos")


def near_duplicate(smaller: str = "l", larger: str = "r") -> Column:
    """Jaccard >= 0.66 or containment >= 0.80 of content tokens."""
    both, small = F.col("l_n") + F.col("r_n"), F.col(f"{smaller}_n")
    close = lambda i: (i * 166 >= 66 * both) | (i * 100 >= 80 * small)
    return (small <= F.col(f"{larger}_n")) & close(overlap_bound()) & let(overlap(), close)


def _sets_with_blanks(groups: DataFrame) -> DataFrame:
    """Numbered sets; groups without tokens stay, with an empty set."""
    numbered = number_tokens(groups.where(F.size("tokens") > 0))
    blank = groups.where(F.size("tokens") == 0).drop("tokens").select(
        "*", F.array().cast("array<bigint>").alias("toks"), F.lit(0).alias("n"), *[F.lit(0).cast("bigint").alias(w) for w in SKETCH]
    )
    return written(numbered.unionByName(blank))


def _with_text_keys(keys: Keys, sets: DataFrame, *by: str) -> Keys:
    """Rows with the same text meet as well, whatever their tokens."""
    extra = sets.where("norm <> ''").select("*", F.xxhash64(F.lit("text"), "norm", *by).alias("key"))
    return Keys(keys.left.unionByName(extra.select(*keys.left.columns)), keys.right.unionByName(extra.select(*keys.right.columns)))


def _kept_in_scan(rows: DataFrame) -> DataFrame:
    """Kept `pos` of events of few rows: each event is scanned in its own row, and no pairs are made."""
    item = F.struct("pos", "kind", "norm", "words", F.size("words").alias("n"))

    def near(k, x):
        both, small = k["n"] + x["n"], F.least(k["n"], x["n"])
        return (small > 0) & let(F.size(F.array_intersect(k["words"], x["words"])), lambda i: (i * 166 >= 66 * both) | (i * 100 >= 80 * small))

    # texts without any wording are repeats only within their type
    same = lambda k, x: ((k["norm"] == x["norm"]) & ((x["norm"] != "") | k["kind"].eqNullSafe(x["kind"]))) | ((k["kind"] == x["kind"]) & near(k, x))
    items = rows.groupBy("event").agg(F.array_sort(F.collect_list(item)).alias("items"))
    scan = F.aggregate(
        "items", F.slice("items", 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: F.coalesce(same(k, x), F.lit(False))), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return items.select(F.explode(F.transform(scan, lambda k: k["pos"])).alias("pos"))


def dedupe_questions(questions: DataFrame, pos: str = "question_id", event: str = "extracted_event_id") -> DataFrame:
    """Within each event, drop near-duplicates of the same type and repeats of the same text.

    An event of at most FEW questions is scanned in one row. In larger ones tokens are tagged with their event, so sets of different events never meet.
    """
    rows = questions.select(
        F.col(pos).alias("pos"), F.col(event).alias("event"), F.col("question_type").alias("kind"),
        aliased("question_text").alias("norm"), story_token_set("question_text").alias("words"),
    )
    large = questions.groupBy(F.col(event).alias("event")).agg(F.count("*").alias("c")).where(F.col("c") > FEW).select("event")
    large = written(large.where("event IS NOT NULL"))
    kept = _kept_in_scan(rows.where("event IS NOT NULL").join(large, "event", "left_anti"))
    if not large.isEmpty():
        kept = kept.unionByName(_kept_by_keys(rows.join(large, "event", "left_semi")))
    lost = rows.where("event IS NULL")
    if not lost.isEmpty():
        kept = kept.unionByName(_kept_by_keys(lost))
    return questions.join(kept.select(F.col("pos").alias(pos)), pos, "left_semi")


def _kept_by_keys(rows: DataFrame) -> DataFrame:
    """Kept `pos` of events of any size."""
    tag = F.col("event").cast("string")
    rows = rows.select("pos", "event", "kind", "norm", F.transform("words", lambda w: F.concat(tag, F.lit("|"), w)).alias("tokens"))
    groups, _ = distinct_sets(written(rows), ["event", "kind", "norm", "tokens"])
    sets = _sets_with_blanks(groups)
    keys = _with_text_keys(publish(sets, 0.66, contained=True), sets, "event")
    same_text = (F.col("l_norm") == F.col("r_norm")) & (F.col("l_event") == F.col("r_event"))
    rule = same_text | ((F.col("l_kind") == F.col("r_kind")) & near_duplicate())
    return keep_first(sets, keys, rule).select("pos")


def _first_per_key(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows per key by pos, cut per salt before per key."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(64)))
    cut = dealt.withColumn("_r", F.row_number().over(W.partitionBy(key, "_salt").orderBy("pos"))).where(F.col("_r") <= n)
    return cut.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("pos"))).where(F.col("_r") <= n).drop("_salt")


def accept_questions(questions: DataFrame, cap: int = 2, stored: DataFrame | None = None,
                     pos: str = "question_id", story: str = "extracted_event_id") -> DataFrame:
    """Scan questions in `pos` order: skip near-duplicates of stored or accepted texts, and stop a
    story at `cap` accepted questions.

    Questions with one token set are one group; a group stands where its first open question does. A round accepts that
    question if no similar group stands before it and its story cannot fill up before it; the group and the groups
    similar to it are then closed. Rounds hand on flags of groups and the places of a story's accepted
    questions: similar pairs are never written.
    """
    text = lambda df, *cols: df.select(*cols, story_token_set("question_text").alias("tokens"), aliased("question_text").alias("norm"))
    new = text(questions, F.col(pos).alias("pos"), F.col(story).alias("story"))
    old = None if stored is None else text(stored, (-1 - F.monotonically_increasing_id()).alias("pos"), F.lit(None).cast(new.schema["story"].dataType).alias("story"))
    pool = written(new if old is None else new.unionByName(old))
    # a text with tokens is known by its set, one without by its wording
    pool = pool.withColumn("norm", F.when(F.size("tokens") > 0, "").otherwise(F.col("norm")))
    groups, members = distinct_sets(pool, ["tokens", "norm"])
    sets = _sets_with_blanks(groups)
    keys = publish(sets, 0.66, contained=True)
    rows = written(members.select("pos", "story", F.col("first").alias("g")))
    blank = written(sets.where("n = 0 AND norm = ''").select(F.col("pos").alias("g")))
    # a text without any wording resembles nothing: each is its own group
    rows = rows.join(F.broadcast(blank.limit(1)).withColumn("_b", F.lit(True)), "g", "left").withColumn(
        "g", F.when(F.col("_b"), -1 - F.col("pos") * 2 - (1 << 40)).otherwise(F.col("g"))
    ).drop("_b")
    rows = written(rows)
    closed_by = lambda g: g.union(neighbours(keys, g.withColumnRenamed("g", "pos"), near_duplicate).withColumnRenamed("pos", "g")).distinct()
    taken = written(closed_by(rows.where("pos < 0").select("g").distinct()))
    open_ = written(rows.where("pos >= 0").join(taken, "g", "left_anti"))
    accepted = open_.limit(0)
    keyed = sets.where("n > 0").select(F.col("pos").alias("g"))
    while not open_.isEmpty():
        least = written(open_.groupBy("g").agg(F.min("pos").alias("m")))
        standing = lambda side: written(side.drop("m").join(least.withColumnRenamed("g", "pos"), "pos"))
        keys = Keys(standing(keys.left), standing(keys.right))
        free = first_of_neighbours(keys, near_duplicate).withColumnRenamed("pos", "g").union(least.select("g").join(keyed, "g", "left_anti"))
        first = open_.join(least.join(free, "g", "left_semi"), "g").where("pos = m").drop("m")
        running = open_.unionByName(accepted)
        head = _first_per_key(running, "story", cap).select("pos")
        take = written(first.join(head, "pos", "left_semi"))
        accepted = written(accepted.unionByName(take))
        full = _first_per_key(accepted, "story", cap).where(F.col("_r") == cap).select("story", F.col("pos").alias("last"))
        shut = closed_by(take.select("g").distinct())
        open_ = open_.join(shut, "g", "left_anti")
        open_ = open_.join(full, "story", "left").where(F.col("last").isNull() | (F.col("pos") < F.col("last"))).drop("last")
        open_ = written(open_)
    return questions.join(accepted.select(F.col("pos").alias(pos)), pos, "left_semi")
