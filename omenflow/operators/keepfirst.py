"""Greedy keep-first over a similarity relation.

Scanning in order, an item is dropped when it is similar to an earlier item that was kept. In a
set-based form: *keep* an item once no earlier similar item is undecided or kept, *drop* it once an
earlier similar item is kept. Each round decides at least the first undecided item, and on real
data the rounds are few (log^2 n for random order).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .durable import written
from .tokenjoin import PAIR_BUDGET, Keys, meet, pair_estimate

HEADS = 32  # members of a crowded key that are compared per round
LEADERS = 128  # first undecided items that are compared with all others


def keep_first_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kept `pos`. `edges`: a, b with a < b for every similar pair."""
    undecided, kept = nodes.select("pos"), None
    edges = edges.select("a", "b")
    while True:
        blocked = edges.select(F.col("b").alias("pos")).distinct()
        keep = written(undecided.join(blocked, "pos", "left_anti"))
        kept = keep if kept is None else kept.unionByName(keep)
        gone = edges.join(keep, edges.a == keep.pos, "left_semi").select(F.col("b").alias("pos")).distinct()
        decided = written(keep.unionByName(gone))
        undecided = undecided.join(decided, "pos", "left_anti")
        edges = edges.join(decided, edges.a == decided.pos, "left_anti")
        edges = written(edges.join(decided, edges.b == decided.pos, "left_anti"))
        undecided = written(undecided)
        if edges.isEmpty():
            return written(kept.unionByName(undecided))


def _heads(side: DataFrame, by: str = "pos") -> DataFrame:
    """The first `HEADS` members of each key, in the order of `by`. Cut per salt before per key."""
    dealt = side.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(64)))
    cut = dealt.withColumn("_r", F.row_number().over(W.partitionBy("key", "_salt").orderBy(by))).where(F.col("_r") <= HEADS)
    top = cut.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(by))).where(F.col("_r") <= HEADS)
    return top.drop("_r", "_salt")


def _beyond(side: DataFrame, by: str = "pos") -> DataFrame:
    """key, last: for keys with more members than heads, the last place that is a head's."""
    heads = _heads(side, by).groupBy("key").agg(F.max(by).alias("last"))
    sizes = side.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HEADS)
    return heads.join(sizes, "key").select("key", "last")


def similar_pairs(keys: Keys, rule: Column) -> DataFrame:
    """a < b for every pair of the relation, once."""
    pairs = meet(keys.left, keys.right, True, (F.col("l_pos") != F.col("r_pos")) & rule)
    return pairs.select(F.least("l_pos", "r_pos").alias("a"), F.greatest("l_pos", "r_pos").alias("b")).distinct()


def keep_first(nodes: DataFrame, keys: Keys, rule: Column, budget: int = PAIR_BUDGET) -> DataFrame:
    """Kept `pos` under `rule`, a test on `l_`/`r_` columns of a candidate.

    While the keys would meet in more than `budget` pairs, a round looks at the first members of
    each key only: an item with an unseen earlier member in a key stays undecided, so nothing is
    missed, and the items kept by the round knock out the crowd behind them.
    """
    undecided, kept = nodes.select("pos"), None
    left, right = keys.left, keys.right
    while pair_estimate(left, right) > budget:
        lh, rh = _heads(left), _heads(right)
        earlier = lambda a, b: (F.col(f"{a}_pos") < F.col(f"{b}_pos")) & rule
        blocked = (
            meet(left, rh, where=earlier("r", "l"), semi=True).select(F.col("l_pos").alias("pos"))
            .union(meet(lh, right, where=earlier("l", "r")).select(F.col("r_pos").alias("pos")))
        )
        unseen = (
            left.join(_beyond(right), "key").where("pos > last").select("pos")
            .union(right.join(_beyond(left), "key").where("pos > last").select("pos"))
        )
        keep = written(undecided.join(blocked.union(unseen).distinct(), "pos", "left_anti"))
        kept = keep if kept is None else kept.unionByName(keep)
        kl, kr = left.join(keep, "pos", "left_semi"), right.join(keep, "pos", "left_semi")
        gone = (
            meet(left, kr, where=earlier("r", "l"), semi=True).select(F.col("l_pos").alias("pos"))
            .union(meet(kl, right, where=earlier("l", "r")).select(F.col("r_pos").alias("pos")))
        ).distinct()
        decided = written(keep.unionByName(gone))
        undecided = written(undecided.join(decided, "pos", "left_anti"))
        left = written(left.join(undecided, "pos", "left_semi"))
        right = written(right.join(undecided, "pos", "left_semi"))
    rest = keep_first_edges(undecided, written(similar_pairs(Keys(left, right), rule)))
    return rest if kept is None else written(kept.unionByName(rest))


def settle_by_leaders(items: DataFrame, rule: Callable[[str, str], Column]) -> tuple[list[int], DataFrame]:
    """Kept positions so far, and the items still undecided.

    `rule(small, large)` is the test on columns with these two prefixes. The first items are settled among themselves, and those kept
    drop what resembles them among all others: no keys, no pairs of the crowd. It goes on as long as a round halves the rest.
    """
    kept: list[int] = []
    sided = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    rest, left = items, items.count()
    while left:
        front = written(rest.orderBy("pos").limit(LEADERS))
        met = sided(front, "l").join(F.broadcast(sided(front, "r")), (F.col("l_pos") != F.col("r_pos")) & rule("l", "r"))
        near = {tuple(sorted(r)) for r in met.select("l_pos", "r_pos").collect()}  # pairs of at most LEADERS items
        mine: list[int] = []
        for r in front.select("pos").orderBy("pos").collect():
            if not any((k, r.pos) in near for k in mine):
                mine.append(r.pos)
        kept += mine
        last = front.agg(F.max("pos")).first()[0]
        heads = F.broadcast(sided(front.where(F.col("pos").isin(mine)), "r"))
        others = sided(rest.where(F.col("pos") > last), "l").join(heads, rule("l", "r") | rule("r", "l"), "left_anti")
        rest = written(others.select(*[F.col(f"l_{c}").alias(c) for c in items.columns]))
        before, left = left, rest.count()
        if left > before / 2:
            break
    return kept, rest


def first_of_neighbours(keys: Keys, rule: Callable[[str, str], Column]) -> DataFrame:
    """`pos` of the members that no similar member precedes for certain, by their column `m`.

    `rule(small, large)` is the test on columns with these two prefixes, of which the first names the published side of the
    smaller set. Members are compared with the first ones of their keys only, and just a flag leaves the join; one that stands
    behind unseen members of a key has to wait until those in front are gone. The first member of all is never held up.
    """
    left, right = keys.left, keys.right
    lh, rh = written(_heads(left, "m")), written(_heads(right, "m"))
    earlier = F.col("r_m") < F.col("l_m")
    held = [
        meet(left, rh, True, earlier & rule("l", "r"), semi=True).select(F.col("l_pos").alias("pos")),
        meet(right, lh, True, earlier & rule("r", "l"), semi=True).select(F.col("l_pos").alias("pos")),
        left.join(_beyond(right, "m"), "key").where("m > last").select("pos"),
        right.join(_beyond(left, "m"), "key").where("m > last").select("pos"),
    ]
    members = left.select("pos").union(right.select("pos")).distinct()
    return members.join(held[0].union(held[1]).union(held[2]).union(held[3]).distinct(), "pos", "left_anti")


def neighbours(keys: Keys, of: DataFrame, rule: Callable[[str, str], Column]) -> DataFrame:
    """`pos` of the members that are similar to one of `of` (pos), each once: flags, not pairs."""
    near = lambda side: side.join(of, "pos", "left_semi")
    found = [
        meet(keys.left, near(keys.right), True, rule("l", "r"), semi=True),
        meet(keys.right, near(keys.left), True, rule("r", "l"), semi=True),
    ]
    return found[0].select("l_pos").union(found[1].select("l_pos")).distinct().withColumnRenamed("l_pos", "pos")
