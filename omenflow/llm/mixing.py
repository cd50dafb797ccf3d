"""Mixing sources to target weights by thresholds on a hash, found from histograms."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..operators.durable import written
from ..operators.ranks import global_rank
from .common import words

#: Bits of the document hash that one histogram resolves, and how many histograms follow each other.
BITS, LEVELS = 12, 5
#: A source's line of the plan is met in so many places, so that no task gets all rows of a hot source.
SALTS = 32


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def _hash(id_col: str) -> Column:
    """60 bits that depend on the id alone."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, its key, size in words and the hash of the id; the texts are read once, here."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), _key(source_col).alias("key"),
        F.size(words(F.col(text_col))).cast("long").alias("size"), _hash(id_col).alias("h"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """key, source_size, target for each source.

    Weights repeat along the sources in code point order, null last. A source whose share is above
    `most` times its size stops there; what it leaves is shared again by weight until none is above.
    Each round is one aggregate over the sources; sums are exact integers.
    """
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "place", 0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("key", "source_size", weight.cast("long").alias("w")))
    total, free = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    stopped = 0
    exact = lambda c: c.cast("decimal(19,0)")
    while True:
        capped = exact(F.col("source_size")) * exact(F.lit(most * free)) < exact(F.col("w")) * exact(F.lit(total - most * stopped))
        now = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)),
        ).first()
        if tuple(now) == (stopped, free) or now[1] == 0:
            break
        stopped, free = now
    share = (F.col("w") * F.lit(total - most * stopped)).cast("double") / F.lit(max(free, 1)).cast("double")
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share)
    return ranked.select("key", "source_size", target.alias("target"))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """key, cut, below, at: the hash where a source's words reach its partial budget `rest`.

    A histogram of words by source and hash prefix tells the prefix in which the budget ends;
    only rows of that prefix go into the next, finer histogram. Histograms are pre-aggregated by
    the tasks that read the rows, and the running sums are over at most 2**BITS prefixes a source.
    """
    edge = None
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        held = rows.select("key", "size", F.shiftright("h", shift).alias("prefix"))
        if edge is None:
            hist = held.groupBy("key", "prefix").agg(F.sum("size").alias("at"))
            hist = hist.join(plan.select("key", "rest").withColumn("base", F.lit(0).cast("long")), "key")
        else:
            held = held.withColumn("upper", F.shiftright("prefix", BITS))
            hist = held.join(edge, ["key", "upper"]).groupBy("key", "prefix").agg(
                F.sum("size").alias("at"), F.first("rest").alias("rest"), F.first("base").alias("base")
            )
        run = W.partitionBy("key").orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
        hist = hist.withColumn("below", F.col("base") + F.sum("at").over(run) - F.col("at"))
        found = hist.where("below <= rest and rest < below + at")
        edge = written(found.select("key", F.col("prefix").alias("upper"), "rest", F.col("below").alias("base"), "at"))
        last, edge = edge, edge.drop("at")
    return last.select("key", F.col("upper").alias("cut"), F.col("base").alias("below"), "at")


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """key, salt, source_size, target, whole, rest, cut, below, at: one source's line in SALTS places."""
    plan = source_targets(rows, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole)
    plan = written(plan.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")))
    cuts = _cuts(rows, plan)
    return plan.join(cuts, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _copies() -> Column:
    extra = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (2 * (F.col("rest") - F.col("below")) >= F.col("at")))
    return F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of `docs`.

    Sources share the words of all rows by weight, each at most `most` times its own words. A
    source at r times its words takes every document floor(r) times and, for the rest, once more
    those whose hash lies below a cut; the document at the cut goes where the total comes nearer.
    A larger budget keeps what a smaller one takes. Nothing is sorted, and reruns agree.

    A null or blank text has size 0 and takes 0 words. A null source is a source, the last in
    order. Rows with one id are taken alike; null ids count as one. No rows give no rows.
    """
    rows = written(_sized(docs, id_col, text_col, source_col))
    rows = rows.withColumn("salt", (F.col("h") % SALTS).cast("int")).join(_plan(rows, weights, most), ["key", "salt"])
    return rows.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", _copies().alias("copies"), (F.col("size") * _copies()).alias("taken")
    )


def take_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
) -> DataFrame:
    """The rows of `docs` as often as `mix` takes them, with all columns: from 0 to `most` times."""
    plan = _plan(written(_sized(docs, id_col, text_col, source_col)), weights, most)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key, h = _key(source_col), _hash(id_col)
    rows = docs.select(row, key.alias("key"), h.alias("h"), (h % SALTS).cast("int").alias("salt")).join(plan, ["key", "salt"])
    rows = rows.select("row", _copies().cast("int").alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def mix_sql(tables: str = "documents") -> str:
    """The words each document gives, in SQL, with running sums in place of the histograms."""
    return f"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h
  from {tables}),
sources as (
  select source, sum(size)::hugeint as s,
    [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1]::hugeint as w
  from sized group by source),
total as (select sum(s) as t, sum(w) as all_w from sources),
rounds(n, stopped, free) as (
  select 0, 0::hugeint, (select all_w from total)
  union all
  select n + 1,
    (select coalesce(sum(case when 3 * s * free < w * (t - 3 * stopped) then s end), 0) from sources, total),
    (select coalesce(sum(case when not 3 * s * free < w * (t - 3 * stopped) then w end), 0) from sources, total)
  from rounds where n < 40),
final as (select stopped, free from rounds order by n desc limit 1),
goals as (
  select source, s, case when 3 * s * free < w * (t - 3 * stopped) then (3 * s)::double
    else (w * (t - 3 * stopped))::double / greatest(free, 1)::double end as target
  from sources, total, final),
plans as (
  select *, case when s > 0 then floor(target / s::double) else 0 end as whole from goals),
hashes as (
  select source, h, sum(size) as held from sized group by source, h),
sums as (
  select source, h, held, sum(held) over (partition by source order by h) - held as below from hashes)
select z.doc_id, z.size::bigint as size, p.s::bigint as source_size, p.target,
  (z.size * (p.whole + case when 2 * (p.target - p.whole * p.s::double - x.below::double) >= x.held::double then 1 else 0 end))::bigint as taken
from sized z join plans p on z.source is not distinct from p.source
join sums x on x.source is not distinct from z.source and x.h = z.h
"""
