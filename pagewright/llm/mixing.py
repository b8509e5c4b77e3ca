"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled (by an md5 of doc_id, or of the text where it is null, and seed). A document's virtual finish time is its
source's cumulative words divided by the source's target; the second pass over a source goes on where the first
ended. All copies are put in order of finish time and cut where their words reach the total budget.

Scale: a source that holds a third of all rows is dealt into 16**digits shuffle buckets, so running sums need only
one bucket at a time, plus a prefix over bucket totals. The cut is found over slots of virtual time: fair queueing
makes words uniform along it, so slots are even and only the slot with the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, aside, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
#: Slots of virtual time from 0 to 1; times of 2 or more share one more slot.
SLOTS = 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(mix_source, source_size, target): words by source and how many the mix should take of them.

    Sources by code point, null last, weigh `weights`, repeating. They share `share` times all words; none gets over
    `most` times its own words, and what is left over goes to the others by weight. That is the water level x for
    which sum(min(most * size, weight * x)) is the budget, found in one sorted pass over the sources."""
    each = sized.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("mix_source").asc_nulls_last())
    each = each.withColumn("at", F.row_number().over(by_name) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", "at")
    before, rest, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    each = each.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.first(F.when(F.col("full_at") > F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when((F.col("full_at") <= F.col("level")) | level.isNull(), F.col("cap")).otherwise(F.col("weight") * level)
    return each.select("mix_source", "source_size", target.alias("target"))


def schedule(docs: DataFrame, digits: int = 3, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, cut). documents: doc_id, mix_source, size, shuffle_key, mix_key, source_size, target and copies, an array of
    (finish, copy) for each pass. cut: one row with the slot in which the budget ends and the last copy in it.

    Null texts have size 0, a null source is a source of its own, repeated rows are rows of their own. Nothing else of
    the input is read, so extra columns do no harm. An empty table gives no documents and a cut of nulls."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat_ws(":", name, F.lit(str(seed))))
    sized = docs.select("doc_id", F.col("source").alias("mix_source"), n_words(F.col("text")).alias("size"), key.alias("shuffle_key"), row_key().alias("mix_key"))
    sized = materialize(sized).withColumn("bucket", F.substring("shuffle_key", 1, digits))
    part = sized.groupBy("mix_source", "bucket").agg(F.sum("size").alias("part"))
    earlier = F.coalesce(F.sum("part").over(W.partitionBy("mix_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = part.select("mix_source", "bucket", earlier.alias("earlier"))
    targets = source_targets(sized, weights, share, most)
    part = part.alias("p").join(targets.alias("t"), F.col("p.mix_source").eqNullSafe(F.col("t.mix_source"))).select(F.col("p.mix_source").alias("s"), F.col("bucket").alias("b"), "earlier", "source_size", "target")
    inside = W.partitionBy("mix_source", "bucket").orderBy("shuffle_key", "doc_id", "size", "mix_key").rowsBetween(W.unboundedPreceding, 0)
    timed = sized.withColumn("inside", F.sum("size").over(inside))
    timed = timed.join(part, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    copies = [F.struct(((F.col("source_size") * i + F.col("earlier") + F.col("inside")) / F.col("target")).alias("finish"), F.lit(i).alias("copy")) for i in range(most)]
    timed = timed.select("doc_id", "mix_source", "size", "shuffle_key", "mix_key", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), F.array(*copies)).alias("copies"))
    timed = materialize(timed)
    return timed, _cut(timed, share)


def _slot(finish: Column) -> Column:
    return F.least(F.floor(finish * SLOTS), F.lit(2 * SLOTS)).cast("long")


def _place(finish: Column, copy: Column) -> Column:
    """What copies are ordered by. Rows that agree in all of it come or go together."""
    return F.struct(finish.alias("finish"), copy.alias("copy"), F.col("shuffle_key").alias("shuffle_key"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))


def _cut(timed: DataFrame, share: float) -> DataFrame:
    every = timed.select("doc_id", "size", "shuffle_key", F.explode("copies").alias("c")).withColumn("slot", _slot(F.col("c.finish")))
    slots = every.groupBy("slot").agg(F.sum("size").alias("words"))
    slots = slots.withColumn("upto", F.sum("words").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)))
    budget = timed.agg((F.sum("size") * F.lit(share)).alias("budget"))
    last = slots.join(F.broadcast(budget), F.col("upto") > F.col("budget"))
    last = last.agg(F.min_by(F.struct(F.col("slot"), (F.col("budget") - F.col("upto") + F.col("words")).alias("room")), "slot").alias("x")).select("x.slot", "x.room")
    near = every.join(F.broadcast(last), "slot")
    near = near.withColumn("place", _place(F.col("c.finish"), F.col("c.copy")))
    near = near.withColumn("upto", F.sum("size").over(W.partitionBy("slot").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    edge = near.filter(F.col("upto") <= F.col("room")).agg(F.max("place").alias("edge"))
    return last.select(F.col("slot").alias("cut_slot")).join(F.broadcast(edge), F.lit(True), "left")


def _in(finish: Column, copy: Column) -> Column:
    slot = _slot(finish)
    return F.coalesce((slot < F.col("cut_slot")) | ((slot == F.col("cut_slot")) & F.coalesce(_place(finish, copy) <= F.col("edge"), F.lit(False))), F.lit(True))


def take(docs: DataFrame, **options) -> DataFrame:
    """One row for each document, with taken: the words that the mix takes of it (repeats counted). Cut rows are one
    row, so the join that brings them is a broadcast of one row."""
    timed, cut = schedule(docs, **options)
    timed = timed.join(F.broadcast(cut), F.lit(True), "left")
    times = F.aggregate(F.coalesce(F.transform("copies", lambda c: F.when(_in(c["finish"], c["copy"]), 1).otherwise(0)), F.array(F.lit(0))), F.lit(0), lambda a, x: a + x)
    return timed.select("doc_id", "size", "source_size", "target", "mix_source", "shuffle_key", "mix_key", "copies", "cut_slot", "edge", times.alias("times"), (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, partitions: int | None = None, ordered: bool = True, **options) -> DataFrame:
    """The mix itself: the taken copies with all columns of docs, in order of finish time (range-partitioned, sorted
    within partitions) or, with ordered=False, without that last exchange of the texts. Columns mix_finish and mix_copy
    are added, in place of any of these names in docs.

    Rows are found again by doc_id and a hash of doc_id, source and text. Rows that agree in both are alike to the mix;
    such rows are numbered on either side, so that together they give just the words that `take` says."""
    docs, columns = aside(docs.drop("mix_finish", "mix_copy"), "_key", "_mix", "_mix_key", "_mix_id", "_mix_copies", "_mix_no", "_more_key", "_more_id", "_no")
    taken = take(docs, **options).filter("size > 0")
    taken = materialize(taken.select(F.col("mix_key").alias("_mix_key"), F.col("doc_id").alias("_mix_id"), F.slice("copies", F.lit(1), F.col("times")).alias("_mix_copies")))
    more = materialize(taken.groupBy("_mix_key", "_mix_id").agg(F.count(F.lit(1)).alias("_mix_rows")).filter("_mix_rows > 1").select(F.col("_mix_key").alias("_more_key"), F.col("_mix_id").alias("_more_id")))
    keyed, chosen = docs.withColumn("_key", row_key()), taken.filter(F.size("_mix_copies") > 0)
    same = (F.col("_key") == F.col("_mix_key")) & F.col("doc_id").eqNullSafe(F.col("_mix_id"))
    if not more.limit(1).count():
        out = keyed.join(chosen, same)
    else:
        left = (F.col("_key") == F.col("_more_key")) & F.col("doc_id").eqNullSafe(F.col("_more_id"))
        right = (F.col("_mix_key") == F.col("_more_key")) & F.col("_mix_id").eqNullSafe(F.col("_more_id"))
        out = keyed.join(chosen.join(more, right, "left_anti"), same)
        numbered = keyed.join(more, left, "left_semi").withColumn("_no", F.row_number().over(W.partitionBy("_key", "doc_id").orderBy("_key")))
        places = chosen.join(more, right, "left_semi").withColumn("_mix_no", F.row_number().over(W.partitionBy("_mix_key", "_mix_id").orderBy("_mix_copies")))
        out = out.unionByName(numbered.join(places, same & (F.col("_no") == F.col("_mix_no"))).drop("_no", "_mix_no"))
    out = out.withColumn("_mix", F.explode("_mix_copies")).select(*columns, F.col("_mix.finish").alias("mix_finish"), F.col("_mix.copy").alias("mix_copy"))
    if not ordered:
        return out
    order = ["mix_finish", "mix_copy", "doc_id"]
    out = out.repartitionByRange(partitions, *order) if partitions else out.repartitionByRange(*order)
    return out.sortWithinPartitions(*order)
