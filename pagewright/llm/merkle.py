"""A Merkle manifest of a dataset: a tree of hashes for each source, a tree over their roots, and a proof for each row.

A digest H is the lowercase hex SHA-256 of inputs one after another, digests among them as hex text. A leaf is H of the
row's columns in order: `-` for null, else the number of UTF-8 bytes, `:`, and the value. Leaves of a source ascend by
key; every `arity` consecutive nodes (the last run may have fewer, even one) become their H until one node remains, the
subroot. Subroots, ordered by source (null first, by UTF-8 bytes), become the root likewise.

Levels are built by sibling-shift self-joins: each node computes the places of its siblings (arity 2: place XOR 1;
else offsets of its slot, modulo arity) and sends its digest there; an equijoin on the place puts the siblings beside
each node, and nodes of slot zero emit parents. The same joined rows give the proofs: going down, each node's path is
its siblings followed by its parent's path.

Scale: keys of the joins are (source number, place), so a source with most rows is dealt as evenly as any other. Texts
are hashed where they are read; only digests (32 bytes) and the columns asked for travel, with their leaf. Rows get their places from a range sort by source, key
and leaf, with counts of partitions as offsets. A level has an arity-th of the rows of the one below, so all of it is a
few passes over digests; paths of a leaf are put together while it is joined, and are never stored for leaves.

Null keys come first, ties of a key are ordered by leaf, equal rows keep a leaf each. A row with a null key is never
tampered with. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a partition of the range sort has above this bit are numbered by it: what monotonically_increasing_id does.
_PART_BITS = 33


def leaf(values: dict[str, Column]) -> Column:
    """H of the values in order."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*each), 256)


def digest(parts: Column) -> Column:
    """H, as 32 bytes, of digests in a binary column."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def tampered(columns: tuple[str, ...] = COLUMNS, key: str = "doc_id") -> dict[str, Column]:
    """The columns of a row after tampering: where 5 divides the key's CRC-32, A-Z of text become a-z."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return {c: F.when(hit, F.translate(c, upper, lower)).otherwise(F.col(c)) if c == "text" else F.col(c) for c in columns}


def _joined(parts: Column) -> Column:
    """Binary values of an array, one after another."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows, stored in a range sort, with _part and _row: partitions in order, and ascending numbers in each. The last
    key tells equal rows apart, so that many of them are no one partition."""
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.asc("_tie")]
    at = tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_row", F.monotonically_increasing_id())
    return materialize(at.withColumn("_part", F.shiftright("_row", _PART_BITS).cast("int")))


def _placed(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows with tree (the number of the group, groups ascending, null first), place (from 0 in the group) and nodes (the
    group's rows), and the groups (group, tree, nodes)."""
    at = _ranged(rows, [F.asc_nulls_first(group), *order])
    runs = materialize(at.groupBy("_part", group).agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n")))
    groups = _ranged(runs.groupBy(group).agg(F.sum("_n").alias("nodes")), [F.asc_nulls_first(group)])
    sizes = groups.groupBy("_part").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", (before - F.col("_from")).alias("_shift"))
    groups = materialize(groups.join(sizes, "_part").select(group, (F.col("_row") + F.col("_shift")).alias("tree"), "nodes"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", F.col(group).alias("_group"), (earlier - F.col("_from")).alias("_shift"))
    runs = runs.join(groups.withColumnRenamed(group, "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    runs = runs.withColumnRenamed("_part", "_p")
    placed = at.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.select(*rows.columns, "tree", (F.col("_row") + F.col("_shift")).alias("place"), "nodes"), groups


def siblings(place: Column, arity: int = ARITY) -> Column:
    """The places of the other nodes of a run, where the last run may have fewer."""
    if arity == 2:
        return F.array(place.bitwiseXOR(F.lit(1)))
    slot = place % arity
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda k: place - slot + (slot + k) % arity)


def _families(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, place, nodes, digest, row) with left and right: the siblings' digests, joined, on either side."""
    sent = nodes.select(F.col("tree").alias("_tree"), F.col("place").alias("_from"), F.col("digest").alias("_digest"), F.explode(siblings(F.col("place"), arity)).alias("_to"))
    met = nodes.join(sent, (F.col("tree") == F.col("_tree")) & (F.col("place") == F.col("_to")), "left")
    kin = F.array_sort(F.collect_list(F.when(F.col("_from").isNotNull(), F.struct("_from", "_digest"))))
    met = met.groupBy("tree", "place").agg(*[F.first(c).alias(c) for c in nodes.columns if c not in ("tree", "place")], kin.alias("_kin"))
    side = lambda of: _joined(F.transform(F.filter("_kin", of), lambda k: k["_digest"]))
    return met.select(*nodes.columns, side(lambda k: k["_from"] < F.col("place")).alias("left"), side(lambda k: k["_from"] > F.col("place")).alias("right"))


def _trees(leaves: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of trees over leaves (tree, place, nodes, digest, row) with at most `most` leaves each, siblings beside
    each node, without the top nodes; and the top nodes (tree, digest, level). `row` stays with the leaves."""
    levels, tops, at = [], None, leaves
    while True:
        top = at.filter("nodes = 1").select("tree", "digest", F.lit(len(levels)).alias("level"))
        tops = top if tops is None else tops.unionByName(top)
        if most <= 1:
            return levels, tops
        levels.append(materialize(_families(at.filter("nodes > 1"), arity)))
        above = levels[-1].filter(F.col("place") % arity == 0)
        number = lambda c: F.floor(c / arity).cast("long")
        at = above.select("tree", number(F.col("place")).alias("place"), number(F.col("nodes") + arity - 1).alias("nodes"), digest(F.concat("digest", "right")).alias("digest"))
        most = -(-most // arity)


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int, leaves: DataFrame) -> DataFrame:
    """row, path, subroot, root of all leaves; tops (tree, level, path, subroot, root), leaves (tree, nodes, row). A node's
    path travels once to the run below it."""
    found = None
    for k in range(len(levels), -1, -1):
        at = tops.filter(F.col("level") == k)
        if k == 0:
            single = leaves.filter("nodes = 1").select(F.col("tree").alias("_tree"), "row")
            here = at.join(single, F.col("tree") == F.col("_tree")).select("row", "path", "subroot", "root")
        else:
            here = at.select("tree", F.lit(0).cast("long").alias("place"), "path", "subroot", "root")
        if k < len(levels):
            up = found.select(F.col("tree").alias("_tree"), F.col("place").alias("_up"), F.col("path").alias("_path"), "subroot", "root")
            down = levels[k].join(up, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("place") / arity) == F.col("_up")))
            path = F.concat(F.array(F.struct("left", "right")), F.col("_path")).alias("path")
            here = here.unionByName(down.select(*(["row"] if k == 0 else ["tree", "place"]), path, "subroot", "root"))
        found = here
    return found


@dataclass
class Manifest:
    """leaves: tree, place, nodes, digest and row (what was given, as a struct). levels, tops: of the sources' trees.
    sources (source, tree, nodes). over, root: levels of the tree over subroots, and its top (no row if there are no rows)."""

    leaves: DataFrame
    sources: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    over: list[DataFrame]
    root: DataFrame
    arity: int


def build(rows: DataFrame, group: str = "source", key: str = "doc_id", arity: int = ARITY) -> Manifest:
    """The manifest of rows that have `leaf` (hex) beside group and key."""
    slim = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.unhex("leaf").alias("digest"), F.struct(*[c for c in rows.columns if c != "leaf"]).alias("row"))
    placed, groups = _placed(slim, "group", [F.asc_nulls_first("key"), F.asc("digest")])
    leaves = materialize(placed.select("tree", "place", "nodes", "digest", "row"))
    most, count = groups.agg(F.max("nodes"), F.count(F.lit(1))).first()
    levels, tops = _trees(leaves, most or 0, arity)
    tops = materialize(tops)
    none = F.lit(None).cast("string").alias("row")
    over, root = _trees(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("nodes"), "digest", none), count, arity)
    return Manifest(leaves, groups.withColumnRenamed("group", group), levels, tops, over, root, arity)


def proofs(m: Manifest) -> DataFrame:
    """row, leaf, path (the siblings' digests left and right of the node, in bytes, of each level from the leaf up through
    the subroot to the root), subroot and root (hex) of each leaf."""
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    hex_ = lambda c: F.lower(F.hex(c))
    top = m.root.select("tree", "level", none.alias("path"), F.lit("").alias("subroot"), hex_("digest").alias("root"))
    of_tree = lambda d: d.withColumn("row", F.col("place"))
    subs = m.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("row"), F.lit(m.tops.count()).cast("long").alias("nodes"))
    over = _paths([of_tree(d) for d in m.over], top, m.arity, subs).select(F.col("row").alias("_tree"), "path", "root")
    subroots = m.tops.join(over, F.col("tree") == F.col("_tree")).select("tree", "level", "path", hex_("digest").alias("subroot"), "root")
    keep = lambda d: d.withColumn("row", F.struct("row", hex_("digest").alias("leaf")))
    return _paths([keep(d) if k == 0 else d for k, d in enumerate(m.levels)], subroots, m.arity, keep(m.leaves)).select("row.row", "row.leaf", "path", "subroot", "root")


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.lower(F.array_join(F.transform(path, lambda p: F.concat(F.hex(p["left"]), F.hex(p["right"]))), "")), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(F.lower(F.hex(p["left"])), h, F.lower(F.hex(p["right"]))), 256))


def verified(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, after tampering with some."""
    now = tampered()
    changed = F.when(~now["text"].eqNullSafe(F.col("text")), F.unhex(leaf(now)))
    rows = docs.select("doc_id", "source", leaf({c: F.col(c) for c in COLUMNS}).alias("leaf"), changed.alias("now"))
    folded = fold(F.coalesce(F.lower(F.hex("row.now")), F.col("leaf")), F.col("path"))
    d = proofs(build(rows, arity=arity)).select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))
