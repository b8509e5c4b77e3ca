"""The prefix trie of conversations: a node for each distinct sequence of first turns, by sorted matrices of turn ids.

Each conversation is a row of 16-byte turn ids (SHA-256 of role and text). Rows are range-sorted by Spark, by ids and
conversation, and cut into blocks of bounded area (rows times the longest row). A block is a padded matrix: numpy's
lexsort orders its rows, the change of each cell against the row above, OR-accumulated along the columns, marks where
nodes start, and reduceat aggregates every depth. Subtree sums are differences of prefix sums over rows, because the
rows of a node are consecutive.

Nodes that reach over a block's border are partial there: nodes on the first row that the block before also has, and
nodes on the last row that the next block also has. They are few (the common prefix of two rows for each border), are
summed by the hash of their prefix, and get their subtree sums from prefix sums over blocks. So conversations that all
begin alike, or are all alike, are dealt over blocks like any others.

Scale: texts are hashed where they are read and never travel; a turn is about 30 bytes in the shuffles by conversation
and in the range sort. A task holds one block at a time. A conversation with more turns than a block has cells is a
block of its own. Conversations that end at a border node send one packed row a block, and are hashed as a stream.

Null roles and texts are empty; turns with equal numbers are ordered by the hash of role and text (null turn first);
repeated rows are repeated turns. Rows without a conversation id belong to no conversation. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Cells of a block's matrix, of 16 bytes each.
CELLS = 1_000_000
ID_BYTES = 16
#: Conversations of one family share turns; fixed values of the data's layout.
FAMILY, MOST_SHARED = 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
_BLOCK = "block long, conv_id long, path binary, chars array<int>, before int, after int"
_OUT = "kind byte, block long, node binary, parent binary, depth int, own_left boolean, up_left boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"
_FINAL, _PARTIAL, _ENDS = 0, 1, 2


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits; the role's length tells role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of id and chars, in order) of (conv_id, turn, role, text)."""
    row = F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"))
    d = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("t"))
    ordered = F.array_sort(F.collect_list("t"), lambda a, b: F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return d.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """convs (conv_id, turns) with turns rebuilt: the first h of the family's first conversation, where there is one,
    then the conversation's own after its first h; h is the CRC-32 of the decimal id, modulo 6."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, MOST_SHARED - 1).alias("_head"))
    d = convs.withColumns({"_h": h, "_family": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(heads, F.col("_family") == F.col("_of"), "left")
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return d.select("conv_id", F.concat(head, own).alias("turns"))


# blocks


def _columns(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema)


def _blocks(convs: DataFrame, cells: int) -> DataFrame:
    """(block, conv_id, path, chars), stored: convs sorted by path and conv_id, blocks numbered in order from 0."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    d = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    d = d.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, rows, width = TaskContext.get().partitionId(), 0, 0, 1
        for b in batches:
            numbers = []
            for n in pc.binary_length(b.column("path")).to_pylist():
                width = max(width, n // ID_BYTES)
                if rows and (rows + 1) * width > cells:
                    k, rows, width = k + 1, 0, max(1, n // ID_BYTES)
                rows += 1
                numbers.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), *b.columns], names=["part", "k", *b.schema.names])

    at = materialize(d.mapInArrow(cut, "part int, k long, conv_id long, path binary, chars array<int>"))
    parts = at.groupBy("part").agg((F.max("k") + 1).alias("n"))  # a row a partition
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return at.join(F.broadcast(parts), F.col("part") == F.col("_part")).select((F.col("k") + F.col("_first")).alias("block"), "conv_id", "path", "chars")


def _common(a: bytes, b: bytes) -> int:
    """Ids that two rows begin with alike."""
    n = min(len(a), len(b)) // ID_BYTES * ID_BYTES
    x, y = (np.frombuffer(v, np.uint8, n).reshape(-1, ID_BYTES) for v in (a, b))
    differ = np.nonzero((x != y).any(axis=1))[0]
    return int(differ[0]) if len(differ) else n // ID_BYTES


def _borders(blocks: DataFrame) -> DataFrame:
    """(block, before, after): ids that the block's first and last row share with the rows next to them; -1: no block."""
    ends = blocks.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [_common(x, y) for x, y in zip(b.column("last").to_pylist(), b.column("first").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(n, pa.int32())], names=["block", "n"])

    meet = ends.select("block", "last").join(ends.select((F.col("block") - 1).alias("block"), "first"), "block").mapInArrow(share, "block long, n int")
    none = F.lit(-1)
    sides = meet.select("block", none.alias("before"), F.col("n").alias("after")).unionByName(meet.select(F.col("block") + 1, F.col("n").alias("before"), none.alias("after")).toDF("block", "before", "after"))
    return ends.select("block", none.alias("before"), none.alias("after")).unionByName(sides).groupBy("block").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def _matrix(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids, two 64-bit numbers each, padded with 0; and their lengths."""
    lengths = np.fromiter(map(len, paths), np.int64, len(paths)) // ID_BYTES
    width = int(lengths.max(initial=0))
    out = np.zeros((len(paths), width, 2), np.uint64)
    out[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    return out, lengths


def _fold(block: int, conv: np.ndarray, paths: list[bytes], chars: list[np.ndarray], before: int, after: int) -> list[tuple]:
    """The rows that a block gives: final nodes, its part of border nodes, and ends of border nodes."""
    ids, lengths = _matrix(paths)
    n, width = ids.shape[:2]
    order = np.lexsort((conv, *(ids[:, j, k] for j in range(width - 1, -1, -1) for k in (1, 0))))
    # zero pads sort as ids do; only an all-zero id could tie with them, and lengths settle that below
    ids, lengths, conv = ids[order], lengths[order], conv[order]
    size = np.zeros((n, width), np.int64)
    size[np.arange(width) < lengths[:, None]] = np.concatenate([chars[i] for i in order.tolist()]) if width else []
    paths = [paths[order[0]], paths[order[-1]]]

    column = np.arange(width)
    valid = column < lengths[:, None]
    changed = np.ones((n, width), bool)
    changed[1:] = ((ids[1:] != ids[:-1]).any(axis=2) | (column >= lengths[:-1, None])) & valid[1:]
    changed = np.logical_or.accumulate(changed, axis=1)
    starts = changed & valid
    # depth 0 is the root; level d has the nodes' first rows, the rows behind their last, and what is summed
    levels = []
    fresh = starts.copy()
    if n:
        fresh[0, : max(before, 0)] = False  # these began in a block before
    leaf, saved = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    for d in range(width + 1):
        cuts = np.nonzero(changed[:, d - 1])[0] if d else np.zeros(1, np.int64)
        real = valid[cuts, d - 1] if d else np.ones(1, bool)
        s, e = cuts[real], np.append(cuts[1:], n)[real]
        add = lambda x: np.add.reduceat(x, cuts)[real]  # noqa: B023, E731
        children = add(fresh[:, d].astype(np.int64)) if d < width else np.zeros(len(s), np.int64)
        left, right = (s == 0) & (d <= before), (e == n) & (d <= after)
        here = ~(left | right)
        text = size[s, d - 1] if d else np.zeros(len(s), np.int64)
        leaf[s, d], saved[s, d] = here & (children == 0), here * (e - s - 1) * text
        levels.append((s, e, left, right, np.minimum.reduceat(conv, cuts)[real], children, add((lengths == d).astype(np.int64)), text))

    def subtree(own: np.ndarray, s: np.ndarray, e: np.ndarray, d: int) -> np.ndarray:
        rows = np.concatenate([[0], np.cumsum(own.sum(axis=1))])
        return rows[e] - rows[s] - own[s, :d].sum(axis=1)

    def keys(path: bytes, most: int) -> list[bytes]:
        h, out = hashlib.sha256(), [b""]
        for d in range(most):
            h.update(path[ID_BYTES * d : ID_BYTES * (d + 1)])
            out.append(h.copy().digest())
        return out

    first, last = keys(paths[0], max(before, 0)), keys(paths[1], max(after, 0))
    out: list[tuple] = []
    for d, (s, e, left, right, lo, children, ending, text) in enumerate(levels):
        n_leaves, tokens = subtree(leaf, s, e, d), subtree(saved, s, e, d)
        up = np.searchsorted(levels[d - 1][0], s, side="right") - 1 if d else np.zeros(len(s), np.int64)
        for i in range(len(s)):
            ends = ",".join(map(str, conv[s[i] : s[i] + ending[i]].tolist()))
            figures = (int(e[i] - s[i]), int(children[i]), int(n_leaves[i]), int(tokens[i]), int(text[i]))
            if left[i] or right[i]:
                own = first if left[i] else last
                out.append((_PARTIAL, block, own[d], own[d - 1] if d else None, d, bool(left[i]), None, int(lo[i]), None, *figures, None))
                if ends:
                    out.append((_ENDS, block, own[d], None, d, None, None, None, None, None, None, None, None, None, ends))
                continue
            parent, up_left = None, None
            if d:
                p = up[i]
                if levels[d - 1][2][p] or levels[d - 1][3][p]:
                    up_left = bool(levels[d - 1][2][p])
                else:
                    parent = int(levels[d - 1][4][p])
            out.append((_FINAL, block, None, None, d, None, up_left, int(lo[i]), parent, *figures, hashlib.sha256(ends.encode()).hexdigest() if ends else NO_ENDS))
    return out


def _folded(blocks: DataFrame, cells: int) -> DataFrame:
    """What all blocks give, stored."""
    rows = blocks.withColumns({"before": F.lit(None).cast("int"), "after": F.lit(None).cast("int")})
    notes = _borders(blocks).select("block", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("binary").alias("path"), F.lit(None).cast("array<int>").alias("chars"), "before", "after")
    dealt = rows.unionByName(notes).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("before"))
    kinds = {"byte": pa.int8(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _OUT.split(", ")])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: list[int] = []
        paths: list[bytes] = []
        chars: list[np.ndarray] = []
        for b in batches:
            number, cs, ps = b.column("block").to_pylist(), b.column("conv_id").to_pylist(), b.column("path").to_pylist()
            lists, befores, afters = b.column("chars"), b.column("before").to_pylist(), b.column("after").to_pylist()
            flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            for i, c in enumerate(cs):
                if befores[i] is None:
                    conv.append(c)
                    paths.append(ps[i])
                    chars.append(flat[cuts[i] : cuts[i + 1]])
                    continue
                # the note comes behind the rows of its block
                found = _fold(number[i], np.array(conv, np.int64), paths, chars, befores[i], afters[i])
                conv, paths, chars = [], [], []
                for k in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found[k : k + 20_000], strict=True), schema, strict=True)], schema=schema)

    return materialize(dealt.mapInArrow(made, _OUT))


def _streamed_ends(rows: DataFrame) -> DataFrame:
    """(node, ends): the hash of each node's ids, joined in the order of blocks."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            for node, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends"])
                    at, h = node, hashlib.sha256(ends.encode())
                else:
                    h.update(b"," + ends.encode())
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends"])

    return rows.select("node", "block", "ends").repartition("node").sortWithinPartitions("node", "block").mapInArrow(made, "node binary, ends string")


def _border_nodes(partial: DataFrame, ends: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes over borders, whole, with node and parent: sums over their parts, and what nodes over borders below
    them add. Of a node from block a to z these begin in blocks a to z - 1, and in a they are the deeper ones."""
    total = partial.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "chars")], F.min("block").alias("_a"), F.max("block").alias("_z"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    total = materialize(total.withColumns({"_leaf": (F.col("n_children") == 0).cast("long"), "_saved": (F.col("n_convs") - 1) * F.col("chars")}))
    below = W.partitionBy("_a").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    # sums over blocks up to each: in stretches of blocks, then over stretches
    each = blocks.select("block").distinct().join(total.groupBy(F.col("_a").alias("block")).agg(F.sum("_leaf").alias("l"), F.sum("_saved").alias("s")), "block", "left").select("block", F.shiftright("block", 12).alias("_t"), F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("s", F.lit(0)).alias("s"))
    stretch = W.orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    stretches = each.groupBy("_t").agg(F.sum("l").alias("_l"), F.sum("s").alias("_s")).select("_t", F.coalesce(F.sum("_l").over(stretch), F.lit(0)).alias("_l"), F.coalesce(F.sum("_s").over(stretch), F.lit(0)).alias("_s"))
    within = W.partitionBy("_t").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    upto = materialize(each.withColumns({"l": F.sum("l").over(within), "s": F.sum("s").over(within)}).join(stretches, "_t").select("block", (F.col("l") + F.col("_l")).alias("l"), (F.col("s") + F.col("_s")).alias("s")))
    d = total.withColumns({"_dl": F.sum("_leaf").over(below), "_ds": F.sum("_saved").over(below)})
    d = d.join(upto.toDF("_b1", "_l1", "_s1"), F.col("_a") == F.col("_b1")).join(upto.toDF("_b2", "_l2", "_s2"), F.col("_z") - 1 == F.col("_b2"))
    d = d.withColumns({"n_leaves": F.col("n_leaves") + F.col("_dl") + F.col("_l2") - F.col("_l1"), "saved_tokens": F.col("saved_tokens") + F.col("_ds") + F.col("_s2") - F.col("_s1")})
    d = d.join(ends.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return materialize(d.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")))


def trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of convs (conv_id, turns (array of id in 32 hex digits, chars)): conv_id (smallest member), depth,
    parent_conv_id (the parent's conv_id), n_convs (members), n_children, n_leaves (nodes without children, in the
    subtree), saved_tokens (over the subtree: (n_convs - 1) times the last turn's chars), ends_sha256 (of the ids of the
    conversations that end here, ascending, joined by commas)."""
    blocks = _blocks(convs, cells)
    found = _folded(blocks, cells)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    final = found.filter(F.col("kind") == _FINAL).withColumnRenamed("ends", "ends_sha256")
    partial = found.filter(F.col("kind") == _PARTIAL)
    whole = _border_nodes(partial, _streamed_ends(found.filter(F.col("kind") == _ENDS)), partial)
    # a final node below a border node learns that node's conversation by block, depth and side
    names = partial.select("block", F.col("depth").alias("_d"), F.col("own_left").alias("_l"), F.col("node").alias("_n")).join(whole.select(F.col("node").alias("_m"), F.col("conv_id").alias("_c")), F.col("_n") == F.col("_m")).select(F.col("block").alias("_b"), "_d", "_l", "_c")
    hung = final.filter("up_left is not null").join(names, (F.col("block") == F.col("_b")) & (F.col("depth") - 1 == F.col("_d")) & (F.col("up_left") == F.col("_l"))).withColumn("parent_conv_id", F.col("_c"))
    ups = whole.select(F.col("node").alias("_m"), F.col("conv_id").alias("parent_conv_id"))
    over = whole.join(ups, F.col("parent") == F.col("_m"), "left")
    every = final.filter("up_left is null").select(*columns).unionByName(hung.select(*columns)).unionByName(over.select(*columns))
    return every.withColumn("depth", F.col("depth").cast("long"))
