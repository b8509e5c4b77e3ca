"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

1. Documents with equal shingle sets are one class; one representative of each goes on, with its number of copies.
2. Candidates: MinHash bands (32 bands of 6; a pair at 0.8 is missed with probability 6e-5, nearer pairs far less).
   Buckets give star edges, never pairs; connected components of the edges are candidate groups.
3. Each group is verified where its shingle sets meet. Pairs are compared by MinHash values, 16 at a time; a pair is
   dropped when the posterior probability that its similarity reaches the threshold falls below `tolerance` (uniform
   prior). All that stay are verified exactly over the whole sets.
4. Links are counted by document and connected by union-find in the task; only counts and roots leave it.

Scale: groups of more than BLOCK representatives are dealt by size of their sets into classes, each of which can have
links to itself and the next one only, and classes into blocks that are verified block against block. So no task holds
a whole group, texts of other lengths are not compared, and no pairs are written as rows. Texts are shuffled once, and
only those of candidates go on from it. Joins by component split the rows of large ones.

Documents with fewer than five words have one shingle, all their words. Null texts and texts without words link to
nothing. A row with null doc_id belongs to its class of equal sets, if that has other rows, and links to nothing.
Repeated rows are copies. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected, join_split
from .common import aside, gram_hashes, grouped, hashed_words, materialize, mixed, small_batches

K = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
CLASS = 1 << 32
_R = np.random.default_rng(20240501)
_A = _R.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = hashed_words(texts)
    ends, out = np.cumsum(counts), []
    for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
        own = h[e - n : e]
        out.append(np.unique(gram_hashes(own, k)) if n >= k else gram_hashes(own, n) if n else own)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of HASHES for each set; all sets have members."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= 32_768:
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        moved = np.empty_like(flat)
        for j in range(HASHES):
            np.multiply(flat, _A[j], out=moved)
            moved += _B[j]
            out[at:end, j] = np.minimum.reduceat(moved, starts) >> np.uint64(32)
        at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the least m with P(similarity >= threshold | m of n equal) >= tolerance. With a uniform
    prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is that of a binomial: P(Bin(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def verified(sets: list[np.ndarray], sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a[i], b[i]), sorted by a, whose sets reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    keep = low >= threshold * high - 1e-9
    a, b = a[keep], b[keep]
    same = np.zeros(len(a), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(a):
            return a, b
        same += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1, dtype=np.int32)
        keep = same >= least[n]
        a, b, same = a[keep], b[keep], same[keep]
    ok = np.zeros(len(a), bool)
    for i in np.unique(a):
        lo, hi = np.searchsorted(a, [i, i + 1])
        own = sets[i]
        for at in range(lo, hi, 64):
            others = b[at : min(at + 64, hi)]
            flat = np.concatenate([sets[j] for j in others])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
            both = np.add.reduceat(hit, starts, dtype=np.int64)
            ok[at : at + len(others)] = both >= threshold * (len(own) + sizes[others] - both) - 1e-9
    return a[ok], b[ok]


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set_a, set_b, n (the identity of the shingle set), bands."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = shingles(b.column("text"), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            for i, keys in zip(full, band_keys(signatures([sets[i] for i in full])) if full else [], strict=True):
                bands[i] = keys
            one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            two = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "set_a", "set_b", "n", "bands"])

    return docs.mapInArrow(made, "doc_id long, set_a long, set_b long, n int, bands array<long>")


def _candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, root) of representatives that share a band bucket with another."""
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    least = buckets.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("band", "first")
    edges = buckets.join(least, "band").filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    return materialize(connected(edges, store=materialize))


def _members(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, threshold: float, block: int) -> DataFrame:
    """Shingle sets and signatures of candidates, dealt to each pair of blocks that they are compared in. A block is a
    number: its class of sizes, times CLASS, and its place in it; 0 is a whole group."""
    sizes = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.0001 / threshold))).cast("long")
    placed = groups.join(classes.select(F.col("rep").alias("node"), "copies", "set_a", "set_b", sizes.alias("class")), "node")
    known = placed.groupBy("root", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("class", "c"))).alias("sizes"), F.sum("c").alias("_n"))
    placed = join_split(placed, known, "root", groups.count(), F.col("node"))
    blocks = lambda c: F.ceil(F.coalesce(F.try_element_at("sizes", c), F.lit(0)) / F.lit(block)).cast("int")
    code = lambda c, j: c * CLASS + j
    many = F.col("_n") > block
    own = F.when(many, code(F.col("class"), F.pmod(F.xxhash64("node"), F.greatest(blocks(F.col("class")), F.lit(1))))).otherwise(F.lit(0).cast("long"))
    pair = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    each = lambda c, of: F.when(blocks(c) > 0, F.transform(F.sequence(F.lit(0), blocks(c) - 1), lambda j: of(code(c, j)))).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))
    c = F.col("class")
    meets = F.concat(each(c, lambda j: pair(F.least("own", j), F.greatest("own", j))), each(c + 1, lambda j: pair(F.col("own"), j)), each(c - 1, lambda j: pair(j, F.col("own"))))
    placed = placed.withColumn("own", own).withColumn("meets", F.when(many, meets).otherwise(F.array(pair(F.lit(0), F.lit(0)))))
    placed = placed.select(F.col("node").alias("rep"), "root", "copies", "set_a", many.alias("part"), "own", "meets")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            sets = shingles(b.column("text"), k)
            keep = [i for i, (s, x) in enumerate(zip(sets, b.column("set_a").to_pylist(), strict=True)) if len(s) and int(s.sum(dtype=np.uint64).view(np.int64)) == x]
            if keep:
                own = [sets[i] for i in keep]
                rest = b.take(pa.array(keep)).select(["rep", "root", "copies", "part", "own", "meets"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([s.tobytes() for s in own], pa.binary()), pa.array([s.tobytes() for s in signatures(own)], pa.binary())], names=["rep", "root", "copies", "part", "own", "meets", "shingles", "sig"])

    joined = docs.join(placed, F.col("doc_id") == F.col("rep")).select("rep", "root", "copies", "part", "own", "meets", "set_a", "text")
    out = joined.mapInArrow(made, "rep long, root long, copies long, part boolean, own long, meets array<struct<x:bigint,y:bigint>>, shingles binary, sig binary")
    return out.select("rep", "root", "copies", "part", "own", "shingles", "sig", F.explode("meets").alias("m")).select("rep", "root", "copies", "part", "own", "shingles", "sig", "m.x", "m.y")


def _linked(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rep, links, root, part): for each representative of each pair of blocks, how many documents it links to there,
    the least representative that its links lead to, and whether the group has more blocks."""
    least = least_matches(threshold, tolerance)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], []]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["rep", "links", "root", "part"])
            for c in cols:
                c.clear()
            return out

        for g in grouped(batches, ["root", "x", "y"]):
            seen = sorted({r: i for i, r in enumerate(g["rep"])}.values())  # repeated rows of one id and text
            reps = [g["rep"][i] for i in seen]
            copies = np.array([g["copies"][i] for i in seen], np.int64)
            own = np.array([g["own"][i] for i in seen])
            sets = [np.frombuffer(g["shingles"][i], np.uint64) for i in seen]
            sig = np.frombuffer(b"".join(g["sig"][i] for i in seen), np.uint32).reshape(len(seen), HASHES)
            if g["x"][0] == g["y"][0]:
                a, b = np.triu_indices(len(seen), 1)
            else:
                left, right = np.nonzero(own == g["x"][0])[0], np.nonzero(own == g["y"][0])[0]
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
            a, b = verified(sets, sig, a, b, threshold, least)
            links = np.bincount(a, copies[b], len(seen)) + np.bincount(b, copies[a], len(seen))
            parent = list(range(len(seen)))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                while parent[j] != j:
                    parent[j] = parent[parent[j]]
                    j = parent[j]
                if reps[i] <= reps[j]:
                    parent[j] = i
                else:
                    parent[i] = j
            for i in range(len(seen)):
                top = i
                while parent[top] != top:
                    top = parent[top]
                cols[0].append(reps[i])
                cols[1].append(int(links[i]))
                cols[2].append(reps[top])
                cols[3].append(g["part"][0])
            if len(cols[0]) > 4096:
                yield batch()
        yield batch()

    dealt = members.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "rep")
    return dealt.mapInArrow(made, "rep long, links long, root long, part boolean")


def join(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copy_id, n_links: one row for each row of docs. class_id is the least doc_id of the documents
    that links connect, copy_id that of the documents with an equal shingle set, n_links the number of other documents
    that this one is similar to."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(_sketches(docs, k))
    same = ["set_a", "set_b", "n"]
    classes = sketches.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes)
    groups = _candidate_groups(classes.filter("rep is not null"))
    linked = materialize(_linked(_members(docs, classes, groups, k, threshold, block), threshold, tolerance))
    whole = linked.filter("not part").select("rep", "root")
    parts = connected(linked.filter("part and rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), store=materialize)
    roots = whole.unionByName(parts.select(F.col("node").alias("rep"), "root"))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    about = classes.select(*same, "rep", "copies").join(links, "rep", "left").join(roots, "rep", "left")
    about = about.select(*[F.col(c).alias(f"_{c}") for c in same], "rep", "copies", "links", "root")
    out = sketches.select("doc_id", *same).join(about, (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b")) & (F.col("n") == F.col("_n")), "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
    return out.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"), n_links.alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class (the least doc_id) with all columns of docs; of repeated rows of it, one. Rows
    without doc_id can't be told apart and stay."""
    kept = join(docs, **options).filter("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept.select(F.col("doc_id").alias("_kept"), (F.col("rows") > 1).alias("_more")))
    own, columns = aside(docs, "_kept", "_more")
    chosen = own.join(kept, F.col("doc_id") == F.col("_kept"))
    out = chosen.filter("not _more").select(*columns)
    if kept.filter("_more").limit(1).count():
        out = out.unionByName(chosen.filter("_more").dropDuplicates(["doc_id"]).select(*columns))
    return out.unionByName(docs.filter("doc_id is null"))
