"""Benchmark decontamination: a prefix-filtered set join of documents against benchmark windows.

Every window of an item (10 consecutive words; a shorter item is one window) has its words ordered by rarity in the
corpus. For exact containment the necessary prefix is one word, the rarest, so a document word is looked up among
these prefix words only. A hit fixes where the window would have to start: the positional bound (it starts at 0 or
later) and the length bound (it ends within the document) come first, then the words are compared exactly.

Rarity is counted once, over RARITY buckets of word hashes: words that share a bucket only change which word of a
window is its prefix, never what is found.

Scale: documents are never shuffled. Windows are made by Spark and dealt by hash into blocks of about BLOCK_WINDOWS;
the driver holds one block at a time, and its index (about 50 MB) is what is broadcast. More blocks mean more passes
over the documents (a stated query set against all rows), united by one small aggregation that keeps repeated rows.

Words: A-Z lower-cased, then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Null or empty texts have no words.
Repeated items count once by item_id; an item_id of null is named `null`. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_words, materialize, small_batches

WINDOW = 10
#: Most windows of an index on average: a bound on what each Python worker and the driver hold.
BLOCK_WINDOWS = 100_000
RARITY = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


class Index:
    """Windows of a block of items, found by their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], count: np.ndarray, window: int):
        often = lambda w: count[xxhash.xxh64_intdigest(w) % RARITY]
        self.items: dict[tuple, set[str]] = defaultdict(set)
        prefix: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for item, ws in items:
            for at in range(max(1, len(ws) - window + 1)) if ws else ():
                w = tuple(ws[at : at + window])
                self.items[w].add(item)
                rarest = min(range(len(w)), key=lambda i: (often(w[i]), w[i], i))
                prefix[w[rarest]].add((rarest, len(w)))
        self.prefix = {w: sorted(x) for w, x in prefix.items()}

    def find(self, ws: list[bytes]) -> tuple[list[int], list[str]]:
        """The positions of words in any window's occurrence, and the items that have such windows."""
        get, hit, items, n = self.prefix.get, set(), set(), len(ws)
        for p, places in [(p, x) for p, x in enumerate(map(get, ws)) if x]:
            for offset, length in places:
                start = p - offset
                if start < 0 or start + length > n:
                    continue
                if found := self.items.get(tuple(ws[start : start + length])):
                    items |= found
                    hit.update(range(start, start + length))
        return sorted(hit), sorted(items)


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win): the distinct windows of each item, words joined by one space."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            ids, wins = [], []
            for item, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = words(t)
                for at in range(max(1, len(ws) - window + 1)) if ws else ():
                    ids.append(item)
                    wins.append(b" ".join(ws[at : at + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], names=["item_id", "win"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(made, "item_id string, win binary").distinct()


def _blocks(benchmark: DataFrame, block_windows: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item, words of a window) in blocks that Spark deals; the driver collects one block at a time."""
    windows = materialize(_windows(benchmark, window))
    blocks = max(1, -(-windows.count() // block_windows))
    for i in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("item_id", "win"), F.lit(blocks)) == i).collect()
        yield [(r["item_id"], bytes(r["win"]).split()) for r in rows]


def _plain(texts: pa.Array) -> pa.Array:
    """binary texts with A-Z lower-cased and a space for every other ASCII byte that is no letter or digit."""
    if texts.offset or len(texts.buffers()) != 3:
        texts = pa.concat_arrays([texts, texts[:0]]) if len(texts) else pa.array([], pa.binary())
    flat, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(_LOWER)) if data else data
    return pa.Array.from_buffers(pa.string(), len(texts), [flat, offsets, data], offset=texts.offset)


def rarity(docs: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur in all documents. Counts are summed in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, np.int64)
        for b in small_batches(batches):
            known, at, _ = coded_words(_plain(b.column(0)))
            total += np.bincount((known % np.uint64(RARITY)).astype(np.int64)[at], minlength=RARITY)
        full = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(RARITY, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most RARITY rows
        out[r["bucket"]] = r["n"]
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, hits (positions of hit words), items (sorted ids): one row for each row of docs."""
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, text_hash long, hits array<int>, items array<string>"
    found, counts = [], rarity(docs)
    for block in _blocks(benchmark, block_windows, window):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, counts, window))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in small_batches(batches):
                n, hits, items = [], [], []
                for t in b.column("text").to_pylist():
                    ws = words(t)
                    h, i = index.find(ws)
                    n.append(len(ws))
                    hits.append(h)
                    items.append(i)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), b.column("text_hash"), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "text_hash", "hits", "items"])

        found.append(slim.withColumn("text_hash", F.xxhash64("text")).mapInArrow(match, schema))
    if len(found) == 1:
        return found[0].drop("text_hash")
    rows = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_hash", "n_words")
    rows = rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / len(found)).cast("int").alias("copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))  # each block has every row once
    return rows.withColumn("_", copy).drop("text_hash", "copies", "_")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs. No shuffle; each block after the
    first reads what the one before it left."""
    counts = rarity(docs)
    for i, block in enumerate(_blocks(benchmark, block_windows, window)):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, counts, window))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches):
                texts = b.column("text").cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([not shared.value.find(words(t))[0] for t in texts], pa.bool_()))

        docs = (materialize(docs) if i else docs).mapInArrow(keep, docs.schema)
    return docs
