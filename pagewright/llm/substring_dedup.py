"""Substring dedup: words go where a window of 13 words also starts in a document with a smaller id.

1. Anchors. The anchor of a window is the least hash among its word 5-grams, so equal windows have equal anchors
   wherever they stand. Neighbouring windows mostly share one, hence about a fifth as many anchors as words. Anchors
   that one document alone has are dropped: their windows can't occur twice.
2. Segments. Windows in a row with the same anchor form a segment of at most 21 words. Equal segments are collapsed
   to one with the smallest doc_id, before and after the exchange.
3. Reference shards. Each anchor's distinct segments are one shard. They are streamed, smallest doc_id first, through
   a suffix automaton whose states know the first document that has their strings; the state that matches the last 13
   words tells each window's owner.
   Anchors that occur more than SHARD times make no shard: their windows are rows, and the owner of a window is the
   least doc_id of its hash, so an automaton never holds more than SHARD segments.
4. Owners go back to the segments' occurrences; words covered by windows that a smaller document owns are removed.

A corpus that is its own reference can't be broadcast, so the automata are dealt by anchor: each is built where its
segments meet, and what is broadcast is nothing. Hot passages: their equal segments are collapsed in each task before
they are shuffled; joins on anchors and segments have rows of few bytes and can be split by adaptive execution.

Null texts and texts of fewer than 13 words lose nothing. Rows with equal doc_id don't remove each other's words. A
row with null doc_id neither loses words nor takes any. Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, grouped, hashed_words, materialize, mixed, small_batches

WINDOW = 13
ANCHOR = 5
#: Most occurrences of an anchor whose segments go through an automaton.
SHARD = 1_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def anchors(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window of word hashes, its least k-gram hash."""
    g = gram_hashes(h, k)
    n = max(0, len(h) - window + 1)
    least = g[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, g[j : j + n], out=least)
    return least


def anchor_places(h: np.ndarray, least: np.ndarray, window: int, k: int) -> np.ndarray:
    """Where each window's anchor stands (the leftmost of equal ones)."""
    g, at = gram_hashes(h, k), np.arange(len(least))
    for j in range(window - k, -1, -1):
        np.copyto(at, np.arange(j, j + len(least)), where=g[j : j + len(least)] == least)
    return at


def whole_windows(counts: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the n windows over texts laid end to end: the text that each starts in, and whether it ends there too."""
    doc = np.repeat(np.arange(len(counts)), counts)[:n]
    return doc, np.arange(n) + window <= np.cumsum(counts)[doc]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, base)]))
    return _POWERS


def segments(h: np.ndarray, counts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, number of windows, hash of the segment's words) of each run of windows with one
    anchor, over texts laid end to end."""
    least = anchors(h, window, k)
    doc, whole = whole_windows(counts, len(least), window)
    at = anchor_places(h, least, window, k)
    own = np.nonzero(whole)[0]
    if not len(own):
        return own, least[:0], own, own, least[:0]
    new = np.concatenate([[True], (at[own[1:]] != at[own[:-1]]) | (doc[own[1:]] != doc[own[:-1]])])
    first = np.nonzero(new)[0]
    starts, sizes = own[first], np.diff(np.append(first, len(own)))
    power, inverse = _powers(len(h))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
    digest = (prefix[starts + sizes + window - 1] - prefix[starts]) * inverse[starts]
    return doc[starts], least[starts], starts, sizes, mixed(digest + sizes.astype(np.uint64))


class Automaton:
    """A suffix automaton of segments that are added in ascending order of their owners. Each state has the first
    owner of its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, owner: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.owner.append(owner)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: bytes) -> int:
        """The state of the strings of q that end a move from p by c; cut off from q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.owner[q], dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: bytes, owner: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1, owner, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def add(self, words: list, owner: int, window: int) -> list[int]:
        """The first owner of each window of the words."""
        last, out = 0, []
        for i, c in enumerate(words):
            last = self._extend(last, c, owner)
            if i >= window - 1:
                s = last
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                out.append(self.owner[s])
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _anchor_rows(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, doc_id), distinct within a row of docs."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            h, counts = hashed_words(b.column("text"))
            least = anchors(h, window, k)
            doc, whole = whole_windows(counts, len(least), window)
            doc, least = doc[whole], least[whole]
            order = np.lexsort((least, doc))
            doc, least = doc[order], least[order]
            new = np.nonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))[0] if len(doc) else order
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[doc[new]], pa.int64())], names=["anchor", "doc_id"])

    return docs.mapInArrow(made, "anchor long, doc_id long")


def _occurrences(docs: DataFrame, wanted: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, text_key, pos, anchor, segment, words): the segments of each document whose anchors are wanted of it."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            h, counts = hashed_words(b.column("text"))
            doc, least, starts, sizes, digest = segments(h, counts, window, k)
            # what one document shares, all that have it share
            keep = np.isin(least.view(np.int64), np.unique(b.column("anchors").flatten().to_numpy()))
            doc, least, starts, sizes, digest = doc[keep], least[keep], starts[keep], sizes[keep], digest[keep]
            begins, words = np.cumsum(counts) - counts, []
            rows, at = np.unique(doc, return_index=True)
            for row, x, y in zip(rows.tolist(), at.tolist(), [*at[1:].tolist(), len(doc)], strict=True):
                ws = b.column("text")[row].as_py().encode().split()
                places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)])
                line, own = b" ".join(ws), starts[x:y] - begins[row]
                words += [line[i:j] for i, j in zip(places[own].tolist(), (places[own + sizes[x:y] + window - 1] - 1).tolist(), strict=True)]
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "text_key"))
            cols = (ids, keys, starts - begins[doc], least.view(np.int64), digest.view(np.int64), words)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "text_key", "pos", "anchor", "segment", "words"])

    return docs.join(wanted, "doc_id").select("doc_id", F.xxhash64("text").alias("text_key"), "text", "anchors").mapInArrow(made, "doc_id long, text_key long, pos int, anchor long, segment long, words binary")


def _owners(distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, owners): the first document of each window of each distinct segment."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], []]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["anchor", "segment", "owners"])
            for c in cols:
                c.clear()
            return out

        for g in grouped(batches, ["anchor"]):
            automaton = Automaton() if len(g["segment"]) > 1 else None
            for s, lo, text in zip(g["segment"], g["lo"], g["words"], strict=True):
                ws = text.split()
                cols[0].append(g["anchor"][0])
                cols[1].append(s)
                cols[2].append(automaton.add(ws, lo, window) if automaton else [lo] * (len(ws) - window + 1))
            if len(cols[0]) > 4096:
                yield batch()
        yield batch()

    dealt = distinct.repartition("anchor").sortWithinPartitions("anchor", "lo", "segment")
    return dealt.mapInArrow(made, "anchor long, segment long, owners array<long>")


def _distinct(found: DataFrame) -> DataFrame:
    return found.groupBy("anchor", "segment").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("words").alias("words"))


def _window_rows(distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, lo, i, win): each window of the segments, by its hash."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            row, at, win = [], [], []
            for r, text in enumerate(b.column("words").to_pylist()):
                ws = text.split()
                n = len(ws) - window + 1
                row += [r] * n
                at += range(n)
                win += [xxhash.xxh64_intdigest(b" ".join(ws[i : i + window])) for i in range(n)]
            row = np.array(row, np.int64)
            own = [pa.array(b.column(c).to_numpy(zero_copy_only=False)[row], pa.int64()) for c in ("anchor", "segment", "lo")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(np.array(win, np.uint64).view(np.int64))], names=["anchor", "segment", "lo", "i", "win"])

    return distinct.select("anchor", "segment", "lo", "words").mapInArrow(made, "anchor long, segment long, lo long, i int, win long")


def _owners_by_window(windows: DataFrame) -> DataFrame:
    """As _owners, from written window rows: nothing is gathered but the few windows of a segment."""
    first = windows.groupBy("win").agg(F.min("lo").alias("owner"))
    each = windows.join(first, "win").groupBy("anchor", "segment")
    return each.agg(F.array_sort(F.collect_list(F.struct("i", "owner"))).alias("x")).select("anchor", "segment", F.col("x.owner").alias("owners"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """(doc_id, text_key, starts): the windows of each document that also start in a document with a smaller id."""
    docs = _texts(docs).filter("doc_id is not null")
    rows = materialize(_anchor_rows(docs, window, k))
    shared = materialize(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    wanted = materialize(rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    discard(rows, shared)
    found = materialize(_occurrences(docs, wanted, window, k))
    discard(wanted)
    often = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard).select("anchor"))
    windows = materialize(_window_rows(_distinct(found.join(often, "anchor", "left_semi")), window))
    both = _owners(_distinct(found.join(often, "anchor", "left_anti")), window).unionByName(_owners_by_window(windows))
    owners = materialize(both.withColumnsRenamed({"anchor": "a", "segment": "s"}))
    del both
    discard(often, windows)
    own = found.select("doc_id", "text_key", "pos", "anchor", "segment").join(owners, (F.col("anchor") == F.col("a")) & (F.col("segment") == F.col("s")))
    own = own.filter(F.exists("owners", lambda x: x < F.col("doc_id")))
    starts = F.filter(F.transform("owners", lambda x, i: F.when(x < F.col("doc_id"), i + F.col("pos"))), lambda x: x.isNotNull())
    spans = materialize(own.select("doc_id", "text_key", starts.alias("starts")).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    del own
    discard(found, owners)
    return spans


def dedup(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): one row for each row of docs."""
    spans = repeated_windows(docs, window, k, shard)
    both = _texts(docs).alias("d").join(spans.alias("s"), (F.col("d.doc_id") == F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.text_key")), "left").select("d.doc_id", "d.text", "s.starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            n, removed, kept = [], [], []
            for t, starts in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("starts").to_pylist(), strict=True):
                ws = t.split() if t else []
                n.append(len(ws))
                if starts:
                    edges = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, np.array(starts) + window, -1)
                    stay = np.nonzero(np.cumsum(edges[:-1]) == 0)[0]
                    ws = [ws[i] for i in stay.tolist()]
                removed.append(n[-1] - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
