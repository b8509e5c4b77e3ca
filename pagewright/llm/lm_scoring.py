"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are words (A-Z lower-cased) and one end for each text. Each token before (the end stands before the first) is a
context with a restaurant of its own; all contexts share one parent, the root restaurant, to which every table of a
context sends a customer and whose base is uniform over the training vocabulary and one unknown word. Seats are sampled
in the Chinese-restaurant way by blocked Gibbs sweeps: root, then SWEEPS of all contexts given the root (a sweep seats
the customers of each pair anew, given its context's tables of the sweep before), then the root again given the tables
of the last sweep. Predictive probabilities are averaged over the sweeps after burn-in; their log10 add up to scores
and perplexities. The discounts of contexts and root are estimated from how many pairs and words have one and two
customers.

The first EXACT customers of a pair draw one by one whether they open a table; those after them draw in blocks of a
sixteenth of those seated, by a binomial with the probability at the block's start.

Scale: pairs are dealt into shards of about SHARD_TOKENS tokens by context. A task sums the pairs of its batch, and
what is shuffled is one packed, compressed row of each batch for each shard, so neither tokens nor pairs are Spark
rows. A shard has its contexts whole, so seats need no other shard; contexts that a sample of texts finds often are
spread over several shards by word; after each sweep Spark sums their tables over the shards, one small row from each,
and the next sweep starts from the sum, as it does for a context that is whole in its shard. Words
are dealt into shards of their own, which get each context shard's part of their counts and answer with probabilities;
those of the HEAVY_WORDS most frequent are broadcast instead. Pairs that occur once, in training texts only, are
not stored: a pair of a text that is not found is one of these. Draws depend on shard and seed alone and packed rows
are merged in sorted order, so lost executors change nothing. Words are known by 64 bits of their hash, pairs by 64.
Counts and probabilities cover all training texts, and what is gathered grows with them.

Null texts are empty (one end token); a null doc_id counts as the empty text for the split. Rows that agree in doc_id
and text score alike, as often as they come. Without training texts every word is unknown and N is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded_words, discard, materialize, mixed, small_batches, trim

#: Tokens of a shard, about; characters of a token, for the number of shards; most bits of that number.
SHARD_TOKENS, TOKEN_CHARS, MOST_BITS = 3_000_000, 6, 22
#: Texts that are sampled to find frequent contexts. They decide where pairs are kept, not what is counted.
HOT_SAMPLE = 4_000
HEAVY_WORDS = 500_000
SWEEPS, BURN_IN, EXACT = 4, 1, 64
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
SEED = 11
#: Rows of packed arrays: kind, the shard they go to, the shard they come from. Shards read them in order of kind.
PACKED = "kind int, shard int, source int, payload binary"
CONTEXTS, PAIRS, WORDS, ANSWERS, MORE, QUERIES, APART = 0, 1, 2, 3, 4, 5, 6
CHUNK = 250_000
#: No word has a space, so no word has this hash.
END = np.uint64(xxhash.xxh64_intdigest(" end"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, sorted; the place of each token among them; tokens of each text). The token before
    the first is the last one, an end."""
    known, at, counts = coded_words(texts, lower=True)
    distinct, code = _distinct(np.append(known, END))
    n = counts + 1
    place = np.full(len(at) + len(counts), code[-1], np.int64)
    inner = np.ones(len(place), bool)
    inner[np.cumsum(n) - 1] = False
    place[inner] = code[at]
    return distinct, place, n


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values, sorted; the place of each value among them)."""
    order = np.argsort(h)
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    code = np.empty(len(h), np.int64)
    code[order] = np.cumsum(new) - 1
    return h[order[new]], code


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) + word)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    sizes, at = np.frombuffer(raw, np.uint32, len(kinds.split())), 4 * len(kinds.split())
    for kind, n in zip(kinds.split(), sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "shard", "source", "payload"])


@dataclass
class Shards:
    """Where pairs and words are kept: 2**bits shards by context, frequent contexts over the next few, by word."""

    bits: int
    hot: np.ndarray
    spread: np.ndarray

    @property
    def count(self) -> int:
        return 1 << self.bits

    def of_words(self, word: np.ndarray) -> np.ndarray:
        return (mixed(word ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.count)).astype(np.int32)

    def of_pairs(self, contexts: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shards of pairs, whose contexts are contexts[context]. What depends on the context alone is found once for
        each of them."""
        home = (mixed(contexts) % np.uint64(self.count))[context]
        if len(self.hot):
            slot, hot = looked_up(self.hot, contexts)
            own = np.nonzero(hot[context])[0]
            of = context[own]
            home[own] = (home[own] + (pair_keys(contexts[of], word[own]) >> np.uint64(20)) % self.spread[slot[of]]) % np.uint64(self.count)
        return home.astype(np.int32)


def plan(docs: DataFrame) -> Shards:
    """The shards for docs (text)."""
    rows, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bits = min(MOST_BITS, max(0, int(np.ceil(np.log2(max(1.0, chars / TOKEN_CHARS / SHARD_TOKENS))))))
    none = np.empty(0, np.uint64)
    if not bits:
        return Shards(0, none, none)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            u, place, _ = tokens(b.column(0))  # each token is a context once
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(place, minlength=len(u)))], names=["u", "c"])

    some = docs.select("text").sample(fraction=min(1.0, HOT_SAMPLE / max(1, rows)), seed=SEED)
    found = materialize(some.mapInArrow(made, "u long, c long").groupBy("u").agg(F.sum("c").alias("c")))
    total = found.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = found.filter(F.col("c") * 4 * (1 << bits) > total).orderBy("u").collect()  # at most four for each shard
    discard(found)
    u = np.array([r["u"] for r in hot], np.int64).view(np.uint64)
    spread = np.array([min(1 << bits, -(-4 * r["c"] * (1 << bits) // total)) for r in hot], np.uint64)
    order = np.argsort(u)
    return Shards(bits, u[order], spread[order])


def seat(n: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of n customers of each dish: after k customers the next one opens a table with probability
    new / (new + k - discount * tables)."""
    t = np.minimum(n, 1).astype(np.float64)
    at, k = np.nonzero(n > 1)[0], 1
    while len(at):
        p = new[at] / (new[at] + k - discount * t[at])
        block = 1 if k < EXACT else k // 16
        t[at] += rng.random(len(at)) < p if block == 1 else rng.binomial(np.minimum(block, n[at] - k), p)
        k += block
        at = at[n[at] > k]
    return t


def share(one: int, two: int) -> float:
    """A discount from the numbers of dishes with one and two customers."""
    return float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95))


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys, sorted, and the sums of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, np.int64)
    return [keys[starts], *[np.add.reduceat(v[order], starts) if len(keys) else v for v in values]]


def looked_up(keys: np.ndarray, wanted: np.ndarray, sort: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(places of wanted among sorted keys, whether they are there). With sort, they are searched in their own
    order, so that neighbours read the same memory."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    if sort:
        order, at = np.argsort(wanted), np.empty(len(wanted), np.int64)
        at[order] = np.searchsorted(keys, wanted[order])
    else:
        at = np.searchsorted(keys, wanted)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted


def by_shard(rows: DataFrame, n: int, make: Callable[[int, Iterator[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """make(shard, its (kind, source, payload) in order) for each shard that has rows. A task streams its shards."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[int, int, int, bytes]]:
            for b in small_batches(batches, 64):
                yield from zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "source", "payload")), strict=True)

        rest = flat()
        row = next(rest, None)
        while row is not None:
            shard = row[0]

            def own(shard=shard) -> Iterator[tuple[int, int, bytes]]:
                nonlocal row
                while row is not None and row[0] == shard:
                    yield row[1:]
                    row = next(rest, None)

            mine = own()
            yield from make(shard, mine)
            for _ in mine:  # what make left
                pass
        trim()

    dealt = rows.repartitionById(min(n, 20_000), "shard").sortWithinPartitions("shard", "kind", "source", "payload")
    return dealt.mapInArrow(made, schema)


# counting


def _batch_pairs(text: pa.Array, shards: Shards) -> tuple:
    """Tokens of a batch and its distinct pairs, sorted by shard, context and word: (pair of each token, tokens of each
    text, shard of each pair, distinct tokens, and the places of each pair's context and word among them)."""
    distinct, word, n = tokens(text)
    before = np.concatenate([word[-1:], word[:-1]])
    pair, both = pd.factorize(before * len(distinct) + word)  # by hashing; a sort of all tokens takes several times as long
    u, w = np.divmod(both, len(distinct))
    own = shards.of_pairs(distinct, u, distinct[w])
    place = np.argsort(both)
    place = place[_by_shard(own[place], shards)]
    back = np.empty(len(place), np.int64)
    back[place] = np.arange(len(place))
    return back[pair], n, own[place], distinct, u[place], w[place]


def _by_shard(of: np.ndarray, shards: Shards) -> np.ndarray:
    """The stable order of shards, by a radix sort up to 16 bits."""
    return np.argsort(of.astype(np.uint16) if shards.bits <= 16 else of, kind="stable")


def _runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours as (value, number)."""
    starts = np.nonzero(np.concatenate([[True], u[1:] != u[:-1]]))[0] if len(u) else np.empty(0, np.int64)
    return u[starts], np.diff(np.append(starts, len(u))).astype(np.uint32)


def _parts(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    value, n = _runs(of)
    ends = np.cumsum(n)
    yield from zip(value.tolist(), (ends - n).tolist(), ends.tolist(), strict=True)


def batch_counts(docs: DataFrame, shards: Shards) -> DataFrame:
    """The pairs of docs (text, learn) by batch and shard: context, word, how often in training texts, and whether in
    others."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 8_192):
            pair, n, own, distinct, u, w = _batch_pairs(b.column("text"), shards)
            u, w = distinct[u], distinct[w]
            learnt = np.repeat(b.column("learn").to_numpy(zero_copy_only=False), n)
            c = np.bincount(pair[learnt], minlength=len(u)).astype(np.uint32)
            held = (np.bincount(pair[~learnt], minlength=len(u)) > 0).astype(np.uint8)
            yield packed_rows([(PAIRS, s, 0, pack(*_runs(u[i:j]), w[i:j], c[i:j], held[i:j])) for s, i, j in _parts(own)])

    return docs.select("text", "learn").mapInArrow(made, PACKED)


class _Merge:
    """Distinct pairs of a shard; what came is merged when it is as much as what is held."""

    def __init__(self) -> None:
        self.done = [np.empty(0, k) for k in ("u8", "u8", "u8", "i8", "?")]  # key, context, word, count, held
        self.new: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, payload: bytes) -> None:
        u, n, w, c, held = unpack(payload, "u8 u4 u8 u4 u1")
        u = np.repeat(u, n)
        self.new.append([pair_keys(u, w), u, w, c, held.view(bool)])
        self.size += len(w)
        if self.size > max(500_000, len(self.done[0])):
            self.merge()

    def merge(self) -> list[np.ndarray]:
        key, u, w, c, held = (np.concatenate(x) for x in zip(self.done, *self.new, strict=True))
        self.done, self.new, self.size = [], [], 0
        order = np.argsort(key)
        starts = np.nonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))[0] if len(key) else np.empty(0, np.int64)
        first = order[starts]
        total = np.add.reduceat(c[order].astype(np.int64), starts) if len(starts) else c.astype(np.int64)
        any_held = np.logical_or.reduceat(held[order], starts) if len(starts) else held
        self.done = [key[first], u[first], w[first], total, any_held]
        return self.done


def merged(batches: DataFrame, shards: Shards) -> DataFrame:
    """Packed rows: CONTEXTS (context, customers, pairs), PAIRS that are stored (context, word, count) and, for the
    shards of words, WORDS (word, count, contexts)."""
    def make(shard: int, rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        whole = _Merge()
        for _, _, payload in rows:
            whole.add(payload)
        _, u, w, c, held = whole.merge()
        del whole
        learnt = c > 0
        words = summed(w, c, learnt.astype(np.int64))
        place = np.argsort(shards.of_words(words[0]), kind="stable")
        words = [x[place] for x in words]
        out = [(WORDS, s, shard, pack(words[0][i:j], words[1][i:j], words[2][i:j])) for s, i, j in _parts(shards.of_words(words[0]))]
        del words, place
        out.append((CONTEXTS, shard, 0, pack(*summed(u[learnt], c[learnt], learnt[learnt].astype(np.int64)))))
        yield packed_rows(out)
        ones, twos = int((c == 1).sum()), int((c == 2).sum())
        keep = np.nonzero((c > 1) | held)[0]
        keep = keep[np.lexsort((w[keep], u[keep]))]
        u, w, c = u[keep], w[keep], c[keep]
        for i in range(0, max(1, len(u)), CHUNK):
            part = slice(i, i + CHUNK)
            stat = np.array([ones, twos] if not i else [0, 0], np.int64)
            yield packed_rows([(PAIRS, shard, i // CHUNK, pack(stat, *_runs(u[part]), w[part], c[part]))])

    return by_shard(batches, shards.count, make, PACKED)


_PAIR_KINDS = "i8 u8 u4 u8 i8"


def _sums(rows: DataFrame, of: Callable[[int, bytes], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(kind, payload), arrays of `size` numbers, over packed rows: in each task, then in Spark."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in small_batches(batches, 64):
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                total += of(kind, payload)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "x"])

    out = np.zeros(size)
    for r in rows.select("kind", "payload").mapInArrow(made, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


# the root restaurant


@dataclass
class Root:
    """Totals of words: n (training tokens), v (distinct), customers and tables of the root, and the least count of
    words that are broadcast."""

    n: int
    v: int
    customers: float
    discount: float
    least: int
    tables: float = 0.0
    round: int = 0

    @property
    def new(self) -> float:
        """The weight of a new table with one of the words, or with the unknown one."""
        return (ROOT_STRENGTH + self.discount * self.tables) / (self.v + 1)

    def p(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.new) / (ROOT_STRENGTH + self.customers)

    def seated(self, shard: int, customers: np.ndarray, tables: float) -> np.ndarray:
        before = Root(self.n, self.v, self.customers, self.discount, self.least, tables)
        return seat(customers, np.full(len(customers), before.new), self.discount, np.random.default_rng([SEED, 1, self.round, shard]))


_LEVELS = 96


def _level(c: np.ndarray) -> np.ndarray:
    """Counts by size, in halves of powers of two."""
    return np.minimum(np.floor(2 * np.log2(np.maximum(c, 1))), _LEVELS - 1).astype(np.int64)


def words_of(parts: DataFrame, shards: Shards) -> DataFrame:
    """The words of each word shard (word, count, customers), from parts WORDS (word, count, contexts) and MORE (word, 0,
    tables beyond the first)."""
    def make(shard: int, rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*(unpack(p, "u8 i8 i8") for _, _, p in rows), strict=True)]
        yield packed_rows([(WORDS, shard, -1, pack(*summed(*cols)))])

    return materialize(by_shard(parts, shards.count, make, PACKED))


def fit_root(words: DataFrame, heavy: int, round_no: int) -> Root:
    def basics(_: int, payload: bytes) -> np.ndarray:
        _, c, k = unpack(payload, "u8 i8 i8")
        head = [c.sum(), (c > 0).sum(), k.sum(), (k == 1).sum(), (k == 2).sum()]
        return np.concatenate([head, np.bincount(_level(c[c > 0]), minlength=_LEVELS)])

    x = _sums(words, basics, 5 + _LEVELS)
    above = np.cumsum(x[5:][::-1])[::-1]  # words of a level or a higher one
    level = int((above > heavy).sum())
    least = int(np.ceil(2 ** (level / 2))) if level else 1
    root = Root(int(x[0]), int(x[1]), float(x[2]), share(x[3], x[4]), least, round=round_no)

    def after(_: int, payload: bytes) -> np.ndarray:
        w, _, k = unpack(payload, "u8 i8 i8")
        return np.array([root.seated(int(w[0] >> np.uint64(33)) if len(w) else 0, k, float(root.v)).sum()])

    root.tables = float(_sums(words, after, 1)[0])
    return root


def answered(words: DataFrame, parts: DataFrame, root: Root, shards: Shards) -> DataFrame:
    """Packed rows (word, count, probability): ANSWERS to each context shard that has a word that is not broadcast, and
    WORDS, those that are."""
    def make(shard: int, rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        w = c = k = p = None
        for _, source, payload in rows:
            if source < 0:
                w, c, k = unpack(payload, "u8 i8 i8")
                p = root.p(k, root.seated(int(w[0] >> np.uint64(33)) if len(w) else 0, k, float(root.v)))
                big = c >= root.least
                yield packed_rows([(WORDS, -1, 0, pack(w[big], c[big], p[big]))])
            else:
                own, *_ = unpack(payload, "u8 i8 i8")
                at, _ = looked_up(w, own)
                at = at[c[at] < root.least]
                yield packed_rows([(ANSWERS, source, shard, pack(w[at], c[at], p[at]))])

    return materialize(by_shard(words.unionByName(parts.filter(F.col("kind") == WORDS)), shards.count, make, PACKED))


@dataclass
class Frequent:
    """The words that are broadcast: hashes, counts, probabilities."""

    word: np.ndarray
    c: np.ndarray
    p: np.ndarray

    @classmethod
    def collected(cls, answers: DataFrame) -> Frequent:
        """At most HEAVY_WORDS words come to the driver."""
        cols = [unpack(bytes(r["payload"]), "u8 i8 f8") for r in answers.filter(F.col("kind") == WORDS).collect()]
        w, c, p = (np.concatenate(x) for x in zip([np.empty(0, k) for k in ("u8", "i8", "f8")], *cols, strict=True))
        order = np.argsort(w)
        return cls(w[order], c[order], p[order])


class Answers:
    """What a context shard knows of words."""

    def __init__(self, frequent: Frequent):
        self.frequent, self.parts = frequent, [[np.empty(0, k)] for k in ("u8", "i8", "f8")]
        self.word = self.c = self.p = np.empty(0)

    def add(self, payload: bytes) -> None:
        for part, x in zip(self.parts, unpack(payload, "u8 i8 f8"), strict=True):
            part.append(x)

    def sort(self) -> None:
        w, c, p = (np.concatenate(x) for x in self.parts)
        order = np.argsort(w)
        self.word, self.c, self.p, self.parts = w[order], c[order], p[order], []

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and probabilities of words that the shard has."""
        c, p = np.zeros(len(words), np.int64), np.zeros(len(words))
        for w, wc, wp in ((self.frequent.word, self.frequent.c, self.frequent.p), (self.word, self.c, self.p)):
            at, there = looked_up(w, words)
            c[there], p[there] = wc[at[there]], wp[at[there]]
        return c, p


# the restaurants of contexts


@dataclass
class Hot:
    """Totals of contexts that are spread over shards, summed by Spark: context, customers, tables."""

    u: np.ndarray
    customers: np.ndarray
    tables: np.ndarray

    @classmethod
    def collected(cls, contexts: DataFrame, shards: Shards) -> Hot:
        hot = shards.hot

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, 64):
                for payload in b.column("payload").to_pylist():
                    u, c, t = unpack(payload, "u8 i8 f8")
                    own = np.nonzero(np.isin(u, hot))[0]
                    yield pa.RecordBatch.from_arrays([pa.array(u[own].view(np.int64)), pa.array(c[own]), pa.array(t[own])], names=["u", "c", "t"])

        if not len(hot):
            return cls(hot, np.empty(0, np.int64), np.empty(0))
        rows = contexts.filter(F.col("kind") == CONTEXTS).select("payload").mapInArrow(made, "u long, c long, t double")
        rows = rows.groupBy("u").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()  # at most four for each shard
        u = np.array([r["u"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(u)
        return cls(u[order], np.array([r["c"] for r in rows], np.int64)[order], np.array([r["t"] for r in rows], np.float64)[order])

    def over(self, u: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables of contexts u, with the totals where they are spread, and where they are."""
        at, there = looked_up(self.u, u)
        c, t = c.astype(np.int64), t.astype(np.float64)
        c[there], t[there] = self.customers[at[there]], self.tables[at[there]]
        return c, t, there


def _with_tables(u: np.ndarray, n: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray) -> bytes:
    """PAIRS of seats: key, count, mean tables."""
    key = pair_keys(np.repeat(u, n), w)
    order = np.argsort(key)
    return pack(key[order], c[order], t[order].astype(np.float32))


def _more_tables(w: np.ndarray, t: np.ndarray, shard: int, shards: Shards) -> list[tuple]:
    """MORE rows: tables beyond the first, by word."""
    more = np.nonzero(t > 1)[0]
    words, extra = summed(w[more], (t[more] - 1).astype(np.int64))
    place = np.argsort(shards.of_words(words), kind="stable")
    words, extra = words[place], extra[place]
    return [(MORE, s, shard, pack(words[i:j], np.zeros(j - i, np.int64), extra[i:j])) for s, i, j in _parts(shards.of_words(words))]


def sampled(found: DataFrame, answers: DataFrame, frequent: Frequent, hot: Hot, discount: float, shards: Shards, sweeps: int, burn_in: int) -> DataFrame:
    """Packed rows after the sweeps: CONTEXTS (context, customers, mean tables), PAIRS (key, count, mean tables) and, for
    the shards of words, MORE (word, 0, tables beyond the first). Of contexts that are spread over shards, APART
    (shard and chunk, context, word, count, root probability of pairs with several customers) instead, for `sampled_apart`,
    and CONTEXTS with a table for each pair."""
    shared = found.sparkSession.sparkContext.broadcast(frequent)

    def make(shard: int, rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        known, chunks, u, customers, d = Answers(shared.value), [], *[np.empty(0, np.int64)] * 3
        for kind, _, payload in rows:
            if kind == CONTEXTS:
                u, customers, d = unpack(payload, "u8 i8 i8")
            elif kind == PAIRS:
                chunks.append(payload)
            elif kind == ANSWERS:
                known.add(payload)
        known.sort()
        spread = np.isin(u, hot.u)
        tables, mean, n_mean = d.astype(np.float64), np.where(spread, d, 0.0), sweeps - burn_in
        context, w, c, p = [], [], [], []
        for i, payload in enumerate(chunks):
            _, uu, n, ww, cc = unpack(payload, _PAIR_KINDS)
            apart = np.repeat(np.isin(uu, hot.u), n)
            if apart.any():
                own, of = np.isin(uu, hot.u), cc[apart] > 1
                yield packed_rows([(APART, shard, i, pack(np.array([shard, i]), uu[own], n[own], ww[apart], cc[apart], known.of(ww[apart][of])[1].astype(np.float32)))])
            multi = (cc > 1) & ~apart
            context.append(np.repeat(looked_up(u, uu)[0], n)[multi])
            w.append(ww[multi])
            c.append(cc[multi])
            p.append(known.of(w[-1])[1])
        context, w, c, p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (context, w, c, p))
        rng, t_mean, t = np.random.default_rng([SEED, 2, shard]), np.zeros(len(c)), np.ones(len(c))
        for sweep in range(sweeps):
            t = seat(c, (STRENGTH + discount * tables[context]) * p, discount, rng)
            tables = d + np.bincount(context, t - 1, len(u))
            if sweep >= burn_in:
                t_mean += t / n_mean
                mean += np.where(spread, 0.0, tables / n_mean)
        yield packed_rows([(CONTEXTS, shard, 0, pack(u, customers, mean))])
        done = 0
        for i, payload in enumerate(chunks):
            _, uu, n, ww, cc = unpack(payload, _PAIR_KINDS)
            own = ~np.isin(uu, hot.u)
            here = np.repeat(own, n)
            cc = cc[here]
            tt, multi = np.minimum(cc, 1).astype(np.float64), np.nonzero(cc > 1)[0]
            tt[multi] = t_mean[done : done + len(multi)]
            done += len(multi)
            yield packed_rows([(PAIRS, shard, i, _with_tables(uu[own], n[own], ww[here], cc, tt))])
        yield packed_rows(_more_tables(w, t, shard, shards))

    parts = found.filter(F.col("kind").isin(CONTEXTS, PAIRS)).unionByName(answers.filter(F.col("kind") == ANSWERS))
    return materialize(by_shard(parts, shards.count, make, PACKED))


def sampled_apart(seats: DataFrame, hot: Hot, discount: float, shards: Shards, sweeps: int, burn_in: int) -> DataFrame | None:
    """The same rows for contexts that are spread over shards, from APART. A sweep draws where the pairs are, and its
    tables are summed before the next one, so what is drawn depends on the totals just as in a context of one shard.
    Draws depend on shard, chunk and sweep alone; the last pass draws all sweeps again rather than storing them."""
    if not len(hot.u):
        return None
    apart, totals = seats.filter(F.col("kind") == APART), [hot.tables]

    def drawn(payload: bytes, sweep: int) -> tuple[np.ndarray, ...]:
        at, u, n, w, c, p = unpack(payload, "i8 u8 u4 u8 i8 f4")
        context, multi = np.repeat(looked_up(hot.u, u)[0], n), c > 1
        rng = np.random.default_rng([SEED, 3, int(at[0]), int(at[1]), sweep])
        t = np.ones(len(c))
        t[multi] = seat(c[multi], (STRENGTH + discount * totals[sweep][context[multi]]) * p.astype(np.float64), discount, rng)
        return u, n, w, c, context, t

    def beyond(sweep: int) -> Callable[[int, bytes], np.ndarray]:
        def of(_: int, payload: bytes) -> np.ndarray:
            *_, context, t = drawn(payload, sweep)
            return np.bincount(context, t - 1, len(hot.u))

        return of

    for sweep in range(sweeps - 1):
        totals.append(hot.tables + _sums(apart, beyond(sweep), len(hot.u)))  # a number for each context, of a pass over its pairs

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            for shard, chunk, payload in zip(b.column("shard").to_pylist(), b.column("source").to_pylist(), b.column("payload").to_pylist(), strict=True):
                mean = 0.0
                for sweep in range(sweeps):
                    u, n, w, c, context, t = drawn(payload, sweep)
                    mean = mean + (t if sweep >= burn_in else 0.0)
                mean = mean / (sweeps - burn_in)
                mean[c == 0] = 0.0
                own, extra = summed(hot.u[context[c > 1]], mean[c > 1] - 1)
                rows = [(CONTEXTS, shard, 0, pack(own, np.zeros(len(own), np.int64), extra)), (PAIRS, shard, chunk, _with_tables(u, n, w, c, mean))]
                yield packed_rows(rows + _more_tables(w[c > 1], t[c > 1], shard, shards))

    return materialize(apart.mapInArrow(made, PACKED))


@dataclass
class Model:
    """What scoring needs: CONTEXTS and PAIRS of `seats`, ANSWERS of `answers`, words that are broadcast, totals."""

    seats: DataFrame
    answers: DataFrame
    frequent: Frequent
    hot: Hot
    root: Root
    discount: float
    shards: Shards


def learn(texts: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, heavy: int = HEAVY_WORDS, shards: Shards | None = None) -> Model:
    """texts: text, learn. The model of the texts that are learnt, with room for the pairs of the others."""
    shards = shards or plan(texts)
    found = materialize(merged(batch_counts(texts, shards), shards))

    def singles(kind: int, payload: bytes) -> np.ndarray:
        return unpack(payload, _PAIR_KINDS)[0] if kind == PAIRS else np.zeros(2)

    discount = share(*_sums(found.filter(F.col("kind") == PAIRS), singles, 2))
    parts = found.filter(F.col("kind") == WORDS)
    words = words_of(parts, shards)
    root = fit_root(words, heavy, 0)
    answers = answered(words, parts, root, shards)
    start = Hot.collected(_as_tables(found), shards)
    seats = sampled(found, answers, Frequent.collected(answers), start, discount, shards, sweeps, burn_in)
    discard(words, answers)
    if (apart := sampled_apart(seats, start, discount, shards, sweeps, burn_in)) is not None:
        seats = seats.filter(F.col("kind") != APART).unionByName(apart)
    words = words_of(parts.unionByName(seats.filter(F.col("kind") == MORE)), shards)
    root = fit_root(words, heavy, 1)
    answers = answered(words, parts, root, shards)
    discard(words, found)
    return Model(seats, answers, Frequent.collected(answers), Hot.collected(seats, shards), root, discount, shards)


def _as_tables(found: DataFrame) -> DataFrame:
    """CONTEXTS rows with their pairs as tables."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            cols = (b.column(c).to_pylist() for c in ("kind", "shard", "source", "payload"))
            rows = []
            for kind, shard, source, payload in zip(*cols, strict=True):
                u, c, d = unpack(payload, "u8 i8 i8")
                rows.append((kind, shard, source, pack(u, c, d.astype(np.float64))))
            yield packed_rows(rows)

    return found.filter(F.col("kind") == CONTEXTS).mapInArrow(made, PACKED)


# scoring


RARE = np.uint32(0xFFFFFFFF)


def queries(docs: DataFrame, shards: Shards, frequent: Frequent) -> DataFrame:
    """For each batch of docs (doc_id, row, text) and shard: the documents with tokens there and how many, the distinct
    pairs, and the pair of each token. Words that are broadcast are their places among these. source says where the
    answers go: to one place for a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent.word)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 8_192):
            pair, n, own, distinct, u, w = _batch_pairs(b.column("text"), shards)
            null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids, rows = b.column("doc_id").fill_null(0).to_numpy(), b.column("row").to_numpy()
            at, there = looked_up(shared.value, distinct)  # once for each word, not for each pair
            place = np.where(there, at, RARE).astype(np.uint32)
            code = place[w]
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            of = own[pair]
            order = _by_shard(of, shards)
            home = int(mixed(rows[:1].view(np.uint64))[0] % np.uint64(shards.count))
            size, out, at = np.bincount(of), [], 0
            for s, i, j in _parts(own):
                end = at + int(size[s])
                docs_here, per = _runs(doc[order[at:end]])
                kind = np.uint16 if j - i <= 65_536 else np.uint32
                local = (pair[order[at:end]] - i).astype(kind)
                before, times = _runs(u[i:j])
                rare = w[i:j][code[i:j] == RARE]
                words = (place[before], distinct[before[~there[before]]], times, code[i:j], distinct[rare])
                out.append((QUERIES, s, home, pack(ids[docs_here], rows[docs_here], null[docs_here].astype(np.uint8), per, *words, local.view(np.uint8))))
                at = end
            yield packed_rows(out)

    return docs.mapInArrow(made, PACKED)


def scored(model: Model, asked: DataFrame) -> DataFrame:
    """For each query, at its home: the sums of the documents' tokens in the shard, packed."""
    session, root, hot, discount = asked.sparkSession, model.root, model.hot, model.discount
    shared = session.sparkContext.broadcast(model.frequent)

    def make(shard: int, rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        known, parts, ready = Answers(shared.value), [[np.empty(0, k)] for k in ("u8", "i8", "f4")], False
        contexts = [[np.empty(0, k)] for k in ("u8", "i8", "f8")]
        u = customers = tables = key = c = t = None
        for kind, source, payload in rows:
            if kind == CONTEXTS:
                for part, x in zip(contexts, unpack(payload, "u8 i8 f8"), strict=True):
                    part.append(x)
            elif kind == PAIRS:
                for part, x in zip(parts, unpack(payload, "u8 i8 f4"), strict=True):
                    part.append(x)
            elif kind == ANSWERS:
                known.add(payload)
            elif kind == QUERIES:
                if not ready:
                    known.sort()
                    u, customers, tables = summed(*(np.concatenate(x) for x in contexts))
                    customers, tables, _ = hot.over(u, customers, tables)
                    key, c, t = (np.concatenate(x) for x in parts)
                    order = np.argsort(key)
                    key, c, t, ready = key[order], c[order], t[order].astype(np.float64), True
                    parts.clear()
                yield packed_rows([(QUERIES, source, shard, answer(payload, known, u, customers, tables, key, c, t))])

    def answer(payload: bytes, known: Answers, u, customers, tables, key, c, t) -> bytes:
        ids, row, null, per, before, rare_before, n, code, rare, local = unpack(payload, "i8 i8 u1 u4 u4 u8 u4 u4 u8 u1")
        local = local.view(np.uint16 if len(code) <= 65_536 else np.uint32)
        per, often = per.astype(np.int64), code != RARE
        qu = np.empty(len(before), np.uint64)
        qu[before != RARE], qu[before == RARE] = known.frequent.word[before[before != RARE]], rare_before
        qw, wc, wp = np.empty(len(code), np.uint64), np.empty(len(code), np.int64), np.empty(len(code))
        for out, x in ((qw, known.frequent.word), (wc, known.frequent.c), (wp, known.frequent.p)):
            out[often] = x[code[often]]
        qw[~often] = rare
        wc[~often], wp[~often] = known.of(rare)
        at, there = looked_up(key, pair_keys(np.repeat(qu, n), qw), sort=True)
        if len(key):
            own_c, own_t = np.where(there, c[at], 1), np.where(there, t[at], 1.0)
        else:
            own_c, own_t = np.ones(len(qw), np.int64), np.ones(len(qw))
        cat, chere = looked_up(u, qu)
        cu, tu = (np.repeat(np.where(chere, x[cat], 0) if len(x) else np.zeros(len(qu)), n) for x in (customers, tables))
        log_p = np.log10((own_c - discount * own_t + (STRENGTH + discount * tu) * wp) / (STRENGTH + cu))
        base = np.log10((wc + 1) / (root.n + root.v + 1))
        starts = np.cumsum(per) - per
        add = lambda x: np.add.reduceat(x[local], starts, dtype=np.int64 if x.dtype == bool else None)
        return pack(ids, row, null, per.astype(np.uint32), add(wc > 0).astype(np.uint32), add(qw == END).astype(np.uint32), add(base), add(log_p))

    parts = model.seats.filter(F.col("kind").isin(CONTEXTS, PAIRS)), model.answers.filter(F.col("kind") == ANSWERS), asked
    return by_shard(reduce(DataFrame.unionByName, parts), model.shards.count, make, PACKED)


SUMS = "doc_id long, row long, n_tokens long, n_known long, copies long, base double, score double"


def document_sums(answers: DataFrame, shards: Shards) -> DataFrame:
    """SUMS of each document, over all shards. Documents of one batch, and so of one home, are one row each."""
    def make(_: int, rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*(unpack(p, "i8 i8 u1 u4 u4 u4 f8 f8") for _, _, p in rows), strict=True)]
        order = np.lexsort((cols[0], cols[2], cols[1]))
        ids, row, null = (cols[i][order] for i in range(3))
        starts = np.nonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]) | (null[1:] != null[:-1])]))[0]
        add = lambda x, kind: pa.array(np.add.reduceat(x[order].astype(kind), starts))
        whole = [pa.array(ids[starts], pa.int64(), mask=null[starts].astype(bool)), pa.array(row[starts]), *[add(x, np.int64) for x in cols[3:6]], *[add(x, np.float64) for x in cols[6:]]]
        yield pa.RecordBatch.from_arrays(whole, names=["doc_id", "row", "n_tokens", "n_known", "copies", "base", "score"])

    return by_shard(answers, shards.count, make, SUMS)


def score(docs: DataFrame, train: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row for each row of docs.
    The model learns from the texts of `train`, or from those of docs that aren't held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.select("text", (~held_out(F.col("doc_id")) if train is None else F.lit(False)).alias("learn"))
    if train is not None:
        texts = texts.unionByName(train.select("text", F.lit(True).alias("learn")))
    model = learn(texts, **options)
    asked = queries(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text"), model.shards, model.frequent)
    rows = document_sums(scored(model, asked), model.shards).groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "copies", "base", "score")])
    rows = rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = lambda c: F.col(c) / F.col("copies")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), F.lit(model.root.n).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"), perplexity.alias("perplexity"))
