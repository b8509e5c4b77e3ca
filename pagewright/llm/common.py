"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import forget, scratch

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a worker handles at a time; a longer text is a batch of its own.
BATCH_BYTES = 4_000_000

#: While a table is written: its shuffles go when it is done, and batches for Python are bounded by bytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again, so it is computed once
    and survives lost executors. The shuffles that made it are dropped."""
    spark = df.sparkSession
    path = scratch(spark, "tables")
    with _conf(spark, _WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for df in tables:
        forget(df.sparkSession, df.written_to)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with columns of these names set aside under others, and what selects all its columns as they were."""
    taken, moved = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in names:
            moved[c] = next(n for n in (f"{c}_{k}" for k in range(len(taken) + 1)) if n.lower() not in taken)
            taken.add(moved[c].lower())
    return df.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body's lambdas use it for each element."""
    return F.transform(F.array(value), body).getItem(0)


_HELD: list[Any] = [None, None]


def held(key: str, make: Callable[[], Any]) -> Any:
    """The one object that a Python worker keeps from task to task. One of another key takes its place, so what
    stages keep does not add up in workers that they share."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        _HELD[:] = [key, make()]
    return _HELD[1]


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_hashes(words: pa.Array) -> np.ndarray:
    """The 64-bit hash of each word's UTF-8 bytes. Hashing a word again is cheaper than looking it up in a cache, and NumPy
    gets strings out of Arrow at a tenth of the cost of a list of Python values."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of the distinct words, the place of each word of all texts among them, and the number of
    words of each text.

    Arrow splits at exactly the characters U+0020 and U+0009-U+000D; each distinct word of the batch is hashed once."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.dictionary_encode(split.flatten())
    words = flat.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    known = word_hashes(pc.ascii_lower(words) if lower else words)
    at = flat.indices.to_numpy()
    cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
    if empty < 0:
        return known, at, np.diff(cuts)
    full = at != empty
    return known, at[full], np.diff(np.concatenate([[0], np.cumsum(full)])[cuts])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' words, one after another, and the number of words of each text."""
    known, at, counts = coded_words(texts)
    return known[at], counts


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of hashes become well spread."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words of one sequence (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _POWER
        out += h[j : j + n]
    return mixed(out)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and, unless one row alone has more, `size` bytes of strings."""
    for b in batches:
        lengths = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                lengths += pc.fill_null(pc.binary_length(c), 0).to_numpy()
        ends, at = np.cumsum(lengths), 0
        while at < b.num_rows:
            full = np.searchsorted(ends, ends[at] - lengths[at] + size, side="right")
            to = int(min(max(at + 1, full), at + rows))
            yield b.slice(at, to - at)
            at = to
        del b, lengths, ends
    trim()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Groups of a partition that is sorted by keys, each as columns of Python values; groups may span batches."""
    held: dict[str, list] | None = None
    last = None
    for b in small_batches(batches):
        if not b.num_rows:
            continue
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        ids = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(ids) + 1):
            if i < len(ids) and ids[i] == ids[start]:
                continue
            part = {c: v[start:i] for c, v in cols.items()}
            if held is not None and last == ids[start]:
                for c in held:
                    held[c] += part[c]
            else:
                if held is not None:
                    yield held
                held, last = part, ids[start]
            start = i
    if held is not None:
        yield held
