"""Token ids as binary shards: every document's ids are one zstandard frame, compressed with a dictionary that all
shards share, so a short document can be read alone and still compresses well.

Format: `<path>/dictionary` (dict_hash, dictionary, id_bytes) and `<path>/shards`, Parquet files that hold one row for
each chunk: shard, chunk, dict_hash, n_ids, first_id, last_id, doc_ids, n_tokens, offsets, payload. Frame i of a chunk
is payload[offsets[i]:offsets[i + 1]] and holds the little-endian ids of doc_ids[i], id_bytes each: 2 where the
vocabulary fits, else 4. Parquet's statistics of first_id and last_id let a reader skip chunks. Shards, chunks and the frames in them are in ascending doc_id order (null first). Spark's own writer
makes the files, so retries and lost executors leave no partial shards, on any store that Spark can write.

Scale: texts are encoded where they are read and only compressed frames are shuffled, once, by shard. Shard borders
are quantiles of doc_id. Starts are prefix sums of chunk totals (read without the payload) inside a shard, plus a
prefix over at most MAX_SHARDS shards.

Null texts are empty and have the end id only. Repeated rows are written as often as they come.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import scratch
from .common import held, small_batches

END_ID = 1
MAX_SHARDS = 65_536
SHARD_DOCS = 8_192
CHUNK_BYTES = 2_000_000
#: What the dictionary is trained on: the id arrays of so many documents (smallest md5 of doc_id), of these as many as
#: have so many characters in all. It is a bound on the training only; all ids are written.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 512, 8_000_000, 65_536
#: A worker's caches of encoded words as they stand, and of their cores; bounds on memory. Cores are what costs.
CACHE_WORDS, CACHE_CORES, CACHE_CHARS = 250_000, 450_000, 32
#: What a tokenizer must be made of to be given words apart: fixed values of its file.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS, _PRETOKENIZERS, _WORD_END = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "</w>"
#: Without U+0130: in lower case it has a combining dot, which joins the punctuation behind it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)\Z")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+\Z")


def takes_words(tokenizer: dict) -> bool:
    """Whether a tokenizer, given as its file says, drops white space, lower-cases, and takes punctuation off letters,
    so that words may be encoded apart."""
    steps = (tokenizer.get("normalizer") or {}).get("normalizers", [])
    parts = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != _NORMALIZERS or [x["type"] for x in parts] != _PRETOKENIZERS:
        return False
    spaces, cut, model = steps[1], parts[0], tokenizer["model"]
    plain = (spaces["pattern"], spaces["content"], cut["pattern"], cut["behavior"], cut["invert"]) == ({"Regex": r"\s+"}, " ", {"Regex": _WORDS}, "Removed", True)
    return plain and model["type"] == "BPE" and model["end_of_word_suffix"] == _WORD_END and not any(x["normalized"] or " " in x["content"] for x in tokenizer["added_tokens"])


class Encoder:
    """Encodes whole texts with a tokenizer. If its file shows that it can, word by word through a cache: distinct words
    are found per batch, so the work in Python is by distinct word, and texts are put together from them by array
    operations. Any other tokenizer, or `whole=True`, encodes each text at once."""

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.cores = Tokenizer.from_file(path), {}, {"": b""}
        self.whole = whole or not takes_words(json.loads(self.tokenizer.to_str()))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(_WORD_END)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _core_ids(self, cores: list[str]) -> list[bytes]:
        """The ids of cores. Plain ones are encoded as one text and parted behind the ids that end words; if that
        gives another number of parts, one by one."""
        plain = [c for c in cores if _LETTERS.match(c)]
        if len(plain) < len(cores):
            odd = [c for c in cores if not _LETTERS.match(c)]
            found = dict(zip(plain + odd, self._core_ids(plain) + self._ids(odd), strict=True))
            return [found[c] for c in cores]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.nonzero(self.ends[ids])[0] + 1
        if len(cuts) != len(cores) or len(cuts) and cuts[-1] != len(ids):
            return self._ids(cores)
        data, at = ids.tobytes(), (np.concatenate([[0], cuts]) * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    @staticmethod
    def _split(word: str) -> tuple[str, str]:
        """(core, mark): a plain Latin word, in lower case if ASCII, and the ASCII punctuation behind it, which this
        tokenizer always takes apart; other words whole."""
        if not (found := _PLAIN.match(word)):
            return word, ""
        core, mark = found.groups()
        return (core.lower() if core.isascii() else core), mark

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from the cache or the tokenizer."""
        get = self.words.get
        out = list(map(get, words))
        new = {i: self._split(words[i]) for i, x in enumerate(out) if x is None}
        wanted = [c for c in {x for pair in new.values() for x in pair if x} if c not in self.cores]
        self.cores.update(zip(wanted, self._core_ids(wanted), strict=True))
        for i, (core, mark) in new.items():
            out[i] = self.cores[core] + (self.cores[mark] if mark else b"")
            if len(self.words) < CACHE_WORDS and len(words[i]) <= CACHE_CHARS:
                self.words[words[i]] = out[i]
        for w in wanted if len(self.cores) > CACHE_CORES else [w for w in wanted if len(w) > CACHE_CHARS]:
            del self.cores[w]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.whole:
            return [np.frombuffer(x, self.kind) for x in self._ids(texts.to_pylist())]
        split = pc.ascii_split_whitespace(texts)
        flat = pc.dictionary_encode(split.flatten())
        ids = self._words(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // self.kind.itemsize
        starts, every = np.cumsum(lengths, dtype=np.int32) - lengths, np.frombuffer(b"".join(ids), self.kind)
        word = flat.indices.to_numpy()
        n = lengths[word]
        ends = np.cumsum(n, dtype=np.int32)
        place = np.repeat(starts[word] - ends + n, n)
        place += np.arange(len(place), dtype=np.int32)
        whole = every[place]
        cuts = np.concatenate([np.zeros(1, np.int32), ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encoder(path: str, whole: bool = False) -> Encoder:
    return held(f"encoder {path} {whole}", lambda: Encoder(path, whole))


def train_dictionary(docs: DataFrame, tokenizer: str, whole: bool = False) -> bytes:
    """A zstandard dictionary from id arrays of a bounded sample. Fewer samples than training needs: their bytes as
    a plain content dictionary."""
    sizes = docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    ids, left = [], SAMPLE_CHARS
    for r in sizes.orderBy(F.md5(F.col("doc_id").cast("string")), "size").limit(SAMPLE_DOCS).collect():
        if r["size"] <= left:
            ids.append(r["doc_id"])
            left -= r["size"]
    if not ids:
        return b""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, whole)
        for b in small_batches(batches, 256):
            found = [x.tobytes() for x in e.encode(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    rows = docs.filter(F.col("doc_id").isin(ids)).select("text").mapInArrow(encode, "ids binary")
    samples = sorted(bytes(r[0]) for r in rows.limit(2 * SAMPLE_DOCS).collect())  # ids may be repeated
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def dict_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, whole: bool = False, level: int = 1) -> str:
    """Writes the ids of all texts, each with end_id behind, and returns the path."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    width = encoder(tokenizer, whole).kind.itemsize
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = train_dictionary(docs, tokenizer, whole)
    name = dict_hash(data)
    spark.createDataFrame([(name, bytearray(data), width)], "dict_hash string, dictionary binary, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")
    shards = max(1, min(MAX_SHARDS, docs.count() // SHARD_DOCS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    borders = np.array(cuts or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, whole)
        end, compress = np.array([end_id], e.kind).tobytes(), zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True, **_dictionary(data)).compress
        for b in small_batches(batches, 4096, 8_000_000):
            ids = [x.tobytes() + end for x in e.encode(b.column("text"))]
            at = b.column("doc_id")
            shard = np.where(at.is_null(), 0, np.searchsorted(borders, at.fill_null(0).to_numpy(zero_copy_only=False), side="left"))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), at, pa.array([len(x) // e.kind.itemsize for x in ids], pa.int32()), pa.array([compress(x) for x in ids], pa.binary())], names=["shard", "doc_id", "n_tokens", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, shard, chunk = [], 0, None, 0
        for b in small_batches(batches, 256):
            for s, d, n, f in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "frame")), strict=True):
                if rows and (s != shard or size + len(f) > CHUNK_BYTES):
                    yield packed(shard, chunk, rows)
                    rows, size, chunk = [], 0, chunk + 1
                chunk, shard = (chunk if s == shard else 0), s
                rows.append((d, n, f))
                size += len(f)
        if rows:
            yield packed(shard, chunk, rows)

    def packed(shard: int, chunk: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, counts, frames = zip(*rows, strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
        cols = [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([name]), pa.array([sum(counts)], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([ids[-1]], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "chunk", "dict_hash", "n_ids", "first_id", "last_id", "doc_ids", "n_tokens", "offsets", "payload"])

    encoded = docs.mapInArrow(encode, "shard int, doc_id long, n_tokens int, frame binary")
    dealt = encoded.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "frame")
    dealt.mapInArrow(pack, "shard int, chunk int, dict_hash string, n_ids long, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, offsets array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/shards")
    return path


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, str, bytes, str]:
    name, data, width = spark.read.parquet(f"{path}/dictionary").first()
    if dict_hash(bytes(data)) != name:
        raise ValueError(f"the dictionary of {path} has not the hash {name}")
    return spark.read.parquet(f"{path}/shards"), name, bytes(data), f"<u{width}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), as read from the files."""
    shards, name, data, kind = _open(spark, path)
    chunks = shards.select("shard", "chunk", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    totals = totals.select("shard", before(W.orderBy("shard")).alias("shard_start"))  # at most MAX_SHARDS rows
    starts = chunks.withColumn("chunk_start", before(W.partitionBy("shard").orderBy("chunk"))).join(totals, "shard")
    starts = starts.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), (F.col("shard_start") + F.col("chunk_start")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(**_dictionary(data)).decompress
        for b in small_batches(batches, 1):
            if b.column("dict_hash")[0].as_py() != name:
                raise ValueError(f"a shard of {path} was written with another dictionary than {name}")
            payload, offsets = b.column("payload")[0].as_buffer(), b.column("offsets")[0].as_py()
            counts = np.array(b.column("n_tokens")[0].as_py(), np.int64)
            crc = [zlib.crc32(np.frombuffer(decompress(payload[i:j]), kind).astype("<u4")) for i, j in zip(offsets, offsets[1:], strict=False)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([b.column(k)[0].as_py()] * n, pa.int32()) for k in ("shard", "chunk")] + [pa.array(b.column("doc_ids")[0].as_py(), pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["shard", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "chunk", "dict_hash", "doc_ids", "n_tokens", "offsets", "payload").mapInArrow(decode, "shard int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c"))).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: chunks that can't have it are skipped by Parquet's statistics, and only its own frame is
    decompressed. Of repeated rows the first counts."""
    shards, _, data, kind = _open(spark, path)
    near = shards.filter((F.col("last_id") >= doc_id) & (F.col("first_id").isNull() | (F.col("first_id") <= doc_id)))
    row = near.filter(F.array_contains("doc_ids", F.lit(doc_id))).withColumn("i", F.array_position("doc_ids", F.lit(doc_id)).cast("int"))
    row = row.select(F.expr("substring(payload, cast(offsets[i - 1] + 1 as int), cast(offsets[i] - offsets[i - 1] as int))")).first()
    if row is None:
        return None
    return np.frombuffer(zstandard.ZstdDecompressor(**_dictionary(data)).decompress(bytes(row[0])), kind).tolist()
