import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import token_output

from .helpers import ODD, documents, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    each = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, _ in rows]
    for i, ids in sorted(each, key=lambda r: (r[0] is not None, r[0], len(r[1]))):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_same_ids_as_the_tokenizer(spark, whole):
    rows = ODD + [(100 + i, sentence(i, 30).title() + ". And, " + sentence(i, 5), "s") for i in range(80)]
    path = token_output.write(documents(spark, rows), PATH, whole=whole)
    got = sorted(map(tuple, token_output.read(spark, path).collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert got == expected(rows)
    assert token_output.read_document(spark, path, 7) == [*Tokenizer.from_file(PATH).encode(ODD[8][1], add_special_tokens=False).ids, 1]
    assert token_output.read_document(spark, path, 12345) is None


def test_shards_are_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_DOCS", 7)
    monkeypatch.setattr(token_output, "CHUNK_BYTES", 300)
    rows = [(i * 3, sentence(i, i % 50), "s") for i in range(90)]
    path = token_output.write(documents(spark, rows), PATH)
    assert spark.read.parquet(f"{path}/shards").select("shard").distinct().count() > 8
    assert sorted(map(tuple, token_output.read(spark, path).collect())) == expected(rows)


def test_empty_table(spark):
    path = token_output.write(documents(spark, []), PATH)
    assert token_output.read(spark, path).count() == 0


def test_another_dictionary_is_refused(spark):
    path = token_output.write(documents(spark, [(1, "a b", "s")]), PATH)
    bad = spark.createDataFrame([("0" * 16, bytearray(b"x"), 2)], "dict_hash string, dictionary binary, id_bytes int")
    bad.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="has not the hash"):
        token_output.read(spark, path)


def test_letters_before_punctuation_as_the_tokenizer(spark):
    import pyarrow as pa

    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7)]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    texts = [" ".join(f"{x}{m} DEN{x}ZL{x}{m}" for m in marks) for x in letters]
    t = Tokenizer.from_file(PATH)
    got = token_output.Encoder(PATH).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_another_tokenizer_is_given_whole_texts_and_its_id_width_is_stored(spark):
    import json

    known = json.loads(Tokenizer.from_file(PATH).to_str())
    assert token_output.takes_words(known)
    cased = {**known, "normalizer": {"type": "Sequence", "normalizers": known["normalizer"]["normalizers"][:2]}}
    assert not token_output.takes_words(cased)
    path = token_output.write(documents(spark, [(1, "a b", "s")]), PATH)
    assert spark.read.parquet(f"{path}/dictionary").first()["id_bytes"] == 2
    assert spark.read.parquet(f"{path}/shards").first()["first_id"] == 1


def test_texts_of_some_megabytes(spark):
    rows = [(1, " ".join(sentence(i, 2_000) for i in range(100)), "s"), (2, "y" * 300_000, "s"), (3, "", "s")]
    path = token_output.write(documents(spark, rows), PATH)
    assert sorted(map(tuple, token_output.read(spark, path).collect())) == expected(rows)


def test_query_over_whole_table(spark, sf_dir):
    from pagewright.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"], "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_token_output"](spark, sf_dir).collect())) == sorted(expected(rows))
