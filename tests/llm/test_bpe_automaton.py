"""The tokenization automaton against the tokenizers library, on every code point, odd texts and whole tables."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pagewright.llm import bpe_automaton
from pagewright.llm.queries import QUERIES
from tokenizers import Tokenizer

from .helpers import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "\n", "'s", "'", "1", "é", "\t", "<|endoftext|>", "th", "er", "\x1c", "\U0001f600", ".", "　", "="]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, encoding="utf-8") as f:
        return bpe_automaton.compile_automaton(f.read())


def check(library, automaton, texts):
    got = bpe_automaton.Encoder(automaton).encode(pa.array(texts, pa.string()))
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert bpe_automaton.spell(automaton, got) == [library.decode(x, skip_special_tokens=False) for x in want]


def test_every_code_point(library, automaton):
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    check(library, automaton, ["".join(f"a{c}b {c}{c} c" for c in letters[k : k + 64]) for k in range(0, len(letters), 64)])


def test_random_and_long_texts(library, automaton):
    r = random.Random(5)
    texts = ["".join(r.choices(ALPHABET, k=r.randint(0, 40))) for _ in range(4000)]
    long = ["x" * 100_000, "the quick brown fox " * 100_000, "=" * 3000 + " " * 3000, "ab" * 5000 + "\n\n", None, *[t for _, t, _ in ODD]]
    check(library, automaton, texts + long)


def test_gadgets_of_a_small_vocabulary():
    """All strings over two letters: exactly the library's tokens, also where letters repeat and merges overlap."""
    merges = [["a", "a"], ["b", "a"], ["aa", "b"], ["a", "b"], ["aa", "aa"], ["ab", "ba"]]
    vocab = {t: i for i, t in enumerate(["a", "b", *["".join(m) for m in merges]])}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}}
    texts = ["".join("ab"[k >> i & 1] for i in range(n)) for n in range(1, 11) for k in range(2**n)]
    check(Tokenizer.from_str(json.dumps(spec)), bpe_automaton.compile_automaton(json.dumps(spec)), texts)
    a = bpe_automaton.compile_automaton(json.dumps(spec))
    one = bpe_automaton.Encoder(a)
    assert [one._long(t.encode()) for t in texts] == [x.tolist() for x in one._together([t.encode() for t in texts])]


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe_automaton.compile_automaton(f.read())


def test_bytes_that_are_no_text(library, automaton):
    ids = [[222], [50256, 5, 50256], [], [161, 255]]
    assert bpe_automaton.spell(automaton, [np.array(x, "<u4").tobytes() for x in ids]) == [library.decode(x, skip_special_tokens=False) for x in ids]


def test_odd_rows(spark, library):
    got = {(r["doc_id"], r["text"]) for r in bpe_automaton.decode(bpe_automaton.encode(documents(spark, ODD), PATH), PATH).collect()}
    assert got == {(i, t or "") for i, t, _ in ODD}
    assert bpe_automaton.decode(bpe_automaton.encode(documents(spark, ODD).limit(0), PATH), PATH).collect() == []


def test_query_gives_the_librarys_ids(spark, sf_dir, library):
    want = set()
    for i, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op11_bpe_automaton"](spark, sf_dir).collect()} == want
