"""Byte-level BPE by a tokenization automaton, and back.

The automaton reads tokens and accepts exactly the token sequences that BPE makes. It starts as one state with a loop
for each byte, and takes one gadget for each merge (u, v) -> uv, in order of merges (Berglund, Martens and van der
Merwe, 2024; Cognetta and Okazaki, 2024): behind u comes a copy of its state without an arc v, and wherever u may come
an arc uv leads to where v led. All arcs of one label end in one state, so the automaton is two maps, the state behind
each label and the group of labels that states treat alike, and one bit for each pair of state and group: no arc. A
state or group is split only when a gadget tells its members apart.

A text's parts between special tokens are split into words by the fixed pattern of byte-level tokenizers. A word's
tokens are the one path of the automaton that spells it: from each place that is reached, arcs are followed through a
trie of the labels' bytes, and of the arcs that end at a place exactly one comes from a reached place whose state has
it. All distinct words of a batch take their steps together, as table look-ups of arrays. Decoding emits the labels of
the arcs: bytes by id, joined.

Scale: no shuffle; texts are encoded where they are read. The automaton (bounded by the vocabulary, about 2 MB) is
compiled once and broadcast. A worker takes about 4 MB of text at a time and keeps one bounded cache of words.

Null texts are empty and have no ids. Empty tables give empty tables. Repeated rows, ties and null ids stay as they
are, one row out for each row in; other columns are not read. Strings of special tokens in a text are those tokens,
as the tokenizer takes them by default. Bytes that are no UTF-8 are decoded to U+FFFD, as the tokenizer does.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches

#: Fixed value: how byte-level tokenizers split a text into words before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker's cache: entries and bytes of the longest one. A bound on memory, not on what is encoded.
CACHE_PIECES, CACHE_CHARS = 400_000, 48
#: Words of more bytes go one by one instead of in step with others.
LONG_WORD = 192
#: Words that take their steps together.
WORDS_AT_ONCE = 32_768
_SPACE = regex.compile(r"\s")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies of byte-level tokenizers: printable Latin-1 characters for
    themselves, other bytes from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Automaton:
    """`state[t]`, `group[t]`: of label t. `barred[g]`: bits of states without arcs of group g. `arcs`: (node * 256 + byte,
    next node) of the trie of labels, whose inner nodes have the lower numbers; `label[node]`: the token that ends there
    or -1. `special`: strings of added tokens to ids. `spelled`, `ends`: bytes of all ids, one after another, and where
    they end."""

    state: np.ndarray
    group: np.ndarray
    barred: np.ndarray
    arcs: np.ndarray
    label: np.ndarray
    special: dict[str, int]
    spelled: np.ndarray
    ends: np.ndarray


def _gadgets(n: int, base: list[int], merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """state, group and barred after the gadgets of merges (u, v, uv). A label that no byte or merge makes stays at -1."""
    state, group = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    state[base] = group[base] = 0
    states, groups = [len(base)], [len(base)]  # members of each
    barred = np.zeros((64, 64), np.uint8)
    for u, v, uv in merges:
        if state[u] < 0 or state[v] < 0 or state[uv] >= 0:
            raise ValueError(f"merge ({u}, {v}) of a token that is not made before, or of one that is made twice")
        at, of = state[u], group[v]
        if barred[of, at >> 3] >> (at & 7) & 1:
            continue  # u never comes before v: the merge makes nothing
        state[uv] = state[v]
        states[state[v]] += 1
        if states[at] > 1:
            new = len(states)
            if new >> 3 >= barred.shape[1]:
                barred = np.pad(barred, ((0, 0), (0, barred.shape[1])))
            barred[:, new >> 3] |= (barred[:, at >> 3] >> np.uint8(at & 7) & np.uint8(1)) << np.uint8(new & 7)
            states[at] -= 1
            states.append(1)
            state[u] = at = new
        if groups[of] > 1:
            new = len(groups)
            if new >= len(barred):
                barred = np.pad(barred, ((0, len(barred)), (0, 0)))
            barred[new] = barred[of]
            groups[of] -= 1
            groups.append(1)
            group[v] = of = new
        barred[of, at >> 3] |= np.uint8(1 << (at & 7))
        group[uv] = group[u]
        groups[group[u]] += 1
    return state, group, np.ascontiguousarray(barred[: len(groups), : (len(states) + 7) >> 3])


def compile_automaton(tokenizer: str) -> Automaton:
    """The automaton of a byte-level BPE tokenizer's JSON. Other kinds of tokenizer raise ValueError."""
    spec = json.loads(tokenizer)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    own = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    plain = not any(model.get(k) for k in own) and not spec["normalizer"] and not spec["post_processor"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]) or model.get("type") != "BPE" or not plain or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
        raise ValueError("not a byte-level BPE tokenizer of the plain kind")
    vocab, alphabet = model["vocab"], byte_alphabet()
    n = max([*vocab.values(), *special.values()]) + 1
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    state, group, barred = _gadgets(n, [i for s, i in vocab.items() if len(s) == 1], [(vocab[a], vocab[b], vocab[a + b]) for a, b in parts])

    spelling = {i: bytes(map(alphabet.__getitem__, s)) for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    arcs: dict[int, int] = {}
    label = [-1]
    for i, word in sorted(spelling.items()):
        if state[i] < 0:
            continue
        node = 0
        for b in word:
            node = arcs.setdefault(node << 8 | b, len(arcs) + 1)
            if node == len(label):
                label.append(-1)
        label[node] = i
    taken, to = np.fromiter(arcs, np.int64, len(arcs)), np.fromiter(arcs.values(), np.int64, len(arcs))
    inner = np.isin(np.arange(len(label)), taken >> 8)
    number = np.where(inner, np.cumsum(inner) - 1, inner.sum() + np.cumsum(~inner) - 1)
    labels = np.empty(len(label), np.int32)
    labels[number] = label
    every = [spelling.get(i, b"") for i in range(n)]
    return Automaton(state, group, barred, np.stack([number[taken >> 8] << 8 | taken & 255, number[to]]), labels, special, np.frombuffer(b"".join(every), np.uint8), np.cumsum([len(x) for x in every]))


def pack(automaton: Automaton) -> bytes:
    return zstandard.compress(pickle.dumps(automaton), 3)


def unpack(data: bytes) -> Automaton:
    return pickle.loads(zstandard.decompress(data))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (lengths[i] places), one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts with an automaton, by distinct pieces between single spaces where words cannot span these."""

    def __init__(self, automaton: Automaton):
        self.a, self.pieces = automaton, {}
        self.inner = int(automaton.arcs[0].max() >> 8) + 1 if automaton.arcs.size else 0
        self.next = np.zeros((self.inner + 1) << 8, np.int32)  # the last row is that of all nodes without arcs
        self.next[automaton.arcs[0]] = automaton.arcs[1]
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True)))) if automaton.special else None

    def _barred(self, before: np.ndarray, label: np.ndarray) -> np.ndarray:
        s = self.a.state[before]
        return self.a.barred[self.a.group[label], s >> 3] >> (s & 7).astype(np.uint8) & 1

    def _long(self, word: bytes) -> list[int]:
        """The ids of one word, place by place; for long words."""
        a, n = self.a, len(word)
        step, inner, label, group, state, barred = self.next, self.inner, a.label, a.group, a.state, a.barred
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            node, s = 0, state[last[i]] if i else -1
            for j in range(i, n):
                if not (node := step[min(int(node), inner) << 8 | word[j]]):
                    break
                if (t := label[node]) >= 0 and (s < 0 or not barred[group[t], s >> 3] >> (s & 7) & 1):
                    last[j + 1], back[j + 1] = int(t), i
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _together(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of one to LONG_WORD bytes, step by step together."""
        a, n = self.a, len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        width = int(lengths.max())
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        first = np.cumsum(lengths) - lengths
        last, back = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int16)
        for i in range(width):
            at = np.nonzero((lengths > i) & (last[i] >= 0) if i else lengths > 0)[0]
            node = np.zeros(len(at), np.int32)
            for j in range(i, width):
                node = self.next[np.minimum(node, self.inner) << 8 | text[first[at] + j]]
                ahead = node > 0
                at, node = at[ahead], node[ahead]
                if not len(at):
                    break
                found = a.label[node]
                ends = np.nonzero(found >= 0)[0]
                if len(ends) and i:
                    ends = ends[self._barred(last[i, at[ends]], found[ends]) == 0]
                last[j + 1, at[ends]], back[j + 1, at[ends]] = found[ends], i
                more = lengths[at] > j + 1
                at, node = at[more], node[more]
        steps, place, rows = [], lengths.copy(), np.arange(n)
        while len(rows):
            steps.append((rows, last[place, rows]))
            place = back[place, rows].astype(np.int64)
            rows, place = rows[place > 0], place[place > 0]
        row, ids = np.concatenate([r for r, _ in steps]), np.concatenate([t for _, t in steps])
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]), row))
        ids = ids[order].astype("<u4")
        return np.split(ids, np.cumsum(np.bincount(row, minlength=n))[:-1])

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers."""
        coded = {w: w.encode() for w in words}
        out = {w: np.array(self._long(x), "<u4").tobytes() for w, x in coded.items() if len(x) > LONG_WORD}
        short = sorted((w for w in words if w not in out), key=lambda w: len(coded[w]))
        for k in range(0, len(short), WORDS_AT_ONCE):
            part = short[k : k + WORDS_AT_ONCE]
            out.update(zip(part, (x.tobytes() for x in self._together([coded[w] for w in part])), strict=True))
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, each split by the pattern as a whole."""
        cut = []
        for text in texts:
            parts, at = [], 0
            for m in self.special.finditer(text) if self.special else ():
                parts += [*self.split(text[at : m.start()]), self.a.special[m[0]]]
                at = m.end()
            cut.append(parts + self.split(text[at:]))
        known = self.words(list({w for parts in cut for w in parts if isinstance(w, str)}))
        return [b"".join(known[w] if isinstance(w, str) else np.uint32(w).astype("<u4").tobytes() for w in parts) for parts in cut]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, from the cache or the automaton."""
        out = list(map(self.pieces.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
        for i, x in zip(new, self._whole([pieces[i] for i in new]), strict=True):
            out[i] = x
            if len(self.pieces) < CACHE_PIECES and len(pieces[i]) <= CACHE_CHARS:
                self.pieces[pieces[i]] = x
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. A text is taken by pieces if each begins and ends with what is no white space, for then
        every word lies in one piece, with the space before it; other texts, and those with special tokens, whole."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = ~pc.match_substring_regex(texts, r"^\s|\s$|\s | \s|[^\S\x09-\x0D\x20]").to_numpy(zero_copy_only=False)
        apart &= pc.binary_length(texts).to_numpy() > 0
        for odd in (*self.a.special, *"\x85\xa0                　"):
            apart &= ~pc.match_substring(texts, odd).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        whole = np.nonzero(~apart)[0].tolist()
        for i, x in zip(whole, self._whole(texts.take(pa.array(whole, pa.int64())).to_pylist()), strict=True):
            out[i] = x
        if not apart.any():
            return out
        # a space before every text but the first piece's is part of the piece
        split = pc.split_pattern(texts.filter(pa.array(apart)), " ")
        firsts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        flat = split.flatten()
        leads = np.zeros(len(flat), bool)
        leads[firsts] = True
        spaced = pc.dictionary_encode(pc.if_else(pa.array(leads), flat, pc.binary_join_element_wise("", flat, " ")))
        ids = self._pieces(spaced.dictionary.to_pylist())
        every = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts, piece = np.cumsum(sizes) - sizes, spaced.indices.to_numpy()
        n = sizes[piece]
        joined = every[_spread(starts[piece], n)]
        cuts = np.concatenate([[0], np.cumsum(n)])[np.append(firsts, len(flat))]
        for i, lo, hi in zip(np.nonzero(apart)[0].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = joined[lo:hi].tobytes()
        return out


def spell(automaton: Automaton, ids: list[bytes | None]) -> list[str]:
    """The texts of ids: labels by id, joined."""
    ids = [x or b"" for x in ids]
    every = np.frombuffer(b"".join(ids), "<u4")
    lengths = np.diff(automaton.ends, prepend=0)
    n = lengths[every]
    spelled = automaton.spelled[_spread((automaton.ends - lengths)[every], n)].tobytes()
    cuts = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *[len(x) >> 2 for x in ids]])].tolist()
    return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _tokenizer(docs: DataFrame, path: str) -> tuple[str, object]:
    with open(path, encoding="utf-8") as f:
        packed = pack(compile_automaton(f.read()))
    return path, docs.sparkSession.sparkContext.broadcast(packed)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of every row. tokenizer: path of its JSON file."""
    path, sent = _tokenizer(docs, tokenizer)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = held(f"automaton {path}", lambda: Encoder(unpack(sent.value)))
        for b in small_batches(batches, 4096):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.encode(b.column(1)), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, ids binary")


_SPELLERS: dict[str, Automaton] = {}


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text of every row of (doc_id, ids)."""
    with open(tokenizer, encoding="utf-8") as f:
        whole = compile_automaton(f.read())
    none = np.empty(0, np.int32)
    sent = encoded.sparkSession.sparkContext.broadcast(pack(Automaton(none, none, none, none, none, {}, whole.spelled, whole.ends)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _SPELLERS:
            _SPELLERS.clear()
            _SPELLERS[tokenizer] = unpack(sent.value)
        for b in small_batches(batches, 4096):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spell(_SPELLERS[tokenizer], b.column(1).to_pylist()), pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(made, "doc_id long, ids binary, text string")
