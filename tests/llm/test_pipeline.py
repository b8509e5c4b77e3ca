"""run() against a brute-force version of all stages."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from .helpers import ODD, plain_documents, sentence, words
from .test_ngram_join import brute as near_classes


def fails(text):
    w = words(text)
    n, windows = len(w), {}
    for i in range(n - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = len({k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)})
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup, chars = len(lines) - len(set(lines)), sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n < 20 or 100 * repeated > 30 * n or 100 * symbols > 40 * n or len(lines) >= 4 and 100 * dup > 50 * len(lines) or chars < 2 * n or chars > 20 * n


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def times_taken(rows):
    """How often the mix takes each document: every copy with its finish time, in one queue."""
    sizes = {i: len(words(t)) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    size = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in names}
    weight, left, budget = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(names), 1.5 * sum(size.values())
    target = {}
    while left:  # those above their limit stop there, the others share what remains
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: weight[s] * level for s in left}
        left = left - full if full else set()
    queue = []
    for s in names:
        own = sorted((hashlib.md5(f"{i}:17".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        upto = 0
        for copy in (0, 1):
            for key, i in own:
                upto += sizes[i]
                if sizes[i]:
                    finish = upto / target[s]
                    queue.append((min(int(finish * 65536), 131072), finish, copy, key, i))
    times, total = dict.fromkeys(sizes, 0), 0
    for *_, i in sorted(queue):
        total += sizes[i]
        if total > budget:
            break
        times[i] += 1
    return times


def test_run_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [r for r in rows if not fails(r[1])]
    first = {i: c for i, c, _ in near_classes(rows)}
    rows = [r for r in rows if first[r[0]] == r[0]]
    bad = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = low_words(r["text"])
        bad |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(b) for b in bad}
    rows = [r for r in rows if not any(tuple(w[i : i + n]) in bad for w in [low_words(r[1])] for n in sizes for i in range(len(w) - n + 1))]
    taken = times_taken(rows)
    t, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text, _ in sorted(rows):
        n = len(t.encode(text, add_special_tokens=False).ids) + 1
        for _ in range(taken[i]):
            want.append((i, start, n))
            start += n
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(want) > 50


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    for rows in (ODD, []):
        docs = plain_documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        got = [r["doc_id"] for r in docs.collect()]
        # of the odd rows only the two copies of one text have twenty words or more, and they repeat themselves
        assert got == []


def test_stages_keep_clean_rows_among_odd_ones(spark, sf_dir):
    good = [(100 + i, sentence(i, 60), "ab"[i % 2]) for i in range(12)]
    docs = plain_documents(spark, ODD + good + [(200, good[0][1], "a"), (200, good[0][1], "a"), (None, sentence(77, 60), None)])
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    assert sorted((r["doc_id"] or -1) for r in docs.collect()) == [-1, *range(100, 112)]


def test_stages_are_lists_of_functions():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "decontamination", "mixing", "token ids"]
