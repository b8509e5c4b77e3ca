import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import ngram_join

from .helpers import ODD, documents, plain_documents, sentence, words


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    ids = [(i, s) for i, t, _ in rows if (s := shingle_set(t)) and i is not None]
    parent = {i: i for i, _ in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for x, (i, s) in enumerate(ids):
        for j, u in ids[:x]:
            if 10 * len(s & u) >= 8 * len(s | u):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, top(i), links[i]) if shingle_set(t) and i is not None else (i, i, 0) for i, t, _ in rows)


def corpus(n_near=60):
    r, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, sentence(i, r.randrange(1, 90)), "s"))
    base = sentence(99, 120).split()
    for i in range(n_near):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        rows.append((1000 + i, " ".join(w), "s"))
    rows += [(2000 + i, rows[5][1], "s") for i in range(7)] + [(3000 + i, f"  {rows[7][1]}\n", "s") for i in range(3)]
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_against_brute_force(spark, block):
    rows = corpus() + [r for r in ODD if r[0] not in (None, 6)]
    rows = [(i if i >= 1000 or t != (rows[i][1] if i < 60 else "") else i, t, s) for i, t, s in rows]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(documents(spark, rows), block=block).collect())
    assert got == brute(rows)


def test_odd_rows(spark):
    got = sorted(map(tuple, ngram_join.join(documents(spark, ODD)).collect()), key=repr)
    assert len(got) == len(ODD)
    assert [g for g in got if g[0] == 6] == [(6, 6, 6, 1)] * 2
    assert [g for g in got if g[0] is None] == [(None, None, None, 0)]
    assert ngram_join.join(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = corpus() + ODD
    kept = ngram_join.keep_one(plain_documents(spark, rows))
    assert kept.columns == plain_documents(spark, []).columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for i, c, _ in brute([r for r in rows if r[0] is not None])} | {None}
    assert sorted(ids, key=repr) == sorted(want, key=repr)


def test_posterior_bound():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert all(a < b for a, b in zip(least.values(), list(least.values())[1:], strict=False))
    p = np.random.default_rng(1).random(400_000)  # the prior
    n = 32
    m = np.random.default_rng(2).binomial(n, p)
    assert not (p[m < least[n] - 1] >= 0.8).any()


def test_pairs_just_above_the_threshold(spark):
    # pairs of 200 to 400 words of which some are replaced at the end, so that their similarity is 0.80 to 0.85
    r, rows, near = random.Random(11), [], set()
    for i in range(300):
        w = [f"w{i}x{k}" for k in range(r.randrange(200, 400))]
        n = len(w) - 4
        common = next(c for c in range(n, 0, -1) if c / (2 * n - c) <= r.uniform(0.801, 0.85))
        rows += [(2 * i, " ".join(w), "s"), (2 * i + 1, " ".join(w[: common + 4] + [f"v{i}x{k}" for k in range(n - common)]), "s")]
        if 10 * common >= 8 * (2 * n - common):
            near.add(2 * i)
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.join(documents(spark, rows)).collect()}
    found = {i for i in near if got[i + 1] == i}
    assert len(near) >= 290 and len(found) >= 0.99 * len(near)
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_one_large_group_of_all_lengths(spark):
    # a chain in which every text is a little longer than the one before: many classes, all in one component
    w = sentence(4, 900).split()
    rows = [(i, " ".join(w[: 100 + 6 * i]), "s") for i in range(130)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(documents(spark, rows), block=16).collect())
    assert got == brute(rows)
