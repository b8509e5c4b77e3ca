"""The prefix trie against a brute-force one, for blocks of every size."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pagewright.llm import prefix_trie
from pagewright.llm.queries import ORACLES, QUERIES

from ..compare import same


def identity(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]


def brute(rows):
    turns = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            turns[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, identity(r["role"], r["text"]), (r["role"] or "", r["text"] or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if len(made[c]) == len(k)).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(children[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def nodes(df, cells):
    rows = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), cells).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def odd_rows():
    """Families, copies, prefixes of others, ties and nulls, ids below zero, and a conversation of many turns."""
    r = random.Random(3)
    rows = []
    for c in range(200):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * 7 - 50, r.choice([t, t, None]) if c % 5 == 0 else t, r.choice(["u", None]), r.choice(["x", "y", ""]) if r.random() < 0.4 else "same"))
    rows += [(None, 1, "u", "x"), (3, None, None, None), (3, 0, "u", "x"), (3, 0, "u", "x")]
    rows += [(1000 + k, t, "u", "copy") for k in range(150) for t in range(4)]
    return rows + [(5000, t, "u", f"turn {t % 3}") for t in range(600)] + [(5001, t, "u", f"turn {t % 3}") for t in range(590)]


@pytest.mark.parametrize("cells", [1_000_000, 300, 12, 1])
def test_against_brute_force(spark, cells):
    d = spark.createDataFrame([(*x, 1) for x in odd_rows()], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    assert nodes(d, cells) == brute(d.collect())


def test_no_rows(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert nodes(d, 100) == []
    assert nodes(spark.createDataFrame([(None, 1, "u", "x")], d.schema), 100) == []


def test_turns_that_all_come_from_the_family(spark):
    """A conversation may be rebuilt without turns; it is a member of the root."""
    rows = [(c, 0, "u", f"t{c}") for c in (100, 101, 102, 103, 250, 251)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(d, 100) == brute(d.collect())
    assert any(r[1] == 0 and r[3] == 6 for r in nodes(d, 2))


def test_long_texts_do_not_travel(spark):
    d = spark.createDataFrame([(c, t, "u", "x" * 3_000_000) for c in (1, 2) for t in (0, 1)], "conv_id long, turn long, role string, text string")
    assert nodes(d, 100) == brute(d.collect())


def test_query_and_sql(spark, sf_dir):
    want = brute(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    assert sorted(tuple(-1 if v is None else v for v in r) for r in QUERIES["op12_prefix_trie"](spark, sf_dir).collect()) == want
    same(QUERIES["op12_prefix_trie"](spark, sf_dir), ORACLES["op12_prefix_trie"], sf_dir)
