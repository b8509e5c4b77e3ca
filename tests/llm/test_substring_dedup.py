import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import substring_dedup as dedup

from .helpers import ODD, documents, sentence, words


def brute(rows, window=13):
    owner, out = {}, []
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                owner[key] = min(owner.get(key, i), i)
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(5)
    passages = [sentence(1000 + i, n) for i, n in enumerate((12, 13, 14, 20, 60, 200, 30))] + ["la " * 40, "a b " * 25]
    rows = []
    for i in range(120):
        parts = [sentence(i, r.randrange(40))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages).split()
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "changed"
            at = r.randrange(len(p))
            parts += [" ".join(p[at:] if r.random() < 0.3 else p), sentence(7000 + i * 10, r.randrange(9))]
        rows.append((r.randrange(10_000) if i % 17 else i, " ".join(parts), "s"))
    return rows + [(20_000 + i, rows[3][1], "s") for i in range(30)]


def test_against_brute_force(spark):
    rows = ODD + corpus()
    got = sorted(map(tuple, dedup.dedup(documents(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 1000


def test_empty_table(spark):
    assert dedup.dedup(documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=4, max_size=25), min_size=1, max_size=6))
def test_automaton_finds_first_owners(texts):
    automaton, first = dedup.Automaton(), {}
    for owner, t in enumerate(texts):
        for k in range(len(t) - 3):
            first.setdefault(tuple(t[k : k + 4]), owner)
        assert automaton.add(t, owner, 4) == [first[tuple(t[k : k + 4])] for k in range(len(t) - 3)]


def test_query_over_whole_table(spark, sf_dir):
    from pagewright.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"], "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows))
    assert sorted(map(tuple, QUERIES["op5_substring_dedup"](spark, sf_dir).collect())) == want


def test_frequent_anchors_make_no_automaton(spark):
    # one passage in each text, every time with other words around it: its anchors have a segment for each text
    rows = corpus() + [(30_000 + i, f"{sentence(9000 + i, 20)} {sentence(77, 15)} {sentence(9500 + i, 20)}", "s") for i in range(60)]
    for shard in (0, 8):
        assert sorted(map(tuple, dedup.dedup(documents(spark, rows), shard=shard).collect()), key=repr) == brute(rows)
