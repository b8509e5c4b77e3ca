"""The Merkle manifest against a brute-force one."""

import hashlib
import zlib

import pytest
from pagewright.llm import merkle
from pagewright.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

from ..compare import same
from .helpers import ODD


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return hashed(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.COLUMNS])


def tree(digests, arity):
    """The root and the siblings (left, right) of each digest, from the bottom."""
    paths, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, over = [], []
        for k in range(0, len(digests), arity):
            run = digests[k : k + arity]
            for s in range(len(run)):
                for x in under[k + s]:
                    paths[x].append((run[:s], run[s + 1 :]))
            above.append(hashed(*run))
            over.append(sum(under[k : k + arity], []))
        digests, under = above, over
    return (digests[0] if digests else None), paths


def brute(rows, arity=16):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r.asDict()))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        sources[s].sort(key=lambda t: t[:3])
        trees.append(tree([t[2] for t in sources[s]], arity))
    root, over = tree([r for r, _ in trees], arity)
    out = []
    for s, (subroot, paths), top in zip(names, trees, over, strict=True):
        for (_, _, own, row), path in zip(sources[s], paths, strict=True):
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
                row["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            h = leaf(row)
            for left, right in path + top:
                h = hashed(*left, h, *right)
            out.append((row["doc_id"], own, subroot, root, hashed(*["".join(a + b) for a, b in path + top]), h, h == root))
    return sorted(out, key=repr)


def rows_of(df, arity=16):
    return sorted(map(tuple, merkle.verified(df, arity).collect()), key=repr)


def odd(spark):
    """Ties and nulls in every column, repeated rows, a source with most rows, one with a single row, names by bytes."""
    rows = [(i, t, "en", s, len(t or ""), i, "x") for i, t, s in ODD] * 2
    rows += [(k, f"Text {k % 9}", "en" if k % 4 else None, "hot", k if k % 3 else None, k, "x") for k in range(300)]
    rows += [(k, "Tail", "de", name, 4, k, "x") for k, name in enumerate(["\uffee", "\U0001f600", "Z", "z", ""])]
    rows += [(None, "null id", None, None, None, 0, "x")] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, place long, leaf string")


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_against_brute_force(spark, arity):
    d = odd(spark).repartition(7)
    assert rows_of(d, arity) == brute(d.collect(), arity)


def test_small_tables(spark):
    d = odd(spark)
    assert rows_of(d.limit(0)) == []
    one = d.filter("source = 'Z'")
    assert rows_of(one) == brute(one.collect())
    assert merkle.verified(one).first()["leaf"] == merkle.verified(one).first()["root"]


def test_many_sources(spark):
    d = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"), F.lit(1).alias("n_chars"))
    assert rows_of(d) == brute(d.collect())


def test_any_change_shows(spark):
    d = odd(spark).filter("doc_id is not null")
    roots = {merkle.verified(x).first()["root"] for x in (d, d.withColumn("lang", F.when(F.col("doc_id") == 299, "fr").otherwise(F.col("lang"))), d.filter("doc_id <> 299"))}
    assert len(roots) == 3


def test_query_and_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op13_merkle"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs.collect())
    same(got, ORACLES["op13_merkle"], sf_dir)
