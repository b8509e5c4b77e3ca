"""Queries of the subpackage against their SQL, and brute-force versions where SQL has none."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.llm import decontamination, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, url_filters
from pagewright.llm.queries import ORACLES, QUERIES

from ..compare import same
from .helpers import ODD, documents, plain_documents, sentence, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


# mixing


def test_targets_are_filled_by_weight(spark):
    rows = [(i, sentence(i, 20), "big") for i in range(300)] + [(1000 + i, sentence(i, 20), "mid") for i in range(100)] + [(2000 + i, sentence(i, 20), None) for i in range(10)]
    got = mixing.take(documents(spark, rows)).collect()
    size, target = Counter(), {}
    for r in got:
        size[r["mix_source"]] += r["taken"]
        target[r["mix_source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert target[None] == 400 and sum(target.values()) == pytest.approx(1.5 * 8200)
    assert all(abs(size[s] - target[s]) <= 40 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.take(documents(spark, rows)).collect()))


def test_mix_keeps_columns_and_order(spark):
    rows = [(i, sentence(i, 5 + i % 30), "ab"[i % 2]) for i in range(80)]
    docs = plain_documents(spark, rows)
    out = mixing.mix(docs, partitions=3)
    assert out.columns == [*docs.columns, "mix_finish", "mix_copy"]
    finish = [r["mix_finish"] for r in out.collect()]
    assert finish == sorted(finish)
    taken = sum(r["taken"] for r in mixing.take(docs).collect())
    assert sum(len(words(r["text"])) for r in out.collect()) == taken


def test_mixing_odd_rows(spark):
    got = mixing.take(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.take(documents(spark, [])).count() == 0
    assert mixing.mix(plain_documents(spark, [])).count() == 0
    assert mixing.take(documents(spark, [(1, None, None), (2, "", "a")])).count() == 2


# URLs


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.DOTALL)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):], re.DOTALL)[0]


def best_rule(host, path):
    fits = [r for r, _ in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://example.com/enx", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "ftp://x.net/fr", "no scheme", None, "", "://", "http://", "http://h?x/en/", "http://h#://a", "http://a.org/b://c/d", "http://u.org/\n/x", "http://É.Net/es/", "x://y" + "z" * 5000]


def test_urls_against_brute_force(spark, sf_dir):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(3, URLS[3], 1)], "page_id long, url string, host int")
    got = url_filters.judge(pages, url_filters.labelled_urls(spark)).collect()
    assert len(got) == len(URLS) + 1
    verdicts = dict(url_filters.RULES)
    for r in got + QUERIES["op7_url_filters"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "page_id").collect():
        url = r["url"] if "url" in r else URLS[r["page_id"]]
        assert (r["host"], r["path"]) == parts(url)
        assert r["rule"] == best_rule(r["host"], r["path"])
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
    assert url_filters.judge(pages.limit(0), url_filters.labelled_urls(spark)).count() == 0


def test_url_regression_learns(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'news'}{i}.org/{'win-cash' if i % 2 else 'article'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = url_filters.parts(pages).filter("page_id < 100").selectExpr("host", "path", "page_id % 2 as label")
    got = url_filters.judge(pages.filter("page_id >= 100"), labelled).collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got) >= 98


# decontamination


def test_decontamination_odd_rows_and_blocks(spark):
    items = [("i1", sentence(1, 25)), ("i2", "Short Item!"), ("i2", "short item"), (None, sentence(2, 12)), ("i4", ""), ("i5", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = ODD + [(50, "x " + sentence(1, 25).upper() + " y", "s"), (51, " ".join(sentence(1, 25).split()[3:12]), "s"), (52, "a SHORT, item? short item", "s"), (53, sentence(2, 12), "s"), (53, sentence(2, 12), "s")]
    got = decontamination.find(documents(spark, rows), bench).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert (len(by[50]["hits"]), by[50]["items"]) == (25, ["i1"]) and by[51]["hits"] == []
    assert by[52]["hits"] == [1, 2, 3, 4] and by[52]["items"] == ["i2"] and by[53]["items"] == ["null"]
    blocks = {r["doc_id"]: r for r in decontamination.find(documents(spark, rows), bench, block_windows=13).collect()}
    assert all(blocks[i][c] == by[i][c] for i in by for c in ("n_words", "hits", "items"))
    kept = sorted(r["doc_id"] or -1 for r in decontamination.clean(plain_documents(spark, rows), bench).collect())
    assert kept == sorted((r[0] or -1) for r in rows if r[0] not in (50, 52, 53))
    assert decontamination.clean(plain_documents(spark, rows), bench, block_windows=13).count() == len(kept)
    assert decontamination.find(documents(spark, rows), bench.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontamination.find(documents(spark, []), bench).count() == 0


# quality rules


def test_rules_on_odd_rows(spark):
    rows = ODD + [(60, " ".join(["a b c d e f g h"] * 5), "s"), (61, "x\n\nx\ny\nx", "s")]
    got = {r["doc_id"]: r for r in quality_rules.ledger(documents(spark, rows)).collect()}
    assert got[2]["measured"]["n_words"] == 0 and got[6]["measured"]["n_repeat_words"] == 3000
    assert got[60]["measured"]["n_repeat_words"] == 40 and got[61]["measured"]["n_dup_lines"] == 2
    assert quality_rules.ledger(documents(spark, [])).count() == 0
    docs = plain_documents(spark, rows)
    assert quality_rules.apply_policy(docs, "base").columns == docs.columns


def test_ablation_counts(spark, sf_dir):
    led = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("fail_bits").collect()
    bits = [r["fail_bits"] for r in led]
    frame = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    for r in quality_rules.ablation(frame, "v1").collect():
        bit, mask = 1 << [n for n, _ in quality_rules.RULES].index(r["rule"]), quality_rules.mask("v1")
        assert (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    kept = QUERIES["op9_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in kept if r["quality"] == 1 and not r["base_failed"]]
    poor = [r["kept"] for r in kept if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(poor) <= 0.2 * len(poor)


# quality classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = labels.select("doc_id", quality_classifier.grade(labels["quality"], labels["toxic"]).alias("grade"))
    model = quality_classifier.train(docs, rated.filter("doc_id % 5 <> 2"))
    got = quality_classifier.score(docs, model).join(rated.filter("doc_id % 5 = 2"), "doc_id").collect()
    share = lambda g: sum(r["kept"] for r in got if r["grade"] == g) / sum(r["grade"] == g for r in got)
    assert share(2) >= 0.98 and share(0) <= 0.15 and share(1) <= 0.1
    assert all(0 <= r["p_tail"] <= r["expected_grade"] <= 2 for r in got)


def test_classifier_odd_rows(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality_classifier.train(docs, none)
    assert quality_classifier.score(docs, model).filter("kept").count() == len(ODD)
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    two = spark.createDataFrame([(1, 0), (3, 2), (6, 1), (None, 1), (7, None)], "doc_id long, grade int")
    assert quality_classifier.score(docs, quality_classifier.train(docs, two)).count() == len(ODD)


# language model


def lm_rows():
    return ODD + [(100 + i, sentence(i % 40, 5 + i % 50).title(), "s") for i in range(150)]


def test_base_scores_against_brute_force(spark):
    rows = lm_rows()
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [" "]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(documents(spark, rows)).collect()
    want = sorted(((i, held(i), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 6)) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want


def test_rare_words_score_as_frequent_ones(spark):
    docs = documents(spark, lm_rows())
    few, all_of_them = (sorted((str(r["doc_id"]), round(r["score"], 6), r["n_known"]) for r in lm_scoring.score(docs, heavy=h).collect()) for h in (5, 100_000))
    assert few == all_of_them


def seatings(model):
    """customers and tables by context, tables by pair key, probability by word."""
    contexts, pairs, p = Counter(), {}, {}
    for r in model.seats.collect():
        if r["kind"] == lm_scoring.CONTEXTS:
            for u, _, t in zip(*lm_scoring.unpack(bytes(r["payload"]), "u8 i8 f8"), strict=True):
                contexts[int(u)] += float(t)
        elif r["kind"] == lm_scoring.PAIRS:
            for k, c, t in zip(*lm_scoring.unpack(bytes(r["payload"]), "u8 i8 f4"), strict=True):
                pairs[int(k)] = (int(c), float(t))
    for r in model.answers.collect():
        for w, _, x in zip(*lm_scoring.unpack(bytes(r["payload"]), "u8 i8 f8"), strict=True):
            p[int(w)] = float(x)
    return contexts, pairs, p


@pytest.mark.parametrize(("bits", "hot"), [(0, False), (2, True)])
def test_scores_against_brute_force_given_seats(spark, bits, hot):
    import numpy as np
    import xxhash

    rows = lm_rows()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    low = lambda t: [xxhash.xxh64_intdigest(re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in words(t)] + [int(lm_scoring.END)]
    none = np.empty(0, np.uint64)
    frequent = np.sort(np.array([lm_scoring.END, xxhash.xxh64_intdigest(sentence(3, 9).split()[0])], np.uint64))
    shards = lm_scoring.Shards(bits, frequent if hot else none, np.array([4, 3], np.uint64) if hot else none)
    docs = documents(spark, rows)
    model = lm_scoring.learn(docs.select("text", (~lm_scoring.held_out(lm_scoring.F.col("doc_id"))).alias("learn")), shards=shards)
    tables, pairs, p = seatings(model)
    c, of, by = Counter(), Counter(), {}
    for i, t, _ in rows:
        if not held(i):
            for u, w in zip([int(lm_scoring.END), *low(t)], low(t), strict=False):
                c[u, w] += 1
                of[u] += 1
    key = lambda u, w: int(lm_scoring.pair_keys(np.array([u], np.uint64), np.array([w], np.uint64))[0])
    d, total = model.discount, Counter()
    for (u, w), n in c.items():
        stored = pairs.get(key(u, w), (1, 1.0))
        assert stored[0] == n and 1 <= stored[1] <= n
        total[u] += stored[1]
        by[u, w] = stored
    assert all(tables[u] == pytest.approx(total[u], abs=1e-3) for u in of)
    vocabulary = {w for _, w in c}
    unknown = float(model.root.p(np.zeros(1), np.zeros(1))[0])
    assert sum(p[w] for w in vocabulary) + unknown == pytest.approx(1.0, abs=1e-9)

    def log_p(u, w):
        n, t = by.get((u, w), (0, 0.0))
        return math.log10((n - d * t + (lm_scoring.STRENGTH + d * tables[u]) * p.get(w, unknown)) / (lm_scoring.STRENGTH + of[u]))

    want = sorted((str(i), sum(log_p(u, w) for u, w in zip([int(lm_scoring.END), *low(t)], low(t), strict=False))) for i, t, _ in rows)
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm_scoring.score(docs, shards=shards).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5)


def test_contexts_over_several_shards_are_seated_as_in_one(spark):
    """Totals of contexts that are spread follow the sweeps: the same tables, within sampling error, as in one shard."""
    import numpy as np
    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("text", F.lit(True).alias("learn"))
    common = [r["w"] for r in docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(3).collect()]
    u = np.sort(np.array([lm_scoring.END, *[xxhash.xxh64_intdigest(w) for w in common]], np.uint64))
    none = np.empty(0, np.uint64)
    one = seatings(lm_scoring.learn(docs, shards=lm_scoring.Shards(0, none, none)))[0]
    apart = seatings(lm_scoring.learn(docs, shards=lm_scoring.Shards(2, u, np.full(len(u), 4, np.uint64))))[0]
    for context in u.tolist():
        assert one[context] > 50
        assert apart[context] == pytest.approx(one[context], rel=0.03, abs=4)


def test_words_of_a_batch_are_hashed_as_one_by_one():
    import pyarrow as pa
    import xxhash

    from pagewright.llm import common

    odd = ["", "a", "Ab", "\u00e9t\u00e9", "\U0001f600", "x" * 31, "y" * 32, "z" * 5000, "a"]
    assert common.word_hashes(pa.array(odd)).tolist() == [xxhash.xxh64_intdigest(w) for w in odd]
    assert common.word_hashes(pa.array(odd).slice(2, 4)).tolist() == [xxhash.xxh64_intdigest(w) for w in odd[2:6]]
    assert len(common.word_hashes(pa.array([], pa.string()))) == 0


def test_pairs_of_a_batch_are_dealt_by_distinct_words(monkeypatch):
    """Shards and frequent contexts are found once for each word of a batch, however many pairs it has."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    texts = [" ".join(f"{a} w{(7 * i + k) % 50}" for k in range(40) for a in ("The", "the", "THE")) for i in range(20)] + ["", None, "the"]
    hashes = lambda t: [xxhash.xxh64_intdigest(w.lower()) for w in (t or "").split()] + [int(lm_scoring.END)]
    the = xxhash.xxh64_intdigest("the")
    hot = np.sort(np.array([the, lm_scoring.END], np.uint64))
    shards = lm_scoring.Shards(3, hot, np.array([5, 3], np.uint64))
    searched, look = [], lm_scoring.looked_up
    monkeypatch.setattr(lm_scoring, "looked_up", lambda keys, wanted, *a, **b: searched.append(len(wanted)) or look(keys, wanted, *a, **b))
    pair, n, own, distinct, u, w = lm_scoring._batch_pairs(pa.array(texts, pa.string()), shards)
    want = [p for t in texts for p in zip([int(lm_scoring.END), *hashes(t)], hashes(t), strict=False)]
    assert n.tolist() == [len(hashes(t)) for t in texts]
    assert [(int(distinct[u[p]]), int(distinct[w[p]])) for p in pair] == want
    assert len(u) == len(set(want)) > 2 * len(distinct) and searched == [len(distinct)]
    order = list(zip(own.tolist(), u.tolist(), w.tolist(), strict=True))
    assert order == sorted(order)

    def shard(a, b):
        home = int(lm_scoring.mixed(np.array([a], np.uint64))[0]) % 8
        key, at = int(lm_scoring.pair_keys(np.array([a], np.uint64), np.array([b], np.uint64))[0]), hot.tolist()
        return (home + (key >> 20) % int(shards.spread[at.index(a)])) % 8 if a in at else home

    assert own.tolist() == [shard(int(distinct[a]), int(distinct[b])) for a, b in zip(u, w, strict=True)]


def test_seats_are_those_of_the_restaurant():
    import numpy as np

    new, d, n, rng = 3.0, 0.6, 300, np.random.default_rng(1)
    got = lm_scoring.seat(np.full(20_000, n), np.full(20_000, new), d, rng)
    one = np.ones(20_000)
    for k in range(1, n):  # one customer at a time
        one += rng.random(20_000) < new / (new + k - d * one)
    assert got.mean() == pytest.approx(one.mean(), rel=0.02) and got.std() == pytest.approx(one.std(), rel=0.04)
    assert (lm_scoring.seat(np.array([0, 1]), np.ones(2), d, rng) == [0, 1]).all()


def test_model_beats_the_base_on_held_out_texts(spark):
    got = [r for r in QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm_scoring.score(documents(spark, [])).count() == 0


def test_contexts_are_told_apart(spark):
    # many contexts, each followed by a word of its own
    rows = [(i, " ".join(f"c{k} w{k}" for k in range(i % 9, 200, 3)), "s") for i in range(60)]
    held = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2)
    right, wrong = " ".join(f"c{k} w{k}" for k in range(0, 200, 3)), " ".join(f"c{k} w{(k + 3) % 198}" for k in range(0, 198, 3))
    train = plain_documents(spark, [r for r in rows])
    got = {r["doc_id"]: r for r in lm_scoring.score(documents(spark, [(held, right, "s"), (held + 7000, wrong, "s")]), train).collect()}
    assert got[held]["perplexity"] < 10 and got[held + 7000]["perplexity"] > 5 * got[held]["perplexity"]


def test_blocks_keep_repeated_rows(spark):
    bench = spark.createDataFrame([(f"i{i}", sentence(i, 25)) for i in range(6)], "item_id string, text string")
    rows = ODD + [(50, "x " + sentence(1, 25) + " y", "s"), (50, "x " + sentence(1, 25) + " y", "s"), (None, sentence(2, 12), "s"), (None, sentence(2, 12), "s")]
    one, many = (sorted(map(str, decontamination.find(documents(spark, rows), bench, block_windows=n).collect())) for n in (1000, 40))
    assert len(many) == len(rows) and one == many


def test_one_long_item_is_dealt_into_blocks(spark):
    bench = spark.createDataFrame([("long", sentence(3, 200))], "item_id string, text string")
    blocks = [len(b) for b in decontamination._blocks(bench, 50, 10)]
    assert len(blocks) == 4 and sum(blocks) == 191 and max(blocks) < 100


def test_a_nul_does_not_end_the_host(spark):
    urls = ["http://net\0.evil.org/es/x", "http://\0/es/x", "http://A\0.net/es/x\0y"]
    got = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filters.labelled_urls(spark)).collect()
    for r in got:
        assert (r["host"], r["path"]) == parts(urls[r["page_id"]]) and r["rule"] == best_rule(r["host"], r["path"])


def test_mix_gives_the_words_that_take_says(spark):
    rows = ODD + [(None, sentence(1, 20), "a") for _ in range(100)] + [(None, sentence(i, 20), "a") for i in range(50)]
    rows += [(7, sentence(7, 9), "b") for _ in range(9)] + [(7, sentence(8, 9), "b") for _ in range(4)] + [(i, sentence(i, 9), None) for i in range(30)]
    docs = documents(spark, rows)
    took = mixing.take(docs).collect()
    for ordered in (True, False):
        out = mixing.mix(docs, ordered=ordered).collect()
        size, want = Counter(), Counter()
        for r in out:
            size[r["doc_id"], r["source"]] += len(words(r["text"]))
        for r in took:
            want[r["doc_id"], r["mix_source"]] += r["taken"]
        assert size == +want
        assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, ordered=ordered).collect()))


def test_url_regression_against_brute_force(spark):
    from pyspark.ml.feature import HashingTF

    labelled, hashing = url_filters.labelled_urls(spark), HashingTF(numFeatures=url_filters.FEATURES)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    model = url_filters.train(labelled)
    rows = labelled.collect()
    got = {(r["host"], r["path"]): r["p_block"] for r in model.p_block(labelled).collect()}
    assert sum((got[r["host"], r["path"]] >= 0.5) == (r["label"] == 1) for r in rows) >= 0.98 * len(rows)
    w, b = model.model.coefficients.toArray(), model.model.intercept
    for r in model.p_block(url_filters.parts(pages)).collect():
        grams = [m + full[i : i + 3] for m, full in (("h", f"^{r['host']}$"), ("p", f"^{r['path']}$")) for i in range(max(1, len(full) - 2))]
        assert r["p_block"] == pytest.approx(1 / (1 + math.exp(-b - sum(w[hashing.indexOf(x)] for x in grams))), abs=1e-9)


def test_classifier_takes_every_feature_and_bounds_the_sample(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20_000)) if i == 0 else f"{'good' if i % 2 else 'bad'} word{i} text", "s") for i in range(40)]
    docs = documents(spark, rows)
    rated = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(40)], "doc_id long, grade int")
    assert len(quality_classifier.features(rows[0][1].encode())) > 19_000
    assert quality_classifier.train(docs, rated).seen == 40
    assert quality_classifier.train(docs, rated, cells=10_000).seen < 40
    kept = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, quality_classifier.train(docs, rated)).collect()}
    assert all(kept[i] == (i % 2 == 1) for i in range(1, 40))


def test_fit_against_a_dense_fit():
    import numpy as np

    r = np.random.default_rng(5)
    x = (r.random((300, 12)) < 0.3).astype(float)
    true = x @ r.normal(0, 2, 12) + r.logistic(size=300)
    grades = np.digitize(true, np.quantile(true, [0.3, 0.7]))
    l1 = 1e-3

    def loss(w, cuts):
        below = np.column_stack([np.zeros(300), *[1 / (1 + np.exp(x @ w - c)) for c in cuts], np.ones(300)])
        return -np.log(np.maximum(below[np.arange(300), grades + 1] - below[np.arange(300), grades], 1e-12)).mean() + l1 * np.abs(w).sum()

    at, step = np.concatenate([np.zeros(12), [-0.8, 0.8]]), 0.5
    for _ in range(4000):  # coordinate-wise pattern search: plain, dense, no gradient
        best = min((loss(t[:12], t[12:]), k) for k, t in enumerate(at + s * step * np.eye(14)[j] for j in range(14) for s in (1, -1)))
        if best[0] >= loss(at[:12], at[12:]):
            step /= 2
            if step < 1e-5:
                break
        else:
            at = at + (1 if best[1] % 2 == 0 else -1) * step * np.eye(14)[best[1] // 2]
    model = quality_classifier.fit([np.nonzero(row)[0].astype(np.int32) for row in x], grades, rounds=3000, l1=l1, least_docs=1)
    assert loss(model.weights[:12].astype(float), model.thresholds) == pytest.approx(loss(at[:12], at[12:]), abs=2e-3)


def test_texts_of_some_megabytes(spark):
    from pagewright.llm import ngram_join, substring_dedup

    long = " ".join(sentence(i, 2_000) for i in range(250))
    assert len(long) > 2_000_000
    docs = plain_documents(spark, [(1, long, "a"), (2, long + " more", "a"), (3, "", "b"), (4, "y" * 3_000_000, "b"), (5, None, None)])
    bench = spark.createDataFrame([("i", sentence(7, 12))], "item_id string, text string")
    assert sum(len(words(r["text"])) for r in mixing.mix(docs).collect()) == sum(r["taken"] for r in mixing.take(docs).collect())
    assert {r["doc_id"]: len(r["hits"]) > 0 for r in decontamination.find(docs, bench).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {r["doc_id"]: r["class_id"] for r in ngram_join.join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed").collect()} == {1: 500_000, 2: 1, 3: 0, 4: 1, 5: 0}
    assert quality_rules.ledger(docs).filter("measured.n_words >= 500000").count() == 2
    assert lm_scoring.score(docs).filter("n_tokens > 500000").count() == 2
    assert quality_classifier.score(docs, quality_classifier.train(docs, spark.createDataFrame([(1, 0), (4, 2)], "doc_id long, grade int"))).count() == 5


INTERNAL = ["_key", "_mix", "_mix_key", "_mix_id", "_mix_copies", "_mix_no", "_more_key", "_more_id", "_no", "Measured", "fail_bits", "_kept", "_more", "size", "finish", "row", "_key_0"]


def test_columns_of_any_name_keep_their_values(spark):
    """Operators that hand rows on: a column of an internal name comes out as it went in."""
    rows = [(i, sentence(i % 4, 60), "en", "ab"[i % 2], 9, *[f"{i} {c}" for c in INTERNAL]) for i in range(8)]
    d = spark.createDataFrame(rows + [rows[3]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INTERNAL))
    for out in (mixing.mix(d), quality_rules.apply_policy(d), ngram_join.keep_one(d)):
        got = out.collect()
        assert got and all(r[c] == f"{r['doc_id']} {c}" for r in got for c in INTERNAL)
        assert out.columns[: len(d.columns)] == d.columns
