"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, chat_format, decontamination, lm_scoring, merkle, mixing, ngram_join, prefix_trie, quality_classifier, quality_rules, substring_dedup, token_output, url_filters
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return led.select("doc_id", *[F.col(f"measured.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op7_url_filters": op7_url_filters,
    "op9_quality_rules": op9_quality_rules,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, ''))), '17')) AS shuffle_key
  FROM documents),
each AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight,
                 row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM each),
full_at AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM named),
level AS (SELECT *, ((SELECT sum(source_size) FROM each)::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY full_at, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM full_at),
targets AS (SELECT source, source_size, CASE WHEN full_at <= level OR x IS NULL THEN cap ELSE weight * x END AS target
  FROM level, (SELECT min_by(level, (full_at, pos)) FILTER (WHERE full_at > level) AS x FROM level)),
timed AS (SELECT doc_id, size, shuffle_key, source_size, target,
    sum(size) OVER (PARTITION BY s.source ORDER BY shuffle_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (source_size * copy + upto)::DOUBLE / target AS finish
  FROM timed, (VALUES (0), (1)) c(copy) WHERE size > 0 AND target > 0),
queue AS (SELECT *, sum(size) OVER (ORDER BY least(floor(finish * 65536), 131072), finish, copy, shuffle_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS words FROM copies),
taken AS (SELECT doc_id, shuffle_key, size, count(*) AS times FROM queue
  WHERE words <= (SELECT sum(size) FROM sized)::DOUBLE * 1.5 GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken
FROM timed LEFT JOIN taken USING (doc_id, shuffle_key, size)
"""

ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM d, unnest(range(1, len(words) - 6)) AS r(i) WHERE len(words) >= 8),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM found, range(0, 8) AS r(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_chats(chat_format.as_streamed(turns)))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read(spark, path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLES["op2_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<|turn|>', '<' || chr(92) || ':|turn|>'), '<|end|>', '<' || chr(92) || ':|end|>'),
    '<s>', '<' || chr(92) || ':s>'), '</s>', '<' || chr(92) || ':/s>'), '[INST]', '[' || chr(92) || ':INST]'), '[/INST]', '[' || chr(92) || ':/INST]') AS escaped FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + 1 + length(escaped) + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES |= {"op2_chat_format": op2_chat_format, "op3_token_output": op3_token_output, "op8_decontamination": op8_decontamination}

ORACLES["op8_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
placed AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
hit AS (SELECT doc_id, item, i, size FROM placed JOIN win USING (size, win)),
n_hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) AS r(k) WHERE k < size GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op5_substring_dedup"] = op5_substring_dedup

ORACLES["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS r(i) WHERE len(w) >= 13),
owner AS (SELECT win, min(doc_id) AS lo FROM win GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN owner USING (win), range(0, 13) AS t(k) WHERE lo < doc_id),
each AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES["op4_ngram_join"] = op4_ngram_join

ORACLES["op4_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(gram, chr(10) ORDER BY gram)) AS whole FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id) AS class_id,
  coalesce((SELECT min(o.doc_id) FROM n o JOIN n own USING (whole) WHERE own.doc_id = d.doc_id), d.doc_id) AS copy_id,
  (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links
FROM d
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = labels.select("doc_id", quality_classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality_classifier.score(docs, quality_classifier.train(docs, rated))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


QUERIES |= {"op6_quality_classifier": op6_quality_classifier, "op10_lm_scoring": op10_lm_scoring}


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    d = bpe_automaton.decode(bpe_automaton.encode(table(spark, sf_dir, "documents"), path), path)
    return d.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES |= {"op11_bpe_automaton": op11_bpe_automaton, "op12_prefix_trie": op12_prefix_trie, "op13_merkle": op13_merkle}

#: CRC-32 of the ASCII text of {0}, as SQL has no such function: by a table of 256 that `crc` makes.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"

ORACLES["op12_prefix_trie"] = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS id FROM t),
c AS (SELECT conv_id, list({{'id': id, 'n': length(text)}} ORDER BY turn NULLS FIRST, id) AS own FROM h GROUP BY conv_id),
n AS (SELECT conv_id, own, CAST({_CRC.format("conv_id")} % 6 AS INT) AS h FROM c, crc),
r AS (SELECT n.conv_id, list_concat(CASE WHEN n.h = 0 THEN [] ELSE coalesce(b.own[1:n.h], []) END, n.own[n.h + 1:]) AS turns FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 100),
m AS (SELECT conv_id, d, md5(array_to_string(list_transform(turns[1:d], lambda x: x.id), ',')) AS k, md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.id), ',')) AS up,
  CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS chars, len(turns) = d AS ending FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
node AS (SELECT d, k, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256 FROM m GROUP BY d, k),
kids AS (SELECT up, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.k),
pairs AS (SELECT DISTINCT a.k AS top, b.k AS k FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM pairs JOIN full_node USING (k) GROUP BY top)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM full_node x JOIN sums ON sums.top = x.k LEFT JOIN full_node p ON p.k = x.up
"""

ORACLES["op13_merkle"] = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, row_number() OVER () AS rid, CASE WHEN coalesce({_CRC.format("coalesce(doc_id, 0)")} % 5 = 0 AND doc_id IS NOT NULL, false)
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents, crc),
e AS (SELECT *, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM d),
leaves AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS now FROM e),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (SELECT 0 AS lv, source, i, n, leaf AS h FROM placed
  UNION ALL SELECT lv + 1, source, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lv, source, i // 16),
subs AS (SELECT source, h, lv, CAST(row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS BIGINT) AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
over_tree AS (SELECT 0 AS lv, i, n, h FROM subs
  UNION ALL SELECT lv + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM over_tree WHERE n > 1 GROUP BY lv, i // 16),
kin AS (SELECT lv, source, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lv, source, i // 16 ORDER BY i)),
over_kin AS (SELECT lv, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM over_tree WHERE n > 1 WINDOW w AS (PARTITION BY lv, i // 16 ORDER BY i)),
steps AS (SELECT p.rid, k.lv, k.l, k.r FROM placed p JOIN kin k ON k.source IS NOT DISTINCT FROM p.source AND k.i = p.i // CAST(pow(16, k.lv) AS BIGINT)
  UNION ALL SELECT p.rid, s.lv + k.lv, k.l, k.r FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source JOIN over_kin k ON k.i = s.i // CAST(pow(16, k.lv) AS BIGINT)),
paths AS (SELECT rid, list({{'l': l, 'r': r}} ORDER BY lv) AS path FROM steps GROUP BY rid),
done AS (SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM over_tree WHERE n = 1) AS root, coalesce(path, []) AS path,
  list_reduce(list_concat([{{'l': p.now, 'r': ''}}], coalesce(path, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN paths USING (rid))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
