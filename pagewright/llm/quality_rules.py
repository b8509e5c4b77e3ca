"""Quality rules as a bitmask ledger, with DataFrame operations only.

Every rule is evaluated once; a row keeps its measurements and one bit for each rule that it fails. Policies are
masks over these bits, so a new policy or an ablation needs no text again: it is bitwise work on small integers.

A narrow projection: no shuffle at any size. The text of a row is measured by array functions in its own row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, aside, let

WINDOW = 8

#: (name, failed): in order of their bits. Rules see the measurements only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("dup_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
#: Masks by version: bit i set means that failing rule i rejects the document.
POLICIES = {"base": ["few_words", "repeated_words"], "v1": [name for name, _ in RULES]}


def mask(policy: str | list[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` consecutive words found twice or more among these words.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes, within one text."""
    def starts(s: Column) -> Column:
        same = lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(let(pairs, starts), covered))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(window)))))
    return F.when(F.size(words) <= window, 0).otherwise(let(windows, count)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """docs with a struct `measured`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    A null text measures 0 in all. Lines are what `\\n` splits; those without a word don't count. A column of that
    name in docs is replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    both = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    return docs.withColumn("measured", let(F.struct(both.alias("a"), counted.alias("b"), chars.alias("c"), symbols.alias("s")), lambda m: F.struct(m["a"]["n_words"].alias("n_words"), m["c"].alias("word_chars"), m["s"].alias("n_symbols"), m["b"]["n_lines"].alias("n_lines"), m["b"]["n_dup_lines"].alias("n_dup_lines"), m["a"]["n_repeat_words"].alias("n_repeat_words"))))


def ledger(docs: DataFrame) -> DataFrame:
    """docs with `measured` and `fail_bits` (long): bit i is set where rule i fails."""
    m = measure(docs)

    def bits(x: Column) -> Column:
        tests = []
        for i, (_, failed) in enumerate(RULES):
            tests.append(F.when(_rule(failed, x), F.lit(1 << i)).otherwise(F.lit(0)))
        return reduce(lambda a, b: a.bitwiseOR(b), tests).cast("long")

    return m.withColumn("measured", let(F.col("measured"), lambda x: F.struct(x.alias("m"), bits(x).alias("f")))).withColumns({"fail_bits": F.col("measured.f"), "measured": F.col("measured.m")})


_NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _rule(text: str, x: Column) -> Column:
    """The rule's comparison over the fields of x: terms `a * name` or numbers, joined by `and`."""
    found = None
    for part in text.split(" and "):
        left, sign, right = next((part.partition(f" {s} ") for s in (">=", "<", ">") if f" {s} " in part))
        value = lambda t: reduce(lambda a, b: a * b, [x[f] if f in _NAMES else F.lit(int(f)) for f in t.split(" * ")])
        a, b = value(left), value(right)
        one = a >= b if sign.strip() == ">=" else a < b if sign.strip() == "<" else a > b
        found = one if found is None else found & one
    return found


def passes(policy: str | list[str] = "v1") -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(docs: DataFrame, policy: str | list[str] = "v1") -> DataFrame:
    """The documents that the policy keeps, with the columns of docs, whatever their names."""
    docs, columns = aside(docs, "measured", "fail_bits")
    return ledger(docs).filter(passes(policy)).select(*columns)


def ablation(with_bits: DataFrame, policy: str | list[str] = "v1") -> DataFrame:
    """For each rule of the policy: how many rows fail it, fail it alone, and are kept without it. One aggregation
    over distinct bit sets, whatever the number of rules."""
    m, sets = mask(policy), with_bits.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if m >> i & 1]))
    r = sets.withColumn("r", rules).select("fail_bits", "n", "r.rule", "r.bit")
    has, own = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("fail_bits").bitwiseAND(F.lit(m))
    rest = F.col("fail_bits").bitwiseAND(F.lit(m).bitwiseXOR(F.col("bit")))
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return r.groupBy("rule").agg(add(has).alias("n_failed"), add(own == F.col("bit")).alias("n_failed_alone"), add(rest == 0).alias("n_kept_without"))
