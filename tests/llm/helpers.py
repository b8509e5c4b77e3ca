"""Odd rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns."""

import random
import re

ODD = [
    (1, "", "a"), (2, None, None), (3, "word", "b"), (None, "null id with some words", "a"),
    (4, " \t\n lead  and trail \r\n", "b"), (5, "x" * 5000, None), (6, "la " * 3000, "a"), (6, "la " * 3000, "a"),
    (7, "Émile Zola said: don't!! <|endoftext|> STOP, stop. ́accent \U0001f600 1234", "b"),
    (8, "İstanbul ΣΑΣ ŉ ﬁ ½ naïve é 12,5. the, of. A.B.", "a"), (9, "a\x0bb\x0cc\x1cd e", "a"),
]
_vocabulary = ["".join(random.Random(i).choices("abcdefgh", k=1 + i % 7)) for i in range(400)]


def sentence(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(_vocabulary, k=n))


def documents(spark, rows):
    """documents with an extra column whose name clashes with the operators' own."""
    made = [(i, t, "en", s, len(t or ""), 1) for i, t, s in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, size int").drop("size").withColumnRenamed("n_chars", "n_words")


def plain_documents(spark, rows):
    made = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
