"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed ranges of code points that take two columns.
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}\x{20000}-\x{3FFFD}]"
#: Fixed ranges of code points that count as Chinese, Japanese or Korean ideographs.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
#: Characters of Windows-1252 beyond Latin-1, and the bytes that they stand for, in order.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = bytes([0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]).decode("latin-1")


def strip(s: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def lstrip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def leading_number(s: Column) -> Column:
    """The ASCII digits that s begins with, as a number up to 2**32 - 1; else null."""
    n = F.regexp_extract(s, "^[0-9]+", 0).try_cast("bigint")
    return F.when(n <= 4294967295, n)


def strip_line_number(s: Column, n: Column) -> Column:
    prefix = n.cast("string")
    return F.when(s.startswith(prefix), lstrip(F.substr(s, F.length(prefix) + 1))).otherwise(s)


def lpad_number(n: Column, width: Column) -> Column:
    s = n.cast("string")
    return F.lpad(s, F.greatest(width.cast("int"), F.length(s)), " ")


def display_width(s: Column) -> Column:
    return (F.char_length(s) + F.regexp_count(s, F.lit(WIDE))).cast("int")


def cjk_score(s: Column) -> Column:
    return F.regexp_count(s, F.lit(CJK)).cast("int")


def csv_escape(s: Column) -> Column:
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def repair_mojibake(s: Column) -> Column:
    """UTF-8 text that was read as Windows-1252, read rightly; s itself unless that finds more ideographs."""
    latin = F.translate(s, CP1252, CP1252_BYTES)
    fits = ~latin.rlike(r"[^\x{00}-\x{FF}]")
    fixed = F.try_validate_utf8(F.encode(F.when(fits, latin), "ISO-8859-1").cast("string"))
    return F.when(fixed.isNotNull() & (cjk_score(fixed) > cjk_score(s)), fixed).otherwise(s)


def sanitize_name(s: Column, fallback: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_-]", "-"), "^-+|-+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit(fallback))


def display_name(name: Column, accuracy: Column) -> Column:
    return F.format_string("%s (%d%%)", name, F.round(accuracy * 100).cast("int"))


def finetuned_name(base: Column, dataset: Column) -> Column:
    return F.concat(base, F.lit("-"), dataset, F.lit("-finetuned"))
