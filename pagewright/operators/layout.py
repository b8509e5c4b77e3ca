"""Operators on regions (page_id, seq, quad, text, ...): gutters, merging, reading order, lines, tables, page text.

Pages are the unit of distribution: each operator needs one exchange by page_id, which those that follow reuse. Folds
whose steps depend on what was gathered so far run over one page's sorted regions inside its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from ..functions import geometry as g
from ..functions import text as t


def of_page():
    return W.partitionBy("page_id")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def _nth(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def upper_median(values: Column, default: float) -> Column:
    """Element n div 2 of the sorted array; the default if it is empty."""
    return F.coalesce(let(F.array_sort(values), lambda a: _nth(a, F.floor(F.size(a) / 2))), F.lit(default))


def _parts(a: Column, starts: Column) -> Column:
    """The array in consecutive parts that begin at the places starts."""
    return F.transform(starts, lambda at, k: F.slice(a, at + 1, F.coalesce(F.get(starts, k + 1), F.size(a)) - at))


def _where(a: Column, new) -> Column:
    """0 and the places i of an array for which new(i) holds."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | new(i))


# gutters and merging


def gutter_candidates(regions: DataFrame) -> DataFrame:
    """Narrow boxes at the left edge that have wider text to their right on the same line. Needs page_w."""
    narrow = regions.filter(g.is_gutter(F.col("quad"), F.col("page_w"), F.col("page_w") * 0.12)).alias("b")
    other = regions.select(F.col("page_id").alias("o_page"), F.col("seq").alias("o_seq"), F.col("quad").alias("o_quad")).alias("o")
    b, o = F.col("b.quad"), F.col("o.o_quad")
    beside = (F.col("b.seq") != F.col("o.o_seq")) & g.shares_line(b, o) & (g.left(o) > g.right(b) + g.quad_height(b) * 0.8) & (g.quad_width(o) > g.quad_width(b) * 1.5)
    return narrow.join(other, (F.col("b.page_id") == F.col("o.o_page")) & beside, "left_semi")


def gutter_right(regions: DataFrame) -> DataFrame:
    """page_id, gutter_right of pages with five candidates or more."""
    q = F.col("quad")
    found = gutter_candidates(regions).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max(g.right(q)).alias("r"), F.avg(g.quad_height(q)).alias("h"), F.first("page_w").alias("w"))
    return found.filter("n >= 5").select("page_id", F.least(F.greatest("r", F.lit(0.0)) + F.col("h") * 0.8, F.col("w") * 0.15).alias("gutter_right"))


def drop_gutter(regions: DataFrame) -> DataFrame:
    both = regions.join(gutter_right(regions), "page_id", "left")
    inside = F.col("gutter_right").isNotNull() & g.is_gutter(F.col("quad"), F.col("page_w"), F.col("gutter_right"))
    return both.filter(~inside).select(*regions.columns)


@F.arrow_udf(ArrayType(IntegerType()))
def _merged_at(left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array, height: pa.Array, aligned: pa.Array) -> pa.Array:
    """Where merged boxes begin among a page's boxes in order: a box joins those gathered last, as one box, by the rule of
    geometry.should_merge."""
    out = []
    for page in zip(*(x.to_pylist() for x in (left, top, right, bottom, height, aligned)), strict=True):
        starts, last = [], None
        for k, (x0, y0, x1, y1, h, straight) in enumerate(zip(*page, strict=True)):
            if last is not None:
                a0, b0, a1, b1, g_, level = last
                mean = (g_ + h) * 0.5
                line = abs((b0 + b1) * 0.5 - (y0 + y1) * 0.5) <= mean * 0.7 or min(b1, y1) - max(b0, y0) >= mean * 0.5
                if level and straight and line and (min(a1, x1) - max(a0, x0) >= mean * 0.4 or x0 - a1 <= mean * 1.2):
                    a0, b0, a1, b1 = min(a0, x0), min(b0, y0), max(a1, x1), max(b1, y1)
                    last = (a0, b0, a1, b1, b1 - b0, True)
                    continue
            starts.append(k)
            last = (x0, y0, x1, y1, h, straight)
        out.append(starts)
    return pa.array(out, pa.list_(pa.int32()))


def merge_regions(regions: DataFrame) -> DataFrame:
    """page_id, seq, quad, det_conf: boxes in order, each joined to the box gathered last if they belong together."""
    pages = drop_gutter(regions).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "quad", F.col("det_conf").cast("double").alias("det_conf")))).alias("_b"))
    of = lambda f: F.transform("_b", lambda x: f(x["quad"]))
    starts = _merged_at(*[of(f) for f in (g.left, g.top, g.right, g.bottom, g.quad_height, g.quad_is_aligned)])
    parts = pages.select("page_id", "_b", starts.alias("_s")).select("page_id", F.posexplode(_parts(F.col("_b"), F.col("_s"))).alias("seq", "_p"))
    edge = lambda f, pick: pick(F.transform("_p", lambda x: f(x["quad"])))
    x0, y0, x1, y1 = edge(g.left, F.array_min), edge(g.top, F.array_min), edge(g.right, F.array_max), edge(g.bottom, F.array_max)
    quad = F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["quad"]).otherwise(g.quad_from_rect(x0, y0, x1 - x0, y1 - y0))
    return parts.select("page_id", F.col("seq").cast("int").alias("seq"), quad.alias("quad"), F.array_max(F.transform("_p", lambda x: x["det_conf"])).alias("det_conf"))


# order and lines


def reading_order(regions: DataFrame) -> DataFrame:
    """regions with band and order_no: by top, a new band where the top lies more than half a mean height (of the two
    boxes) below the one before, then by left."""
    q, by_top = F.col("quad"), of_page().orderBy(g.top(F.col("quad")), g.left(F.col("quad")), "seq")
    prev = F.lag("quad").over(by_top)
    far = g.top(q) - g.top(prev) > (g.quad_height(q) + g.quad_height(prev)) * 0.25
    banded = regions.withColumn("_new", F.coalesce(far, F.lit(False)).cast("int")).withColumn("band", F.sum("_new").over(by_top.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return banded.drop("_new").withColumn("order_no", F.row_number().over(of_page().orderBy("band", g.left(q), "seq")))


def group_lines(regions: DataFrame) -> DataFrame:
    """regions with line_no (from 0): a region starts a line unless it shares one with the region just before."""
    box = F.struct("seq", "quad", F.struct(*regions.columns).alias("row"))
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", box.alias("b")))).alias("_b"))
    lines = pages.select(F.posexplode(_lines_in(F.transform("_b", lambda x: x["b"]))).alias("line_no", "_l"))
    return lines.select("line_no", F.explode("_l").alias("_x")).select("_x.row.*", "line_no")


def join_line(lined: DataFrame) -> DataFrame:
    """page_id, line_no, center_y, height, text of grouped regions: a space only across a wide gap between ASCII
    letters or digits."""
    lines = lined.groupBy("page_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("seq", "quad", "text"))).alias("_l"))
    return lines.select("page_id", "line_no", _line(F.col("_l")).alias("l")).select("page_id", "line_no", "l.*")


def _of_lines(lines: DataFrame) -> DataFrame:
    """page_id, _l: each page's lines in order."""
    return lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "center_y", "height", "text"))).alias("_l"))


def line_pitch(lines: DataFrame, variant: str = "layout") -> DataFrame:
    """page_id, pitch: the median of the lower half of line gaps (upper median for variant `spatial`); without gaps
    the mean height, which for `spatial` is at least page_h / 80."""
    pages = _of_lines(lines)
    if variant == "spatial":
        d = pages.join(lines.groupBy("page_id").agg(F.max("page_h").alias("page_h")), "page_id")
        return d.select("page_id", let(_gap_list(F.col("_l")), lambda gaps: _upper_pitch(gaps, F.greatest(_mean(F.col("_l"), lambda x: x["height"]), F.col("page_h") / 80, F.lit(1.0)))).alias("pitch"))
    return pages.select("page_id", let(F.col("_l"), _pitch).alias("pitch"))


def expand_slots(lines: DataFrame) -> DataFrame:
    """page_id, slot, line_no, k, text: lines with up to 32 empty slots (k > 0) where the next line is far below."""
    slots = _of_lines(lines).select("page_id", "_l", F.posexplode(let(F.col("_l"), _slots)).alias("slot", "_s"))
    line = F.get("_l", F.col("_s.i"))["line_no"]
    return slots.select("page_id", "slot", line.alias("line_no"), F.col("_s.k").alias("k"), F.col("_s.text").alias("text"))


def numbering_start(slots: DataFrame) -> DataFrame:
    """page_id, start: the first line number of pages whose lines carry their numbers. At least three lines must
    agree with it exactly; of several starts the one with most exact, then most near matches, then the first line."""
    slot = F.struct("slot", (F.col("k") == 0).alias("line"), "text")
    pages = slots.groupBy("page_id").agg(F.array_sort(F.collect_list(slot)).alias("_s"))
    return pages.select("page_id", _start(F.col("_s")).alias("start")).filter("start is not null")


def _lines_in(boxes: Column) -> Column:
    """The lines, as arrays, of an array of boxes in order: a box starts one unless it shares it with the box before."""
    new = lambda b: lambda i: ~g.shares_line(F.get(b, i - 1)["quad"], F.get(b, i)["quad"])
    return let(boxes, lambda b: let(_where(b, new(b)), lambda starts: _parts(b, starts)))


def _mean(a: Column, of) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + of(x)) / F.size(a)


def _line(boxes: Column) -> Column:
    """center_y, height and text of one line, as join_line has them."""
    def piece(x: Column, i: Column) -> Column:
        last = F.get(boxes, i - 1)
        wide = g.left(x["quad"]) - g.right(last["quad"]) > (g.quad_height(x["quad"]) + g.quad_height(last["quad"])) * 0.5 * 0.7
        space = wide & last["text"].rlike(r"[A-Za-z0-9]\z") & x["text"].rlike(r"\A[A-Za-z0-9]")
        return F.concat(F.when(space, " ").otherwise(""), t.strip(x["text"]))

    text = F.array_join(F.transform(boxes, piece), "")
    return F.struct(_mean(boxes, lambda x: g.center_y(x["quad"])).alias("center_y"), _mean(boxes, lambda x: g.quad_height(x["quad"])).alias("height"), text.alias("text"))


def _gap_list(lines: Column) -> Column:
    """The positive distances of neighbouring lines, sorted."""
    return F.array_sort(F.filter(F.transform(lines, lambda x, i: x["center_y"] - F.get(lines, i - 1)["center_y"]), lambda v: v > 0))


def _lower_half(gaps: Column) -> Column:
    return F.slice(gaps, F.lit(1), F.greatest(F.ceil(F.size(gaps) / 2).cast("int"), F.lit(1)))


def _blanks(lines: Column, pitch: Column, most: float, least: float) -> Column:
    """Empty lines behind (least 1) each line, by the distance to the next."""
    far = lambda x, i: F.greatest(F.get(lines, i + 1)["center_y"] - x["center_y"], F.lit(0.0)) / pitch
    return F.transform(lines, lambda x, i: F.coalesce(F.least(F.greatest(F.round(far(x, i)), F.lit(least)) - 1, F.lit(most)), F.lit(0.0)).cast("int"))


def _upper_pitch(gaps: Column, default: Column) -> Column:
    upper = let(_lower_half(gaps), lambda low: _nth(low, F.floor(F.size(low) / 2)))
    return F.when(F.size(gaps) > 0, F.greatest(upper, F.lit(1.0))).otherwise(default)


def _pitch(lines: Column) -> Column:
    """The line pitch of a page's lines, as line_pitch has it."""
    middle = lambda a: F.when(F.size(a) % 2 == 0, (_nth(a, F.floor(F.size(a) / 2) - 1) + _nth(a, F.floor(F.size(a) / 2))) * 0.5).otherwise(_nth(a, F.floor(F.size(a) / 2)))
    return let(_gap_list(lines), lambda gaps: F.greatest(F.when(F.size(gaps) > 0, let(_lower_half(gaps), middle)).otherwise(_mean(lines, lambda x: x["height"])), F.lit(1.0)))


def _slots(lines: Column) -> Column:
    """Lines (k 0) with the empty slots behind them (k 1 and on); i is the line's place."""
    slot = lambda k, i, text: F.struct((k == 0).alias("line"), i.cast("int").alias("i"), k.cast("int").alias("k"), text.alias("text"))
    behind = lambda x, i, n: F.transform(F.sequence(F.lit(0), n), lambda k: slot(k, i, F.when(k == 0, x["text"]).otherwise("")))
    return let(_pitch(lines), lambda p: let(_blanks(lines, p, 32.0, 1.0), lambda blanks: F.flatten(F.transform(lines, lambda x, i: behind(x, i, F.get(blanks, i))))))


def _most_voted(numbers: np.ndarray, lines: int) -> int | None:
    """The start that most numbers vote for. numbers: that of each slot, or nan; a number's vote is itself less its slot.
    Exact matches of a start are its votes, near ones also those beside it: look-ups in one sorted histogram."""
    slot = np.nonzero(~np.isnan(numbers))[0]
    if len(slot) < 3 or not (len(numbers) > lines or numbers[slot].max() > lines + 2):
        return None
    start, first, exact = np.unique(numbers[slot].astype(np.int64) - slot, return_index=True, return_counts=True)
    beside = np.diff(start) == 1
    near = exact.copy()
    near[1:] += np.where(beside, exact[:-1], 0)
    near[:-1] += np.where(beside, exact[1:], 0)
    fits = np.nonzero((start >= 0) & (exact >= 3))[0].tolist()
    best = max(fits, key=lambda i: (exact[i], near[i], -slot[first[i]]), default=None)
    return None if best is None else int(start[best])


@F.arrow_udf(LongType())
def _voted(numbers: pa.Array, lines: pa.Array) -> pa.Array:
    pages = zip(numbers, lines.to_pylist(), strict=True)
    return pa.array([_most_voted(n.values.to_numpy(zero_copy_only=False).astype(float), k) for n, k in pages], pa.int64())


def _start(slots: Column) -> Column:
    """The first line number of slots (line, text), as numbering_start has it; null without one."""
    numbers = F.transform(slots, lambda s: F.when(s["line"], t.leading_number(s["text"])))
    return _voted(numbers, F.size(F.filter(slots, lambda s: s["line"])))


def _numbered_text(slots: Column, start: Column) -> Column:
    def line(s: Column, i: Column) -> Column:
        rest = t.strip_line_number(s["text"], start + i)
        width = F.length((start + F.size(slots) - 1).cast("string"))
        with_number = F.concat(t.lpad_number(start + i, width), F.when(F.length(t.strip(rest)) > 0, F.concat(F.lit("  "), t.rstrip(rest))).otherwise(""))
        return F.when(start.isNull(), t.rstrip(s["text"])).otherwise(with_number)

    return F.array_join(F.transform(slots, line), "\n")


def page_text(regions: DataFrame) -> DataFrame:
    """page_id, text: lines in order, blank lines where the page has gaps, line numbers in a column of their own. One
    exchange by page; all else happens in the page's row."""
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "quad", "text"))).alias("_b"))
    slots = let(F.transform(_lines_in(F.col("_b")), _line), _slots)
    pages = pages.select("page_id", slots.alias("_s")).select("page_id", "_s", _start(F.col("_s")).alias("_start"))
    return pages.select("page_id", let(F.col("_s"), lambda s: _numbered_text(s, F.col("_start"))).alias("text"))


def _lines_to_text(d: DataFrame, order: str) -> DataFrame:
    rows = d.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("_l"))
    return rows.select("page_id", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("text"))


# estimators


def char_width(regions: DataFrame) -> DataFrame:
    """page_id, char_width: the upper median of width per character, at least page_w / 160 and 1."""
    per = g.quad_width(F.col("quad")) / F.greatest(F.char_length("text"), F.lit(1))
    d = regions.withColumn("_w", per).groupBy("page_id").agg(F.collect_list(F.when(F.col("_w") > 0, F.col("_w"))).alias("ws"), F.max("page_w").alias("page_w"))
    limit = F.when(F.col("page_w") > 0, F.col("page_w") / 160.0).otherwise(1.0)
    return d.select("page_id", F.greatest(upper_median(F.col("ws"), 10.0), limit, F.lit(1.0)).alias("char_width"))


def median_height(regions: DataFrame) -> DataFrame:
    h = g.quad_height(F.col("quad"))
    d = regions.withColumn("_h", h).groupBy("page_id").agg(F.collect_list(F.when(F.col("_h") > 0, F.col("_h"))).alias("hs"))
    return d.select("page_id", upper_median(F.col("hs"), 1.0).alias("median_height"))


def vertical_dominant(regions: DataFrame) -> DataFrame:
    n, v = F.count(F.lit(1)), F.count_if(F.col("direction") == "Vertical")
    return regions.groupBy("page_id").agg(((n >= 2) & (v * 2 > n)).alias("vertical"))


# spatial text


def spatial_text(regions: DataFrame) -> DataFrame:
    """page_id, text with indents and vertical gaps kept. Needs page_w and page_h. One exchange by page; all else happens
    in the page's row."""
    q = F.col("quad")
    wide = g.quad_width(q) / F.greatest(F.char_length("text"), F.lit(1))
    box = F.struct(g.top(q).alias("y"), g.left(q).alias("x"), "seq", q.alias("quad"), t.strip(F.col("text")).alias("s"), wide.alias("wide"))
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("_b"), F.max("page_w").alias("_w"), F.max("page_h").alias("_h"))
    return pages.select("page_id", let(F.col("_b"), _spatial).alias("text"))


def _spatial(b: Column) -> Column:
    """The spatial text of a page's boxes (y, x, seq, quad, s, wide) in order; its size is in _w and _h."""
    widths = F.filter(F.transform(b, lambda x: x["wide"]), lambda v: v > 0)
    limit = F.when(F.col("_w") > 0, F.col("_w") / 160.0).otherwise(1.0)
    left = F.greatest(F.array_min(F.transform(b, lambda x: x["x"])), F.lit(0.0))
    about = F.struct(F.greatest(upper_median(widths, 10.0), limit, F.lit(1.0)).alias("wide"), left.alias("left"), _mean(b, lambda x: g.quad_height(x["quad"])).alias("high"))
    return let(about, lambda a: let(F.transform(_lines_in(b), lambda line: _indented(line, a)), lambda lines: _spaced(lines, a)))


def _indented(boxes: Column, a: Column) -> Column:
    def add(out: Column, x: Column) -> Column:
        column = F.least(F.greatest(F.round((x["x"] - a["left"]) / a["wide"]), F.lit(0.0)), F.lit(240.0)).cast("int")
        gap = F.when(column > F.char_length(out), F.repeat(F.lit(" "), column - F.char_length(out))).when((F.length(out) > 0) & ~out.endswith(" "), " ").otherwise("")
        return F.concat(out, gap, x["s"])

    across = F.array_sort(F.transform(boxes, lambda x: F.struct(x["x"].alias("x"), x["y"].alias("y"), x["seq"].alias("seq"), x["s"].alias("s"))))
    return F.struct(_mean(boxes, lambda x: g.center_y(x["quad"])).alias("center_y"), t.rstrip(F.aggregate(across, F.lit(""), add)).alias("text"))


def _spaced(lines: Column, a: Column) -> Column:
    upper = lambda gaps: _upper_pitch(gaps, F.greatest(a["high"], F.col("_h") / 80, F.lit(1.0)))
    text = lambda n: F.array_join(F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit("\n"), F.coalesce(F.get(n, i - 1), F.lit(0))), x["text"])), "\n")
    return let(let(_gap_list(lines), upper), lambda p: let(_blanks(lines, p, 16.0, 1.0), text))


# rows, columns, tables


@F.arrow_udf(ArrayType(IntegerType()))
def _clustered_at(centres: pa.Array, extents: pa.Array) -> pa.Array:
    """Where groups begin among a page's boxes in order: a box joins the last group if its centre is near the group's
    mean."""
    out = []
    for cs, es in zip(centres.to_pylist(), extents.to_pylist(), strict=True):
        starts, n, c, e = [], 0, 0.0, 0.0
        for k, (x, h) in enumerate(zip(cs, es, strict=True)):
            if n and abs(x - c / n) <= max(e / n, h) * 0.6:
                n, c, e = n + 1, c + x, e + h
            else:
                starts.append(k)
                n, c, e = 1, x, h
        out.append(starts)
    return pa.array(out, pa.list_(pa.int32()))


def _clusters(boxes: str) -> Column:
    return _clustered_at(F.transform(boxes, lambda x: x["c"]), F.transform(boxes, lambda x: x["e"]))


def _grouped(regions: DataFrame, center: Column, extent: Column, down: bool, name: str) -> DataFrame:
    """regions with column `name`: the number of the group that each falls into."""
    key = -center if down else center
    box = F.struct(key.alias("k"), F.col("seq").cast("int").alias("seq"), center.alias("c"), extent.alias("e"), F.struct(*regions.columns).alias("row"))
    sortable = F.struct(key.alias("k"), F.col("seq").cast("int").alias("seq"), box.alias("b"))
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(sortable)).alias("_b")).select(F.transform("_b", lambda x: x["b"]).alias("_b"))
    groups = pages.select("_b", _clusters("_b").alias("_s")).select(F.posexplode(_parts(F.col("_b"), F.col("_s"))).alias(name, "_g"))
    return groups.select(name, F.explode("_g").alias("_x")).select("_x.row.*", name)


def cluster_rows(regions: DataFrame) -> DataFrame:
    """regions with row_no (from 0, by centre) and row_pos (from 1, by left)."""
    q = F.col("quad")
    d = _grouped(regions, g.center_y(q), g.quad_height(q), False, "row_no")
    return d.withColumn("row_pos", F.row_number().over(W.partitionBy("page_id", "row_no").orderBy(g.left(q), g.center_y(q), "seq")))


def vertical_order(regions: DataFrame) -> DataFrame:
    """regions with col_no (from 0, right to left) and col_pos (from 1, downwards)."""
    q = F.col("quad")
    d = _grouped(regions, g.center_x(q), g.quad_width(q), True, "col_no")
    return d.withColumn("col_pos", F.row_number().over(W.partitionBy("page_id", "col_no").orderBy(g.top(q), -g.center_x(q), "seq")))


def vertical_text(regions: DataFrame) -> DataFrame:
    d = vertical_order(regions).groupBy("page_id", "col_no").agg(F.array_sort(F.collect_list(F.struct("col_pos", t.strip(F.col("text")).alias("s")))).alias("_p"))
    return _lines_to_text(d.withColumn("_line", F.array_join(F.transform("_p", lambda x: x["s"]), "")), "col_no")


def _edges(xs: Column, far: Column) -> Column:
    """Means of sorted left edges that follow each other closely."""
    return let(_where(xs, lambda i: F.get(xs, i) - F.get(xs, i - 1) > far), lambda starts: F.transform(_parts(xs, starts), lambda part: _mean(part, lambda v: v)))


def _far(heights: Column, page_w: Column) -> Column:
    """How far apart left edges of different columns are."""
    return F.greatest(upper_median(F.filter(heights, lambda v: v > 0), 1.0) * 1.2, page_w * 0.01, F.lit(4.0))


def column_edges(regions: DataFrame) -> DataFrame:
    """page_id, col_no, edge: means of left edges that follow each other closely. Needs page_w."""
    q = F.col("quad")
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(g.left(q))).alias("xs"), F.collect_list(g.quad_height(q)).alias("_h"), F.max("page_w").alias("_w"))
    pages = pages.select("page_id", "xs", _far(F.col("_h"), F.col("_w")).alias("far"))
    return pages.select("page_id", F.posexplode(_edges(F.col("xs"), F.col("far"))).alias("col_no", "edge"))


def _nearest(x: Column, edges: Column) -> Column:
    """The number of the nearest of edges (edge, col_no); the first of equally near ones."""
    return F.array_min(F.transform(edges, lambda e: F.struct(F.abs(x - e["edge"]).alias("d"), e["col_no"].alias("k"))))["k"]


def assign_columns(regions: DataFrame, columns: DataFrame) -> DataFrame:
    """regions with col_no of the nearest edge; the first of equally near ones."""
    edges = columns.groupBy("page_id").agg(F.collect_list(F.struct("col_no", "edge")).alias("_edges"))
    return regions.join(edges, "page_id").withColumn("col_no", _nearest(g.left(F.col("quad")), F.col("_edges"))).drop("_edges")


def _grid(regions: DataFrame) -> DataFrame:
    """page_id, is_table, n_rows, n_cols, grid (texts by row and column): rows by cluster_rows, columns by column_edges
    and assign_columns, within the page's row after one exchange."""
    q = F.col("quad")
    box = F.struct(g.center_y(q).alias("k"), F.col("seq").cast("int").alias("seq"), g.center_y(q).alias("c"), g.quad_height(q).alias("e"), g.left(q).alias("x"), t.strip(F.col("text")).alias("s"))
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("_boxes"), F.max("page_w").alias("_w"))
    return _with_grid(pages.withColumn("_starts", _clusters("_boxes")), F.lit(True)).select("page_id", "_t.*")


def _with_grid(pages: DataFrame, on: Column) -> DataFrame:
    """pages (_boxes in order, _starts of their rows, _w) with _t: is_table, n_rows, n_cols, grid; null where not `on`."""
    xs, heights = F.array_sort(F.transform("_boxes", lambda x: x["x"])), F.transform("_boxes", lambda x: x["e"])
    pages = pages.withColumns({"_xs": F.when(on, xs), "_far": F.when(on, _far(heights, F.col("_w")))})
    numbered = F.transform(_edges(F.col("_xs"), F.col("_far")), lambda v, k: F.struct(v.alias("edge"), k.alias("col_no")))
    pages = pages.withColumn("_e", F.when(on, numbered)).drop("_xs", "_far")

    def table(rows: Column) -> Column:
        wide = F.size(F.filter(rows, lambda r: F.size(F.array_distinct(F.transform(r, lambda x: x["col"]))) >= 2))
        join = lambda r, k: F.array_join(F.transform(F.filter(r, lambda x: x["col"] == k), lambda x: F.nullif(x["s"], F.lit(""))), " ")
        grid = F.transform(rows, lambda r: F.transform("_e", lambda e: join(r, e["col_no"])))
        is_one = (F.size("_boxes") >= 4) & (F.size(rows) >= 2) & (F.size("_e") >= 2) & (wide >= 2)
        return F.struct(is_one.alias("is_table"), F.size(rows).alias("n_rows"), F.size("_e").alias("n_cols"), grid.alias("grid"))

    placed = F.transform("_boxes", lambda x: F.struct(x["x"].alias("x"), x["c"].alias("c"), x["seq"].alias("seq"), _nearest(x["x"], F.col("_e")).alias("col"), x["s"].alias("s")))
    rows = let(placed, lambda b: F.transform(_parts(b, F.col("_starts")), lambda r: F.array_sort(r)))
    return pages.withColumn("_t", F.when(on, let(rows, table))).drop("_e")


def is_table(regions: DataFrame) -> DataFrame:
    """page_id, is_table, n_rows, n_cols: four regions, two rows, two columns, and two rows that use two columns."""
    return _grid(regions).select("page_id", "is_table", "n_rows", "n_cols")


def table_cells(regions: DataFrame) -> DataFrame:
    """page_id, row_no, col_no, text: all cells of pages that are tables; texts of one cell are joined by a space."""
    rows = _grid(regions).filter("is_table").select("page_id", F.posexplode("grid").alias("row_no", "_row"))
    return rows.select("page_id", "row_no", F.posexplode("_row").alias("col_no", "text"))


def _rows(cells: DataFrame, *more: Column) -> DataFrame:
    """page_id, _rows: the cells of each page by row and column. Cells of table_cells are dealt by page already."""
    cell = F.struct("row_no", "col_no", "text", *more)
    pages = cells.groupBy("page_id").agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    starts = _where(F.col("_c"), lambda i: F.get("_c", i)["row_no"] != F.get("_c", i - 1)["row_no"])
    return pages.select("page_id", "_c", let(starts, lambda at: _parts(F.col("_c"), at)).alias("_rows"))


def table_text(cells: DataFrame) -> DataFrame:
    """page_id, text: columns aligned by display width, two spaces apart."""
    pages = _rows(cells, t.display_width(F.col("text")).alias("width"))
    return pages.select("page_id", _aligned(F.col("_rows"), F.col("_c")).alias("text"))


def _aligned(rows: Column, cells: Column) -> Column:
    """The text of a table's rows of cells (col_no, text, width)."""
    columns = F.array_sort(F.array_distinct(F.transform(cells, lambda x: x["col_no"])))
    widths = F.transform(columns, lambda k: F.struct(k.alias("k"), F.array_max(F.transform(F.filter(cells, lambda x: x["col_no"] == k), lambda x: x["width"])).alias("w")))
    state = lambda s, at: F.struct(s.alias("s"), at.cast("int").alias("at"))

    def whole(w: Column) -> Column:
        start = lambda x: F.aggregate(F.filter(w, lambda c: c["k"] < x["col_no"]), F.lit(0), lambda total, c: total + c["w"] + 2)

        def add(a: Column, x: Column) -> Column:
            with_pad = lambda pad: state(F.concat(a["s"], F.repeat(F.lit(" "), pad), x["text"]), a["at"] + pad + x["width"])
            return F.when(x["text"] == "", a).otherwise(let(F.greatest(start(x) - a["at"], F.lit(0)), with_pad))

        line = lambda row: F.rtrim(F.aggregate(row, state(F.lit(""), F.lit(0)), add, lambda a: a["s"]))
        return F.array_join(F.transform(rows, line), "\n")

    return let(widths, whole)


def table_csv(cells: DataFrame) -> DataFrame:
    """page_id, text: CSV with quotes only where a value needs them."""
    pages = _rows(cells.withColumn("text", t.csv_escape(F.col("text"))))
    line = lambda row: F.array_join(F.transform(row, lambda x: x["text"]), ",")
    return pages.select("page_id", F.array_join(F.transform("_rows", line), "\n").alias("text"))


def layout_text(regions: DataFrame) -> DataFrame:
    """page_id, layout, text: vertical pages by columns, tables aligned, all others as spatial text. One exchange by page;
    which layout a page has, and its text, are found in its row, so nothing is stored between."""
    q = F.col("quad")
    wide = g.quad_width(q) / F.greatest(F.char_length("text"), F.lit(1))
    box = F.struct(g.top(q).alias("y"), g.left(q).alias("x"), "seq", q.alias("quad"), t.strip(F.col("text")).alias("s"), wide.alias("wide"), g.center_x(q).alias("cx"), g.center_y(q).alias("cy"), g.quad_width(q).alias("w"), g.quad_height(q).alias("h"))
    n, down = F.count(F.lit(1)), F.count_if(F.col("direction") == "Vertical")
    pages = regions.filter("page_id is not null").groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("_b"), ((n >= 2) & (down * 2 > n)).alias("_v"), F.max("page_w").alias("_w"), F.max("page_h").alias("_h"))

    def sorted_by(key, c: str, e: str, x: str) -> Column:
        return F.array_sort(F.transform("_b", lambda b: F.struct(key(b).alias("k"), b["seq"].cast("int").alias("seq"), b[c].alias("c"), b[e].alias("e"), b[x].alias("x"), b["s"].alias("s"))))

    # columns of vertical pages, rows of all others
    boxes = F.when(F.col("_v"), sorted_by(lambda b: -b["cx"], "cx", "w", "y")).otherwise(sorted_by(lambda b: b["cy"], "cy", "h", "x"))
    pages = pages.withColumn("_boxes", boxes).withColumn("_starts", _clusters("_boxes"))
    pages = _with_grid(pages, ~F.col("_v"))
    kind = F.when(F.col("_v"), "vertical").when(F.coalesce(F.col("_t.is_table"), F.lit(False)), "table").otherwise("spatial")
    pages = pages.withColumn("layout", kind)

    downwards = lambda part: F.array_sort(F.transform(part, lambda b: F.struct(b["x"].alias("top"), b["k"].alias("k"), b["seq"].alias("seq"), b["s"].alias("s"))))
    column = lambda part: F.array_join(F.transform(downwards(part), lambda b: b["s"]), "")
    vertical = F.array_join(F.transform(_parts(F.col("_boxes"), F.col("_starts")), column), "\n")
    cell = lambda text, k: F.struct(k.alias("col_no"), text.alias("text"), t.display_width(text).alias("width"))
    cells = F.transform("_t.grid", lambda row: F.transform(row, cell))
    aligned = let(cells, lambda rows: _aligned(rows, F.flatten(rows)))
    text = F.when(F.col("layout") == "vertical", vertical).when(F.col("layout") == "table", aligned).otherwise(let(F.col("_b"), _spatial))
    return pages.select("page_id", "layout", text.alias("text"))


# review


def score_regions(regions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """regions with confidence (detection times recognition) and in_text: shown in the text if not blank and, with a
    threshold, sure enough."""
    d = regions.withColumn("confidence", F.col("det_conf") * F.col("rec_conf"))
    shown = F.length(t.strip(F.col("text"))) > 0
    return d.withColumn("in_text", shown & (F.col("confidence") >= threshold) if threshold > 0 else shown)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")
