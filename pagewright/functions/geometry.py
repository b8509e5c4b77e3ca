"""Column functions on boxes. A quad is ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>> of four points, clockwise from the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (name, long side, box threshold, unclip ratio, least area, rotated boxes).
PRESETS = [("fast", 960, 0.6, 1.5, 10.0, False), ("balanced", 1280, 0.6, 1.6, 6.0, False), ("high", 1600, 0.5, 1.7, 4.0, True)]
#: Fixed values that all presets share.
SHARED = {"threshold": 0.3, "max_candidates": 1000, "orientation_threshold": 0.9, "allow_upscale": False, "score_threshold": 0.0}


def _at(q: Column, i: int, c: str) -> Column:
    return F.get(q, F.lit(i))[c]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad_from_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def _edge(q: Column, a: int, b: int) -> Column:
    return F.sqrt(F.pow(_at(q, b, "x") - _at(q, a, "x"), 2) + F.pow(_at(q, b, "y") - _at(q, a, "y"), 2))


def quad_width(q: Column) -> Column:
    return _edge(q, 0, 1)


def quad_height(q: Column) -> Column:
    return _edge(q, 0, 3)


def quad_area(q: Column) -> Column:
    return quad_width(q) * quad_height(q)


def left(q: Column) -> Column:
    return F.least(*[_at(q, i, "x") for i in range(4)])


def top(q: Column) -> Column:
    return F.least(*[_at(q, i, "y") for i in range(4)])


def right(q: Column) -> Column:
    return F.greatest(*[_at(q, i, "x") for i in range(4)])


def bottom(q: Column) -> Column:
    return F.greatest(*[_at(q, i, "y") for i in range(4)])


def quad_rect(q: Column) -> Column:
    """STRUCT<x0,y0,x1,y1> of the least upright rectangle."""
    return F.struct(left(q).alias("x0"), top(q).alias("y0"), right(q).alias("x1"), bottom(q).alias("y1"))


def center_x(q: Column) -> Column:
    return (left(q) + right(q)) * 0.5


def center_y(q: Column) -> Column:
    return (top(q) + bottom(q)) * 0.5


def _clamped(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def quad_clamp(q: Column, max_w: Column, max_h: Column) -> Column:
    return F.transform(q, lambda p: point(_clamped(p["x"], 0.0, max_w), _clamped(p["y"], 0.0, max_h)))


def quad_is_aligned(q: Column) -> Column:
    """The top edge rises by at most 4 % of its run, the left edge leans by at most 4 % of its drop (of 1 at least)."""
    d = lambda i, c: F.abs(_at(q, i, c) - _at(q, 0, c))
    level = d(1, "y") <= F.greatest(d(1, "x"), F.lit(1.0)) * 0.04
    return level & (d(3, "x") <= F.greatest(d(3, "y"), F.lit(1.0)) * 0.04)


def quad_union(a: Column, b: Column) -> Column:
    x0, y0 = F.least(left(a), left(b)), F.least(top(a), top(b))
    return quad_from_rect(x0, y0, F.greatest(right(a), right(b)) - x0, F.greatest(bottom(a), bottom(b)) - y0)


def quad_unclip(q: Column, ratio: Column) -> Column:
    """Every edge moves outward along the box's own axes by area * ratio / perimeter. A box without perimeter stays."""
    w, h = quad_width(q), quad_height(q)
    by = w * h * ratio / ((w + h) * 2)
    unit = lambda a, b, n: {c: (_at(q, b, c) - _at(q, a, c)) / F.greatest(n, F.lit(1e-6)) for c in "xy"}
    u, v = unit(0, 1, w), unit(0, 3, h)
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    moved = F.array(*[point(*[_at(q, i, c) + by * (u[c] * s + v[c] * t) for c in "xy"]) for i, (s, t) in enumerate(signs)])
    return F.when(w + h > 0, moved).otherwise(q)


def quad_to_original(q: Column, meta: dict[str, Column]) -> Column:
    """From the resized page to the source page. meta: pad_x, pad_y, content_w, content_h, scale_x, scale_y, orig_w,
    orig_h."""
    def back(p: Column) -> Column:
        one = lambda c, pad, content, scale, orig: _clamped(_clamped(p[c] - pad, 0.0, content.cast("double")) * scale, 0.0, orig.cast("double"))
        return point(one("x", meta["pad_x"], meta["content_w"], meta["scale_x"], meta["orig_w"]), one("y", meta["pad_y"], meta["content_h"], meta["scale_y"], meta["orig_h"]))

    return F.transform(q, back)


def _plan(w: Column, h: Column, rw: Column, rh: Column, cw: Column, ch: Column, px: Column, py: Column) -> Column:
    ints = {"orig_w": w, "orig_h": h, "resized_w": rw, "resized_h": rh, "content_w": cw, "content_h": ch, "pad_x": px, "pad_y": py}
    return F.struct(*[v.cast("int").alias(k) for k, v in ints.items()], (w / cw).cast("double").alias("scale_x"), (h / ch).cast("double").alias("scale_y"))


def resize_plan_square(w: Column, h: Column, size: int = 512) -> Column:
    """The page scaled into a square, centred."""
    scale = F.least(F.lit(float(size)) / F.greatest(w, F.lit(1)), F.lit(float(size)) / F.greatest(h, F.lit(1)))
    cw, ch = _clamped(F.round(w * scale), 1.0, float(size)), _clamped(F.round(h * scale), 1.0, float(size))
    return _plan(w, h, F.lit(size), F.lit(size), cw, ch, F.floor((F.lit(size) - cw) / 2), F.floor((F.lit(size) - ch) / 2))


def _up_to_32(x: Column) -> Column:
    return F.ceil(F.greatest(x, F.lit(1)) / 32) * 32


def resize_plan_limit(w: Column, h: Column, long_side: Column, upscale: bool = False) -> Column:
    """The page with its long side at most long_side, each side filled up to a multiple of 32."""
    ratio = long_side.cast("double") / F.greatest(w, h, F.lit(1))
    ratio = ratio if upscale else F.least(ratio, F.lit(1.0))
    cw, ch = F.greatest(F.round(w * ratio), F.lit(1.0)), F.greatest(F.round(h * ratio), F.lit(1.0))
    return _plan(w, h, _up_to_32(cw), _up_to_32(ch), cw, ch, F.lit(0), F.lit(0))


def rec_content_width(w: Column, h: Column, height: int = 48) -> Column:
    return _clamped(F.round(w * float(height) / F.greatest(h, F.lit(1))), 48.0, 2048.0).cast("int")


def rec_width(w: Column, h: Column, height: int = 48) -> Column:
    """The content width filled up to a multiple of 32, within 48 and 2048."""
    c = rec_content_width(w, h, height)
    return F.when((c <= 48) | (c >= 2048), c).otherwise(F.least(_up_to_32(c), F.lit(2048))).cast("int")


def crop_rect(q: Column, w: Column, h: Column) -> Column:
    """STRUCT<x,y,w,h> of the padded crop within a page of w by h; null if it is empty."""
    r = quad_rect(quad_clamp(q, F.greatest(w - 1, F.lit(0)).cast("double"), F.greatest(h - 1, F.lit(0)).cast("double")))
    rw, rh = F.greatest(r["x1"] - r["x0"], F.lit(1.0)), F.greatest(r["y1"] - r["y0"], F.lit(1.0))
    px = _clamped(rw * 0.02, 2.0, 12.0)
    py = _clamped(rh * 0.45, 2.0, F.greatest(rh * 0.10, F.lit(8.0)))
    x, y = F.greatest(F.floor(r["x0"] - px), F.lit(0)), F.greatest(F.floor(r["y0"] - py), F.lit(0))
    x1, y1 = F.greatest(F.ceil(r["x1"] + px), F.floor(r["x0"] + 1)), F.greatest(F.ceil(r["y1"] + py), F.floor(r["y0"] + 1))
    cw, ch = F.least(x1 - x, w - x), F.least(y1 - y, h - y)
    return F.when((cw > 0) & (ch > 0), F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), cw.cast("int").alias("w"), ch.cast("int").alias("h")))


def annotation_rect(bbox: Column, w: Column, h: Column) -> Column:
    """STRUCT<x,y,w,h> of an annotated box (ARRAY<DOUBLE> of two opposite corners); null below 4 numbers or 2 pixels."""
    n = lambda i: F.get(bbox, F.lit(i))
    x0, y0 = _clamped(F.least(n(0), n(2)), 0.0, w - 1.0), _clamped(F.least(n(1), n(3)), 0.0, h - 1.0)
    x1, y1 = _clamped(F.greatest(n(0), n(2)), x0 + 1.0, w.cast("double")), _clamped(F.greatest(n(1), n(3)), y0 + 1.0, h.cast("double"))
    cw, ch = F.round(x1 - x0), F.round(y1 - y0)
    box = F.struct(F.round(x0).cast("int").alias("x"), F.round(y0).cast("int").alias("y"), cw.cast("int").alias("w"), ch.cast("int").alias("h"))
    return F.when((F.size(bbox) >= 4) & (cw >= 2) & (ch >= 2), box)


def text_direction(w: Column, h: Column) -> Column:
    return F.when(h > F.floor(w * 5 / 4), "Vertical").otherwise("Horizontal")


def shares_line(a: Column, b: Column) -> Column:
    mean = (quad_height(a) + quad_height(b)) * 0.5
    overlap = F.least(bottom(a), bottom(b)) - F.greatest(top(a), top(b))
    return (F.abs(center_y(a) - center_y(b)) <= mean * 0.7) | (overlap >= mean * 0.5)


def should_merge(a: Column, b: Column) -> Column:
    mean = (quad_height(a) + quad_height(b)) * 0.5
    overlap = F.least(right(a), right(b)) - F.greatest(left(a), left(b))
    near = (overlap >= mean * 0.4) | (left(b) - right(a) <= mean * 1.2)
    return quad_is_aligned(a) & quad_is_aligned(b) & shares_line(a, b) & near


def is_gutter(q: Column, page_w: Column, gutter_right: Column) -> Column:
    w, h = quad_width(q), quad_height(q)
    within = (left(q) <= gutter_right) & (right(q) <= gutter_right)
    return within & (w <= F.greatest(page_w * 0.08, F.lit(36.0))) & (h <= F.greatest(page_w * 0.05, F.lit(24.0))) & (w <= h * 2.2 + 8.0)


def preset_params(spark: SparkSession) -> DataFrame:
    """One row for each preset, with all thresholds; small enough to broadcast."""
    base = spark.createDataFrame(PRESETS, "preset string, long_side int, box_threshold double, unclip_ratio double, min_area double, rotated boolean")
    return base.withColumns({k: F.lit(v) for k, v in SHARED.items()})
