"""From a probability table (image_id, y, x, p) to boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import pixels, rasters
from .layout import reading_order


def binarize(prob: DataFrame, threshold: float = 0.3) -> DataFrame:
    return prob.filter(F.col("p") > threshold)


def runs(fg: DataFrame) -> DataFrame:
    """image_id, y, x0, x1: horizontal runs of foreground pixels. One row per run goes on, not one per pixel."""
    island = F.col("x") - F.row_number().over(W.partitionBy("image_id", "y").orderBy("x"))
    return fg.withColumn("_i", island).groupBy("image_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def _labelled(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The first run (in order of y, x0) of each run's component: runs of neighbouring rows that overlap are joined."""
    root = list(range(len(y)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ys, left, right = y.tolist(), x0.tolist(), x1.tolist()
    above = 0
    for i in range(len(ys)):
        while ys[above] < ys[i] - 1 or (ys[above] == ys[i] - 1 and right[above] < left[i]):
            above += 1
        k = above
        while ys[k] == ys[i] - 1 and left[k] <= right[i]:
            a, b = top(k), top(i)
            root[max(a, b)] = min(a, b)
            k += 1
    return np.array([top(i) for i in range(len(ys))], np.int64)


def label_runs(fg: DataFrame) -> DataFrame:
    """image_id, y, x0, x1, label: runs with the component they belong to (4-neighbourhood). The label is the place of
    the component's first run, STRUCT<image_id,y,x0>.

    A component never leaves its image, so one exchange of the runs by image is enough; an image's runs are joined by
    union-find in one pass over its rows."""
    def label(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
        y, x0, x1 = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        first = _labelled(y, x0, x1)
        return table.append_column("label_y", pa.array(y[first])).append_column("label_x", pa.array(x0[first]))

    labelled = runs(fg).select("image_id", "y", "x0", "x1").groupBy("image_id").applyInArrow(label, "image_id long, y int, x0 int, x1 int, label_y int, label_x int")
    return labelled.select("image_id", "y", "x0", "x1", F.struct("image_id", F.col("label_y").alias("y"), F.col("label_x").alias("x0")).alias("label"))


def components(fg: DataFrame) -> DataFrame:
    """fg with the label of each pixel's component."""
    r = label_runs(fg).alias("r")
    inside = (F.col("f.image_id") == F.col("r.image_id")) & (F.col("f.y") == F.col("r.y")) & F.col("f.x").between(F.col("r.x0"), F.col("r.x1"))
    return fg.alias("f").join(r, inside).select("f.*", "r.label")


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.sum("p").alias("score_sum"), F.count(F.lit(1)).alias("n"), F.avg("p").alias("score"))


def filter_components(stats: DataFrame, box_threshold: float = 0.6, min_area: float = 6.0) -> DataFrame:
    """Sure and large enough components; a box reaches from pixel to pixel, so lines one pixel thin have no area."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return stats.filter((F.col("score") >= box_threshold) & (area >= min_area))


def cap_candidates(stats: DataFrame, most: int = 1000) -> DataFrame:
    """The first `most` components of each image, by their first pixel. The cap is the feature here."""
    return stats.withColumn("_r", F.row_number().over(W.partitionBy("image_id").orderBy("label"))).filter(F.col("_r") <= most).drop("_r")


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    both: list[tuple[float, float]] = []
    for side in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in side:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        both += half[:-1]
    return both


def least_rect(points: list[tuple[float, float]]) -> tuple:
    """The corners (x, y each) of the least rectangle of any angle around points, its longer edge first; of fewer than
    three hull points the upright box."""
    hull = _hull(sorted(points)) if len(points) > 2 else points
    h = np.array(hull, float)
    if len(h) < 3:
        (x0, y0), (x1, y1) = h.min(axis=0), h.max(axis=0)
        return x0, y0, x1, y0, x1, y1, x0, y1
    edge = np.roll(h, -1, axis=0) - h
    ux, uy = (edge / np.hypot(*edge.T)[:, None]).T
    along, across = np.outer(ux, h[:, 0]) + np.outer(uy, h[:, 1]), np.outer(ux, h[:, 1]) - np.outer(uy, h[:, 0])
    s0, s1, t0, t1 = along.min(axis=1), along.max(axis=1), across.min(axis=1), across.max(axis=1)
    i = int(np.argmin((s1 - s0) * (t1 - t0)))
    corner = lambda s, t: (float(s[i] * ux[i] - t[i] * uy[i]), float(s[i] * uy[i] + t[i] * ux[i]))
    wide = [corner(s0, t0), corner(s1, t0), corner(s1, t1), corner(s0, t1)]
    return tuple(v for p in (wide if s1[i] - s0[i] >= t1[i] - t0[i] else [wide[3], *wide[:3]]) for v in p)


_CORNERS = ", ".join(f"{c}{i} double" for i in range(4) for c in "xy")


def _quad() -> Column:
    return F.array(*[g.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)])


def min_area_rect(labelled_runs: DataFrame) -> DataFrame:
    """image_id, label, quad: the least rectangle of any angle around a component, its longer edge first; components
    without area get their upright box. One exchange of runs by image; only run ends count."""
    def rects(table: pa.Table) -> pa.Table:
        points: dict = {}
        for y, x0, x1, *label in zip(*(table.column(c).to_pylist() for c in ("y", "x0", "x1", "label_y", "label_x")), strict=True):
            points.setdefault(tuple(label), set()).update(((float(x0), float(y)), (float(x1), float(y))))
        rows = [(*label, *least_rect(list(p))) for label, p in sorted(points.items())]
        out = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["label_y", "label_x", *(c.split()[0] for c in _CORNERS.split(", "))])
        return out.add_column(0, "image_id", pa.array([table.column("image_id")[0].as_py()] * len(rows), pa.int64()))

    flat = labelled_runs.select("image_id", "y", "x0", "x1", F.col("label.y").alias("label_y"), F.col("label.x0").alias("label_x"))
    found = flat.groupBy("image_id").applyInArrow(rects, f"image_id long, label_y long, label_x long, {_CORNERS}")
    label = F.struct("image_id", F.col("label_y").cast("int").alias("y"), F.col("label_x").cast("int").alias("x0"))
    return found.select("image_id", label.alias("label"), _quad().alias("quad"))


# one image at a time: from runs of foreground to boxes

_BOXES = f"image_id long, label int, score double, {_CORNERS}"


def _boxes(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, total: np.ndarray, box_threshold: float, min_area: float, most: int, rotated: bool) -> list[tuple]:
    """(label, score, corners) of an image's components, in order of their first run: sure ones whose box (upright, or
    the least of any angle) is large enough, `most` of these."""
    first = _labelled(y, x0, x1)
    order = np.argsort(first, kind="stable")
    out: list[tuple] = []
    for rows in np.split(order, np.nonzero(np.diff(first[order]))[0] + 1):
        if len(out) == most or not len(rows):
            break
        score = total[rows].sum() / (x1[rows] - x0[rows] + 1).sum()
        if score < box_threshold:
            continue
        a, b, t, e = (float(v) for v in (x0[rows].min(), x1[rows].max(), y[rows].min(), y[rows].max()))
        corners = (a, t, b, t, b, e, a, e)
        if rotated:
            corners = least_rect(list({(float(x), float(v)) for side in (x0, x1) for x, v in zip(side[rows].tolist(), y[rows].tolist(), strict=True)}))
        if math.dist(corners[0:2], corners[2:4]) * math.dist(corners[0:2], corners[6:8]) >= min_area:
            out.append((int(first[rows[0]]), float(score), *corners))
    return out


def _box_table(image: int, found: list[tuple]) -> pa.Table:
    schema = pa.schema([("image_id", pa.int64()), ("label", pa.int32()), *((n, pa.float64()) for n in ["score", *(c.split()[0] for c in _CORNERS.split(", "))])])
    columns = list(zip(*((image, *row) for row in found), strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _placed(boxes: DataFrame, meta: DataFrame, unclip_ratio: float) -> DataFrame:
    """page_id, seq, quad, det_conf of boxes on resized pages: grown, set back on the source pages, in reading order."""
    fields = ("pad_x", "pad_y", "content_w", "content_h", "scale_x", "scale_y", "orig_w", "orig_h")
    placed = boxes.withColumn("quad", _quad()).select("image_id", "label", "score", "quad").join(meta.select("image_id", *fields), "image_id")
    quad = g.quad_to_original(g.quad_unclip(F.col("quad"), F.lit(unclip_ratio)), {c: F.col(c) for c in fields})
    out = reading_order(placed.select(F.col("image_id").alias("page_id"), F.col("label").alias("seq"), quad.alias("quad"), F.col("score").alias("det_conf")))
    return out.select("page_id", F.col("order_no").cast("int").alias("seq"), "quad", "det_conf")


def detect_regions(prob: DataFrame, meta: DataFrame, threshold: float = 0.3, box_threshold: float = 0.6, unclip_ratio: float = 1.5, min_area: float = 6.0, max_candidates: int = 1000, rotated: bool = False) -> DataFrame:
    """page_id, seq, quad, det_conf: boxes on the source pages, in reading order. meta has a resize plan's fields. With
    `rotated` boxes are the least of any angle, and it is their area that counts.

    Runs of foreground, not pixels, meet by image, and an image's boxes are found in one pass over its runs."""
    island = F.col("x") - F.row_number().over(W.partitionBy("image_id", "y").orderBy("x"))
    scored = binarize(prob, threshold).withColumn("_i", island).groupBy("image_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("p").alias("total"))

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
        columns = (table.column(c).to_numpy() for c in ("y", "x0", "x1", "total"))
        return _box_table(table.column("image_id")[0].as_py(), _boxes(*columns, box_threshold, min_area, max_candidates, rotated))

    boxes = scored.select(F.col("image_id").cast("long").alias("image_id"), "y", "x0", "x1", "total").groupBy("image_id").applyInArrow(found, _BOXES)
    return _placed(boxes, meta, unclip_ratio)


def _runs_of(p: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(y, x0, x1, total) of the runs of an array of probabilities."""
    wide = p.shape[1] + 2
    on = np.zeros((p.shape[0], wide), bool)  # rows end off, so runs begin and end in turn
    np.greater(p, threshold, out=on[:, 1:-1])
    turn = np.nonzero(on.ravel()[1:] != on.ravel()[:-1])[0]
    (y, x0), end = np.divmod(turn[::2], wide), turn[1::2] % wide
    sums = np.cumsum(p, axis=1)
    return y, x0, end - 1, sums[y, end - 1] - np.where(x0 > 0, sums[y, x0 - 1], 0.0)


def _square(w: int, h: int, size: int) -> tuple[int, int, int, int]:
    """Width, height and padding of a page in a square, as resize_plan_square has them."""
    scale = min(size / max(w, 1), size / max(h, 1))
    cw, ch = (int(min(max(math.floor(v * scale + 0.5), 1), size)) for v in (w, h))
    return cw, ch, (size - cw) // 2, (size - ch) // 2


def _model_free_luma(px: np.ndarray, size: int, kernel: str) -> np.ndarray:
    """The luma of an image in a white square. Luma is linear in the channels, so it is taken before scaling: one channel
    grows instead of three."""
    w, h, x, y = _square(px.shape[1], px.shape[0], size)
    v = np.ones((size, size))
    v[y : y + h, x : x + w] = rasters.scaled(rasters.luma(px)[:, :, None], w, h, kernel)[:, :, 0]
    return np.clip(v, 0.0, 1.0, out=v)


def model_free_probability(px: np.ndarray, size: int = 512, kernel: str = "triangle") -> np.ndarray:
    """The text probability of an image in a square, by ink and contrast alone."""
    v = _model_free_luma(px, size, kernel)
    return rasters.text_probability(v, None, v.mean())


def _model_free_runs(px: np.ndarray, size: int, kernel: str, threshold: float) -> tuple[np.ndarray, ...]:
    """_runs_of(model_free_probability(...), threshold), some rows of the square at a time."""
    v = _model_free_luma(px, size, kernel)
    mean, step, parts = v.mean(), max(1, rasters.AT_ONCE // size), []
    for top in range(0, size, step):
        halo = min(top, 1)
        p = rasters.text_probability(v[top - halo : top + step + 1], None, mean)
        y, *runs = _runs_of(p[halo : halo + step], threshold)
        parts.append((y + top, *runs))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _plan_of(sizes: DataFrame, size: int) -> DataFrame:
    return sizes.withColumn("p", g.resize_plan_square(F.col("src_w"), F.col("src_h"), size)).select("image_id", "p.*")


def detect_in_rasters(images: DataFrame, size: int = 512, kernel: str = "triangle", threshold: float = 0.3, box_threshold: float = 0.6, unclip_ratio: float = 1.5, min_area: float = 6.0, max_candidates: int = 1000, rotated: bool = False) -> DataFrame:
    """Boxes by ink and contrast alone, of rasters: an image's boxes are found where it lies; only boxes travel."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rasters.rows_of(b):
                boxes = _boxes(*_model_free_runs(rasters.array_of(r), size, kernel, threshold), box_threshold, min_area, max_candidates, rotated)
                if boxes:
                    yield from _box_table(r["image_id"], boxes).to_batches()

    boxes = rasters.mapped(images.select("image_id", "width", "height", "rgb"), found, _BOXES)
    return _placed(boxes, _plan_of(images.select("image_id", F.col("width").alias("src_w"), F.col("height").alias("src_h")), size), unclip_ratio)


def detect_model_free(px: DataFrame, size: int = 512, kernel: str = "triangle", threshold: float = 0.3, box_threshold: float = 0.6, unclip_ratio: float = 1.5, min_area: float = 6.0, max_candidates: int = 1000, rotated: bool = False) -> DataFrame:
    """The same of a pixel table: one exchange by image."""
    def found(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        image = np.full((int(y.max()) + 1, int(x.max()) + 1, 3), 255)
        image[y, x] = np.stack([table.column(c).to_numpy() for c in pixels.CHANNELS], axis=1)
        runs = _model_free_runs(image, size, kernel, threshold)
        return _box_table(table.column("image_id")[0].as_py(), _boxes(*runs, box_threshold, min_area, max_candidates, rotated))

    boxes = px.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", *pixels.CHANNELS).groupBy("image_id").applyInArrow(found, _BOXES)
    return _placed(boxes, _plan_of(pixels.sizes_of(px), size), unclip_ratio)
