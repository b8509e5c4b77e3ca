"""Operators on pixel tables: (image_id, y, x, r, g, b) with channels 0..255, or one value column where named.

All work by image_id; window and group operators share one exchange by it where they follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import rasters

CHANNELS = ("r", "g", "b")
#: Channel means and deviations of the detection input; all other inputs have 0.5 and 0.5.
DETECTION_MEAN, DETECTION_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
HALF = (0.5, 0.5, 0.5)


def of_image():
    return W.partitionBy("image_id")


def to_pixels(images: DataFrame) -> DataFrame:
    """Pixels of (image_id, width, height, n_channels, data): data is row by row, BGR or BGRA or grey."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, n, data in zip(*(b.column(c) for c in ("image_id", "width", "height", "n_channels", "data")), strict=True):
                w, h, n = w.as_py(), h.as_py(), n.as_py()
                px = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
                for top in range(0, h, 256):  # bounded batches of tall images
                    part = px[top : top + 256]
                    y, x = np.divmod(np.arange(part.shape[0] * w, dtype=np.int32), np.int32(w))
                    bgr = [part[:, :, k if n >= 3 else 0].ravel().astype(np.int32) for k in (2, 1, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i.as_py(), np.int64)), pa.array(y + np.int32(top)), pa.array(x), *map(pa.array, bgr)], names=["image_id", "y", "x", *CHANNELS])

    slim = images.filter("width > 0 and height > 0").select("image_id", "width", "height", "n_channels", "data")
    return rasters.mapped(slim, unpack, "image_id long, y int, x int, r int, g int, b int")


def normalize_px(px: DataFrame, mean: tuple = DETECTION_MEAN, std: tuple = DETECTION_STD) -> DataFrame:
    return px.withColumns({c: (F.col(c) / 255.0 - m) / s for c, m, s in zip(CHANNELS, mean, std, strict=True)})


def denormalize_px(px: DataFrame, mean: tuple = DETECTION_MEAN, std: tuple = DETECTION_STD) -> DataFrame:
    """Channels as shares of 1, clamped."""
    return px.withColumns({c: F.least(F.greatest(F.col(c) * s + m, F.lit(0.0)), F.lit(1.0)) for c, m, s in zip(CHANNELS, mean, std, strict=True)})


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.greatest(r * 0.299 + g * 0.587 + b * 0.114, F.lit(0.0)), F.lit(1.0))


def to_gray(px: DataFrame) -> DataFrame:
    """image_id, y, x, v: luma as a share of 1."""
    return px.select("image_id", "y", "x", luma(*[F.col(c) / 255.0 for c in CHANNELS]).alias("v"))


def background(gray: DataFrame) -> DataFrame:
    """image_id, is_light (mean over a half), luma (the whole mean of 0..255 values)."""
    v = F.round(F.col("v") * 255).cast("long")
    return gray.groupBy("image_id").agg((F.avg("v") > 0.5).alias("is_light"), F.floor(F.sum(v) / F.count(F.lit(1))).cast("int").alias("luma"))


def ink(gray: DataFrame) -> DataFrame:
    """v becomes the share of ink: inverted on light images."""
    light = F.avg("v").over(of_image()) > 0.5
    value = F.when(light, 1.0 - F.col("v")).otherwise(F.col("v"))
    return gray.withColumn("v", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


# geometry


def axis_weights(sizes: DataFrame, kernel: str = "bilinear") -> DataFrame:
    """(image_id, src, dst) sizes -> (image_id, d, s, w): the share of source place s in target place d. bilinear is a
    point sample; triangle and lanczos3 widen with the scale when an image shrinks."""
    d = sizes.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("dst") - 1))).withColumn("ratio", F.col("src") / F.col("dst"))
    at = (F.col("d") + 0.5) * F.col("ratio") - 0.5
    last = F.col("src") - 1
    if kernel == "bilinear":
        s0 = F.least(F.greatest(F.floor(at), F.lit(0)), last)
        w1 = F.least(F.greatest(at - s0, F.lit(0.0)), F.lit(1.0))
        taps = F.array(F.struct(s0.cast("int").alias("s"), (1 - w1).alias("w")), F.struct(F.least(s0 + 1, last).cast("int").alias("s"), w1.alias("w")))
    else:
        support = {"triangle": 1.0, "lanczos3": 3.0}[kernel]
        wide = F.greatest(F.col("ratio"), F.lit(1.0))
        reach = wide * support
        lo, hi = F.greatest(F.ceil(at - reach), F.lit(0)).cast("int"), F.least(F.floor(at + reach), last).cast("int")

        def weight(s: Column) -> Column:
            x = F.abs((s - at) / wide)
            if kernel == "triangle":
                return F.greatest(1.0 - x, F.lit(0.0))
            pi = F.pi() * x
            return F.when(x < 1e-9, 1.0).when(x >= 3, 0.0).otherwise(3 * F.sin(pi) * F.sin(pi / 3) / (pi * pi))

        taps = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda s: F.struct(s.alias("s"), weight(s).alias("w")))
    each = d.select("image_id", "d", F.explode(taps).alias("t")).select("image_id", "d", "t.s", "t.w").groupBy("image_id", "d", "s").agg(F.sum("w").alias("w"))
    return each.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("image_id", "d"))).filter("w <> 0")


def _scaled(table: pa.Table, p: dict, kernel: str, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """An image's values scaled to a plan's size, and which places any pixel has a share in."""
    if min(p[c] or 0 for c in ("src_w", "src_h", "dst_w", "dst_h")) < 1:
        return np.zeros((0, 0, len(values))), np.zeros((0, 0), bool)
    px, have = rasters.array_in(table, values, p["src_w"], p["src_h"])
    return rasters.scaled(px, p["dst_w"], p["dst_h"], kernel), rasters.scaled_where(have, p["dst_w"], p["dst_h"], kernel)


def resample(px: DataFrame, plan: DataFrame, kernel: str = "bilinear", values: tuple = ("v",)) -> DataFrame:
    """px scaled to the sizes of plan (image_id, src_w, src_h, dst_w, dst_h): along x, then along y. One exchange of both
    by image; axis_weights has the shares as a table."""
    def run(table: pa.Table, plans: pa.Table) -> pa.Table:
        v, there = _scaled(table, plans.to_pylist()[0], kernel, values) if plans.num_rows and table.num_rows else (np.zeros((0, 0, len(values))), np.zeros((0, 0), bool))
        y, x = np.nonzero(there)
        return rasters.pixel_table((table if table.num_rows else plans).column("image_id")[0], y, x, {c: v[y, x, k] for k, c in enumerate(values)})

    sizes = plan.select("image_id", "src_w", "src_h", "dst_w", "dst_h")
    return rasters.beside(px.select("image_id", "y", "x", *values), sizes, run, "image_id long, y int, x int, " + ", ".join(f"{c} double" for c in values))


def pad_canvas(px: DataFrame, plan: DataFrame, fill: Column | float = 1.0, values: tuple = ("v",)) -> DataFrame:
    """px set at (pad_x, pad_y) into canvases of plan (image_id, canvas_w, canvas_h, pad_x, pad_y); the rest is fill,
    a number or a column of plan. One exchange of both by image."""
    def run(table: pa.Table, plans: pa.Table) -> pa.Table:
        p = plans.to_pylist()[0] if plans.num_rows else {"canvas_w": 0, "canvas_h": 0, "pad_x": 0, "pad_y": 0, "_fill": 0.0}
        moved = table.set_column(1, "y", pc.add(table.column("y"), p["pad_y"])).set_column(2, "x", pc.add(table.column("x"), p["pad_x"]))
        v, have = rasters.array_in(moved, values, p["canvas_w"], p["canvas_h"])
        v[~have] = p["_fill"]
        y, x = np.divmod(np.arange(have.size), max(have.shape[1], 1))
        return rasters.pixel_table((plans if plans.num_rows else table).column("image_id")[0], y, x, {c: v[:, :, k].ravel() for k, c in enumerate(values)})

    fill = fill if isinstance(fill, Column) else F.lit(fill)
    canvas = plan.select("image_id", "canvas_w", "canvas_h", "pad_x", "pad_y", fill.cast("double").alias("_fill"))
    known = px.select("image_id", "y", "x", *values).dropna(subset=list(values))
    return rasters.beside(known, canvas, run, "image_id long, y int, x int, " + ", ".join(f"{c} double" for c in values))


def crop_px(px: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels of rects (image_id, crop_id, x0, y0, w, h), counted from each rectangle's corner, as crop_id's image. A
    rectangle meets the pixels of its rows only: it is a row for each of them. Neither side is broadcast, as Spark takes
    an exploded table for as small as what it was made of."""
    rows = rects.filter("h > 0").withColumn("_y", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)))
    rows = rows.select(F.col("image_id").alias("_image"), F.col("_y").cast("int").alias("_y"), "crop_id", "x0", "y0", "w")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w"))
    both = px.join(rows.hint("merge"), (F.col("image_id") == F.col("_image")) & (F.col("y") == F.col("_y")) & inside)
    rest = [c for c in px.columns if c not in ("image_id", "x", "y")]
    return both.select(F.col("crop_id").alias("image_id"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *rest)


def crop_rotated(px: DataFrame, quads: DataFrame) -> DataFrame:
    """Upright pixels of quads (image_id, crop_id, quad, page_w, page_h) by bilinear samples, edges repeated; a sample
    without any pixel near it is left out. One exchange of both by image."""
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        parts = []
        if table.num_rows and found.num_rows:
            px, have = rasters.array_in(table, CHANNELS, pc.max(table.column("x")).as_py() + 1, pc.max(table.column("y")).as_py() + 1)
            for k, q in enumerate(found.to_pylist()):
                v, there = rasters.sampled(px, have, [(p["x"], p["y"]) for p in q["quad"]], q["page_w"], q["page_h"])
                y, x = np.nonzero(there)
                whole = np.clip(np.floor(v[y, x] + 0.5), 0, 255).astype(np.int32)
                parts.append(rasters.pixel_table(found.column("crop_id")[k], y, x, {c: whole[:, i] for i, c in enumerate(CHANNELS)}))
        return pa.concat_tables(parts) if parts else empty

    kind = quads.schema["crop_id"].dataType
    empty = pa.schema([("image_id", to_arrow_type(kind)), *((c, pa.int32()) for c in ("y", "x", *CHANNELS))]).empty_table()
    slim = px.select("image_id", "y", "x", *CHANNELS)
    return rasters.beside(slim, quads.select("image_id", "crop_id", "quad", F.col("page_w").cast("double").alias("page_w"), F.col("page_h").cast("double").alias("page_h")), run, f"image_id {kind.simpleString()}, y int, x int, r int, g int, b int")


def rotate180(px: DataFrame) -> DataFrame:
    return px.withColumns({"x": F.max("x").over(of_image()) - F.col("x"), "y": F.max("y").over(of_image()) - F.col("y")})


# orientation


def needs_rotation(gray: DataFrame, directions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """image_id, confidence, rotate: horizontal crops whose lower half has clearly more ink. directions: image_id,
    direction."""
    d = gray.withColumn("_half", F.greatest(F.floor((F.max("y").over(of_image()) + 1) / 2), F.lit(1)))
    dark = 1.0 - F.col("v")
    sums = d.groupBy("image_id").agg(F.sum(F.when(F.col("y") < F.col("_half"), dark).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("y") >= F.col("_half"), dark).otherwise(0.0)).alias("b"))
    conf = F.least(F.abs(F.col("b") - F.col("a")) / F.greatest(F.col("a") + F.col("b"), F.lit(1.1920929e-7)), F.lit(1.0))
    both = sums.join(directions, "image_id")
    turn = (F.col("direction") == "Horizontal") & (F.col("b") > F.col("a")) & (conf >= min(threshold, 0.98))
    return both.select("image_id", conf.alias("confidence"), turn.alias("rotate"))


def needs_rotation_scores(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """df (direction, p0, p1) with confidence and rotate; of equal scores the first class wins."""
    return df.withColumns({"confidence": F.greatest("p0", "p1"), "rotate": (F.col("direction") == "Horizontal") & (F.col("p1") > F.col("p0")) & (F.col("p1") >= min(threshold, 0.999))})


def text_probability(gray: DataFrame) -> DataFrame:
    """image_id, y, x, p: ink, and a quarter of the mean contrast with the four neighbours that exist. One exchange by
    image; rasters.tile_pixels does without."""
    kernel = lambda px, have: [rasters.text_probability(px[:, :, 0], have, px[have].mean())]
    return rasters.by_image(gray, ("v",), kernel, "p double")


# augmentation


def image_uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on key and salt alone."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _byte(v: Column) -> Column:
    return F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(255.0)).cast("int")


def aug_brightness(px: DataFrame, delta: Column) -> DataFrame:
    return px.withColumns({c: _byte(F.col(c) + delta * 255.0) for c in CHANNELS})


def aug_contrast(px: DataFrame, factor: Column) -> DataFrame:
    return px.withColumns({c: _byte((F.col(c) - 128.0) * factor + 128.0) for c in CHANNELS})


def aug_noise(px: DataFrame, std: float, on: Column | None = None, seed: Column | None = None) -> DataFrame:
    """The same whole number from [-a, a], a = round(std * 765), for all channels of a pixel; by seed (a whole number,
    image_id unless given) and place."""
    a = int(std * 255.0 * 3.0 + 0.5)
    prime = rasters.PRIME
    t = (F.pmod(F.col("image_id") if seed is None else seed, F.lit(prime)) + F.col("x").cast("long") * rasters.CONTENT_X + F.col("y").cast("long") * rasters.CONTENT_Y + 1) % prime
    t = (t * rasters.NOISE_FACTOR + 11) % prime
    noise = (t * t + t) % prime % (2 * a + 1) - a
    noise = noise if on is None else F.when(on, noise).otherwise(0)
    return px.withColumns({c: _byte(F.col(c) + noise) for c in CHANNELS})


def aug_blur(px: DataFrame, on: Column | None = None) -> DataFrame:
    """A 3 by 3 box blur of whole numbers over the pixels that exist; images of 4 pixels or fewer a side stay, and those
    where `on` is false. One exchange by image; rasters.tile_pixels does without."""
    def kernel(v, have):
        px = v[:, :, :3]
        blurred = rasters.box_blur(px, have, px.shape[1], px.shape[0]) if v[:, :, 3].max() else px
        return [blurred[:, :, k] for k in range(3)]

    return rasters.by_image(px.withColumn("_on", F.lit(1) if on is None else on.cast("int")), (*CHANNELS, "_on"), kernel, "r int, g int, b int")


def content_hash(px: DataFrame) -> DataFrame:
    """image_id, content: a whole number that depends on an image's pixels and their places alone, so the same image
    under two ids has it twice. One sum by image."""
    weight = (F.col("x").cast("long") * rasters.CONTENT_X + F.col("y").cast("long") * rasters.CONTENT_Y + rasters.CONTENT_ADD) % rasters.CONTENT_MOD
    rgb = F.col("r").cast("long") * 65_536 + F.col("g") * 256 + F.col("b") + 1
    return px.groupBy("image_id").agg(F.sum(rgb * weight % rasters.PRIME).alias("content"))


def augment(px: DataFrame, brightness: float = 0.15, contrast: float = 0.20, noise: float = 0.02, blur: bool = True) -> DataFrame:
    """Brightness, contrast, noise (three images in five), blur (three in ten), by numbers that depend on what an image
    shows, not on its id. One exchange by image."""
    def kernel(v, have):
        out = rasters.augment(v, have, brightness, contrast, noise, blur)
        return [out[:, :, k] for k in range(3)]

    return rasters.by_image(px, CHANNELS, kernel, "r int, g int, b int")


# features and model inputs


def sizes_of(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("src_w"), (F.max("y") + 1).alias("src_h"))


def fit_canvas(gray: DataFrame, w: int, h: int) -> DataFrame:
    """gray scaled into canvases of w by h, centred on the image's mean luma."""
    size = sizes_of(gray).join(background(gray), "image_id")
    scale = F.least(F.lit(float(w)) / F.col("src_w"), F.lit(float(h)) / F.col("src_h"))
    fit = lambda side, most: F.least(F.greatest(F.round(F.col(side) * scale), F.lit(1.0)), F.lit(float(most))).cast("int")
    plan = size.withColumns({"dst_w": fit("src_w", w), "dst_h": fit("src_h", h), "canvas_w": F.lit(w), "canvas_h": F.lit(h)})
    plan = plan.withColumns({"pad_x": F.floor((w - F.col("dst_w")) / 2).cast("int"), "pad_y": F.floor((h - F.col("dst_h")) / 2).cast("int")})
    return pad_canvas(resample(gray, plan, "triangle"), plan, F.col("luma") / 255.0)


def template_feature(px: DataFrame, w: int = 32, h: int = 32) -> DataFrame:
    """image_id, feature: the ink of the image fitted into w by h, row by row, with unit length. One exchange by image."""
    def feature(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        image = np.full((int(y.max()) + 1, int(x.max()) + 1, 3), 255)
        image[y, x] = np.stack([table.column(c).to_numpy() for c in CHANNELS], axis=1)
        return pa.Table.from_arrays([table.column("image_id").slice(0, 1), pa.array([rasters.template_feature(image, w, h)])], names=["image_id", "feature"])

    slim = px.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", *CHANNELS)
    return slim.groupBy("image_id").applyInArrow(feature, "image_id long, feature array<double>")


def model_input(px: DataFrame, plan: DataFrame, mean: tuple = HALF, std: tuple = HALF, kernel: str = "triangle") -> DataFrame:
    """image_id, values: scaled, padded with white, normalised, planes in channel order, each row by row. plan has
    src_w, src_h, dst_w, dst_h, canvas_w, canvas_h, pad_x, pad_y. One exchange of both by image."""
    def run(table: pa.Table, plans: pa.Table) -> pa.Table:
        rows = []
        if plans.num_rows:
            p = plans.to_pylist()[0]
            canvas = np.full((p["canvas_h"], p["canvas_w"], 3), 255.0)
            v, there = _scaled(table, p, kernel, CHANNELS)
            y, x = np.nonzero(there)
            to_y, to_x = y + p["pad_y"], x + p["pad_x"]
            inside = (to_y >= 0) & (to_y < p["canvas_h"]) & (to_x >= 0) & (to_x < p["canvas_w"])
            canvas[to_y[inside], to_x[inside]] = v[y[inside], x[inside]]
            rows.append(np.moveaxis((canvas / 255.0 - mean) / std, 2, 0).ravel())
        ids = pa.array([p["image_id"] for p in plans.slice(0, 1).to_pylist()], pa.int64())
        return pa.Table.from_arrays([ids, pa.array(rows, pa.list_(pa.float64()))], names=["image_id", "values"])

    sizes = plan.select("image_id", "src_w", "src_h", "dst_w", "dst_h", "canvas_w", "canvas_h", "pad_x", "pad_y")
    return rasters.beside(px.select("image_id", "y", "x", *CHANNELS), sizes, run, "image_id long, values array<double>")
