"""Images as rows and tiles of them, and the kernels that work on their arrays.

A raster is one row for each image: image_id, width, height, rgb (one byte a channel, row by row). A tile is a row for
each part of an image of at most `size` by `size` pixels, with a halo of neighbouring pixels where there are any, and
what a kernel may need of the whole image (its mean luma), so that kernels run where a tile lies: no exchange.

`by_image` runs the same kernels on pixel tables (image_id, y, x, values): one exchange by image, and an image is one
array while it is worked on. Pixels that are not in the table do not exist for a kernel.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHANNELS = ("r", "g", "b")
RASTER = "image_id long, width int, height int, rgb binary"
TILE = "image_id long, width int, height int, y0 int, x0 int, n_rows int, n_cols int, top int, left int, ext_rows int, ext_cols int, mean double, rgb binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
#: Pixels that are sent on at a time.
ROWS_AT_ONCE = 65_536
#: Numbers that a kernel works on at a time where it can: what is larger than a cache, or than memory that is kept for
#: the next image, takes several times as long.
AT_ONCE = 32_768
#: Fixed values of the content hash and of the noise, whole numbers whose products fit 64 bits.
CONTENT_X, CONTENT_Y, CONTENT_ADD, CONTENT_MOD, PRIME, NOISE_FACTOR = 7919, 104_729, 12_345, 1_000_003, 2_147_483_647, 48_271


def batch_of(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; bytes are not copied."""
    names = b.schema.names
    plain = {n: b.column(n).to_pylist() for n in names if not pa.types.is_binary(b.schema.field(n).type)}
    raw = {n: b.column(n) for n in names if n not in plain}
    for i in range(b.num_rows):
        yield {n: plain[n][i] if n in plain else memoryview(raw[n][i].as_buffer()) if raw[n][i].is_valid else None for n in names}


def in_batches(ddl: str, rows: Iterator[tuple], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `size` bytes, or one row where that has more."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(v) for v in r if isinstance(v, bytes)) + 64
        if n >= size:
            yield batch_of(ddl, held)
            held, n = [], 0
    if held:
        yield batch_of(ddl, held)


#: Bytes of a batch of images that a worker is given; rows alone would bound it only for small images.
BATCH_BYTES = 64_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow for rows that hold images. Batches are bounded by bytes; a session that sets its own bound keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def of_images(images: DataFrame) -> DataFrame:
    """Rasters of (image_id, width, height, n_channels, data) as images are read: BGR, BGRA or grey, row by row."""
    def turned(r: dict) -> tuple:
        px = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
        rgb = px[:, :, 2::-1] if r["n_channels"] >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
        return r["image_id"], r["width"], r["height"], rgb.tobytes()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(RASTER, (turned(r) for b in batches for r in rows_of(b)))

    slim = images.filter("width > 0 and height > 0").select("image_id", "width", "height", "n_channels", "data")
    return mapped(slim, turn, RASTER)


def array_of(r: dict) -> np.ndarray:
    """(height, width, 3) of a raster's row, or of a tile's with its halo."""
    return np.frombuffer(r["rgb"], np.uint8).reshape(r.get("ext_rows", r["height"]), r.get("ext_cols", r["width"]), 3)


def tiles(rasters: DataFrame, size: int = 512, halo: int = 1) -> DataFrame:
    """Tiles of rasters, cut where the images lie."""
    def parts(r: dict) -> Iterator[tuple]:
        px, w, h = array_of(r), r["width"], r["height"]
        mean = sum(float(luma(px[y : y + 256]).sum()) for y in range(0, h, 256)) / (w * h)
        for y in range(0, h, size):
            for x in range(0, w, size):
                n, m = min(size, h - y), min(size, w - x)
                t, left = min(halo, y), min(halo, x)
                part = px[y - t : y + n + halo, x - left : x + m + halo]
                yield r["image_id"], w, h, y, x, n, m, t, left, *part.shape[:2], mean, part.tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(TILE, (t for b in batches for r in rows_of(b) for t in parts(r)))

    return mapped(rasters.select("image_id", "width", "height", "rgb"), cut, TILE)


def _pixel_rows(parts: Iterator[tuple[int, int, int, list[np.ndarray]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pixel rows of (image_id, y0, x0, arrays), about ROWS_AT_ONCE at a time."""
    held: list[list[np.ndarray]] = []

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["image_id", "y", "x", *names])

    n = 0
    for image, y0, x0, values in parts:
        h, w = values[0].shape
        step = max(1, ROWS_AT_ONCE // w)
        for y in range(0, h, step):
            at = np.arange(min(step, h - y) * w, dtype=np.int32)
            held.append([np.full(len(at), image, np.int64), at // w + np.int32(y0 + y), at % w + np.int32(x0), *(v[y : y + step].ravel() for v in values)])
            n += len(at)
            if n >= ROWS_AT_ONCE:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def tile_pixels(tiled: DataFrame, kernel: Callable[[np.ndarray, dict], list[np.ndarray]], values: str) -> DataFrame:
    """image_id, y, x and values (a DDL, such as `v double`) of all tiles: kernel takes a tile's array with its halo and
    the tile's row, and returns an array of the same height and width for each value."""
    names = [v.split()[0] for v in values.split(", ")]

    def part(r: dict) -> tuple:
        t, left = r["top"], r["left"]
        return r["image_id"], r["y0"], r["x0"], [v[t : t + r["n_rows"], left : left + r["n_cols"]] for v in kernel(array_of(r), r)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pixel_rows((part(r) for b in batches for r in rows_of(b)), names)

    return mapped(tiled, run, f"image_id long, y int, x int, {values}")


def by_image(px: DataFrame, columns: tuple, kernel: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], values: str) -> DataFrame:
    """The same for a pixel table: kernel takes an image's (height, width, columns) array and the mask of its pixels."""
    names = [v.split()[0] for v in values.split(", ")]
    kinds = [_ARROW[v.split()[1]] for v in values.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        px = np.zeros((int(y.max()) + 1, int(x.max()) + 1, len(columns)), np.result_type(*(table.column(c).to_numpy().dtype for c in columns)))
        have = np.zeros(px.shape[:2], bool)
        have[y, x] = True
        for k, c in enumerate(columns):
            px[y, x, k] = table.column(c).to_numpy()
        out = [pa.array(v[y, x]).cast(kind) for v, kind in zip(kernel(px, have), kinds, strict=True)]
        return pa.Table.from_arrays([*(table.column(c) for c in ("image_id", "y", "x")), *out], names=["image_id", "y", "x", *names])

    slim = px.selectExpr("cast(image_id as bigint) image_id", "cast(y as int) y", "cast(x as int) x", *columns)
    return slim.groupBy("image_id").applyInArrow(run, f"image_id long, y int, x int, {values}")


def beside(px: DataFrame, plan: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn of each image's pixels and its rows of plan, which meet in one task: one exchange of both by image. Neither is
    broadcast: Spark takes a table that was exploded for as small as what it was made of."""
    slim = px.filter("y is not null and x is not null").withColumn("image_id", px["image_id"].cast("long"))
    return slim.groupBy("image_id").cogroup(plan.withColumn("image_id", plan["image_id"].cast("long")).groupBy("image_id")).applyInArrow(fn, schema)


def array_in(table: pa.Table, columns: tuple, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(h, w, columns) of a pixel table, and the mask of its pixels; those beyond w and h are left out."""
    y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    px, have = np.zeros((h, w, len(columns))), np.zeros((h, w), bool)
    y, x = y[inside], x[inside]
    have[y, x] = True
    for k, c in enumerate(columns):
        px[y, x, k] = pc.fill_null(table.column(c), 0).to_numpy()[inside]
    return px, have


def pixel_table(image: pa.Scalar, y: np.ndarray, x: np.ndarray, values: dict) -> pa.Table:
    columns = {"y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32))} | {c: pa.array(v) for c, v in values.items()}
    return pa.table({"image_id": pa.repeat(image, len(y))} | columns)


# kernels


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, k] / 255.0 for k in range(3))
    return np.clip(r * 0.299 + g * 0.587 + b * 0.114, 0.0, 1.0)


def ink(v: np.ndarray, mean: float) -> np.ndarray:
    return np.clip(1.0 - v if mean > 0.5 else v, 0.0, 1.0)


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The neighbour at (dy, dx) of each place; 0 (no pixel) beyond the edge."""
    out = np.zeros_like(a)
    h, w = a.shape[:2]
    out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = a[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


@functools.lru_cache(maxsize=4)
def _neighbours(h: int, w: int) -> np.ndarray:
    """How many of the four neighbours each place has, 1 at least."""
    n = np.full((h, w), 4.0)
    for edge in (np.s_[:, 0], np.s_[:, -1], np.s_[0], np.s_[-1]):
        n[edge] -= 1
    return np.maximum(n, 1)


def text_probability(v: np.ndarray, have: np.ndarray | None, mean: float) -> np.ndarray:
    """Ink, and a quarter of the mean contrast with the four neighbours that exist; have None: all pixels do."""
    if have is None:
        across, down = np.abs(np.diff(v, axis=1)), np.abs(np.diff(v, axis=0))
        total, n = np.zeros(v.shape), _neighbours(*v.shape)
        total[:, 1:] += across
        total[:, :-1] += across
        total[1:] += down
        total[:-1] += down
        total /= n
        total *= 0.25
        total += (1.0 - v if mean > 0.5 else v) * 0.75
        return np.clip(total, 0.0, 1.0, out=total)
    total, n = np.zeros(v.shape), np.zeros(v.shape, np.int64)
    for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
        there = _shifted(have, dy, dx)
        total += np.where(there, np.abs(v - _shifted(v, dy, dx)), 0.0)
        n += there
    return np.clip((1.0 - v if mean > 0.5 else v) * 0.75 + total / np.maximum(n, 1) * 0.25, 0.0, 1.0)


def box_blur(px: np.ndarray, have: np.ndarray, width: int, height: int) -> np.ndarray:
    """A 3 by 3 box of whole numbers over the pixels that exist; images of 4 pixels or fewer a side stay."""
    if width <= 4 or height <= 4:
        return px
    total, n = np.where(have[:, :, None], px, 0).astype(np.int64), have.astype(np.int64)
    for axis in (1, 0):
        back, ahead = ((0, -1), (0, 1)) if axis else ((-1, 0), (1, 0))
        total = total + _shifted(total, *back) + _shifted(total, *ahead)
        n = n + _shifted(n, *back) + _shifted(n, *ahead)
    return (total // np.maximum(n, 1)[:, :, None]).astype(px.dtype)


def content(px: np.ndarray, have: np.ndarray) -> int:
    """A hash of an image's pixels and their places, in any order; images alike have it alike."""
    y, x = np.nonzero(have)
    r, g, b = (px[y, x, k].astype(np.int64) for k in range(3))
    weight = (x * CONTENT_X + y * CONTENT_Y + CONTENT_ADD) % CONTENT_MOD
    return int(((r * 65_536 + g * 256 + b + 1) * weight % PRIME).sum())


def uniform(key: object, salt: int) -> float:
    """As pixels.image_uniform: a number in [0, 1) that depends on key and salt alone."""
    return int(hashlib.md5(f"{key}:{salt}".encode()).hexdigest()[:12], 16) / float(1 << 48)


def noise_at(seed: int, y: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers from [-most, most], as pixels.aug_noise has them."""
    t = (seed % PRIME + x.astype(np.int64) * CONTENT_X + y.astype(np.int64) * CONTENT_Y + 1) % PRIME
    t = (t * NOISE_FACTOR + 11) % PRIME
    return (t * t + t) % PRIME % (2 * most + 1) - most


def _byte(v: np.ndarray) -> np.ndarray:
    whole = np.floor(v)
    return np.clip(whole + (v - whole >= 0.5), 0, 255).astype(np.int64)


def augment(px: np.ndarray, have: np.ndarray, brightness: float = 0.15, contrast: float = 0.20, noise: float = 0.02, blur: bool = True) -> np.ndarray:
    """Brightness, contrast, noise (three images in five), blur (three in ten), by numbers that depend on content."""
    seed = content(px, have)
    u = [uniform(seed, salt) for salt in range(4)]
    px = px.astype(np.int64)
    if brightness > 0:
        px = _byte(px + (u[0] * 2.0 * brightness - brightness) * 255.0)
    if contrast > 0:
        px = _byte((px - 128.0) * (1.0 + (u[1] * 2.0 * contrast - contrast)) + 128.0)
    if noise > 0 and u[2] > 0.4:
        y, x = np.mgrid[0 : px.shape[0], 0 : px.shape[1]]
        px = np.clip(px + noise_at(seed, y, x, int(noise * 255.0 * 3.0 + 0.5))[:, :, None], 0, 255)
    return box_blur(px, have, px.shape[1], px.shape[0]) if blur and u[3] > 0.7 else px


@functools.lru_cache(maxsize=64)
def _taps(src: int, dst: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """(dst, n) source places of each target place, and their shares; as pixels.axis_weights has them."""
    at = (np.arange(dst) + 0.5) * (src / dst) - 0.5
    if kernel == "bilinear":
        s0 = np.clip(np.floor(at), 0, src - 1)
        w1 = np.clip(at - s0, 0.0, 1.0)
        taps, weights = np.stack([s0, np.minimum(s0 + 1, src - 1)], 1), np.stack([1 - w1, w1], 1)
    else:
        support, wide = {"triangle": 1.0, "lanczos3": 3.0}[kernel], max(src / dst, 1.0)
        first = np.maximum(np.ceil(at - wide * support), 0)
        taps = first[:, None] + np.arange(math.ceil(2 * wide * support) + 2)
        off = np.abs((taps - at[:, None]) / wide)
        weights = np.maximum(1.0 - off, 0.0) if kernel == "triangle" else np.where(off >= 3, 0.0, np.sinc(off) * np.sinc(off / 3))
        weights = np.where(taps <= np.minimum(np.floor(at + wide * support), src - 1)[:, None], weights, 0.0)
    used = (weights != 0).any(axis=0)
    return np.minimum(taps, src - 1).astype(np.int64)[:, used], (weights / weights.sum(axis=1, keepdims=True))[:, used]


def axis_weights(src: int, dst: int, kernel: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(dst, hi - lo): the share of source places lo to hi in each target place."""
    taps, weights = _taps(src, dst, kernel)
    hi = src if hi is None else hi
    out, inside = np.zeros((dst, hi - lo)), (taps >= lo) & (taps < hi)
    np.add.at(out, (np.nonzero(inside)[0], taps[inside] - lo), weights[inside])
    return out


def _along(px: np.ndarray, dst: int, kernel: str) -> np.ndarray:
    """(rows, dst, channels) of (rows, src, channels): a sum over taps, so the work grows with the larger side only."""
    taps, weights = _taps(px.shape[1], dst, kernel)
    out = np.zeros((px.shape[0], dst, px.shape[2]))
    for k in range(taps.shape[1]):
        out += px[:, taps[:, k]] * weights[:, k, None]
    return out


def scaled(px: np.ndarray, w: int, h: int, kernel: str = "triangle") -> np.ndarray:
    """(h, w, channels) of an array, along x, then along y."""
    px = _along(px, w, kernel)
    taps, weights = _taps(px.shape[0], h, kernel)
    out = np.zeros((h, w, px.shape[2]))
    step = max(1, AT_ONCE // (w * px.shape[2]))
    for top in range(0, h, step):
        rows = slice(top, top + step)
        for k in range(taps.shape[1]):
            out[rows] += px[taps[rows, k]] * weights[rows, k, None, None]
    return out


def scaled_where(have: np.ndarray, w: int, h: int, kernel: str = "triangle") -> np.ndarray:
    """(h, w): the target places that a pixel has a share in."""
    if have.all():
        return np.ones((h, w), bool)
    for dst in (w, h):
        taps, weights = _taps(have.shape[1], dst, kernel)
        have = (have[:, taps] & (weights != 0)).any(axis=2).T
    return have


def recognition_input(px: np.ndarray, width: int, height: int = 48) -> np.ndarray:
    """(3, height, width): an image scaled to height, on the left of white, channels around 0; as pixels.model_input."""
    content = int(min(max(math.floor(px.shape[1] * height / max(px.shape[0], 1) + 0.5), 48), 2048))
    canvas = np.full((height, width, 3), 255.0)
    canvas[:, :content] = scaled(px, content, height)
    return np.moveaxis((canvas / 255.0 - 0.5) / 0.5, 2, 0)


def template_feature(px: np.ndarray, w: int = 32, h: int = 32) -> np.ndarray:
    """The ink of an image fitted into a canvas of its mean luma, row by row, with unit length."""
    v, canvas = luma(px), np.empty((h, w))
    canvas[:] = int(np.floor(v * 255 + 0.5).sum() // v.size) / 255.0
    scale = min(w / v.shape[1], h / v.shape[0])
    dw, dh = (int(min(max(math.floor(side * scale + 0.5), 1), most)) for side, most in ((v.shape[1], w), (v.shape[0], h)))
    x, y = (w - dw) // 2, (h - dh) // 2
    canvas[y : y + dh, x : x + dw] = scaled(v[:, :, None], dw, dh)[:, :, 0]
    flat = ink(canvas, canvas.mean()).ravel()
    return flat / max(float(np.sqrt((flat * flat).sum())), 1.1920929e-7)


def sampled(px: np.ndarray, have: np.ndarray | None, quad: list[tuple[float, float]], w: float, h: float) -> tuple[np.ndarray, np.ndarray]:
    """The upright pixels of a quad on a page of w by h by bilinear samples, edges repeated, and which of them any pixel
    is near; have None: all pixels of the page are there."""
    p = [(min(max(x, 0.0), w - 1.0), min(max(y, 0.0), h - 1.0)) for x, y in quad]
    (ax, ay), (bx, by) = ((p[k][0] - p[0][0], p[k][1] - p[0][1]) for k in (1, 3))
    ow, oh = (max(int(math.floor(math.hypot(*e) + 0.5)), 1) for e in ((ax, ay), (bx, by)))
    fx, fy = (np.arange(ow) + 0.5)[None, :] / ow, (np.arange(oh) + 0.5)[:, None] / oh
    sx, sy = np.clip(p[0][0] + fx * ax + fy * bx, 0.0, w - 1.0), np.clip(p[0][1] + fx * ay + fy * by, 0.0, h - 1.0)
    out, there = np.zeros((oh, ow, 3)), np.zeros((oh, ow), bool)
    for i in (0, 1):
        for j in (0, 1):
            x, y = np.minimum(np.floor(sx) + i, w - 1).astype(int), np.minimum(np.floor(sy) + j, h - 1).astype(int)
            weight = np.abs(1 - i - (sx - np.floor(sx))) * np.abs(1 - j - (sy - np.floor(sy)))
            if have is None:
                there[:] = True
            else:
                inside = (y < have.shape[0]) & (x < have.shape[1])
                y, x = np.where(inside, y, 0), np.where(inside, x, 0)
                inside &= have[y, x]
                there |= inside
                weight = np.where(inside, weight, 0.0)
            out += px[y, x] * weight[:, :, None]
    return out, there


def cut_rotated(px: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The upright pixels of a quad by bilinear samples, edges repeated."""
    return np.clip(np.floor(sampled(px, None, quad, px.shape[1], px.shape[0])[0] + 0.5), 0, 255).astype(np.uint8)


def upside_down(px: np.ndarray, threshold: float = 0.9) -> tuple[float, bool]:
    """(confidence, turn): whether the lower half of a horizontal crop has clearly more ink than the upper one."""
    dark = 1.0 - luma(px)
    half = max(px.shape[0] // 2, 1)
    a, b = float(dark[:half].sum()), float(dark[half:].sum())
    sure = min(abs(b - a) / max(a + b, 1.1920929e-7), 1.0)
    return sure, b > a and sure >= min(threshold, 0.98)


def resample(tiled: DataFrame, kernel: str = "bilinear") -> DataFrame:
    """image_id, y, x, v: the luma of tiles' images scaled to the columns dst_w and dst_h. A tile gives the block of
    target pixels that it has a share in; one exchange by image adds the blocks up."""
    def block(r: dict) -> Iterator[tuple]:
        v = luma(array_of(r))[r["top"] : r["top"] + r["n_rows"], r["left"] : r["left"] + r["n_cols"]]
        along = axis_weights(r["width"], r["dst_w"], kernel, r["x0"], r["x0"] + r["n_cols"])
        down = axis_weights(r["height"], r["dst_h"], kernel, r["y0"], r["y0"] + r["n_rows"])
        xs, ys = (np.nonzero(m.any(axis=1))[0] for m in (along, down))
        if len(xs) and len(ys):
            found = down[ys[0] : ys[-1] + 1] @ (v @ along[xs[0] : xs[-1] + 1].T)
            yield r["image_id"], r["dst_w"], r["dst_h"], int(ys[0]), int(xs[0]), *found.shape, found.tobytes()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(_SHARE, (x for b in batches for r in rows_of(b) for x in block(r)))

    def whole(table: pa.Table) -> pa.Table:
        first = next(rows_of(table.slice(0, 1).to_batches()[0]))
        out = np.zeros((first["dst_h"], first["dst_w"]))
        for b in table.to_batches():
            for r in rows_of(b):
                out[r["y"] : r["y"] + r["n"], r["x"] : r["x"] + r["m"]] += np.frombuffer(r["block"]).reshape(r["n"], r["m"])
        return pa.Table.from_batches(list(_pixel_rows(iter([(first["image_id"], 0, 0, [out])]), ["v"])))

    return mapped(tiled, share, _SHARE).groupBy("image_id").applyInArrow(whole, "image_id long, y int, x int, v double")


_SHARE = "image_id long, dst_w int, dst_h int, y int, x int, n int, m int, block binary"
