"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import repair_mojibake
from ..operators import detection, evaluation, layout, pixels, rasters, recognition
from ..sources import tables
from .lineage import checkpointed
from .models import Model, Slot, in_use, ready

RECOGNISED = "text string, confidence double, error string"


def apply_recognizer(crops: DataFrame, fn: Callable[[pd.DataFrame], Mapping] | Model | Slot, keys: str = "page_id long, seq int", batch: int = 32) -> DataFrame:
    """keys, text, confidence, error of crops. fn takes a batch of rows and returns text and confidence for each, as a
    frame or a dict of them; if it fails on a batch its rows are tried alone, and a row that fails keeps its error. fn may
    be a Model, which workers set up once, or a Slot, whose model of the moment is used."""
    names, fn = [k.split()[0] for k in keys.split(",")], in_use(fn)

    def one(call: Callable, pdf: pd.DataFrame) -> tuple[list, list, list]:
        n = len(pdf)
        try:
            out = call(pdf)
            text, confidence = list(out["text"]), list(out["confidence"])
            if len(text) != n or len(confidence) != n:
                raise ValueError(f"{len(text)} texts and {len(confidence)} confidences for {n} rows")
            return text, confidence, [None] * n
        except Exception as failed:
            if n > 1:
                rows = [one(call, pdf.iloc[[i]]) for i in range(n)]
                return tuple([v for row in rows for v in row[k]] for k in range(3))
            return [None], [None], [f"{type(failed).__name__}: {failed}"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = ready(fn)
        for pdf in frames:  # what a model returns is small, so it goes on by frames, not by batches
            found: tuple[list, list, list] = ([], [], [])
            for at in range(0, len(pdf), batch):
                for held, more in zip(found, one(call, pdf.iloc[at : at + batch].reset_index(drop=True)), strict=True):
                    held.extend(more)
            out = pdf[names].reset_index(drop=True)
            for name, values in zip(("text", "confidence", "error"), found, strict=True):
                out[name] = pd.Series(values, dtype="float64" if name == "confidence" else object)
            yield out

    return crops.mapInPandas(run, f"{keys}, {RECOGNISED}")


_DETECTED = "page_id long, seq int, x double, y double, w double, h double, det_conf double, error string"


def apply_detector(images: DataFrame, fn: Callable[[np.ndarray], list[tuple]] | Model | Slot) -> tuple[DataFrame, DataFrame]:
    """(boxes, failed) of rasters: page_id, seq, quad, det_conf, and page_id, error. fn takes an image's (height, width, 3)
    array and returns (x, y, w, h, confidence) for each box; it may be a Model or a Slot."""
    fn = in_use(fn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ready(fn)

        def found(r: dict) -> list[tuple]:
            try:
                return [(r["image_id"], k, *map(float, box), None) for k, box in enumerate(call(rasters.array_of(r)))]
            except Exception as failed:
                return [(r["image_id"], *[None] * 6, f"{type(failed).__name__}: {failed}")]

        yield from rasters.in_batches(_DETECTED, (x for b in batches for r in rasters.rows_of(b) for x in found(r)))

    found = rasters.mapped(images.select("image_id", "width", "height", "rgb"), run, _DETECTED)
    boxes = found.filter("error is null").select("page_id", "seq", g.quad_from_rect(*[F.col(c) for c in "xywh"]).alias("quad"), "det_conf")
    return boxes, found.filter("error is not null").select("page_id", "error")


def crop_table(px: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id (of the crop), y, x, r, g, b for each region of (page_id, seq, quad): upright boxes are cut with
    padding, tilted ones sampled upright. crop_id names a crop by page and seq."""
    size = pixels.sizes_of(px).withColumnRenamed("image_id", "page_id")
    d = regions.join(size, "page_id").withColumn("crop_id", crop_id(F.col("page_id"), F.col("seq")))
    straight = d.filter(g.quad_is_aligned(F.col("quad"))).withColumn("c", g.crop_rect(F.col("quad"), F.col("src_w"), F.col("src_h"))).filter("c is not null")
    rects = straight.select(F.col("page_id").alias("image_id"), "crop_id", F.col("c.x").alias("x0"), F.col("c.y").alias("y0"), "c.w", "c.h")
    tilted = d.filter(~g.quad_is_aligned(F.col("quad"))).select(F.col("page_id").alias("image_id"), "crop_id", "quad", F.col("src_w").alias("page_w"), F.col("src_h").alias("page_h"))
    return pixels.crop_px(px, rects).unionByName(pixels.crop_rotated(px, tilted))


def crop_id(page: Column, seq: Column) -> Column:
    return F.xxhash64(page, seq)


def recognize_pages(px: DataFrame, recognizer: Callable[[DataFrame], DataFrame], size: int = 512, orientation_threshold: float = 0.9, score_threshold: float = 0.0, **params) -> tuple[DataFrame, DataFrame]:
    """(regions, texts) of page pixels: detect, drop the gutter, merge, crop, orient, recognise, assemble, lay out.
    recognizer takes crop pixels and returns crop_id, text, rec_conf; crops that it leaves out are dropped."""
    pages = pixels.sizes_of(px).select(F.col("image_id").alias("page_id"), F.col("src_w").cast("double").alias("page_w"), F.col("src_h").cast("double").alias("page_h"))
    found = checkpointed(detection.detect_model_free(px, size, **params).join(pages.select("page_id", "page_w"), "page_id"))
    boxes = checkpointed(layout.merge_regions(found))  # reads them several times
    named = boxes.withColumn("crop_id", crop_id(F.col("page_id"), F.col("seq")))
    crops = checkpointed(crop_table(px, boxes))
    direction = named.select(F.col("crop_id").alias("image_id"), g.text_direction(g.quad_width(F.col("quad")), g.quad_height(F.col("quad"))).alias("direction"))
    turn = checkpointed(pixels.needs_rotation(pixels.to_gray(crops), direction, orientation_threshold).join(direction, "image_id"))
    rotated = turn.filter("rotate").select("image_id")
    upright = crops.join(rotated, "image_id", "left_anti").unionByName(pixels.rotate180(crops.join(rotated, "image_id", "left_semi")).select(*crops.columns))
    read = checkpointed(recognizer(checkpointed(upright)))
    regions = recognition.assemble_regions(named.drop("crop_id"), named.join(turn.withColumnRenamed("image_id", "crop_id"), "crop_id"), named.select("page_id", "seq", "crop_id").join(read, "crop_id"))
    regions = checkpointed(layout.score_regions(regions, score_threshold))
    shown = regions.filter("in_text").join(pages, "page_id")
    return regions, layout.page_text(shown)


_CROPS = "page_id long, seq int, direction string, rotate boolean, width int, height int, rgb binary"


def crop_rasters(images: DataFrame, boxes: DataFrame, orientation_threshold: float = 0.9) -> DataFrame:
    """page_id, seq, direction, rotate, width, height, rgb: the crop of each box (page_id, seq, quad), upright. A page's
    boxes come to it as one row, so an image travels at most once; its crops are cut and turned where it is."""
    size = images.select(F.col("image_id").alias("page_id"), "width", "height")
    rect = F.when(g.quad_is_aligned(F.col("quad")), g.crop_rect(F.col("quad"), F.col("width"), F.col("height")))
    direction = g.text_direction(g.quad_width(F.col("quad")), g.quad_height(F.col("quad")))
    box = F.struct("seq", "quad", direction.alias("direction"), g.quad_is_aligned(F.col("quad")).alias("straight"), rect.alias("rect"))
    pages = boxes.join(size, "page_id").groupBy("page_id").agg(F.collect_list(box).alias("boxes"))
    # images are never broadcast: Spark can't tell how large their bytes are
    both = images.select("image_id", "width", "height", "rgb").hint("merge").join(pages, F.col("image_id") == F.col("page_id")).drop("page_id")

    def crops(r: dict) -> Iterator[tuple]:
        page = rasters.array_of(r)
        for x in r["boxes"]:
            if x["straight"] and not x["rect"]:
                continue
            c = x["rect"]
            px = page[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] if c else rasters.cut_rotated(page, [(p["x"], p["y"]) for p in x["quad"]])
            turn = x["direction"] == "Horizontal" and rasters.upside_down(px, orientation_threshold)[1]
            px = px[::-1, ::-1] if turn else px
            yield r["image_id"], x["seq"], x["direction"], turn, px.shape[1], px.shape[0], px.tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rasters.in_batches(_CROPS, (x for b in batches for r in rasters.rows_of(b) for x in crops(r)))

    return rasters.mapped(both, cut, _CROPS)


def recognize_rasters(images: DataFrame, recognizer: Callable[[DataFrame], DataFrame], size: int = 512, orientation_threshold: float = 0.9, score_threshold: float = 0.0, **params) -> tuple[DataFrame, DataFrame]:
    """recognize_pages for images that are rows: boxes are found where an image lies, an image travels once to be cut,
    and crops are read where they are cut. recognizer takes crop rasters (crop_id, width, height, rgb) and returns crop_id,
    text, rec_conf."""
    pages = images.select(F.col("image_id").alias("page_id"), F.col("width").cast("double").alias("page_w"), F.col("height").cast("double").alias("page_h"))
    found = checkpointed(detection.detect_in_rasters(images, size, **params).join(pages.select("page_id", "page_w"), "page_id"))
    boxes = checkpointed(layout.merge_regions(found))  # reads them several times
    crops = checkpointed(crop_rasters(images, boxes, orientation_threshold))
    read = recognizer(crops.select(crop_id(F.col("page_id"), F.col("seq")).alias("crop_id"), "width", "height", "rgb"))
    named = boxes.withColumn("crop_id", crop_id(F.col("page_id"), F.col("seq")))
    regions = recognition.assemble_regions(boxes, crops.select("page_id", "seq", "direction", "rotate"), named.select("page_id", "seq", "crop_id").join(read, "crop_id"))
    regions = checkpointed(layout.score_regions(regions, score_threshold))
    return regions, layout.page_text(regions.filter("in_text").join(pages, "page_id"))


def raster_template_recognizer(templates: DataFrame, w: int = 32, h: int = 32, threshold: float = recognition.TEMPLATE_THRESHOLD) -> Callable[[DataFrame], DataFrame]:
    """Reads crop rasters by the nearest template."""
    def read(crops: DataFrame) -> DataFrame:
        found = recognition.match_templates(template_features(crops.withColumnRenamed("crop_id", "image_id"), w, h).withColumnRenamed("image_id", "sample_id"), templates, threshold)
        return found.select(F.col("sample_id").alias("crop_id"), "text", F.col("confidence").alias("rec_conf"))

    return read


def template_features(images: DataFrame, w: int = 32, h: int = 32) -> DataFrame:
    """image_id, feature of rasters."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r["image_id"], rasters.template_feature(rasters.array_of(r), w, h)) for r in rasters.rows_of(b)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.float64()))], names=["image_id", "feature"])

    return rasters.mapped(images.select("image_id", "width", "height", "rgb"), made, "image_id long, feature array<double>")


def template_recognizer(templates: DataFrame, w: int = 32, h: int = 32, threshold: float = recognition.TEMPLATE_THRESHOLD) -> Callable[[DataFrame], DataFrame]:
    def read(crops: DataFrame) -> DataFrame:
        features = pixels.template_feature(crops, w, h).withColumnRenamed("image_id", "sample_id")
        found = recognition.match_templates(features, templates, threshold)
        return found.select(F.col("sample_id").alias("crop_id"), "text", F.col("confidence").alias("rec_conf"))

    return read


def _keyed(samples: DataFrame, *columns: Column) -> DataFrame:
    """columns of samples with _key and _no, which together name a row also where seq is not unique: of rows with one
    seq, those alike in name and label may stand for each other."""
    keyed = samples.select(*columns, F.xxhash64("seq").alias("_key"), F.xxhash64("label_text").alias("_text"))
    return keyed.withColumn("_no", F.row_number().over(W.partitionBy("_key").orderBy("seq", "image_path", "_text"))).drop("_text")


def prepare_training(samples: DataFrame, sizes: DataFrame, char_dict: DataFrame, batch: int = 32) -> DataFrame:
    """Samples ready for training: encoded, split, with width, batch and padded labels. sizes: image_path, w, h. The
    training side is batched by chunks in order, each parted by width; the validation side by width, then in chunks.

    Rows are split and batched by their lengths and sizes alone. Labels travel once, as text, to what was found for
    their row, and are encoded there: neither they nor their indices are stored between."""
    samples = samples.drop("label_indices")
    lengths = recognition.encode_labels(samples, char_dict).withColumn("_n", F.size("label_indices"))
    # filtered behind the window, so that labels are encoded once
    coded = checkpointed(_keyed(lengths, F.col("seq"), F.col("image_path"), F.col("_n")).filter("_n > 0"))
    split = evaluation.split_every_fifth(coded)
    side = F.explode(F.array_compact(F.array(F.when(F.col("in_train"), "train"), F.when(F.col("in_validation"), "validation"))))
    sided = checkpointed(split.withColumn("side", side).join(sizes, "image_path").withColumn("width", g.rec_width(F.col("w"), F.col("h"))).drop("image_path"))
    of = lambda name: sided.filter(F.col("side") == name)
    batched = evaluation.assign_batches(of("train"), batch, "chunk").unionByName(evaluation.assign_batches(of("validation"), batch, "width"))
    longest = batched.withColumn("_most", F.max("_n").over(W.partitionBy("side", "batch_no", "width"))).drop("seq", "_n").withColumnsRenamed({"_key": "_of", "_no": "_of_no"})
    labels = _keyed(samples, *[F.col(c) for c in samples.columns])
    # the same row's key alone deals both sides; labels are never broadcast
    whole = labels.join(longest.hint("merge"), (F.col("_key") == F.col("_of")) & (F.col("_no") - F.col("_of_no") == 0)).drop("_key", "_no", "_of", "_of_no")
    ready_ = recognition.encode_labels(whole, char_dict).withColumn("label_length", F.size("label_indices"))
    return ready_.withColumn("padded", F.concat("label_indices", F.array_repeat(F.lit(0), F.col("_most") - F.col("label_length")))).drop("_most")


#: Bytes of images that a packed row holds unless one alone has more.
PACK_BYTES = 8_000_000
TENSORS = "side string, batch_no int, width int, part int, shape array<int>, tensor binary, seqs array<long>, label_lengths array<int>, padded array<int>"


def training_tensors(samples: DataFrame, images: DataFrame, char_dict: DataFrame, batch: int = 32, augmented: bool = True, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """What a trainer reads: for each side, batch and width one tensor of shape (samples, 3, 48, width), 32-bit floats,
    with the samples' numbers, label lengths and labels padded to the batch's longest. Images of the training side are
    augmented by their content. images: image_path, width, height, rgb.

    Samples are numbered and batched without their images; then images travel once, as bytes, to the task that packs
    their batch, where they are augmented, scaled and normalised. A tensor above pack_bytes comes in parts, each a
    tensor of consecutive samples, so rows are bounded however large a batch is."""
    sizes = images.select("image_path", F.col("width").alias("w"), F.col("height").alias("h"))
    ready_ = prepare_training(samples, sizes, char_dict, batch).select("side", "batch_no", "width", "seq", "image_path", "label_length", "padded")
    raw = images.select("image_path", F.col("width").alias("w"), F.col("height").alias("h"), "rgb")
    dealt = ready_.join(raw, "image_path").drop("image_path").repartition("side", "batch_no", "width").sortWithinPartitions("side", "batch_no", "width", "seq")
    schema = pa.schema([("side", pa.string()), ("batch_no", pa.int32()), ("width", pa.int32()), ("part", pa.int32()), ("shape", pa.list_(pa.int32())), ("tensor", pa.binary()), ("seqs", pa.list_(pa.int64())), ("label_lengths", pa.list_(pa.int32())), ("padded", pa.list_(pa.int32()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held, labels = None, 0, [], []

        def row() -> pa.RecordBatch:
            tensor = np.stack(held)
            values = (*key, part, list(tensor.shape), tensor.tobytes(), [x[0] for x in labels], [x[1] for x in labels], [i for x in labels for i in x[2]])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for b in batches:
            for r in rasters.rows_of(b):
                own = (r["side"], r["batch_no"], r["width"])
                if held and (own != key or (len(held) + 1) * held[0].nbytes > pack_bytes):
                    yield row()
                    part, held, labels = (part + 1 if own == key else 0), [], []
                key = own
                px = rasters.array_of({"rgb": r["rgb"], "width": r["w"], "height": r["h"]})
                if augmented and r["side"] == "train":
                    px = rasters.augment(px, np.ones(px.shape[:2], bool))
                held.append(rasters.recognition_input(px, r["width"]).astype("<f4"))
                labels.append((r["seq"], r["label_length"], r["padded"]))
        if held:
            yield row()

    return rasters.mapped(dealt, pack, TENSORS)


def prepare_dataset(annotations: DataFrame, sizes: DataFrame, char_dict: DataFrame, split: str = "train", least: int = 1) -> DataFrame:
    """Attempts of (annotations, sizes: src, w, h): row_idx, region, name, label, rect, reason (null: to be written)."""
    samples, _ = tables.explode_annotations(annotations)
    keyed = samples.withColumn("key", F.struct("row_idx", "region"))
    clean = recognition.keep_known(keyed.select("key", repair_mojibake(F.col("label")).alias("label")), char_dict, least)
    both = keyed.drop("label").join(clean, "key", "left").join(sizes, "src", "left")
    rect = g.annotation_rect(F.col("bbox"), F.col("w"), F.col("h"))
    both = both.withColumn("rect", F.when(F.col("region") >= 0, rect))
    reason = F.when(F.col("label").isNull(), "label").when((F.col("region") >= 0) & F.col("rect").isNull(), "box")
    return both.select("row_idx", "region", tables.file_name(split).alias("name"), "label", "rect", reason.alias("reason"))

