"""Readers and writers, with explicit schemas."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sanitize_name, strip

IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp")
#: Fixed value: the characters used where no dictionary file is there; the space is the last.
BUILTIN_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,:;!?+-*/=_()[]{}<>@#%&'\" "
ANNOTATIONS = "rows ARRAY<STRUCT<row_idx BIGINT, row STRUCT<image STRUCT<src STRING>, text STRING, label STRING, texts ARRAY<STRING>, bboxes ARRAY<ARRAY<DOUBLE>>>>>"
TEMPLATES = "model_id STRING, label STRING, sample_count BIGINT, feature ARRAY<DOUBLE>"
MANIFEST = "name STRING, created_at BIGINT, base_model_name STRING, weights_file STRING, dict_file STRING, metrics STRUCT<train_samples BIGINT, validation_samples BIGINT, accuracy DOUBLE, avg_loss DOUBLE>"


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, rejects): image_id, origin, width, height, n_channels, data; files that can't be decoded are rejects."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    images = found.filter("width > 0").select(F.xxhash64("origin").alias("image_id"), "origin", "width", "height", F.col("nChannels").alias("n_channels"), "data")
    return images, found.filter("width <= 0").select("origin", F.lit("undecodable").alias("reason"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: file, line (from 1, within its file), seq (from 1, over all files in order of name), value.
    Lines end at \\n; one \\r before it goes.

    Files may be of any size: a line's place in the split that Spark reads is known without a sort, and the lines of
    earlier splits are one small sum over splits."""
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    text = spark.read.option("lineSep", "\n").text(path).select(block.alias("b"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("value"))
    text = text.select("b.file", "b.start", "_id", "value")
    blocks = text.groupBy("file", "start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_of_file": upto(W.partitionBy("file").orderBy("start")), "_of_all": upto(W.orderBy("file", "start"))}).drop("_n")
    place = F.col("_id") - F.col("_first") + 1
    return text.join(blocks, ["file", "start"]).select("file", (F.col("_of_file") + place).alias("line"), (F.col("_of_all") + place).alias("seq"), "value")


def parse_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, line, seq, value) -> (samples, rejects): the trimmed line is split at its first tab; blank lines are
    skipped, lines without both parts are rejects."""
    d = lines.withColumn("value", strip(F.col("value"))).filter("value <> ''").withColumn("_p", F.split("value", "\t", 2))
    good = d.filter(F.size("_p") == 2).select(F.col("seq").cast("long").alias("seq"), F.col("_p")[0].alias("image_path"), F.col("_p")[1].alias("label_text"))
    return good, d.filter(F.size("_p") < 2).select("file", "line", "value", F.lit("not two parts").alias("reason"))


def read_labels(spark: SparkSession, path: str, mode: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of `name<TAB>label` files: seq, image_path, label_text. seq counts the lines of all files, in
    order of file name. mode raw drops blank labels; mode encoded leaves them to the encoder."""
    samples, rejects = parse_labels(_lines(spark, path))
    return (samples.filter(F.length(strip(F.col("label_text"))) > 0) if mode == "raw" else samples), rejects


def encoded_only(samples: DataFrame) -> DataFrame:
    return samples.filter(F.size("label_indices") > 0)


def join_images(samples: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, missing): samples with the image of their file name, and those without one."""
    named = images.withColumn("_name", F.element_at(F.split("origin", "/"), -1))
    joined = samples.join(named, samples["image_path"] == named["_name"]).drop("_name")
    return joined, samples.join(named, samples["image_path"] == named["_name"], "left_anti")


def number_chars(lines: DataFrame) -> DataFrame:
    """(seq, value) -> char_dict (idx, ch): entries count from 1, 0 is the blank; without an entry of one space, an
    ideographic space stands for it. A dictionary is one small file."""
    d = lines.filter("value <> ''").withColumn("idx", F.row_number().over(W.orderBy("seq")))
    has_space = F.max((F.col("value") == " ").cast("int")).over(W.partitionBy()) == 1
    ch = F.when(~has_space & (F.col("value") == "　"), " ").otherwise(F.col("value"))
    blank = d.sparkSession.sql("SELECT 0 AS idx, '<blank>' AS ch")
    return blank.unionByName(d.select("idx", ch.alias("ch")))


def read_char_dict(spark: SparkSession, path: str) -> DataFrame:
    return number_chars(_lines(spark, path))


def builtin_char_dict(spark: SparkSession) -> DataFrame:
    chars = spark.range(1).select(F.posexplode(F.split(F.lit(BUILTIN_CHARS), "")).alias("idx", "ch")).filter("ch <> ''")
    return spark.sql("SELECT 0 AS idx, '<blank>' AS ch").unionByName(chars.select((F.col("idx") + 1).alias("idx"), "ch"))


def parse_annotations(pages: DataFrame) -> DataFrame:
    """(rows) -> row_idx, src, text (or label), texts, bboxes; absent arrays are empty."""
    each = pages.select(F.explode("rows").alias("r")).select("r.row_idx", "r.row.*")
    return each.select("row_idx", F.col("image.src").alias("src"), F.coalesce("text", "label").alias("text"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), F.coalesce("bboxes", F.array().cast("array<array<double>>")).alias("bboxes"))


def read_dataset_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Annotated pages of JSON files; with multi_line=False, of files that hold a page object a line."""
    return parse_annotations(spark.read.schema(ANNOTATIONS).option("multiLine", multi_line).json(path))


def explode_annotations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, skipped): row_idx, region (-1: the whole image), src, label, bbox; skipped: reason, n."""
    whole = df.filter(F.size("bboxes") == 0).select("row_idx", F.lit(-1).alias("region"), "src", F.col("text").alias("label"), F.lit(None).cast("array<double>").alias("bbox"))
    parts = df.select("row_idx", "src", "texts", F.posexplode("bboxes").alias("region", "bbox"))
    parts = parts.select("row_idx", "region", "src", F.get("texts", F.col("region")).alias("label"), "bbox")
    both = whole.unionByName(parts)
    reason = F.when(F.col("region") < 0, "no text").otherwise("no text for the box")
    return both.filter("label is not null"), both.filter("label is null").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def label_lines(samples: DataFrame, split: str) -> DataFrame:
    """name, line of (row_idx, region, label): `split_row[_region].jpg`, and with the label behind a tab."""
    name = file_name(split)
    return samples.select("row_idx", "region", name.alias("name"), F.concat_ws("\t", name, "label").alias("line"))


def file_name(split: str) -> Column:
    return F.concat(F.lit(f"{split}_"), F.col("row_idx"), F.when(F.col("region") >= 0, F.concat(F.lit("_"), F.col("region"))).otherwise(""), F.lit(".jpg"))


def write_labels(samples: DataFrame, path: str, split: str) -> None:
    lines = label_lines(samples, split).repartitionByRange("row_idx", "region").sortWithinPartitions("row_idx", "region")
    lines.select("line").write.mode("overwrite").text(path)


def ingest_report(attempts: DataFrame) -> DataFrame:
    """written, skipped of rows with `reason` (null: written)."""
    return attempts.agg(F.count_if(F.col("reason").isNull()).alias("written"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))


def save_templates(templates: DataFrame, path: str) -> None:
    templates.select("model_id", "label", "sample_count", "feature").write.mode("overwrite").partitionBy("model_id").json(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATES).json(path)


def model_dir(created_at: Column, name: Column) -> Column:
    return F.concat_ws("-", created_at.cast("string"), sanitize_name(name, "ai-recognizer"))


def _written(rows: DataFrame, root: str) -> None:
    """A file of each row (model_dir, file, text) below root, written by the tasks, each under its final name, whole: a
    task that runs again writes the same. Rows are dealt first, as a file takes long for what it holds."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        for b in batches:
            for folder, file, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs.create_dir(f"{base}/{folder}", recursive=True)
                with fs.open_output_stream(f"{base}/{folder}/{file}") as f:
                    f.write(text.encode())
            yield b.select(["model_dir"])

    places = 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows.select("model_dir", "file", "text").repartition(places, "model_dir").mapInArrow(write, "model_dir string").count()


def register_model(models: DataFrame, root: str) -> None:
    """One folder `model_dir=<created_at>-<name>` with a manifest for each row of the manifest's columns. Models that are
    registered again get another manifest beside the first."""
    folder = F.concat(F.lit("model_dir="), model_dir(F.col("created_at"), F.col("name")))
    file = F.concat(F.lit(f"part-{uuid.uuid4().hex}-"), F.substring(F.sha2("text", 256), 1, 16), F.lit(".json"))
    _written(models.select(folder.alias("model_dir"), F.to_json(F.struct(*models.columns)).alias("text")).withColumn("file", file), root)


#: Characters of files that are sent on at a time, unless one alone has more.
CHARS_AT_ONCE = 4_000_000


def files_below(spark: SparkSession, root: str, file: str = "*") -> DataFrame:
    """path, text of all files in and below root whose name fits; hidden ones (as Spark has it, `.` or `_` first) are left
    out. One task lists root, tasks list its folders and read: neither paths nor files pass through the driver."""
    hidden = lambda path: any(x[0] == "." or (x[0] == "_" and "=" not in x) for x in path.split("/") if x)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, base = FileSystem.from_uri(root)
            found = [x.path for x in fs.get_file_info(FileSelector(base))]
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000], pa.string())], names=["path"])

    def files(fs: FileSystem, base: str, paths: list[str]) -> Iterator[str]:
        for info in fs.get_file_info(paths):
            inside = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(info.path, recursive=True))
            yield from (x.path for x in inside if x.type == FileType.File and fnmatchcase(x.base_name, file) and not hidden(x.path[len(base) :]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        held, n = [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "text"])
        for b in batches:
            for path in files(fs, base, b.column(0).to_pylist()):
                with fs.open_input_stream(path) as f:
                    held.append((path, f.read().decode(errors="replace")))
                n += len(held[-1][1]) + 200
                if n >= CHARS_AT_ONCE:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    listed = spark.range(0, 1, 1, 1).mapInArrow(entries, "path string")
    return listed.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(read, "path string, text string")


def _manifests(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """Readable manifests of that file name in folders below root, with model_dir; others are left out.
    Fields that the schema lacks are not parsed."""
    parsed = F.from_json("text", schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("model_dir")
    d = files_below(spark, root, file).select(folder, F.explode(F.array(parsed)).alias("m")).select("m.*", "model_dir")  # explode: parsed once
    return d.filter("_corrupt is null and name is not null and created_at is not null").drop("_corrupt")


def list_models(spark: SparkSession, root: str, file: str = "*.json") -> DataFrame:
    """Readable manifests below root, newest first. file: their name, where other JSON lies beside them."""
    d = _manifests(spark, root, file, MANIFEST).select("model_dir", "name", "created_at", "base_model_name", "metrics.*")
    return _newest_first(d)


def _newest_first(d: DataFrame) -> DataFrame:
    """d in order. A sort over ranges reads what it sorts twice, so rows are dealt before: files are read once."""
    return d.repartition("model_dir").orderBy(F.desc("created_at"), F.desc("name"))


#: Fixed value: the name of a template model's file. It holds the templates themselves, and what describes them.
TEMPLATE_FILE = "template-model.json"
_TEMPLATE_METRICS = "metrics STRUCT<train_samples BIGINT, validation_samples BIGINT, accuracy DOUBLE, avg_loss DOUBLE>"
TEMPLATE_MODEL = f"name STRING, created_at BIGINT, input_width INT, input_height INT, similarity_threshold DOUBLE, templates ARRAY<STRUCT<label STRING, sample_count BIGINT, feature ARRAY<DOUBLE>>>, {_TEMPLATE_METRICS}"


def save_template_models(models: DataFrame, root: str) -> None:
    """One folder `<created_at>-<name>` with a template model's file for each row of TEMPLATE_MODEL."""
    names = [x.split()[0] for x in ("name", "created_at", "input_width", "input_height", "similarity_threshold", "templates", "metrics")]
    folder = F.concat_ws("-", F.col("created_at").cast("string"), sanitize_name(F.col("name"), "template-model"))
    _written(models.select(folder.alias("model_dir"), F.lit(TEMPLATE_FILE).alias("file"), F.to_json(F.struct(*names)).alias("text")), root)


def list_template_models(spark: SparkSession, root: str) -> DataFrame:
    """The template models below root, newest first: model_dir, name, created_at, template_count, input_width,
    input_height, accuracy, avg_loss. Of the templates only labels are parsed, to be counted; unreadable files are left
    out."""
    slim = f"name STRING, created_at BIGINT, input_width INT, input_height INT, templates ARRAY<STRUCT<label STRING>>, {_TEMPLATE_METRICS}"
    d = _manifests(spark, root, TEMPLATE_FILE, slim).filter("templates is not null")
    d = d.select("model_dir", "name", "created_at", F.size("templates").alias("template_count"), "input_width", "input_height", "metrics.accuracy", "metrics.avg_loss")
    return _newest_first(d)


def load_template_models(spark: SparkSession, root: str) -> DataFrame:
    """model_dir, label, sample_count, feature of all readable template models below root."""
    d = _manifests(spark, root, TEMPLATE_FILE, TEMPLATE_MODEL).filter("templates is not null")
    return d.select("model_dir", F.explode("templates").alias("t")).select("model_dir", "t.*")
