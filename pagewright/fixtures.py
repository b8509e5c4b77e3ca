"""Document-recognition tables derived from the business and text tables, in Spark and in SQL alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import geometry as g
from .plans.lineage import scratch

PAGE_W, PAGE_H = 400.0, 300.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each order, one region for each line item, in two columns; every seventh page is vertical."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    items = items.withColumn("seq", seq)  # numbered before l_orderkey gets its other name, so what follows by page needs no exchange
    d = items.select(F.col("l_orderkey").alias("page_id"), "seq", "l_partkey", "l_suppkey", F.col("p_name").alias("text"), (1 - F.col("l_discount")).cast("double").alias("det_conf"), (1 - F.col("l_tax")).cast("double").alias("rec_conf"))
    at = F.col("seq") - 1
    down = F.col("page_id") % 7 == 0
    across, along = 20.0 + 160 * (at % 2) + F.col("l_partkey") % 3, 10.0 + 30 * F.floor(at / 2) + F.col("l_suppkey") % 3
    long = 8.0 * F.length("text")
    d = d.withColumns({"x": across, "y": along, "w": F.when(down, 12.0).otherwise(long), "h": F.when(down, long).otherwise(12.0)})
    return d.select("page_id", "seq", "x", "y", "w", "h", g.quad_from_rect(*[F.col(c) for c in "xywh"]).alias("quad"), "text", "det_conf", "rec_conf", g.text_direction(F.col("w"), F.col("h")).alias("direction"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"))


REGIONS = """src AS (SELECT l_orderkey AS page_id, p_name AS text, l_partkey, l_suppkey,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS seq,
    CAST(1 - l_discount AS DOUBLE) AS det_conf, CAST(1 - l_tax AS DOUBLE) AS rec_conf FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT page_id, seq, CAST(20 + 160 * ((seq - 1) % 2) + l_partkey % 3 AS DOUBLE) AS x, CAST(10 + 30 * ((seq - 1) // 2) + l_suppkey % 3 AS DOUBLE) AS y,
    CASE WHEN page_id % 7 = 0 THEN 12.0::DOUBLE ELSE 8.0::DOUBLE * length(text) END AS w, CASE WHEN page_id % 7 = 0 THEN 8.0::DOUBLE * length(text) ELSE 12.0::DOUBLE END AS h,
    text, det_conf, rec_conf, CASE WHEN page_id % 7 = 0 AND 8 * length(text) > 15 THEN 'Vertical' ELSE 'Horizontal' END AS direction, 400.0::DOUBLE AS page_w, 300.0::DOUBLE AS page_h FROM src)"""


def tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose boxes lean by up to 2 pixels."""
    d = regions(spark, sf_dir).withColumn("d", (F.col("seq") % 3).cast("double"))
    x, y, w, h, t = (F.col(c) for c in ("x", "y", "w", "h", "d"))
    return d.withColumn("quad", F.array(g.point(x, y), g.point(x + w, y + t), g.point(x + w - t, y + h + t), g.point(x - t, y + h)))


def gutter_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by supplier: numbered lines with a narrow box at the left of each, as an editor shows them."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    line, part = F.floor(F.col("i") / 2), F.col("i") % 2
    x = F.when(part == 0, 4.0 + F.col("page_id") % 5).otherwise(60.0)
    w = F.when(part == 0, 14.0 + line % 4).otherwise(180.0 + F.col("page_id") % 7)
    d = s.select("page_id", F.col("i").alias("seq"), x.alias("x"), (10.0 + 30.0 * line).alias("y"), w.alias("w"), F.lit(12.0).alias("h"))
    d = d.filter((F.col("page_id") % 4 != 0) | (F.col("seq") > 7))
    return d.withColumns({"quad": g.quad_from_rect(*[F.col(c) for c in "xywh"]), "det_conf": 0.5 + F.col("seq") / 100.0, "text": F.concat(F.lit("t"), F.col("seq")), "page_w": F.lit(PAGE_W), "page_h": F.lit(PAGE_H)})


GUTTER = """r AS (SELECT s_suppkey AS page_id, CAST(i AS INT) AS seq, CASE WHEN i % 2 = 0 THEN 4.0::DOUBLE + s_suppkey % 5 ELSE 60.0 END AS x, 10.0::DOUBLE + 30.0 * (i // 2) AS y,
    CASE WHEN i % 2 = 0 THEN 14.0::DOUBLE + (i // 2) % 4 ELSE 180.0 + s_suppkey % 7 END AS w, 12.0::DOUBLE AS h, 400.0::DOUBLE AS page_w, 0.5::DOUBLE + i / 100.0::DOUBLE AS det_conf
  FROM supplier, range(16) AS t(i) WHERE s_suppkey % 4 <> 0 OR i > 7)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as regions, each with its number before it; every fifth line is missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    d = d.filter(F.col("n") % 5 != 3).withColumn("text", F.concat((F.col("n") + 1).cast("string"), F.lit(" "), "line"))
    box = g.quad_from_rect(F.lit(10.0), 24.0 * F.col("n"), F.lit(300.0), F.lit(12.0))
    return d.select("page_id", F.col("n").alias("seq"), box.alias("quad"), "text", F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"))


IMAGE_W, IMAGE_H = 24, 16


def dealt(ids: DataFrame) -> DataFrame:
    """ids, dealt to all places of the cluster: a file of ids is small and read by one task, what is made of them is not."""
    return ids.repartition(4 * ids.sparkSession.sparkContext.defaultParallelism, *ids.columns)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small image for each supplier, with colours by formula."""
    s = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")))
    d = s.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(IMAGE_H - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(IMAGE_W - 1))))
    v = lambda a, b, c: ((F.col("x") * a + F.col("y") * b + F.col("image_id") * c) % 256).cast("int")
    return d.withColumns({"r": v(7, 13, 17), "g": v(11, 3, 5), "b": v(2, 29, 31)})


def _bgr(i: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([(x * 2 + y * 29 + i * 31) % 256, (x * 11 + y * 3 + i * 5) % 256, (x * 7 + y * 13 + i * 17) % 256], axis=2).astype(np.uint8)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as they are read from files: image_id, width, height, n_channels, data (BGR)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:IMAGE_H, 0:IMAGE_W]
        for b in batches:
            data = pa.array([_bgr(i, y, x).tobytes() for i in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], names=["image_id", "data"])

    ids = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("image_id")))
    return ids.mapInArrow(made, "image_id long, data binary").select("image_id", F.lit(IMAGE_W).alias("width"), F.lit(IMAGE_H).alias("height"), F.lit(3).alias("n_channels"), "data")


def image_files(spark: SparkSession, sf_dir: str, path: str, keep: str, prefix: str = "i") -> None:
    """Bitmap files of the same images, those of suppliers that `keep` says; every tenth (7, 17, ...) is no image."""
    head = b"BM" + (54 + 3 * IMAGE_W * IMAGE_H).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    head += IMAGE_W.to_bytes(4, "little") + IMAGE_H.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        y, x = np.mgrid[IMAGE_H - 1 : -1 : -1, 0:IMAGE_W]  # bottom row first
        for b in batches:
            for i in b.column(0).to_pylist():
                with fs.open_output_stream(f"{root}/{prefix}{i}.bmp") as f:
                    f.write(b"no image" if i % 10 == 7 else head + _bgr(i, y, x).tobytes())
            yield b

    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")).filter(keep).mapInArrow(write, "id long").count()


PIXELS = """px AS (SELECT s_suppkey AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST((x * 7 + y * 13 + s_suppkey * 17) % 256 AS INT) AS r,
    CAST((x * 11 + y * 3 + s_suppkey * 5) % 256 AS INT) AS g, CAST((x * 2 + y * 29 + s_suppkey * 31) % 256 AS INT) AS b FROM supplier, range(16) AS t(y), range(24) AS u(x)),
gray AS (SELECT image_id, y, x, least(greatest(r / 255.0::DOUBLE * 0.299 + g / 255.0::DOUBLE * 0.587 + b / 255.0::DOUBLE * 0.114, 0.0), 1.0) AS v FROM px)"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability map for each supplier: blocks of text, speckles, background."""
    d = pixels(spark, sf_dir).select("image_id", "y", "x")
    x, y, s = F.col("x"), F.col("y"), F.col("image_id")
    block = (x % 12).between(2, 9) & (y % 8).between(2, 5) & ((F.floor(x / 12) + F.floor(y / 8) + s) % 3 != 0)
    return d.withColumn("p", F.when(block, 0.9 - (s % 5) / 50.0).when((x * 31 + y * 17 + s) % 11 == 0, 0.55).otherwise(0.1))


PROB = """prob AS (SELECT s_suppkey AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
    CASE WHEN x % 12 BETWEEN 2 AND 9 AND y % 8 BETWEEN 2 AND 5 AND (x // 12 + y // 8 + s_suppkey) % 3 <> 0 THEN 0.9::DOUBLE - (s_suppkey % 5) / 50.0::DOUBLE
         WHEN (x * 31 + y * 17 + s_suppkey) % 11 = 0 THEN 0.55::DOUBLE ELSE 0.1::DOUBLE END AS p FROM supplier, range(16) AS t(y), range(24) AS u(x)),
fg AS (SELECT * FROM prob WHERE p > 0.3),
reach AS (SELECT image_id, y * 100 + x AS a, y * 100 + x AS b FROM fg
  UNION SELECT r.image_id, r.a, f.y * 100 + f.x FROM reach r JOIN fg f ON f.image_id = r.image_id AND abs(f.y - r.b // 100) + abs(f.x - r.b % 100) = 1),
lab AS (SELECT image_id, b, min(a) AS label FROM reach GROUP BY image_id, b),
comp AS (SELECT f.*, label FROM fg f JOIN lab ON lab.image_id = f.image_id AND lab.b = f.y * 100 + f.x),
stats AS (SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n, avg(p) AS score FROM comp GROUP BY image_id, label)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    return d.select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("feature"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen steps of four classes for each embedding."""
    d = embeddings(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return d.select(F.col("vec_id").alias("crop_id"), "t", F.slice("feature", F.col("t") * 4 + 1, F.lit(4)).alias("v"))


LOGITS = "e AS (SELECT vec_id AS crop_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), lg AS (SELECT crop_id, CAST(t AS INT) AS t, f[t * 4 + 1:t * 4 + 4] AS v FROM e, range(16) AS s(t))"


def small_dict(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0, '<blank>'), (1, 'a'), (2, 'b'), (3, 'c') AS t(idx, ch)")


def char_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All characters of all documents but line breaks, by code point, from 1; a dictionary is bounded by Unicode."""
    chars = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter(~F.col("ch").isin("", "\n")).distinct()
    return chars.withColumn("idx", F.row_number().over(W.orderBy("ch")))


def dict_files(spark: SparkSession, sf_dir: str) -> str:
    """The same characters as two text files, a line each."""
    path = scratch(spark, "chars")
    char_dict(spark, sf_dir).repartitionByRange(2, "idx").sortWithinPartitions("idx").select("ch").write.text(path)
    return path


CHARS = "chars AS (SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS INT) AS idx FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch NOT IN ('', chr(10)))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return d.withColumn("id", F.col("doc_id") * 1_000_000 + F.col("n"))


LINES = "lines AS (SELECT doc_id, doc_id * 1000000 + n - 1 AS id, n - 1 AS n, x[n] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(n))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled sample for each line of each document."""
    return _lines(spark, sf_dir).select(F.col("id").alias("seq"), F.concat(F.col("id"), F.lit(".png")).alias("image_path"), F.col("line").alias("label_text"))


SAMPLES = LINES + ", samples AS (SELECT id AS seq, id || '.png' AS image_path, line AS label_text FROM lines)"


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: each line; predictions with some letters changed in two of three."""
    changed = F.replace(F.replace("line", F.lit("e"), F.lit("3")), F.lit("th"), F.lit("t"))
    d = _lines(spark, sf_dir)
    return d.select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, F.col("line")).otherwise(changed).alias("prediction"), F.col("line").alias("target"), ((F.col("id") % 100) / 100.0).cast("double").alias("confidence"))


#: DuckDB counts edits by byte, so what is not ASCII becomes one byte there.
PREDS = LINES + """, t AS (SELECT id AS sample_id, line AS target FROM lines),
preds AS (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN target ELSE replace(replace(target, 'e', '3'), 'th', 't') END AS prediction, target, (sample_id % 100) / 100.0::DOUBLE AS confidence FROM t),
tr AS (SELECT *, regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') AS p, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS q FROM preds),
ev AS (SELECT *, p = q AS exact, levenshtein(regexp_replace(p, '[^\\x00-\\x7F]', chr(1), 'g'), regexp_replace(q, '[^\\x00-\\x7F]', chr(1), 'g')) AS distance, length(q) AS target_chars FROM tr)"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training progress from events: a day is an epoch."""
    d = table(spark, sf_dir, "events")
    epoch = F.dayofmonth("ts")
    batch = F.row_number().over(W.partitionBy(epoch).orderBy("ts", "event_id"))
    return d.select(F.lit("run").alias("run"), epoch.alias("epoch"), batch.alias("batch"), (F.col("value") / 100.0).cast("double").alias("loss"), (F.col("event_type") == "purchase").cast("int").alias("correct"), F.lit(1).alias("processed"))


PROGRESS = "progress AS (SELECT 'run' AS run, CAST(dayofmonth(ts) AS INT) AS epoch, CAST(row_number() OVER (PARTITION BY dayofmonth(ts) ORDER BY ts, event_id) AS INT) AS batch, CAST(value / 100.0 AS DOUBLE) AS loss, CAST(event_type = 'purchase' AS INT) AS correct, 1 AS processed FROM events)"


def ideographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with ideographs by formula, some of them read in the wrong character set."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex((F.lit(19968) + n).cast("long")), 4, "0")), "UTF-16BE")
    good = F.concat(char(F.col("key") % 20000), char(F.col("key") * 7 % 20000))
    return d.select("key", F.col("p_name").alias("name"), good.alias("good"), F.concat("p_name", good).alias("text"))


IDEOGRAPHS = "cj AS (SELECT p_partkey AS key, p_name AS name, chr(CAST(19968 + p_partkey % 20000 AS INT)) || chr(CAST(19968 + p_partkey * 7 % 20000 AS INT)) AS good, p_name || chr(CAST(19968 + p_partkey % 20000 AS INT)) || chr(CAST(19968 + p_partkey * 7 % 20000 AS INT)) AS text FROM part)"
