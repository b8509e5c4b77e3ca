"""Evaluation, training metrics, and the shape of training batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import strip


def edits(a: str, b: str) -> int:
    """Levenshtein distance by code points: common ends go, the rest is compared by bit vectors (Myers, 1999; Hyyro,
    2003), a step for each character of the shorter one."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    end, most = 0, min(len(a), len(b))
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = sorted((a[: len(a) - end], b[: len(b) - end]), key=len)
    if not a:
        return len(b)
    places: dict[str, bytearray] = {}
    size = (len(b) + 7) // 8
    for i, c in enumerate(b):
        places.setdefault(c, bytearray(size))[i >> 3] |= 1 << (i & 7)
    equal = {c: int.from_bytes(x, "little") for c, x in places.items()}
    full, top, distance = (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    up, down = full, 0
    for c in a:
        same = equal.get(c, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(more & top) - bool(less & top)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return distance


#: Above this product of lengths, bit vectors are faster than Spark's own table of distances.
LONG_PAIR = 10_000
#: Above this one, pairs are dealt anew.
DEALT_PAIR = 1_000


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def eval_report(preds: DataFrame) -> DataFrame:
    """preds (sample_id, prediction, target, confidence) with exact and distance (edits between trimmed texts).

    The work of a pair grows with the product of its lengths and says nothing of where its row lies, so pairs that
    take long are dealt anew, as many to each task; all others are compared where they are."""
    p, t = strip(F.col("prediction")), strip(F.col("target"))
    d = preds.withColumns({"_p": p, "_t": t})
    product = F.char_length("_p").cast("long") * F.char_length("_t")
    costly = F.coalesce((F.col("_p") != F.col("_t")) & (product > DEALT_PAIR), F.lit(False))
    here = d.filter(~costly).withColumn("distance", F.when(F.col("_p") == F.col("_t"), 0).otherwise(F.levenshtein("_p", "_t")))
    dealt = d.filter(costly).repartition(4 * d.sparkSession.sparkContext.defaultParallelism)
    long = F.pandas_udf(_distances, IntegerType())(F.when(product > LONG_PAIR, F.col("_p")), F.when(product > LONG_PAIR, F.col("_t")))
    dealt = dealt.withColumn("distance", F.coalesce(long, F.levenshtein("_p", "_t")))
    return here.unionByName(dealt).withColumns({"exact": F.col("_p") == F.col("_t"), "target_chars": F.char_length("_t")}).drop("_p", "_t")


def line_accuracy(preds: DataFrame) -> DataFrame:
    return eval_report(preds).agg(F.coalesce(F.avg(F.col("exact").cast("double")), F.lit(0.0)).alias("line_accuracy"))


def char_accuracy(preds: DataFrame) -> DataFrame:
    d = eval_report(preds).agg(F.sum("distance").alias("d"), F.sum("target_chars").alias("n"))
    return d.select(F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.greatest(1.0 - F.col("d") / F.col("n"), F.lit(0.0))).alias("char_accuracy"))


def validation_accuracy(preds: DataFrame) -> DataFrame:
    """Exact matches with the full label; 1 without samples."""
    return preds.agg(F.coalesce(F.avg((F.col("prediction") == F.col("target")).cast("double")), F.lit(1.0)).alias("accuracy"))


def _at(steps: Column, place: Column) -> Column:
    return F.least(F.greatest(F.floor(place), F.lit(0)), steps - 1).cast("int")


def alignment_loss(probs: DataFrame, samples: DataFrame) -> DataFrame:
    """crop_id, loss: each label character at the middle of its share of time steps (a later one wins a tie), blanks
    elsewhere; the mean of -ln(probability). probs: crop_id, t, v; samples: crop_id, label_indices."""
    n = F.size("label_indices")
    steps = probs.groupBy("crop_id").agg((F.max("t") + 1).alias("_steps"))
    chars = samples.join(steps, "crop_id").select("crop_id", "_steps", n.alias("_n"), F.posexplode("label_indices").alias("_i", "_c"))
    placed = chars.groupBy("crop_id", _at(F.col("_steps"), (F.col("_i") + 0.5) / F.col("_n") * F.col("_steps")).alias("t")).agg(F.max_by("_c", "_i").alias("_c"))
    d = probs.join(samples.select("crop_id"), "crop_id", "left_semi").join(placed, ["crop_id", "t"], "left")
    p = F.coalesce(F.get("v", F.coalesce("_c", F.lit(0))), F.lit(0.0))
    return d.groupBy("crop_id").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-6)))).alias("loss"))


def simple_ctc_loss(logprobs: DataFrame, samples: DataFrame) -> DataFrame:
    """crop_id, loss: the mean of -log probability of each label character at the start of its share of steps; 0 for
    empty labels."""
    n = F.size("label_indices")
    steps = logprobs.groupBy("crop_id").agg((F.max("t") + 1).alias("_steps"))
    chars = samples.join(steps, "crop_id").select("crop_id", "_steps", n.alias("_n"), F.posexplode("label_indices").alias("_i", "_c"))
    placed = chars.withColumn("t", _at(F.col("_steps"), F.col("_i") * (F.col("_steps") / F.col("_n"))))
    loss = placed.join(logprobs, ["crop_id", "t"]).groupBy("crop_id").agg(F.avg(-F.get("v", F.col("_c"))).alias("loss"))
    return samples.select("crop_id").join(loss, "crop_id", "left").select("crop_id", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def running_metrics(batches: DataFrame) -> DataFrame:
    """batches (run, epoch, batch, loss, correct, processed) with the epoch's loss and accuracy so far."""
    w = W.partitionBy("run", "epoch").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    return batches.withColumns({"running_loss": F.avg("loss").over(w), "running_accuracy": F.sum("correct").over(w) / F.greatest(F.sum("processed").over(w), F.lit(1))})


def best_checkpoint(metrics: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Of (run, epoch, loss, accuracy) the row of each run with the best accuracy, then the least loss, then the latest
    epoch. runs (run, accuracy: measured before training) gives what each run starts from: epoch 0 with that accuracy
    and infinite loss, which stays the best until an epoch is as accurate. Without `accuracy` it is 0."""
    rows = metrics.select("run", F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss"), F.col("accuracy").cast("double").alias("accuracy"))
    if runs is not None:
        measured = F.col("accuracy").cast("double") if "accuracy" in runs.columns else F.lit(0.0)
        rows = rows.unionByName(runs.select("run", F.lit(0).alias("epoch"), F.lit(math.inf).alias("loss"), measured.alias("accuracy")).distinct())
    key = F.struct("accuracy", -F.col("loss"), "epoch")
    return rows.groupBy("run").agg(F.max_by(F.struct("epoch", "loss", "accuracy"), key).alias("b")).select("run", "b.*")


#: Ranges of seq that rows are numbered in.
RANGES = 512


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with _place: each row's number from 0 in order of seq within keys, exact over any number of rows.

    Ranges are quantiles of seq, so neither a hot key nor far-off values of seq put many rows into one: rows are counted
    by key and range, and only numbered within them. Null keys are a key. df is read three times; store it first if it is
    costly."""
    cuts = df.agg(F.percentile_approx(F.col("seq").cast("double"), [i / RANGES for i in range(1, RANGES)], 8 * RANGES)).first()[0]
    splits = [-math.inf, *sorted(set(cuts or [0.0])), math.inf]
    d = Bucketizer(splits=splits, inputCol="_seq", outputCol="_range", handleInvalid="keep").transform(df.withColumn("_seq", F.col("seq").cast("double"))).drop("_seq")
    parts = d.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    earlier = (W.partitionBy(*keys) if keys else W).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_range").orderBy("seq")) - 1
    return d.join(parts, same).withColumn("_place", place).select(*df.columns, "_place")


def split_every_fifth(samples: DataFrame) -> DataFrame:
    """samples with in_train and in_validation: every fifth row by seq validates; a single row does both."""
    one = F.lit(samples.limit(2).count() <= 1)
    fifth = F.col("_place") % 5 == 0
    return numbered(samples, []).select(*samples.columns, (one | ~fifth).alias("in_train"), (one | fifth).alias("in_validation"))


def assign_batches(samples: DataFrame, size: int = 32, by: str = "width", parts: list[str] | None = None) -> DataFrame:
    """samples (seq, width) with batch_no: for inference (`width`) batches within one width; for training (`chunk`)
    chunks in order, each parted by width. parts name columns that batches never cross."""
    keys = [*(parts or []), *(["width"] if by == "width" else [])]
    return numbered(samples, keys).select(*samples.columns, F.floor(F.col("_place") / size).cast("int").alias("batch_no"))


def pad_batches(samples: DataFrame, keys: list[str]) -> DataFrame:
    """samples with label_length and padded (label_indices filled up with 0 to the batch's longest)."""
    most = F.max(F.size("label_indices")).over(W.partitionBy(*keys))
    fill = F.array_repeat(F.lit(0), most - F.size("label_indices"))
    return samples.withColumns({"label_length": F.size("label_indices"), "padded": F.concat("label_indices", fill)})


def latest_models(registry: DataFrame, k: int = 1) -> DataFrame:
    """The k newest rows of a registry; of equally new ones the greater name first."""
    return registry.orderBy(F.desc("created_at"), F.desc("name")).limit(k)
