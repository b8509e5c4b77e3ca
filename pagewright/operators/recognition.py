"""From class sequences and features to text. logits: (crop_id, t, v ARRAY<DOUBLE>); char_dict: (idx, ch)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed

#: Fixed value: below this similarity a template match has no text.
TEMPLATE_THRESHOLD = 0.40
EPSILON = 1.1920929e-7
#: Bytes of template features that are broadcast at a time.
BLOCK_BYTES = 16_000_000
#: Blocks that are held at a time, features that are compared at a time, and what rounding may be off by.
BLOCKS_AT_ONCE, FEATURES_AT_ONCE, SLACK = 8, 512, 1e-7


def argmax_steps(logits: DataFrame, mode: str = "softmax") -> DataFrame:
    """crop_id, t, idx, conf: the first largest class; its softmax probability, or with mode `probability` its value, 0
    at least."""
    best = F.array_max("v")
    conf = 1.0 / F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x - best)) if mode == "softmax" else F.greatest(best, F.lit(0.0))
    return logits.select("crop_id", "t", (F.array_position("v", best) - 1).cast("int").alias("idx"), conf.alias("conf"))


def ctc_decode(steps: DataFrame, char_dict: DataFrame) -> DataFrame:
    """crop_id, text, confidence: without blanks (0) and repeats of the step before; classes that the dictionary lacks
    emit nothing, but count as the step before. Crops without characters have empty text and confidence 0."""
    last = F.lag("idx", 1, 0).over(W.partitionBy("crop_id").orderBy("t"))
    d = steps.withColumn("_keep", (F.col("idx") != 0) & (F.col("idx") != last)).join(F.broadcast(char_dict.filter("idx > 0")), "idx", "left")
    kept = F.col("_keep") & F.col("ch").isNotNull()
    out = d.groupBy("crop_id").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("t", "ch")))).alias("_c"), F.coalesce(F.avg(F.when(kept, F.col("conf"))), F.lit(0.0)).alias("confidence"))
    return out.select("crop_id", F.array_join(F.transform("_c", lambda c: c["ch"]), "").alias("text"), "confidence")


def to_time_major(outputs: DataFrame, dict_size: int) -> DataFrame:
    """(crop_id, n_rows, n_cols, flat) -> logits. Rows are time steps if n_cols >= n_rows or n_cols is the dictionary's
    size, else columns are. Outputs with fewer classes than the dictionary are dropped; a rest of a step is ignored."""
    by_rows = (F.col("n_cols") >= F.col("n_rows")) | (F.col("n_cols") == dict_size)
    d = outputs.withColumn("_classes", F.when(by_rows, F.col("n_cols")).otherwise(F.col("n_rows"))).withColumn("_rows", by_rows)
    d = d.filter(F.col("_classes") >= dict_size).withColumn("_steps", F.floor(F.size("flat") / F.col("_classes")).cast("int"))
    d = d.withColumn("t", F.explode(F.when(F.col("_steps") > 0, F.sequence(F.lit(0), F.col("_steps") - 1))))
    column = F.transform(F.sequence(F.lit(0), F.col("_classes") - 1), lambda c: F.get("flat", c * F.col("n_cols") + F.col("t")))
    return d.select("crop_id", "t", F.when(F.col("_rows"), F.slice("flat", F.col("t") * F.col("n_cols") + 1, F.col("n_cols"))).otherwise(column).alias("v"))


def _lookup(char_dict: DataFrame) -> Broadcast:
    """The index of each code point, 0 where the dictionary lacks it; Unicode bounds it. Of a character's entries the
    last counts, and only the first character of an entry."""
    known = char_dict.filter("idx > 0 and ch <> ''").groupBy(F.substring("ch", 1, 1).alias("c")).agg(F.max("idx").alias("i")).collect()
    found = np.zeros(max((ord(r["c"]) for r in known), default=0) + 2, np.int32)
    for r in known:
        found[ord(r["c"])] = r["i"]
    return char_dict.sparkSession.sparkContext.broadcast(found)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and where each text's end (from 0 on)."""
    each = pc.fill_null(texts, "")
    points = np.frombuffer("".join(each.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(pc.utf8_length(each).to_numpy(zero_copy_only=False))])


def encode_labels(samples: DataFrame, char_dict: DataFrame) -> DataFrame:
    """samples with label_indices: unknown characters are dropped. Labels are looked up where they lie."""
    sent = _lookup(char_dict)

    @F.arrow_udf("array<int>")
    def coded(labels: pa.Array) -> pa.Array:
        points, ends = _codes(labels)
        idx = sent.value[np.minimum(points, len(sent.value) - 1)]
        kept = np.concatenate([[0], np.cumsum(idx > 0)])[ends]
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(idx[idx > 0]))

    return samples.drop("label_indices").withColumn("label_indices", coded("label_text"))


def keep_known(labels: DataFrame, char_dict: DataFrame, least: int = 1) -> DataFrame:
    """(key, label) -> (key, label) with dictionary characters only, of `least` or more. Labels are filtered where they
    lie."""
    sent = _lookup(char_dict)

    @F.arrow_udf("string")
    def kept(texts: pa.Array) -> pa.Array:
        points, ends = _codes(texts)
        known = sent.value[np.minimum(points, len(sent.value) - 1)] > 0
        text, cuts = points[known].tobytes().decode("utf-32-le"), np.concatenate([[0], np.cumsum(known)])[ends].tolist()
        return pa.array([text[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())

    return labels.select("key", kept("label").alias("label")).filter(F.char_length("label") >= least)


# templates


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(EPSILON))
    return F.transform(F.array(F.struct(v.alias("v"), norm.alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])).getItem(0)


def train_templates(features: DataFrame) -> DataFrame:
    """(sample_id, label, feature) -> (label, sample_count, feature): unit means by label. Features of one label must
    have one length."""
    each = features.select("label", F.size("feature").alias("_d"), F.posexplode("feature").alias("_i", "_x"))
    means = each.groupBy("label", "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    rows = means.groupBy("label").agg(F.max("_n").alias("sample_count"), F.min("_n").alias("_least"), F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_f"))
    checked = F.assert_true(F.col("sample_count") == F.col("_least"), F.lit("template features differ in length"))
    mean = F.transform("_f", lambda x: x["_m"])
    return rows.withColumn("_ok", checked).filter(F.col("_ok").isNull()).select("label", "sample_count", unit(mean).alias("feature"))


class _Clusters:
    """Templates of one length in clusters about some of them. A template's angle to its cluster's centre is at most the
    cluster's radius, so by the triangle inequality a feature's angle to it is at least its angle to the centre less the
    radius: clusters that cannot hold a nearer template than the nearest so far are passed over."""

    def __init__(self, labels: list[str], rows: np.ndarray):
        self.labels, self.rows = labels, rows
        norm = np.maximum(np.linalg.norm(rows, axis=1), EPSILON)
        flat = rows / norm[:, None]
        self.centres = flat[:: max(1, math.isqrt(len(rows)))]
        cosine = flat @ self.centres.T
        own = cosine.argmax(axis=1)
        angle = np.arccos(np.clip(cosine[np.arange(len(own)), own], -1, 1))
        self.members = [np.nonzero(own == k)[0] for k in range(len(self.centres))]
        self.radius = np.array([angle[m].max(initial=0.0) for m in self.members])
        self.norm = np.array([norm[m].max(initial=0.0) for m in self.members])

    def best(self, features: np.ndarray) -> list[tuple[float, str] | None]:
        """(similarity, label) of each feature's nearest template, the greatest label of equally near ones; None where
        none has a similarity above 0."""
        norm = np.linalg.norm(features, axis=1)
        angle = np.arccos(np.clip(features @ self.centres.T / np.maximum(norm, EPSILON)[:, None], -1, 1))
        bound = np.minimum(np.cos(np.clip(angle - self.radius, 0, np.pi)) * self.norm * norm[:, None], 1.0) + SLACK
        top, near = np.zeros(len(features)), [[] for _ in features]
        for k in np.argsort(-bound.sum(axis=0)).tolist():
            at = np.nonzero((bound[:, k] >= top) & (bound[:, k] > 0))[0]
            if not len(at) or not len(self.members[k]):
                continue
            found = np.clip(features[at] @ self.rows[self.members[k]].T, 0.0, 1.0)
            top[at] = np.maximum(top[at], found.max(axis=1))
            for i, j in zip(*np.nonzero((found > 0) & (found >= top[at][:, None] - SLACK)), strict=True):
                near[at[i]].append(int(self.members[k][j]))
        # products of matrices may differ in the last digits from place to place, so what is close is compared anew
        exact = lambda f, j: (min(float((f * self.rows[j]).sum()), 1.0), self.labels[j])
        return [max((exact(f, j) for j in js), default=None) for f, js in zip(features, near, strict=True)]


def match_templates(features: DataFrame, templates: DataFrame, threshold: float = TEMPLATE_THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """sample_id, text, confidence: the nearest template by cosine, the greatest label of equally near ones; empty text
    below the threshold. Features of another length have similarity 0; no templates give no rows.

    Templates are a stated query set against all features: they are dealt by label into blocks of about block_bytes,
    which are sent out one by one and compared by products of matrices, a cluster of templates with a batch of features
    at a time. Only the best of each block goes on, so no pairs are shuffled; features are read once for each block, and
    at most BLOCKS_AT_ONCE blocks are held at a time."""
    n, longest = templates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("feature")), F.lit(1))).first()
    blocks = max(1, -(-n * longest * 8 // block_bytes))
    kind = features.schema["sample_id"].dataType.simpleString()
    slim = features.select("sample_id", "feature")

    def within(i: int) -> tuple[DataFrame, Broadcast]:
        own: dict[int, list] = {}
        for r in templates.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == i).select("label", "feature").collect():
            own.setdefault(len(r["feature"]), []).append((r["label"], r["feature"]))
        last = max((x[0] for rows in own.values() for x in rows), default=None)
        sent = features.sparkSession.sparkContext.broadcast((last, {k: _Clusters([x[0] for x in rows], np.array([x[1] for x in rows], float)) for k, rows in own.items()}))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, by_length = sent.value
            for b in batches if last is not None else ():
                for at in range(0, b.num_rows, FEATURES_AT_ONCE):
                    part = b.slice(at, FEATURES_AT_ONCE)
                    rows = [np.array(x, float) for x in part.column(1).to_pylist()]
                    best: list = [None] * len(rows)
                    for length, clusters in by_length.items():
                        if same := [k for k, x in enumerate(rows) if len(x) == length]:
                            for k, found in zip(same, clusters.best(np.stack([rows[k] for k in same])), strict=True):
                                best[k] = found
                    s, label = zip(*(x or (0.0, last) for x in best), strict=True) if best else ((), ())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(label, pa.string())], names=["sample_id", "s", "label"])

        return slim.mapInArrow(match, f"sample_id {kind}, s double, label string"), sent

    best = F.max(F.struct("s", "label")).alias("_m")
    done: list[DataFrame] = []
    for at in range(0, blocks, BLOCKS_AT_ONCE):
        parts = [within(i) for i in range(at, min(at + BLOCKS_AT_ONCE, blocks))]
        found = reduce(DataFrame.unionByName, [d for d, _ in parts]).groupBy("sample_id").agg(best)
        if blocks > BLOCKS_AT_ONCE:
            found = checkpointed(found)
            for _, sent in parts:
                sent.destroy()
        done.append(found.select("sample_id", "_m.*"))
    whole = done[0] if len(done) == 1 else reduce(DataFrame.unionByName, done).groupBy("sample_id").agg(best).select("sample_id", "_m.*")
    return whole.select("sample_id", F.when(F.col("s") < threshold, "").otherwise(F.col("label")).alias("text"), F.col("s").alias("confidence"))


def assemble_regions(detections: DataFrame, orientation: DataFrame, recognition: DataFrame) -> DataFrame:
    """Regions of (page_id, seq, quad, det_conf) with direction and rotate (Horizontal and false if unknown) and the
    recognised text and rec_conf; regions whose recognition failed are dropped."""
    key = ["page_id", "seq"]
    d = detections.join(orientation.select(*key, "direction", "rotate"), key, "left").join(recognition.select(*key, "text", "rec_conf"), key)
    return d.withColumns({"direction": F.coalesce("direction", F.lit("Horizontal")), "rotate": F.coalesce("rotate", F.lit(False)), "confidence": F.col("det_conf") * F.col("rec_conf")})
