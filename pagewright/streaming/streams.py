"""Continuous forms: pages as they arrive, and training progress."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import pixels
from ..plans import pipelines

EVERY = {"processingTime": "10 seconds"}
PROGRESS = "run string, epoch int, batch int, total_batches int, loss double, accuracy double"
IMAGE = "image STRUCT<origin STRING, height INT, width INT, nChannels INT, mode INT, data BINARY>"


def arrivals(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """A stream of a folder's image files, an image once: image_id, origin, arrived, width, height, n_channels, data. Of
    files with the same pixels only the first goes on, also if another comes in a later batch, as long as it is not
    `late` older than the newest; that bounds the state. Files that can't be decoded have width -1."""
    read = spark.readStream.format("image").schema(IMAGE).option("dropInvalid", False).load(path)
    d = read.select("image.*", F.col("_metadata.file_modification_time").alias("arrived"))
    d = d.select(F.xxhash64("origin").alias("image_id"), "origin", "arrived", "width", "height", F.col("nChannels").alias("n_channels"), "data")
    shown = F.sha2(F.concat_ws(":", "width", "height", "n_channels", F.sha2("data", 256)), 256)
    d = d.withColumn("_shown", F.when(F.col("width") > 0, shown).otherwise(F.concat(F.lit("file:"), "origin")))
    return d.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["_shown"]).drop("_shown")


def stream_pages(spark: SparkSession, path: str, out: str, checkpoint: str, recognise: Callable[[DataFrame], DataFrame], late: str = "7 days", **trigger) -> StreamingQuery:
    """Image files of a folder, each recognised once, as they come: every micro-batch goes through `recognise` (page
    pixels to text rows) to <out>/pages, and what can't be decoded to <out>/quarantine (origin, arrived, reason), by
    batch, so a batch that is run again replaces its own rows. The query stays up, looking for files every ten seconds;
    `trigger` may say otherwise (availableNow=True: what is there)."""
    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            bad = batch.filter("width <= 0").select("origin", "arrived", F.lit("undecodable").alias("reason"))
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={n}")
            recognise(pixels.to_pixels(batch.filter("width > 0"))).write.mode("overwrite").parquet(f"{out}/pages/batch={n}")
        finally:
            batch.unpersist()

    return arrivals(spark, path, late).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY)).start()


def stream_recognition(spark: SparkSession, path: str, out: str, checkpoint: str, recognizer: Callable[[], Callable[[DataFrame], DataFrame]], size: int = 512, params: dict | None = None, **trigger) -> StreamingQuery:
    """The whole recognition job on every micro-batch: page_id and text of each page that arrives. recognizer is asked
    for the recogniser as each batch starts, so another may take over while the stream goes on."""
    return stream_pages(spark, path, out, checkpoint, lambda px: pipelines.recognize_pages(px, recognizer(), size, **(params or {}))[1], **trigger)


def epoch_metrics(progress: DataFrame) -> DataFrame:
    """run, epoch, loss, accuracy (means), batches; for batch or streaming progress events."""
    return progress.groupBy("run", "epoch").agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("batches"))


BEST = "run string, epoch int, at_batch int, loss double, accuracy double"


class _Best(StatefulProcessor):
    """A run's best event so far: greatest accuracy, then least loss, then latest. A run begins with what its initial
    model was measured at, where that is known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._best = handle.getValueState("best", "epoch int, at_batch int, loss double, accuracy double")

    @staticmethod
    def _rank(row: tuple) -> tuple:
        epoch, batch, loss, accuracy = row
        return accuracy, -loss, epoch, batch

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._best.update((0, 0, math.inf, float(initialState["accuracy"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = tuple(self._best.get()) if self._best.exists() else None
        for pdf in rows:
            for e, b, loss, acc in zip(pdf["epoch"].tolist(), pdf["batch"].tolist(), pdf["loss"].tolist(), pdf["accuracy"].tolist(), strict=True):
                if best is None or self._rank((e, b, loss, acc)) >= self._rank(best):
                    best = (e, b, loss, acc)
        self._best.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["run", "epoch", "at_batch", "loss", "accuracy"])

    def close(self) -> None:
        pass


def best_so_far(progress: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """run and its best event of a stream of progress, one row of state for each run. runs (run, accuracy) has what the
    initial models were measured at: epoch 0, which stays the best until an event is as accurate."""
    start = None if runs is None else runs.select("run", F.col("accuracy").cast("double").alias("accuracy")).groupBy("run")
    slim = progress.select("run", "epoch", "batch", "loss", "accuracy")
    return slim.groupBy("run").transformWithStateInPandas(_Best(), BEST, "Update", "None", initialState=start)


_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_progress(progress: DataFrame, out: str, checkpoint: str, runs: DataFrame | None = None, **trigger) -> tuple[StreamingQuery, StreamingQuery]:
    """Two queries over a stream of progress events, in update mode: below <out>/epochs and <out>/best each micro-batch
    writes the rows that it changed. `latest` gives the rows as they stand. runs: as for best_so_far."""
    def start(df: DataFrame, part: str) -> StreamingQuery:
        def each(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{part}/batch={n}")

        writer = df.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{checkpoint}/{part}")
        return writer.trigger(**(trigger or EVERY)).start()

    epochs, conf = start(epoch_metrics(progress), "epochs"), progress.sparkSession.conf
    before = {k: conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():  # a query keeps the provider that it starts with
        conf.set(k, v)
    try:
        return epochs, start(best_so_far(progress, runs), "best")
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of the rows that micro-batches wrote below path, the last of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
