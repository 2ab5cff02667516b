"""Streams: mastery per learner as keyed map state with a time to live, request rates with a watermark."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import delete, passing, reliable, shared_folder
from ..params import SETTINGS

_OUT = "student long, concept string, mastery_level double, p_known double, attempts long, correct_attempts long"
_STATE = "p double, attempts long, correct long"
#: The state store that keeps more than one variable for a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bkt(p: float, correct: bool) -> float:
    """One step of Bayesian knowledge tracing, as functions.learner.bkt_step."""
    s, g, t = SETTINGS.p_slip, SETTINGS.p_guess, SETTINGS.p_transit
    post = p * (1 - s) / (p * (1 - s) + (1 - p) * g) if correct else p * s / (p * s + (1 - p) * (1 - g))
    return min(0.99, max(0.01, post + (1 - post) * t))


class Mastery(StatefulProcessor):
    """A learner's concepts as a map: concept to (p, attempts, correct); an entry that idle_ms passes over goes."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.concepts = handle.getMapState("concepts", "concept string", _STATE, self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        answers = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for concept, own in answers.groupby("concept", sort=True, dropna=False):
            name = (None if pd.isna(concept) else concept,)
            p, n, right = self.concepts.getValue(name) if self.concepts.containsKey(name) else (SETTINGS.initial_mastery, 0, 0)
            for correct in own["correct"]:
                p, n, right = bkt(p, bool(correct)), n + 1, right + int(correct)
            self.concepts.updateValue(name, (p, n, right))
            out.append((key[0], name[0], min(1.0, max(0.1, p)), p, n, right))
        yield pd.DataFrame(out, columns=["student", "concept", "mastery_level", "p_known", "attempts", "correct_attempts"])


def mastery(answers: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of answers (student, concept, correct, ts, event_id) to a stream of updated states.

    Answers of one micro-batch count in order of time; across batches, in order of arrival.  With idle_ms a concept that
    a learner hasn't answered about for so long starts anew, and its stream goes on (write_updates, every); without,
    states stay.  Needs the state store STORE.
    """
    return answers.groupBy("student").transformWithStateInPandas(Mastery(idle_ms), _OUT, "Update", "ProcessingTime" if idle_ms else "None")


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str = STORE) -> Iterator[None]:
    """Streams that start inside have this state store; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def rates(events: DataFrame, ts: str, key: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in each window; a window is final, and its state goes, once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")


def write_updates(updates: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts a stream of updates into a folder, a subfolder for each micro-batch, so that a batch that runs again
    replaces what it wrote; returns the query.

    It ends when it has read what is there, or with every (a time) goes on, as states with a time to live need: their
    stream always has one more batch to look at the clock."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    when = {"processingTime": every} if every else {"availableNow": True}
    with state_store(updates.sparkSession):
        return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**when).start()


def write_final(rows: DataFrame, path: str, checkpoint: str):
    """Starts a stream of final rows into a folder; returns the query."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """The last update (column batch: its micro-batch) of each learner and concept."""
    order = F.struct("batch", "attempts")
    return updates.groupBy("student", "concept").agg(*[F.max_by(c, order).alias(c) for c in ("mastery_level", "p_known", "correct_attempts", "attempts")])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states when all events are read; the stream's own folder goes."""
    answers = _stream(spark, sf_dir).select(F.col("user_id").alias("student"), F.col("event_type").alias("concept"), (F.col("value") >= 50).alias("correct"), "ts", "event_id")
    own = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        write_updates(mastery(answers), f"{own}/updates", f"{own}/checkpoint").awaitTermination()
        with passing(spark) as keep:
            return keep(reliable(latest(spark.read.schema(f"{_OUT}, batch long").parquet(f"{own}/updates"))))
    finally:
        delete(spark, own)


def rates_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the windows that the watermark has passed when all events are read."""
    events = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    own, found = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", rates(events, "ts", "event_type")
    try:
        write_final(found, f"{own}/rates", f"{own}/checkpoint").awaitTermination()
        with passing(spark) as keep:
            return keep(reliable(spark.read.schema(found.schema).parquet(f"{own}/rates")))
    finally:
        delete(spark, own)
