"""Run-log monitor on Structured Streaming: windowed statistics, late rows dropped, alarms."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgewise.functions.shared import fresh_path


def as_log(events: DataFrame) -> DataFrame:
    """Events as log rows: run, upd, value, kind, ts."""
    return events.select((F.col("user_id") % 4).alias("run"), F.col("event_id").alias("upd"), "value", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def windowed(log: DataFrame, width: str) -> DataFrame:
    """ST1: rows, mean and most of the value per run and window; the same for batches and streams."""
    grouped = log.groupBy("run", F.window("ts", width).alias("w")).agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return grouped.select("run", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "rows", "mean", "most")


def alarms(log: DataFrame) -> DataFrame:
    """Rows whose value isn't finite."""
    return log.filter(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))


#: Columns of alarms.
ALARMS = "run long, upd long, alarm string, value double"


def first_alarms(log: DataFrame, tail: int, limit: float) -> DataFrame:
    """ST1 over a whole log: per run the first row whose value isn't finite (``non-finite``), and the first at which the mean of the last ``tail`` finite values is over ``limit`` (``mean``)."""
    bad = alarms(log).groupBy("run").agg(F.min_by(F.struct("upd", F.lit("non-finite").alias("alarm"), F.col("value").cast("double").alias("value")), "upd").alias("x"))
    order = Window.partitionBy("run").orderBy("upd").rowsBetween(1 - tail, 0)
    finite = log.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    trailing = finite.withColumn("mean", F.avg("value").over(order)).withColumn("n", F.count("*").over(order)).filter((F.col("n") == tail) & (F.col("mean") > limit))
    high = trailing.groupBy("run").agg(F.min_by(F.struct("upd", F.lit("mean").alias("alarm"), F.col("mean").alias("value")), "upd").alias("x"))
    return bad.union(high).select(F.col("run").cast("long").alias("run"), F.col("x.upd").cast("long").alias("upd"), "x.alarm", "x.value")


def stream_alarms(log: DataFrame, tail: int, limit: float) -> DataFrame:
    """ST1 on a growing log: the rows of ``first_alarms``, each raised once, and a row ``late`` for each row at or before its run's last update of an earlier batch.

    Each run keeps its last update, its last ``tail`` finite values and what it
    has raised, whatever the log's length. A late row is left out of the means;
    rows of one batch may come in any order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": None, "tail": [], "raised": []}
        rows, out = pd.concat(list(frames)).sort_values("upd", kind="stable"), []
        last = held["last"]

        def once(upd: int, alarm: str, value: float | None) -> None:
            if alarm not in held["raised"]:
                held["raised"].append(alarm)
                out.append((key[0], upd, alarm, value))

        for upd, value in zip(rows["upd"].tolist(), rows["value"].tolist(), strict=True):
            if last is not None and upd <= last:
                out.append((key[0], upd, "late", value))
                continue
            held["last"] = upd
            if value is None or not math.isfinite(value):
                once(upd, "non-finite", value)
                continue
            held["tail"] = [*held["tail"], value][-tail:]
            if len(held["tail"]) == tail and sum(held["tail"]) / tail > limit:
                once(upd, "mean", sum(held["tail"]) / tail)
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["run", "upd", "alarm", "value"]).astype({"run": "int64", "upd": "int64", "alarm": "object", "value": "float64"})

    rows = log.select(F.col("run").cast("long").alias("run"), F.col("upd").cast("long").alias("upd"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("run").applyInPandasWithState(step, ALARMS, "held string", "append", GroupStateTimeout.NoTimeout)


def watch(log: DataFrame, tail: int, limit: float, path: str) -> StreamingQuery:
    """Append alarms to Parquet under ``path``; restarted on it, goes on behind the files it has read and raises nothing twice."""
    return stream_alarms(log, tail, limit).writeStream.outputMode("append").format("parquet").option("path", f"{path}/alarms").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def start_monitor(spark: SparkSession, source: DataFrame, width: str, delay: str, path: str) -> StreamingQuery:
    """Append closed windows to Parquet under ``path``; rows later than ``delay`` are dropped.

    State is bounded by the watermark; the sink and checkpoint are in the shared folder.
    """
    log = as_log(source).withWatermark("ts", delay)
    return windowed(log, width).writeStream.outputMode("append").format("parquet").option("path", f"{path}/windows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def run_once(spark: SparkSession, path: str, width: str, delay: str) -> DataFrame:
    """All windows of the files under ``path`` through a stream, open ones included.

    Each batch's update replaces earlier rows of its windows, so that the
    windows still open at the end are there too.
    """
    # Keeping every partial batch's state is bounded by windows, not rows.
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    out = fresh_path(spark, f"monitor-{uuid.uuid4().hex[:8]}")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/updates")

    log = as_log(stream).withWatermark("ts", delay)
    running = windowed(log, width).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    running.awaitTermination()
    updates = spark.read.parquet(f"{out}/updates")
    last = updates.groupBy("run", "window_start").agg(F.max(F.struct("batch", "rows", "mean", "most")).alias("x"))
    return last.select("run", "window_start", "x.rows", "x.mean", "x.most")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
