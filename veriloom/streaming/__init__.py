"""Structured Streaming variants of the record pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriloom.session import shared_dir, written


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def new_records(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark. State older than the watermark is dropped."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", slide: str | None = None, late: str = "30 days") -> DataFrame:
    """Counts and sums by event-time window and group; rows later than the watermark are left out."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return s.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def fold_states(events: DataFrame, key: str = "process_id") -> DataFrame:
    """(process_id, rounds, solved, version): the search state of each record, folded from its verify events (attempt, round, event_id, verdict) as they come.

    A round of an attempt counts once, however often and late its events come; solved is the verdict of the latest
    one seen, of several events of it that with the largest id. State is that and the rounds seen of a record; the
    version counts its updates.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, round_, event, solved, version, seen = state.get if state.exists else (-1, -1, -1, False, 0, [])
        latest, places = (attempt, round_, event), {tuple(map(int, s.split("/"))) for s in seen}
        for f in frames:
            f = f[f["kind"] == "verify"]
            for a, r, e, v in zip(f["attempt"], f["round"], f["event_id"], f["verdict"]):
                place = (int(a), int(r), int(e))
                places.add(place[:2])
                if place >= latest:
                    latest, solved = place, bool(v)
        state.update((*latest, solved, version + 1, [f"{a}/{r}" for a, r in sorted(places)]))
        yield pd.DataFrame({key: [k[0]], "rounds": [len(places)], "solved": [solved], "version": [version + 1]})

    held = "attempt long, round long, event long, solved boolean, version long, seen array<string>"
    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, rounds int, solved boolean, version long", held, "update", GroupStateTimeout.NoTimeout)


def rolling_monitor(stream: DataFrame, value: str, order: str, by: list[str], sink: Callable[[DataFrame, int], None], n: int = 50) -> StreamingQuery:
    """A running query that hands the sink, for each micro-batch, its rows with the mean of the n latest up to each, those of earlier batches included.

    Between batches the last n - 1 rows of each group are kept in the shared folder. Rows are in order within a batch; one
    that comes in a later batch counts as later.
    """
    base = written(f"{shared_dir(stream.sparkSession)}/monitor-{uuid.uuid4().hex}")
    kept: dict[str, str] = {}

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_new", F.lit(epoch))
        if kept:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(kept["tail"]))
        w = Window.partitionBy(*by).orderBy("_new", order)
        told = rows.withColumn("trailing_mean", F.avg(value).over(w.rowsBetween(-(n - 1), 0)))
        sink(told.filter(F.col("_new") == epoch).drop("_new"), epoch)
        last = Window.partitionBy(*by).orderBy(F.desc("_new"), F.desc(order))
        path = f"{base}/epoch={epoch}"
        rows.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") < n).drop("_n").write.mode("overwrite").parquet(path)
        kept["tail"] = path

    return stream.writeStream.foreachBatch(each).trigger(availableNow=True).start()


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now through the stream into a table of the shared folder; `complete` rewrites the table each time."""
    spark = stream.sparkSession
    base = written(f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")

    def each(batch: DataFrame, epoch: int) -> None:
        # overwriting an epoch's folder makes a repeated epoch harmless
        batch.write.mode("overwrite").parquet(f"{base}/out/" + ("all" if mode == "complete" else f"epoch={epoch}"))

    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/" + ("all" if mode == "complete" else "epoch=*"))
