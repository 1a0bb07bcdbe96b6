"""Structured Streaming forms of the incremental jobs. State and progress live in a checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql import functions as F

from ..runtime import latest, new_path


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path) if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def dedup(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once ``delay`` behind the latest event time."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str, delay: str) -> DataFrame:
    x = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return x.groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_once(stream: DataFrame, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Process what is there and return what was written.

    With ``keys``, batches are deduplicated on them before they are written under their batch number, so that a batch
    repeated after a failure replaces itself. In complete mode each batch holds the whole result so far and replaces
    the one before it.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"batches of mode {mode} would have to be merged by key")
    spark = stream.sparkSession
    root = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        part = "all" if mode == "complete" else number
        (batch.dropDuplicates(keys) if keys else batch).write.mode("overwrite").parquet(f"{root}/out/batch={part}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def upsert_once(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Process what is there as an upsert: of each key the row with the greatest ``order`` over all batches.

    Each batch writes the merged table under its own number and reads the one before it, so a batch repeated after a
    failure gives the same result, and late batches do not overwrite later values.
    """
    spark = stream.sparkSession
    root = new_path(spark, "upsert")
    last: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        kept = [p for p in last if not p.endswith(f"={number}")]
        rows = spark.read.schema(stream.schema).parquet(kept[-1]).unionByName(batch) if kept else batch
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{root}/table={number}")
        last[:] = [*kept, f"{root}/table={number}"]

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)


def above_water_mark(stream: DataFrame, existing: DataFrame, by: str, date: str) -> DataFrame:
    """Rows of a stream later than the last date held for their ``by``; all of those it holds none for."""
    mark = existing.groupBy(by).agg(F.max(date).alias("_mark"))
    return stream.join(mark, by, "left").filter(F.col("_mark").isNull() | (F.col(date) > F.col("_mark"))).drop("_mark")


class Progress(StreamingQueryListener):
    """Rows and seconds of each batch, with the mean rate of the last ``window`` batches."""

    def __init__(self, window: int = 20):
        self.window = window
        self.batches: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, (p.batchDuration or 0) / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rate(self) -> float:
        """Rows a second over the last batches; 0 before any."""
        held = self.batches[-self.window :]
        return sum(n for _, n, _ in held) / max(sum(s for *_, s in held), 1e-9) if held else 0.0

    def seconds_left(self, rows: int) -> float | None:
        r = self.rate()
        return rows / r if r else None
