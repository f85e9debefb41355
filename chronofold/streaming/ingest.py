"""Micro-batch ingestion: records in once, roll-ups merged as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from chronofold.operators import normalize, query
from chronofold.schema import ROW

Hook = Callable[[DataFrame], DataFrame]


def read(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Records that arrive as JSON lines in a folder, so many files a batch."""
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files).json(path)


def once(batch: DataFrame) -> DataFrame:
    """One row of each id."""
    of = Window.partitionBy("id").orderBy("occurred_at", "conversation_id", "content")
    return batch.withColumn("__n", F.row_number().over(of)).where("__n = 1").drop("__n")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _path(spark, path)
    return files.exists(target)


def _numbers(spark: SparkSession, path: str, name: str, whole: bool = False) -> list[int]:
    """The numbers of the folders name=N below path, in order; only those that were written to their end, if asked."""
    files, target = _path(spark, path)
    if not files.exists(target):
        return []
    found = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(int(f.partition("=")[2]) for f in found if f.startswith(f"{name}=") and (not whole or _exists(spark, f"{path}/{f}/_SUCCESS")))


def ingest(stream: DataFrame, out: str, checkpoint: str, before_send: Hook | None = None, every: str | None = None) -> StreamingQuery:
    """Append a stream's records to ``out``/records, their ids to ``out``/ids, their partial roll-ups to ``out``/deltas.

    Records come once by id, however late: a batch is joined with the ids that stand already, so nothing is lost to a
    watermark. A batch has its own folders, written anew when it is repeated, so that a restart adds nothing twice.
    ``before_send`` changes or drops records first.
    """
    kept = before_send(stream) if before_send else stream
    return _started(kept.writeStream.foreachBatch(lambda batch, n: _commit(batch, n, out)), checkpoint, every)


def ingest_exports(stream: DataFrame, out: str, checkpoint: str, before_send: Hook | None = None, every: str | None = None) -> StreamingQuery:
    """Append the spans of a stream of export requests as records; those that are none go to ``out``/rejects with the reason.

    One bad span does not hold up the others of its request.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = normalize.spans(batch)
        normalize.rejected(rows).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        found = normalize.records_from_spans(rows)
        _commit(before_send(found) if before_send else found, batch_id, out)

    return _started(stream.writeStream.foreachBatch(write), checkpoint, every)


def read_exports(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Export requests that arrive as JSON files in a folder."""
    return spark.readStream.schema(normalize.EXPORT).option("multiLine", True).option("maxFilesPerTrigger", files).json(path)


def _started(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _commit(batch: DataFrame, batch_id: int, out: str) -> None:
    """Write what is new in a batch, its ids and its deltas."""
    spark, new = batch.sparkSession, once(batch)
    if any(n < batch_id for n in _numbers(spark, f"{out}/ids", "batch")):
        seen = spark.read.schema("id string, batch int").parquet(f"{out}/ids").where(F.col("batch") < batch_id)
        new = new.join(seen.select("id"), "id", "left_anti")
    new.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/records/batch={batch_id}")
    written = spark.read.schema(batch.schema).parquet(f"{out}/records/batch={batch_id}")
    query.deltas(written, F.lit(f"batch_{batch_id}")).write.mode("overwrite").parquet(f"{out}/deltas/batch={batch_id}")
    written.select("id").write.mode("overwrite").parquet(f"{out}/ids/batch={batch_id}")


def records(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/records").drop("batch")


def newest_snapshot(spark: SparkSession, out: str) -> tuple[int, int] | None:
    """Version and last batch of the newest snapshot that was written to its end."""
    versions = _numbers(spark, f"{out}/snapshots", "version", whole=True)
    if not versions:
        return None
    return versions[-1], spark.read.parquet(f"{out}/snapshots/version={versions[-1]}").agg(F.max("through")).first()[0] or -1


def _parts(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest snapshot, if any, and the deltas of the batches after it."""
    last = newest_snapshot(spark, out)
    parts = spark.read.parquet(f"{out}/snapshots/version={last[0]}").drop("through") if last else None
    if later := [n for n in _numbers(spark, f"{out}/deltas", "batch") if last is None or n > last[1]]:
        deltas = spark.read.option("basePath", f"{out}/deltas").parquet(*(f"{out}/deltas/batch={n}" for n in later)).drop("batch")
        parts = deltas if parts is None else parts.unionByName(deltas)
    return parts


def conversations(spark: SparkSession, out: str) -> DataFrame:
    """The roll-up of all batches so far, from the newest snapshot (if any) and the deltas after it."""
    return query.merge(_parts(spark, out))


def compact(spark: SparkSession, out: str, retire: bool = True) -> DataFrame:
    """The newest snapshot and the deltas after it as one more snapshot; deltas that it holds go.

    A version is never changed, and counts only once it is whole: a compaction that fails leaves all as it was.
    """
    last, batches = newest_snapshot(spark, out), _numbers(spark, f"{out}/deltas", "batch")
    version, through = (last[0] + 1 if last else 0), max([*batches, last[1] if last else -1])
    merged = query.merge(_parts(spark, out)).withColumn("source", F.lit(f"snapshot_{version}")).withColumn("through", F.lit(through))
    merged = merged.withColumn("delta_key", F.sha2(F.concat_ws("\u0000", "source", "conversation_id"), 256))
    merged.write.mode("overwrite").parquet(f"{out}/snapshots/version={version}")
    for n in batches if retire else ():
        files, target = _path(spark, f"{out}/deltas/batch={n}")
        files.delete(target, True)
    return spark.read.parquet(f"{out}/snapshots/version={version}")


def rebuild(spark: SparkSession, out: str) -> DataFrame:
    """The roll-up from the records alone, as they stand now: also what to write anew once sources were removed."""
    return query.conversations(records(spark, out))


def rolling_counts(stream: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Records and conversations by window of event time, for late-data-aware dashboards."""
    of = stream.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", window), "kind")
    return of.agg(F.count(F.lit(1)).alias("records"), F.approx_count_distinct("conversation_id").alias("conversations"))


def sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Bursts of a conversation's records that lie less than the gap apart."""
    return stream.withWatermark("occurred_at", watermark).groupBy("conversation_id", F.session_window("occurred_at", gap)).agg(F.count(F.lit(1)).alias("records"))


class DeliveryStats(StreamingQueryListener):
    """Counts of batches and rows delivered, and the last failure, of the queries of a session."""

    def __init__(self) -> None:
        self.batches = self.rows = self.failed = 0
        self.last_error: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed += 1
            self.last_error = event.exception
