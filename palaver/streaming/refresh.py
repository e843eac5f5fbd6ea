"""Refresh as a stream: recorder exports arrive as files, each batch updates the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as ent
from ..plans.index import Index, ScanResult

MEETING_EXPORT = "id string, title string, created_at string, updated_at string, folder_path string, transcripts array<struct<id:string, transcript:string, timestamp:string, audio_start_time:double, audio_end_time:double, speaker:string>>, summary struct<result:string, metadata:string>, notes struct<notes_markdown:string>"


def tables_of(batch: DataFrame) -> dict[str, DataFrame]:
    """The recorder's four tables from nested exports; of several exports of a meeting in a batch the newest counts."""
    newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct(F.coalesce("updated_at", F.lit("")), F.xxhash64(*batch.columns))).alias("m")).select("m.*")
    said = newest.select(F.col("id").alias("meeting_id"), F.explode("transcripts").alias("t")).select("t.id", "meeting_id", "t.transcript", "t.timestamp", "t.audio_start_time", "t.audio_end_time", "t.speaker")
    return {
        "meetings": newest.select("id", "title", "created_at", "updated_at", "folder_path"),
        "transcripts": said,
        "summary_processes": newest.where("summary is not null").select(F.col("id").alias("meeting_id"), "summary.result", "summary.metadata"),
        "meeting_notes": newest.where("notes is not null").select(F.col("id").alias("meeting_id"), "notes.notes_markdown"),
    }


def ingest(index: Index, source: str):
    """A foreachBatch function. The state that a batch makes names it, so one that is replayed after a failure is known
    and left out, and its run is not counted twice. Late data is a meeting whose fingerprint changed: it is replaced
    whole."""

    def run(batch: DataFrame, batch_id: int) -> ScanResult | None:
        return None if batch.isEmpty() else index.refresh(tables_of(batch), source, batch=(source, batch_id))

    return run


def run_available(spark: SparkSession, folder: str, index: Index, checkpoint: str, source: str = "exports") -> None:
    """Take in all exports that have arrived since the last run, then stop."""
    stream = spark.readStream.schema(MEETING_EXPORT).json(folder)
    q = stream.writeStream.foreachBatch(ingest(index, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def signals_per_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Entities per kind and window over a stream of (ts, text) chunks, with a watermark for late ones."""
    found = events.withWatermark("ts", late).select("ts", F.explode(ent.sentences("text")).alias("s")).select("ts", F.explode(ent.kinds_of(F.col("s"))).alias("k"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ent.KINDS]), F.col("k") + 1)
    return found.groupBy(F.window("ts", width), kind.alias("kind")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
