"""Large tables read as corpora of meetings and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sha_joined


def _chunks(rows: DataFrame, **columns: Column) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    base = {
        "chunk_id": null("long"), "meeting_id": null("long"), "meeting_external_id": null("string"), "title": null("string"), "created_at": null("string"), "updated_at": null("string"),
        "folder_path": null("string"), "language": null("string"), "chunk_external_id": null("string"), "kind": F.lit("transcript"), "ordinal": F.lit(0).cast("long"), "text": null("string"), "speaker": null("string"),
        "starts_at_seconds": null("double"), "ends_at_seconds": null("double"), "timestamp_label": null("string"),
    } | columns
    out = rows.select(*[c.alias(n) for n, c in base.items()])
    return out.withColumn("fingerprint", sha_joined("meeting_external_id", "kind", F.col("ordinal").cast("string"), F.coalesce("text", F.lit(""))))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting a conversation, a chunk a turn, the role as speaker."""
    c, s = spark.read.parquet(f"{sf_dir}/conversations.parquet"), lambda x: F.col(x).cast("string")
    return _chunks(
        c, chunk_id=F.col("conv_id") * 1000 + F.col("turn"), meeting_id=F.col("conv_id"), meeting_external_id=F.concat(F.lit("conversation-"), s("conv_id")), title=F.concat(F.lit("Conversation "), s("conv_id")),
        chunk_external_id=F.concat(F.lit("turn-"), s("conv_id"), F.lit("-"), s("turn")), ordinal=F.col("turn"), text=F.col("text"), speaker=F.col("role"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting and a chunk a document, its source as title."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _chunks(
        d, chunk_id=F.col("doc_id"), meeting_id=F.col("doc_id"), meeting_external_id=F.concat(F.lit("document-"), F.col("doc_id").cast("string")), title=F.col("source"), language=F.col("lang"), chunk_external_id=F.col("doc_id").cast("string"), text=F.col("text"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting a user, a chunk an event, with a sentence by the type of the event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "purchase", F.concat(F.lit("We decided to approve order "), i, F.lit(". Budget is fine.")))
        .when(kind == "error", F.concat(F.lit("Open question: who owns incident "), (F.col("event_id") % 50).cast("string"), F.lit("? There is a risk of outage.")))
        .when(kind == "signup", F.concat(F.lit("Please send the welcome pack to user "), u, F.lit(" by Friday.")))
        .when(kind == "click", F.lit("We should think about the update. Please share notes."))
        .otherwise(F.concat(F.lit("Nothing notable in session "), i, F.lit(".")))
    )
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("n", F.row_number().over(w) - 1).withColumn("latest", F.max("ts").over(Window.partitionBy("user_id")))
    return _chunks(
        rows, chunk_id=F.col("event_id"), meeting_id=F.col("user_id"), meeting_external_id=F.concat(F.lit("user-"), u), title=F.concat(F.lit("User "), u), created_at=F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        chunk_external_id=F.concat(F.lit("event-"), i), ordinal=F.col("n").cast("long"), text=text, speaker=F.concat(F.lit("speaker "), (F.col("event_id") % 5).cast("string")), timestamp_label=day,
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting a customer, a chunk an order, in English and Russian, with its clerk's number as speaker."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    i, u, kind = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    clerk = F.concat(F.lit("Clerk "), (F.col("o_orderkey") % 7).cast("string"))
    text = (
        F.when(kind == "1", F.concat(clerk, F.lit(" agreed to send the contract. Есть риск задержки.")))
        .when(kind == "2", F.lit("Решили подтвердить план миграции. Нужно подготовить отчёт!"))
        .when(kind == "3", F.lit("Открытый вопрос: кто отвечает за миграцию? Надо подумать о сроках."))
        .when(kind == "4", F.concat(F.lit("Моя задача - собрать данные. "), clerk, F.lit(" owns the миграция list.")))
        .otherwise(F.lit("Просто Болтовня без дела."))
    )
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.withColumn("n", F.row_number().over(w) - 1)
    return _chunks(
        rows, chunk_id=F.col("o_orderkey"), meeting_id=F.col("o_custkey"), meeting_external_id=F.concat(F.lit("customer-"), u), title=F.concat(F.lit("Customer "), u), created_at=F.lit("2026-01-01T00:00:00Z"),
        updated_at=F.when(F.col("o_custkey") % 2 == 0, F.lit("2026-02-01T00:00:00Z")), language=F.when(F.col("o_custkey") % 3 == 0, F.lit("ru")).otherwise(F.lit("en-US")), chunk_external_id=F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("order-"), i)),
        ordinal=F.col("n").cast("long"), text=text, speaker=clerk,
    )


def recorder_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The recorder's four tables, from conversations: with blanks, empty turns, summaries of several forms and notes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("mid", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))
    one = c.select("conv_id", "mid").distinct()
    n, i = F.col("conv_id"), F.col("conv_id").cast("string")
    meetings = one.select(F.col("mid").alias("id"), F.concat(F.lit("Conversation "), i).alias("title"), F.lit("2026-01-02T03:04:05Z").alias("created_at"), F.when(n % 2 == 0, F.lit("2026-03-02T03:04:05Z")).alias("updated_at"), F.lit(None).cast("string").alias("folder_path"))
    t = F.col("turn")
    said = F.when(t % 7 == 3, F.lit("  \t ")).when(t % 4 == 0, F.concat(F.lit("  "), "text", F.lit(" \r\n\r\n\r\n\r\n end "))).otherwise(F.col("text"))
    transcripts = c.select(
        F.concat("mid", F.lit("-"), t.cast("string")).alias("id"), F.col("mid").alias("meeting_id"), said.alias("transcript"), F.lit(" 10:00 ").alias("timestamp"),
        F.when(t > 0, t * 5.0).alias("audio_start_time"), (t * 5.0 + 4).alias("audio_end_time"), F.when(t % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "role", F.lit(" "))).alias("speaker"),
    )
    result = F.when(n % 9 == 0, F.lit("plain words")).when(n % 2 == 0, F.concat(F.lit('{"markdown":" # Summary '), i, F.lit(' "}'))).otherwise(F.concat(F.lit('{"markdown":" ","summary":"Short '), i, F.lit('"}')))
    meta = F.when(n % 4 == 0, F.lit('{"language":"ru"}')).when(n % 4 == 1, F.lit('["en"]')).otherwise(F.lit('{"language":"en"}'))
    summaries = one.where("conv_id % 3 = 0").select(F.col("mid").alias("meeting_id"), result.alias("result"), meta.alias("metadata"))
    notes = one.where("conv_id % 4 = 1").select(F.col("mid").alias("meeting_id"), F.when(n % 8 == 5, F.lit(" ")).otherwise(F.concat(F.lit("Note "), i, F.lit("\n\n\n\nmore "))).alias("notes_markdown"))
    return {"meetings": meetings, "transcripts": transcripts, "summary_processes": summaries, "meeting_notes": notes}


def meetings_of(chunks: DataFrame) -> DataFrame:
    """One row a meeting, from its chunks."""
    return chunks.groupBy("meeting_id").agg(
        F.min("meeting_external_id").alias("external_id"), F.min("title").alias("title"), F.max("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("language").alias("language"), F.lit(None).cast("string").alias("indexed_at")
    )
