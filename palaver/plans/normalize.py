"""From the recorder's tables to meetings and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_optional, normalize_text, token_count

CHUNK_COLUMNS = (
    "chunk_id meeting_id source_kind source_path meeting_external_id title created_at updated_at folder_path language chunk_external_id kind ordinal text speaker "
    "starts_at_seconds ends_at_seconds timestamp_label token_count fingerprint"
).split()
MEETING_COLUMNS = "meeting_id source_kind source_path external_id title created_at updated_at folder_path language summary_text fingerprint indexed_at".split()
SOURCE_KIND = "recorder_sqlite"


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def summary_text(result) -> Column:
    """Text of a summary: of a JSON object the first text among its usual fields, else the canonical JSON; of a JSON
    string itself; what is no JSON as it stands."""
    c = F.col(result)
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    some = [F.try_variant_get(v, f"$.{k}", "string") for k in ("markdown", "summary", "raw_summary", "MeetingName")]
    is_text = [F.expr(f"schema_of_variant(variant_get(try_parse_json(`{result}`), '$.{k}')) = 'STRING'") for k in ("markdown", "summary", "raw_summary", "MeetingName")]
    first = F.coalesce(*[F.when(t & (F.trim(s) != ""), s) for t, s in zip(is_text, some, strict=True)])
    text = F.when(v.isNull(), c).when(kind.startswith("OBJECT"), F.coalesce(first, F.to_json(v))).when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.when(F.coalesce(c, F.lit("")) != "", normalize_text(text))


def language(metadata) -> Column:
    v = F.try_parse_json(F.col(metadata))
    return F.when(F.expr(f"schema_of_variant(variant_get(try_parse_json(`{metadata}`), '$.language')) = 'STRING'"), F.try_variant_get(v, "$.language", "string"))


def chunk_key(*parts) -> Column:
    return F.xxhash64(*parts)


def normalize(tables: dict[str, DataFrame], path: str, now: str, source_uuid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(meetings, chunks). Everything of a meeting is joined by its id; nothing is looked up row by row.

    Transcript ordinals count blank segments too; the summary and the note come after the number of segments that are
    not blank. Fingerprints are SHA-256 of canonical JSON of whole upstream rows. Ids come from the source's uuid where it
    has one, so they outlive a move of its file.
    """
    m, t, s, n = (tables[k] for k in ("meetings", "transcripts", "summary_processes", "meeting_notes"))
    order = Window.partitionBy("meeting_id").orderBy(F.coalesce("audio_start_time", F.lit(0.0)), F.col("timestamp").asc_nulls_first(), "id")
    t = t.withColumn("row_json", _json(t.columns)).withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    t = t.withColumn("text", normalize_text(F.coalesce("transcript", F.lit("")))).where("text <> ''")
    said = t.select(
        F.col("meeting_id").alias("mid"), F.col("id").alias("chunk_external_id"), F.lit("transcript").alias("kind"), "ordinal", "text", clean_optional("speaker").alias("speaker"),
        F.col("audio_start_time").alias("starts_at_seconds"), F.col("audio_end_time").alias("ends_at_seconds"), clean_optional("timestamp").alias("timestamp_label"), F.sha2("row_json", 256).alias("fingerprint"),
    )
    spoken = said.groupBy("mid").agg(F.count("*").alias("n_said"))
    if "metadata" not in s.columns:
        s = s.withColumn("metadata", F.lit(None).cast("string"))
    whole = lambda kind, body: F.sha2(F.concat(F.lit(f'{{"kind":"{kind}","payload":'), body, F.lit("}")), 256)
    sums = s.withColumn("summary_json", _json(s.columns)).select(F.col("meeting_id").alias("mid"), summary_text("result").alias("summary_text"), language("metadata").alias("language"), "summary_json")
    notes = n.withColumn("notes_json_row", _json(n.columns)).select(F.col("meeting_id").alias("mid"), normalize_text(F.coalesce("notes_markdown", F.lit(""))).alias("note_text"), "notes_json_row")
    meet = m.select(F.col("id").cast("string").alias("mid"), "title", "created_at", "updated_at", "folder_path").join(spoken, "mid", "left").join(sums, "mid", "left").join(notes, "mid", "left")
    meet = meet.withColumn("n_said", F.coalesce("n_said", F.lit(0))).withColumn("meeting_id", chunk_key(F.lit(SOURCE_KIND), F.lit(source_uuid or path), F.col("mid")))
    has = F.coalesce("summary_text", F.lit("")) != ""
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("speaker", "string"), ("starts_at_seconds", "double"), ("ends_at_seconds", "double"), ("timestamp_label", "string"))]
    summed = meet.where(has).select("mid", F.concat(F.lit("summary:"), "mid").alias("chunk_external_id"), F.lit("summary").alias("kind"), F.col("n_said").alias("ordinal"), F.col("summary_text").alias("text"), *blank, whole("summary", F.col("summary_json")).alias("fingerprint"))
    noted = meet.where(F.coalesce("note_text", F.lit("")) != "").select("mid", F.concat(F.lit("note:"), "mid").alias("chunk_external_id"), F.lit("note").alias("kind"), (F.col("n_said") + has.cast("int")).alias("ordinal"), F.col("note_text").alias("text"), *blank, whole("note", F.col("notes_json_row")).alias("fingerprint"))
    parts = reduce(DataFrame.unionByName, (said, summed, noted))
    prints = parts.groupBy("mid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "fingerprint"))), lambda x: x["fingerprint"]).alias("prints"))
    full = meet.join(prints, "mid", "left")
    mark = F.sha2(F.to_json(F.struct(F.col("mid").alias("id"), "title", "created_at", "updated_at", "folder_path", "prints", "summary_json", "notes_json_row"), {"ignoreNullFields": "false"}), 256)
    meetings = full.select("meeting_id", F.lit(SOURCE_KIND).alias("source_kind"), F.lit(path).alias("source_path"), F.col("mid").alias("external_id"), "title", "created_at", "updated_at", "folder_path", "language", "summary_text", mark.alias("fingerprint"), F.lit(now).alias("indexed_at"))
    head = meet.select("mid", "meeting_id", F.lit(SOURCE_KIND).alias("source_kind"), F.lit(path).alias("source_path"), F.col("mid").alias("meeting_external_id"), "title", "created_at", "updated_at", "folder_path", "language")
    chunks = parts.join(head, "mid").withColumn("chunk_id", chunk_key("meeting_id", "kind", "ordinal")).withColumn("token_count", token_count("text").cast("long"))
    return meetings.select(*MEETING_COLUMNS), chunks.select(*CHUNK_COLUMNS)
