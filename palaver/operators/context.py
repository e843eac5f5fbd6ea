"""Evidence ids, nested hits, context bundles and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_date, excerpt, preview

MAX_EVIDENCE, DEFAULT_LIMIT, PREVIEW, PROJECTION = 20, 8, 240, "compact-search-hit.v1"
ENTITY_NAMES = {"decisions": "decision", "action_items": "task", "risks": "risk", "open_questions": "question"}


def _quoted(c) -> Column:
    """A JSON string."""
    one = F.to_json(F.struct(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias("t")))
    return F.regexp_extract(one, r'(?s)^\{"t":(.*)\}$', 1)


def evidence_id(source_uuid: Column) -> Column:
    """Public id of a chunk: SHA-256 of JSON of the source's id, the meeting's id and the chunk's id, or of its kind,
    place and content where it has none. It survives every rebuild of the index."""
    has = F.col("chunk_external_id").isNotNull() & (F.col("chunk_external_id") != "")
    named = F.concat(F.lit('{"external_id":'), _quoted("chunk_external_id"), F.lit("}"))
    placed = F.concat(F.lit('{"content_fingerprint":"'), F.sha2("text", 256), F.lit('","kind":'), _quoted("kind"), F.lit(',"ordinal":'), F.col("ordinal").cast("string"), F.lit("}"))
    body = F.concat(F.lit('{"chunk":'), F.when(has, named).otherwise(placed), F.lit(',"meeting_external_id":'), _quoted("meeting_external_id"), F.lit(',"source_uuid":'), _quoted(source_uuid), F.lit("}"))
    return F.concat(F.lit("evidence:"), F.sha2(body, 256))


def nested(hits: DataFrame, source_uuid: Column, source_path: Column) -> DataFrame:
    """(id, meeting, excerpt, is_context, position): version 2 hits."""
    return hits.select(
        evidence_id(source_uuid).alias("id"),
        F.struct(source_uuid.alias("source_uuid"), F.col("meeting_external_id").alias("external_id"), "title", source_path.alias("source_path"), "created_at", "updated_at", "folder_path", "language").alias("meeting"),
        F.struct("meeting_external_id", "chunk_external_id", "kind", "ordinal", "text", "speaker", "starts_at_seconds", "ends_at_seconds", "timestamp_label").alias("excerpt"),
        "is_context", "position",
    )


def compact(hits: DataFrame, length: int = PREVIEW) -> DataFrame:
    """Nested hits with a preview in place of the text."""
    text = F.col("excerpt.text")
    return hits.select("id", "meeting", preview(text, length).alias("preview"), (F.length(text) > length).alias("truncated"), "is_context", F.lit(length).alias("preview_length"), F.lit(PROJECTION).alias("projection_version"), "position")


def grouped(hits: DataFrame) -> DataFrame:
    """(meeting_external_id, title, date, first_position, n_excerpts, excerpts): meetings in the order of their first hit."""
    x = F.struct("position", "chunk_id", "chunk_external_id", "speaker", "timestamp_label", "is_context", excerpt("text").alias("text"))
    return hits.groupBy("meeting_external_id", "title").agg(
        F.max(F.coalesce("updated_at", "created_at", F.lit("unknown"))).alias("date"), F.min("position").alias("first_position"), F.min("rank").alias("best_rank"), F.count("*").alias("n_excerpts"), F.array_sort(F.collect_list(x)).alias("excerpts")
    )


def markdown(question: str, groups: list, by_rank: bool = False) -> str:
    """The context of a question; `groups` are rows of `grouped`, a result of limited size."""
    q = question.strip()
    out = ["# Question", "", q, "", "# Relevant meetings"]
    key = (lambda g: (g["best_rank"] if g["best_rank"] is not None else 0.0, g["date"], g["title"])) if by_rank else (lambda g: g["first_position"])
    for g in sorted(groups, key=key):
        out += ["", f"## Meeting: {g['title']}", "", f"Date: {g['date']}", f"Meeting ID: {g['meeting_external_id']}", "", "### Relevant excerpt"]
        for x in g["excerpts"]:
            who = " | ".join(v for v in (x["speaker"], x["timestamp_label"]) if v)
            source = f"Source: {g['meeting_external_id']} / {x['chunk_external_id'] or x['chunk_id']}"
            out += ["", source + ("\nEvidence role: neighboring context" if x["is_context"] else "") + "\n> " + (f"**{who}**: " if who else "") + x["text"]]
    if not groups:
        out += ["", "No relevant excerpts found."]
    return "\n".join([*out, "", "# Question", "", q, ""])


def recent(chunks_or_meetings: DataFrame) -> DataFrame:
    """Adds `day`, the date part of the newest time there is."""
    return chunks_or_meetings.withColumn("day", compact_date(F.coalesce("updated_at", "created_at")))


def positions(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
