"""Decisions, action items, risks and open questions: extraction by declarative rules, and detail views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, contains_all, sentences, sha_joined
from .state import STATUSES as TASK_STATUSES
from .state import with_status

KINDS = ("decisions", "action_items", "risks", "open_questions")
SOURCE, CONFIDENCE = "heuristic", 0.55

# fixed values: the patterns that make a sentence an entity
DECISION = (
    r"\b(decision|decided|agreed|approved|confirmed|resolved)\b|"
    r"(решили|решение|согласовали|утвердили|подтвердил|подтвердили|подтвержден)"
)
RISK = r"\b(risk|risks|blocker|blocked|issue|concern|dependency)\b|(риск|риски|блокер|проблема|зависимость)"
ACTION = (
    r"\b(action item|todo|to do|follow up)\b|\b(agreed to|owns|owner)\s+\w+|"
    r"\b(send|prepare|share|write|create|update|review|check|clarify)\b",
    r"(отправить|подготовить|написать|создать|обновить|доработать|проверить|уточнить|согласовать|прислать|скинуть|собрать|изучить|оценить)",
    r"(нужно|надо)\s+\w*(подготов|сдел|отправ|напис|созд|обнов|доработ|провер|уточн|изуч|оцен)",
    r"моя задача\s+(?:[-—:]\s*)?(?:это\s+)?\w+|мне нужно время,?\s+чтобы\s+\w+",
)
NO_ACTION = (
    r"(надо|нужно)\s+(подумать|понять|разобраться)|должен\s+будет|"
    r"\b(should|need to|needs to)\s+(think|understand|figure out)\b"
)
QUESTION = (r"\b(open question|unknown|clarify|tbd)\b", r"(открытый вопрос|уточнить|неясно|непонятно|под вопросом)")


def _has(sentence: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(sentence, F.lit("(?iU)" + p)) for p in patterns])


def kinds_of(sentence: Column) -> Column:
    """Indexes into KINDS of what a sentence is."""
    question = _has(sentence, *QUESTION)
    action = ~question & ~_has(sentence, NO_ACTION) & _has(sentence, *ACTION)
    tests = (_has(sentence, DECISION), action, _has(sentence, RISK), question)
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]), lambda k: k.isNotNull())


def extract(chunks: DataFrame) -> DataFrame:
    """Entities of every meeting: (entity_id, kind, meeting_id, source_chunk_id, ordinal, text, source, confidence, fingerprint).

    Per meeting, in the order of its chunks, their sentences and KINDS; a sentence counts once per kind and meeting,
    whatever its case; ordinals count within kind. One shuffle by meeting; its rows are sentences that are entities.
    """
    s = chunks.select("meeting_id", "chunk_id", F.col("ordinal").alias("chunk_ordinal"), F.posexplode(sentences("text")).alias("place", "text"))
    e = s.select("*", F.explode(kinds_of(F.col("text"))).alias("k"))
    e = e.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1)).withColumn("fold", casefold("text"))
    first = Window.partitionBy("meeting_id", "kind", "fold").orderBy("chunk_ordinal", "chunk_id", "place")
    e = e.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    count = Window.partitionBy("meeting_id", "kind").orderBy("chunk_ordinal", "chunk_id", "place")
    e = e.withColumn("ordinal", F.row_number().over(count) - 1)
    mark = sha_joined("kind", F.col("chunk_id").cast("string"), "fold")
    return e.select(
        F.xxhash64(mark).alias("entity_id"), "kind", "meeting_id", F.col("chunk_id").alias("source_chunk_id"), F.col("ordinal").cast("long").alias("ordinal"), "text",
        F.lit(SOURCE).alias("source"), F.lit(CONFIDENCE).alias("confidence"), mark.alias("fingerprint"),
    )


def counts(entities: DataFrame) -> DataFrame:
    """(kind, n) for every kind, also those with none."""
    kinds = entities.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return F.broadcast(kinds).join(entities.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def kind_index() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1


def details(entities: DataFrame, chunks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Entities with their meeting and chunk, and for action items the status (open unless the user set one)."""
    c = chunks.select(
        F.col("chunk_id").alias("source_chunk_id"), "meeting_external_id", F.col("title").alias("meeting_title"), F.col("language").alias("meeting_language"),
        F.coalesce("updated_at", "created_at").alias("meeting_date"), "chunk_external_id", F.col("kind").alias("chunk_kind"), F.col("ordinal").alias("chunk_ordinal"),
        F.col("speaker").alias("chunk_speaker"), F.col("timestamp_label").alias("chunk_timestamp_label"),
    )
    rows = entities.join(c, "source_chunk_id")
    status = F.lit(None).cast("string")
    if states is None:
        rows = rows.withColumn("status_note", status)
    else:
        rows = with_status(rows, states)
        status = F.col("state_status")
    rows = rows.withColumn("status", F.when(F.col("kind") == "action_items", F.coalesce(status, F.lit("open"))))
    return rows.drop("state_status")


def latest(rows: DataFrame, kind: str, limit: int = 20, status: str = "all") -> DataFrame:
    """The newest details of one kind. The status is filtered before the limit."""
    if kind not in KINDS:
        raise ValueError(f"unknown entity kind: {kind}")
    if status != "all" and status not in TASK_STATUSES:
        raise ValueError(f"unknown task status filter: {status}")
    own = rows.where(F.col("kind") == kind)
    if status != "all":
        own = own.where(F.col("status") == status)
    return own.orderBy(F.col("meeting_date").desc_nulls_last(), "ordinal", "entity_id").limit(limit)


def latest_per_kind(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The newest `limit` of every kind, with `place` from 1: a ranked group limit, pushed below the shuffle by Catalyst."""
    w = Window.partitionBy("kind").orderBy(F.col("meeting_date").desc_nulls_last(), "ordinal", "entity_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def merged(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The newest `limit` of every kind in one list: by date, ordinal, then the order of KINDS."""
    top = latest_per_kind(rows, limit).withColumn("kind_index", kind_index())
    w = Window.orderBy(F.col("meeting_date").desc_nulls_last(), "ordinal", "kind_index", "place")
    return top.withColumn("position", F.row_number().over(w)).drop("place", "kind_index")  # 4 * limit rows


def haystack(separator: str = " ") -> Column:
    return casefold(F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in ("text", "meeting_title", "meeting_external_id", "chunk_external_id", "chunk_speaker")]))


def timeline(rows: DataFrame, query: str | None = None, limit: int = 20) -> DataFrame:
    """Of the 4 * limit newest of every kind merged, the first `limit` that hold all terms of the query."""
    top = merged(rows, 4 * limit).where(F.col("position") <= 16 * limit)
    if query:
        top = top.where(contains_all(haystack(), query))
    return top.orderBy("position").limit(limit)


def of_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Details whose chunk is among the hits."""
    return rows.join(F.broadcast(hits.select(F.col("chunk_id").alias("source_chunk_id")).distinct()), "source_chunk_id", "left_semi")
