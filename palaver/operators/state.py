"""User state of tasks: an overlay that outlives the index, joined when tasks are read."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.querytext import normalize_key as query_key
from ..functions.text import normalize_key

# fixed values: what a task can be
STATUSES = ("open", "done", "cancelled", "unknown")
SCHEMA = "source_uuid string, meeting_external_id string, chunk_external_id string, kind string, text_sha string, status string, note string, legacy_id long, orphaned boolean, updated_at string"
KEY = ("source_uuid", "meeting_external_id", "chunk_external_id", "kind", "text_sha")


def text_sha(column) -> Column:
    """Identity of a task's wording: SHA-256 of the case-folded text with single blanks."""
    return F.sha2(normalize_key(column), 256)


def identity(rows: DataFrame) -> DataFrame:
    """Entity details with the columns of KEY; a task without a chunk id has no identity."""
    uuid = F.col("source_uuid") if "source_uuid" in rows.columns else F.lit("")
    return rows.withColumns({"source_uuid": uuid, "text_sha": text_sha("text")})


def upsert(states: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest row of every key; a legacy id once known stays."""
    both = states.withColumn("new", F.lit(0)).unionByName(changes.withColumn("new", F.lit(1)), allowMissingColumns=True)
    live = both.where(~F.coalesce("orphaned", F.lit(False)))
    w = Window.partitionBy(*KEY)
    kept = live.withColumn("legacy_id", F.coalesce("legacy_id", F.max("legacy_id").over(w)))
    kept = kept.withColumn("nth", F.row_number().over(w.orderBy(F.col("new").desc(), F.col("updated_at").desc_nulls_last()))).where("nth = 1")
    orphans = both.where(F.coalesce("orphaned", F.lit(False)))
    return kept.drop("nth", "new").unionByName(orphans.drop("new"), allowMissingColumns=True)


def with_status(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Details with `state_status` and `status_note`, null where the user has set none: one join on the whole identity."""
    live = states.where(~F.coalesce("orphaned", F.lit(False)) & (F.col("kind") == "task"))
    live = live.select("source_uuid", "meeting_external_id", "chunk_external_id", "text_sha", F.col("status").alias("state_status"), F.col("note").alias("status_note"))
    tasks = identity(rows).withColumn("text_sha", F.when(F.col("kind") == "action_items", F.col("text_sha")))  # only tasks have a status
    return tasks.join(live, ["source_uuid", "meeting_external_id", "chunk_external_id", "text_sha"], "left").select(*rows.columns, "state_status", "status_note")


def change(task: dict, status: str, note: str | None, now: str) -> dict:
    """The state row that sets a task's status."""
    if status not in STATUSES:
        raise ValueError(f"unknown task status: {status}")
    if not task.get("chunk_external_id"):
        raise ValueError("a task without a chunk id cannot have a status")
    return {
        "source_uuid": task.get("source_uuid") or "", "meeting_external_id": task["meeting_external_id"], "chunk_external_id": task["chunk_external_id"], "kind": "task",
        "text_sha": hashlib.sha256(query_key(task["text"]).encode()).hexdigest(), "status": status, "note": note, "legacy_id": None, "orphaned": False, "updated_at": now,
    }


def split_legacy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an older state: those with a strict identity, and those without one, which become orphans."""
    known = F.col("chunk_external_id").isNotNull() & F.col("meeting_external_id").isNotNull()
    return rows.where(known).withColumn("orphaned", F.lit(False)), rows.where(~known).withColumn("orphaned", F.lit(True))


# fixed values: why a legacy row could not be carried over
ORPHAN_REASONS = ("missing_task", "missing_source", "missing_chunk_id")


def migrate_legacy(legacy: DataFrame, tasks: DataFrame, states: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """States with the rows of an older index taken in, and a report (reason, n): migrated, or why a row is an orphan.

    `legacy` has (entity_id, status, note) by the older task ids; `tasks` are that index's task details with their
    source_uuid. One left join; rows whose task, source or chunk id is not known are kept as orphans with their reason.
    """
    t = identity(tasks.where("kind = 'action_items'")).select("entity_id", "source_uuid", "meeting_external_id", "chunk_external_id", "text_sha")
    rows = legacy.join(t, "entity_id", "left")
    reason = F.when(F.col("text_sha").isNull(), ORPHAN_REASONS[0]).when(F.coalesce("source_uuid", F.lit("")) == "", ORPHAN_REASONS[1]).when(F.coalesce("chunk_external_id", F.lit("")) == "", ORPHAN_REASONS[2])
    rows = rows.withColumn("reason", reason)
    new = rows.select(
        F.coalesce("source_uuid", F.lit("")).alias("source_uuid"), "meeting_external_id", "chunk_external_id", F.lit("task").alias("kind"), "text_sha", "status", F.coalesce("note", "reason").alias("note"),
        F.col("entity_id").cast("long").alias("legacy_id"), F.col("reason").isNotNull().alias("orphaned"), F.lit(now).alias("updated_at"),
    )
    # what the user has set since then stays
    known = states.where(~F.coalesce("orphaned", F.lit(False))).select(*KEY)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEY]
    fresh = new.alias("n").join(known.alias("k"), same, "left_anti")
    report = rows.groupBy(F.coalesce("reason", F.lit("migrated")).alias("reason")).agg(F.count("*").alias("n"))
    return upsert(states, fresh), report
