"""Knowledge graph of meetings, chunks, people and entities; topics over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import querytext as q
from ..functions.text import casefold, contains_any, normalize_key
from . import entities as ent
from .search import equals, search_terms

NODE_TYPES = {"decisions": "Decision", "action_items": "Task", "risks": "Risk", "open_questions": "Question"}
SPEAKER_CONFIDENCE = 0.8
#: Entities of each kind that a topic is matched with, newest first.
TOPIC_SCAN = 500
UI_LANGUAGES = ("en", "ru")


def people(chunks: DataFrame) -> DataFrame:
    """(meeting_id, person_key, display_name): speakers of each meeting; one person whatever the case.

    The display name is the one that comes first over the whole index.
    """
    s = chunks.where(F.col("speaker").isNotNull() & (F.trim("speaker") != "")).select("meeting_id", "chunk_id", "ordinal", "speaker", normalize_key("speaker").alias("person_key"))
    names = s.groupBy("person_key").agg(F.min_by("speaker", F.struct("meeting_id", "ordinal", "chunk_id")).alias("display_name"))
    return s.select("meeting_id", "person_key").distinct().join(names, "person_key").select("meeting_id", "person_key", "display_name")


def _type_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv]), kind)


def nodes(chunks: DataFrame, entities: DataFrame, who: DataFrame) -> DataFrame:
    """(type, stable_key, title)."""
    s = lambda c: F.col(c).cast("string")
    meetings = chunks.select(F.lit("Meeting").alias("type"), F.concat(F.lit("meeting:"), s("meeting_id")).alias("stable_key"), "title").distinct()
    parts = chunks.select(F.lit("Chunk").alias("type"), F.concat(F.lit("chunk:"), s("chunk_id")).alias("stable_key"), F.concat("title", F.lit(" / "), "kind", F.lit(" #"), s("ordinal")).alias("title"))
    persons = who.select(F.lit("Person").alias("type"), F.concat(F.lit("person:"), "person_key").alias("stable_key"), F.col("display_name").alias("title")).distinct()
    found = entities.select(_type_of(F.col("kind")).alias("type"), F.concat("kind", F.lit(":"), s("entity_id")).alias("stable_key"), F.col("text").alias("title"))
    return reduce(DataFrame.unionByName, (meetings, parts, persons, found))


def edges(chunks: DataFrame, entities: DataFrame, who: DataFrame) -> DataFrame:
    """(from_key, relation, to_key, confidence, meeting_id, chunk_id, extraction_method)."""
    s = lambda c: F.col(c).cast("string")
    meeting = F.concat(F.lit("meeting:"), s("meeting_id"))
    entity = F.concat("kind", F.lit(":"), s("entity_id"))
    row = lambda a, rel, b, conf, chunk, how: (a.alias("from_key"), F.lit(rel).alias("relation"), b.alias("to_key"), conf.cast("double").alias("confidence"), F.col("meeting_id"), chunk.cast("long").alias("chunk_id"), how.alias("extraction_method"))
    chunk_of = F.col("source_chunk_id")
    holds = chunks.select(*row(meeting, "contains", F.concat(F.lit("chunk:"), s("chunk_id")), F.lit(1.0), F.col("chunk_id"), F.lit("scan")))
    speaks = who.select(*row(meeting, "mentions", F.concat(F.lit("person:"), "person_key"), F.lit(SPEAKER_CONFIDENCE), F.lit(None), F.lit("speaker")))
    has = entities.select(*row(meeting, "contains", entity, F.col("confidence"), chunk_of, F.col("kind")))
    origin = entities.select(*row(entity, "originated_in", F.concat(F.lit("chunk:"), s("source_chunk_id")), F.lit(1.0), chunk_of, F.col("kind")))
    tasks = entities.where("kind = 'action_items'").join(who, "meeting_id").where(F.contains(casefold("text"), casefold("display_name")))
    given = tasks.select(*row(entity, "assigned_to", F.concat(F.lit("person:"), "person_key"), F.lit(0.7), chunk_of, F.lit("heuristic_assignee")))
    return reduce(DataFrame.unionByName, (holds, speaks, has, origin, given))


def of_segment(chunks: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the meeting that each stands for, and edges, of the meetings of one segment of an index.

    A person has a node in every meeting, at the first place where they speak there; whoever reads the nodes of all
    segments takes the first of these.
    """
    who = people(chunks)
    s = chunks.where(F.col("speaker").isNotNull() & (F.trim("speaker") != "")).withColumn("person_key", normalize_key("speaker"))
    first = s.groupBy("meeting_id", "person_key").agg(F.min_by(F.struct("speaker", "ordinal", "chunk_id"), F.struct("ordinal", "chunk_id")).alias("x"))
    persons = first.select(F.lit("Person").alias("type"), F.concat(F.lit("person:"), "person_key").alias("stable_key"), F.col("x.speaker").alias("title"), "meeting_id", "x.ordinal", "x.chunk_id")
    c = lambda col: F.col(col).cast("string")
    none = [F.lit(None).cast("long").alias(x) for x in ("ordinal", "chunk_id")]
    meetings = chunks.select(F.lit("Meeting").alias("type"), F.concat(F.lit("meeting:"), c("meeting_id")).alias("stable_key"), "title", "meeting_id").distinct().select("*", *none)
    parts = chunks.select(F.lit("Chunk").alias("type"), F.concat(F.lit("chunk:"), c("chunk_id")).alias("stable_key"), F.concat("title", F.lit(" / "), "kind", F.lit(" #"), c("ordinal")).alias("title"), "meeting_id", *none)
    found = entities.select(_type_of(F.col("kind")).alias("type"), F.concat("kind", F.lit(":"), c("entity_id")).alias("stable_key"), F.col("text").alias("title"), "meeting_id", *none)
    return reduce(DataFrame.unionByName, (meetings, parts, persons, found)), edges(chunks, entities, who)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (type, stable_key): the new title, the first created_at."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy("type", "stable_key").agg(F.max_by("title", "age").alias("title"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """By ends, relation, meeting, chunk and method: the new confidence."""
    key = ["from_key", "relation", "to_key", "meeting_id", "chunk_id", "extraction_method"]
    return old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1))).groupBy(*key).agg(F.max_by("confidence", "age").alias("confidence"))


def without_meetings(rows: DataFrame, meeting_ids: DataFrame) -> DataFrame:
    """Rows of all other meetings."""
    return rows.join(meeting_ids, "meeting_id", "left_anti")


# ---- topics -----------------------------------------------------------------------------------------------

TOPIC_SCHEMA = "topic_key string, title string, created_at string, updated_at string"
ALIAS_SCHEMA = "topic_key string, alias string, normalized_alias string"


def topic_key(title: str) -> str:
    return f"topic:{q.normalize_key(title)}"


def resolve_topic(topics: DataFrame, aliases: DataFrame, title: str) -> str | None:
    """Key of the topic that has this alias, else of the one with this title."""
    name = q.normalize_key(title)
    row = aliases.where(F.col("normalized_alias") == name).select("topic_key").first() or topics.where(F.col("topic_key") == f"topic:{name}").select("topic_key").first()
    return row[0] if row else None


def topic_links(rows: DataFrame, terms: list[str], scan: int = TOPIC_SCAN) -> DataFrame:
    """Details that any term, or a case variant of a token of it, is a substring of: `scan` newest of each kind."""
    hay = normalize_key(ent.haystack())
    return ent.latest_per_kind(rows, scan).drop("place").where(contains_any(hay, q.match_variants(terms)))


def topic_signals(rows: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """The newest `limit` linked entities over all kinds, with position."""
    linked = topic_links(rows, terms).withColumn("kind_index", ent.kind_index())
    order = (F.col("meeting_date").desc_nulls_last(), F.col("ordinal"), F.col("kind_index"), F.col("entity_id"))
    top = linked.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("kind_index")


def topic_people(linked: DataFrame, who: DataFrame, limit: int = 10) -> DataFrame:
    """People of the meetings whose entities belong to the topic, by name."""
    near = who.join(linked.select("meeting_id").distinct(), "meeting_id", "left_semi")
    return near.select("person_key", "display_name").distinct().orderBy("display_name", "person_key").limit(limit)


def topic_edges(linked: DataFrame, key: str) -> DataFrame:
    """belongs_to edges of a topic, computed when asked for."""
    return linked.select(
        F.concat("kind", F.lit(":"), F.col("entity_id").cast("string")).alias("from_key"), F.lit("belongs_to").alias("relation"), F.lit(key).alias("to_key"), F.lit(0.7).alias("confidence"),
        "meeting_id", F.col("source_chunk_id").cast("long").alias("chunk_id"), F.lit("topic_query").alias("extraction_method"),
    )


def subgraph(all_nodes: DataFrame, all_edges: DataFrame, own: DataFrame, key: str, title: str, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within two steps of a topic: its links, and what touches the linked entities; without a limit, all."""
    order = ("relation", "from_key", "to_key", "extraction_method")
    first = (lambda rows: rows) if limit is None else (lambda rows: rows.orderBy(*order).limit(limit))
    small = (lambda rows: rows) if limit is None else F.broadcast
    own = first(own)
    keys = small(own.select(F.col("from_key").alias("k")))
    ends = [first(all_edges.join(keys, F.col(c) == F.col("k"), "left_semi")) for c in ("from_key", "to_key")]
    touching = first(ends[0].unionByName(ends[1]).distinct())
    found = first(own.unionByName(touching).distinct())
    ends = found.select(F.explode(F.array("from_key", "to_key")).alias("stable_key")).distinct()
    topic = all_nodes.sparkSession.createDataFrame([("Topic", key, title)], "type string, stable_key string, title string")
    some = all_nodes.select("type", "stable_key", "title").join(small(ends), "stable_key", "left_semi").select("type", "stable_key", "title").unionByName(topic)
    return some.orderBy("type", "title", "stable_key"), found


def stored_subgraph(index, own: DataFrame, key: str, title: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """`subgraph` over a stored graph: the linked entities, at most `limit`, and the ends found are looked up by literals."""
    order = ("relation", "from_key", "to_key", "extraction_method")
    spark = own.sparkSession
    rows = own.orderBy(*order).limit(limit).collect()
    first = spark.createDataFrame(rows, own.schema)
    keys = [r["from_key"] for r in rows]
    ends = [index.table(t).where(equals(c, keys)).orderBy(*order).limit(limit) for t, c in (("edges", "from_key"), ("edges_to", "to_key"))]
    touching = ends[0].unionByName(ends[1]).distinct().orderBy(*order).limit(limit)
    got = first.unionByName(touching).distinct().orderBy(*order).limit(limit).collect()
    found = spark.createDataFrame(got, own.schema)
    topic = spark.createDataFrame([("Topic", key, title)], "type string, stable_key string, title string")
    some = index.nodes(sorted({r[c] for r in got for c in ("from_key", "to_key")})).select("type", "stable_key", "title")
    return some.unionByName(topic).orderBy("type", "title", "stable_key"), found


def dominant_language(languages: DataFrame, column: str = "language", restrict=UI_LANGUAGES) -> DataFrame:
    """One row (language, n): the most frequent primary tag among `restrict`, ties to the one seen first by `position`."""
    tag = F.lower(F.split(F.col(column), "-")[0])
    rows = languages.where(F.col(column).isNotNull() & (F.col(column) != "")).withColumn("language", tag).where(F.col("language").isin(list(restrict)))
    order = F.min("position") if "position" in languages.columns else F.min("language")
    return rows.groupBy("language").agg(F.count("*").alias("n"), order.alias("seen")).orderBy(F.col("n").desc(), "seen", "language").limit(1).select("language", "n")


def list_topics(topics: DataFrame, aliases: DataFrame, limit: int = 100) -> DataFrame:
    """(topic_key, title, aliases, created_at, updated_at): topics by newest change, then title, aliases in order."""
    names = aliases.groupBy("topic_key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    top = topics.orderBy(F.col("updated_at").desc_nulls_last(), "title", "topic_key").limit(limit)
    return top.join(names, "topic_key", "left").select("topic_key", "title", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "created_at", "updated_at")


def topic_evidence(chunks: DataFrame, terms: list[str], limit: int, postings=None) -> DataFrame:
    return search_terms(chunks, terms, limit, postings)
