"""Lists and views over meetings: recent, by person, counts, timeline, project, person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.querytext import any_terms
from ..functions.text import casefold, contains_all
from . import entities as ent
from .graph import edges, nodes, people
from .search import ranked, tokenized, with_frequencies


def recent_meetings(meetings: DataFrame, chunks: DataFrame, limit: int = 20, only: DataFrame | None = None) -> DataFrame:
    """Meetings with their number of chunks, newest first; those without chunks count 0."""
    m = meetings.join(only, "meeting_id", "left_semi") if only is not None else meetings
    n = chunks.groupBy("meeting_id").agg(F.count("chunk_id").alias("chunk_count"))
    newest = F.coalesce("updated_at", "created_at", "indexed_at")
    # the limit comes before the join: counts are looked up for the meetings shown only
    top = m.orderBy(newest.desc_nulls_last(), "meeting_id").limit(limit)
    return top.join(n, "meeting_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def mentioned_ids(chunks: DataFrame, name: str) -> DataFrame:
    """Meetings whose text mentions any term of a name: a filter on tokens, without ranking."""
    terms = any_terms(name)
    if not terms:
        return chunks.select("meeting_id").where(F.lit(False))
    return with_frequencies(tokenized(chunks), terms).where(F.exists("tf", lambda x: x > 0)).select("meeting_id").distinct()


def person_meetings(chunks: DataFrame, name: str, postings=None) -> DataFrame:
    """Union of two id sets, each found by one scan; the OR of two EXISTS as semi joins."""
    speaks = people(chunks).where(F.contains(casefold("display_name"), F.lit(name.casefold()))).select("meeting_id")
    mentions = mentioned_ids(chunks, name) if postings is None else postings.meetings(name)
    return speaks.unionByName(mentions).distinct()


def index_counts(sources: DataFrame, meetings: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: sources, meetings, chunks, entities, nodes and edges of the knowledge graph."""
    who = people(chunks)
    of = lambda df, name: df.agg(F.count("*").alias(name))
    parts = (of(sources, "sources"), of(meetings, "meetings"), of(chunks, "chunks"), of(entities, "structured_entities"), of(nodes(chunks, entities, who), "knowledge_nodes"), of(edges(chunks, entities, who), "knowledge_edges"))
    return reduce(DataFrame.crossJoin, parts)  # one row each


def stats(meetings: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of counts, from one aggregate a table."""
    m = meetings.agg(F.count("*").alias("meetings"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_distinct(casefold("speaker")).alias("people"))
    e = entities.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ent.KINDS])
    return reduce(DataFrame.crossJoin, (m, F.broadcast(c), F.broadcast(e)))  # one row each


def language_of(meetings: DataFrame) -> DataFrame:
    """One row (language, n): the most frequent, ties to the first by name; null and empty do not count."""
    rows = meetings.where(F.col("language").isNotNull() & (F.col("language") != ""))
    return rows.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "language").limit(1)


def project(chunks: DataFrame, details: DataFrame, query: str, limit: int = 10, postings=None) -> tuple[DataFrame, DataFrame]:
    """Hits of a query, and the newest entities in their meetings or holding all its terms."""
    hits = ranked(chunks, query, limit) if postings is None else postings.hits(chunks, query, limit)
    ids = hits.select("meeting_id").distinct().withColumn("near", F.lit(True))
    rows = ent.merged(details, 4 * limit).join(F.broadcast(ids), "meeting_id", "left")
    return hits, rows.where(F.col("near") | contains_all(ent.haystack(), query)).drop("near").orderBy("position").limit(limit)


def person(meetings: DataFrame, chunks: DataFrame, details: DataFrame, name: str, limit: int = 10, postings=None) -> tuple[DataFrame, DataFrame]:
    """A person's meetings, and the newest entities of those meetings or naming the person."""
    shown = recent_meetings(meetings, chunks, limit, person_meetings(chunks, name, postings))
    ids = shown.select("meeting_id").withColumn("near", F.lit(True))
    rows = ent.merged(details, 4 * limit).join(F.broadcast(ids), "meeting_id", "left")
    return shown, rows.where(F.col("near") | contains_all(ent.haystack(), name)).drop("near").orderBy("position").limit(limit)
