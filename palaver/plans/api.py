"""The memory as one object: versioned responses with plain Python data."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import querytext as q
from ..operators import context as ctx
from ..operators import entities as ent
from ..operators import graph, memory, search, state, vectors
from ..sources import chat, recorder, vault
from . import dossier
from .index import Index, ScanResult, utc_now
from .log import Conflict, Log

V1, V2 = "core.v1", "core.v2"
SOURCES = "source_uuid string, kind string, path string, label string"


@dataclass(frozen=True)
class Response:
    kind: str
    data: dict[str, Any]
    contract_version: str = V1


def _rows(df: DataFrame) -> list[dict]:
    """A result of limited size as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


class Memory:
    """Index, user state and topics below one folder. Reads are pure; what writes says so."""

    def __init__(self, spark: SparkSession, path: str, strategy=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = Index(spark, f"{self.path}/index")
        self.strategy = strategy or self.search_frame

    # small tables outside the index, as logs: whoever writes at the same time loses nothing

    def _log(self, name: str, schema: str, key: tuple[str, ...], keep: str = "last", loose: str | None = None) -> Log:
        return Log(self.spark, f"{self.path}/state/{name}", schema, key, keep, loose)

    @property
    def _tasks(self) -> Log:
        return self._log("tasks", state.SCHEMA, state.KEY, loose="orphaned")

    @property
    def _topics(self) -> Log:
        return self._log("topics", graph.TOPIC_SCHEMA, ("topic_key",), "first")

    @property
    def _aliases(self) -> Log:
        return self._log("aliases", graph.ALIAS_SCHEMA, ("normalized_alias",), "first")

    @property
    def _sources(self) -> Log:
        return self._log("sources", SOURCES, ("source_uuid",))

    def states(self) -> DataFrame:
        return self._tasks.read()

    def topics(self) -> DataFrame:
        return self._topics.read()

    def aliases(self) -> DataFrame:
        return self._aliases.read()

    def sources(self) -> DataFrame:
        return self._sources.read()

    # ---- writes

    def refresh(self, path: str, force: bool = False, label: str | None = None, prune: bool = False) -> ScanResult:
        """Bring the index up to a recorder file, and register the file's durable id."""
        key = self.register_source(path, label)
        return self.index.refresh(recorder.read(self.spark, path), str(path), force=force, prune=prune, source_uuid=key)

    def register_source(self, path: str, label: str | None = None) -> str:
        while True:
            version = self._sources.version()
            row = self.sources().where(F.col("path") == str(path)).first()
            if row is not None and not (label and label != row["label"]):
                return row["source_uuid"]
            key = row["source_uuid"] if row else str(uuid.uuid4())
            new = self.spark.createDataFrame([(key, "recorder_sqlite", str(path), label or (row["label"] if row else None))], SOURCES)
            try:  # a file has one id, whoever registers it first
                self._sources.append(new, expected=version)
                return key
            except Conflict:
                continue

    def rebind(self, old: str, new: str) -> int:
        """Point a source at a moved copy of its file; returns how many of its meetings the copy has, at least one.

        The source keeps its uuid, so ids, evidence and task states outlive the move.
        """
        have = self.sources()
        row = have.where(F.col("path") == str(old)).first()
        if row is None:
            raise LookupError(f"unknown source: {old}")
        meetings = self.index.table("meetings").where(F.col("source_path") == str(old)).select(F.col("external_id").alias("id"))
        there = recorder.read(self.spark, new)["meetings"].select(F.col("id").cast("string").alias("id"))
        both = meetings.intersect(there).count()
        if not both and not meetings.isEmpty():
            raise ValueError("the new file has none of the indexed meetings")
        moved = self.spark.createDataFrame([(row["source_uuid"], row["kind"], str(new), row["label"])], SOURCES)
        self.index.rebind(str(old), str(new))
        other = have.where((F.col("path") == str(new)) & (F.col("source_uuid") != row["source_uuid"]))
        self._sources.append(moved.unionByName(other), deleted=F.col("source_uuid") != row["source_uuid"])
        return both

    def analyze(self, meeting: str | int | None = None) -> dict[str, int]:
        """Extract the entities of one meeting, or of all, anew."""
        if meeting is None:
            return self.index.analyze()
        row = self.get_meeting(meeting).data["meeting"]
        if row is None:
            raise LookupError(f"meeting not found: {meeting}")
        return self.index.analyze(row["meeting_id"])

    def migrate_states(self, legacy: DataFrame, now: str | None = None) -> dict[str, int]:
        """Take in (entity_id, status, note) of an older index; how many rows were migrated, and why others were not."""
        states, report = state.migrate_legacy(legacy, self._details(), self.states(), now or utc_now())
        counted = {r["reason"]: r["n"] for r in report.collect()}
        known = self.states()
        self._tasks.append(states.select(*known.columns).exceptAll(known))
        return counted

    def set_task_status(self, task_id: int, status: str, note: str | None = None, now: str | None = None) -> Response:
        row = self._details().where((F.col("entity_id") == task_id) & (F.col("kind") == "action_items")).first()
        if row is None:
            raise LookupError(f"task not found: {task_id}")
        one = state.change(row.asDict() | {"source_uuid": self._uuid_of(row["meeting_id"])}, status, note, now or utc_now())
        self._tasks.append(self.spark.createDataFrame([one], state.SCHEMA))
        return Response("task_status", {"id": task_id, "status": status, "note": note})

    def add_topic_alias(self, title: str, aliases: list[str]) -> Response:
        return Response("topic_alias", self.ensure_topic(title, aliases))

    def ensure_topic(self, title: str, aliases: list[str] = (), now: str | None = None) -> dict:
        """Resolve or create a topic and add aliases; one that belongs to another topic already is left out."""
        now, topics, have = now or utc_now(), self.topics(), self.aliases()
        key = graph.resolve_topic(topics, have, title)
        if key is None:
            key = graph.topic_key(title)
            self._topics.append(self.spark.createDataFrame([(key, title, now, now)], graph.TOPIC_SCHEMA))
        wanted = {n: a for a in reversed(aliases) if (n := q.normalize_key(a))}
        taken = {r["normalized_alias"] for r in have.where(F.col("normalized_alias").isin(list(wanted))).select("normalized_alias").collect()}  # as many as are to be added
        added = [(key, a, n) for n, a in reversed(wanted.items()) if n not in taken]
        if added:
            self._aliases.append(self.spark.createDataFrame(added, graph.ALIAS_SCHEMA))
        return self.topic_view(key, title) | {"added_aliases": [a for _, a, _ in added]}

    # ---- frames

    def chunks(self) -> DataFrame:
        return self.index.table("chunks")

    def _details(self) -> DataFrame:
        chunks = self.chunks()
        rows = self.index.table("entities").join(self.index.table("meetings").select("meeting_id", F.coalesce("source_uuid", F.lit("")).alias("source_uuid")), "meeting_id")
        return ent.details(rows, chunks.drop("source_uuid"), self.states())

    def _uuid_of(self, meeting_id: int) -> str:
        row = self.index.table("meetings").where(F.col("meeting_id") == meeting_id).select("source_uuid").first()
        return (row[0] if row else None) or ""

    def _nested(self, hits: DataFrame) -> DataFrame:
        return ctx.nested(hits, F.coalesce("source_uuid", F.lit("")), F.col("source_path")).orderBy("position")

    def search_frame(self, query: str, limit: int, meeting_id: int | None = None, context: int = 0) -> DataFrame:
        """Lexical search by the index's postings."""
        return search.search(self.chunks(), query, limit, meeting_id, context, self.index.postings())

    def embed(self, provider) -> int:
        """Bring the stored vectors of a provider up to the index; how many chunks were embedded."""
        return self.index.embed(provider)

    def semantic_frame(self, provider, query: str, limit: int) -> DataFrame:
        """Evidence rows of the chunks whose stored vectors are nearest, with the distance as rank. Embeds nothing but
        the query; raises if nothing is stored."""
        top = self.index.nearest(provider, provider.embed_query(self.spark, query), limit)
        return search.lookup(self.chunks(), top.withColumnRenamed("distance", "rank"), limit).withColumns({"is_context": F.lit(False), "stage": F.lit(0)})

    def hybrid(self, provider):
        """A strategy that fuses lexical and semantic ranks."""

        def run(query: str, limit: int) -> DataFrame:
            n = vectors.candidate_limit(limit)
            a, b = self.search_frame(query, n), self.semantic_frame(provider, query, n)
            top = vectors.fuse(a.select("chunk_id", "position"), b.select("chunk_id", "position"), limit, "chunk_id").select("chunk_id", "position", F.col("score").alias("rank"))
            ids = a.select("chunk_id", "meeting_id").unionByName(b.select("chunk_id", "meeting_id")).distinct()  # two lists of limited length
            return search.lookup(self.chunks(), top.join(ids, "chunk_id"), limit).withColumns({"is_context": F.lit(False), "stage": F.lit(0)})

        return run

    # ---- responses

    @staticmethod
    def _version(v: str) -> None:
        if v not in (V1, V2):
            raise ValueError(f"unsupported contract version: {v}")

    def search(self, query: str, limit: int = 10, context: int = 0, contract_version: str = V1) -> Response:
        self._version(contract_version)
        if contract_version == V2:
            return Response("search", {"query": query, "context": context, "results": self.search_hits(query, limit, context)}, V2)
        hits = self.search_frame(query, limit, context=context).orderBy("position")
        more = ["rank"] + (["matched_chunk_id", "is_context"] if context else [])
        return Response("search", {"query": query, "context": context, "results": _rows(hits.select(*search.EVIDENCE, *more))})

    def _payload(self, df: DataFrame) -> list[dict]:
        return [{k: v for k, v in r.items() if k != "position"} for r in _rows(df)]

    def search_hits(self, query: str, limit: int = 10, context: int = 0) -> list[dict]:
        hits = self.strategy(query, limit)
        return self._payload(self._nested(search.expand(hits, self.chunks(), context, limit) if context else hits))

    def compact_search_hits(self, query: str, limit: int = 10, preview_length: int = ctx.PREVIEW) -> list[dict]:
        return self._payload(ctx.compact(self._nested(self.strategy(query, limit)), preview_length).orderBy("position"))

    def get_search_hit(self, evidence_id: str) -> dict | None:
        got = self._payload(self._nested(self.index.evidence(evidence_id).withColumns({"is_context": F.lit(False), "position": F.lit(1)})))
        return got[0] if got else None

    def resolve_search_hit(self, evidence_id: str) -> dict:
        if (hit := self.get_search_hit(evidence_id)) is None:
            raise LookupError(f"evidence not found: {evidence_id}")
        return hit

    def evidence_at(self, source_path: str, meeting_external_id: str, chunk_external_id: str | None = None, kind: str | None = None, ordinal: int | None = None) -> dict | None:
        """One evidence row by its place: the chunk's id, or kind and ordinal where it has none."""
        own = self.chunks().where((F.col("source_path") == source_path) & (F.col("meeting_external_id") == meeting_external_id))
        own = own.where(F.col("chunk_external_id") == chunk_external_id) if chunk_external_id else own.where(F.col("chunk_external_id").isNull() & (F.col("kind") == kind) & (F.col("ordinal") == ordinal))
        row = own.select(*search.EVIDENCE).first()
        return row.asDict() if row else None

    def context_bundle(self, question: str, limit: int = ctx.DEFAULT_LIMIT, meeting_id: int | None = None, neighbor_count: int = 0, max_evidence: int = ctx.MAX_EVIDENCE) -> dict:
        if neighbor_count < 0 or max_evidence < 1:
            raise ValueError("neighbor_count must not be negative and max_evidence must be positive")
        hits = self.search_frame(question, limit, meeting_id, neighbor_count).where(F.col("position") <= max_evidence)
        found = ent.of_hits(self._details(), hits)
        named = F.element_at(F.create_map(*[F.lit(x) for kv in ctx.ENTITY_NAMES.items() for x in kv]), F.col("kind"))
        evidence = self._nested(hits)
        by_chunk = {(e["meeting"]["external_id"], e["excerpt"]["chunk_external_id"]): e for e in _rows(evidence)}
        entities = []
        for r in _rows(found.select(named.alias("name"), "text", "source", "meeting_external_id", "chunk_external_id", "ordinal", "kind", "meeting_date").orderBy(F.col("meeting_date").desc_nulls_last(), "ordinal", ent.kind_index())):
            hit = by_chunk.get((r["meeting_external_id"], r["chunk_external_id"]))
            if hit:
                entities.append({"kind": r["name"], "content": r["text"], "source": hit["excerpt"], "evidence_id": hit["id"], "extraction_method": r["source"], "authoritative": False})
        return {"question": question, "evidence": self._payload(evidence), "entities": entities}

    def build_context(self, question: str, limit: int = ctx.DEFAULT_LIMIT, contract_version: str = V1, context: int = 0, meeting: str | int | None = None) -> Response:
        self._version(contract_version)
        row = self.get_meeting(meeting).data["meeting"] if meeting is not None else None
        if meeting is not None and row is None:
            raise ValueError(f"meeting not found: {meeting}")
        mid, kind = (row["meeting_id"], "meeting_context") if row else (None, "context")
        if contract_version == V2:
            return Response(kind, self.context_bundle(question, limit, mid, context), V2)
        hits = self.search_frame(question, limit, mid, context).where(F.col("position") <= ctx.MAX_EVIDENCE)
        text = ctx.markdown(question, ctx.grouped(hits).collect())
        more = {"meeting": row} if row else {}
        return Response(kind, {"question": question, **more, "markdown": text, "evidence": _rows(hits.orderBy("position").select(*search.EVIDENCE, "rank", "is_context"))})

    def build_meeting_context(self, question: str, meeting: str | int, limit: int = ctx.DEFAULT_LIMIT, **how) -> Response:
        return self.build_context(question, limit, meeting=meeting, **how)

    def meetings(self, limit: int = 20, person: str | None = None) -> Response:
        m, c = self.index.table("meetings"), self.chunks()
        only = memory.person_meetings(c, person, self.index.postings()) if person is not None else None
        return Response("meetings", {"person": person, "meetings": _rows(memory.recent_meetings(m, c, limit, only))})

    def latest_meeting(self, person: str | None = None) -> Response:
        got = self.meetings(1, person).data["meetings"]
        return Response("latest_meeting", {"person": person, "meeting": got[0] if got else None})

    def get_meeting(self, meeting: str | int) -> Response:
        m = self.index.table("meetings")
        own = F.col("external_id") == str(meeting)
        if str(meeting).lstrip("-").isdigit():
            own = own | (F.col("meeting_id") == int(meeting))
        row = m.where(own).first()
        return Response("meeting", {"meeting": row.asDict() if row else None})

    def meeting_chunks(self, meeting_id: int) -> Response:
        return Response("meeting_chunks", {"meeting_id": meeting_id, "chunks": _rows(self.chunks().where(F.col("meeting_id") == meeting_id).orderBy("ordinal", "kind"))})

    def stats(self) -> dict[str, int]:
        """Counts of sources, meetings, chunks, entities by kind, and nodes and edges of the graph."""
        found = self.index.table("entities")
        counted = _rows(memory.index_counts(self.sources(), self.index.table("meetings"), self.chunks(), found))[0]
        kinds = {r["kind"]: r["n"] for r in ent.counts(found).collect()}
        return {k: v for k, v in counted.items() if k != "structured_entities"} | kinds

    def list_topics(self, limit: int = 100) -> list[dict]:
        return _rows(graph.list_topics(self.topics(), self.aliases(), limit).orderBy(F.col("updated_at").desc_nulls_last(), "title", "topic_key"))

    def summary(self) -> Response:
        counts = _rows(memory.stats(self.index.table("meetings"), self.chunks(), self.index.table("entities")))[0]
        return Response("summary", {"stats": counts, "latest_meeting": self.latest_meeting().data["meeting"]})

    def timeline(self, query: str | None = None, limit: int = 20) -> Response:
        return Response("timeline", {"query": query, "signals": _rows(ent.timeline(self._details(), query, limit))})

    def project(self, query: str, limit: int = 10) -> Response:
        hits, signals = memory.project(self.chunks(), self._details(), query, limit, self.index.postings())
        return Response("project", {"query": query, "meetings": _rows(hits.select(*search.EVIDENCE, "rank")), "structured_signals": _rows(signals)})

    def person(self, name: str, limit: int = 10) -> Response:
        shown, signals = memory.person(self.index.table("meetings"), self.chunks(), self._details(), name, limit, self.index.postings())
        return Response("person", {"person": name, "meetings": _rows(shown), "structured_signals": _rows(signals)})

    def topic_view(self, key: str, title: str) -> dict:
        row = self.topics().where(F.col("topic_key") == key).first()
        names = sorted(r[0] for r in self.aliases().where(F.col("topic_key") == key).select("alias").toLocalIterator())
        return {"topic_key": key, "title": row["title"] if row else title, "aliases": names}

    def _topic(self, title: str) -> dict:
        key = graph.resolve_topic(self.topics(), self.aliases(), title) or graph.topic_key(title)
        return self.topic_view(key, title)

    def topic(self, title: str, limit: int = 10) -> Response:
        """A topic's evidence, signals, people and language. Nothing is written; add_topic_alias makes a topic last."""
        topic = self._topic(title)
        terms = [topic["title"], *topic["aliases"]]
        evidence = graph.topic_evidence(self.chunks(), terms, limit, self.index.postings())
        details = self._details()
        signals = graph.topic_signals(details, terms, limit)
        linked = graph.topic_links(details, terms)
        seen = evidence.select("language", "position").unionByName(signals.select(F.col("meeting_language").alias("language"), (F.col("position") + limit).alias("position")))
        lang = graph.dominant_language(seen).first()
        hits = _rows(evidence.select(*search.EVIDENCE, "rank").orderBy("position"))
        return Response("topic", {"topic": topic, "language": lang["language"] if lang else None, "query_terms": terms, "meetings": hits, "evidence": hits, "structured_signals": _rows(signals.orderBy("position")), "related_people": _rows(graph.topic_people(linked, graph.people(self.chunks()), limit))})

    def dossier(self, title: str, limit: int = 10, language: str | None = None) -> str:
        """A topic as text, in the language set, else that of its evidence."""
        data = self.topic(title, limit).data
        return dossier.dossier(data, language or data["language"] or "en")

    def ask_prompt(self, question: str, limit: int = ctx.DEFAULT_LIMIT, meeting: str | None = None, topic: str | None = None) -> str:
        """The prompt that asks a language model a question with its context; a topic's title joins the search."""
        memory_ = self.topic(topic, limit).data if topic else None
        found = self.build_context(f"{topic} {question}" if topic else question, limit, meeting=meeting)
        return dossier.prompt(question, found.data["markdown"], meeting, memory_)

    def ask(self, question: str, provider: str | None = None, model: str | None = None, url: str | None = None, **how) -> str:
        """A model's answer to the prompt, or the prompt itself where a person asks."""
        text = self.ask_prompt(question, **how)
        return chat.ask(text, model, url) if chat.provider(provider) == "ollama" else text

    def graph(self, title: str, limit: int = 50) -> Response:
        topic = self._topic(title)
        own = graph.topic_edges(graph.topic_links(self._details(), [topic["title"], *topic["aliases"]]), topic["topic_key"])
        nodes, edges = graph.stored_subgraph(self.index, own, topic["topic_key"], topic["title"], limit)
        return Response("graph", {"topic": topic, "nodes": _rows(nodes), "edges": _rows(edges)})

    def structured_entities(self, kind: str, limit: int = 20, status: str = "all") -> Response:
        return Response("structured_entities", {"entity_kind": kind, "status": status, "entities": _rows(ent.latest(self._details(), kind, limit, status))})

    def sync_vault(self, root: str, limit: int = 100) -> vault.SyncResult:
        meetings = memory.recent_meetings(self.index.table("meetings"), self.chunks(), limit)
        topics = [self.topic(t["title"]).data for t in self.list_topics(limit)]
        return vault.sync(root, meetings, ent.merged(self._details(), limit).orderBy("position"), topics)
