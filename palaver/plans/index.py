"""The index: meetings, chunks, entities, postings and evidence in segments, refreshed by what changed."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import entities as ent
from ..operators import cells, graph, inverted, search
from . import normalize as norm

SCHEMA_VERSION = 5
MEETINGS = "meeting_id long, source_kind string, source_path string, external_id string, title string, created_at string, updated_at string, folder_path string, language string, summary_text string, fingerprint string, indexed_at string"
CHUNKS = "chunk_id long, meeting_id long, source_kind string, source_path string, meeting_external_id string, title string, created_at string, updated_at string, folder_path string, language string, chunk_external_id string, kind string, ordinal long, text string, speaker string, starts_at_seconds double, ends_at_seconds double, timestamp_label string, token_count long, fingerprint string"
ENTITIES = "entity_id long, kind string, meeting_id long, source_chunk_id long, ordinal long, text string, source string, confidence double, fingerprint string"
EVIDENCE = "evidence_id string, meeting_id long, chunk_id long"
ORIGINS = "source_key string, source_uuid string, source_path string"
#: A node of one meeting; what several meetings have in common (people) has a row in each, so its support goes with them.
NODES = "type string, stable_key string, title string, meeting_id long, ordinal long, chunk_id long"
EDGES = "from_key string, relation string, to_key string, confidence double, meeting_id long, chunk_id long, extraction_method string"
VECTORS = "meeting_id long, chunk_id long, chunk_fingerprint string, vector array<float>, cell int, r double"
#: What stands in files: a source by its key; where its file is now, stands in `origins`, once.
STORED = {name: schema.replace("source_path string", "source_key string") for name, schema in {"meetings": MEETINGS, "chunks": CHUNKS}.items()} | {"entities": ENTITIES, "postings": inverted.POSTINGS, "evidence": EVIDENCE, "nodes": NODES, "edges": EDGES, "edges_to": EDGES}
TABLES = {"meetings": MEETINGS, "chunks": CHUNKS, "entities": ENTITIES, "postings": inverted.POSTINGS, "evidence": EVIDENCE, "nodes": NODES, "edges": EDGES, "edges_to": EDGES}
#: So many segments of a tier become one of the next; a tier's segments are up to TIER times as large as the last one's.
TIER = 4
RUNS = "source_path string, started_at string, finished_at string, status string, meetings_seen long, meetings_inserted long, meetings_updated long, meetings_unchanged long, chunks_inserted long, chunks_updated long, meetings_analyzed long"
EMPTY = {"schema": SCHEMA_VERSION, "segments": [], "about": {}, "origins": None, "ledger": {}, "pivots": {}}


def utc_now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


@dataclass
class ScanResult:
    meetings_seen: int = 0
    meetings_inserted: int = 0
    meetings_updated: int = 0
    meetings_unchanged: int = 0
    chunks_inserted: int = 0
    chunks_updated: int = 0
    meetings_analyzed: int = 0


def classify(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """(key, change): inserted, updated or unchanged by fingerprint; missing where the new side has no such key."""
    o, n = old.select("key", F.col("fingerprint").alias("f0")), new.select("key", F.col("fingerprint").alias("f1"))
    same = F.col("f0") == F.col("f1") if not force else F.lit(False)
    change = F.when(F.col("f1").isNull(), "missing").when(F.col("f0").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return o.join(n, "key", "full").select("key", change.alias("change"))


class Index:
    """Tables in segments below `path`. A refresh writes one segment with the meetings that changed and the ids of those
    it replaces, so it costs what has changed, not what is there; rows of replaced meetings in earlier segments are left
    out when tables are read. Neighbouring segments of one size become one of the next size, so each row is written a
    number of times that grows with the logarithm of the index. Numbered pointer files name the segments of each state;
    the highest whole one counts, so a reader sees a state before a refresh or after it, never none, and of two refreshes
    at once one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> tuple[int, dict]:
        """Number and content of the current state; 0 and EMPTY before the first refresh."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        if not fs.exists(folder):
            return 0, EMPTY
        for name in sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                found = json.loads(text)
            except ValueError:  # still being written
                continue
            if found["schema"] > SCHEMA_VERSION:
                raise ValueError(f"the index has a newer schema: {found['schema']}")
            return int(name), EMPTY | found
        return 0, EMPTY

    def _state(self) -> tuple[int, list[str]]:
        """Number and segments of the current state."""
        number, found = self._pointer()
        return number, found["segments"]

    def _publish(self, state: int, segments: list[str], **changes) -> int:
        """Make `segments` the state after `state`; fails if another one was published meanwhile."""
        jvm, fs = self._fs()
        content = self._pointer()[1] | {"schema": SCHEMA_VERSION} | changes | {"segments": segments}
        content["about"] = {s: v for s, v in content["about"].items() if s in segments}
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/{state + 1:012d}"), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return state + 1

    def version(self) -> str | None:
        segments = self._state()[1]
        return segments[-1] if segments else None

    def batch(self, stream: str) -> int | None:
        """The last batch of a stream that was taken in."""
        return self._pointer()[1]["ledger"].get(stream)

    # ---- reads

    def _read(self, segment: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment}/{name}")

    def _live(self, name: str, segments: list[str], have: list[str] | None = None) -> list[DataFrame | None]:
        """The live rows of each segment, as they are stored: without those of meetings that a later one replaces."""
        out = []
        for k, s in enumerate(segments):
            if have is not None and s not in have:
                out.append(None)
                continue
            rows = self._read(s, name, STORED.get(name, VECTORS))
            if later := segments[k + 1 :]:
                gone = _union([self._read(x, "gone", "gone_id long") for x in later])
                rows = rows.join(gone, F.col("meeting_id") == F.col("gone_id"), "left_anti")
            out.append(rows)
        return out

    def origins(self) -> DataFrame:
        """(source_key, source_uuid, source_path): where each source's file is now."""
        folder = self._pointer()[1]["origins"]
        return self.spark.read.schema(ORIGINS).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], ORIGINS)

    def _with_path(self, rows: DataFrame) -> DataFrame:
        """Stored rows with source_path in place of the key, and source_uuid. A row a source is joined, whatever side of it is small."""
        known = self.origins()
        return rows.join(known, "source_key", "left").drop("source_key")

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """The live rows of a table: a replaced or deleted meeting's rows in earlier segments do not count."""
        segments = self._state()[1] if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], TABLES[name] + (", source_uuid string" if name in ("meetings", "chunks") else ""))
        rows = _union(self._live(name, segments))
        if name in ("meetings", "chunks"):
            order = [c.split()[0] for c in TABLES[name].split(", ")]
            return self._with_path(rows).select(*order, "source_uuid")
        return rows

    def postings(self, few: int = inverted.FEW) -> inverted.Postings:
        """Search over the postings of all segments; what later ones replace is taken off the counts, too."""
        about, segments = (x := self._pointer()[1])["about"], x["segments"]
        heads = [self._read(s, "blocks", inverted.BLOCKS) for s in segments]
        parts = [inverted.Part(r, h, about[s]["buckets"]) for s, r, h in zip(segments, self._live("postings", segments) if segments else [], heads, strict=True)]
        totals = _union([self._read(s, "lengths", inverted.LENGTHS) for s in segments]) if segments else self.spark.createDataFrame([], inverted.LENGTHS)
        return inverted.Postings(parts, totals, few)

    def evidence(self, evidence_id: str) -> DataFrame:
        """The chunk of an evidence id, or no row: its place by a table in the order of the ids, then the chunk by its place."""
        got = self.table("evidence").where(F.col("evidence_id") == evidence_id).limit(1).collect()
        return search.by_key(self.table("chunks"), [(r["meeting_id"], r["chunk_id"]) for r in got])

    def nodes(self, keys: list[str] | None = None) -> DataFrame:
        """(type, stable_key, title, support): the stored graph's nodes, or some of them; support is in meetings.

        A person has the name that comes first over the whole index, and goes with the last meeting they speak in.
        """
        rows = self.table("nodes")
        if keys is not None:
            rows = rows.where(search.equals("stable_key", keys))
        return rows.groupBy("type", "stable_key").agg(F.min_by("title", F.struct("meeting_id", "ordinal", "chunk_id")).alias("title"), F.count("*").alias("support"))

    def edges(self) -> DataFrame:
        return self.table("edges")

    def edges_at(self, keys: list[str]) -> DataFrame:
        """The edges that touch any of some nodes: by two copies, in the order of either end, so neither is scanned."""
        ends = [self.table(name).where(search.equals(c, keys)) for name, c in (("edges", "from_key"), ("edges_to", "to_key"))]
        return ends[0].unionByName(ends[1]).distinct()

    def embedded(self, provider) -> list[str]:
        """The segments that have vectors of a provider."""
        name, pointer = vectors_of(provider), self._pointer()[1]
        return [s for s in pointer["segments"] if name in pointer["about"][s].get("vectors", [])]

    def vectors(self, provider) -> DataFrame:
        """Live vectors of a provider: (meeting_id, chunk_id, chunk_fingerprint, vector, cell, r)."""
        segments, name = self._state()[1], vectors_of(provider)
        have = self.embedded(provider)
        live = [rows for s, rows in zip(segments, self._live(name, segments, have), strict=True) if s in have]
        return _union(live) if live else self.spark.createDataFrame([], VECTORS)

    def nearest(self, provider, query: list[float], limit: int = 10) -> DataFrame:
        """(meeting_id, chunk_id, distance, position) of the exact nearest stored vectors. Raises if nothing is stored."""
        name, pointer, have = vectors_of(provider), self._pointer()[1], self.embedded(provider)
        if not have:
            raise ValueError("the vector index is empty; embed the chunks first")
        heads = _union([self._read(s, f"{name}-cells", cells.HEADS) for s in have])
        rows = self.vectors(provider).withColumn("key", F.struct("chunk_id", "meeting_id"))
        return cells.search(rows, heads, self._pivots(pointer["pivots"][name]), query, limit, "key").select("key.meeting_id", "key.chunk_id", "distance", "position")

    def _pivots(self, folder: str) -> np.ndarray:
        rows = self.spark.read.schema("at int, vector array<double>").parquet(f"{self.path}/{folder}").orderBy("at").collect()  # PIVOTS rows
        return np.array([r["vector"] for r in rows])

    def runs(self) -> DataFrame:
        jvm, fs = self._fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")

    # ---- writes

    def _new(self) -> str:
        return f"s{uuid.uuid4().hex[:12]}"

    def _write_rows(self, segment: str, meetings: DataFrame, chunks: DataFrame) -> tuple[DataFrame, int]:
        """Meetings, clustered chunks and evidence of a segment; the chunks as written, and their number."""
        at = f"{self.path}/{segment}"
        meetings.write.parquet(f"{at}/meetings")
        search.clustered(chunks).write.parquet(f"{at}/chunks")
        stored = self._read(segment, "chunks", STORED["chunks"])
        uuids = self.origins().select("source_key", "source_uuid")
        named = stored.join(uuids, "source_key", "left").select(ctx.evidence_id(F.coalesce("source_uuid", F.lit(""))).alias("evidence_id"), "meeting_id", "chunk_id")
        named.repartitionByRange("evidence_id").sortWithinPartitions("evidence_id").write.parquet(f"{at}/evidence")
        return stored, stored.count()

    def _write_entities(self, segment: str, entities: DataFrame) -> None:
        entities.write.partitionBy("kind").parquet(f"{self.path}/{segment}/entities")

    def _write_graph(self, segment: str, nodes: DataFrame, edges: DataFrame) -> None:
        at = f"{self.path}/{segment}"
        nodes.repartitionByRange("stable_key").sortWithinPartitions("stable_key").write.parquet(f"{at}/nodes")
        for name, end in (("edges", "from_key"), ("edges_to", "to_key")):
            edges.repartitionByRange(end).sortWithinPartitions(end).write.parquet(f"{at}/{name}")

    def embed(self, provider) -> int:
        """Embed the chunks of the segments that have no vectors of this provider; returns how many chunks.

        A refresh leaves one new segment, so this costs what has changed; vectors of replaced meetings go with them.
        """
        name, done = vectors_of(provider), 0
        state, pointer = self._pointer()
        segments, about = pointer["segments"], {s: dict(v) for s, v in pointer["about"].items()}
        todo = [s for s in segments if name not in about[s].get("vectors", [])]
        pivots = self._pivots(pointer["pivots"][name]) if name in pointer["pivots"] else None
        folder = pointer["pivots"].get(name)
        for s, chunks in zip(segments, self._live("chunks", segments, todo), strict=True):
            if chunks is None:
                continue
            at = f"{self.path}/{s}/{name}"
            got = provider(chunks).join(chunks.select("chunk_id", "meeting_id", F.col("fingerprint").alias("chunk_fingerprint")), "chunk_id")
            got.select("meeting_id", "chunk_id", "chunk_fingerprint", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(f"{at}-new")
            rows = self.spark.read.parquet(f"{at}-new")
            if pivots is None:
                found = cells.pivots_of(rows)
                if not len(found):
                    continue
                pivots, folder = found, f"p{uuid.uuid4().hex[:12]}"
                self.spark.createDataFrame([(k, v) for k, v in enumerate(pivots.tolist())], "at int, vector array<double>").coalesce(1).write.parquet(f"{self.path}/{folder}")
            cells.write(cells.placed(rows, pivots), at)
            about[s]["vectors"] = [*about[s].get("vectors", []), name]
            done += rows.count()
        if done:
            self._publish(state, segments, about=about, pivots=pointer["pivots"] | {name: folder})
        return done

    def _write_gone(self, segment: str, gone: DataFrame) -> None:
        gone.select(F.col(gone.columns[0]).alias("gone_id")).write.parquet(f"{self.path}/{segment}/gone")

    def _segment(self, segment: str, meetings: DataFrame, chunks: DataFrame, entities: DataFrame | None, replaced: DataFrame | None) -> dict:
        """A segment of new rows. `replaced`: the chunks, live until now, whose meetings it replaces or deletes; their
        terms and lengths are taken off the index's counts, so no query has to count what is live."""
        at = f"{self.path}/{segment}"
        stored, n = self._write_rows(segment, meetings, chunks)
        if not stored.groupBy("meeting_id", "chunk_id").count().where("count > 1").isEmpty():
            raise ValueError("two chunks have one id")
        self._write_entities(segment, ent.extract(stored) if entities is None else entities)
        self._write_graph(segment, *graph.of_segment(stored, self._read(segment, "entities", ENTITIES)))
        buckets = inverted.write_parts(inverted.term_rows(stored), at, n)
        inverted.written_lengths(self.spark, at, n).write.parquet(f"{at}/lengths")
        if replaced is not None:
            gone = inverted.term_rows(replaced).groupBy("term").agg((-F.count("*")).alias("n"))
            inverted.write_heads(inverted.taken_off(gone, buckets), at, "append")
            inverted.lengths(replaced).select((-F.col("n_rows")).alias("n_rows"), (-F.col("dl")).alias("dl")).write.mode("append").parquet(f"{at}/lengths")
        return {"rows": n, "buckets": buckets}

    def _origin(self, source: str, source_uuid: str | None) -> str:
        """The key of a source; a new one is published with its file."""
        known = self.origins()
        same = (F.col("source_uuid") == source_uuid) if source_uuid else (F.col("source_path") == source)
        row = known.where(same).first()
        if row is not None and row["source_path"] == source:
            return row["source_key"]
        key = row["source_key"] if row is not None else source_uuid or source
        self._save_origins(known.where(F.col("source_key") != key).unionByName(self.spark.createDataFrame([(key, source_uuid, source)], ORIGINS)))
        return key

    def _save_origins(self, rows: DataFrame) -> None:
        """A row a source: the whole list is written anew, no chunk is."""
        state, segments = self._state()
        folder = f"o{uuid.uuid4().hex[:12]}"
        rows.coalesce(1).write.parquet(f"{self.path}/{folder}")
        self._publish(state, segments, origins=folder)

    def refresh(self, tables: dict[str, DataFrame], source: str, force: bool = False, analyze: bool = True, prune: bool = False, now: str | None = None, source_uuid: str | None = None, batch: tuple[str, int] | None = None) -> ScanResult | None:
        """Bring the index up to the recorder's tables.

        Changed meetings are replaced whole, with chunks, entities and postings. Meetings gone upstream stay unless
        `prune`. Ids follow from the source's uuid, or its first path where it has none. `batch` (stream, number) is
        noted in the state that it makes; one that was taken in before changes nothing, and gives None.
        """
        began = now or utc_now()
        if batch and (last := self.batch(batch[0])) is not None and batch[1] <= last:
            return None
        key = self._origin(source, source_uuid)
        state, pointer = self._pointer()
        segments = pointer["segments"]
        ledger = pointer["ledger"] | ({batch[0]: batch[1]} if batch else {})
        meetings, chunks = (t.withColumnRenamed("source_path", "source_key") for t in norm.normalize(tables, key, began, source_uuid))
        segment = self._new()
        at = f"{self.path}/{segment}"
        meetings.write.parquet(f"{at}/_new_meetings")
        new_m = self._read(segment, "_new_meetings", STORED["meetings"])
        old = _union(self._live("meetings", segments)) if segments else self.spark.createDataFrame([], STORED["meetings"])
        if segments and not old.where(F.col("source_key") != key).join(new_m, "meeting_id", "left_semi").isEmpty():
            raise ValueError("two meetings of different sources have one id")
        keyed = [m.select(F.col("meeting_id").alias("key"), "fingerprint") for m in (old.where(F.col("source_key") == key), new_m)]
        classify(*keyed, force).write.parquet(f"{at}/_diff")
        diff = self._read(segment, "_diff", "key long, change string")
        n = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
        done = n.get("inserted", 0) + n.get("updated", 0)
        c: dict[str, int] = {}
        if done or prune and n.get("missing"):
            fresh = diff.where(F.col("change").isin("inserted", "updated")).select(F.col("key").alias("meeting_id"), "change")
            self._write_gone(segment, diff.where(F.col("change").isin(["updated"] + (["missing"] if prune else []))).select("key"))
            gone = self._read(segment, "gone", "gone_id long")
            ids = fresh.select("meeting_id")
            kept = None if analyze else self.spark.createDataFrame([], ENTITIES)
            about = self._segment(segment, new_m.join(ids, "meeting_id", "left_semi"), chunks.join(ids, "meeting_id", "left_semi").select(*[x.split()[0] for x in STORED["chunks"].split(", ")]), kept, self._of_meetings("chunks", segments, gone))
            stored = self._read(segment, "chunks", STORED["chunks"])
            c = {r["change"]: r["n"] for r in stored.join(fresh, "meeting_id").groupBy("change").agg(F.count("*").alias("n")).collect()}
            self._publish(state, [*segments, segment], about=pointer["about"] | {segment: about}, ledger=ledger)
            self.merge()
        elif batch:
            self._publish(state, segments, ledger=ledger)
        result = ScanResult(done + n.get("unchanged", 0), n.get("inserted", 0), n.get("updated", 0), n.get("unchanged", 0), sum(c.values()), c.get("updated", 0), done if analyze else 0)
        row = {"source_path": source, "started_at": began, "finished_at": now or utc_now(), "status": "completed", **asdict(result)}
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return result

    def _of_meetings(self, name: str, segments: list[str], ids: DataFrame) -> DataFrame | None:
        """Stored live rows of some meetings. Few ids become literals, which clustered files are read by."""
        if not segments:
            return None
        some = ids.limit(search.LITERALS + 1).collect()
        rows = _union(self._live(name, segments))
        if len(some) <= search.LITERALS:
            return rows.where(search.equals("meeting_id", (r[0] for r in some))) if some else None
        return rows.join(ids.toDF("meeting_id"), "meeting_id", "left_semi")

    def _merged(self, i: int, j: int, state: int, pointer: dict) -> int:
        """Publish segments i to j - 1 as one. Their live rows are copied in order: no text is cut or tokenised again."""
        segments = pointer["segments"]
        run, segment = segments[i:j], self._new()
        at = f"{self.path}/{segment}"
        self._write_gone(segment, _union([self._read(s, "gone", "gone_id long") for s in run]).distinct() if i else self.spark.createDataFrame([], "gone_id long"))
        _, n = self._write_rows(segment, _union(self._live("meetings", run)), _union(self._live("chunks", run)))
        self._write_entities(segment, _union(self._live("entities", run)))
        self._write_graph(segment, _union(self._live("nodes", run)), _union(self._live("edges", run)))
        rows = _union(self._live("postings", run)).select("term", "chunk_id", "meeting_id", "tf", "dl", "pos")
        buckets = inverted.write_parts(rows, at, n)
        if i:  # what the run takes off the counts of segments before it
            counts = _union([self._read(s, "blocks", inverted.BLOCKS).select("term", "n") for s in run]).unionByName(self._read(segment, "blocks", inverted.BLOCKS).select("term", (-F.col("n")).alias("n")))
            inverted.write_heads(inverted.taken_off(counts.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0"), buckets), at, "append")
        _union([self._read(s, "lengths", inverted.LENGTHS) for s in run]).agg(F.sum("n_rows").alias("n_rows"), F.sum("dl").alias("dl")).write.parquet(f"{at}/lengths")
        kept = [name for name in pointer["pivots"] if all(name in pointer["about"][s].get("vectors", []) for s in run)]
        for name in kept:
            cells.write(_union(self._live(name, run)), f"{at}/{name}")
        return self._publish(state, [*segments[:i], segment, *segments[j:]], about=pointer["about"] | {segment: {"rows": n, "buckets": buckets, "vectors": kept}})

    def merge(self) -> None:
        """Merge the newest segments while they are `due`."""
        while True:
            state, pointer = self._pointer()
            i = due([pointer["about"][s]["rows"] for s in pointer["segments"]])
            if i is None:
                return
            self._merged(i, len(pointer["segments"]), state, pointer)

    def compact(self) -> None:
        """Merge all segments into one."""
        state, pointer = self._pointer()
        if pointer["segments"]:
            self._merged(0, len(pointer["segments"]), state, pointer)

    def rebind(self, old: str, new: str) -> None:
        """A source's file has moved: one row of the list of sources changes; ids, chunks and postings stay."""
        known = self.origins()
        moved = F.when(F.col("source_path") == old, new).otherwise(F.col("source_path"))
        self._save_origins(known.withColumn("source_path", moved))

    def analyze(self, meeting_id: int | None = None) -> dict[str, int]:
        """Extract the entities of one meeting, or of all as one job, anew; the number of each kind."""
        state, pointer = self._pointer()
        segments = pointer["segments"]
        if not segments:
            return dict.fromkeys(ent.KINDS, 0)
        segment = self._new()
        at = f"{self.path}/{segment}"
        if meeting_id is None:
            self._write_gone(segment, self.spark.createDataFrame([], "gone_id long"))
            stored, n = self._write_rows(segment, _union(self._live("meetings", segments)), _union(self._live("chunks", segments)))
            self._write_entities(segment, ent.extract(stored))
            self._write_graph(segment, *graph.of_segment(stored, self._read(segment, "entities", ENTITIES)))
            buckets = inverted.write_parts(_union(self._live("postings", segments)).select("term", "chunk_id", "meeting_id", "tf", "dl", "pos"), at, n)
            inverted.written_lengths(self.spark, at, n).write.parquet(f"{at}/lengths")
            self._publish(state, [segment], about={segment: {"rows": n, "buckets": buckets}})
            return {r["kind"]: r["n"] for r in ent.counts(self.table("entities")).collect()}
        own = F.col("meeting_id") == meeting_id
        meetings, chunks = (_union(self._live(t, segments)).where(own) for t in ("meetings", "chunks"))
        if meetings.isEmpty():
            raise LookupError(f"meeting not found: {meeting_id}")
        self._write_gone(segment, meetings.select("meeting_id"))
        about = self._segment(segment, meetings, chunks, None, chunks)
        self._publish(state, [*segments, segment], about=pointer["about"] | {segment: about})
        return {r["kind"]: r["n"] for r in ent.counts(self.table("entities").where(own)).collect()}

    def vacuum(self) -> None:
        """Delete the segments and lists that the current state does not name, and earlier pointers."""
        jvm, fs = self._fs()
        state, pointer = self._pointer()
        used = {*pointer["segments"], pointer["origins"], *pointer["pivots"].values()}
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            name = s.getPath().getName()
            if s.isDirectory() and len(name) == 13 and name[0] in "sop" and name not in used:
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")) if state else ():
            if s.getPath().getName() < f"{state:012d}":
                fs.delete(s.getPath(), False)


def vectors_of(provider) -> str:
    """The table of a provider's vectors within a segment."""
    key = f"{provider.provider}/{provider.model}/{provider.dims}"
    return f"vectors-{hashlib.sha256(key.encode()).hexdigest()[:12]}"


def due(rows: list[int]) -> int | None:
    """From where on segments of these sizes, oldest first, are to be merged, if any: TIER of them, none of a higher
    tier than the newest, stand at the end. A row is then merged as often as the index has grown by a factor of TIER."""
    tiers = [int(math.log(max(1, n), TIER) + 1e-9) for n in rows]
    i = len(tiers)
    while i and tiers[i - 1] <= tiers[-1]:
        i -= 1
    return i if len(tiers) - i >= TIER else None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
