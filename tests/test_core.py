"""Search, extraction, refresh, memory and evaluation on a small recorder file with known answers."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from palaver.functions import querytext as q
from palaver.functions import text as t
from palaver.operators import context, entities, evaluation, graph, inverted, search, state, vectors
from palaver.plans import api
from palaver.plans.index import Index
from palaver.sources import chat, recorder, settings, vault
from palaver.streaming import refresh


def fill(path, meetings=2):
    db = sqlite3.connect(path)
    db.executescript(
        """create table meetings (id text primary key, title text, created_at text, updated_at text, folder_path text);
        create table transcripts (id text primary key, meeting_id text, transcript text, timestamp text, summary text, action_items text, key_points text, audio_start_time real, audio_end_time real, duration real, speaker text);
        create table summary_processes (meeting_id text primary key, status text, result text, metadata text);
        create table meeting_notes (meeting_id text primary key, notes_markdown text);"""
    )
    rows = [("meeting-1", "Launch Planning", "2026-07-01T10:00:00Z", "2026-07-01T11:00:00Z", None), ("meeting-2", "Dobrynya Follow-up", "2026-07-02T09:00:00Z", "2026-07-02T09:30:00Z", None)]
    db.executemany("insert into meetings values (?, ?, ?, ?, ?)", rows[:meetings])
    said = [
        ("transcript-1", "meeting-1", "Alice confirmed the launch checklist and pricing decision.", "10:05:00", 300.0, 315.0, "Alice"),
        ("transcript-2", "meeting-2", "Dobrynya agreed to send migration risks by Friday.", "09:10:00", 600.0, 620.0, "Dobrynya"),
        ("transcript-3", "meeting-1", "Open question: who owns partner review?", "10:15:00", 900.0, 910.0, "Alice"),
        ("transcript-4", "meeting-2", "Добрыня подтвердил план миграции.", "09:20:00", 1200.0, 1210.0, None),
    ]
    db.executemany("insert into transcripts (id, meeting_id, transcript, timestamp, audio_start_time, audio_end_time, speaker) values (?, ?, ?, ?, ?, ?, ?)", said)
    db.execute("insert into summary_processes values ('meeting-1', 'completed', ?, ?)", (json.dumps({"markdown": "Launch checklist approved."}), json.dumps({"language": "en"})))
    db.execute("insert into meeting_notes values ('meeting-2', 'Dobrynya owns the migration risk list.')")
    db.commit()
    db.close()
    return path


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("memory")
    m = api.Memory(spark, str(root / "store"))
    m.file = fill(root / "recorder.sqlite")
    m.first = m.refresh(m.file)
    return m


def test_query_parsing():
    assert q.fts_query("What was the pricing decision?") == '"pricing" OR "decision"'
    assert q.strict_fts_query("pricing decision") == '"pricing" AND "decision"' and q.strict_fts_query("pricing") == ""
    assert q.any_terms("миграция") == ["миграция", "миграции", "миграцию", "миграцией"]
    assert q.case_variants("работа") == ["работа", "работы", "работе", "работу", "работой"] and q.case_variants("dana") == ["dana"]
    assert q.query_tokens("а я the A ab ab " + " ".join(f"w{i}" for i in range(30)))[:2] == ["ab", "w0"] and len(q.query_tokens(" ".join(f"w{i}" for i in range(30)))) == 16


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_text_functions(spark):
    assert one(spark, t.normalize_text("x"), " a \r\n\r\n\r\n b \rc ", "", " \n ") == ["a\n\nb\nc", "", ""]
    assert one(spark, t.clean_optional("x"), "  ", " y ", None) == [None, "y", None]
    assert one(spark, t.index_tokens("x"), "Café foo_bar 3.14 ёж Straße²") == [["cafe", "foo", "bar", "3", "14", "ёж", "straße²"]]
    assert one(spark, t.sentences("x"), "One. Two?  Three!\nFour.five") == [["One.", "Two?", "Three!", "Four.five"]]
    assert one(spark, t.preview("x", 5), "abc  defg", "abcde") == ["abc…", "abcde"]
    assert one(spark, t.casefold("x"), "STRASSE Straße ΟΔΟΣ") == ["strasse strasse οδοσ"]
    assert one(spark, t.safe_note_name("x"), ' a/b:c? ') == ["a_b_c_"]
    assert one(spark, t.token_count("x"), " a  b c ", "") == [3, 0]
    with pytest.raises(ValueError):
        t.preview("x", 0)


def test_chunks_of_the_file(memory):
    rows = memory.chunks().orderBy("meeting_external_id", "ordinal").collect()
    assert [(r.meeting_external_id, r.chunk_external_id, r.ordinal) for r in rows] == [
        ("meeting-1", "transcript-1", 0), ("meeting-1", "transcript-3", 1), ("meeting-1", "summary:meeting-1", 2),
        ("meeting-2", "transcript-2", 0), ("meeting-2", "transcript-4", 1), ("meeting-2", "note:meeting-2", 2),
    ]
    assert rows[0].language == "en" and rows[2].text == "Launch checklist approved." and rows[0].token_count == 8


def test_golden_ranks(memory):
    got = {r.chunk_external_id: r.rank for r in search.ranked(memory.chunks(), "migration risks", 10, mode="any").collect()}
    assert got == {"transcript-2": pytest.approx(-1.645716687189), "note:meeting-2": pytest.approx(-0.583284469171)}
    strict = search.ranked(memory.chunks(), "pricing decision", 10, mode="all").collect()
    assert [(r.chunk_external_id, r.rank) for r in strict] == [("transcript-1", pytest.approx(-2.361596195629))]
    assert [r.chunk_external_id for r in search.ranked(memory.chunks(), "launch", 3).orderBy("position").collect()] == ["summary:meeting-1", "transcript-1", "transcript-3"]
    assert search.ranked(memory.chunks(), "the of", 5).count() == 0


def test_stored_index_ranks_like_the_rows(spark, memory, tmp_path):
    index = inverted.StoredIndex(spark, str(tmp_path / "fts")).build(memory.chunks())
    for text in ("migration risks", "launch", "pricing decision", "dobrynya friday"):
        want = [(r.chunk_id, round(r.rank, 9), r.stage) for r in search.ranked(memory.chunks(), text, 5).orderBy("position").collect()]
        assert [(r.chunk_id, round(r.rank, 9), r.stage) for r in index.ranked(text, 5).orderBy("position").collect()] == want


def test_phrases_and_neighbours(spark, memory):
    rows = spark.createDataFrame([(1, 1, 0, "t", "the foo_bar file", None), (2, 1, 1, "t", "bar foo", None), (3, 1, 2, "t", "none", None)], "chunk_id long, meeting_id long, ordinal long, title string, text string, speaker string")
    assert [r.chunk_id for r in search.ranked(rows, "foo_bar", 5).collect()] == [1]
    hits = memory.search("pricing decision", 1, context=1).data["results"]
    assert [(h["chunk_external_id"], h["is_context"]) for h in hits] == [("transcript-1", False), ("transcript-3", True)]
    around = search.expand(search.ranked(memory.chunks(), "partner review", 1), memory.chunks(), 2).orderBy("position").collect()
    assert [r.chunk_external_id for r in around] == ["transcript-3", "transcript-1", "summary:meeting-1"]


def test_extraction_rules(spark):
    text = (
        "We should think about the roadmap. Please share notes. Can you send it? Open question: who will review? "
        "Unknown scope. Bob owns delivery. TBD. Нужно подготовить отчёт. Надо подумать. Это риск."
    )
    rows = spark.createDataFrame([(1, 1, 0, text), (1, 2, 1, "please share notes. There is a blocker.")], "meeting_id long, chunk_id long, ordinal long, text string")
    got = [(r.kind, r.ordinal, r.text) for r in entities.extract(rows).orderBy("kind", "ordinal").collect()]
    assert [x[2] for x in got if x[0] == "action_items"] == ["Please share notes.", "Can you send it?", "Bob owns delivery.", "Нужно подготовить отчёт."]
    assert [x[2] for x in got if x[0] == "open_questions"] == ["Open question: who will review?", "Unknown scope.", "TBD."]
    assert [x[2] for x in got if x[0] == "risks"] == ["Это риск.", "There is a blocker."]


def test_counts_of_entities_and_graph(memory):
    chunks, found = memory.chunks(), memory.index.table("entities")
    assert {r.kind: r.n for r in entities.counts(found).collect()} == {"decisions": 4, "action_items": 2, "risks": 2, "open_questions": 1}
    who = graph.people(chunks)
    assert graph.nodes(chunks, found, who).count() == 19
    assert {r.relation: r["count"] for r in graph.edges(chunks, found, who).groupBy("relation").count().collect()} == {"contains": 15, "mentions": 2, "originated_in": 9, "assigned_to": 2}


def test_refresh_is_incremental(spark, tmp_path):
    file = fill(tmp_path / "r.sqlite")
    index = Index(spark, str(tmp_path / "index"))
    run = lambda **k: index.refresh(recorder.read(spark, file), "r", now="2026-07-03T00:00:00Z", **k)
    a, b = run(), run()
    assert (a.meetings_inserted, a.chunks_inserted, b.meetings_inserted, b.meetings_updated, b.meetings_unchanged) == (2, 6, 0, 0, 2)
    db = sqlite3.connect(file)
    db.execute("update transcripts set transcript = 'Dobrynya decided to wait.' where id = 'transcript-2'")
    db.commit()
    c = run()
    assert (c.meetings_updated, c.meetings_unchanged, c.chunks_updated) == (1, 1, 3)
    assert index.table("chunks").count() == 6 and index.table("chunks").where("text like '%wait%'").count() == 1
    assert run(force=True).meetings_updated == 2
    db.execute("delete from meetings where id = 'meeting-1'")
    db.commit()
    assert run().meetings_seen == 1 and index.table("meetings").count() == 2
    run(prune=True)
    assert index.table("meetings").count() == 1 and index.table("entities").select("meeting_id").distinct().count() == 1
    assert index.runs().count() == 6 and sum(index.analyze().values()) == index.table("entities").count()
    index.vacuum()
    assert index.table("chunks").count() == 3


def test_unsupported_files(tmp_path):
    db = sqlite3.connect(tmp_path / "x.sqlite")
    db.execute("create table meetings (id text)")
    db.commit()
    assert recorder.inspect_schema(tmp_path / "x.sqlite") == (False, "recorder schema is unsupported: missing columns meetings.created_at, folder_path, title, updated_at")
    assert not recorder.can_open(tmp_path / "none.sqlite")
    with pytest.raises(FileNotFoundError):
        recorder.connect(tmp_path / "none.sqlite")
    assert recorder.discover(("app",), "x.sqlite", "REC_DB", {"REC_DB": str(tmp_path / "x.sqlite")}, tmp_path) == tmp_path / "x.sqlite"


def test_summary_texts(spark):
    from palaver.plans.normalize import language, summary_text

    raw = ['{"markdown": " ", "summary": "S"}', '{"a": 1}', '"text"', "plain words", "123", None, "", '{"markdown": 5, "MeetingName": "N"}']
    assert one(spark, summary_text("x"), *raw) == ["S", '{"a":1}', "text", "plain words", "123", None, None, "N"]
    assert one(spark, language("x"), '{"language":"ru"}', '{"language":5}', "[1]", "no", None) == ["ru", None, None, None, None]


def test_api_versions_and_ids(memory):
    v1 = memory.search("launch", 2).data["results"]
    assert set(v1[0]) == {*search.EVIDENCE, "rank"} and len(v1[0]) == 17
    v2 = memory.search("launch", 2, contract_version=api.V2).data["results"]
    assert set(v2[0]) == {"id", "meeting", "excerpt", "is_context"} and v2[0]["id"].startswith("evidence:")
    assert memory.resolve_search_hit(v2[0]["id"])["excerpt"]["text"] == v2[0]["excerpt"]["text"]
    with pytest.raises(LookupError):
        memory.resolve_search_hit("evidence:0")
    assert memory.evidence_at(str(memory.file), "meeting-1", "transcript-1")["ordinal"] == 0 and memory.evidence_at("x", "meeting-1", kind="note", ordinal=1) is None
    with pytest.raises(ValueError):
        memory.search("x", contract_version="3")
    small = memory.compact_search_hits("launch", 1, preview_length=6)[0]
    assert small["preview"] == "Launch…" and small["truncated"] and "excerpt" not in small


def test_evidence_ids_are_digests_of_canonical_json(spark):
    import hashlib

    rows = [("m\"1", "c-1", "note", 2, "t"), ("м-2", None, "note", 3, "text\n")]
    df = spark.createDataFrame(rows, "meeting_external_id string, chunk_external_id string, kind string, ordinal long, text string")
    for r, got in zip(rows, [x[0] for x in df.select(context.evidence_id(F.lit("u"))).collect()], strict=True):
        chunk = {"external_id": r[1]} if r[1] else {"kind": r[2], "ordinal": r[3], "content_fingerprint": hashlib.sha256(r[4].encode()).hexdigest()}
        body = json.dumps({"source_uuid": "u", "meeting_external_id": r[0], "chunk": chunk}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got == "evidence:" + hashlib.sha256(body.encode()).hexdigest()


def test_context(memory):
    r = memory.build_context("migration risks", 2, context=1)
    text = r.data["markdown"]
    assert text.startswith("# Question\n\nmigration risks\n\n# Relevant meetings\n\n## Meeting: Dobrynya Follow-up\n\nDate: 2026-07-02T09:30:00Z\nMeeting ID: meeting-2\n")
    assert "Source: meeting-2 / transcript-2\n> **Dobrynya | 09:10:00**: Dobrynya agreed" in text and "Evidence role: neighboring context" in text and text.endswith("# Question\n\nmigration risks\n")
    assert "No relevant excerpts found." in memory.build_context("zzz").data["markdown"]
    bundle = memory.build_context("migration risks", 2, api.V2).data
    assert {e["kind"] for e in bundle["entities"]} >= {"decision", "task", "risk"} and all(e["evidence_id"] in {h["id"] for h in bundle["evidence"]} for e in bundle["entities"])
    scoped = memory.build_meeting_context("launch", "meeting-1")
    assert scoped.kind == "meeting_context" and scoped.data["meeting"]["external_id"] == "meeting-1"
    with pytest.raises(ValueError):
        memory.build_meeting_context("x", "none")


def test_views(memory):
    assert [m["external_id"] for m in memory.meetings().data["meetings"]] == ["meeting-2", "meeting-1"] and memory.meetings().data["meetings"][0]["chunk_count"] == 3
    assert memory.latest_meeting("ALI").data["meeting"]["external_id"] == "meeting-1"
    assert memory.summary().data["stats"] == {"meetings": 2, "chunks": 6, "people": 2, "decisions": 4, "action_items": 2, "risks": 2, "open_questions": 1}
    assert [r["chunk_external_id"] for r in memory.timeline("migration RISKS").data["signals"]] and memory.timeline("nowhere").data["signals"] == []
    assert memory.project("migration risks").data["structured_signals"][0]["meeting_external_id"] == "meeting-2"
    assert memory.person("dobrynya").data["meetings"][0]["external_id"] == "meeting-2"
    assert len(memory.meeting_chunks(memory.get_meeting("meeting-1").data["meeting"]["meeting_id"]).data["chunks"]) == 3


def test_topics_tasks_and_vault(memory, tmp_path):
    got = memory.add_topic_alias("Migration", ["миграция", "move", "MOVE"]).data
    assert got["added_aliases"] == ["миграция", "move"] and memory.ensure_topic("Other", ["move"])["added_aliases"] == []
    topic = memory.topic("move").data
    assert topic["topic"]["title"] == "Migration" and topic["related_people"][0]["display_name"] == "Dobrynya"
    assert {r["chunk_external_id"] for r in topic["evidence"]} >= {"transcript-2", "transcript-4"} and topic["structured_signals"]
    text = memory.dossier("move")
    assert text.startswith("What we know: Migration\nalias: move\nalias: миграция\n\nSummary\nFound ") and "Possible risks\n- Dobrynya" in text and text.endswith("Related people\n- Dobrynya")
    assert memory.dossier("nothing here").split("\n")[3] == "No source-backed evidence found for this topic." and memory.dossier("move", language="ru").startswith("Что известно")
    asked = memory.ask_prompt("Who owns it?", topic="move")
    assert "Topic: Migration" in asked and "## Structured Signals" in asked and "# Relevant meetings" in asked
    graph_ = memory.graph("Migration").data
    assert {n["type"] for n in graph_["nodes"]} >= {"Topic", "Task", "Risk"} and any(e["relation"] == "belongs_to" for e in graph_["edges"])
    task = memory.structured_entities("action_items").data["entities"][0]
    assert task["status"] == "open"
    memory.set_task_status(task["entity_id"], "done", note="ok")
    assert [r["entity_id"] for r in memory.structured_entities("action_items", status="done").data["entities"]] == [task["entity_id"]]
    memory.refresh(memory.file, force=True)
    assert len(memory.structured_entities("action_items", status="done").data["entities"]) == 1
    for bad in (lambda: memory.set_task_status(task["entity_id"], "later"), lambda: memory.structured_entities("x"), lambda: memory.structured_entities("risks", status="later")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "Meetings").mkdir()
    (tmp_path / "Meetings" / "Launch Planning.md").write_text("mine")
    done = memory.sync_vault(str(tmp_path))
    assert done.files_skipped == 1 and (tmp_path / "Meetings" / "Launch Planning.md").read_text() == "mine"
    assert vault.MARKER in (tmp_path / "People" / "Dobrynya.md").read_text() and "- Status: `done`" in (next((tmp_path / "Tasks").glob(f"*{task['text'][:10]}*"))).read_text()


def test_rebind_keeps_ids_evidence_and_task_state(spark, tmp_path):
    m = api.Memory(spark, str(tmp_path / "store"))
    old, new, part, other = (fill(tmp_path / f"{n}.sqlite", meetings=1 if n == "part" else 2) for n in ("old", "new", "part", "other"))
    m.refresh(old)
    with sqlite3.connect(other) as db:
        db.execute("update meetings set id = 'other-' || id")
    evidence = m.search("migration risks", 1, contract_version=api.V2).data["results"][0]["id"]
    task = m.structured_entities("action_items").data["entities"][0]
    m.set_task_status(task["entity_id"], "done", note="survives move")
    uuid = m.register_source(old)
    with pytest.raises(ValueError):
        m.rebind(old, other)
    with pytest.raises(LookupError):
        m.rebind("nowhere", new)
    assert m.rebind(old, new) == 2 and m.register_source(new) == uuid
    again = m.refresh(new)
    assert (again.meetings_inserted, again.meetings_unchanged, m.chunks().count()) == (0, 2, 6)
    assert m.search("migration risks", 1, contract_version=api.V2).data["results"][0]["id"] == evidence
    row = next(r for r in m.structured_entities("action_items").data["entities"] if r["text"] == task["text"])
    assert (row["entity_id"], row["status"], row["status_note"]) == (task["entity_id"], "done", "survives move")
    assert [r.path for r in m.sources().collect()] == [str(new)]
    assert m.rebind(new, part) == 1


def test_segments_postings_and_pointers(spark, tmp_path, monkeypatch):
    """Searching the postings of many segments is searching the live rows; two refreshes at once do not both win."""
    file, m = fill(tmp_path / "r.sqlite"), api.Memory(spark, str(tmp_path / "store"))
    m.refresh(file)
    state = m.index._state()
    for n in range(3):
        with sqlite3.connect(file) as db:
            db.execute("update transcripts set transcript = ? where id = 'transcript-2'", (f"Dobrynya agreed to send foo_bar {n} migration risks.",))
        m.refresh(file)
    assert len(m.index._state()[1]) == 4 and m.chunks().count() == 6 and m.index.table("entities").select("meeting_id").distinct().count() == 2
    p = m.index.postings()
    for text in ("migration risks", "launch", "pricing decision", "foo_bar", "foo_bar risks", "zzz", "the of"):
        for mode in ("cascade", "any", "all"):
            want = [(r.chunk_id, round(r.rank, 9), r.stage) for r in search.ranked(m.chunks(), text, 5, mode=mode).orderBy("position").collect()]
            assert [(r.chunk_id, round(r.rank, 9), r.stage) for r in p.ranked(text, 5, mode=mode).orderBy("position").collect()] == want
    with pytest.raises(Exception, match="(?i)exist"):
        m.index._publish(state[0], ["x"])
    one = m.get_meeting("meeting-2").data["meeting"]["meeting_id"]
    assert m.analyze("meeting-2") == {r["kind"]: r["count"] for r in m.index.table("entities").where(F.col("meeting_id") == one).groupBy("kind").count().collect()} | {k: 0 for k in entities.KINDS if k == "open_questions"}
    with pytest.raises(LookupError):
        m.analyze("none")
    before = sorted(map(tuple, m.index.table("entities").collect()))
    m.index.compact()
    m.index.vacuum()
    assert len(m.index._state()[1]) == 1 and sorted(map(tuple, m.index.table("entities").collect())) == before
    one_bucket = m.index.postings()._of(["launch"])
    assert one_bucket.count() == 3 and "PartitionFilters: [isnotnull(bucket" in one_bucket._jdf.queryExecution().toString()
    stats = m.stats()
    assert (stats["sources"], stats["meetings"], stats["chunks"]) == (1, 2, 6) and stats["knowledge_nodes"] > 8 and stats["knowledge_edges"] > 8


def test_states_of_two_sources_do_not_double_rows_and_legacy_rows_are_reported(spark):
    task = lambda i, uuid, chunk="c": (i, "action_items", "m", chunk, "Do it", uuid)
    rows = spark.createDataFrame([task(1, "a"), task(2, "b"), task(3, ""), task(4, "a", None)], "entity_id long, kind string, meeting_external_id string, chunk_external_id string, text string, source_uuid string")
    import hashlib

    sha = hashlib.sha256(b"do it").hexdigest()
    states = spark.createDataFrame([(u, "m", "c", "task", sha, s, f"n{u}", None, False, "1") for u, s in (("a", "done"), ("b", "cancelled"))], state.SCHEMA)
    got = {r.entity_id: (r.state_status, r.status_note) for r in state.with_status(rows, states).collect()}
    assert got == {1: ("done", "na"), 2: ("cancelled", "nb"), 3: (None, None), 4: (None, None)}
    legacy = spark.createDataFrame([(1, "open", None), (2, "done", "x"), (3, "done", None), (4, "open", None), (9, "done", None)], "entity_id long, status string, note string")
    new, report = state.migrate_legacy(legacy, rows, states.where("source_uuid = 'b'"), "2")
    assert {r.reason: r.n for r in report.collect()} == {"migrated": 2, "missing_source": 1, "missing_chunk_id": 1, "missing_task": 1}
    live = {r.source_uuid: r.status for r in new.where("not orphaned").collect()}
    assert live == {"a": "open", "b": "cancelled"} and new.where("orphaned").count() == 3


def test_asking_a_model(memory):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked, answers = [], [b'{"response": "Dobrynya."}', b'{"x": 1}']

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answers[len(asked) - 1])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert memory.ask("Who owns migration risks?", "ollama", url=url) == "Dobrynya."
    path, body = asked[0]
    assert path == "/api/generate" and body["model"] == "llama3.1" and body["stream"] is False and "Question: Who owns" in body["prompt"]
    with pytest.raises(ValueError):
        memory.ask("x", "ollama", url=url)
    server.shutdown()
    server.server_close()
    with pytest.raises(chat.Unavailable):
        chat.ask("x", url=url, timeout=1)
    assert memory.ask("x").startswith("Answer the question")
    with pytest.raises(ValueError):
        memory.ask("x", "other")


def test_reports_are_compared(spark):
    task = lambda i, ok, n, crit=False: {"task_id": i, "class": "risk" if crit else "task", "critical": crit, "success": ok, "ndcg": n}
    a = evaluation.Report({"run_id": "1", "retrieval_mode": "x"}, {}, [task("a", True, 1.0, True), task("b", False, 0.0), task("c", True, 0.5)])
    b = evaluation.Report({"run_id": "2", "retrieval_mode": "y"}, {}, [task("a", False, 0.0, True), task("b", True, 0.5), task("c", True, 0.5)])
    with pytest.raises(ValueError):
        evaluation.compare_reports(spark, a, b)
    got = evaluation.compare_reports(spark, a, b, {"retrieval_mode"})
    assert got.counts == {"improvements": 1, "ties": 1, "regressions": 1} and got.by_class["risk"]["regressions"] == 1
    assert got.transitions == ["a: success -> failure", "b: failure -> success"] and got.critical_regressions == ["a"] and got.allowed_manifest_drift == ["retrieval_mode"]


def test_vectors(spark, memory):
    chunks = memory.chunks()
    p = vectors.HashProvider()
    a, b = p.embed_query(spark, "risk"), p.embed_query(spark, "blocker")
    assert sum(x * y for x, y in zip(a, b, strict=True)) == 0 and sum(x * x for x in a) == pytest.approx(1)
    assert vectors.hash_vector([]) == [1.0] + [0.0] * 127
    empty = spark.createDataFrame([], vectors.SCHEMA)
    stored = vectors.refresh(chunks, empty, p, p.provider, p.model, p.dims).cache()
    assert stored.count() == 6 and vectors.stale(chunks, stored, p.provider, p.model, p.dims).count() == 0
    fewer = vectors.refresh(chunks.where("ordinal < 2"), stored, p, p.provider, p.model, p.dims)
    assert fewer.count() == 4
    top = vectors.semantic_search(chunks, stored, p.embed_query(spark, "migration risks by Friday"), 2, p.provider, p.model).orderBy("position").collect()
    assert top[0].chunk_external_id == "transcript-2"
    with pytest.raises(ValueError):
        vectors.semantic_search(chunks, empty, a, 2, p.provider, p.model)
    assert memory.embed(p) == 6 and memory.embed(p) == 0
    hybrid = memory.hybrid(p)
    assert hybrid("migration risks", 2).orderBy("position").first().chunk_external_id == "transcript-2"
    assert t.RRF_K == 60


def test_providers():
    assert vectors.resolve_provider("Hash").provider == "hash" and vectors.resolve_provider(env={}, config={"provider": "local"}).provider == "hash"
    assert vectors.resolve_provider(env={"PALAVER_EMBEDDINGS": "ollama"}, config={"provider": "hash"}).dims == 768
    with pytest.raises(ValueError):
        vectors.resolve_provider("none", {})


def test_embedding_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    sizes = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            n = len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"])
            sizes.append(n)
            body = json.dumps({"embeddings": [[0.1, 0.2, 0.3]] * n}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = vectors.HttpProvider(f"http://127.0.0.1:{server.server_port}", "m", 3, batch=2)
    assert p.embed_query(spark, "x") == [0.2672612419124244, 0.5345224838248488, 0.8017837257372731]
    p.request(["a", "b"])
    server.shutdown()
    assert sizes == [1, 2]


def test_fusion_ties_prefer_the_lexical_rank(spark):
    rank = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], "evidence_id string, position int")
    got = vectors.fuse(rank("a", "b"), rank("c", "b"), None).orderBy("position").collect()
    assert [(r.evidence_id, r.lexical_rank, r.semantic_rank) for r in got] == [("b", 2, 2), ("a", 1, None), ("c", None, 1)]
    assert got[1].score == pytest.approx(1 / 61)


def test_evaluation(spark, memory, tmp_path):
    tasks = [
        {"id": "exact-pricing", "query": "pricing decision", "class": "exact_match", "critical": True, "critical_reason": "known", "expected": [{"evidence_id": "meeting-1/transcript-1", "relevance": 2}, {"evidence_id": "meeting-1/summary:meeting-1", "relevance": 1}]},
        {"id": "task-owner", "query": "Who owns migration risks?", "class": "task", "critical": False, "critical_reason": None, "expected": [{"evidence_id": "meeting-2/transcript-2", "relevance": 2}, {"evidence_id": "meeting-2/note:meeting-2", "relevance": 1}]},
    ]
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"schema_version": "recorder.eval.v1", "dataset_version": "1", "name": "n", "tasks": tasks}))
    strategy = lambda text, n: memory.search_frame(text, n).withColumn("evidence_id", evaluation.evaluation_id())
    report = evaluation.evaluate(spark, evaluation.load_dataset(spark, str(path)), strategy, 5)
    m = report.metrics
    assert [m[k] for k in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr", "source_accuracy", "median_source_openings", "empty_result_rate")] == [1, 1, 1, 1, 1, 1, 0]
    assert m["ndcg"] == pytest.approx(0.9131173286)
    manifest = evaluation.build_manifest(evaluation.load_dataset(spark, str(path)), memory.chunks(), 4, 5, context=0)
    assert set(evaluation.COMPATIBILITY) <= set(manifest) and evaluation.compatible(manifest, dict(manifest, run_id="x")) == []
    report.save(tmp_path / "r.json")
    assert evaluation.Report.load(tmp_path / "r.json").metrics == m
    with pytest.raises(ValueError):
        report.save(tmp_path / "r.json")
    path.write_text(json.dumps({"schema_version": "v0", "dataset_version": "1", "name": "n", "tasks": tasks}))
    with pytest.raises(ValueError):
        evaluation.load_dataset(spark, str(path))
    row = lambda i, ok, n, crit=False: (i, "risk" if crit else "task", crit, ok, n)
    frame = lambda *rows: spark.createDataFrame(rows, "task_id string, class string, critical boolean, success boolean, ndcg double")
    pairs = evaluation.paired(frame(row("a", True, 1.0), row("b", False, 0.0, True)), frame(row("a", True, 1.0), row("b", True, 0.5, True)))
    assert {r.task_id: (r.outcome, r.transition) for r in pairs.collect()} == {"a": ("tie", None), "b": ("improvement", "b: failure -> success")}
    with pytest.raises(ValueError):
        evaluation.paired(frame(row("a", True, 1.0)), frame(row("b", True, 1.0)))
    with pytest.raises(ValueError):
        evaluation.compatible({"retrieval_mode": "a"}, {"retrieval_mode": "b"})
    assert evaluation.compatible({"retrieval_mode": "a"}, {"retrieval_mode": "b"}, {"retrieval_mode"}) == ["retrieval_mode"]


def test_state_upsert_keeps_legacy_ids(spark):
    row = lambda status, at, legacy=None, orphan=False: ("u", "m", "c", "task", "s", status, None, legacy, orphan, at)
    f = lambda *rows: spark.createDataFrame(rows, state.SCHEMA)
    got = state.upsert(f(row("open", "1", 7), row("done", "0", 3, True)), f(row("done", "2"))).collect()
    assert sorted((r.status, r.legacy_id, r.orphaned) for r in got) == [("done", 3, True), ("done", 7, False)]


def test_streaming_refresh(spark, tmp_path):
    folder, index = tmp_path / "in", Index(spark, str(tmp_path / "index"))
    folder.mkdir()
    export = lambda text, at: json.dumps({"id": "m", "title": "T", "created_at": "1", "updated_at": at, "folder_path": None, "transcripts": [{"id": "t", "transcript": text, "timestamp": "1", "audio_start_time": 0.0, "audio_end_time": 1.0, "speaker": "A"}], "summary": None, "notes": {"notes_markdown": "We decided."}})
    (folder / "a.json").write_text(export("We agreed.", "1"))
    go = lambda: refresh.run_available(spark, str(folder), index, str(tmp_path / "cp"))
    go()
    go()
    assert index.table("chunks").count() == 2 and index.runs().count() == 1
    (folder / "b.json").write_text(export("We agreed to wait.", "2"))
    go()
    assert {r.text for r in index.table("chunks").collect()} == {"We agreed to wait.", "We decided."} and index.runs().count() == 2


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    settings.save(p, {"a": {"b": 1, "c": 2}})
    assert settings.update(p, {"a": {"b": 3, "c": None}, "d": "x"}) == settings.load(p) == {"a": {"b": 3}, "d": "x"}
    assert settings.resolve_language(None, "ru-RU", "en_US") == "ru" and settings.resolve_language("fr", None, None) == "en"


@pytest.mark.parametrize("hashed", ["sha_features", "hash_embed"])
def test_texts_of_one_file_are_hashed_in_several_tasks(spark, hashed):
    rows = spark.createDataFrame([(i, f"word{i} and more words") for i in range(40)], "chunk_id long, text string").coalesce(1)
    plan = getattr(vectors, hashed)(rows)._jdf.queryExecution().executedPlan().toString()
    # one shuffle, of texts: none of features follows
    assert plan.count("Exchange hashpartitioning(chunk_id") == plan.count("Exchange ") == 1


def test_tokens_of_postings_are_cut_once(spark):
    rows = spark.createDataFrame([(1, 1, "b a b"), (2, 2, None), (3, 3, " . ")], "chunk_id long, meeting_id long, text string")
    got = inverted.term_rows(rows, ("text",))
    assert sorted((r.term, r.chunk_id, r.tf, r.dl, tuple(r.pos)) for r in got.collect()) == [("a", 1, 1, 3, (1,)), ("b", 1, 2, 3, (0, 2))]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
