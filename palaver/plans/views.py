"""Registered queries of ingest, lookups, state, graph maintenance, memory views and renderers, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import querytext as qt
from ..functions import text as tx
from ..operators import context as ctx
from ..operators import entities as ent
from ..operators import evaluation as ev
from ..operators import graph, inverted, memory, search, state, vectors
from ..sources import corpora, recorder
from ..streaming.refresh import ingest, run_available
from . import normalize as norm
from .dossier import prompt
from .index import Index
from .log import Log
from .queries import _DIST, _DOCS, _ENTITIES, _EVENTS, _PLACED, _QUERY, _TURNS, _bm25, _tokens, _with, folder, indexed, kept, query, table_state

# ---- ingest -----------------------------------------------------------------------------------------------

_RECORDER = r"""
  one AS (SELECT DISTINCT conv_id, 'conv-' || conv_id AS mid FROM conversations),
  said AS (SELECT 'conv-' || conv_id AS mid, 'conv-' || conv_id || '-' || turn AS cid, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal,
             CASE WHEN turn % 7 = 3 THEN '' WHEN turn % 4 = 0 THEN trim(text) || chr(10) || chr(10) || 'end' ELSE trim(text) END AS text,
             CASE WHEN turn % 3 = 1 THEN NULL ELSE role END AS speaker, CASE WHEN turn > 0 THEN turn * 5.0 END AS starts FROM conversations),
  kept AS (SELECT * FROM said WHERE text <> ''),
  spoken AS (SELECT mid, count(*) AS n FROM kept GROUP BY mid),
  head AS (SELECT one.*, coalesce(n, 0) AS n, 'Conversation ' || conv_id AS title,
             CASE WHEN conv_id % 3 <> 0 THEN NULL WHEN conv_id % 9 = 0 THEN 'plain words' WHEN conv_id % 2 = 0 THEN '# Summary ' || conv_id ELSE 'Short ' || conv_id END AS summary,
             CASE WHEN conv_id % 3 <> 0 THEN NULL WHEN conv_id % 4 = 0 THEN 'ru' WHEN conv_id % 4 = 1 THEN NULL ELSE 'en' END AS language,
             CASE WHEN conv_id % 4 = 1 AND conv_id % 8 <> 5 THEN 'Note ' || conv_id || chr(10) || chr(10) || 'more' END AS note
           FROM one LEFT JOIN spoken USING (mid)),
  chunks AS (SELECT mid, cid, 'transcript' AS kind, ordinal, text, speaker, starts, '10:00' AS label FROM kept
    UNION ALL SELECT mid, 'summary:' || mid, 'summary', n, summary, NULL, NULL, NULL FROM head WHERE summary IS NOT NULL
    UNION ALL SELECT mid, 'note:' || mid, 'note', n + (summary IS NOT NULL)::INT, note, NULL, NULL, NULL FROM head WHERE note IS NOT NULL)"""


@query(_with(_RECORDER, r"SELECT c.mid AS meeting_external_id, cid AS chunk_external_id, kind, ordinal, text, speaker, starts::DOUBLE AS starts_at_seconds, label AS timestamp_label, len(regexp_extract_all(text, '\S+')) AS token_count, language FROM chunks c JOIN head USING (mid)"))
def normalize_chunks(spark, sf_dir):
    """Transcripts, summaries and notes of every meeting as chunks."""
    return norm.normalize(corpora.recorder_tables(spark, sf_dir), "r", "now")[1].select("meeting_external_id", "chunk_external_id", "kind", "ordinal", "text", "speaker", "starts_at_seconds", "timestamp_label", "token_count", "language")


@query(_with(_RECORDER, "SELECT mid AS external_id, title, '2026-01-02T03:04:05Z' AS created_at, CASE WHEN conv_id % 2 = 0 THEN '2026-03-02T03:04:05Z' END AS updated_at, language, summary AS summary_text FROM head"))
def normalize_meetings(spark, sf_dir):
    return norm.normalize(corpora.recorder_tables(spark, sf_dir), "r", "now")[0].select("external_id", "title", "created_at", "updated_at", "language", "summary_text")


@query("SELECT 'nation-' || n_nationkey AS id, 'Nation ' || n_name AS title, 'region-' || n_regionkey AS folder_path, n_nationkey AS rank FROM nation ORDER BY n_nationkey")
def recorder_scan(spark, sf_dir):
    """A recorder file written from a small table, checked, and scanned read-only in row-id ranges."""
    import sqlite3
    from pathlib import Path

    path = Path(folder(spark).removeprefix("file:"), "recorder.sqlite")
    path.parent.mkdir(parents=True)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows at any scale
    with sqlite3.connect(path) as db:
        for table, columns in recorder.REQUIRED.items():
            db.execute(f"create table {table} ({', '.join(f'{c} text' for c in columns)}{', rank integer' if table == 'meetings' else ''})")
        db.executemany("insert into meetings values (?, ?, '', '', ?, ?)", [(f"nation-{r.n_nationkey}", f"Nation {r.n_name}", f"region-{r.n_regionkey}", r.n_nationkey) for r in rows])
    db.close()
    assert recorder.can_open(path) and recorder.inspect_schema(path) == (True, None)
    return recorder.read(spark, path)["meetings"].select("id", "title", "folder_path", "rank")


@query(
    _with(
        _RECORDER,
        """SELECT 'first' AS run, (SELECT count(*) FROM head) AS inserted, 0::BIGINT AS updated, 0::BIGINT AS unchanged, (SELECT count(*) FROM chunks) AS live_chunks, (SELECT count(*) FROM head) AS live_meetings
        UNION ALL SELECT 'again', 0, 0, (SELECT count(*) FROM head), (SELECT count(*) FROM chunks), (SELECT count(*) FROM head)
        UNION ALL SELECT 'changed', 0, (SELECT count(*) FROM head WHERE conv_id % 5 = 1), (SELECT count(*) FROM head WHERE conv_id % 5 > 1), (SELECT count(*) FROM chunks JOIN head USING (mid) WHERE conv_id % 5 > 0), (SELECT count(*) FROM head WHERE conv_id % 5 > 0)""",
    )
)
def incremental_refresh(spark, sf_dir):
    """Three refreshes of one index: all meetings, nothing new, then some retitled and some gone."""
    tables, index, out = corpora.recorder_tables(spark, sf_dir), Index(spark, f"{folder(spark)}/index"), []
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    later = tables | {"meetings": tables["meetings"].where(number % 5 != 0).withColumn("title", F.when(number % 5 == 1, F.lit("New")).otherwise(F.col("title")))}
    for run, now in (("first", tables), ("again", tables), ("changed", later)):
        r = index.refresh(now, "r", prune=True)
        out.append((run, r.meetings_inserted, r.meetings_updated, r.meetings_unchanged, index.table("chunks").count(), index.table("meetings").count()))
    return spark.createDataFrame(out, "run string, inserted long, updated long, unchanged long, live_chunks long, live_meetings long")


_INDEXES: dict[tuple[str, str, str], Index] = {}


def stored(spark, sf_dir) -> Index:
    """An index of the recorder's tables with a history, made once a session and state of the table: every seventh
    meeting was there with another title and one more turn and is replaced, the others come in five refreshes."""
    key = (spark.sparkContext.applicationId, sf_dir, table_state(spark, f"{sf_dir}/conversations.parquet"))
    if key not in _INDEXES:
        tables, index = corpora.recorder_tables(spark, sf_dir), Index(spark, f"{folder(spark)}/index")
        number = lambda c: F.regexp_extract(c, r"^conv-(\d+)", 1).cast("long")
        of = {"meetings": "id", "transcripts": "meeting_id", "summary_processes": "meeting_id", "meeting_notes": "meeting_id"}
        some = lambda cond: {t: df.where(cond(number(of[t]))) for t, df in tables.items()}
        early = some(lambda n: n % 7 == 0)
        early["meetings"] = early["meetings"].withColumn("title", F.concat("title", F.lit(" draft")))
        extra = early["transcripts"].where(F.col("id").endswith("-0")).withColumns({"id": F.concat("id", F.lit("-x")), "transcript": F.lit("a turn that goes again")})
        early["transcripts"] = early["transcripts"].unionByName(extra)
        index.refresh(early, "r", source_uuid="u")
        for k in range(5):
            index.refresh(some(lambda n, k=k: n % 5 == k), "r", source_uuid="u")
        _INDEXES[key] = index
    return _INDEXES[key]


@query(_with(_RECORDER, f"SELECT t.term, count(*) AS df FROM (SELECT DISTINCT mid, cid, unnest(list_concat(list_concat({_tokens('title')}, {_tokens('text')}), {_tokens('speaker')})) AS term FROM chunks JOIN head USING (mid)) t GROUP BY 1"))
def index_term_counts(spark, sf_dir):
    """Chunks of each term in an index with replaced meetings, by the counts that are stored with its blocks."""
    heads = stored(spark, sf_dir).postings().parts
    return reduce(DataFrame.unionByName, [p.heads for p in heads]).groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0")


@query(
    _with(
        _RECORDER,
        """SELECT 'Meeting' AS type, title, 1::BIGINT AS support FROM head
        UNION ALL SELECT 'Chunk', concat(title, ' / ', kind, ' #', ordinal), 1 FROM chunks JOIN head USING (mid)
        UNION ALL SELECT 'Person', any_value(speaker), count(DISTINCT mid) FROM chunks WHERE speaker IS NOT NULL GROUP BY lower(speaker)""",
    )
)
def graph_stored_nodes(spark, sf_dir):
    """Nodes of a stored graph after a history of refreshes, with the number of meetings that support each."""
    return stored(spark, sf_dir).nodes().select("type", "title", "support")


@query(
    _with(
        _RECORDER,
        """SELECT mid AS meeting, 'contains' AS relation, concat(kind, ' #', ordinal) AS other, 1.0::DOUBLE AS confidence FROM chunks
        UNION ALL SELECT DISTINCT mid, 'mentions', lower(speaker), 0.8 FROM chunks WHERE speaker IS NOT NULL""",
    )
)
def graph_stored_edges(spark, sf_dir):
    """Edges of a stored graph after a history of refreshes, with their meetings and chunks by name."""
    index = stored(spark, sf_dir)
    names = index.table("meetings").select("meeting_id", F.col("external_id").alias("meeting"))
    places = index.table("chunks").select("meeting_id", "chunk_id", F.concat("kind", F.lit(" #"), F.col("ordinal").cast("string")).alias("place"))
    e = index.edges().join(names, "meeting_id").join(places, ["meeting_id", "chunk_id"], "left")
    return e.select("meeting", "relation", F.coalesce("place", F.substring_index("to_key", ":", -1)).alias("other"), "confidence")


@query(
    _with(
        _RECORDER,
        "SELECT mid AS external_id, title, (SELECT count(*) FROM chunks c WHERE c.mid = head.mid) AS n_chunks, 2::BIGINT AS batches, 0::BIGINT AS replayed FROM head",
    )
)
def stream_refresh(spark, sf_dir):
    """An index kept by a stream of nested exports: half of the meetings, then all of them with a late version of the
    first half, then the last batch once more, which changes nothing."""
    tables, base = corpora.recorder_tables(spark, sf_dir), folder(spark)
    said = tables["transcripts"].groupBy(F.col("meeting_id").alias("id")).agg(F.collect_list(F.struct("id", "transcript", "timestamp", "audio_start_time", "audio_end_time", "speaker")).alias("transcripts"))
    own = lambda t, name, cols: tables[t].select(F.col("meeting_id").alias("id"), F.struct(*cols).alias(name))
    every = tables["meetings"].join(said, "id", "left").join(own("summary_processes", "summary", ("result", "metadata")), "id", "left").join(own("meeting_notes", "notes", ("notes_markdown",)), "id", "left")
    index = Index(spark, f"{base}/index")
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    early = every.where(number % 2 == 0).withColumns({"title": F.concat("title", F.lit(" draft")), "updated_at": F.lit("2026-01-01T00:00:00Z")})
    for rows in (early, every):
        rows.write.mode("append").json(f"{base}/exports")
        run_available(spark, f"{base}/exports", index, f"{base}/checkpoint")
    last = index.batch("exports")
    again = ingest(index, "exports")(every, last)
    n = index.table("chunks").groupBy("meeting_id").agg(F.count("*").alias("n_chunks"))
    out = index.table("meetings").join(n, "meeting_id", "left")
    return out.select("external_id", "title", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(last + 1).cast("long").alias("batches"), F.lit(int(again is not None)).cast("long").alias("replayed"))


@query(_with(_RECORDER, "SELECT 'conv-' || conv_id AS external_id, 'moved' AS source_path, 1::BIGINT AS rows_of_meeting FROM head"))
def source_rebind(spark, sf_dir):
    """An index whose source has moved: the same meetings once, under the new path, after the next refresh."""
    tables, index = corpora.recorder_tables(spark, sf_dir), Index(spark, f"{folder(spark)}/index")
    index.refresh(tables, "old", source_uuid="u")
    index.rebind("old", "moved")
    index.refresh(tables, "moved", source_uuid="u")
    return index.table("meetings").groupBy("external_id", "source_path").agg(F.count("*").alias("rows_of_meeting"))


# ---- text -------------------------------------------------------------------------------------------------

_SPACED = "concat('  ', source, ' / ', lang, '? ', chr(9), substr(text, 1, 30), chr(13), chr(10), chr(13), chr(10), chr(10), ' end  ')"


@query(
    rf"""WITH d AS (SELECT doc_id, {_SPACED} AS x FROM documents)
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS normalized,
      trim(regexp_replace(replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ'), '\s+', ' ', 'g')) AS key, trim(regexp_replace(x, '[/\\:*?"<>|]', '_', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS note_name,
      substr('2026-05-0' || (doc_id % 9 + 1) || 'T01:02:03Z', 1, 10) AS day, len(regexp_extract_all(x, '\S+')) AS token_count FROM d"""
)
def text_forms(spark, sf_dir):
    """Normal form, key, note name, date and word count of a text with all kinds of blanks."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_SPACED.replace("chr(", "char(")).alias("x"))
    day = F.concat(F.lit("2026-05-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T01:02:03Z"))
    return d.select("doc_id", tx.normalize_text("x").alias("normalized"), tx.normalize_key("x").alias("key"), tx.safe_note_name("x").alias("note_name"), tx.compact_date(day).alias("day"), tx.token_count("x").alias("token_count"))


# ---- search -----------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(qt.STOPWORDS))
_WORDS = "regexp_extract_all(replace(replace(lower(array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ')), 'ß', 'ss'), 'ς', 'σ'), '[\\p{L}\\p{N}_]+')"
_ORDERS = """
  o AS (SELECT o_orderkey, o_custkey, substr(o_orderpriority, 1, 1) AS p, 'Clerk ' || (o_orderkey % 7) AS clerk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders),
  ot AS (SELECT *, CASE p WHEN '1' THEN clerk || ' agreed to send the contract. Есть риск задержки.' WHEN '2' THEN 'Решили подтвердить план миграции. Нужно подготовить отчёт!' WHEN '3' THEN 'Открытый вопрос: кто отвечает за миграцию? Надо подумать о сроках.'
      WHEN '4' THEN 'Моя задача - собрать данные. ' || clerk || ' owns the миграция list.' ELSE 'Просто Болтовня без дела.' END AS text,
      CASE WHEN o_orderkey % 5 > 0 THEN 'order-' || o_orderkey END AS cid, CASE WHEN o_custkey % 3 = 0 THEN 'ru' ELSE 'en-US' END AS lang, CASE WHEN o_custkey % 2 = 0 THEN '2026-02-01T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS day FROM o)"""
_ORDER_DOCS = f"SELECT o_orderkey AS chunk_id, o_custkey AS meeting_id, ord AS ordinal, list_concat(list_concat({_tokens(chr(39) + 'Customer ' + chr(39) + ' || o_custkey')}, {_tokens('text')}), {_tokens('clerk')}) AS tokens FROM ot"


@query(_with(f"{_ORDERS}, {_bm25(_ORDER_DOCS, ['миграция', 'миграции', 'миграцию', 'миграцией'])}", "SELECT row_number() OVER (ORDER BY rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank FROM scored WHERE n_terms > 0 ORDER BY rank, chunk_id LIMIT 25"))
def fts_case_variants(spark, sf_dir):
    """A Cyrillic noun finds its other case endings."""
    return search.ranked(corpora.orders(spark, sf_dir), "Миграция", 25).select("position", "chunk_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT lang, len(list_filter({_WORDS}, lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))) = 0 AS no_terms, count(*) AS n FROM documents GROUP BY 1, 2")
def fts_no_terms(spark, sf_dir):
    """How many texts, as queries, ask for nothing: their first two words are stop words or single letters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.col("doc_id").alias("query_id"), F.substring_index("text", " ", 2).alias("query"))
    terms = inverted.terms_of(d).select("query_id", (F.size("anyof") == 0).alias("no_terms"))
    return d.join(terms, "query_id").groupBy("lang", "no_terms").agg(F.count("*").alias("n"))


_HITS = f"""{_bm25(_TURNS, ["with", "from"], ", meeting_id, ordinal")},
  hits AS (SELECT *, row_number() OVER (ORDER BY (n_terms < 2)::INT, rank, chunk_id) AS position FROM scored WHERE n_terms > 0 ORDER BY (n_terms < 2)::INT, rank, chunk_id LIMIT 12),
  shown AS (SELECT h.*, c.conv_id, c.turn, c.role, c.text FROM hits h JOIN conversations c ON h.chunk_id = c.conv_id * 1000 + c.turn)"""


@query(_with(_HITS, "SELECT conv_id AS meeting_id, 'conversation-' || conv_id AS meeting_external_id, 'Conversation ' || conv_id AS title, NULL::VARCHAR AS created_at, NULL::VARCHAR AS updated_at, NULL::VARCHAR AS folder_path, NULL::VARCHAR AS language, chunk_id, 'turn-' || conv_id || '-' || turn AS chunk_external_id, 'transcript' AS kind, turn AS ordinal, text, role AS speaker, NULL::DOUBLE AS starts_at_seconds, NULL::DOUBLE AS ends_at_seconds, NULL::VARCHAR AS timestamp_label, round(rank, 6) AS rank FROM shown"))
def search_rows(spark, sf_dir):
    """Evidence rows, all 17 columns, found through stored postings."""
    chunks, index = indexed(spark, sf_dir, "conversations")
    return search.search(chunks, "with from", 12, postings=index).select(*search.EVIDENCE, F.round("rank", 6).alias("rank"))


_TURN_ID = """concat('evidence:', sha256(concat('{"chunk":{"external_id":"turn-', conv_id, '-', turn, '"},"meeting_external_id":"conversation-', conv_id, '","source_uuid":"corpus"}')))"""


@query(_with(_HITS, f"SELECT position, {_TURN_ID} AS id, 'corpus' AS source_uuid, 'conversation-' || conv_id AS external_id, 'path' AS source_path, 'turn-' || conv_id || '-' || turn AS chunk_external_id, turn AS ordinal, text, role AS speaker, false AS is_context FROM shown"))
def search_hits_nested(spark, sf_dir):
    """Nested hits of the second contract, flattened."""
    chunks, index = indexed(spark, sf_dir, "conversations")
    n = ctx.nested(search.search(chunks, "with from", 12, postings=index), F.lit("corpus"), F.lit("path"))
    return n.select("position", "id", "meeting.source_uuid", "meeting.external_id", "meeting.source_path", "excerpt.chunk_external_id", "excerpt.ordinal", "excerpt.text", "excerpt.speaker", "is_context")


@query(_with(_HITS, f"SELECT position, {_TURN_ID} AS id, CASE WHEN length(text) > 40 THEN concat(regexp_replace(substr(text, 1, 40), '\\s+$', ''), '…') ELSE text END AS preview, length(text) > 40 AS truncated, 40 AS preview_length FROM shown"))
def search_hits_compact(spark, sf_dir):
    chunks, index = indexed(spark, sf_dir, "conversations")
    n = ctx.nested(search.search(chunks, "with from", 12, postings=index), F.lit("corpus"), F.lit("path"))
    return ctx.compact(n, 40).select("position", "id", "preview", "truncated", "preview_length")


_EVIDENCE = """concat('evidence:', sha256(concat('{"chunk":{"external_id":"', cid, '"},"meeting_external_id":"', mid, '","source_uuid":"u"}')))"""


@query(_with(_RECORDER, f"SELECT {_EVIDENCE} AS id, mid AS meeting_external_id, cid AS chunk_external_id, text FROM chunks"))
def evidence_lookup(spark, sf_dir):
    """Every chunk of a stored index by its public id: the ids' own table, then the clustered chunks by their place."""
    index = stored(spark, sf_dir)
    found = index.table("evidence").join(index.table("chunks"), ["meeting_id", "chunk_id"])
    return found.select(F.col("evidence_id").alias("id"), "meeting_external_id", "chunk_external_id", "text")


@query(_with(f"r AS ({_TURNS})", "SELECT DISTINCT r.meeting_id FROM r JOIN conversations c ON c.conv_id * 1000 + c.turn = r.chunk_id WHERE contains(lower(role), 'system') OR list_contains(tokens, 'system')"))
def person_meetings_by_name(spark, sf_dir):
    """Meetings in which a person speaks or is mentioned: the union of two id sets."""
    return memory.person_meetings(corpora.conversations(spark, sf_dir), "System")


@query(_with(_bm25(_DOCS, ["with", "from"]), "SELECT doc_id AS evidence_id, n_terms FROM scored JOIN documents ON doc_id = chunk_id WHERE n_terms > 0"))
def fts_term_frequencies(spark, sf_dir):
    """How many of the terms a chunk has, counted inside its row."""
    rows = search.with_frequencies(search.tokenized(corpora.documents(spark, sf_dir)), ["with", "from"])
    n = F.size(F.filter("tf", lambda x: x > 0))
    return rows.where(n > 0).select(F.col("chunk_id").alias("evidence_id"), n.alias("n_terms"))


# ---- entities and state -----------------------------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"
_RU_ENTITIES = rf"""{_ORDERS},
  rcut AS (SELECT o_orderkey, o_custkey, ord, day, clerk, string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(10)), 'g'), chr(10)) AS parts FROM ot),
  rsent AS (SELECT * EXCLUDE (parts), unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS place FROM rcut),
  rkinds(kind_index, kind) AS (VALUES (0, 'decisions'), (1, 'action_items'), (2, 'risks'), (3, 'open_questions')),
  rhit AS (SELECT s.*, k.* FROM rsent s, rkinds k WHERE CASE kind
     WHEN 'decisions' THEN regexp_matches(text, '(?i)\b(decision|decided|agreed|approved|confirmed|resolved)\b|(решили|решение|согласовали|утвердили|подтвердил|подтвердили|подтвержден)')
     WHEN 'risks' THEN regexp_matches(text, '(?i)\b(risk|risks|blocker|blocked|issue|concern|dependency)\b|(риск|риски|блокер|проблема|зависимость)')
     WHEN 'open_questions' THEN regexp_matches(text, '(?i)\b(open question|unknown|clarify|tbd)\b|(открытый вопрос|уточнить|неясно|непонятно|под вопросом)')
     ELSE NOT regexp_matches(text, '(?i)\b(open question|unknown|clarify|tbd)\b|(открытый вопрос|уточнить|неясно|непонятно|под вопросом)')
      AND NOT regexp_matches(text, '(?i)(надо|нужно)\s+(подумать|понять|разобраться)|должен\s+будет|\b(should|need to|needs to)\s+(think|understand|figure out)\b')
      AND regexp_matches(text, '(?i)\b(action item|todo|to do|follow up)\b|\b(agreed to|owns|owner)\s+{_W}+|\b(send|prepare|share|write|create|update|review|check|clarify)\b|(отправить|подготовить|написать|создать|обновить|доработать|проверить|уточнить|согласовать|прислать|скинуть|собрать|изучить|оценить)|(нужно|надо)\s+{_W}*(подготов|сдел|отправ|напис|созд|обнов|доработ|провер|уточн|изуч|оцен)|моя задача\s+(?:[-—:]\s*)?(?:это\s+)?{_W}+|мне нужно время,?\s+чтобы\s+{_W}+') END),
  ronce AS (SELECT * FROM rhit QUALIFY row_number() OVER (PARTITION BY o_custkey, kind, lower(text) ORDER BY ord, o_orderkey, place) = 1),
  rent AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY ord, o_orderkey, place) - 1 AS ordinal FROM ronce)"""


@query(_with(_RU_ENTITIES, "SELECT kind, o_custkey AS meeting_id, o_orderkey AS source_chunk_id, ordinal, text FROM rent"))
def entities_two_languages(spark, sf_dir):
    """Decisions, tasks, risks and questions in English and Russian sentences."""
    return ent.extract(corpora.orders(spark, sf_dir)).select("kind", "meeting_id", "source_chunk_id", "ordinal", "text")


@query(_with(_RU_ENTITIES, ", who AS (SELECT DISTINCT o_custkey, clerk FROM ot) SELECT DISTINCT o_custkey AS meeting_id, e.o_orderkey AS chunk_id, e.text, 'person:' || lower(w.clerk) AS to_key, 0.7::DOUBLE AS confidence FROM rent e JOIN who w USING (o_custkey) WHERE kind = 'action_items' AND contains(lower(e.text), lower(w.clerk))"))
def graph_assignees(spark, sf_dir):
    """Tasks that name a person of their meeting are assigned to them."""
    chunks = kept(spark, corpora.orders(spark, sf_dir))
    found = kept(spark, ent.extract(chunks))
    e = graph.edges(chunks, found, graph.people(chunks)).where("relation = 'assigned_to'")
    return e.join(found.select(F.concat("kind", F.lit(":"), F.col("entity_id").cast("string")).alias("from_key"), "text"), "from_key").select("meeting_id", "chunk_id", "text", "to_key", "confidence")


def _task_states(spark, sf_dir):
    chunks = corpora.events(spark, sf_dir)
    found = ent.extract(chunks)
    keys = state.identity(ent.details(found, chunks).where("kind = 'action_items'"))
    status = F.when(F.col("source_chunk_id") % 3 == 0, "done").when(F.col("source_chunk_id") % 3 == 1, "cancelled")
    rows = keys.select("source_uuid", "meeting_external_id", "chunk_external_id", F.lit("task").alias("kind"), "text_sha", status.alias("status"), F.concat(F.lit("note "), F.col("source_chunk_id").cast("string")).alias("note"), F.lit(None).cast("long").alias("legacy_id"), F.lit(False).alias("orphaned"), F.lit("1").alias("updated_at")).where("status is not null")
    # a second source's states for the same tasks must not double them
    return chunks, found, rows.unionByName(rows.withColumn("source_uuid", F.lit("another")).withColumn("status", F.lit("open")))


@query(_with(_ENTITIES, "SELECT user_id AS meeting_id, event_id AS source_chunk_id, text, 'done' AS status, 'note ' || event_id AS status_note FROM ent WHERE kind = 'action_items' AND event_id % 3 = 0 ORDER BY meeting_date DESC, ordinal, event_id LIMIT 30"))
def task_status_filter(spark, sf_dir):
    """The newest done tasks with the user's notes; the status is filtered before the limit."""
    chunks, found, states = _task_states(spark, sf_dir)
    rows = ent.details(found, chunks, states).withColumn("entity_id", F.col("source_chunk_id"))
    return ent.latest(rows, "action_items", 30, "done").select("meeting_id", "source_chunk_id", "text", "status", "status_note")


@query("SELECT e_type AS kind, n_live, n_orphans, last_status FROM (SELECT event_type AS e_type, count(DISTINCT user_id) AS n_live, count(*) FILTER (event_id % 11 = 0) AS n_orphans, 'done' AS last_status FROM events GROUP BY 1)")
def state_upsert(spark, sf_dir):
    """States merged by identity: the newest status stays, orphans are kept as they are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = lambda status, at, orphan: (F.lit("u").alias("source_uuid"), F.col("user_id").cast("string").alias("meeting_external_id"), F.lit("c").alias("chunk_external_id"), F.lit("task").alias("kind"), F.col("event_type").alias("text_sha"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("long").alias("legacy_id"), F.lit(orphan).alias("orphaned"), F.lit(at).alias("updated_at"))
    old, new = e.select(*row("open", "1", False)).distinct(), e.select(*row("done", "2", False)).distinct()
    both = state.upsert(old.unionByName(e.where("event_id % 11 = 0").select(*row("open", "0", True))), new)
    live = ~F.col("orphaned")
    return both.groupBy(F.col("text_sha").alias("kind")).agg(F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_orphans"), F.max(F.when(live, F.col("status"))).alias("last_status"))


@query("SELECT 'event-' || event_id AS chunk_external_id, CASE WHEN event_id % 3 = 0 THEN 'cancelled' WHEN event_id % 2 = 0 THEN 'done' ELSE 'open' END AS status, CASE WHEN event_id % 3 = 0 THEN 'third' WHEN event_id % 2 = 0 THEN 'second' END AS note, event_id AS legacy_id FROM events WHERE event_type = 'signup' AND event_id % 7 <> 1")
def state_log(spark, sf_dir):
    """States of tasks after five changes, folded in between: the newest of each task, without those taken back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")

    def change(cond: str, status: str, note: str | None, legacy: bool = False):
        return e.where(cond).select(
            F.lit("u").alias("source_uuid"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("meeting_external_id"), F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("chunk_external_id"), F.lit("task").alias("kind"), F.lit("s").alias("text_sha"),
            F.lit(status).alias("status"), F.lit(note).cast("string").alias("note"), (F.col("event_id") if legacy else F.lit(None)).cast("long").alias("legacy_id"), F.lit(False).alias("orphaned"), F.lit("t").alias("updated_at"),
        )

    log = Log(spark, f"{folder(spark)}/states", state.SCHEMA, state.KEY, loose="orphaned")
    log.append(change("true", "open", None, True))
    log.append(change("event_id % 2 = 0", "done", "second"))
    log.fold()
    log.append(change("event_id % 3 = 0", "cancelled", "third"))
    log.append(change("event_id % 7 = 1", "open", None), deleted=F.lit(True))
    return log.read().select("chunk_external_id", "status", "note", "legacy_id")


@query(_with(_ENTITIES, "SELECT CASE WHEN event_id % 4 = 0 THEN 'missing_task' WHEN event_id % 4 = 1 THEN 'missing_source' WHEN event_id % 4 = 2 THEN 'missing_chunk_id' ELSE 'migrated' END AS reason, count(*) AS n FROM ent WHERE kind = 'action_items' GROUP BY 1"))
def state_migration(spark, sf_dir):
    """Task states of an older index: how many are carried over, and why others are not."""
    chunks = corpora.events(spark, sf_dir)
    tasks = ent.details(ent.extract(chunks), chunks).where("kind = 'action_items'").withColumn("entity_id", F.col("source_chunk_id"))
    k = F.col("entity_id") % 4
    known = tasks.where(k != 0).withColumns({"source_uuid": F.when(k == 1, F.lit("")).otherwise(F.lit("u")), "chunk_external_id": F.when(k != 2, F.col("chunk_external_id"))})
    legacy = tasks.select("entity_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("note"))
    return state.migrate_legacy(legacy, known, spark.createDataFrame([], state.SCHEMA), "now")[1]


@query(_with(_ENTITIES, ", hits AS (SELECT event_id FROM ev WHERE event_id % 50 = 7) SELECT kind, event_id AS source_chunk_id, text FROM ent JOIN hits USING (event_id)"))
def entities_of_hits(spark, sf_dir):
    """Entities whose chunk is among the hits."""
    chunks = corpora.events(spark, sf_dir)
    return ent.of_hits(ent.details(ent.extract(chunks), chunks), chunks.where("chunk_id % 50 = 7")).select("kind", "source_chunk_id", "text")


# ---- graph and topics -------------------------------------------------------------------------------------

@query("SELECT 'Nation' AS type, 'nation:' || n_nationkey AS stable_key, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS title, '1' AS created_at, CASE WHEN n_nationkey % 2 = 0 THEN '2' ELSE '1' END AS updated_at FROM nation")
def graph_node_upsert(spark, sf_dir):
    """Nodes by type and key: the new title, the first creation."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    row = lambda title, at: (F.lit("Nation").alias("type"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("stable_key"), title.alias("title"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))
    return graph.upsert_nodes(n.select(*row(F.col("n_name"), "1")), n.where("n_nationkey % 2 = 0").select(*row(F.concat(F.lit("new "), "n_name"), "2")))


@query("SELECT 'meeting:' || user_id AS from_key, 'contains' AS relation, 'chunk:' || event_id AS to_key, user_id AS meeting_id, event_id AS chunk_id, 'scan' AS extraction_method, CASE WHEN event_id % 3 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM events WHERE user_id % 10 <> 4")
def graph_edge_upsert(spark, sf_dir):
    """Edges by ends, relation and evidence: the new confidence; the edges of deleted meetings go."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = lambda c: (F.concat(F.lit("meeting:"), F.col("user_id").cast("string")).alias("from_key"), F.lit("contains").alias("relation"), F.concat(F.lit("chunk:"), F.col("event_id").cast("string")).alias("to_key"), F.col("user_id").alias("meeting_id"), F.col("event_id").alias("chunk_id"), F.lit("scan").alias("extraction_method"), F.lit(c).alias("confidence"))
    both = graph.upsert_edges(e.select(*row(1.0)), e.where("event_id % 3 = 0").select(*row(0.9)))
    return graph.without_meetings(both, e.where("user_id % 10 = 4").select(F.col("user_id").alias("meeting_id")).distinct())


@query("SELECT 'topic:' || lower(r_name) AS topic_key, r_name AS title, string_agg(n_name, ',' ORDER BY n_name) AS aliases FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey ORDER BY r_regionkey DESC LIMIT 4")
def topics_listed(spark, sf_dir):
    """Topics with their aliases, newest first."""
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    key = F.concat(F.lit("topic:"), F.lower("r_name"))
    topics = r.select(key.alias("topic_key"), F.col("r_name").alias("title"), F.lit("0").alias("created_at"), F.col("r_regionkey").cast("string").alias("updated_at"))
    aliases = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("topic_key"), F.col("n_name").alias("alias"), F.lower("n_name").alias("normalized_alias"))
    return graph.list_topics(topics, aliases, 4).select("topic_key", "title", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT n_name AS asked, 'topic:' || lower(r_name) AS topic_key FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'topic:' || lower(r_name) FROM region")
def topic_resolution(spark, sf_dir):
    """Every name that a topic is known by, its title or an alias, leads to its key."""
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    key = F.concat(F.lit("topic:"), F.lower("r_name"))
    topics = r.select(key.alias("topic_key"), F.col("r_name").alias("title"), F.lit("0").alias("created_at"), F.lit("0").alias("updated_at"))
    aliases = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("topic_key"), F.col("n_name").alias("alias"), F.lower("n_name").alias("normalized_alias")).cache()
    names = [x[0] for x in n.select("n_name").union(r.select("r_name")).collect()]  # 30 names at any scale
    return spark.createDataFrame([(name, graph.resolve_topic(topics, aliases, f"  {name} ")) for name in names], "asked string, topic_key string")


_LINKS = f"""{_PLACED},
  linked AS (SELECT * FROM top WHERE place_in_kind <= 500 AND contains(lower(concat_ws(' ', text, 'User ' || user_id, 'user-' || user_id, 'event-' || event_id, 'speaker ' || event_id % 5)), 'outage')),
  fp AS (SELECT *, sha256(concat(kind, chr(0), event_id, chr(0), lower(text))) AS fp FROM linked)"""


@query(_with(_LINKS, "SELECT count(*) AS n_edges, 0.7::DOUBLE AS confidence, 'topic:outage' AS to_key, count(DISTINCT user_id) AS n_meetings FROM fp"))
def topic_edges(spark, sf_dir):
    """belongs_to edges of a topic."""
    chunks = corpora.events(spark, sf_dir)
    found = ent.extract(chunks).withColumn("entity_id", F.col("source_chunk_id"))
    e = graph.topic_edges(graph.topic_links(ent.details(found, chunks), ["outage"]), graph.topic_key("Outage"))
    return e.groupBy("to_key").agg(F.count("*").alias("n_edges"), F.max("confidence").alias("confidence"), F.count_distinct("meeting_id").alias("n_meetings"))


_EDGE_CTES = f"""{_ENTITIES},
  ekey AS (SELECT *, kind || ':' || user_id || '-' || kind_index || '-' || ordinal AS k FROM ent),
  alle AS (SELECT 'meeting:' || user_id AS f, 'contains' AS relation, 'chunk:' || event_id AS t, 'scan' AS m FROM ev
    UNION ALL SELECT DISTINCT 'meeting:' || user_id, 'mentions', 'person:speaker ' || (event_id % 5), 'speaker' FROM ev
    UNION ALL SELECT 'meeting:' || user_id, 'contains', k, kind FROM ekey UNION ALL SELECT k, 'originated_in', 'chunk:' || event_id, kind FROM ekey),
  own AS (SELECT k AS f, 'belongs_to' AS relation, 'topic:x' AS t, 'topic_query' AS m FROM ekey WHERE kind = 'risks' ORDER BY relation, f, t, m LIMIT 40),
  touch AS (SELECT a.* FROM alle a WHERE a.f IN (SELECT f FROM own) OR a.t IN (SELECT f FROM own) ORDER BY relation, f, t, m LIMIT 40),
  found AS (SELECT DISTINCT * FROM (SELECT * FROM own UNION ALL SELECT * FROM touch) ORDER BY relation, f, t, m LIMIT 40)"""


#: The same without a limit.
_ALL_EDGE_CTES = _EDGE_CTES.replace(" ORDER BY relation, f, t, m LIMIT 40", "")


def _neighbourhood(spark, sf_dir, limit=40):
    chunks = kept(spark, corpora.events(spark, sf_dir))
    found = kept(spark, ent.extract(chunks)).withColumn("entity_id", F.concat_ws("-", "meeting_id", ent.kind_index(), "ordinal"))
    who = graph.people(chunks)
    own = found.where("kind = 'risks'").select(F.concat("kind", F.lit(":"), "entity_id").alias("from_key"), F.lit("belongs_to").alias("relation"), F.lit("topic:x").alias("to_key"), F.lit(0.7).alias("confidence"), "meeting_id", F.col("source_chunk_id").cast("long").alias("chunk_id"), F.lit("topic_query").alias("extraction_method"))
    return graph.subgraph(graph.nodes(chunks, found, who), graph.edges(chunks, found, who), own, "topic:x", "X", limit)


@query(_with(_EDGE_CTES, "SELECT f AS from_key, relation, t AS to_key, m AS extraction_method FROM found"))
def graph_subgraph_edges(spark, sf_dir):
    """What touches the entities of a topic, within a limit."""
    return _neighbourhood(spark, sf_dir)[1].select("from_key", "relation", "to_key", "extraction_method")


@query(_with(_ALL_EDGE_CTES, ", ends AS (SELECT f AS k FROM found UNION SELECT t FROM found) SELECT k AS stable_key, CASE WHEN k LIKE 'topic:%' THEN 'Topic' WHEN k LIKE 'meeting:%' THEN 'Meeting' WHEN k LIKE 'chunk:%' THEN 'Chunk' WHEN k LIKE 'risks:%' THEN 'Risk' ELSE 'other' END AS type FROM ends"))
def graph_subgraph_nodes(spark, sf_dir):
    """All nodes within two steps of a topic."""
    return _neighbourhood(spark, sf_dir, None)[0].select("stable_key", "type")


@query(_with(_ENTITIES, "SELECT 1::BIGINT AS sources, (SELECT count(DISTINCT user_id) FROM ev) AS meetings, (SELECT count(*) FROM ev) AS chunks, count(*) AS structured_entities, count(*) + (SELECT count(DISTINCT user_id) + count(*) + count(DISTINCT event_id % 5) FROM ev) AS knowledge_nodes, 2 * count(*) + (SELECT count(*) + count(DISTINCT concat(user_id, '-', event_id % 5)) FROM ev) AS knowledge_edges FROM ent"))
def index_counts(spark, sf_dir):
    """Counts of sources, meetings, chunks, entities, and of nodes and edges of the graph."""
    chunks = kept(spark, corpora.events(spark, sf_dir))
    return memory.index_counts(spark.range(1), corpora.meetings_of(chunks), chunks, kept(spark, ent.extract(chunks)))


# ---- memory views -----------------------------------------------------------------------------------------

_EV_DOCS = f"SELECT event_id AS chunk_id, user_id AS meeting_id, ord AS ordinal, list_concat(list_concat({_tokens(chr(39) + 'User ' + chr(39) + ' || user_id')}, {_tokens('text')}), {_tokens(chr(39) + 'speaker ' + chr(39) + ' || event_id % 5')}) AS tokens FROM ev"
_HAY = "lower(concat_ws(' ', text, 'User ' || user_id, 'user-' || user_id, 'event-' || event_id, 'speaker ' || event_id % 5))"


def _merged(limit: int) -> str:
    return f"merged AS (SELECT *, row_number() OVER (ORDER BY meeting_date DESC, ordinal, kind_index, place_in_kind) AS position FROM top WHERE place_in_kind <= {limit})"


@query(
    _with(
        f"{_PLACED}, {_bm25(_EV_DOCS, ['welcome', 'pack'], ', meeting_id, ordinal')}, hits AS (SELECT * FROM scored WHERE n_terms > 0 ORDER BY (n_terms < 2)::INT, rank, chunk_id LIMIT 10), {_merged(40)}",
        f"SELECT kind, user_id AS meeting_id, event_id AS source_chunk_id, text FROM merged WHERE user_id IN (SELECT meeting_id FROM hits) OR contains({_HAY}, 'welcome') AND contains({_HAY}, 'pack') ORDER BY position LIMIT 10",
    )
)
def project_signals(spark, sf_dir):
    """The newest entities in the meetings that a query finds, or holding all its terms."""
    chunks = corpora.events(spark, sf_dir)
    details = ent.details(ent.extract(chunks).withColumn("entity_id", F.col("source_chunk_id")), chunks)
    return memory.project(chunks, details, "welcome pack", 10)[1].select("kind", "meeting_id", "source_chunk_id", "text")


@query(_with(_EVENTS, ", m AS (SELECT user_id, max(latest) AS latest FROM ev GROUP BY 1) SELECT user_id AS meeting_id, strftime(latest, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM m WHERE user_id IN (SELECT user_id FROM ev WHERE regexp_matches(lower(concat_ws(' ', 'User ' || user_id, text, 'speaker ' || event_id % 5)), '\\bincident\\b')) ORDER BY created_at DESC, meeting_id LIMIT 10"))
def person_view(spark, sf_dir):
    """A person's newest meetings: here of a name that is only mentioned."""
    chunks = corpora.events(spark, sf_dir)
    details = ent.details(ent.extract(chunks), chunks)
    return memory.person(corpora.meetings_of(chunks), chunks, details, "incident", 10)[0].select("meeting_id", "created_at")


@query(_with(f"{_PLACED}, {_merged(80)}", "SELECT position, kind, event_id AS source_chunk_id FROM merged ORDER BY position LIMIT 20"))
def timeline_newest(spark, sf_dir):
    """The newest entities of all kinds."""
    chunks = corpora.events(spark, sf_dir)
    details = ent.details(ent.extract(chunks).withColumn("entity_id", F.col("source_chunk_id")), chunks)
    return ent.timeline(details, None, 20).select("position", "kind", "source_chunk_id")


@query(_with(_HITS, "SELECT concat('# Question', chr(10), chr(10), 'with from', chr(10)) AS head, count(*) AS n_excerpts, count(DISTINCT conv_id) AS n_meetings, true AS names_all FROM shown"))
def context_bundle(spark, sf_dir):
    """The context document: its head, and one excerpt a hit under its meeting."""
    chunks, index = indexed(spark, sf_dir, "conversations")
    groups = ctx.grouped(search.search(chunks, "with from", 12, postings=index)).collect()  # at most 12 hits
    text = ctx.markdown("with from", groups)
    return spark.createDataFrame([("\n".join(text.split("\n")[:3]) + "\n", text.count("\nSource: "), text.count("\n## Meeting: "), all(g["meeting_external_id"] in text for g in groups))], "head string, n_excerpts long, n_meetings long, names_all boolean")


@query(
    """WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_name FROM supplier ORDER BY s_suppkey LIMIT 20)
    SELECT concat('Answer the question using only the source-backed context below.', chr(10), 'If the context is insufficient, say what is missing.', chr(10), chr(10), 'Question: Who?', chr(10), 'Meeting: m', chr(10), 'Topic: T', chr(10), chr(10),
      '# Topic Memory', chr(10), chr(10), 'Topic: T', chr(10), chr(10), '## Meetings', chr(10), (SELECT string_agg(concat('- ', s_name, ' [id-', n, ']'), chr(10) ORDER BY n) FROM s WHERE n <= 10), chr(10), chr(10),
      '## Structured Signals', chr(10), (SELECT string_agg(concat('- risks: ', s_name, ' (Source: m-', n, ' / ', n, ')'), chr(10) ORDER BY n) FROM s), chr(10), chr(10), '## People', chr(10), (SELECT string_agg(concat('- ', s_name), chr(10) ORDER BY n) FROM s), chr(10), chr(10), 'context', chr(10)) AS prompt"""
)
def ask_prompt(spark, sf_dir):
    """The prompt of a question about a topic, within its limits."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").limit(30).collect()  # more than the prompt shows
    topic = {
        "topic": {"title": "T", "aliases": []},
        "meetings": [{"title": r.s_name, "meeting_external_id": f"id-{n}"} for n, r in enumerate(rows, 1)],
        "structured_signals": [{"kind": "risks", "text": r.s_name, "meeting_external_id": f"m-{n}", "chunk_external_id": None, "source_chunk_id": n} for n, r in enumerate(rows, 1)],
        "related_people": [{"display_name": r.s_name} for r in rows],
    }
    return spark.createDataFrame([(prompt("Who?", "context", "m", topic),)], "prompt string")


# ---- vectors ----------------------------------------------------------------------------------------------

@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE * 3, 2))), 5) AS before, 1.0::DOUBLE AS after FROM embeddings")
def vectors_normalized(spark, sf_dir):
    """Vectors brought to length one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return e.select("vec_id", F.round(F.pow(tx.norm("v"), 2), 5).alias("before"), F.round(tx.norm(tx.normalized("v")), 9).alias("after"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 4 = 0 OR vec_id % 7 = 0 THEN 'new' ELSE 'kept' END AS how FROM embeddings WHERE vec_id % 9 <> 0")
def embeddings_refresh(spark, sf_dir):
    """The embedding table brought up to date: stale rows anew, rows of gone chunks dropped."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = F.col("vec_id").cast("string")
    chunks = e.where("vec_id % 9 <> 0").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("f"), s).alias("fingerprint"))
    print_ = F.when(F.col("vec_id") % 7 == 0, F.lit("old")).otherwise(F.concat(F.lit("f"), s))
    stored = e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("chunk_id"), F.lit("hash").alias("provider"), F.lit("m").alias("model"), F.lit(64).alias("dims"), print_.alias("chunk_fingerprint"), F.col("embedding").alias("vector"))
    embed = lambda todo: todo.select("chunk_id", F.array(F.lit(-9.0).cast("float")).alias("vector"))
    out = vectors.refresh(chunks, stored, embed, "hash", "m", 64)
    return out.select("chunk_id", F.when(F.size("vector") == 1, "new").otherwise("kept").alias("how"))


@query("SELECT count(*) FILTER (vec_id % 4 <> 0) AS n FROM embeddings")
def embeddings_count(spark, sf_dir):
    """Embeddings of one provider, model and size."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = F.when(F.col("vec_id") % 4 == 0, F.lit("other")).otherwise(F.lit("m"))
    return vectors.indexed_count(e.select(F.lit("hash").alias("provider"), model.alias("model"), F.lit(64).alias("dims")), "hash", "m", 64)


@query(f"SELECT position, vec_id AS chunk_id, round(d, 5) AS rank, substr(text, 1, 40) AS text, source AS title FROM (SELECT row_number() OVER (ORDER BY d, vec_id) AS position, vec_id, d FROM (SELECT vec_id, {_DIST} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10) JOIN documents ON doc_id = vec_id")
def semantic_rows(spark, sf_dir):
    """Nearest vectors joined back to their chunks."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    stored = e.select(F.col("vec_id").alias("chunk_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(64).alias("dims"), F.col("embedding").alias("vector"))
    got = vectors.semantic_search(corpora.documents(spark, sf_dir), stored, _QUERY, 10, "p", "m")
    return got.select("position", "chunk_id", F.round("rank", 5).alias("rank"), F.substring("text", 1, 40).alias("text"), "title")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents WHERE doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM a) ORDER BY n_chars, doc_id LIMIT 30) SELECT coalesce(a.doc_id, b.doc_id) AS evidence_id, a.r AS lexical_rank, b.r AS semantic_rank, round(coalesce(1.0 / (60 + a.r), 0)::DOUBLE + coalesce(1.0 / (60 + b.r), 0)::DOUBLE, 6) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def fusion_trace(spark, sf_dir):
    """All candidates of a fusion with both ranks."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = ctx.positions(d.orderBy(F.col("n_chars").desc(), "doc_id").limit(30), F.col("n_chars").desc(), "doc_id")
    other = d.join(F.broadcast(a.select("doc_id", F.lit(True).alias("seen"))), "doc_id", "left").where("doc_id % 3 = 0 or seen")
    b = ctx.positions(other.orderBy("n_chars", "doc_id").limit(30), "n_chars", "doc_id")
    of = lambda x: x.select(F.col("doc_id").alias("evidence_id"), "position")
    return vectors.fuse(of(a), of(b), None).select("evidence_id", "lexical_rank", "semantic_rank", F.round("score", 6).alias("score"))


# ---- evaluation, languages --------------------------------------------------------------------------------

@query("SELECT lang AS language, CASE lang WHEN 'en' THEN 'en' WHEN 'ru' THEN 'ru' END AS ui, count(*) AS n FROM documents GROUP BY 1, 2")
def ui_languages(spark, sf_dir):
    """The interface's language for each language tag."""
    from ..sources.settings import ui_language

    tags = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"))
    rows = [(r.language, ui_language(f"{r.language}_XX" if r.language else None), r.n) for r in tags.toLocalIterator()]  # a row a language
    return spark.createDataFrame(rows, "language string, ui string, n long")


@query(_with(_ORDERS, "SELECT regexp_extract(lang, '^[a-z]+') AS language, count(*) AS n FROM ot GROUP BY 1 ORDER BY n DESC, language LIMIT 1"))
def dominant_ui_language(spark, sf_dir):
    """The most frequent primary tag among the interface's languages."""
    return graph.dominant_language(corpora.orders(spark, sf_dir))


@query(_with(_ORDERS, """SELECT o_orderkey AS chunk_id, CASE WHEN cid IS NOT NULL THEN concat('customer-', o_custkey, '/', cid) ELSE concat('customer-', o_custkey, '/transcript:', ord, ':', sha256(concat('{"kind":"transcript","ordinal":', ord, ',"text":"', text, '"}'))) END AS evidence_id FROM ot"""))
def evaluation_ids(spark, sf_dir):
    """The ids that evaluation sets use, with and without a chunk id."""
    return corpora.orders(spark, sf_dir).select("chunk_id", ev.evaluation_id().alias("evidence_id"))


_PRINTED = "sha256(concat_ws(chr(0), 'k', 'p', 'conversation-' || conv_id, 'f' || conv_id, 'turn-' || conv_id || '-' || turn, 'transcript', turn, sha256(concat('conversation-', conv_id, chr(0), 'transcript', chr(0), turn, chr(0), text))))"


@query(f"WITH r AS (SELECT {_PRINTED} AS h FROM conversations), p AS (SELECT substr(h, 1, 3) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n_chunks, sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM p")
def corpus_fingerprint_full(spark, sf_dir):
    """The corpus with its sources' and its meetings' marks."""
    chunks = corpora.conversations(spark, sf_dir).withColumns({"source_kind": F.lit("k"), "source_path": F.lit("p")})
    meetings = chunks.select("meeting_id", F.concat(F.lit("f"), F.col("meeting_id").cast("string")).alias("fingerprint")).distinct()
    return ev.corpus_fingerprint(chunks, meetings)


_NOTED = f"w AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), t AS (SELECT doc_id, t, min(i) AS i FROM w WHERE length(t) > 1 AND t NOT IN ({_STOP}) GROUP BY 1, 2), q AS (SELECT doc_id, count(*) AS n, string_agg('\"' || t || '\"', ' OR ' ORDER BY i) AS a, string_agg('\"' || t || '\"', ' AND ' ORDER BY i) AS s FROM t GROUP BY 1)"


@query(f"WITH {_NOTED} SELECT doc_id, coalesce(a, '') AS any_query, CASE WHEN n BETWEEN 2 AND 4 THEN s ELSE '' END AS strict_query FROM documents LEFT JOIN q USING (doc_id)")
def query_notation(spark, sf_dir):
    """What the first two words of every text ask of a full-text engine."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("query_id"), F.substring_index("text", " ", 2).alias("query"))
    written = lambda c, word: F.array_join(F.transform(c, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), f" {word} ")
    return inverted.terms_of(d).select(F.col("query_id").alias("doc_id"), written("anyof", "OR").alias("any_query"), written("strict", "AND").alias("strict_query"))
