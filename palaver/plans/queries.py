"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.querytext import STOPWORDS
from ..functions.text import ACCENTED, PLAIN, preview
from ..operators import context as ctx
from ..operators import entities as ent
from ..operators import evaluation as ev
from ..operators import cells, graph, inverted, memory, search, state, vectors
from ..sources import corpora
from .dossier import KEYWORDS, classified
from .index import classify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL pieces -------------------------------------------------------------------------------------------

def _tokens(c: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(rows: str, terms: list[str], keep: str = "") -> str:
    """CTEs: rows(chunk_id, tokens, ...) to scored(chunk_id, n_terms, rank)."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""
      r AS ({rows}),
      corpus AS (SELECT count(*) AS n_rows, avg(len(tokens)) AS avgdl FROM r),
      terms(term) AS (VALUES {values}),
      tf AS (SELECT chunk_id{keep}, len(tokens) AS dl, term, len(list_filter(tokens, lambda x: x = term)) AS tf FROM r, terms),
      df AS (SELECT term, sum((tf > 0)::INT) AS df FROM tf GROUP BY term),
      scored AS (SELECT chunk_id{keep}, sum((tf > 0)::INT) AS n_terms,
          -sum(CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
        FROM tf JOIN df USING (term) CROSS JOIN corpus GROUP BY chunk_id{keep})"""


_DOCS = f"SELECT doc_id AS chunk_id, list_concat({_tokens('source')}, {_tokens('text')}) AS tokens FROM documents"
_TURNS = f"SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS meeting_id, turn AS ordinal, list_concat(list_concat({_tokens(chr(39) + 'Conversation ' + chr(39) + ' || conv_id')}, {_tokens('text')}), {_tokens('role')}) AS tokens FROM conversations"
_EVENTS = """
  ev AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, max(ts) OVER (PARTITION BY user_id) AS latest, ts,
           CASE event_type
             WHEN 'purchase' THEN concat('We decided to approve order ', event_id, '. Budget is fine.')
             WHEN 'error' THEN concat('Open question: who owns incident ', event_id % 50, '? There is a risk of outage.')
             WHEN 'signup' THEN concat('Please send the welcome pack to user ', user_id, ' by Friday.')
             WHEN 'click' THEN 'We should think about the update. Please share notes.'
             ELSE concat('Nothing notable in session ', event_id, '.') END AS text
         FROM events)"""
_DECISION = r"(?i)\b(decision|decided|agreed|approved|confirmed|resolved)\b"
_RISK = r"(?i)\b(risk|risks|blocker|blocked|issue|concern|dependency)\b"
_ACTION = r"(?i)\b(action item|todo|to do|follow up)\b|\b(agreed to|owns|owner)\s+\w+|\b(send|prepare|share|write|create|update|review|check|clarify)\b"
_SKIP = r"(?i)\b(should|need to|needs to)\s+(think|understand|figure out)\b"
_QUESTION = r"(?i)\b(open question|unknown|clarify|tbd)\b"
_ENTITIES = f"""{_EVENTS},
  cut AS (SELECT event_id, user_id, ord, latest, string_split(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(10)), 'g'), chr(10)) AS parts FROM ev),
  sent AS (SELECT event_id, user_id, ord, latest, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS place FROM cut),
  kinds(kind_index, kind) AS (VALUES (0, 'decisions'), (1, 'action_items'), (2, 'risks'), (3, 'open_questions')),
  hit AS (SELECT s.*, k.* FROM sent s, kinds k WHERE CASE kind
            WHEN 'decisions' THEN regexp_matches(text, '{_DECISION}')
            WHEN 'risks' THEN regexp_matches(text, '{_RISK}')
            WHEN 'open_questions' THEN regexp_matches(text, '{_QUESTION}')
            ELSE NOT regexp_matches(text, '{_QUESTION}') AND NOT regexp_matches(text, '{_SKIP}') AND regexp_matches(text, '{_ACTION}') END),
  once AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY user_id, kind, lower(text) ORDER BY ord, event_id, place) = 1),
  ent AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ord, event_id, place) - 1 AS ordinal, strftime(latest, '%Y-%m-%dT%H:%M:%SZ') AS meeting_date FROM once)"""
_PLACED = f"""{_ENTITIES},
  top AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY meeting_date DESC, ordinal, event_id) AS place_in_kind FROM ent)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


_STORED: dict[tuple[str, str, str, str], inverted.StoredIndex] = {}


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; it is deleted when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="palaver-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/views-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


_FOLDERS: list[tuple[SparkSession, str]] = []


def kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows that a query uses more than once, written and read again, so that they are made once."""
    path = f"{folder(spark)}/rows"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@atexit.register
def _delete_folders() -> None:
    for spark, path in _FOLDERS:
        if spark.sparkContext._jsc is None:
            return
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM is already gone; the folder belongs to the session
            return


def table_state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: what changes when it is written anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    return repr([(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)])


def indexed(spark: SparkSession, sf_dir: str, corpus: str) -> tuple[DataFrame, inverted.StoredIndex]:
    """The clustered chunks of a corpus and its postings, written once a session and state of the table."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus, table_state(spark, f"{sf_dir}/{corpus}.parquet"))
    if key not in _STORED:
        _STORED[key] = inverted.StoredIndex(spark, f"{folder(spark)}/{corpus}").build(getattr(corpora, corpus)(spark, sf_dir))
    return _STORED[key].chunks, _STORED[key]


def _found(spark: SparkSession, sf_dir: str, corpus: str, text: str, limit: int, mode: str = "cascade", meeting_id=None) -> DataFrame:
    chunks, index = indexed(spark, sf_dir, corpus)
    return index.hits(chunks, text, limit, meeting_id, mode)


def _searched(spark: SparkSession, sf_dir: str, text: str, limit: int, context: int = 0) -> DataFrame:
    chunks, index = indexed(spark, sf_dir, "conversations")
    return search.search(chunks, text, limit, context=context, postings=index)


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("position", "chunk_id", F.round("rank", 6).alias("rank"), *more)


# ---- search -----------------------------------------------------------------------------------------------

@query(_with(f"t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents)", "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term"))
def fts_tokens(spark, sf_dir):
    """Index vocabulary with document and collection frequencies."""
    return search.term_statistics(corpora.documents(spark, sf_dir), ("text",))


@query(_with(_bm25(_DOCS, ["with", "from"]), "SELECT row_number() OVER (ORDER BY rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank FROM scored WHERE n_terms > 0 ORDER BY rank, chunk_id LIMIT 20"))
def fts_bm25_or(spark, sf_dir):
    return _hits(_found(spark, sf_dir, "documents", "with from", 20, "any"))


@query(_with(_bm25(_DOCS, ["with", "from"]), "SELECT row_number() OVER (ORDER BY rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank FROM scored WHERE n_terms = 2 ORDER BY rank, chunk_id LIMIT 20"))
def fts_strict_and(spark, sf_dir):
    return _hits(_found(spark, sf_dir, "documents", "with from", 20, "all"))


_CASCADE = _with(
    _bm25(_TURNS, ["with", "from", "their"], ", meeting_id, ordinal"),
    "SELECT row_number() OVER (ORDER BY stage, rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank, stage FROM (SELECT *, (n_terms < 3)::INT AS stage FROM scored WHERE n_terms > 0) ORDER BY stage, rank, chunk_id LIMIT 40",
)


@query(_CASCADE)
def fts_strict_then_or(spark, sf_dir):
    """Strict hits first, then any."""
    return _hits(_found(spark, sf_dir, "conversations", "with from their", 40), "stage")


@query(_with(_bm25(_TURNS, ["with", "from"], ", meeting_id, ordinal"), "SELECT row_number() OVER (ORDER BY stage, rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank, stage FROM (SELECT *, (n_terms < 2)::INT AS stage FROM scored WHERE n_terms > 0 AND meeting_id = 3) ORDER BY stage, rank, chunk_id LIMIT 10"))
def fts_scoped(spark, sf_dir):
    """One conversation's hits, scored with the statistics of all."""
    return _hits(_found(spark, sf_dir, "conversations", "with from", 10, meeting_id=3), "stage")


@query(
    _with(
        _bm25(_TURNS, ["with", "from"], ", meeting_id, ordinal")
        + """,
      hits AS (SELECT *, row_number() OVER (ORDER BY (n_terms < 2)::INT, rank, chunk_id) AS hit_position FROM scored WHERE n_terms > 0 ORDER BY (n_terms < 2)::INT, rank, chunk_id LIMIT 8),
      both_ AS (SELECT chunk_id, chunk_id AS matched_chunk_id, hit_position, 0 AS away, ordinal, rank, false AS is_context FROM hits
        UNION ALL SELECT r.chunk_id, h.chunk_id, hit_position, abs(r.ordinal - h.ordinal), r.ordinal, h.rank, true FROM hits h JOIN r ON r.meeting_id = h.meeting_id AND abs(r.ordinal - h.ordinal) BETWEEN 1 AND 2),
      once AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY is_context, hit_position, away, ordinal) = 1)""",
        "SELECT row_number() OVER (ORDER BY is_context, hit_position, away, ordinal, chunk_id) AS position, chunk_id, round(rank, 6) AS rank, matched_chunk_id, hit_position, is_context FROM once",
    )
)
def fts_neighbors(spark, sf_dir):
    """Hits, then the turns at most two away from each."""
    return _hits(_searched(spark, sf_dir, "with from", 8, 2), "matched_chunk_id", "hit_position", "is_context")


@query(_with(_bm25(_DOCS, ["src7"]), "SELECT row_number() OVER (ORDER BY rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank FROM scored WHERE n_terms > 0 ORDER BY rank, chunk_id LIMIT 30"))
def fts_title_match(spark, sf_dir):
    """A word of the title matches every chunk of the meeting."""
    return _hits(_found(spark, sf_dir, "documents", "src7", 30))


def _ranked_cte(name: str, terms: list[str], limit: int) -> str:
    body = _bm25("SELECT * FROM base", terms)
    return f"{name} AS (WITH {body.strip()} SELECT chunk_id, rank, row_number() OVER (ORDER BY (n_terms < {len(terms)})::INT, rank, chunk_id) AS position FROM scored WHERE n_terms > 0 ORDER BY (n_terms < {len(terms)})::INT, rank, chunk_id LIMIT {limit})"


@query(
    _with(
        f"base AS ({_DOCS}), {_ranked_cte('a', ['with', 'from'], 12)}, {_ranked_cte('b', ['nicht'], 12)}, u AS (SELECT 0 AS tp, * FROM a UNION ALL SELECT 1, * FROM b), once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY tp, position) = 1)",
        "SELECT row_number() OVER (ORDER BY tp, position, chunk_id) AS position, chunk_id, round(rank, 6) AS rank, tp AS term_position FROM once ORDER BY tp, position, chunk_id LIMIT 12",
    )
)
def fts_multi_term_union(spark, sf_dir):
    """Each term's hits in turn, new ones only."""
    chunks, index = indexed(spark, sf_dir, "documents")
    return _hits(search.search_terms(chunks, ["with from", "nicht"], 12, index), "term_position")


@query(_with(_bm25(_DOCS, ["with", "from"]), "SELECT row_number() OVER (ORDER BY rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank FROM scored WHERE n_terms > 0 ORDER BY rank, chunk_id LIMIT 20"))
def fts_scan(spark, sf_dir):
    """The same ranking without an index, counted inside the rows."""
    return _hits(search.ranked(corpora.documents(spark, sf_dir), "with from", 20, mode="any"))


@query(_with(_bm25(_DOCS, ["with", "from"]), "SELECT row_number() OVER (ORDER BY stage, rank, chunk_id) AS position, chunk_id, round(rank, 6) AS rank, stage FROM (SELECT *, (n_terms < 2)::INT AS stage FROM scored WHERE n_terms > 0) ORDER BY stage, rank, chunk_id LIMIT 10"))
def fts_block_bounds(spark, sf_dir):
    """The cascade's top by blocks whose bounds reach the threshold, however few postings there are."""
    chunks, index = indexed(spark, sf_dir, "documents")
    return _hits(inverted.Postings(index.parts, index.totals, few=0).hits(chunks, "with from", 10), "stage")


_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
def _batch(queries: str) -> str:
    """CTEs from queries (query_id, query) to top(query_id, chunk_id, rank, stage) over the conversations."""
    return f"""
  r AS ({_TURNS}),
  corpus AS (SELECT count(*) AS n_rows, avg(len(tokens)) AS avgdl FROM r),
  asked AS ({queries}),
  raw AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT query_id AS doc_id, regexp_extract_all(replace(replace(lower(coalesce(query, '')), 'ß', 'ss'), 'ς', 'σ'), '[\\p{{L}}\\p{{N}}_]+') AS w FROM asked)),
  seen AS (SELECT doc_id, term, min(i) AS first_ FROM raw WHERE length(term) > 1 AND term NOT IN ({_STOP}) GROUP BY 1, 2),
  tok AS (SELECT doc_id, term FROM seen QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first_) <= 16),
  ask AS (SELECT doc_id, term, translate(term, '{ACCENTED}', '{PLAIN}') AS token, count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
  post AS (SELECT chunk_id, meeting_id, len(tokens) AS dl, unnest(tokens) AS token FROM r),
  tf AS (SELECT token, chunk_id, dl, count(*) AS tf FROM post GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  scored AS (SELECT doc_id, chunk_id, n, count(*) AS hit, -sum(greatest(CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - df + 0.5) / (df + 0.5)) END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
    FROM ask JOIN tf USING (token) JOIN df USING (token), corpus GROUP BY 1, 2, 3),
  top AS (SELECT doc_id AS query_id, chunk_id, rank, CASE WHEN n BETWEEN 2 AND 4 AND hit = n THEN 0 ELSE 1 END AS stage FROM scored)"""


@query(_with(_batch("SELECT doc_id AS query_id, substr(text, 1, 60) AS query FROM documents"), "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank, chunk_id) AS position, chunk_id, stage, round(rank, 6) AS rank FROM top QUALIFY position <= 5"))
def batch_search(spark, sf_dir):
    """The cascade's top of many queries at once: the beginning of every document, looked up in the conversations."""
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    top = indexed(spark, sf_dir, "conversations")[1].batch(asked, 5)
    return top.select("query_id", "position", "chunk_id", "stage", F.round("rank", 6).alias("rank"))


# ---- entities ---------------------------------------------------------------------------------------------

@query(_with(_ENTITIES, "SELECT kind, user_id AS meeting_id, event_id AS source_chunk_id, ordinal, text, 'heuristic' AS source, 0.55::DOUBLE AS confidence, sha256(concat(kind, chr(0), event_id, chr(0), lower(text))) AS fingerprint FROM ent"))
def entities_extract(spark, sf_dir):
    return ent.extract(corpora.events(spark, sf_dir)).drop("entity_id")


@query(_with(_ENTITIES, "SELECT kind, count(e.kind) AS n FROM kinds LEFT JOIN (SELECT kind FROM ent) e USING (kind) GROUP BY kind"))
def entities_by_kind_counts(spark, sf_dir):
    return ent.counts(ent.extract(corpora.events(spark, sf_dir)))


def _details(spark, sf_dir):
    chunks = corpora.events(spark, sf_dir)
    # ties by the chunk's id, as the SQL has them
    found = ent.extract(chunks).withColumn("entity_id", F.col("source_chunk_id"))
    return chunks, ent.details(found, chunks)


@query(_with(_PLACED, "SELECT kind, place_in_kind AS place, user_id AS meeting_id, event_id AS source_chunk_id, ordinal, text, meeting_date FROM top WHERE place_in_kind <= 15"))
def entities_latest_per_kind(spark, sf_dir):
    return ent.latest_per_kind(_details(spark, sf_dir)[1], 15).select("kind", "place", "meeting_id", "source_chunk_id", "ordinal", "text", "meeting_date")


_MERGED = f"""{_PLACED},
  merged AS (SELECT *, row_number() OVER (ORDER BY meeting_date DESC, ordinal, kind_index, place_in_kind) AS position FROM top WHERE place_in_kind <= 80)"""


@query(_with(_MERGED, "SELECT position, kind, user_id AS meeting_id, event_id AS source_chunk_id, text FROM merged WHERE contains(lower(text), 'risk') AND contains(lower(text), 'outage') ORDER BY position LIMIT 20"))
def entities_merged_timeline(spark, sf_dir):
    """The newest of all kinds that hold all terms."""
    return ent.timeline(_details(spark, sf_dir)[1], "Risk outage", 20).select("position", "kind", "meeting_id", "source_chunk_id", "text")


@query(_with(_ENTITIES, "SELECT user_id AS meeting_id, kind, text, event_id AS source_chunk_id FROM ent WHERE kind IN ('risks', 'action_items')"))
def entities_dedupe(spark, sf_dir):
    """Repeated sentences keep their first chunk."""
    return ent.extract(corpora.events(spark, sf_dir)).where(F.col("kind").isin("risks", "action_items")).select("meeting_id", "kind", "text", "source_chunk_id")


# ---- meetings ---------------------------------------------------------------------------------------------

@query(_with(_EVENTS, "SELECT user_id AS meeting_id, concat('User ', user_id) AS title, strftime(max(latest), '%Y-%m-%dT%H:%M:%SZ') AS created_at, count(*) AS chunk_count FROM ev GROUP BY user_id ORDER BY created_at DESC, meeting_id LIMIT 25"))
def meetings_recent(spark, sf_dir):
    chunks = corpora.events(spark, sf_dir)
    return memory.recent_meetings(corpora.meetings_of(chunks), chunks, 25).select("meeting_id", "title", "created_at", "chunk_count")


@query(_with(_EVENTS, "SELECT DISTINCT user_id AS meeting_id FROM ev WHERE event_id % 5 = 3 OR contains(lower(text), ' 17') AND regexp_matches(text, '\\b17\\b')"))
def person_meetings(spark, sf_dir):
    """Meetings in which speaker 3 speaks, or that mention the number 17."""
    chunks = corpora.events(spark, sf_dir)
    return graph.people(chunks).where(F.col("display_name") == "speaker 3").select("meeting_id").unionByName(memory.mentioned_ids(chunks.withColumns({"title": F.lit(""), "speaker": F.lit("")}), "17")).distinct()


@query("SELECT * FROM (SELECT 'all' AS scope, lang AS language, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1) UNION ALL SELECT * FROM (SELECT 'ui', lang, count(*) AS n FROM documents WHERE lang IN ('en', 'ru') GROUP BY lang ORDER BY n DESC, lang LIMIT 1)")
def dominant_language(spark, sf_dir):
    d = corpora.documents(spark, sf_dir)
    return memory.language_of(d).select(F.lit("all").alias("scope"), "language", "n").unionByName(graph.dominant_language(d).select(F.lit("ui").alias("scope"), "language", "n"))


@query(_with(_ENTITIES, "SELECT (SELECT count(DISTINCT user_id) FROM events) AS meetings, (SELECT count(*) FROM events) AS chunks, (SELECT count(DISTINCT event_id % 5) FROM events) AS people, count(*) FILTER (kind = 'decisions') AS decisions, count(*) FILTER (kind = 'action_items') AS action_items, count(*) FILTER (kind = 'risks') AS risks, count(*) FILTER (kind = 'open_questions') AS open_questions FROM ent"))
def stats(spark, sf_dir):
    chunks = corpora.events(spark, sf_dir)
    return memory.stats(corpora.meetings_of(chunks), chunks, ent.extract(chunks))


# ---- graph ------------------------------------------------------------------------------------------------

@query(
    _with(
        _ENTITIES,
        """SELECT DISTINCT 'Meeting' AS type, concat('meeting:', user_id) AS stable_key, concat('User ', user_id) AS title FROM ev
        UNION ALL SELECT 'Chunk', concat('chunk:', event_id), concat('User ', user_id, ' / transcript #', ord) FROM ev
        UNION ALL SELECT DISTINCT 'Person', concat('person:speaker ', event_id % 5), concat('speaker ', event_id % 5) FROM ev
        UNION ALL SELECT CASE kind WHEN 'decisions' THEN 'Decision' WHEN 'action_items' THEN 'Task' WHEN 'risks' THEN 'Risk' ELSE 'Question' END, concat(kind, ':', user_id, '-', ordinal), text FROM ent""",
    )
)
def graph_nodes(spark, sf_dir):
    chunks, found, who = _graph(spark, sf_dir)
    return graph.nodes(chunks, found, who)


def _graph(spark, sf_dir):
    chunks = kept(spark, corpora.events(spark, sf_dir))
    found = kept(spark, ent.extract(chunks)).withColumn("entity_id", F.concat_ws("-", "meeting_id", "ordinal"))
    return chunks, found, graph.people(chunks)


@query(
    _with(
        _ENTITIES,
        """SELECT concat('meeting:', user_id) AS from_key, 'contains' AS relation, concat('chunk:', event_id) AS to_key, 1.0::DOUBLE AS confidence, user_id AS meeting_id, event_id AS chunk_id, 'scan' AS extraction_method FROM ev
        UNION ALL SELECT DISTINCT concat('meeting:', user_id), 'mentions', concat('person:speaker ', event_id % 5), 0.8, user_id, NULL, 'speaker' FROM ev
        UNION ALL SELECT concat('meeting:', user_id), 'contains', concat(kind, ':', user_id, '-', ordinal), 0.55, user_id, event_id, kind FROM ent
        UNION ALL SELECT concat(kind, ':', user_id, '-', ordinal), 'originated_in', concat('chunk:', event_id), 1.0, user_id, event_id, kind FROM ent""",
    )
)
def graph_edges(spark, sf_dir):
    chunks, found, who = _graph(spark, sf_dir)
    return graph.edges(chunks, found, who)


_LINKED = f"""{_PLACED},
  linked AS (SELECT * FROM top WHERE place_in_kind <= 500 AND (contains(lower(concat_ws(' ', text, 'User ' || user_id, 'user-' || user_id, 'event-' || event_id, 'speaker ' || event_id % 5)), 'outage')))"""


@query(_with(_LINKED, "SELECT row_number() OVER (ORDER BY meeting_date DESC, ordinal, kind_index, event_id) AS position, kind, user_id AS meeting_id, event_id AS source_chunk_id, text FROM linked ORDER BY position LIMIT 25"))
def topic_signals(spark, sf_dir):
    """The newest entities that any term of a topic matches."""
    return graph.topic_signals(_details(spark, sf_dir)[1], ["outage"], 25).select("position", "kind", "meeting_id", "source_chunk_id", "text")


@query(_with(_LINKED, "SELECT DISTINCT concat('speaker ', event_id % 5) AS display_name FROM ev WHERE user_id IN (SELECT user_id FROM linked) ORDER BY 1 LIMIT 10"))
def topic_people(spark, sf_dir):
    chunks, details = _details(spark, sf_dir)
    return graph.topic_people(graph.topic_links(details, ["outage"]), graph.people(chunks), 10).select("display_name")


# ---- vectors ----------------------------------------------------------------------------------------------

_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_DIST = f"sqrt(list_sum(list_transform(list_zip(embedding, {_QUERY}::DOUBLE[]), lambda x: pow(x[1]::DOUBLE - x[2], 2))))"


@query(f"SELECT row_number() OVER (ORDER BY d, vec_id) AS position, vec_id, round(d, 5) AS distance FROM (SELECT vec_id, {_DIST} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    """Exact nearest vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    return vectors.nearest(e, _QUERY, 10, "vec_id").select("position", "vec_id", F.round("distance", 5).alias("distance"))


_CELLS: dict[tuple[str, str, str], tuple[str, np.ndarray]] = {}


@query(f"SELECT row_number() OVER (ORDER BY d, vec_id) AS position, vec_id, round(d, 5) AS distance FROM (SELECT vec_id, {_DIST} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 25")
def knn_cells(spark, sf_dir):
    """The same nearest vectors from a table stored by cells, of which those too far away are skipped."""
    key = (spark.sparkContext.applicationId, sf_dir, table_state(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _CELLS:
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
        _CELLS[key] = f"{folder(spark)}/vectors", cells.pivots_of(e)
        cells.write(cells.placed(e, _CELLS[key][1]), _CELLS[key][0])
    path, pivots = _CELLS[key]
    top = cells.search(spark.read.parquet(path), spark.read.parquet(f"{path}-cells"), pivots, _QUERY, 25, "vec_id")
    return top.select("position", "vec_id", F.round("distance", 5).alias("distance"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 7 = 0")
def embeddings_stale(spark, sf_dir):
    """Chunks without a stored embedding of their present fingerprint."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("fingerprint"))
    old = F.when(F.col("vec_id") % 7 == 0, F.lit("old")).otherwise(F.concat(F.lit("f"), F.col("vec_id").cast("string")))
    stored = e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("chunk_id"), F.lit("hash").alias("provider"), F.lit("m").alias("model"), F.lit(64).alias("dims"), old.alias("chunk_fingerprint"))
    return vectors.stale(chunks, stored, "hash", "m", 64).select("chunk_id")


_SHA = r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(replace(replace(lower(text), 'ς', 'σ'), 'ß', 'ss'), '[\p{L}\p{M}\p{N}\p{Pc}]+'), lambda t: CASE WHEN length(t) > 3 AND t[-1] = 's' THEN t[:-2] ELSE t END) AS w FROM documents),
  f AS (SELECT doc_id, unnest(list_concat(list_transform(w, lambda t: {'name': 'tok:' || t, 'weight': 1.0::DOUBLE}), list_transform(range(1, len(w)), lambda i: {'name': 'big:' || w[i] || ':' || w[i + 1], 'weight': 1.25::DOUBLE}))) AS f FROM w),
  h AS (SELECT doc_id, sha256(f.name) AS h, f.weight AS weight FROM f)
  SELECT doc_id AS chunk_id, (('0x' || substr(h, 1, 8))::BIGINT % 128)::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN weight ELSE -weight END) AS weight
  FROM h GROUP BY 1, 2 HAVING weight <> 0"""


@query(_SHA)
def hash_embedding_sha(spark, sf_dir):
    """Feature hashing in built-in functions, as sparse rows."""
    return vectors.sha_features(corpora.documents(spark, sf_dir))


@query()
def hash_embedding_blake(spark, sf_dir):
    """Feature hashing with blake2b in Arrow batches."""
    return vectors.hash_embed(corpora.documents(spark, sf_dir))


@query(
    _with(
        f"lex AS (WITH {_bm25(_DOCS, ['with', 'from']).strip()} SELECT chunk_id AS id, row_number() OVER (ORDER BY rank, chunk_id) AS r FROM scored WHERE n_terms > 0 ORDER BY rank, chunk_id LIMIT 40), sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_DIST}, vec_id) AS r FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 40), j AS (SELECT coalesce(lex.id, sem.id) AS id, lex.r AS lr, sem.r AS sr, coalesce(1.0 / (60 + lex.r), 0)::DOUBLE + coalesce(1.0 / (60 + sem.r), 0)::DOUBLE AS score FROM lex FULL JOIN sem ON lex.id = sem.id)",
        "SELECT row_number() OVER (ORDER BY score DESC, coalesce(lr, 1000000), coalesce(sr, 1000000), id) AS position, id AS evidence_id, lr AS lexical_rank, sr AS semantic_rank, round(score, 6) AS score FROM j ORDER BY position LIMIT 10",
    )
)
def hybrid_rrf(spark, sf_dir):
    """Fusion of a lexical and a semantic list of four times the limit."""
    lex = indexed(spark, sf_dir, "documents")[1].ranked("with from", vectors.candidate_limit(10), mode="any").select(F.col("chunk_id").alias("evidence_id"), "position")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    sem = vectors.nearest(e, _QUERY, vectors.candidate_limit(10), "vec_id").select(F.col("vec_id").alias("evidence_id"), "position")
    return vectors.fuse(lex, sem, 10).select("position", "evidence_id", "lexical_rank", "semantic_rank", F.round("score", 6).alias("score"))


# ---- evaluation -------------------------------------------------------------------------------------------

def _judged(order: str, s: str = "") -> str:
    """CTEs up to obs{s}: the metrics of each source as a task, its documents in this order as the ranking."""
    return f"""
  lab{s} AS (SELECT d.doc_id, d.source, d.n_chars, coalesce(l.quality, 0) + coalesce(l.toxic, 0) AS rel FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
  ret{s} AS (SELECT source AS task_id, concat(source, '-', doc_id % 7) AS meeting, rel, row_number() OVER (PARTITION BY source ORDER BY {order}) AS rank FROM lab{s} QUALIFY rank <= 10),
  want{s} AS (SELECT source AS task_id, concat(source, '-', doc_id % 7) AS meeting, rel, row_number() OVER (PARTITION BY source ORDER BY rel DESC, concat(source, '-', doc_id % 7, '/', doc_id)) AS n FROM lab{s} WHERE rel > 0),
  ideal{s} AS (SELECT task_id, sum((pow(2, rel) - 1) / log2(n + 1)) AS ideal FROM want{s} WHERE n <= 5 GROUP BY 1),
  fp{s} AS (SELECT task_id, min(rank) FILTER (rel = 2) AS p, sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS n_retrieved FROM ret{s} GROUP BY 1),
  src{s} AS (SELECT r.task_id, r.meeting IN (SELECT w.meeting FROM want{s} w WHERE w.task_id = r.task_id) AS ok FROM ret{s} r WHERE rank = 1),
  opened{s} AS (SELECT r.task_id, count(DISTINCT r.meeting) AS openings FROM ret{s} r JOIN fp{s} USING (task_id) WHERE p IS NULL OR rank <= p GROUP BY 1),
  obs{s} AS (SELECT task_id, p, p IS NOT NULL AS success, coalesce((p <= 1)::INT, 0)::DOUBLE AS h1, coalesce((p <= 3)::INT, 0)::DOUBLE AS h3, coalesce((p <= 5)::INT, 0)::DOUBLE AS h5, coalesce(1.0 / p, 0)::DOUBLE AS rr,
            CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg, ok, openings, n_retrieved FROM fp{s} LEFT JOIN ideal{s} USING (task_id) LEFT JOIN src{s} USING (task_id) LEFT JOIN opened{s} USING (task_id))"""


def _observed(spark, sf_dir, *order):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    s = F.concat("source", F.lit("-"), (F.col("doc_id") % 7).cast("string"))
    rows = d.join(lab, "doc_id", "left").withColumn("relevance", F.coalesce("q", F.lit(0)) + F.coalesce("t", F.lit(0))).select(F.col("source").alias("task_id"), "doc_id", "n_chars", s.alias("meeting_external_id"), F.concat_ws("/", s, "doc_id").alias("evidence_id"), "relevance")
    found = rows.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(*order))).where("rank <= 10").select("task_id", "evidence_id", "meeting_external_id", "rank")
    tasks = rows.select("task_id", F.lit("exact_match").alias("class"), F.lit(False).alias("critical")).distinct()
    return ev.observe(found, rows.where("relevance > 0").select("task_id", "evidence_id", "relevance"), tasks)


@query(_with(_judged("n_chars DESC, doc_id"), "SELECT task_id, success, h1 AS hit_at_1, h3 AS hit_at_3, h5 AS hit_at_5, round(rr, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, coalesce(ok, false) AS source_accurate, openings AS source_openings FROM obs"))
def eval_tasks(spark, sf_dir):
    """Metrics of every task: sources as tasks, their documents by length as the ranking, labels as judgements."""
    o = _observed(spark, sf_dir, F.col("n_chars").desc(), "doc_id")
    return o.select("task_id", "success", "hit_at_1", "hit_at_3", "hit_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"), "source_accurate", "source_openings")


@query(_with(_judged("n_chars DESC, doc_id"), "SELECT round(avg(h1), 6) AS hit_at_1, round(avg(h3), 6) AS hit_at_3, round(avg(h5), 6) AS hit_at_5, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(coalesce(ok, false)::INT), 6) AS source_accuracy, median(openings)::DOUBLE AS median_source_openings, avg((n_retrieved = 0)::INT)::DOUBLE AS empty_result_rate FROM obs"))
def eval_metrics(spark, sf_dir):
    m = ev.metrics(_observed(spark, sf_dir, F.col("n_chars").desc(), "doc_id"))
    return m.select(*[F.round(c, 6).alias(c) for c in ev.METRICS[:6]], "median_source_openings", "empty_result_rate")


@query(
    _with(
        _batch("SELECT conv_id * 1000 + turn AS query_id, substr(text, 1, 40) AS query FROM conversations")
        + """,
  placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank, chunk_id) AS pos FROM top QUALIFY pos <= 5),
  want AS (SELECT conv_id * 1000 + turn AS query_id, conv_id * 1000 + turn AS chunk_id, 2 AS rel FROM conversations UNION ALL SELECT a.conv_id * 1000 + a.turn, b.conv_id * 1000 + b.turn, 1 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  ideal AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(3.0 - rel + 1)) AS ideal FROM want GROUP BY 1),
  got AS (SELECT query_id, min(pos) FILTER (rel = 2) AS p, sum(coalesce((pow(2, rel) - 1) / log2(pos + 1), 0)) AS dcg, count(*) AS n FROM placed LEFT JOIN want USING (query_id, chunk_id) GROUP BY 1)""",
        "SELECT query_id::VARCHAR AS task_id, p IS NOT NULL AS success, coalesce((p <= 1)::INT, 0)::DOUBLE AS hit_at_1, round(coalesce(1.0 / p, 0), 6)::DOUBLE AS reciprocal_rank, round(coalesce(dcg, 0) / ideal, 6) AS ndcg, coalesce(n, 0)::BIGINT AS n_retrieved FROM ideal LEFT JOIN got USING (query_id)",
    )
)
def eval_batch(spark, sf_dir):
    """Retrieval quality over all turns at once: the beginning of each is to find the turn itself, then the next one."""
    chunks, index = indexed(spark, sf_dir, "conversations")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda turn: F.concat(F.lit("conversation-"), F.col("conv_id").cast("string"), F.lit("/turn-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    own, following = F.struct(name(F.col("turn")).alias("evidence_id"), F.lit(2).alias("relevance")), F.struct(name(F.col("turn") + 1).alias("evidence_id"), F.lit(1).alias("relevance"))
    tasks = c.withColumn("last", last).select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("task_id"), F.substring("text", 1, 40).alias("query"), F.lit("exact_match").alias("class"), F.lit(False).alias("critical"), F.when(F.col("turn") < F.col("last"), F.array(own, following)).otherwise(F.array(own)).alias("expected"))
    o = ev.observe_index(tasks, index, chunks)
    return o.select("task_id", "success", "hit_at_1", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"), "n_retrieved")


@query(
    _with(
        _judged("n_chars DESC, doc_id", "0") + "," + _judged("doc_id", "1"),
        "SELECT count(*) FILTER (b.success AND NOT a.success OR a.success = b.success AND b.ndcg > a.ndcg) AS improvements, count(*) FILTER (a.success = b.success AND a.ndcg = b.ndcg) AS ties, count(*) FILTER (a.success AND NOT b.success OR a.success = b.success AND b.ndcg < a.ndcg) AS regressions FROM obs0 a JOIN obs1 b USING (task_id)",
    )
)
def eval_compare(spark, sf_dir):
    """Paired outcomes of two rankings."""
    pairs = ev.paired(_observed(spark, sf_dir, F.col("n_chars").desc(), "doc_id"), _observed(spark, sf_dir, "doc_id"))
    return ev.outcome_counts(pairs).where("class is null").select("improvements", "ties", "regressions")


# ---- identity, state, views -------------------------------------------------------------------------------

_TURN_PRINT = "sha256(concat('conversation-', conv_id, chr(0), 'transcript', chr(0), turn, chr(0), text))"


@query(f"WITH r AS (SELECT sha256(concat(chr(0), chr(0), 'conversation-', conv_id, chr(0), chr(0), 'turn-', conv_id, '-', turn, chr(0), 'transcript', chr(0), turn, chr(0), {_TURN_PRINT})) AS h FROM conversations), p AS (SELECT substr(h, 1, 3) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n_chunks, sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM p")
def corpus_fingerprint(spark, sf_dir):
    return ev.corpus_fingerprint(corpora.conversations(spark, sf_dir))


@query(_with(_ENTITIES, "SELECT user_id AS meeting_id, event_id AS source_chunk_id, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN 'cancelled' ELSE 'open' END AS status FROM ent WHERE kind = 'action_items'"))
def task_state_overlay(spark, sf_dir):
    """Tasks with the status that the user's state has for them."""
    chunks = corpora.events(spark, sf_dir)
    found = ent.extract(chunks)
    keys = state.identity(ent.details(found, chunks).where("kind = 'action_items'"))
    status = F.when(F.col("source_chunk_id") % 3 == 0, "done").when(F.col("source_chunk_id") % 3 == 1, "cancelled")
    states = keys.select("source_uuid", "meeting_external_id", "chunk_external_id", F.lit("task").alias("kind"), "text_sha", status.alias("status"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("orphaned")).where("status is not null")
    return ent.details(found, chunks, states).where("kind = 'action_items'").select("meeting_id", "source_chunk_id", "status")


@query("SELECT doc_id AS chunk_id, CASE WHEN length(text) > 60 THEN concat(regexp_replace(substr(text, 1, 60), '\\s+$', ''), '…') ELSE text END AS preview, length(text) > 60 AS truncated FROM documents")
def compact_preview(spark, sf_dir):
    return corpora.documents(spark, sf_dir).select("chunk_id", preview("text", 60).alias("preview"), (F.length("text") > 60).alias("truncated"))


@query("SELECT CASE WHEN event_id % 10 = 0 THEN 'inserted' WHEN event_id % 10 = 1 THEN 'missing' WHEN event_id % 10 = 2 THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM events GROUP BY 1")
def incremental_diff(spark, sf_dir):
    """What changed between two snapshots, by fingerprint."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("key"), F.concat_ws("|", "event_type", "user_id").alias("fingerprint"))
    old = e.where("key % 10 <> 0").withColumn("fingerprint", F.when(F.col("key") % 10 == 2, F.lit("old")).otherwise(F.col("fingerprint")))
    return classify(old, e.where("key % 10 <> 1")).groupBy("change").agg(F.count("*").alias("n"))


@query(_with(_bm25(_TURNS, ["with", "from"], ", meeting_id, ordinal"), "SELECT concat('conversation-', meeting_id) AS meeting_external_id, min(position) AS first_position, count(*) AS n_excerpts, round(min(rank), 6) AS best_rank FROM (SELECT *, row_number() OVER (ORDER BY (n_terms < 2)::INT, rank, chunk_id) AS position FROM scored WHERE n_terms > 0 ORDER BY (n_terms < 2)::INT, rank, chunk_id LIMIT 20) GROUP BY meeting_id"))
def context_group(spark, sf_dir):
    """Hits by meeting, in the order of the first."""
    g = ctx.grouped(_searched(spark, sf_dir, "with from", 20))
    return g.select("meeting_external_id", "first_position", "n_excerpts", F.round("best_rank", 6).alias("best_rank"))


@query("""SELECT conv_id * 1000 + turn AS chunk_id, concat('evidence:', sha256(concat('{"chunk":{"external_id":"turn-', conv_id, '-', turn, '"},"meeting_external_id":"conversation-', conv_id, '","source_uuid":"corpus"}'))) AS evidence_id FROM conversations""")
def evidence_ids(spark, sf_dir):
    return corpora.conversations(spark, sf_dir).select("chunk_id", ctx.evidence_id(F.lit("corpus")).alias("evidence_id"))


@query("SELECT concat('conversation-', conv_id) AS meeting_external_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def meeting_transcripts(spark, sf_dir):
    """Every meeting's chunks in order, as one text."""
    c = corpora.conversations(spark, sf_dir)
    return c.groupBy("meeting_external_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))


_CLASSES = ", ".join(f"list_has_any([TRUE], [{' OR '.join(f'contains(lower(text), {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)})' for w in words)}]) AS is_{kind}" for kind, words in KEYWORDS.items())


@query(_with(_EVENTS, f"SELECT event_id AS chunk_id, {_CLASSES} FROM ev"))
def evidence_classes(spark, sf_dir):
    """Which kinds of signal an excerpt's words suggest."""
    rows = classified(corpora.events(spark, sf_dir))
    return rows.select("chunk_id", *[F.array_contains("classes", k).alias(f"is_{k}") for k in KEYWORDS])


@query()
def context_markdown(spark, sf_dir):
    """The context document of one question, rendered from its grouped hits."""
    rows = ctx.grouped(_searched(spark, sf_dir, "with from", 8, 1)).collect()
    return spark.createDataFrame([(ctx.markdown("with from", rows),)], "markdown string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over conversations, joined back to the text, with neighbours."""
    return _searched(spark, sf_dir, "with from", 10, 1).select("position", "chunk_id", "meeting_external_id", "ordinal", "speaker", "text", "rank", "is_context")

