"""Full-text search: token index, BM25, strict-then-any cascade, scope, neighbours."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import querytext as q
from ..functions.text import index_tokens

# fixed values: BM25 constants and the floor of a term's weight
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

#: Columns of an evidence row.
EVIDENCE = (
    "meeting_id meeting_external_id title created_at updated_at folder_path language chunk_id chunk_external_id kind ordinal text speaker starts_at_seconds ends_at_seconds timestamp_label"
).split()
INDEXED = ("title", "text", "speaker")


def phrase(term: str) -> list[str]:
    """Index tokens of a query term; more than one if the index splits it (foo_bar)."""
    out, word = [], ""
    for ch in term.lower() + " ":
        if unicodedata.category(ch)[0] in "LN":
            parts = unicodedata.normalize("NFD", ch)
            word += parts[0] if len(parts) == 2 and parts[0].isascii() else ch
        elif word:
            out.append(word)
            word = ""
    return out


def frequency(tokens: Column, term: str) -> Column:
    """How often a term, or the phrase it stands for, is among the tokens of one field."""
    p = phrase(term)
    if len(p) == 1:
        return F.size(F.filter(tokens, lambda t: t == p[0]))
    wanted = F.array(*[F.lit(x) for x in p])
    places = F.when(F.size(tokens) >= len(p), F.sequence(F.lit(1), F.size(tokens) - len(p) + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.slice(tokens, i, len(p)) == wanted))


def tokenized(chunks: DataFrame, fields=INDEXED) -> DataFrame:
    """Rows with `tokens`, one array a field, and `dl`, their number."""
    here = [f for f in fields if f in chunks.columns]
    out = chunks.withColumn("tokens", F.array(*[index_tokens(f) for f in here]))
    return out.withColumn("dl", F.size(F.flatten("tokens")))


def with_frequencies(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """`tf`: an array with the frequency of each term over all fields, counted inside the row, without a shuffle."""
    per = [F.aggregate("tokens", F.lit(0), (lambda t: lambda a, f: a + frequency(f, t))(t)) for t in terms]
    return tokens.withColumn("tf", F.array(*per) if per else F.array().cast("array<int>"))


def statistics(rows: DataFrame, terms: list[str]) -> DataFrame:
    """One row: number of rows, average length, and each term's number of rows; partial sums leave the scan only."""
    per = [F.sum((F.col("tf")[i] > 0).cast("long")) for i in range(len(terms))]
    return rows.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"), F.array(*per).alias("df") if per else F.array().cast("array<bigint>").alias("df"))


def bm25(use: list[int]) -> Column:
    """Negated BM25 over the terms `use` (best is least), from tf, dl, n_rows, avgdl and df."""
    def part(i: int) -> Column:
        df, tf = F.col("df")[i].cast("double"), F.col("tf")[i].cast("double")
        raw = F.log((F.col("n_rows") - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    return -reduce(lambda a, b: a + b, [part(i) for i in use], F.lit(0.0))


def ranked(chunks: DataFrame, query: str, limit: int = 10, meeting_id=None, fields=INDEXED, mode: str = "cascade") -> DataFrame:
    """The best `limit` rows with rank (less is better), stage (0 strict, 1 any) and position from 1.

    mode: cascade (strict hits first, then any), any, all. Statistics are those of the whole index even if the search
    is scoped to one meeting. Ties go to the least chunk_id. A query without terms finds nothing.
    """
    any_, strict = q.any_terms(query), q.all_terms(query)
    if mode == "any":
        strict = []
    if mode == "all":
        strict = q.query_tokens(query)
    terms = list(dict.fromkeys(any_ + strict))
    rows = with_frequencies(tokenized(chunks, fields), terms)
    if not terms:
        return rows.where(F.lit(False)).drop("tokens", "tf", "dl").withColumns({"rank": F.lit(0.0), "stage": F.lit(0), "position": F.lit(0)})
    stats = statistics(rows, terms)
    hit = reduce(lambda a, b: a | b, [F.col("tf")[i] > 0 for i in range(len(terms))])
    found = rows.drop("tokens").where(hit)
    if meeting_id is not None:
        found = found.where(F.col("meeting_id") == F.lit(meeting_id))
    found = found.crossJoin(F.broadcast(stats))  # one row
    at = {t: i for i, t in enumerate(terms)}
    every = reduce(lambda a, b: a & b, [F.col("tf")[at[t]] > 0 for t in strict], F.lit(bool(strict)))
    found = found.withColumn("stage", F.when(every, 0).otherwise(1))
    if mode == "all":
        found = found.where("stage = 0")
    score = F.when(F.col("stage") == 0, bm25([at[t] for t in strict])).otherwise(bm25([at[t] for t in any_])) if strict else bm25([at[t] for t in any_])
    found = found.withColumn("rank", score).drop("tf", "dl", "n_rows", "avgdl", "df")
    top = found.orderBy("stage", "rank", "chunk_id").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("stage", "rank", "chunk_id")))


def search(chunks: DataFrame, query: str, limit: int = 10, meeting_id=None, context: int = 0, postings=None) -> DataFrame:
    """Cascade search, by the postings where there are some; with `context` > 0 the neighbours of each hit behind all."""
    hits = ranked(chunks, query, limit, meeting_id) if postings is None else postings.hits(chunks, query, limit, meeting_id)
    return expand(hits, chunks, context, None if postings is None else limit) if context > 0 else hits.withColumn("is_context", F.lit(False))


def expand(hits: DataFrame, chunks: DataFrame, context: int, limit: int | None = None) -> DataFrame:
    """Hits in their order, then for each hit the rows of its meeting at most `context` ordinals away, nearest first.

    A chunk appears once, where it comes first. Neighbours carry their hit's rank and matched_chunk_id. Of a known,
    small `limit` of hits the places are fetched first and become literals of the scan of `chunks`; in any case the
    hits, a result of limited size, are the side that is broadcast.
    """
    near = chunks
    if limit is not None and limit <= LITERALS:
        near = around(chunks, [(r["meeting_id"], r["ordinal"]) for r in hits.select("meeting_id", "ordinal").collect()], context)
    h = hits.select(F.col("meeting_id"), F.col("ordinal").alias("hit_ordinal"), F.col("chunk_id").alias("matched_chunk_id"), F.col("position").alias("hit_position"), "rank", "stage")
    near = near.join(F.broadcast(h), "meeting_id").withColumn("away", F.abs(F.col("ordinal") - F.col("hit_ordinal"))).where(F.col("away") <= context)
    near = near.where(F.col("chunk_id") != F.col("matched_chunk_id")).withColumn("is_context", F.lit(True))
    first = hits.withColumns({"matched_chunk_id": F.col("chunk_id"), "hit_position": F.col("position"), "away": F.lit(0), "is_context": F.lit(False)})
    both = first.drop("position").unionByName(near.drop("hit_ordinal"))
    once = Window.partitionBy("meeting_id", "chunk_id").orderBy("is_context", "hit_position", "away", "ordinal")
    kept = both.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    # hits times 2 * context + 1 rows at most
    order = Window.orderBy("is_context", "hit_position", "away", "ordinal", "chunk_id")
    return kept.withColumn("position", F.row_number().over(order)).drop("away")


# ---- late lookup ------------------------------------------------------------------------------------------

#: Values that become literals of a filter, and so reach the files' statistics; more are joined.
LITERALS = 256


def any_of(conditions: Iterable[Column]) -> Column:
    """Their OR, as a balanced tree. An IN of more than ten values reaches files as a range only; equalities do."""
    found = list(conditions)
    while len(found) > 1:
        found = [found[i] | found[i + 1] if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0] if found else F.lit(False)


def equals(column: str, values: Iterable) -> Column:
    return any_of(F.col(column) == F.lit(v) for v in sorted(set(values)))


def by_key(chunks: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """The rows with these (meeting_id, chunk_id): of a clustered table only the row groups of their meetings are read."""
    return chunks.where(equals("meeting_id", (m for m, _ in keys)) & equals("chunk_id", (c for _, c in keys)))


def lookup(chunks: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """`ranked` rows, at most `limit`, with the columns of their chunks.

    Up to LITERALS of them are fetched first, so their keys become literals of the scan; more are broadcast.
    """
    more = [c for c in ranked.columns if c not in chunks.columns]
    if limit <= LITERALS:
        got = ranked.collect()
        ranked = chunks.sparkSession.createDataFrame(got, ranked.schema)
        chunks = by_key(chunks, [(r["meeting_id"], r["chunk_id"]) for r in got])
    return chunks.join(F.broadcast(ranked), ["meeting_id", "chunk_id"]).select(*chunks.columns, *more)


def around(chunks: DataFrame, places: list[tuple[int, int]], reach: int) -> DataFrame:
    """Rows of meetings whose ordinal is at most `reach` from one of (meeting_id, ordinal), by literals of the scan."""
    return chunks.where(any_of((F.col("meeting_id") == m) & F.col("ordinal").between(o - reach, o + reach) for m, o in sorted(set(places))))


def clustered(chunks: DataFrame) -> DataFrame:
    """Chunks in the order in which they are looked up, in files of disjoint ranges."""
    return chunks.repartitionByRange("meeting_id", "ordinal").sortWithinPartitions("meeting_id", "ordinal", "chunk_id")


def search_terms(chunks: DataFrame, terms: list[str], limit: int, postings=None) -> DataFrame:
    """Search once per term; first the first term's hits, then the next one's that are new, `limit` together."""
    find = (lambda t: ranked(chunks, t, limit)) if postings is None else lambda t: postings.hits(chunks, t, limit)
    parts = [find(t).withColumn("term_position", F.lit(i)) for i, t in enumerate(terms)]
    if not parts:
        return ranked(chunks, "", limit).withColumn("term_position", F.lit(0))
    both = reduce(DataFrame.unionByName, parts)
    once = Window.partitionBy("chunk_id").orderBy("term_position", "position")
    kept = both.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    top = kept.orderBy("term_position", "position", "chunk_id").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("term_position", "position", "chunk_id")))


# ---- vocabulary -------------------------------------------------------------------------------------------


def term_statistics(chunks: DataFrame, fields=INDEXED) -> DataFrame:
    """(term, df, cf) over the whole corpus, counted before the shuffle."""
    flat = tokenized(chunks, fields).select(F.flatten("tokens").alias("s"))
    once, each = F.transform(F.array_distinct("s"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))), F.transform("s", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return flat.select(F.explode(F.concat(once, each)).alias("r")).groupBy("r.term").agg(F.sum("r.df").alias("df"), F.sum("r.cf").alias("cf"))
