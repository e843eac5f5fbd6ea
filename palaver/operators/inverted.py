"""The stored inverted index: postings in blocks with bounds, top-k that skips blocks, late lookup, many queries at once."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import querytext as q
from ..functions.text import casefold, index_tokens
from . import topk
from .search import B, IDF_FLOOR, INDEXED, K1, LITERALS, clustered, equals, lookup, phrase, tokenized

#: A posting; a block is the same set of chunks for every term: those of a class of lengths and a slice of their hashes.
POSTINGS = "term string, block int, chunk_id long, meeting_id long, tf long, dl int, pos array<int>, bucket int"
#: A block of a term: its postings, and what bounds their scores. Block -1 takes off what a later part has replaced.
BLOCKS = "term string, block int, n long, max_tf long, min_dl int, bucket int"
#: Rows and tokens of a part, less those it has replaced.
LENGTHS = "n_rows long, dl long"
#: Chunks for which one more bucket of terms, or one more slice, is made.
BUCKET_ROWS, SLICE_ROWS = 1 << 15, 1 << 12
MAX_BUCKETS = 1 << 12
#: Slices of a class of lengths; block numbers are class * MAX_SLICES + slice.
MAX_SLICES = 1 << 20
#: Blocks whose rows set the first threshold; postings under which none is set, as reading all is cheaper.
SEEDS, FEW = 32, 1 << 14
#: Scores are summed as whole multiples of 1 / UNIT, so the sum hangs on no order and equal scores are equal. A term's part
#: is below 64 and a query has at most 2 * MAX_TOKENS parts, so sums stay within 64 bits.
UNIT = float(1 << 50)
#: Of many queries at once: tokens of the chunks in a cell, about; the least number of parts of the chunks, and of cells.
CELL_TOKENS, CELL_BLOCKS, CELLS = 1 << 24, 4, 16


def sized(n: int, rows: int, most: int) -> int:
    """The power of two of about n / rows, from 1 to `most`."""
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, n) / rows)))) if n > rows else 1


def total(part: Column, when: Column) -> Column:
    """The exact sum of the parts of a score, each to the nearest multiple of 1 / UNIT."""
    return F.coalesce(F.sum(F.when(when, F.rint(part * UNIT).cast("long"))), F.lit(0)) / F.lit(UNIT)


# ---- building ---------------------------------------------------------------------------------------------


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def block_of(dl: Column, chunk_id: Column, slices: int) -> Column:
    """Chunks of like length share blocks: for one frequency a term's score hangs on the length alone."""
    return (F.floor(2 * F.log2(dl + 1)).cast("int") * MAX_SLICES + F.pmod(F.xxhash64(chunk_id), F.lit(slices)).cast("int")).cast("int")


def flat(chunks: DataFrame, fields) -> DataFrame:
    """Rows with `s`: all tokens, one empty place between fields, so that no phrase goes over their border."""
    t = tokenized(chunks, fields)
    meeting = F.col("meeting_id") if "meeting_id" in chunks.columns else F.lit(None)
    gap = F.transform("tokens", lambda x: F.concat(x, F.array(F.lit(""))))
    return t.select("chunk_id", meeting.cast("long").alias("meeting_id"), "dl", F.flatten(gap).alias("s"))


def term_rows(chunks: DataFrame, fields=INDEXED) -> DataFrame:
    """(term, chunk_id, meeting_id, tf, dl, pos): one row a chunk and term, counted inside the chunk's row.

    The tokens are sorted with their places; each run of equal ones is a posting. Nothing is shuffled.
    """
    # the empty places between fields come first in the order; a filter on the tokens would be evaluated a second time
    t = flat(chunks, fields).withColumn("all", F.sort_array(F.transform("s", lambda w, i: F.struct(w.alias("w"), i.alias("at")))))
    t = t.withColumn("a", F.slice("all", F.size("all") - F.col("dl") + 1, F.col("dl")))
    t = t.withColumn("starts", F.when(F.col("dl") > 0, F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("a", i)["w"] != F.get("a", F.when(i > 0, i - 1).otherwise(0))["w"]))))
    run = lambda i, k: F.struct(F.get("a", i)["w"].alias("term"), F.transform(F.slice("a", i + 1, F.coalesce(F.get("starts", k + 1), F.size("a")) - i), lambda x: x["at"]).alias("pos"))
    t = t.select("chunk_id", "meeting_id", "dl", F.explode(F.transform("starts", run)).alias("p"))
    return t.select("p.term", "chunk_id", "meeting_id", F.size("p.pos").cast("long").alias("tf"), "dl", "p.pos")


def write_parts(rows: DataFrame, path: str, n: int) -> int:
    """Write posting rows of `n` chunks as `path`/postings, with `path`/blocks; returns the number of buckets.

    One shuffle, by bucket and a salt of the chunk, so a word that every chunk has is spread; within a file the rows
    of a term stand by block, so both are found by the statistics of row groups and pages.
    """
    spark = rows.sparkSession
    buckets, slices = sized(n, BUCKET_ROWS, MAX_BUCKETS), sized(n, SLICE_ROWS, MAX_SLICES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, tasks // buckets)
    t = rows.withColumns({"bucket": bucket_of(F.col("term"), buckets), "block": block_of(F.col("dl"), F.col("chunk_id"), slices), "salt": F.pmod(F.hash("chunk_id"), F.lit(salts))})
    t = t.repartition("bucket", "salt").select(*[c.split()[0] for c in POSTINGS.split(", ")])
    t.sortWithinPartitions("bucket", "term", "block", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    heads = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    write_heads(heads, path, "overwrite")
    return buckets


def write_heads(heads: DataFrame, path: str, mode: str) -> None:
    heads.select(*[c.split()[0] for c in BLOCKS.split(", ")]).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/blocks")


def taken_off(terms: DataFrame, buckets: int) -> DataFrame:
    """BLOCKS rows for (term, n), n below zero."""
    return terms.select("term", F.lit(-1).alias("block"), "n", F.lit(0).cast("long").alias("max_tf"), F.lit(0).alias("min_dl"), bucket_of(F.col("term"), buckets).alias("bucket"))


def written_lengths(spark: SparkSession, path: str, n: int) -> DataFrame:
    """`lengths` of the `n` chunks whose postings stand below `path`: no text is tokenised again."""
    tf = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return tf.agg(F.lit(n).cast("long").alias("n_rows"), F.coalesce(F.sum("tf"), F.lit(0)).alias("dl"))


def lengths(chunks: DataFrame, fields=INDEXED) -> DataFrame:
    """One row (n_rows, dl): rows and their tokens."""
    return tokenized(chunks, fields).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("dl"))


# ---- reading ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Live postings and blocks of one segment, dealt by `buckets`."""

    rows: DataFrame
    heads: DataFrame
    buckets: int


@dataclass(frozen=True)
class Statistics:
    """What a query's scores need: rows, average length, and each term's weight."""

    df: dict[str, int]
    n_rows: int
    avgdl: float

    def idf(self, term: str) -> float:
        n = self.df.get(term, 0)
        raw = math.log((self.n_rows - n + 0.5) / (n + 0.5))
        return raw if raw > 0 else IDF_FLOOR

    def weight(self, column: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for t in self.df for x in (t, self.idf(t))]), column)

    def score(self, tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.avgdl)))


class Postings:
    """Search over postings in parts. A query reads the buckets of its terms, of frequent terms only the blocks that can
    still enter its top, and of the chunks only the hits."""

    def __init__(self, parts: list[Part], totals: DataFrame, few: int = FEW):
        self.parts, self.totals, self.few = parts, totals, few

    def _of(self, words: list[str], table: str = "rows", blocks: dict[int, list[int]] | None = None) -> DataFrame:
        """Rows, or blocks, of some index terms, with their part; the buckets fold to constants and prune partitions."""
        out = []
        for k, part in enumerate(self.parts):
            if blocks is None or k in blocks:
                here = F.col("bucket").isin([bucket_of(F.lit(w), part.buckets) for w in words]) & equals("term", words)
                here = here if blocks is None else here & equals("block", blocks[k])
                out.append(getattr(part, table).where(here).withColumn("part", F.lit(k)))
        return reduce(DataFrame.unionByName, out)

    @staticmethod
    def _layers(terms: list[str]) -> tuple[list[dict[str, str]], dict[str, list[str]]]:
        """Terms of one index token, as maps from tokens that are different in each; and the terms that are phrases."""
        layers: list[dict[str, str]] = []
        phrases: dict[str, list[str]] = {}
        for t in terms:
            p = phrase(t)
            if len(p) > 1:
                phrases[t] = p
            elif p:
                layer = next((x for x in layers if p[0] not in x), None)
                if layer is None:
                    layers.append(layer := {})
                layer[p[0]] = t
        return layers, phrases

    def frequencies(self, terms: list[str], blocks: dict[int, list[int]] | None = None) -> DataFrame:
        """(chunk_id, meeting_id, dl, q, tf, part, block): how often each query term is in a chunk; a phrase by its places."""
        layers, phrases = self._layers(terms)
        shown = ("chunk_id", "meeting_id", "dl", "q", "tf", "part", "block")
        parts = []
        for layer in layers:
            of = F.element_at(F.create_map(*[F.lit(x) for kv in layer.items() for x in kv]), F.col("term"))
            parts.append(self._of(list(layer), "rows", blocks).withColumn("q", of).select(*shown))
        for t, p in phrases.items():
            found = self._of(p[:1]).select("chunk_id", "meeting_id", "dl", "part", "block", F.col("pos").alias("starts"))
            for k, word in enumerate(p[1:], 1):
                nxt = self._of([word]).select("chunk_id", "meeting_id", F.transform("pos", (lambda k: lambda x: x - k)(k)).alias("next"))
                found = found.join(nxt, ["meeting_id", "chunk_id"]).withColumn("starts", F.array_intersect("starts", "next")).drop("next")
            parts.append(found.withColumns({"q": F.lit(t), "tf": F.size("starts").cast("long")}).where("tf > 0").select(*shown))
        if not parts:
            return self.parts[0].rows.withColumns({"q": F.col("term"), "part": F.lit(0)}).select(*shown).where(F.lit(False))
        return reduce(DataFrame.unionByName, parts)

    def statistics(self, terms: list[str]) -> Statistics:
        """By one small job over the blocks of the terms; phrases are counted in their rows."""
        layers, phrases = self._layers(terms)
        parts = []
        for layer in layers:
            of = F.element_at(F.create_map(*[F.lit(x) for kv in layer.items() for x in kv]), F.col("term"))
            parts.append(self._of(list(layer), "heads").select(of.alias("q"), "n"))
        if phrases:
            parts.append(self.frequencies(list(phrases)).select("q", F.lit(1).cast("long").alias("n")))
        whole = self.totals.select(F.lit(None).cast("string").alias("q"), "n_rows", "dl")
        rows = reduce(DataFrame.unionByName, parts).groupBy("q").agg(F.sum("n").alias("n_rows"), F.lit(0).cast("long").alias("dl")) if parts else None
        all_ = whole.groupBy("q").agg(F.sum("n_rows").alias("n_rows"), F.sum("dl").alias("dl"))
        got = (all_ if rows is None else rows.unionByName(all_)).collect()  # a row a term, and one
        n, dl = next(((r["n_rows"], r["dl"]) for r in got if r["q"] is None), (0, 0))
        return Statistics(dict.fromkeys(terms, 0) | {r["q"]: r["n_rows"] for r in got if r["q"] is not None}, n or 0, (dl or 0) / n if n else 1.0)

    @staticmethod
    def _summed(x: DataFrame, part: Column, any_: list[str], strict: list[str]) -> list[Column]:
        inside = lambda ts: F.col("q").isin(ts)
        return [
            total(part, inside(any_)).alias("r1"),
            total(part, inside(strict)).alias("r0") if strict else F.lit(0.0).alias("r0"),
            F.sum(inside(strict).cast("int")).alias("n0") if strict else F.lit(-1).alias("n0"),
        ]

    def _top(self, x: DataFrame, s: Statistics, any_: list[str], strict: list[str], limit: int, mode: str) -> DataFrame:
        part = s.weight(F.col("q")) * s.score(F.col("tf"), F.col("dl"))
        per = x.groupBy("chunk_id", "meeting_id").agg(*self._summed(x, part, any_, strict))
        per = per.withColumn("stage", F.when(F.col("n0") == len(strict), 0).otherwise(1)).withColumn("rank", -F.when(F.col("stage") == 0, F.col("r0")).otherwise(F.col("r1")))
        per = per.where("stage = 0") if mode == "all" else per.where((F.col("stage") == 0) | (F.col("r1") > 0))
        return per.select("chunk_id", "meeting_id", "rank", "stage").orderBy("stage", "rank", "chunk_id").limit(limit)

    def _choose(self, s: Statistics, any_: list[str], strict: list[str], limit: int, mode: str) -> tuple[DataFrame, Column] | None:
        """Blocks with their bounds, and which of them can hold a row of the top; None if all of them can.

        The blocks of the greatest bounds are scored first: the last row of their top is the threshold. A block counts
        if its bound reaches it, so that ties are seen; a strict hit stands before all others, so with strict terms the
        blocks that have all of them count unless the threshold is strict itself.
        """
        layers, _ = self._layers(list(dict.fromkeys(any_ + strict)))
        heads = []
        for layer in layers:
            of = F.element_at(F.create_map(*[F.lit(x) for kv in layer.items() for x in kv]), F.col("term"))
            heads.append(self._of(list(layer), "heads").where("block >= 0").select(of.alias("q"), "part", "block", "max_tf", "min_dl"))
        x = reduce(DataFrame.unionByName, heads)
        bound = s.weight(F.col("q")) * s.score(F.col("max_tf"), F.col("min_dl"))
        blocks = x.groupBy("part", "block").agg(*self._summed(x, bound, any_, strict))
        full = F.col("n0") == len(strict)
        blocks = blocks.where(full) if mode == "all" else blocks
        first = blocks.orderBy(full.desc(), F.when(full, F.col("r0")).otherwise(F.col("r1")).desc(), "part", "block").limit(SEEDS).collect()
        if not first:
            return None
        got = self._top(self.frequencies(list(dict.fromkeys(any_ + strict)), _by_part(first)), s, any_, strict, limit, mode).collect()  # `limit` rows
        if len(got) < limit:
            return None
        last = max((r["stage"], r["rank"]) for r in got)
        reach = -last[1] * (1 - 1e-9)  # rounding must not hide a tie
        return blocks, (full & (F.col("r0") >= reach) if last[0] == 0 else full | (F.col("r1") >= reach))

    def ranked(self, query: str, limit: int = 10, meeting_id=None, mode: str = "cascade") -> DataFrame:
        """(chunk_id, meeting_id, rank, stage, position), as `search.ranked` over the rows has them."""
        any_, strict = q.any_terms(query), [] if mode == "any" else q.query_tokens(query) if mode == "all" else q.all_terms(query)
        terms = list(dict.fromkeys(any_ + strict))
        order = Window.orderBy("stage", "rank", "chunk_id")  # over `limit` rows
        if not terms or not self.parts:
            return self.totals.select(*[F.lit(0).cast(k).alias(c) for c, k in (("chunk_id", "long"), ("meeting_id", "long"), ("rank", "double"), ("stage", "int"), ("position", "int"))]).where(F.lit(False))
        s = self.statistics(terms)
        x = None
        if meeting_id is None and not self._layers(terms)[1] and sum(s.df.values()) > self.few and limit <= self.few:
            found = self._choose(s, any_, strict, limit, mode)
            if found is not None:
                chosen = found[0].where(found[1]).select("part", "block")
                some = chosen.limit(LITERALS + 1).collect()
                if len(some) <= LITERALS:
                    x = self.frequencies(terms, _by_part(some))
                else:
                    x = self.frequencies(terms).join(chosen, ["part", "block"], "left_semi")
        x = self.frequencies(terms) if x is None else x
        if meeting_id is not None:
            x = x.where(F.col("meeting_id") == F.lit(meeting_id))
        return self._top(x, s, any_, strict, limit, mode).withColumn("position", F.row_number().over(order))

    def cost(self, query: str, limit: int = 10, mode: str = "cascade") -> tuple[int, int]:
        """(blocks that `ranked` reads, blocks of the query's terms), whatever its number of postings."""
        any_, strict = q.any_terms(query), [] if mode == "any" else q.query_tokens(query) if mode == "all" else q.all_terms(query)
        found = self._choose(self.statistics(list(dict.fromkeys(any_ + strict))), any_, strict, limit, mode)
        every = reduce(DataFrame.unionByName, [self._of(list(x), "heads") for x in self._layers(any_ + strict)[0]]).where("block >= 0").select("part", "block").distinct().count()
        return (every if found is None else found[0].where(found[1]).count()), every

    def hits(self, chunks: DataFrame, query: str, limit: int = 10, meeting_id=None, mode: str = "cascade") -> DataFrame:
        """The hits with the columns of their chunks."""
        return lookup(chunks, self.ranked(query, limit, meeting_id, mode), limit)

    def meetings(self, name: str) -> DataFrame:
        """Ids of the meetings that mention any term of a name."""
        return self.frequencies(q.any_terms(name)).select("meeting_id").distinct()

    # ---- many queries

    def batch(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, chunk_id, meeting_id, rank, stage, position): the cascade's top of every (query_id, query) at once.

        Postings of the queries' terms, with their share of a score, are dealt by parts of the chunks, queries by parts of
        the queries; a cell of both finds its best rows by itself, so no pair of a query and a chunk is shuffled, only
        `limit` rows a query and part of the chunks are. A null query has no terms.
        """
        parts = self.parts
        t = terms_of(queries)
        tokens = t.select(F.explode(F.array_union("anyof", "strict")).alias("q")).distinct().withColumn("parts", index_tokens("q"))
        single, phrases = tokens.where(F.size("parts") == 1).select("q", F.col("parts")[0].alias("term")), tokens.where(F.size("parts") > 1)
        rows = reduce(DataFrame.unionByName, [p.rows for p in parts])
        heads = reduce(DataFrame.unionByName, [p.heads for p in parts])
        df = heads.join(single, "term").groupBy("q", "term").agg(F.sum("n").alias("df"))
        x = rows.select("term", "chunk_id", "meeting_id", "tf", "dl").join(df, "term").select("q", "df", "chunk_id", "meeting_id", "tf", "dl")
        # a phrase starts where each of its parts stands at its place
        at = phrases.select("q", F.size("parts").alias("size"), F.posexplode("parts").alias("k", "term"))
        starts = rows.select("term", "chunk_id", "meeting_id", "dl", "pos").join(at, "term").select("q", "size", "chunk_id", "meeting_id", "dl", F.explode(F.transform("pos", lambda p: p - F.col("k"))).alias("start"))
        found = starts.groupBy("q", "size", "chunk_id", "meeting_id", "dl", "start").count().where(F.col("count") == F.col("size"))
        found = found.groupBy("q", "chunk_id", "meeting_id", "dl").agg(F.count("*").alias("tf"))
        x = x.unionByName(found.join(found.groupBy("q").agg(F.count("*").alias("df")), "q"))
        size = self.totals.agg(F.sum("n_rows").alias("n"), F.sum("dl").alias("dl")).first()
        n, avgdl = size["n"] or 0, (size["dl"] or 0) / size["n"] if size["n"] else 1.0
        raw = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw) * Statistics({}, n, avgdl).score(F.col("tf"), F.col("dl"))
        blocks = max(CELL_BLOCKS, sized(size["dl"] or 0, CELL_TOKENS, MAX_SLICES))
        slices = max(1, CELLS // blocks)
        all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        block, slice_ = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)), F.pmod(F.xxhash64("query_id"), F.lit(slices))
        sent = x.withColumn("slice", all_of(slices)).select((block * slices + F.col("slice")).cast("int").alias("cell"), F.col("q").alias("term"), "chunk_id", "meeting_id", F.rint(part * UNIT).cast("long").alias("part"))
        asked = t.where(F.size("anyof") > 0).withColumn("block", all_of(blocks)).select((F.col("block") * slices + slice_).cast("int").alias("cell"), "query_id", "anyof", "strict")
        dealt = sent.unionByName(asked, allowMissingColumns=True).repartitionById(blocks * slices, F.col("cell"))
        best = dealt.sortWithinPartitions("cell", F.col("term").isNull()).mapInArrow(topk.cells(limit), f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id long, meeting_id long, stage int, score long")
        own = Window.partitionBy("query_id").orderBy("stage", "rank", "chunk_id")
        best = best.withColumn("rank", -(F.col("score") / F.lit(UNIT)))
        return best.select("query_id", "chunk_id", "meeting_id", "rank", "stage", F.row_number().over(own).alias("position")).where(F.col("position") <= limit)


def _by_part(rows) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["part"], []).append(r["block"])
    return out


def terms_of(queries: DataFrame) -> DataFrame:
    """(query_id, anyof, strict): terms of queries as columns, by the rules of `querytext`."""
    words = F.regexp_extract_all(casefold(F.coalesce(F.col("query").cast("string"), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(sorted(q.STOPWORDS)))
    t = queries.select("query_id", F.slice(F.array_distinct(kept), 1, q.MAX_TOKENS).alias("tokens"))

    def variants(w: Column) -> Column:
        stem = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
        case = lambda n, ends: F.array(w, *[F.concat(stem(n), F.lit(e)) for e in ends])
        cyrillic = F.rlike(w, F.lit("[а-яё]"))
        return F.when(cyrillic & w.endswith("ия") & (F.length(w) > 4), case(2, ("ии", "ию", "ией"))).when(cyrillic & w.endswith("а") & (F.length(w) > 3), case(1, ("ы", "е", "у", "ой"))).otherwise(F.array(w))

    anyof = F.slice(F.array_distinct(F.flatten(F.transform("tokens", variants))), 1, q.MAX_TOKENS)
    strict = F.when(F.size("tokens").between(q.STRICT_MIN, q.STRICT_MAX), F.col("tokens")).otherwise(F.array().cast("array<string>"))
    return t.select("query_id", anyof.alias("anyof"), strict.alias("strict"))


class StoredIndex(Postings):
    """An index of one part, and its clustered chunks, in a folder."""

    def __init__(self, spark: SparkSession, path: str, few: int = FEW):
        self.spark, self.path, self.few = spark, path.rstrip("/"), few

    def build(self, chunks: DataFrame, fields=INDEXED) -> StoredIndex:
        clustered(chunks).write.mode("overwrite").parquet(f"{self.path}/chunks")
        n = self.chunks.count()
        buckets = write_parts(term_rows(self.chunks, fields), self.path, n)
        written_lengths(self.spark, self.path, n).write.mode("overwrite").parquet(f"{self.path}/lengths")
        self.parts = [Part(self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings"), self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks"), buckets)]
        return self

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    @property
    def totals(self) -> DataFrame:
        return self.spark.read.schema(LENGTHS).parquet(f"{self.path}/lengths")
