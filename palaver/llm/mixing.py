"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import names, numbered, staged

#: The weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_REPEATS = 1.5, 2
#: Blocks that the mix of one class of sources is cut into at least, over all its shards, and blocks a source of it.
#: The targets of a class lie within a factor of 16, so the smallest source of a class wins some 50 blocks or more.
BLOCKS, SOURCE_BLOCKS, SHARDS, SEED = 16_000, 800, 16, 7
#: More sources than this are not broadcast.
BROADCAST_SOURCES = 20_000


def _key(text: F.Column, id_: F.Column) -> F.Column:
    """The seeded place of a document in its source; rows without an id of their own lie apart by their texts."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _words(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(id, source, size, key): words of every whole text and the seeded place of the document in its source."""
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").cast("string").alias("source"),
        _words("text").alias("size"),
        _key(F.col("text"), F.col("doc_id")).alias("key"),
    )


def targets(base: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target): weighted shares of share * all words, none above MAX_REPEATS * its source.

    Filling up is closed-form: in the order of limit / weight, a source is full exactly if its limit is below what
    the words left over then give it. One row a source; only this table of totals is ordered in one task.
    """
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = len(weights)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % k + 1).cast("int"))
    w = sizes.withColumn("w", weight).withColumn("cap", (F.lit(MAX_REPEATS) * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("wleft", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", F.col("left") / F.col("wleft"))
    w = w.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)  # the first source that is not full
    return w.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def quotas(wanted: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, source_blocks: int = SOURCE_BLOCKS) -> DataFrame:
    """(source, source_size, target, block, quotas): Sainte-Laguë seats of each source, one integer a shard.

    Sources are apportioned among those whose targets have as many hexadecimal digits, each class with blocks of its
    own size: so a source of a few words beside one of billions still comes near its target. In a class the seats are
    ranked by quotient target / (2 i - 1); a highest-quotient method hands out seats one after another whatever their
    number, so seats 1..B/S are shard 0's quotas, the next B/S shard 1's, and so on. A source can only win seats up to
    target / total * (blocks + sources / 2) + 1, so about blocks + sources quotients are ranked in a class, whatever
    the size of the corpus; a class is one window partition.
    """
    t = wanted.withColumn("class", F.length(F.hex(F.floor("target").cast("long"))))
    own = Window.partitionBy("class").orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("target").over(own)).withColumn("n", F.count("*").over(own))
    t = t.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("total") / F.greatest(F.lit(blocks), source_blocks * F.col("n")))).cast("long"))
    t = t.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    most = F.ceil(F.col("target") / F.col("block") * (1 + F.col("n") / (2 * F.greatest(F.col("seats"), F.lit(1))))).cast("int") + 1
    # a source holds at most MAX_REPEATS times its blocks
    most = F.least(most, (MAX_REPEATS * F.ceil(F.col("source_size") / F.col("block"))).cast("int"))
    q = t.where("target > 0").select("source", "class", "seats", "target", F.explode(F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).alias("i"))
    ranked = q.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy((F.col("target") / (2 * F.col("i") - 1)).desc(), F.col("source").asc_nulls_last(), "i")))
    won = ranked.where("rank <= seats").withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((rank - 1) * {shards}) div seats")).cast("int"))
    per = won.groupBy("source", "shard").agg(F.count("*").alias("q")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("shard", "q"))).alias("q"))
    out = t.alias("t").join(per.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")), "left")
    q0 = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.col("q")[s.cast("int")], F.lit(0)).cast("long"))
    return out.select("t.source", "source_size", "target", "block", F.coalesce(q0, F.array_repeat(F.lit(0).cast("long"), shards)).alias("quotas"))


def _few(quota: DataFrame) -> DataFrame:
    """The table of sources, to be broadcast where it is small."""
    return F.broadcast(quota) if quota.count() <= BROADCAST_SOURCES else quota


def streams(base: DataFrame, quota: DataFrame) -> DataFrame:
    """Rows (row, id, source, size, key) with the words before them in their source and what their source takes.

    Adds start, source_size, target, block, quotas, quota (blocks won), passes, cut and extra: the stream of a source is taken
    `passes` times and its first `cut` words once more, of this document `extra`. The word's place in the stream comes
    from prefix sums in two steps: totals of (source, first 3 digits of the key), then sums inside each of these parts;
    a source with most of the rows is spread over 4096 parts.
    """
    base = base.withColumn("part", F.substring("key", 1, 3))
    sums = base.groupBy("source", "part").agg(F.sum("size").alias("s"))
    sums = sums.select("source", "part", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    # rows of equal keys have equal texts, so their order changes no result
    inside = Window.partitionBy("source", "part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    inner = base.withColumn("end", F.sum("size").over(inside)).alias("d")
    rows = inner.join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.part") == F.col("s.part"))).select("d.*", (F.col("s0") + F.col("end") - F.col("size")).alias("start"))
    rows = rows.alias("r").join(_few(quota).alias("q"), F.col("r.source").eqNullSafe(F.col("q.source"))).select("r.*", "q.source_size", "q.target", "q.block", "q.quotas")
    rows = rows.withColumn("quota", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("n", F.expr("(source_size + block - 1) div block"))
    rows = rows.withColumn("quota", F.least("quota", MAX_REPEATS * F.col("n")))
    rows = rows.withColumn("passes", F.expr("coalesce(quota div nullif(n, 0), 0)")).withColumn("cut", F.expr("coalesce(quota % nullif(n, 0), 0) * block"))
    return rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("cut")) - F.col("start")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """How many words of each row the mix takes: (doc_id, size, source_size, target, taken, quota, first_shard).

    A source's documents stand in a seeded order (md5 of seed, id and text), their words form one stream, and the
    stream is cut into equal blocks. A quota of q blocks out of n takes every block q div n times and the first q mod n
    blocks of that seeded order once more. So a document is taken 0, 1 or 2 times, or, for the one at the cut, with its
    first words once more than with the rest. quota is the blocks its source won, first_shard the shard whose quota
    takes the document's first word first, null if nothing is taken.

    Null text: 0 words. Null source: a source of its own, last. Rows with null or repeated ids are rows like others.
    A source without words has target 0. An empty table gives no rows.
    """
    base = numbered(sized(docs), "mix-base")
    quota = staged(quotas(targets(base, weights, share), blocks, shards), "mix-quotas")
    rows = streams(base, quota).withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long"))
    upto = F.aggregate("quotas", F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("i")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["i"] + F.when(F.expr("start div block") >= a["s"] + x, 1).otherwise(0)).alias("i")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "quota", F.when(F.col("taken") > 0, upto["i"]).cast("int").alias("first_shard"))


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """The documents of the mix themselves: whole copies, and for the one at a source's cut its first words once more.

    Returns the columns of `docs`; n_chars, where there is one, follows the text. What a row contributes depends on
    whether it stands before, at or after its source's cut, so texts are not shuffled: the cuts, one a source, go to them.
    Texts without words are never taken.
    """
    own = names(docs)
    # one row number for sizes and texts alike
    docs = numbered(docs.select(*own, _key(F.col("text"), F.col("doc_id")).alias("__key")), "mix-docs", "__row")
    base = staged(docs.select(F.col("__row").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), _words("text").alias("size"), F.col("__key").alias("key")), "mix-base")
    quota = staged(quotas(targets(base, weights, share), blocks, shards), "mix-quotas")
    last = F.max(F.when(F.col("start") < F.col("cut"), F.struct("key", "row", "extra", (F.col("extra") == F.col("size")).alias("whole"))))
    cuts = staged(streams(base, quota).groupBy("source").agg(F.max("passes").alias("__passes"), last.alias("__last")), "mix-cuts").withColumnRenamed("source", "__source")
    kept = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(_few(cuts), F.col("source").cast("string").eqNullSafe(F.col("__source")))
    place, at = F.struct("__key", "__row"), F.struct(F.col("__last.key").alias("__key"), F.col("__last.row").alias("__row"))
    once_more = F.coalesce((place < at) | ((place == at) & F.col("__last.whole")), F.lit(False))
    part = F.when((place == at) & ~F.col("__last.whole"), F.col("__last.extra")).otherwise(F.lit(0))
    times = F.array_repeat(F.lit(0).cast("long"), (F.col("__passes") + once_more.cast("int")).cast("int"))
    out = kept.withColumn("__part", F.explode(F.when(part > 0, F.concat(times, F.array(part))).otherwise(times)))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__part") > 0, F.concat_ws("", F.slice(words, F.lit(1), F.greatest(F.col("__part"), F.lit(1)).cast("int")))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__part") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own)
