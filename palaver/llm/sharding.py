"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import names, numbered, staged

SHARDS = 16
#: A group of equal texts stays in one shard unless it is larger than this share of a shard's target.
WHOLE_GROUP_SHARE = 0.02
#: Rows that one partition of the global order should hold; the order has a partition for each of 16 ** digits prefixes.
PART_ROWS, MAX_DIGITS = 50_000, 4


def _digits(rows: F.Column, least: int) -> F.Column:
    """Digits of a digest that deal so many rows into partitions of PART_ROWS."""
    out = F.lit(MAX_DIGITS)
    for k in range(MAX_DIGITS - 1, least - 1, -1):
        out = F.when(rows <= PART_ROWS * 16**k, k).otherwise(out)
    return out


def placed(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, size, crc, shard, nth): the shard and the place in the global order of every row of `docs`.

    Where `docs` has a column __row, that number tells its rows apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    base = docs.select(row.alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("t"))
    base = staged(base, "shard-base").withColumn("d", F.unhex(F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))))
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = next((k for k in range(2, MAX_DIGITS) if n <= PART_ROWS * 16**k), MAX_DIGITS)
    # at most shards / WHOLE_GROUP_SHARE groups can be that large, so the broadcast is bounded
    hot = base.groupBy("t").agg(F.sum("size").alias("all"), F.count("*").alias("c")).where(F.col("all") > F.lit(WHOLE_GROUP_SHARE * total / shards)).select("t", _digits(F.col("c"), 1).alias("digits"))
    rows = base.join(F.broadcast(hot), "t", "left").withColumn("hot", F.col("digits").isNotNull())
    rows = rows.withColumn("part", F.when(F.col("hot"), F.concat(F.lit("0"), F.hex("t"), F.expr("substring(hex(d), 1, digits)"))).otherwise(F.concat(F.lit("1"), F.substring(F.hex("t"), 1, digits))))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    offsets = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("part").orderBy("t", "d", "id", "row")
    group = Window.partitionBy("part", "t")
    return (
        rows.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("b0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nth", F.col("c0") + F.row_number().over(inside) - 1)
        .withColumn("first", F.when(F.col("hot"), F.col("start")).otherwise(F.min("start").over(group)))
        .withColumn("bytes", F.when(F.col("hot"), F.col("size")).otherwise(F.sum("size").over(group)))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * first + bytes) * {shards}) div (2 * {max(total, 1)}L)")).cast("int"))
        .select("row", "id", "size", "crc", "shard", "nth")
    )


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards of near equal bytes: rows (id, size, text_crc32, law, shard, slot, grown_shard).

    The global order is: rows of large groups of equal texts, then the others; in both by the text's md5, then the
    id's md5, then the id. Prefixes of those digests deal the rows into partitions that follow the order, a large group
    into as many as its rows need; the totals of these partitions, at most 16 ** MAX_DIGITS and as many again for each of
    shards / WHOLE_GROUP_SHARE groups, are summed up first and give every partition the bytes and rows before it. A row
    or a whole small group goes to the shard its middle byte falls into.

    size is the text's UTF-8 bytes plus 1. A null text counts as no bytes and has crc 0, as the empty text. Rows with
    null or repeated ids each get a slot of their own. An empty table gives no rows.
    """
    rows = _slotted(docs.select(id_col, text_col), shards, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slotted(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    rows = staged(placed(docs, shards, id_col, text_col), "shard-placed")
    firsts = rows.groupBy("shard").agg(F.min("nth").alias("nth0"))  # one row a shard
    return rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("nth") - F.col("nth0"))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the columns size, text_crc32, law, shard, slot and grown_shard of `shard`; own columns of these names go."""
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own = [c for c, n in zip(names(docs), docs.columns, strict=True) if n not in added]
    docs = numbered(docs.select(*own), "shard-docs", "__row")
    rows = _slotted(docs, shards, id_col, text_col)
    rows = rows.select(F.col("row").alias("__row"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    return docs.join(rows, "__row").select(*own, *added)
