"""What the training-data operators share: staged tables, text codes, packed n-grams, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import unicodedata
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palaver-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of `df`: write it as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palaver/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_rows(df: DataFrame, tag: str, count: str = "true") -> tuple[DataFrame, int]:
    """`staged`, and how many of the rows fulfil a condition, counted while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.when(F.expr(count), 1)).alias("n")), tag)
    return out, seen.get["n"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete every staged table of this process; results that still read one of them end here."""
    while _STAGED:
        _delete(spark, _STAGED.pop()[1])


def last_staged() -> int:
    """A mark for `forget`: the tables staged so far."""
    return len(_STAGED)


def forget(since: int, *needed: DataFrame) -> None:
    """Delete the tables staged since a mark but those that `needed` read; for work whose last step is staged itself."""
    read = {f for df in needed for f in df.inputFiles()}
    for spark, path in _STAGED[since:]:
        tag = path.rsplit("/", 1)[1]
        if not any(f"/{tag}/" in f for f in read):
            _STAGED.remove((spark, path))
            _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    if _STAGED:
        spark = _STAGED[-1][0]
        if spark.sparkContext._jsc is not None:
            try:
                release(spark)
            except Exception:  # the JVM is already gone; the folder belongs to the session
                _STAGED.clear()


def numbered(df: DataFrame, tag: str, name: str = "row") -> DataFrame:
    """`df`, staged, with a number of its own for each row: ids may be null or repeated, so they tell no rows apart."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()), tag)


def names(df: DataFrame) -> list[F.Column]:
    """The columns of `df` as they are called, dots and quotes included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows of two or three numbers that are small enough to be broadcast, or to be treated in one task.
LOCAL_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of known size as the side of a join: broadcast up to LOCAL_ROWS, shuffled beyond."""
    return F.broadcast(df) if rows <= LOCAL_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """At most `n` rows, those with the least hash of the key; the same ones on every run.

    Of a large table a hash first lets about 4 n rows pass, so the ordering sees few rows whatever the table's size.
    """
    every = df.count() // (4 * n)
    some = df.where(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(every)) == 0) if every > 1 else df
    return some.orderBy(F.xxhash64(*key), *key).limit(n)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """One integer for each of `n` partitions that repartition(n, column) deals to it, so buckets fall one by one."""
    some = spark.range(40 * n).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p"))
    found = {r["p"]: r["k"] for r in some.groupBy("p").agg(F.min("k").alias("k")).collect()}  # n rows
    return [found.get(p, p) for p in range(n)]


def id_crc(column) -> F.Column:
    """crc32 of the id as text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc_of_id(value) -> int:
    return zlib.crc32(str(value).encode())


def join_totals(rows: DataFrame, totals: DataFrame, key: str, size: str, share: float = 0.001) -> DataFrame:
    """`rows` with the one row of `totals` that each key has; `size` is the key's number of rows.

    Keys with more than `share` of all rows, at most 1 / share of them, are looked up by a broadcast, so a key with a
    third of all rows is never gathered; the others are joined by a shuffle. Both tables should be staged.
    """
    least = totals.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] * share
    large, small = totals.where(F.col(size) > least), totals.where(F.col(size) <= least)
    marked = rows.join(F.broadcast(large.withColumn("__large", F.lit(True))), key, "left")
    rest = marked.where(F.col("__large").isNull()).select(*rows.columns).join(small, key)
    return marked.where("__large").drop("__large").unionByName(rest)


# ---- characters -------------------------------------------------------------------------------------------

_LETTERS = _ALNUM = None


def _is_letter(ch: str) -> bool:
    return ch.isalpha() or unicodedata.category(ch) in ("Mn", "Mc")


class Alphabet:
    """Which code points are kept, and their lower-case codes; the others are spaces.

    Codes have 16 bits. A kept code point beyond 0xFFFF becomes its two UTF-16 surrogates, so no two are confused.
    """

    def __init__(self, keep):
        self.keep = keep
        self.table = np.full(65536, 32, np.uint16)
        for cp in range(65536):
            ch = chr(cp)
            if not 0xD800 <= cp < 0xE000 and keep(ch):
                low = ch.lower()
                self.table[cp] = ord(low) if len(low) == 1 and ord(low) < 65536 else cp

    def beyond(self, cp: int) -> int:
        """Lower-case code point of one beyond 0xFFFF, 32 if it is not kept."""
        ch = chr(cp)
        low = ch.lower()
        return 32 if not self.keep(ch) else ord(low) if len(low) == 1 and ord(low) > 0xFFFF else cp


def letter_table() -> Alphabet:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = Alphabet(_is_letter)
    return _LETTERS


def alnum_table() -> Alphabet:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = Alphabet(str.isalnum)
    return _ALNUM


def codes(text: str, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of `text` with other characters as single spaces, none at either end; and the position of each."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    place = None
    if cp.size and cp.max() > 0xFFFF:
        far, which = np.unique(cp[cp > 0xFFFF], return_inverse=True)
        wide = np.array([alphabet.beyond(c) for c in far.tolist()], np.uint32)[which]
        low = alphabet.table[np.where(cp > 0xFFFF, 32, cp)].astype(np.uint32)
        low[cp > 0xFFFF] = wide
        place = np.repeat(np.arange(cp.size), np.where(low > 0xFFFF, 2, 1))
        units, first = low[place], np.r_[True, place[1:] != place[:-1]]
        pair = units > 0xFFFF
        units[pair & first] = 0xD800 + ((units[pair & first] - 0x10000) >> 10)
        units[pair & ~first] = 0xDC00 + ((units[pair & ~first] - 0x10000) & 0x3FF)
        low = units.astype(np.uint16)
    else:
        low = alphabet.table[cp]
    blank = low == 32
    keep = ~blank
    if keep.size:
        keep[1:] |= ~blank[:-1]
    at = np.nonzero(keep)[0]
    if at.size and blank[at[-1]]:
        at = at[:-1]
    return low[at], at if place is None else place[at]


def blocks(sizes, limit: int):
    """Slices (from, to) of consecutive rows whose sizes add up to about `limit`; a larger row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class KeyProbe:
    """Exact lookup of 64-bit keys in a fixed set: a hashed bitmap turns most away, a sorted array settles the rest."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.sort(keys.astype(np.uint64))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, np.bool_)
        self.seen[self._slot(self.keys)] = True

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `grams` that are keys, and the index of each key in the sorted array."""
        if not self.keys.size or not grams.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.nonzero(self.seen[self._slot(grams)])[0]
        k = np.searchsorted(self.keys, grams[at])
        k[k == self.keys.size] = 0
        hit = self.keys[k] == grams[at]
        return at[hit], k[hit]


# ---- components -------------------------------------------------------------------------------------------


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of its component.

    Every round hooks each root to the smallest root next to it and then halves the paths, so the number of rounds
    grows with the logarithm of a component's diameter. Only counts come to the driver. A node's row is aggregated
    map-side with min(), so a node with very many edges does not gather in one task. Up to LOCAL_ROWS edges are treated
    in one task, which spares the shuffles.
    """
    e, n = staged_rows(edges.select("a", "b").where("a <> b").distinct(), f"{tag}-edges")
    held = lambda df: df.coalesce(1) if n <= LOCAL_ROWS else df
    e = held(e)
    label = held(staged(e.selectExpr("explode(array(a, b)) node").distinct().withColumn("root", F.col("node")), f"{tag}-label"))
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("root").alias("ra")), label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        hooks = e.join(la, "a").join(lb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("hi"), F.least("ra", "rb").alias("lo"))
        parent, left = staged_rows(hooks.groupBy("hi").agg(F.min("lo").alias("up")), f"{tag}-parent")
        if not left:
            return label
        while left:  # pointer jumping among the roots that moved: up < hi always, so there are no cycles
            parent = held(parent)
            p2 = parent.select(F.col("hi").alias("up"), F.col("up").alias("up2"))
            p4 = parent.select(F.col("hi").alias("up2"), F.col("up").alias("up3"))
            far = parent.join(p2, "up", "left").join(p4, "up2", "left")  # two jumps at once
            parent, left = staged_rows(far.select("hi", F.coalesce("up3", "up2", "up").alias("up"), F.col("up3").isNotNull().alias("moved")), f"{tag}-jump", "moved")
            parent = parent.select("hi", "up")
        parent = held(parent)
        label = held(staged(label.join(parent.withColumnRenamed("hi", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{tag}-label"))
