"""Exact dedup over a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_totals, numbered, partitions, staged

#: Live digests that one task keeps; older ones are deleted from its index and passed on.
MAX_LIVE = 200_000
BLANKS = " \t\n\x0b\x0c\r"


class CuckooIndex:
    """Digests of live entries: a cuckoo filter in front of buckets of whole digests.

    The filter holds a 16-bit fingerprint in one of two buckets of four slots; the second bucket is the first one
    xor a hash of the fingerprint, so entries move without the key. A miss is certain. A hit is verified against the
    whole digests of the key's content bucket. Deleting takes one copy of the fingerprint out again. When an insertion
    finds no place after `kicks` moves, the table doubles and is filled anew from the stored digests.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 1024, kicks: int = 200):
        self.kicks, self.size = kicks, 0
        self.content: dict[int, dict[bytes, object]] = {}
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.table = [0] * (self.buckets * self.SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[:2], "big") or 1
        one = int.from_bytes(key[2:10], "big") & (self.buckets - 1)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ ((fp * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def _put(self, key: bytes) -> bool:
        fp, one, two = self._places(key)
        table, n = self.table, self.SLOTS
        for b in (one, two):
            for s in range(b * n, b * n + n):
                if not table[s]:
                    table[s] = fp
                    return True
        b = two
        for turn in range(self.kicks):
            s = b * n + (turn * 7 + fp) % n
            fp, table[s] = table[s], fp
            b = self._other(b, fp)
            for s in range(b * n, b * n + n):
                if not table[s]:
                    table[s] = fp
                    return True
        return False

    def _resize(self) -> None:
        self.resizes += 1
        size = self.buckets * 2
        while True:
            self._empty(size)
            if all(self._put(k) for bucket in self.content.values() for k in bucket):
                return
            size *= 2

    def may_hold(self, key: bytes) -> bool:
        fp, one, two = self._places(key)
        n = self.SLOTS
        return fp in self.table[one * n : one * n + n] or fp in self.table[two * n : two * n + n]

    def get(self, key: bytes):
        """The live entry of exactly this digest, or None."""
        if not self.may_hold(key):
            return None
        return self.content.get(int.from_bytes(key[-3:], "big"), {}).get(key)

    def insert(self, key: bytes, entry) -> None:
        """Make a digest live; an entry it already has is replaced."""
        bucket = self.content.setdefault(int.from_bytes(key[-3:], "big"), {})
        known = key in bucket
        bucket[key] = entry
        if not known:
            self.size += 1
            if self.size > self.buckets * self.SLOTS * 0.95 or not self._put(key):
                self._resize()

    def delete(self, key: bytes) -> bool:
        """Take a live digest out; False if it was not live."""
        home = int.from_bytes(key[-3:], "big")
        bucket = self.content.get(home)
        if not bucket or key not in bucket:
            return False
        del bucket[key]
        if not bucket:
            del self.content[home]
        fp, one, two = self._places(key)
        for b in (one, two):
            for s in range(b * self.SLOTS, b * self.SLOTS + self.SLOTS):
                if self.table[s] == fp:
                    self.table[s] = 0
                    self.size -= 1
                    return True
        raise AssertionError("a live digest has no fingerprint")

    def __len__(self) -> int:
        return self.size


_FIELDS = ("digest", "chars", "id", "row", "n")


def _rank(entry: tuple) -> tuple:
    """What stays comes first: most code points, then the least id, null last, then the least row number."""
    chars, i, row, _ = entry
    return -chars, i is None, i or 0, row


def _merge(batches: Iterator[pa.RecordBatch], max_live: int = MAX_LIVE) -> Iterator[pa.RecordBatch]:
    """Rows (digest, chars, id, row, n) to one row a digest, as far as the index reaches: best row and number of rows."""
    index = CuckooIndex()
    order: list[bytes] = []
    head = 0

    def batch(keys: list[bytes]) -> pa.RecordBatch:
        got = [index.get(k) for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([g[c] for g in got], pa.int64()) for c in range(4))], list(_FIELDS))

    for b in batches:
        for key, *entry in zip(*(b.column(k).to_pylist() for k in _FIELDS), strict=True):
            live = index.get(key)
            if live is None:
                index.insert(key, tuple(entry))
                order.append(key)
            else:
                best = min(live, entry, key=_rank)
                index.insert(key, (*best[:3], live[3] + entry[3]))
            if len(index) > max_live:
                old, head = order[head : head + max_live // 4], head + max_live // 4
                yield batch(old)
                for k in old:
                    index.delete(k)
                if head > max_live:
                    del order[:head]
                    head = 0
    if head < len(order):
        yield batch(order[head:])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chars, digest): code points of the whole text, sha256 of the text without blanks; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"))


def exact_groups(base: DataFrame) -> DataFrame:
    """(digest, chars, id, row, n): the row that stays of each digest and the number of rows.

    Each task first merges its own rows in a bounded index, so a group with a third of all rows reaches the shuffle as
    one row a task. After the shuffle the rows come sorted by digest, so a digest that the index lets go never returns.
    """
    schema = "digest binary, chars long, id long, row long, n long"
    part = base.select("digest", "chars", "id", "row", F.lit(1).cast("long").alias("n")).mapInArrow(_merge, schema)
    return part.repartition(partitions(base.sparkSession), "digest").sortWithinPartitions("digest").mapInArrow(_merge, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, keep_id, group_size, kept, text_sha256).

    Of texts that are equal without blanks, the one with the most code points stays, then the smallest id; a null id
    comes after all others. One row of a group is kept: rows that repeat id and text are rows of the group, each
    counted, and one of them stays if they are to. Null texts and empty texts are equal. An empty table gives no rows.
    """
    base = numbered(digests(docs, id_col, text_col), "exact-base")
    groups = exact_groups(base).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    joined = join_totals(base, staged(groups, "exact-groups"), "digest", "n")
    return joined.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
