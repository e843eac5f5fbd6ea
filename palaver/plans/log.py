"""Small tables that users change: append-only logs, merged when read, folded now and then."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries after which a reader would have too many folders to open; the next write folds them.
FOLD = 16


class Conflict(RuntimeError):
    """Another writer published first."""


class Log:
    """A table below `path` as a list of numbered entries. Each names a folder of changed rows; of the rows of a key the
    newest entry's counts (`keep` last), or the oldest's (first), and a row marked deleted ends its key. A writer adds a
    folder and then takes the next free number, so of two writers at once both changes stay; one that has read the table
    and depends on it can insist on the number it has seen. Rows under `loose` have no key and all stay."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], keep: str = "last", loose: str | None = None):
        self.spark, self.path, self.schema, self.key, self.keep, self.loose = spark, path.rstrip("/"), schema, key, keep, loose

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path
        return where, where(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> list[tuple[int, dict]]:
        """The entries that count, oldest first: from the newest fold on."""
        where, fs = self._fs()
        folder = where(f"{self.path}/entries")
        if not fs.exists(folder):
            return []
        out = []
        for name in sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True):
            stream = fs.open(where(folder, name))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                out.append((int(name), json.loads(text)))
            except ValueError:  # still being written
                continue
            if out[-1][1]["fold"]:
                break
        return out[::-1]

    def version(self) -> int:
        entries = self._entries()
        return entries[-1][0] if entries else 0

    def _publish(self, folder: str, fold: bool, expected: int | None) -> int:
        where, fs = self._fs()
        n = self.version() if expected is None else expected
        while True:
            try:
                out = fs.create(where(f"{self.path}/entries/{n + 1:012d}"), False)
            except Py4JJavaError as e:
                if not fs.exists(where(f"{self.path}/entries/{n + 1:012d}")):
                    raise
                if expected is not None:
                    raise Conflict(f"entry {n + 1} was published meanwhile") from e
                n += 1
                continue
            out.write(bytearray(json.dumps({"folder": folder, "fold": fold}).encode()))
            out.close()
            return n + 1

    def append(self, rows: DataFrame, deleted: Column | None = None, expected: int | None = None) -> int:
        """Publish changed rows; the entry's number. With `expected` it must follow that entry, or Conflict is raised."""
        folder = f"c{uuid.uuid4().hex[:12]}"
        rows.select(*self._columns(), (F.lit(False) if deleted is None else deleted).alias("deleted")).write.parquet(f"{self.path}/{folder}")
        n = self._publish(folder, False, expected)
        if len(self._entries()) > FOLD:
            self.fold()
        return n

    def _columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _all(self, entries: list[tuple[int, dict]]) -> DataFrame:
        """Rows of all entries with `entry`; a fold's rows keep those they had."""
        out = None
        for n, e in entries:
            schema = f"{self.schema}, deleted boolean" + (", entry long" if e["fold"] else "")
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{e['folder']}")
            rows = rows if e["fold"] else rows.withColumn("entry", F.lit(n).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key, by one shuffle of the changes; a legacy id once known stays."""
        loose = F.coalesce(F.expr(self.loose), F.lit(False)) if self.loose else F.lit(False)
        w = Window.partitionBy(*self.key)
        order = F.col("entry").desc() if self.keep == "last" else F.col("entry")
        kept = rows.where(~loose)
        if "legacy_id" in rows.columns:
            kept = kept.withColumn("legacy_id", F.coalesce("legacy_id", F.max("legacy_id").over(w)))
        # equal keys of one entry: the greatest row, so that reads agree
        kept = kept.withColumn("nth", F.row_number().over(w.orderBy(order, F.xxhash64(*rows.columns)))).where("nth = 1").drop("nth")
        return kept.unionByName(rows.where(loose)) if self.loose else kept

    def read(self) -> DataFrame:
        entries = self._entries()
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self._all(entries)).where(~F.col("deleted")).select(*self._columns())

    def fold(self) -> None:
        """Write what is read as one entry, dealt by key; if another entry came meanwhile, it stays as it is."""
        entries = self._entries()
        if len(entries) > 1:
            folder = f"f{uuid.uuid4().hex[:12]}"
            self._merged(self._all(entries)).repartition(*self.key).write.parquet(f"{self.path}/{folder}")
            try:
                self._publish(folder, True, entries[-1][0])
            except Conflict:
                return
