"""The meeting recorder's SQLite file as a Spark data source, its discovery and its schema check."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tables and the columns they must have; more columns are welcome and become part of fingerprints.
REQUIRED = {
    "meetings": ("id", "title", "created_at", "updated_at", "folder_path"),
    "transcripts": ("id", "meeting_id", "transcript", "timestamp", "audio_start_time", "audio_end_time", "speaker"),
    "summary_processes": ("meeting_id", "result"),
    "meeting_notes": ("meeting_id", "notes_markdown"),
}
_TYPES = {"INTEGER": "bigint", "REAL": "double"}


def connect(path: str | Path) -> sqlite3.Connection:
    """A read-only connection; a missing file is an error, never a new database."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    db = sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True)
    db.row_factory = sqlite3.Row
    return db


def can_open(path: str | Path) -> bool:
    try:
        with connect(path) as db:
            db.execute("select count(*) from sqlite_master").fetchone()
        return True
    except (OSError, sqlite3.Error):
        return False


def columns(path: str | Path, table: str) -> list[tuple[str, str]]:
    with connect(path) as db:
        return [(r["name"], _TYPES.get((r["type"] or "").upper(), "string")) for r in db.execute(f'pragma table_info("{table}")')]


def check_schema(path: str | Path) -> None:
    """Raises ValueError naming the table and its missing columns, sorted."""
    for table, wanted in REQUIRED.items():
        have = {c for c, _ in columns(path, table)}
        if not have:
            raise ValueError(f"recorder schema is unsupported: missing table {table}")
        if missing := sorted(set(wanted) - have):
            raise ValueError(f"recorder schema is unsupported: missing columns {table}.{', '.join(missing)}")


def inspect_schema(path: str | Path) -> tuple[bool, str | None]:
    try:
        check_schema(path)
        return True, None
    except (OSError, ValueError, sqlite3.Error) as e:
        return False, str(e)


def discover(names: tuple[str, ...], file_name: str, env_var: str, env: Mapping[str, str] | None = None, home: Path | None = None) -> Path | None:
    """First existing database: the environment's, then the usual application folders of each platform under `names`."""
    env, home = os.environ if env is None else env, home or Path.home()
    found = [Path(env[env_var]).expanduser()] if env.get(env_var) else []
    roots = [Path(env["XDG_DATA_HOME"])] if env.get("XDG_DATA_HOME") else []
    roots += [Path(env["APPDATA"])] if env.get("APPDATA") else []
    roots += [home / "Library" / "Application Support", home / ".local" / "share", home / "AppData" / "Roaming"]
    found += [r / n / file_name for r in roots for n in names]
    return next((p for p in dict.fromkeys(found) if p.is_file()), None)


class _Table(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    """Row-id ranges of one table; each task opens the file read-only."""

    def __init__(self, path: str, table: str, names: list[str], parts: int):
        self.path, self.table, self.names, self.parts = path, table, names, parts

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [_Table(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Table(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Table) -> Iterator[tuple]:
        with connect(self.path) as db:
            wanted = ", ".join(f'"{c}"' for c in self.names)
            for row in db.execute(f'select {wanted} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high)):
                yield tuple(row)


class RecorderSource(DataSource):
    """`spark.read.format("recorder").option("path", file).option("table", name).load()`"""

    @classmethod
    def name(cls) -> str:
        return "recorder"

    def schema(self) -> str:
        have = columns(self.options["path"], self.options["table"])
        if not have:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c}` {t}" for c, t in have)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("partitions", "1")))


def read(spark: SparkSession, path: str | Path, check: bool = True) -> dict[str, DataFrame]:
    """The four tables of a recorder file."""
    if check:
        check_schema(path)
    spark.dataSource.register(RecorderSource)
    return {t: spark.read.format("recorder").option("path", str(path)).option("table", t).load() for t in REQUIRED}
