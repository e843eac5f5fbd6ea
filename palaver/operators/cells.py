"""Exact nearest neighbours over stored vectors: cells around pivots, skipped by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import any_of
from .vectors import nearest

#: Pivots of a vector table: a sample of bounded size, so that pivots and bounds of cells fit the driver at any scale.
PIVOTS = 256
#: A cell's vectors, by their distance from its pivot, and what its rows span.
HEADS = "cell int, n long, least double, most double"
#: Cells of which the first threshold is taken.
FIRST = 4


def pivots_of(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """At most `most` different vectors, those with the least hashes."""
    rows = vectors.where("vector IS NOT NULL").select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(most).collect()
    return np.array([r["vector"] for r in rows], float)


def placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with `cell`, their nearest pivot, and `r`, its distance; null vectors and those of another length go."""
    rows = vectors.where(F.size("vector") == (pivots.shape[1] if pivots.size else -1))
    at, names, square = rows.columns.index("vector"), [*rows.columns, "cell", "r"], (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                cell = ((square - 2 * x @ pivots.T)).argmin(1)
                r = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(r)], names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int, r double")


def write(rows: DataFrame, path: str) -> None:
    """Placed rows in the order (cell, r), so that a range of a cell is a range of a file; and the cells' bounds."""
    spark = rows.sparkSession
    rows.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").write.mode("overwrite").parquet(path)
    heads = spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most"))
    heads.coalesce(1).write.mode("overwrite").parquet(f"{path}-cells")


def bounds(pivots: np.ndarray, query: list[float], heads: list) -> list[tuple[float, float, int, int]]:
    """(least possible distance, distance of the pivot, cell, rows) of each cell, nearest first; rows of one cell add up."""
    d = np.sqrt(((pivots - np.array(query, float)) ** 2).sum(1)) if heads else None
    cells: dict[int, tuple[float, float, int]] = {}
    for h in heads:
        low, high, n = cells.get(h["cell"], (np.inf, 0.0, 0))
        cells[h["cell"]] = (min(low, h["least"]), max(high, h["most"]), n + h["n"])
    return sorted((max(0.0, float(d[c]) - high, low - float(d[c])), float(d[c]), c, n) for c, (low, high, n) in cells.items())


def within(cells: list[tuple[float, float, int, int]], reach: float):
    """The rows that can be at most `reach` away, as a filter that files' statistics answer."""
    some = []
    for least, d, c, _ in cells:
        slack = 1e-9 * (1 + d + reach)  # distances are rounded
        if least <= reach + slack:
            some.append((F.col("cell") == c) & F.col("r").between(d - reach - slack, d + reach + slack))
    return any_of(some)


def search(rows: DataFrame, heads: DataFrame, pivots: np.ndarray, query: list[float], limit: int = 10, key: str = "chunk_id") -> DataFrame:
    """(key, distance, position): the exact `limit` nearest, as `vectors.nearest` over all rows finds them.

    The nearest cells give a first threshold; then only rows whose distance from their pivot lets them come as near are
    read, of cells that can hold any. Rows that heads count but `rows` lacks (deleted ones) only widen the search.
    """
    cells = bounds(pivots, query, heads.collect())  # at most PIVOTS rows a segment
    first, seen = [], 0
    for c in cells:
        first.append(c)
        seen += c[3]
        if len(first) >= FIRST and seen >= 2 * limit:
            break
    got = nearest(rows.where(any_of(F.col("cell") == c[2] for c in first)), query, limit, key).collect() if first else []  # `limit` rows
    if len(got) < limit:
        return nearest(rows, query, limit, key)
    return nearest(rows.where(within(cells, max(r["distance"] for r in got))), query, limit, key)


def read(rows: DataFrame, heads: DataFrame, pivots: np.ndarray, query: list[float], reach: float) -> int:
    """How many rows `search` reads for a threshold."""
    return rows.where(within(bounds(pivots, query, heads.collect()), reach)).count()


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
