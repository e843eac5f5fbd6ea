"""The best rows of many queries in one cell: the postings of a part of the chunks, and a part of the queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Block:
    """Postings of a cell by term, with the greatest share of each; chunks are numbered in the order of their ids."""

    def __init__(self, rows: pa.Table):
        term = rows["term"].combine_chunks().dictionary_encode()
        (self.chunks, c), (self.meetings, m) = _numbered(rows["chunk_id"]), _numbered(rows["meeting_id"])
        self.pairs, row = np.unique(c * len(self.meetings) + m, return_inverse=True)
        n = len(self.pairs)
        key = term.indices.to_numpy().astype(np.int64) * n + row
        order = np.argsort(key, kind="stable")
        key, part = key[order], rows["part"].combine_chunks().to_numpy()[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.part, self.row = np.add.reduceat(part, first), (key[first] % n).astype(np.int32)
        begin = np.searchsorted(key[first], np.arange(len(term.dictionary) + 1) * n)
        self.span = {t: (a, b) for t, a, b in zip(term.dictionary.to_pylist(), begin[:-1].tolist(), begin[1:].tolist())}
        self.most = dict(zip(self.span, np.maximum.reduceat(self.part, begin[:-1]).tolist()))
        self.sums = np.zeros(n, np.int64)

    def added(self, term: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some chunks have a term, and its share of their scores."""
        a, b = self.span[term]
        at = np.minimum(np.searchsorted(self.row[a:b], rows), b - a - 1)
        has = self.row[a:b][at] == rows
        return has, np.where(has, self.part[a:b][at], 0)

    def strict(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks that have all terms, and their scores."""
        if not terms or any(t not in self.span for t in terms):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        terms = sorted(terms, key=lambda t: self.span[t][1] - self.span[t][0])
        a, b = self.span[terms[0]]
        rows, sums = self.row[a:b], self.part[a:b]
        for t in terms[1:]:
            has, part = self.added(t, rows)
            rows, sums = rows[has], (sums + part)[has]
        return rows, sums

    def any(self, terms: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with some of the terms and their scores: the `limit` best, their ties, and maybe more.

        Terms come by their greatest share. Once `limit` chunks have more than all terms to come can add up to, no new
        chunk can reach them, so those terms are only looked up for the chunks that still can.
        """
        terms = sorted((t for t in terms if t in self.span), key=lambda t: -self.most[t])
        left = sum(self.most[t] for t in terms)
        met, n_met, floor, tried = [], 0, 0, 0
        for k, t in enumerate(terms):
            a, b = self.span[t]
            if n_met >= limit and n_met != tried and 4 * (b - a) > n_met:
                floor, tried = _last(np.concatenate([self.sums[r] for r in met]), limit), n_met
            if left < floor:
                terms = terms[k:]
                break
            rows = self.row[a:b]
            before = self.sums[rows]
            met.append(rows[before == 0])
            self.sums[rows] = before + self.part[a:b]
            n_met, left = n_met + len(met[-1]), left - self.most[t]
        else:
            terms = []
        rows = np.concatenate(met) if met else np.zeros(0, np.int32)
        sums = self.sums[rows]
        self.sums[rows] = 0
        for t in terms:
            can = sums + left >= floor
            rows, sums = rows[can], sums[can]
            sums, left = sums + self.added(t, rows)[1], left - self.most[t]
        return rows, sums

    def top(self, anyof: list[str], strict: list[str], limit: int) -> list[tuple[int, int, int]]:
        """(stage, score, chunk's number): the cascade's best."""
        out, hit = [], np.zeros(0, np.int32)
        if strict:
            hit, sums = self.strict(strict)
            out = [(0, int(s), int(r)) for s, r in zip(*_best(sums, hit, limit))]
        if len(out) < limit:
            rows, sums = self.any(anyof, limit)
            if len(hit):
                other = ~np.isin(rows, hit)
                rows, sums = rows[other], sums[other]
            out += [(1, int(s), int(r)) for s, r in zip(*_best(sums, rows, limit - len(out)))]
        return out


def _numbered(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids in order, null first, and the number of each row's."""
    d = ids.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(d.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return d.dictionary.take(pa.array(order)), place[d.indices.to_numpy()]


def _last(sums: np.ndarray, limit: int) -> int:
    return int(np.partition(sums, len(sums) - limit)[len(sums) - limit])


def _best(sums: np.ndarray, rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The `limit` greatest, ties to the least row."""
    if len(sums) > limit:
        reach = sums >= _last(sums, limit)
        sums, rows = sums[reach], rows[reach]
    order = np.lexsort((rows, -sums))[:limit]
    return sums[order], rows[order]


def cells(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, chunk_id, meeting_id, stage, score) of the best of each cell.

    Rows come by cell, first postings: term, chunk_id, meeting_id and part, the share of a score; then queries, without a
    term: query_id, anyof, strict.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            cells_, asks = batch.column("cell").to_numpy(), batch.column("term").is_null().to_numpy(zero_copy_only=False)
            kind = cells_.astype(np.int64) * 2 + asks
            ends = np.flatnonzero(np.diff(kind)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(kind)]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if cells_[a] != cell:
                    cell, held, block = cells_[a], [], None
                if not asks[a]:
                    held.append(rows.select(["term", "chunk_id", "meeting_id", "part"]))
                    continue
                if block is None and held:
                    block, held = Block(pa.Table.from_batches(held)), []
                if block is not None:
                    yield _answers(block, rows, limit)

    return run


def _answers(block: Block, queries: pa.RecordBatch, limit: int) -> pa.RecordBatch:
    of, found = [], []
    for k, (anyof, strict) in enumerate(zip(queries.column("anyof").to_pylist(), queries.column("strict").to_pylist())):
        got = block.top(anyof, strict, limit)
        of += [k] * len(got)
        found += got
    stage, score, row = np.array(found, np.int64).reshape(-1, 3).T
    c, m = np.divmod(block.pairs[row], len(block.meetings))
    columns = queries.column("query_id").take(pa.array(of, pa.int64())), block.chunks.take(pa.array(c)), block.meetings.take(pa.array(m)), pa.array(stage.astype(np.int32)), pa.array(np.ascontiguousarray(score))
    return pa.RecordBatch.from_arrays(list(columns), names=["query_id", "chunk_id", "meeting_id", "stage", "score"])
