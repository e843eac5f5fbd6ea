"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyProbe, alnum_table, blocks, codes

#: Edits allowed, as a share of an item's letters and digits (with single spaces).
ERROR_SHARE = 0.1
#: Pieces are at least so long; a short item has fewer errors to spend.
PIECE = 8
#: Items that one pass over the documents takes; more items take more passes.
BLOCK_ITEMS = 20_000


def _packed8(c: np.ndarray) -> np.ndarray:
    """8 codes, the low byte of each, at every position."""
    n = c.size - PIECE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = (c & 0xFF).astype(np.uint64)
    two = (b[:-1] << np.uint64(8)) | b[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def budget(n: int) -> int:
    """Errors allowed in an item of n codes, so that n / (errors + 1) is no shorter than a piece."""
    return max(0, min(int(n * ERROR_SHARE), n // PIECE - 1))


def myers(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Smallest edit distance between the pattern and any substring of the text, and where it first ends.

    One bit a pattern position in a Python integer; (most + 1, 0) if the distance is above `most`.
    """
    m = pattern.size
    peq: dict[int, int] = {}
    for i, ch in enumerate(pattern.tolist()):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, most + 1, 0
    for j, ch in enumerate(text.tolist()):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """Pieces of a block of items, by their first 8 codes."""

    ids: list
    text: list[np.ndarray]
    probe: KeyProbe
    first: np.ndarray
    piece_item: np.ndarray
    piece_at: np.ndarray
    piece_last: np.ndarray
    piece_tail: np.ndarray
    fine: KeyProbe
    fine_first: np.ndarray
    fine_item: np.ndarray
    fine_at: np.ndarray
    errors: np.ndarray
    least: np.ndarray
    short: list[int]

    def hits(self, c: np.ndarray):
        """Exact piece hits: item, the place where the item would begin, the place of the piece."""
        g = _packed8(c)
        at, k = self.probe.find(g)
        if not at.size:
            return at, at, at
        # every piece that begins with these 8 codes
        at, p = _spread(at, k, self.first)
        # the last 8 codes of the piece must be there too
        tail = at + self.piece_last[p]
        ok = tail < g.size
        at, p, tail = at[ok], p[ok], tail[ok]
        ok = g[tail] == self.piece_tail[p]
        item, begin, at = self.piece_item[p[ok]], at[ok] - self.piece_at[p[ok]], at[ok]
        # an edit spoils at most one of an item's 8-code pieces and moves the others by one place: where the item is,
        # all but `errors` of them begin within `errors` places of each other
        f, k = self.fine.find(g)
        f, p = _spread(f, k, self.fine_first)
        width = np.int64(4 * (c.size + max((t.size for t in self.text), default=0)))
        there = np.sort(self.fine_item[p] * width + f - self.fine_at[p])
        mine, e = item * width + begin, self.errors[item]
        enough = np.searchsorted(there, mine + e, "right") - np.searchsorted(there, mine - e, "left") >= self.least[item]
        return item[enough], begin[enough], at[enough]

    def verify(self, c: np.ndarray, item: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, distance, begin, end) of each item that is in the codes of one document, its best place."""
        out = {}
        if not item.size:
            return []
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        # hits of an item whose places are close share one window
        k = np.array([budget(self.text[i].size) for i in item])
        new = np.r_[True, (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > k[1:])]
        cuts = np.nonzero(new)[0]
        for a, b in zip(cuts, np.r_[cuts[1:], item.size], strict=True):
            i = int(item[a])
            q, kk = self.text[i], int(k[a])
            lo, hi = max(0, int(begin[a]) - kk), min(c.size, int(begin[b - 1]) + q.size + kk)
            if i in out and out[i][1] == 0:
                continue
            d, end = myers(q, c[lo:hi], kk)
            if d <= kk and (i not in out or d < out[i][1]):
                # where it begins: the same search backwards from the end
                _, back = myers(q[::-1], c[lo : lo + end][::-1][: q.size + kk], kk)
                out[i] = (i, d, lo + end - back, lo + end)
        return list(out.values())

    def short_hits(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Items shorter than a piece, as whole words."""
        out = []
        if self.short:
            whole = " " + "".join(map(chr, c.tolist())) + " "
            for i in self.short:
                at = whole.find(" " + "".join(map(chr, self.text[i].tolist())) + " ")
                if at >= 0:
                    out.append((i, 0, at, at + self.text[i].size))
        return out


def _spread(at: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once for every entry of its key; entries of key k are first[k] up to first[k + 1]."""
    n = first[key + 1] - first[key]
    return np.repeat(at, n), np.repeat(first[key], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def _by_key(keys: list, *columns: list) -> tuple[KeyProbe, np.ndarray, list[np.ndarray]]:
    keys = np.array(keys, np.uint64)
    order = np.argsort(keys, kind="stable")
    u, first = np.unique(keys[order], return_index=True)
    return KeyProbe(u), np.r_[first, keys.size].astype(np.int64), [np.array(c, np.uint64 if k == 3 else np.int64)[order] for k, c in enumerate(columns)]


def prepare(rows: list[tuple[int, str | None]]) -> Items:
    """Split every item into one piece more than its errors. Items without a letter or digit are left out."""
    ids, text, short = [], [], []
    keys, item, at, last, tail = [], [], [], [], []
    fine, fine_item, fine_at = [], [], []
    for i, t in rows:
        q, _ = codes(t or "", alnum_table())
        if not q.size:
            continue
        ids.append(i)
        text.append(q)
        if q.size < PIECE:
            short.append(len(ids) - 1)
            continue
        g, n = _packed8(q), budget(q.size) + 1
        places = range(0, q.size - PIECE + 1, PIECE)
        fine += g[:: PIECE].tolist()
        fine_item += [len(ids) - 1] * len(places)
        fine_at += places
        for p in range(n):
            a, b = q.size * p // n, q.size * (p + 1) // n
            keys.append(g[a])
            item.append(len(ids) - 1)
            at.append(a)
            last.append(b - a - PIECE)
            tail.append(g[b - PIECE])
    probe, first, pieces = _by_key(keys, item, at, last, tail)
    probe2, first2, pieces2 = _by_key(fine, fine_item, fine_at)
    errors = np.array([budget(t.size) for t in text], np.int64)
    least = np.array([t.size // PIECE for t in text], np.int64) - errors
    return Items(ids, text, probe, first, *pieces, probe2, first2, *pieces2, errors, least, short)


def _documents(items: Items, made, starts, item, begin, at, ids) -> list[tuple]:
    rows = []
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.argsort(doc, kind="stable")
    doc, item, begin = doc[order], item[order], begin[order]
    edges = np.searchsorted(doc, np.arange(len(made) + 1))
    for d in range(len(made)) if items.short else np.unique(doc).tolist():
        c, where = made[d]
        own = slice(edges[d], edges[d + 1])
        for i, dist, a, b in items.verify(c, item[own], begin[own] - starts[d]) + items.short_hits(c):
            rows.append((ids[d], items.ids[i], dist, int(where[a]), int(where[b - 1]) + 1, int(items.text[i].size)))
    return rows


def _found(items: Items, ids: list, texts: list[str | None]) -> list[tuple]:
    """The rows of `contaminated` for some texts."""
    rows = []
    for i, j in blocks([len(t or "") for t in texts], 1 << 20):
        made = [codes(t or "", alnum_table()) for t in texts[i:j]]
        # a separator that no text holds keeps pieces inside their document
        whole = np.concatenate([np.r_[c, np.uint16(1)] for c, _ in made])
        starts = np.cumsum([0] + [c.size + 1 for c, _ in made])
        item, begin, at = items.hits(whole)
        rows += _documents(items, made, starts, item, begin, at, ids[i:j])
    return rows


def _filter(items: Items, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in _found(items, list(range(b.num_rows)), b.column(text_at).to_pylist())]] = False
            yield b.filter(pa.array(keep))

    return run


def _scan(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _found(items, b.column(0).to_pylist(), b.column(1).to_pylist())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "begin", "finish", "item_len"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, made ready, in blocks of about BLOCK_ITEMS."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = -(-bench.count() // BLOCK_ITEMS)
    for k in range(n):
        got = (bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else bench).toArrow()
        yield prepare(sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, distance, begin, finish, item_len) of documents that hold a benchmark item.

    Texts are compared as lower-case letters and digits with single spaces. An item is in a document if some substring
    is within budget(length) edits of it; begin and finish are code points of the original text around the best one.
    The benchmark is the stated query set: it comes to the driver in blocks of BLOCK_ITEMS items, one after another,
    and every block goes over all documents once. Null or empty texts and items match nothing; null ids stay null;
    repeated rows repeat.
    """
    schema = "doc_id long, item_id long, distance long, begin long, finish long, item_len long"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark):
        found = base.mapInArrow(_scan(items), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item, columns unchanged; each row is judged by its own text."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(_filter(items, at), docs.schema)
    return docs
