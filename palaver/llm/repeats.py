"""Repeated byte strings: prefix-free parsing into phrases, sorted dictionaries of them, and their corpus order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, even_keys, partitions, staged

#: Strings of LENGTH bytes count; a trigger is a rolling hash of GRAM bytes.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # trigger places in one string
#: Bytes parsed at once, and bytes of phrases a task holds before it sends them on.
PARSE, HOLD = 1 << 19, 24 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: A document is an id and the digest of its text: rows that share an id are told apart, equal rows are not.
DOC = np.dtype([("doc", "<i8"), ("sub", "<u8")])
PHRASE = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("sub", "<u8"), ("a", "<i4"), ("n", "u1")])
#: A phrase of a dictionary: the string that begins at a has its trigger `lead` bytes later; its bytes go with it.
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("sub", "<u8"), ("a", "<i4"), ("n", "u1"), ("lead", "u1")])
#: Phrases of a dictionary that are sorted at once, whole keys.
SORT = 400_000
MARK = np.dtype([("doc", "<i8"), ("sub", "<u8"), ("a", "<i4"), ("b", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M1
    return x ^ (x >> np.uint64(29))


def _double(h: np.ndarray, step: int, m: np.uint64) -> np.ndarray:
    """Hashes of twice the length: of the string at i and the one `step` later."""
    return _mix(h[:-step] * m + h[step:])


def gram_hashes(b: np.ndarray, m: np.uint64 = _M2) -> np.ndarray:
    """64-bit hash of the GRAM bytes at every place."""
    x = b.astype(np.uint64)
    two = (x[:-1] << np.uint64(8)) | x[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    return _double(_double(_mix(eight), 8, m), 16, m | np.uint64(1))


def string_hashes(g: np.ndarray, m: np.uint64 = _M3) -> np.ndarray:
    """64-bit hash of the LENGTH bytes at every place, from those of its four overlapping grams."""
    n = g.size - (LENGTH - GRAM)
    return _mix(_mix(_mix(g[:n] * m + g[32 : 32 + n]) * m + g[64 : 64 + n]) * m + g[68 : 68 + n])


def parse(b: np.ndarray, ends: np.ndarray):
    """Phrases of concatenated texts: for each, the places (a, b) of the strings it stands for, its key and content,
    and the place of its trigger.

    Every LENGTH-byte string has one trigger: the leftmost least rolling hash of the grams in it, which depends on the
    string alone. Strings that begin one after another and share their trigger form a phrase. Its key is the hash of
    the trigger gram; its content hash covers all bytes from the first string's start to the last one's end, with the
    trigger's place. Equal strings always lie in phrases of the same key, at the same distance from the trigger.
    """
    none = np.empty(0, np.int64)
    n = b.size - LENGTH + 1
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    g = gram_hashes(b)
    at = np.arange(g.size, dtype=np.uint64)
    # upper bits order the triggers, the place breaks ties to the left
    m = (g & np.uint64(0xFFFFFFFFFF000000)) | at
    w = 1
    while 2 * w <= SPAN:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < SPAN:
        m = np.minimum(m[: m.size - (SPAN - w)], m[SPAN - w :])
    t = (m[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    # strings that reach over a text's end are none
    valid = np.ones(n, bool)
    for e in ends[:-1] if len(ends) > 1 else []:
        valid[max(0, e - LENGTH + 1) : e] = False
    cut = np.r_[True, (t[1:] != t[:-1]) | (valid[1:] != valid[:-1])]
    a = np.nonzero(cut)[0]
    z = np.r_[a[1:], n] - 1
    ok = valid[a]
    a, z = a[ok], z[ok]
    s = string_hashes(g)
    tr = t[a]
    ctx = _mix(_mix(s[a] * _M2 + s[z]) * _M3 + ((z - a) * 256 + (tr - a)).astype(np.uint64))
    return a, z, g[tr], ctx, tr


def _first(rows: np.ndarray, fields) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows by content and corpus order; (sorted rows, whether each is the first of its content).

    Equal rows of the table have equal places: these stay once, and `_cut_task` sees to the copies."""
    rows = rows[np.lexsort(tuple(rows[f] for f in ("a", "sub", "doc", *reversed(fields))))]
    if rows.size:
        rows = rows[np.r_[True, np.any([rows[f][1:] != rows[f][:-1] for f in (*fields, "doc", "sub", "a")], axis=0)]]
    head = np.ones(rows.size, bool)
    if rows.size:
        head[1:] = np.any([rows[f][1:] != rows[f][:-1] for f in fields], axis=0)
    return rows, head


def _pack(rows: np.ndarray) -> bytes:
    """Columns apart, bytes of equal weight together, ids as a table and indexes: sorted hashes and places then
    compress to about half."""
    order = np.lexsort((rows["sub"], rows["doc"]))
    doc, sub = rows["doc"][order], rows["sub"][order]
    new = np.ones(rows.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
    index = np.empty(rows.size, "<u4")
    index[order] = np.cumsum(new) - 1
    ids = doc[new]
    columns = [ids, sub[new], index, *(rows[f] for f in rows.dtype.names if f not in DOC.names)]
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(c.size, -1).T).tobytes() for c in columns]
    return np.array([rows.size, ids.size], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    n, k = np.frombuffer(blob, "<i8", 2).tolist()
    raw, at = zstandard.ZstdDecompressor().decompress(blob[16:]), 0

    def column(size: int, dtype) -> np.ndarray:
        nonlocal at
        dtype = np.dtype(dtype)
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        at += planes.size
        return np.ascontiguousarray(planes.T).view(dtype).ravel()

    ids, subs, index = column(k, "<i8"), column(k, "<u8"), column(n, "<u4")
    out = np.empty(n, kind)
    out["doc"], out["sub"] = ids[index], subs[index]
    for f in kind.names:
        if f not in DOC.names:
            out[f] = column(n, kind[f])
    return out


def _blobs(kind: int, rows: np.ndarray, bucket: np.ndarray, keys: list[int]) -> list[tuple[int, int, bytes]]:
    n = len(keys)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    return [(kind, keys[k], _pack(rows[cuts[k] : cuts[k + 1]])) for k in range(n) if cuts[k + 1] > cuts[k]]


def _batch(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], ["kind", "bucket", "blob"])


_BLOB = "kind int, bucket int, blob binary"
PHRASES, MARKS, ASKED, DOCS = 0, 1, 2, 3


def _doc_bucket(rows: np.ndarray, n: int) -> np.ndarray:
    return (_mix(_mix(rows["doc"].view(np.uint64) + _M3) + rows["sub"]) % np.uint64(n)).astype(np.int64)


def _docs(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The documents (id, digest) of rows."""
    out = np.empty(len(texts), DOC)
    out["doc"] = ids
    out["sub"] = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts]
    return out


def _key_bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (_mix(key) % np.uint64(n)).astype(np.int64)


def _joined(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks of begin places a..b, sorted, neighbours in a document joined."""
    out = np.empty(rows.size, MARK)
    out["doc"], out["sub"], out["a"], out["b"] = rows["doc"], rows["sub"], a, b
    out = out[np.lexsort((out["a"], out["sub"], out["doc"]))]
    if not out.size:
        return out
    new = np.r_[True, (out["doc"][1:] != out["doc"][:-1]) | (out["sub"][1:] != out["sub"][:-1]) | (out["a"][1:] > out["b"][:-1] + 1)]
    at = np.nonzero(new)[0]
    head = out[at].copy()
    head["b"] = np.maximum.reduceat(out["b"], at)
    return head


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _pieces(texts: list[bytes]):
    """Slices of texts to parse at once, as (bytes, [(row, offset in the bytes, place in its text)]).

    A text over 2 * PARSE bytes is cut, each piece with the LENGTH - 1 bytes after it: no string is lost, and the
    phrase at a cut is two phrases."""
    for i, j in blocks([len(t) for t in texts], PARSE):
        if j - i > 1 or len(texts[i]) <= 2 * PARSE:
            rows, at = [], 0
            for r in range(i, j):
                rows.append((r, at, 0))
                at += len(texts[r])
            yield b"".join(texts[i:j]), rows
        else:
            for at in range(0, len(texts[i]), PARSE):
                yield texts[i][at : at + PARSE + LENGTH - 1], [(i, 0, at)]


def _parse_task(keys: list[int]):
    """Rows (id, text) to blobs: the first phrase of each content in this task, and marks for the others.

    What a task merges itself never travels: of a passage that a third of all documents share, each task sends one
    phrase per content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            rows, head = _first(np.concatenate(held), ("key", "ctx"))
            rest = rows[~head]
            marks = _joined(rest, rest["a"], rest["a"] + rest["n"])
            first = rows[head]
            yield from _batch(_blobs(PHRASES, first, _key_bucket(first["key"], len(keys)), keys) + _blobs(MARKS, marks, _doc_bucket(marks, len(keys)), keys))

        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), _bytes(b.column(1))
            docs = _docs(ids, texts)
            for whole, rows in _pieces(texts):
                a, z, key, ctx, _ = parse(np.frombuffer(whole, np.uint8), np.array([r[1] for r in rows[1:]] + [len(whole)]))
                if not a.size:
                    continue
                r = np.searchsorted([x[1] for x in rows], a, "right") - 1
                out = np.empty(a.size, PHRASE)
                own = docs[np.array([x[0] for x in rows])[r]]
                out["key"], out["ctx"], out["doc"], out["sub"] = key, ctx, own["doc"], own["sub"]
                out["a"], out["n"] = a + np.array([x[2] - x[1] for x in rows])[r], z - a
                held.append(out)
                size += out.nbytes
                if size > HOLD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _buckets(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray | tuple[int, int, bytes]]:
    """The phrases of one bucket after another, as the partition is sorted; blobs of other kinds as they come."""
    now, parts = None, []
    for b in batches:
        for what, k, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            if what != PHRASES:
                yield what, k, blob
                continue
            if k != now and parts:
                yield np.concatenate(parts)
                parts = []
            now = k
            parts.append(_unpack(blob, kind))
    if parts:
        yield np.concatenate(parts)


def _order_task(keys: list[int]):
    """Dictionary and parse of a bucket in order: marks for every phrase whose content came before in the corpus; and
    the first phrases of keys with more than one content, whose strings must be looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, PHRASE):
            if isinstance(rows, tuple):
                yield from _batch([rows])
                continue
            rows, head = _first(rows, ("key", "ctx"))
            rest, first = rows[~head], rows[head]
            marks = _joined(rest, rest["a"], rest["a"] + rest["n"])
            same = first["key"][1:] == first["key"][:-1]
            more = np.r_[same, False] | np.r_[False, same] if first.size else np.empty(0, bool)
            ask = _joined(first[more], first["a"][more], first["a"][more] + first["n"][more])
            yield from _batch(_blobs(MARKS, marks, _doc_bucket(marks, len(keys)), keys) + _blobs(ASKED, ask, _doc_bucket(ask, len(keys)), keys))

    return run


def _ship_task(keys: list[int]):
    """Rows (id, text) to blobs: the texts of a batch that fall into one bucket, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), _bytes(b.column(1))
            docs = _docs(ids, texts)
            for i, j in blocks([len(t) for t in texts], HOLD):
                bucket = _doc_bucket(docs[i:j], len(keys))
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(len(keys) + 1))
                out = []
                for k in np.nonzero(cuts[1:] > cuts[:-1])[0].tolist():
                    own = [i + r for r in order[cuts[k] : cuts[k + 1]].tolist()]
                    head = np.array([len(own), *ids[own].tolist(), *docs["sub"][own].view(np.int64).tolist(), *(len(texts[r]) for r in own)], np.int64).tobytes()
                    out.append((DOCS, keys[k], pack.compress(head + b"".join(texts[r] for r in own))))
                yield from _batch(out)

    return run


def _shipped(blob: bytes) -> Iterator[tuple[tuple[int, int], bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, subs, sizes = (np.frombuffer(raw, kind, n, 8 + 8 * n * k).tolist() for k, kind in enumerate((np.int64, np.uint64, np.int64)))
    at = 8 + 24 * n
    for i, sub, size in zip(ids, subs, sizes, strict=True):
        yield (i, sub), raw[at : at + size]
        at += size


def _marks_by_doc(blobs: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    if not blobs:
        return {}
    rows = np.concatenate([_unpack(x, MARK) for x in blobs])
    rows = rows[np.lexsort((rows["sub"], rows["doc"]))]
    at = np.nonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["sub"][1:] != rows["sub"][:-1])])[0] if rows.size else np.empty(0, np.int64)
    return dict(zip(zip(rows["doc"][at].tolist(), rows["sub"][at].tolist(), strict=True), np.split(rows, at[1:]), strict=True)) if rows.size else {}


def _docs_with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[tuple[int, int], bytes]], dict[tuple[int, int], np.ndarray]]]:
    """Blobs of documents, each with the marks of its bucket; the partition is sorted by bucket, then marks first."""
    now, blobs, marks = None, [], None
    for b in batches:
        for what, k, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            if k != now:
                now, blobs, marks = k, [], None
            if what != DOCS:
                blobs.append(blob)
            else:
                if marks is None:
                    marks, blobs = _marks_by_doc(blobs), []
                yield list(_shipped(blob)), marks


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of True."""
    d = np.diff(np.r_[0, x.astype(np.int8), 0])
    return np.nonzero(d == 1)[0], np.nonzero(d == -1)[0]


def _pack_entries(rows: np.ndarray, texts: list[bytes]) -> bytes:
    head = _pack(rows)
    return np.array([len(head)], "<i8").tobytes() + head + zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def _unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 8 + int(np.frombuffer(blob, "<i8", 1)[0])
    return _unpack(blob[8:cut], ENTRY), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[cut:]), np.uint8)


def _open_task(keys: list[int]):
    """The phrases that were asked for, with their bytes, to the dictionaries of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0

        def flush():
            rows = np.concatenate(held)
            bucket = _key_bucket(rows["key"], len(keys))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(len(keys) + 1))
            parts = ((keys[k], order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist())
            yield from _batch([(PHRASES, k, _pack_entries(rows[own], [texts[i] for i in own.tolist()])) for k, own in parts])

        for docs, wanted in _docs_with_marks(batches):
            for i, text in docs:
                for a, z in _merged(wanted.get(i)):
                    for a1 in range(a, z + 1, PARSE):
                        part = text[a1 : min(z, a1 + PARSE - 1) + LENGTH]
                        begin, end, key, _, trigger = parse(np.frombuffer(part, np.uint8), np.array([len(part)]))
                        rows = np.empty(begin.size, ENTRY)
                        rows["key"], rows["doc"], rows["sub"], rows["a"], rows["n"], rows["lead"] = key, *i, begin + a1, end - begin, trigger - begin
                        held.append(rows)
                        texts += [part[x : y + LENGTH] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                        size += rows.nbytes + int((end - begin).sum()) + LENGTH * begin.size
                if size > HOLD:
                    yield from flush()
                    held, texts, size = [], [], 0
        if held:
            yield from flush()

    return run


def _ordered(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows by key and content, and how long each row's prefix in common with the one before is; -1 for a new key."""
    words = rows.view(">u8")
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), key))
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[key[order[1:]] != key[order[:-1]]] = -1
    return order, np.r_[-1, common]


def repeated(rows: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a dictionary the strings that begin earlier in the corpus: index of the phrase, and place of the string.

    All phrases are sorted twice: by what follows their trigger, and by what stands before it, read backwards; with each
    goes the array of longest common prefixes. A string whose trigger is d bytes behind its beginning is the last d bytes
    before the trigger and the LENGTH - d bytes from it on. Two strings are equal if they have one trigger, one d, and
    in both orders no shorter common prefix lies between them. Of equal strings the first in the order of the parse, by
    document and place, stays.
    """
    rows_at = np.cumsum(rows["n"].astype(np.int64) + LENGTH) - (rows["n"].astype(np.int64) + LENGTH)
    order = np.lexsort((rows["a"], rows["a"].astype(np.int64) + rows["lead"], rows["sub"], rows["doc"]))  # the same for every d
    # equal rows of the table have equal places: these stand there once
    place = rows[["doc", "sub", "a"]][order]
    order = order[np.r_[True, place[1:] != place[:-1]]]
    rows, at = rows[order], rows_at[order]
    lead, n = rows["lead"].astype(np.int64), rows["n"].astype(np.int64)
    m, wide = rows.size, -(-LENGTH // 8) * 8
    after, before = np.zeros((m, wide), np.uint8), np.zeros((m, -(-SPAN // 8) * 8), np.uint8)
    for k in range(LENGTH):  # byte k from the trigger on, and k + 1 bytes before it, of all phrases
        own = np.flatnonzero(lead + k < n + LENGTH)
        after[own, k] = text[at[own] + lead[own] + k]
        own = np.flatnonzero(lead > k)
        if own.size:
            before[own, k] = text[at[own] + lead[own] - k - 1]
    key = rows["key"]
    orders = [(o, c, np.empty(m, np.int64)) for o, c in (_ordered(key, before), _ordered(key, after))]

    def classes(which: int, depth: int) -> np.ndarray:
        """Number of the class of phrases with `depth` bytes in common, of every phrase."""
        o, common, out = orders[which]
        out[o] = np.cumsum(common < depth)
        return out

    found, places = [], []
    for d in range(SPAN):
        own = np.flatnonzero((lead >= d) & (lead - n <= d))
        if own.size > 1:
            both = classes(0, d)[own] * np.int64(m + 1) + classes(1, LENGTH - d)[own]
            first = np.unique(both, return_index=True)[1]
            again = np.ones(own.size, bool)
            again[first] = False
            found.append(order[own[again]])
            places.append((rows["a"].astype(np.int64) + lead - d)[own[again]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *places])


def _merged(marks: np.ndarray | None) -> list[tuple[int, int]]:
    if marks is None:
        return []
    out = _joined(marks, marks["a"], marks["b"])
    return list(zip(out["a"].tolist(), out["b"].tolist(), strict=True))


def _dictionary_task(keys: list[int]):
    """Marks for the strings of a bucket's dictionary that repeat earlier ones, in parts of about SORT phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _bucketed(batches):
            rows, text = np.concatenate([r for r, _ in parts]), np.concatenate([t for _, t in parts])
            parts.clear()
            end = np.cumsum(rows["n"].astype(np.int64) + LENGTH)
            begin = end - (rows["n"].astype(np.int64) + LENGTH)
            order = np.argsort(rows["key"], kind="stable")
            new = np.flatnonzero(np.r_[True, rows["key"][order[1:]] != rows["key"][order[:-1]]])
            cuts = [0]
            for c in [*new[1:].tolist(), order.size]:
                if c - cuts[-1] >= SORT or c == order.size:
                    cuts.append(c)
            for x, y in zip(cuts, cuts[1:], strict=False):
                own = order[x:y]
                size = end[own] - begin[own]
                bytes_ = text[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                which, place = repeated(rows[own], bytes_)
                marks = _joined(rows[own[which]], place, place)
                yield from _batch(_blobs(MARKS, marks, _doc_bucket(marks, len(keys)), keys))

    return run


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The dictionary of one bucket after another, as the partition is sorted."""
    now, parts = None, []
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if k != now and parts:
                yield parts
                parts = []
            now = k
            parts.append(_unpack_entries(blob))
    if parts:
        yield parts


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
_NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "span_from", "span_to")


def _cut_task(width: int):
    """Remove the bytes that marked strings cover; of equal rows, which meet here, all of each after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for docs, found in _docs_with_marks(batches):
            out = []
            for i, text in docs:
                kept, removed, spans = text, 0, ([], [])
                if i in seen and len(text) >= LENGTH:
                    kept, removed, spans = b"", len(text), ([0], [len(text)])
                elif i in found:
                    edge = np.zeros(len(text) + 1, np.int32)
                    own = _joined(found[i], found[i]["a"], found[i]["b"])
                    own = own[own["b"] + LENGTH <= len(text)]
                    np.add.at(edge, own["a"], 1)
                    np.add.at(edge, own["b"] + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = tuple(x.tolist() for x in _runs(gone))
                    removed = int(gone.sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                seen.add(i)
                out.append((i[0], len(text), removed, len(spans[0]), hashlib.sha256(kept).hexdigest(), kept, spans[0], spans[1])[:width])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=False)], list(_NAMES[:width]))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept_sha256[, kept, span_from, span_to]).

    Removes each byte covered by a LENGTH-byte string that also begins earlier in the corpus: in a document with a
    smaller id, or earlier in the same one. Strings never cross documents and are judged on the input. Null text is
    empty. The id must be an integer; a null id comes before all others (as the smallest integer). Rows with the same
    id, null ids too, are documents of their own, in the order of the 64-bit digests of their texts; of equal rows the
    first is treated like any document, and the others lose all their bytes if they have LENGTH. Very long texts are parsed in pieces. An empty table gives no rows. `texts`: with the bytes
    kept and the spans removed (byte offsets, end exclusive).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keys = even_keys(spark, n)
    low = -(1 << 63)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    dealt = lambda d: d.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    ordered = staged(dealt(base.mapInArrow(_parse_task(keys), _BLOB)).mapInArrow(_order_task(keys), _BLOB), "repeats-ordered")
    shipped = base.mapInArrow(_ship_task(keys), _BLOB)
    asked = ordered.where(F.col("kind") == ASKED)
    opened = dealt(shipped.unionByName(asked)).mapInArrow(_open_task(keys), _BLOB)
    marks = staged(dealt(opened).mapInArrow(_dictionary_task(keys), _BLOB), "repeats-opened")
    marks = marks.unionByName(ordered.where(F.col("kind") == MARKS))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, span_from array<long>, span_to array<long>"
    out = dealt(shipped.unionByName(marks)).mapInArrow(_cut_task(8 if texts else 5), schema if texts else schema.split(", kept binary")[0])
    return out.withColumn("doc_id", F.when(F.col("doc_id") != low, F.col("doc_id"))).withColumnRenamed("doc_id", id_col)


def brute(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same by a dictionary of all strings, for small inputs."""
    seen, out = set(), []
    digest = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little")
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1]))):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out.append((i, len(b), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
