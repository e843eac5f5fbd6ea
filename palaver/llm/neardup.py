"""Near-duplicates by Order MinHash over five-word shingles, verified by banded alignment of the words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_table, blocks, codes, components, forget, join_totals, last_staged, names, partitions, small, staged, staged_rows

#: Words in a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Sketches a document, and least k-mers in each: at similarity 0.8 a sketch agrees with a chance of about 0.8 ** 3,
#: all 24 disagree with one of about 4e-8.
SKETCHES, PICKS, SEED = 24, 3, 11
#: The documents of larger groups that share a sketch are first linked by FINE sketches of FINE_PICKS shingles each, which
#: leaves few components to compare; then every two documents of the group in different components are compared.
SMALL, FINE, FINE_PICKS = 64, 24, 6
#: Members in one packed row of a group.
PIECE = 1000
#: Documents outside a group's largest component, and inside it, in a block; every block of the first meets every block.
LEADS, PORTION = 1000, 1000
#: Places of a document's count of words, which bounds how many words two documents can have in common.
PLACES = 256
HOLD = 32 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.array([int.from_bytes(hashlib.sha256(f"{SEED}:{k}".encode()).digest()[:8], "big") for k in range(SKETCHES + FINE)], np.uint64)[:, None]
MEMBER = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<i8"), ("root", "<i8"), ("more", "<i8")])
PIECES = "key long, size long, lo long, hi long, top long, tops long, blob binary"
ENTRY, PAIR = np.dtype([("key", "<u8"), ("id", "<i8")]), np.dtype([("a", "<i8"), ("b", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the words: runs of letters and digits, lower case."""
    return _hashed(codes(text or "", alnum_table())[0])


def _hashed(c: np.ndarray) -> np.ndarray:
    if not c.size:
        return np.empty(0, np.uint32)
    gap = c == 32
    first = np.r_[0, np.nonzero(gap)[0] + 1]
    place = np.arange(c.size) - np.repeat(first, np.diff(np.r_[first, c.size]))
    x = _mix(c + place.astype(np.uint64) * _M2)
    x[gap] = 0
    return (_mix(np.add.reduceat(x, first)) >> np.uint64(32)).astype(np.uint32)


def shingles(w: np.ndarray) -> np.ndarray:
    """64-bit hashes of WORDS words in a row; of all words where there are fewer; none without words."""
    k = min(WORDS, w.size)
    if not k:
        return np.empty(0, np.uint64)
    n = w.size - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _mix(x * _M2 + w[i : i + n])
    return x


def sketches(s: np.ndarray, first: int = 0, count: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """Order-MinHash values: of each hash function the `picks` least occurrence-labelled shingles, in text order.

    The value covers the labels too: else all texts that say one thing very often would have one value.
    """
    order = np.argsort(s, kind="stable")
    runs = s[order]
    new = np.r_[True, runs[1:] != runs[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(s.size), 0))
    label = np.empty(s.size, np.uint64)
    label[order] = (np.arange(s.size) - start).astype(np.uint64)
    x = _mix(s + label * _M2)
    low = np.uint64((1 << 24) - 1)
    k = min(picks, s.size)
    rows = []
    step = max(1, min(count, (1 << 21) // s.size))
    seeds = _SEEDS[first : first + count]
    for i in range(0, count, step):
        h = (_mix(x[None, :] ^ seeds[i : i + step]) & ~low) | np.arange(s.size, dtype=np.uint64)
        rows.append(np.sort(np.partition(h, k - 1, axis=1)[:, :k] & low, axis=1))
    at = np.concatenate(rows).astype(np.int64)
    out = seeds[:, 0].copy()
    for j in range(k):
        out = _mix(out * _M2 + x[at[:, j]])
    return out


def banded(sketch: np.ndarray, n: int) -> np.ndarray:
    """What documents of n words are grouped by: each sketch with either of two bands of lengths.

    Bands are so wide, and the second ones begin so much later, that lengths within SIMILARITY share one of the two.
    """
    at = np.log(n) / np.log(SIMILARITY) / -2
    return np.r_[_mix(sketch * _M1 + np.uint64(2 * int(at))), _mix(sketch * _M1 + np.uint64(2 * int(at + 0.5) + 1))]


def keys(w: np.ndarray) -> np.ndarray:
    """The group keys of a document's word hashes."""
    return banded(sketches(shingles(w)), w.size)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the longest common subsequence L of two word sequences has L / (n + m - L) >= least.

    Alignment by one bit per place of b in a Python integer, within the band of diagonals that so few insertions and
    deletions allow. Equal ends are cut off first, and pairs whose words alone tell that they differ are not aligned.
    """
    n, m = a.size, b.size
    if not n or not m:
        return False
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return False
    k = min(n, m)
    head = int(np.argmin(np.r_[a[:k] == b[:k], False]))
    tail = int(np.argmin(np.r_[a[::-1][: k - head] == b[::-1][: k - head], False]))
    if head + tail >= need:
        return True
    x, y = a[head : n - tail], b[head : m - tail]
    u, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
    both = np.minimum(np.bincount(inv[: x.size], minlength=u.size), np.bincount(inv[x.size :], minlength=u.size))
    if head + tail + both.sum() < need:
        return False
    band = n + m - 2 * need
    masks: dict[int, int] = {}
    for j, w in enumerate(inv[x.size :].tolist()):
        if both[w]:
            masks[w] = masks.get(w, 0) | (1 << j)
    v = full = (1 << y.size) - 1
    wide = (1 << (2 * band + 1)) - 1
    for i, w in enumerate(inv[: x.size].tolist()):
        if both[w]:
            u_ = v & masks[w] & (wide << (i - band) if i > band else wide >> (band - i))
            v = ((v + u_) | (v - u_)) & full
    return head + tail + y.size - v.bit_count() >= need


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = [t or "" for t in b.column(2).to_pylist()]
        for i, j in blocks([len(t) for t in texts], 1 << 22):
            rows = []
            for t in texts[i:j]:
                c, _ = codes(t, alnum_table())
                w, raw = _hashed(c), hashlib.md5(t.encode("utf-8", "replace")).digest()
                # equal texts have equal letters and digits; without any they must be equal as they stand
                same = hashlib.md5(c.tobytes()).digest() if w.size else hashlib.md5(b"\0" + raw).digest()
                rows.append((raw, same, pack.compress(w.tobytes()), sketches(shingles(w)).tobytes() if w.size else b"", w.size))
            *cols, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(c, pa.binary()) for c in cols), pa.array(sizes, pa.int64())], ["id", "row", "raw", "same", "words", "sketch", "n"])


def _keyed(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The keys of each row: of its sketches, or those it has been dealt by."""
    if "keys" in b.schema.names:
        yield from (np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist())
    else:
        for x, n in zip(b.column("sketch").to_pylist(), b.column("n").to_pylist(), strict=True):
            yield banded(np.frombuffer(x, np.uint64), n)


def _pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by key and id: the least id of each key, and a pair of it with every other."""
    rows = rows[np.lexsort((rows["id"], rows["key"]))]
    new = np.r_[True, rows["key"][1:] != rows["key"][:-1]]
    at = np.nonzero(new)[0]
    lead = rows[at[np.cumsum(new) - 1]]
    out = np.empty(int((~new).sum()), PAIR)
    out["a"], out["b"] = lead["id"][~new], rows["id"][~new]
    return rows[new], np.unique(out[out["a"] != out["b"]])


def _blob_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _key_task(n: int):
    """Keys of representatives to blobs by key; what shares a key in this task is paired here and sends one entry on.

    A key that very many documents share so reaches the next task with one entry a task: each document has a pair
    with its task's first, and those with the first of all. What these pairs do not link is left to `closed`. Bucket
    -1 holds pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            first, pairs = _pairs(np.concatenate(held))
            bucket = (_mix(first["key"]) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, cuts = first[order], np.searchsorted(bucket[order], np.arange(n + 1))
            out = [(k, first[cuts[k] : cuts[k + 1]].tobytes()) for k in range(n) if cuts[k + 1] > cuts[k]]
            out += [(-1 - i // 50_000 % n, pairs[i : i + 50_000].tobytes()) for i in range(0, pairs.size, 50_000)]
            yield _blob_rows(out)

        for b in batches:
            for i, k in zip(b.column("id").to_pylist(), _keyed(b), strict=True):
                out = np.empty(k.size, ENTRY)
                out["key"], out["id"] = k, i
                held.append(out)
                size += out.nbytes
            if size > HOLD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _pair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs["a"]), pa.array(pairs["b"])], ["a", "b"])

    now, parts = None, []
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if k < 0:
                yield out(np.frombuffer(blob, PAIR))
                continue
            if k != now and parts:
                yield out(_pairs(np.concatenate(parts))[1])
                parts = []
            now = k
            parts.append(np.frombuffer(blob, ENTRY))
    if parts:
        yield out(_pairs(np.concatenate(parts))[1])


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b: each document of a group with the group's least."""
    n = partitions(reps.sparkSession)
    entries = reps.select("id", *[c for c in ("sketch", "n", "keys") if c in reps.columns]).mapInArrow(_key_task(n), "bucket int, blob binary")
    return entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_pair_task, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs, each end made distinct before they meet."""
    return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()


def _verify_task(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        read = lambda z: np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint32)
        for b in batches:
            a, c, x, y = (b.column(k).to_pylist() for k in ("a", "b", "x", "y"))
            ok = []
            for i in range(len(a)):
                if a[i] != last:
                    last, seen = a[i], read(x[i])
                ok.append(aligned(seen, read(y[i]), least))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(pairs: DataFrame, count: int, seqs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of `count` staged pairs those that the alignment confirms; `seqs` has (id, words).

    Only the words of documents in the pairs travel: few pairs go to them, many meet them by a shuffle.
    """
    ids, n = staged_rows(_ends(pairs), "near-ids")
    some = seqs.select("id", "words").join(small(ids, n), "id", "left_semi")
    y = some.select(F.col("id").alias("b"), F.col("words").alias("y")).join(small(pairs, count), "b")
    x = some.select(F.col("id").alias("a"), F.col("words").alias("x"))
    both = y.join(x, "a").select("a", "b", "x", "y").coalesce(_tasks(seqs, count)).sortWithinPartitions("a")
    return both.mapInArrow(_verify_task(least), "a long, b long")


def _tasks(df: DataFrame, rows: int, each: int = 5000) -> int:
    """Tasks for so many rows of work: few rows are not worth a Python worker for every partition."""
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // each)


def _deal_task(n: int, piece: int):
    """Rows with id, n, root and their keys to blobs of members by key. Of a key that more than `piece` documents have in
    this task all but one member are sent past the meeting (bucket below 0), so no task gets all of a very common key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            new = np.r_[True, rows["key"][1:] != rows["key"][:-1]]
            sizes = np.diff(np.r_[np.nonzero(new)[0], rows.size])
            rows["more"][new] = sizes > piece
            past = np.repeat(sizes > piece, sizes) & ~new
            first, rest = rows[~past], rows[past]
            bucket = (_mix(first["key"]) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, cuts = first[order], np.searchsorted(bucket[order], np.arange(n + 1))
            out = [(k, first[cuts[k] : cuts[k + 1]].tobytes()) for k in range(n) if cuts[k + 1] > cuts[k]]
            yield _blob_rows(out + [(-1 - i // 50_000 % n, rest[i : i + 50_000].tobytes()) for i in range(0, rest.size, 50_000)])

        for b in batches:
            ids = b.column("id").to_pylist()
            roots = b.column("root").to_pylist() if "root" in b.schema.names else ids
            for i, m, root, k in zip(ids, b.column("n").to_pylist(), roots, _keyed(b), strict=True):
                k = np.unique(k)
                out = np.zeros(k.size, MEMBER)
                out["key"], out["id"], out["n"], out["root"] = k, i, m, root
                held.append(out)
                size += out.nbytes
            if size > HOLD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _meet_task(piece: int):
    """Blobs of members by bucket to PIECES of the keys whose documents lie in several components, or may do so: each
    with its least and greatest root, and the root that most of its members have."""

    def out(rows: np.ndarray, every: bool = False) -> Iterator[pa.RecordBatch]:
        rows = rows[np.argsort(rows["key"], kind="stable")]
        at = np.nonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])[0]
        lo, hi = np.minimum.reduceat(rows["root"], at), np.maximum.reduceat(rows["root"], at)
        keep = (lo < hi) | (np.maximum.reduceat(rows["more"], at) > 0) | every
        found = []
        for i, j in zip(at[keep].tolist(), np.r_[at[1:], rows.size][keep].tolist(), strict=True):
            for k in range(i, j, piece):
                part = rows[k : min(k + piece, j)]
                roots, counts = np.unique(part["root"], return_counts=True)
                most = counts.argmax()
                found.append((int(part["key"][:1].view(np.int64)[0]), part.size, int(roots[0]), int(roots[-1]), int(roots[most]), int(counts[most]), part.tobytes()))
        for i in range(0, len(found), 10_000):
            *cols, blobs = zip(*found[i : i + 10_000], strict=True)
            names_ = ["key", "size", "lo", "hi", "top", "tops", "blob"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(blobs, pa.binary())], names_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if k < 0:
                    yield from out(np.frombuffer(blob, MEMBER), True)
                    continue
                if k != now and parts:
                    yield from out(np.concatenate(parts))
                    parts = []
                now = k
                parts.append(np.frombuffer(blob, MEMBER))
        if parts:
            yield from out(np.concatenate(parts))

    return run


def groups(part: DataFrame) -> DataFrame:
    """Pieces (key, members, docs, main, blob) of the keys whose documents lie in several components: the key's number of
    members, the component that has most of them and how many it has. Without roots every document is its own.

    Members stay packed, so what is joined is a row a piece, not one a document and key.
    """
    n = partitions(part.sparkSession)
    dealt = part.mapInArrow(_deal_task(n, PIECE), "bucket int, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    pieces = staged(dealt.mapInArrow(_meet_task(PIECE), PIECES), "near-pieces")
    tops = pieces.groupBy("key", "top").agg(F.sum("tops").alias("docs"), F.sum("size").alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = tops.groupBy("key").agg(F.max(F.struct("docs", "top")).alias("m"), F.sum("members").alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    whole, n = staged_rows(whole.select("key", "members", "m.docs", F.col("m.top").alias("main")), "near-keys")
    return pieces.select("key", "blob").join(small(whole, n), "key")


def _member_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to a row a member: (key, id, n, root) and the other columns of the piece."""
    for b in batches:
        parts = [np.frombuffer(x, MEMBER) for x in b.column("blob").to_pylist()]
        rows, of = np.concatenate(parts), pa.array(np.repeat(np.arange(len(parts)), [p.size for p in parts]))
        own = [pa.array(rows["key"].copy().view(np.int64)), *(pa.array(rows[c].copy()) for c in ("id", "n", "root"))]
        yield pa.RecordBatch.from_arrays([*own, *(b.column(c).take(of) for c in ("members", "docs", "main"))], ["key", "id", "n", "root", "members", "docs", "main"])


def members(pieces: DataFrame) -> DataFrame:
    return pieces.select("blob", "members", "docs", "main").mapInArrow(_member_task, "key long, id long, n long, root long, members long, docs long, main long")


def shared(part: DataFrame) -> DataFrame:
    """Entries (key, id, n) of the keys that two documents or more of `part` have; those of one alone link nothing."""
    return members(groups(part)).select("key", "id", "n")


def _id_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.frombuffer(x, MEMBER)["id"] for x in b.column(0).to_pylist()])))], ["id"])


def _every_task(least: float):
    """Groups of one piece to all their pairs (a, b) of different components whose lengths allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, PAIR)]
            for x in b.column(0).to_pylist():
                m = np.frombuffer(x, MEMBER)
                i, j = np.triu_indices(m.size, 1)
                ok = (m["root"][i] != m["root"][j]) & (np.minimum(m["n"][i], m["n"][j]) >= np.maximum(m["n"][i], m["n"][j]) * least - 1e-6)
                out = np.empty(int(ok.sum()), PAIR)
                out["a"], out["b"] = np.minimum(m["id"][i], m["id"][j])[ok], np.maximum(m["id"][i], m["id"][j])[ok]
                found.append(out)
            found = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(found["a"].copy()), pa.array(found["b"].copy())], ["a", "b"])

    return run


def _fine_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, words) to rows (id, n, keys): the fine sketches."""
    read = zstandard.ZstdDecompressor()
    for b in batches:
        words = (np.frombuffer(read.decompress(z), np.uint32) for z in b.column("words").to_pylist())
        out = [sketches(shingles(w), SKETCHES, FINE, FINE_PICKS).tobytes() for w in words]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(out, pa.binary())], ["id", "n", "keys"])


class _Links:
    """What has been tried and found so far: pairs, and the component of each linked document."""

    def __init__(self, seqs: DataFrame, least: float):
        self.seqs, self.least = seqs, least
        self.label, self.labelled = None, 0
        self.tried: list[tuple[DataFrame, int]] = []

    def _roots(self, rows: DataFrame, *names: tuple[str, str]) -> DataFrame:
        """`rows` with the root of each named document; one that has no link is its own."""
        for name, root in names:
            if self.label is None:
                rows = rows.withColumn(root, F.col(name))
            else:
                label = small(self.label.select(F.col("node").alias(name), F.col("root").alias(root)), self.labelled)
                rows = rows.join(label, name, "left").withColumn(root, F.coalesce(root, name))
        return rows

    def rooted(self, entries: DataFrame) -> DataFrame:
        return self._roots(entries, ("id", "root"))

    def take(self, found: DataFrame) -> None:
        """Take links in: components of the components that they join."""
        found, any_new = staged_rows(self._roots(found, ("a", "ra"), ("b", "rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "near-found")
        if not any_new:
            return
        new = components(found, "near-cc")
        if self.label is not None:
            up = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
            old = self.label.join(small(up, any_new), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            new = old.unionByName(new.join(self.label, "node", "left_anti"))
        self.label, self.labelled = staged_rows(new, "near-label")

    def try_(self, pairs: DataFrame) -> None:
        """Align pairs of documents of different components that were not tried, and take the links in."""
        new = self._roots(pairs, ("a", "ra"), ("b", "rb")).where("ra <> rb").select("a", "b")
        for t, n in self.tried:
            new = new.join(small(t, n), ["a", "b"], "left_anti")
        new, count = staged_rows(new, "near-untried")
        if count:
            self.tried.append((new, count))
            self.take(verified(new, count, self.seqs, self.least))


def closed(held: DataFrame, state: _Links) -> None:
    """Link until every two documents of a group are linked or known to differ.

    Of a group whose documents lie in several components, every two of different components are aligned where it has at
    most SMALL documents. The documents of larger groups, as a passage makes that very many unlike texts share, are
    linked by finer sketches first, in which two agree only if they have most of their shingles in common. That leaves
    fewer components and drops no pair: what then lies in different components of a large group, by either kind of
    sketch, meets in `crossed`.
    """
    large = _small(held.select("id", "n", "sketch"), state)
    ids, n = staged_rows(large.select("blob").mapInArrow(_id_task, "id long").distinct(), "near-large-ids")
    if n:
        some = held.join(small(ids, n), "id", "left_semi")
        coarse = staged(some.select("id", "n", "sketch"), "near-coarse")
        fine = staged(some.select("id", "n", "words").mapInArrow(_fine_task, "id long, n long, keys binary"), "near-fine")
        state.try_(candidates(fine))
        _small(fine, state)
        crossed([groups(state.rooted(part)).where(F.col("members") > SMALL) for part in (coarse, fine)], held, state)


def _small(part: DataFrame, state: _Links) -> DataFrame:
    """Align every two documents of small groups that are in different components; the pieces of larger groups."""
    mixed = staged(groups(state.rooted(part)), "near-mixed")
    state.try_(mixed.where(F.col("members") <= SMALL).select("blob").mapInArrow(_every_task(state.least), "a long, b long").distinct())
    return mixed.where(F.col("members") > SMALL)


def _counts(w: np.ndarray) -> np.ndarray:
    """How many words fall on each of PLACES: the sum of the lesser counts of two documents bounds their common words."""
    return np.bincount(w % np.uint32(PLACES), minlength=PLACES).astype(np.int32)


def _cross_task(least: float):
    """Rows (key, i, j, block, id, n, root, words, open), sorted by cell (key, i, j), to links (a, b) between the blocks i
    and j of a group, or within one.

    Two documents that meet in several groups are aligned only in the least of them, as their lists of groups tell.
    Lengths and counts of words leave out only pairs that the alignment would not link.
    """
    read = lambda z: np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint32)

    def cell(key: int, within: bool, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        n, root = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        if (root == root[0]).all():
            return
        counts, opened = np.stack([_counts(read(r[4])) for r in rows]), [frozenset(r[5]) for r in rows]
        cut = next((k for k, r in enumerate(rows) if r[0] != rows[0][0]), len(rows))  # the second block begins
        for x in range(cut):
            ys = np.arange(x + 1 if within else cut, len(rows))
            ys = ys[(root[ys] != root[x]) & (np.minimum(n[ys], n[x]) >= np.maximum(n[ys], n[x]) * least - 1e-6)]
            if not ys.size:
                continue
            need = np.ceil(least * (n[ys] + n[x]) / (1 + least) - 1e-9)
            ys = ys[np.minimum(counts[ys], counts[x]).sum(axis=1) >= need]
            seq = None
            for y in ys.tolist():
                if root[x] != root[y] and min(opened[x] & opened[y]) == key:
                    seq = read(rows[x][4]) if seq is None else seq
                    if aligned(seq, read(rows[y][4]), least):
                        yield min(rows[x][1], rows[y][1]), max(rows[x][1], rows[y][1])
                        root[root == root[y]] = root[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def links() -> Iterator[pa.RecordBatch]:
            found = list(cell(now[0], now[1] == now[2], rows))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for *at, block, i, n, root, words, open_ in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
                if at != now:
                    if rows:
                        yield from links()
                    now, rows = at, []
                rows.append((block, i, n, root, words, open_))
        if rows:
            yield from links()

    return run


def crossed(pieces: list[DataFrame], held: DataFrame, state: _Links) -> None:
    """Compare every two documents of a group that lie in different components; only links leave the tasks.

    The documents outside a group's largest component are cut into blocks of about LEADS, the others into blocks of
    about PORTION, and every block of the first kind meets every block in a cell of its own. Nothing is left out: two
    documents of the largest component are linked already. The comparisons grow with the number of documents times
    those outside; a task holds two blocks at a time, and pairs are never rows.
    """
    blocks_of = lambda docs, each: F.ceil(docs / F.lit(each)).cast("int")
    now = reduce(DataFrame.unionByName, [members(p) for p in pieces])
    now = now.withColumns({"outer": blocks_of(F.col("members") - F.col("docs"), LEADS), "inner": blocks_of(F.col("docs"), PORTION)})
    deal = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    outside = F.col("root") != F.col("main")
    now = now.withColumn("block", F.when(outside, deal("outer")).otherwise(F.col("outer") + deal("inner")))
    now = now.withColumn("others", F.col("outer") + F.when(outside, F.col("inner")).otherwise(0))
    # as many keys as a document has
    docs = now.groupBy("id", "n", "root").agg(F.collect_list(F.struct("key", "block", "others")).alias("at")).join(held.select("id", "words"), "id")
    cells = lambda x: F.transform(F.sequence(F.lit(0), x["others"] - 1), lambda o: F.struct(x["key"].alias("key"), F.least(x["block"], o).alias("i"), F.greatest(x["block"], o).alias("j"), x["block"].alias("block")))
    rows = docs.withColumn("open", F.transform("at", lambda x: x["key"])).withColumn("cell", F.explode(F.flatten(F.transform("at", cells))))
    rows = rows.select("cell.*", "id", "n", "root", "words", "open").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block")
    state.take(rows.mapInArrow(_cross_task(state.least), "a long, b long").distinct())


_LOW = -(1 << 63)  # stands for a null id and comes before all others


def _classified(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(id, raw, class_id, class_size, kept) of every row of `docs`; raw is the md5 of the text as it stands."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    # rows are told apart by a number that is fixed when the table is staged: ids may be null or repeated
    table = staged(base.mapInArrow(_sketch_task, "id long, row long, raw binary, same binary, words binary, sketch binary, n long"), "near-sketch")
    groups = table.groupBy("same").agg(F.min(F.struct("id", "row")).alias("best"), F.count("*").alias("copies"))
    groups = staged(groups.select("same", "copies", "best", F.col("best.row").alias("node")), "near-groups")
    # one row of each group stands for it; the others are left out
    copies = table.select("row", "same").join(groups.where("copies > 1").select("same", "node"), "same").where("row <> node").select("row")
    copies, n = staged_rows(copies, "near-copies")
    reps = table.where("n > 0").join(small(copies, n), "row", "left_anti").select(F.col("row").alias("id"), "words", "sketch", "n")
    pairs = staged(candidates(reps), "near-pairs")
    ids, n = staged_rows(_ends(pairs), "near-ids")
    held = staged(reps.join(small(ids, n), "id", "left_semi"), "near-held")
    # first each document with the least it is paired with, then what pairs are left between different components
    state = _Links(held, least)
    state.try_(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    state.try_(pairs)
    closed(held, state)
    label = state.label if state.label is not None else groups.select("node", F.col("node").alias("root")).limit(0)
    # classes of groups, then of rows; what a class or a group has many of is summed up first
    of = staged(groups.join(label, "node", "left").select("same", "copies", "best", F.coalesce("root", "node").alias("class")), "near-of")
    classes = staged(of.groupBy("class").agg(F.min("best").alias("lead"), F.sum("copies").alias("class_size"), F.count("*").alias("groups")), "near-classes")
    group = staged(join_totals(of.select("same", "copies", "class"), classes, "class", "groups").select("same", "copies", "lead", "class_size"), "near-group")
    rows = join_totals(table.select("id", "row", "raw", "same"), group, "same", "copies")
    return rows.select("id", "raw", F.col("lead.id").alias("class_id"), "class_size", (F.col("row") == F.col("lead.row")).alias("kept"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: (id, class_id, class_size, kept); class_id is the least id of its class.

    Two texts are linked if their words (letters and digits, lower case) have an alignment with at least `least` of all
    their words in common, L / (n + m - L); classes are the components. Every pair whose five-word shingles agree that
    much is such a pair too. Texts equal in their words are one class from the start and only one of them is compared.
    Candidates are documents that share an Order-MinHash sketch of five-word shingles. First every document is aligned
    with the first it has a candidate pair with, then what candidate pairs are left between different components, then
    all documents of a sketch that are still in different components: every two of them, in groups of any size. Texts that share no five words in a row are never candidates: only
    texts of a few dozen words can be so and still be similar.

    One row of each class is kept: of its least id, and if rows share that id, one of them. Texts of less than five words
    are one shingle. Null texts and texts without words are classes of equal texts. A null id comes before all others
    and gives a null class_id; rows with null or repeated ids are rows of their own. An empty table gives no rows.
    """
    null = lambda c: F.when(F.col(c) != _LOW, F.col(c)).alias(id_col if c == "id" else c)
    return _classified(docs, id_col, text_col, least).select(null("id"), null("class_id"), "class_size", "kept")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class, as `near_classes` keeps it; columns unchanged.

    Rows are found again by id and text. Of rows equal in both, one stays where one is to stay: the least by its columns.
    """
    mark = last_staged()
    each = _classified(docs, "doc_id", "text", least).groupBy("id", "raw").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    each = staged(each.select(F.col("id").alias("__id"), F.col("raw").alias("__raw"), "kept", "copies").where("not kept or copies > 1"), "near-gone")
    forget(mark, each)
    own = names(docs)
    marked = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("__id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("__raw"))
    on = ["__id", "__raw"]
    twice = each.where("kept").select(*on)
    if twice.isEmpty():
        return marked.join(each.select(*on), on, "left_anti").select(*own)
    once = marked.join(each.select(*on), on, "left_anti").select(*own)
    left = marked.join(twice, on, "left_semi").groupBy(*on).agg(F.min(F.struct(*own)).alias("__one")).select("__one.*")
    return once.unionByName(left)
