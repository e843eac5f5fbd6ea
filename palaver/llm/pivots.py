"""Near-duplicate embeddings: a pivot-permutation index, then verification by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_totals, sampled, small, staged, staged_rows

#: Two vectors are linked from this cosine on.
LEAST = 0.95
#: Reference points: at most so many of SAMPLE distinct vectors (those with the least hashes), whatever the table's
#: size, no two with a cosine of APART or more: else those within a dense group would tell its members apart.
PIVOTS, SAMPLE, APART = 1024, 8192, 0.8
#: Pivots that describe a vector, nearest first. Vectors that share two of them are compared. Of random pairs whose
#: cosine is exactly 0.95, in 64 dimensions, 998 in 1,000 do; the nearer, the more.
NEAREST = 8
#: Members of a list that are compared in one task; a longer list is cut into blocks, and every two blocks meet.
LIST = 4096
#: Rows of a block that are multiplied with all others of their list at once.
STRIP = 256
#: A cell (two first pivots) with more than this share of all vectors, and more than LOW, can become a ball.
SHARE, LOW = 0.001, 64

THETA = float(np.arccos(LEAST))
#: Two vectors that are so near to one centre are linked in any case; the margin is far above rounding errors.
RADIUS = THETA / 2 - 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, however large or small their entries are."""
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def chosen(u: np.ndarray, most: int) -> np.ndarray:
    """The first `most` rows of `u` that lie apart from all chosen before them; two in any case, if there are."""
    out: list[int] = []
    free = np.ones(len(u), bool)
    while len(out) < most and free.any():
        out.append(int(free.argmax()))
        free &= u @ u[out[-1]] < APART
        free[out[-1]] = False
    return u[out] if len(out) > 1 else u[:2]


def described(u: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The `k` pivots nearest to each row of `u`, nearest first; of equally near ones the first."""
    m = len(pivots)
    order = np.rint((u @ pivots.T) * (1 << 40)).astype(np.int64) * m - np.arange(m)
    near = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (len(u), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(order, near, 1), axis=1), 1)


# ---- balls: groups that are so dense that no pair in them needs a look --------------------------------------


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        if b.num_rows:
            cell, u = b.column(0).to_numpy(), unit(_matrix(b.column(1)))
            for c in np.unique(cell).tolist():
                total[c] = total.get(c, 0) + u[cell == c].sum(0)
    for c, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, c), pa.int32()), pa.array(np.arange(v.size), pa.int32()), pa.array(v)], ["cell", "at", "part"])


def centres(table: DataFrame, n: int) -> np.ndarray:
    """Centres of the cells that hold many of the `n` vectors, largest cell first, none near an earlier one.

    At most 1 / SHARE cells are that large, so their sums, and the centres that every task gets, are bounded.
    """
    first, second = F.get("near", F.lit(0)), F.coalesce(F.get("near", F.lit(1)), F.lit(-1))
    cell = F.struct(first.alias("p"), second.alias("q"))
    many = table.groupBy(cell.alias("cell")).count().where(F.col("count") > max(LOW, int(SHARE * n))).orderBy(F.desc("count"), "cell").collect()
    if not many:
        return np.zeros((0, 0))
    spark = table.sparkSession
    known = spark.createDataFrame([(r["cell"]["p"], r["cell"]["q"], k) for k, r in enumerate(many)], "p int, q int, cell int")
    rows = table.select(first.alias("p"), second.alias("q"), "vector").join(F.broadcast(known), ["p", "q"])
    sums = rows.select("cell", "vector").mapInArrow(_cell_sums, "cell int, at int, part double").groupBy("cell", "at").agg(F.sum("part").alias("part")).toArrow()
    total = np.zeros((len(many), 1 + int(sums.column("at").to_numpy().max())))
    total[sums.column("cell").to_numpy(), sums.column("at").to_numpy()] = sums.column("part").to_numpy()
    total = unit(total[np.abs(total).max(1) > 0])
    kept: list[int] = []
    for k in range(len(total)):
        if not kept or (total[kept] @ total[k]).max() < np.cos(np.radians(3)):
            kept.append(k)
    return total[kept]


def _place_task(middle: np.ndarray):
    """Adds to each vector its ball (the first whose centre is near enough; -1: none), and the other balls of which it
    may be linked to some member; of two balls only the later one's members look at the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = unit(_matrix(b.column("vector"))) @ middle.T
                inside = cos >= np.cos(RADIUS)
                ball = np.where(inside.any(1), inside.argmax(1), -1)
                edge = (cos >= np.cos(THETA + RADIUS)) & ((np.arange(len(middle)) < ball[:, None]) | (ball < 0)[:, None])
                counts, which = edge.sum(1), np.nonzero(edge)[1]
                shells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(which, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball, pa.int32()), shells], [*b.schema.names, "ball", "shells"])

    return run


# ---- comparing the members of lists -----------------------------------------------------------------------


class Pairs:
    """Links among the rows of one portion: their number, weighted, and a label of the rows that they connect."""

    def __init__(self, u: np.ndarray, copies: np.ndarray):
        self.u, self.copies, self.links = u, copies, np.zeros(len(u), np.int64)
        self.label, self.held, self.waiting = np.arange(len(u)), [], 0

    def strips(self, left: np.ndarray, right: np.ndarray):
        """Linked (row of left, row of right), verified, strip by strip."""
        for i in range(0, len(left), STRIP):
            a, b = np.nonzero(self.u[left[i : i + STRIP]] @ self.u[right].T >= LEAST)
            if a.size:
                yield left[i + a], right[b]

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.links, a, self.copies[b])
        np.add.at(self.links, b, self.copies[a])
        self.held.append((a, b))
        self.waiting += a.size
        if self.waiting > 1 << 18:
            self.unite()

    def unite(self) -> None:
        """Hooks roots to lesser roots until the held links connect none any more."""
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.waiting, label = [], 0, self.label
        while True:
            ra, rb = label[a], label[b]
            if not (ra != rb).any():
                break
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (label[label] != label).any():
                label = label[label]
        self.label = label


def portions(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4 * LIST) -> Iterator[pa.Table]:
    """Whole groups of rows with equal first `keys` columns, which come sorted by them; some groups at once."""
    held: list[pa.RecordBatch] = []

    def changes(t: pa.Table) -> np.ndarray:
        cols = [t.column(k).to_numpy() for k in range(keys)]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held)
            at = changes(t)
            if at.size:
                yield t.slice(0, int(at[-1])).combine_chunks()
                held = t.slice(int(at[-1])).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    found = t.column(name)
    return found.chunk(0) if found.num_chunks == 1 else found.combine_chunks()


def _groups(t: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    cols = [t.column(k).to_numpy() for k in range(keys)]
    at = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    return np.r_[0, at], np.r_[at, t.num_rows]


OUT = "node long, links long, mate long"


def _out(node, links, mate) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(mate, pa.int64())], ["node", "links", "mate"])


def _list_task(s: int):
    """Of each list (pivot p, residue of the other pivot) the pairs that share p and another pivot q, each pair at its
    two first shared pivots only: it counts if the two share no other pivot below q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in portions(batches, 3):
            node, near, h = t.column("node").to_numpy(), _matrix(_column(t, "near")), t.column("h").to_numpy()
            i, j, lists = (t.column(c).to_numpy() for c in ("i", "j", "list"))
            found = Pairs(unit(_matrix(_column(t, "vector"))), t.column("copies").to_numpy())
            p, residue = lists // s, lists % s
            group = np.zeros(t.num_rows, np.int64)
            group[_groups(t, 3)[0][1:]] = 1
            group = np.cumsum(group)
            row, at = np.nonzero((near > p[:, None]) & (near % s == residue[:, None]))
            q = near[row, at]
            order = np.lexsort((q, group[row]))
            row, q, g = row[order], q[order], group[row][order]
            cut = np.flatnonzero((q[1:] != q[:-1]) | (g[1:] != g[:-1])) + 1
            for x, y in zip(np.r_[0, cut].tolist(), np.r_[cut, len(row)].tolist(), strict=True):
                if y - x < 2:
                    continue
                members, first = row[x:y], row[x]
                one = i[first] == j[first]
                sides = (members, members) if one else (members[h[members] == i[first]], members[h[members] != i[first]])
                for a, b in found.strips(*sides):
                    if one:
                        a, b = a[a < b], b[a < b]
                    for k in range(0, a.size, 1 << 16):
                        c, d = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                        below = (near[c][:, :, None] == near[d][:, None, :]).any(2) & (near[c] < q[x])
                        own = below.sum(1) == 1
                        if own.any():
                            found.take(c[own], d[own])
            found.unite()
            some = found.links > 0
            yield _out(node[some], found.links[some], node[found.label[some]])

    return run


def _shell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each ball and block the links of its members (outside = false) to vectors outside it; `mate` is the ball's
    least node for vectors outside, which are linked to some member, and null for members."""
    for t in portions(batches, 3):
        node, outside, root = t.column("node").to_numpy(), _column(t, "outside").to_numpy(zero_copy_only=False), t.column("root").to_numpy()
        found = Pairs(unit(_matrix(_column(t, "vector"))), t.column("copies").to_numpy())
        for x, y in zip(*(v.tolist() for v in _groups(t, 3)), strict=True):
            rows = np.arange(x, y)
            for a, b in found.strips(rows[outside[x:y]], rows[~outside[x:y]]):
                np.add.at(found.links, a, found.copies[b])
                np.add.at(found.links, b, found.copies[a])
        some = np.flatnonzero(found.links > 0)
        yield _out(node[some], found.links[some], pa.array(root[some], mask=~outside[some]))


# ---- the operator -----------------------------------------------------------------------------------------


def _dealt(rows: DataFrame, first: str) -> DataFrame:
    return rows.repartition(first, "i", "j").sortWithinPartitions(first, "i", "j")


def _through_lists(singles: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """Links among the vectors that are in no ball, through inverted lists."""
    s = min(m, max(1, -(-n * k * 4 // (m * LIST))))  # lists of LIST / 4 on average
    near = F.array_sort("near")
    lists = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.transform(F.slice(near, i + 1, k), lambda q: F.element_at(near, i).cast("long") * s + q % s))))
    entries = singles.select(F.explode(lists).alias("list"), "node", "copies", near.alias("near"), "vector")
    long_, count = staged_rows(entries.groupBy("list").agg(F.count("*").alias("members")).where(F.col("members") > LIST), "pivots-long")
    if not count:
        rows = entries.withColumns({"i": F.lit(0), "j": F.lit(0), "h": F.lit(0)})
    else:
        b = F.coalesce(F.ceil(F.col("members") * 2 / LIST), F.lit(1))
        rows = entries.join(small(long_, count), "list", "left").withColumn("h", F.pmod(F.xxhash64("node"), b).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (b - 1).cast("int")))).withColumns({"i": F.least("h", "other"), "j": F.greatest("h", "other")})
    rows = rows.select("list", "i", "j", "h", "node", "copies", "near", "vector")
    return _dealt(rows, "list").mapInArrow(_list_task(s), OUT)


def _through_shells(table: DataFrame, balls: DataFrame) -> DataFrame:
    """Links of balls' members to vectors outside. Either side is cut into blocks of LIST; every two blocks meet."""
    shell = table.where(F.size("shells") > 0).select(F.explode("shells").alias("ball"), "node", "copies", "vector")
    sizes = shell.groupBy("ball").agg(F.count("*").alias("around")).join(F.broadcast(balls), "ball").select("ball", "root", *[F.ceil(F.col(c) / LIST).cast("int").alias(a) for c, a in (("members", "nb"), ("around", "ns"))])
    sizes = F.broadcast(staged(sizes, "pivots-shells"))  # a row a ball
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = shell.join(sizes, "ball").select("ball", every("nb").alias("i"), block("ns").alias("j"), "node", "copies", "root", "vector", F.lit(True).alias("outside"))
    own = table.where("ball >= 0").join(sizes, "ball").select("ball", block("nb").alias("i"), every("ns").alias("j"), "node", "copies", "root", "vector", F.lit(False).alias("outside"))
    return _dealt(out.unionByName(own), "ball").mapInArrow(_shell_task, OUT)


def vector_links(embeddings: DataFrame) -> DataFrame:
    """One row per row of `embeddings`: (vec_id, n_links, component_id, kept).

    Equal vectors are one, with a weight. Each is described by its nearest pivots in order; those of groups so dense
    that a centre proves their links (balls) are told by it, without pairs, and compared with what lies around; the
    others meet in the inverted lists of the pivots. Pairs that share two pivots are verified by their cosine in double
    precision. Only weights and connecting edges leave a task, never all pairs of a group.

    Vectors that are null, empty, zero or hold null or non-finite entries, or have another length than most have (of
    equally many the shorter), link with nothing. component_id is the least id reachable, null only where all are null;
    kept: vec_id equals component_id, so rows that share the least id are all kept. Rows with null or repeated ids are
    rows like others; labels and other columns do not matter; an empty table gives an empty table.
    """
    kind = embeddings.schema["embedding"].dataType.elementType.typeName()
    c = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0), F.lit(False))
    zero = F.lit(0.0).cast("float" if kind == "float" else "double")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.transform(c, lambda v: v + zero)).alias("vector"))  # -0.0 is 0.0
    top = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = staged(rows.withColumn("vector", F.when(F.size("vector") == (top["d"] if top else -1), F.col("vector"))), "pivots-rows")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not top:
        return alone

    once = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct, n = staged_rows(once.withColumn("node", F.monotonically_increasing_id()), "pivots-distinct")
    some = sampled(distinct.select("vector"), SAMPLE, "vector").toArrow()  # SAMPLE rows
    pivots = chosen(unit(_matrix(_column(some, "vector"))), PIVOTS)
    m, k = len(pivots), min(NEAREST, len(pivots))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = described(unit(_matrix(b.column("vector"))), pivots, k)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(near.ravel(), pa.int32()), k).cast(pa.list_(pa.int32()))], [*b.schema.names, "near"])

    element = "float" if kind == "float" else "double"
    shape = f"vector array<{element}>, copies long, least long, node long, near array<int>"
    table = staged(distinct.mapInArrow(describe, shape), "pivots-described")
    middle = centres(table, n)
    if len(middle):
        table = staged(table.mapInArrow(_place_task(middle), f"{shape}, ball int, shells array<int>"), "pivots-placed")
    else:
        table = table.withColumns({"ball": F.lit(-1), "shells": F.array().cast("array<int>")})
    # a row a ball: fixed in number
    balls = staged(table.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("rows"), F.count("*").alias("members"), F.min("node").alias("root")), "pivots-balls")

    parts = []
    if k > 1:
        parts.append(staged(_through_lists(table.where("ball < 0"), n, m, k), "pivots-lists"))
    if len(middle):
        parts.append(staged(_through_shells(table, balls), "pivots-around"))
    links = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else table.sparkSession.createDataFrame([], OUT)
    entity = table.select("node", "copies", "least", "ball", "vector").join(F.broadcast(balls.select("ball", "rows", "root")), "ball", "left").withColumn("entity", F.coalesce("root", "node"))
    of = entity.select("node", "entity")
    edges = links.where("mate IS NOT NULL AND mate <> node").select("node", F.col("mate").alias("b")).distinct()
    label = components(edges.join(of, "node").select(F.col("entity").alias("a"), "b"), "pivots-cc")
    # least ids by entity, then by component
    least = entity.groupBy("entity").agg(F.min("least").alias("least")).join(label.withColumnRenamed("node", "entity"), "entity", "left")
    least = staged(least.select("entity", F.coalesce("root", "entity").alias("root"), "least"), "pivots-entities")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("entity", "component_id")
    own = entity.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    total = own.withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce(F.col("rows") - F.col("copies"), F.lit(0)))
    # a ball with a third of all vectors is looked up, the others are joined
    of_balls = named.join(F.broadcast(balls.select(F.col("root").alias("entity"))), "entity", "left_semi")
    of_balls = F.broadcast(staged(of_balls, "pivots-named"))
    total = total.where("ball >= 0").join(of_balls, "entity").unionByName(total.where("ball < 0").join(named, "entity"))
    total = staged(total.select("vector", "copies", "n_links", "component_id"), "pivots-total")
    out = join_totals(rows.where("vector IS NOT NULL"), total, "vector", "copies").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
