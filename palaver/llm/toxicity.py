"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyProbe, blocks, codes, id_crc, letter_table, sampled, staged

ORDERS = (3, 4, 5)
#: The classifier is fitted on at most so many labelled rows of each class, their whole texts.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Features are all n-grams that so many sample texts have and whose shares in the classes differ, in whichever
#: direction and by whatever factor, by this z-score.
MIN_TEXTS, MIN_Z = 3, 3.3
FOLDS, HELD_OUT = 5, 0

_STEP, _M = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams of 16-bit codes."""
    n = c.size - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, order, np.uint64)
    for k in range(order):
        out *= _STEP
        out += c[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _M
    return out ^ (out >> np.uint64(29))


def text_codes(text: str | None) -> np.ndarray:
    """Letters in lower case, words apart by one space, a space at both ends."""
    c, _ = codes(text or "", letter_table())
    out = np.full(c.size + 2, 32, np.uint64)
    out[1:-1] = c
    return out


def present(texts: list[str | None], probe: KeyProbe, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text, key) blocks: which distinct keys every whole text holds, as positions in the sorted keys."""
    n = max(1, probe.keys.size)
    for i, j in blocks([len(t or "") for t in texts], limit):
        parts = [text_codes(t) for t in texts[i:j]]
        whole = np.concatenate(parts)
        doc = np.repeat(np.arange(j - i), [p.size for p in parts])
        found = []
        for order in ORDERS:
            at, k = probe.find(grams(whole, order))
            inside = doc[at] == doc[at + order - 1] if at.size else np.empty(0, bool)
            found.append(doc[at[inside]] * np.int64(n) + k[inside])
        once = np.unique(np.concatenate(found))
        yield i, once // n, once % n


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of weights of the distinct n-grams that a text holds)))."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, texts: list[str | None], limit: int = 1 << 18) -> np.ndarray:
        w = self.weights[np.argsort(self.keys)]
        out = np.full(len(texts), float(self.bias))
        for i, text, key in present(texts, KeyProbe(self.keys), limit):
            if text.size:
                n = int(text.max()) + 1
                out[i : i + n] += np.bincount(text, w[key], n)
        return out


def _frequencies(batches: Iterator[pa.RecordBatch], flush: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) to rows (gram, toxic, clean): the number of texts that hold it, merged in the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys, inv = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.stack([np.bincount(inv, np.concatenate([v[:, c] for _, v in held]), keys.size) for c in (0, 1)], 1)
        return keys, n.astype(np.int64)

    def out(keys, n):
        for i in range(0, keys.size, 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000, 0]), pa.array(n[i : i + 200_000, 1])], ["gram", "toxic", "clean"])

    for b in batches:
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            c = text_codes(t)
            own = np.unique(np.concatenate([grams(c, n) for n in ORDERS]))
            n = np.zeros((own.size, 2), np.int64)
            n[:, 0 if y else 1] = 1
            held.append((own, n))
            size += own.size
            if size > flush:
                held = [merged()]
                if held[0][0].size > flush // 2:
                    yield from out(*held.pop())
                size = sum(k.size for k, _ in held)
    if held:
        yield from out(*merged())


def _holds(keys: np.ndarray):
    """Rows (y, text) to rows (y, n, features): positions in the sorted keys, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = KeyProbe(keys)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [b""] * len(texts)
            for i, text, key in present(texts, probe):
                cuts = np.searchsorted(text, np.arange((int(text.max()) if text.size else -1) + 2))
                for r in range(cuts.size - 1):
                    rows[i + r] = key[cuts[r] : cuts[r + 1]].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["y", "features"])

    return run


def solve(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 1.0, bias_ridge: float = 1e-3) -> np.ndarray:
    """L2-regularised logistic regression on sparse rows of scaled 0/1 features and a bias, the last weight.

    Newton steps, each solved by conjugate gradients: only products with the sparse matrix, no dense one is made.
    """
    n, k = len(rows), scale.size
    sizes = np.array([r.size for r in rows], np.int64)
    some, starts = sizes > 0, (np.cumsum(sizes) - sizes)[sizes > 0]
    col = np.concatenate([*rows, np.empty(0, np.uint32)]).astype(np.uint32)  # all that is kept of the matrix

    def forward(w):
        out = np.full(n, w[-1])
        if starts.size:
            out[some] += np.add.reduceat((scale * w[:-1])[col], starts)
        return out

    def back(v):
        return np.r_[scale * np.bincount(col, np.repeat(v, sizes), k), v.sum()]

    pull = np.r_[np.full(k, ridge), bias_ridge]
    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))

    def loss(w):
        m = forward(w)
        return np.logaddexp(0, np.where(y > 0, -m, m)).sum() + 0.5 * (pull * w * w).sum()

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -500, 500)))
        grad, h = back(p - y) + pull * w, p * (1 - p)
        step, r = np.zeros_like(w), -grad
        d, rr = r.copy(), float(r @ r)
        stop = 1e-6 * rr
        for _ in range(60):
            if rr <= stop:
                break
            hd = back(h * forward(d)) + pull * d
            a = rr / float(d @ hd)
            step, r = step + a * d, r - a * hd
            new = float(r @ r)
            d, rr = r + new / rr * d, new
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if after >= now:
            break
        w, gain, now = w + size * step, now - after, after
        if gain < 1e-7 * max(1.0, now):
            break
    return w


def fit(sample: DataFrame, min_z: float = MIN_Z, min_texts: int = MIN_TEXTS) -> Model:
    """Naive Bayes ratios of both classes, a z-test to choose the n-grams, then logistic regression on the scaled ones.

    `sample` has (y, text), y 1 or 0. Its texts stay in the cluster: the driver gets the chosen n-grams and, of every
    text, which of them it holds.
    """
    counts = {bool(r.y): r["count"] for r in sample.groupBy("y").count().collect()}
    ta, tb = counts.get(True, 0), counts.get(False, 0)
    none = Model(np.empty(0, np.uint64), np.empty(0), float(np.log((ta + 1) / (tb + 1))) if ta + tb else -1.0)
    if not ta or not tb:
        return none
    seen = sample.select("y", "text").mapInArrow(_frequencies, "gram long, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = (F.col("a") + F.col("b")) / (ta + tb)
    z = (F.col("a") / ta - F.col("b") / tb) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / ta + 1 / tb))
    got = seen.where((F.col("a") + F.col("b") >= min_texts) & (F.abs(z) >= min_z)).toArrow()
    if not got.num_rows:
        return none
    keys, a, b = (got.column(c).to_numpy() for c in range(3))
    order = np.argsort(keys.view(np.uint64))
    keys, a, b = keys.view(np.uint64)[order], a[order], b[order]
    ratio = np.log(((a + 1) / (ta + 2)) / ((b + 1) / (tb + 2)))
    held = sample.select("y", "text").mapInArrow(_holds(keys), "y int, features binary").toArrow()
    rows = [np.frombuffer(x, "<u4") for x in held.column(1).to_pylist()]
    w = solve(rows, held.column(0).to_numpy().astype(float), ratio)
    return Model(keys, w[:-1] * ratio, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold, the smallest ids' hashes first.

    At most SAMPLE_TOXIC + SAMPLE_CLEAN rows; their texts count whole, however long.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(id_crc("id") % FOLDS != HELD_OUT)
    # one label a document: the larger where labels disagree
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    # the ids are drawn from the narrow label table, some more than needed as not every id has a text
    ids = sampled(known.where("y = 1"), 2 * SAMPLE_TOXIC, "id").unionByName(sampled(known.where("y = 0"), 2 * SAMPLE_CLEAN, "id"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "id")
    some = [sampled(rows.where(F.col("y") == y), n, "id", "text").select("y", "text") for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = staged(some[0].unionByName(some[1]), "toxicity-sample")
    return fit(sample.repartition(max(2, sample.sparkSession.sparkContext.defaultParallelism)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every whole text; a null or empty text has the score of no n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model.margins(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))))], ["id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, score, predicted); predicted is 1 from a score of 0.5 on.

    Rows with null or repeated ids are scored like others. Without labels of both classes nothing is toxic.
    """
    out = score(docs, model or train(docs, labels))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(id_crc("id") % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the classifier rejects; their columns unchanged."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.margins(b.column(at).to_pylist()) < 0))

    return docs.mapInArrow(run, docs.schema)
