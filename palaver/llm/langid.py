"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, codes, id_crc, letter_table, sampled, staged

ORDER = 4
FOLDS, HELD_OUT = 4, 2
#: Of the rows to learn from, those whose id's crc32 div 4 is 0 modulo this calibrate the scores and are not counted.
CALIBRATE_EVERY = 16
CALIBRATION_ROWS = 2000
#: Of each language and order a model stores so many n-grams at most, those it would lose most likelihood without; all
#: others count in every statistic and keep their probability mass through the back-off weights.
MAX_GRAMS = 500_000
#: Log-probabilities of so many n-grams and languages are tabulated; others are looked up order by order.
TABLE = 16_000_000
#: Calibration texts that may be rejected although right.
REJECT_SHARE = 0.005

_W = np.uint64(16)


def padded(text: str | None) -> np.ndarray:
    """Lower-case letters with single spaces between words, three spaces before and one after; empty if no letter."""
    c, _ = codes(text or "", letter_table())
    if not c.size or not any(ch.isalpha() for ch in text):  # combining marks alone are no letters
        return np.empty(0, np.uint64)
    out = np.full(c.size + ORDER, 32, np.uint64)
    out[ORDER - 1 : -1] = c
    return out


def packed(c: np.ndarray) -> np.ndarray:
    """All n-grams of ORDER codes, exactly: 16 bits a code."""
    n = c.size - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return (c[:n] << np.uint64(48)) | (c[1 : n + 1] << np.uint64(32)) | (c[2 : n + 2] << _W) | c[3 : n + 3]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in the sorted keys, -1 where it is missing."""
    if not keys.size:
        return np.full(wanted.size, -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == keys.size] = 0
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Level:
    """One order of one language: sorted n-grams with their probabilities, sorted contexts with their back-off weights."""

    grams: np.ndarray
    probs: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _prob(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """Interpolated probability of the last character of each n-gram of order len(levels)."""
    order = len(levels)
    if not order:
        return np.full(grams.size, 1 / 65536)
    top = levels[-1]
    at = _find(top.grams, grams)
    out = np.where(at >= 0, top.probs[at], 0.0)
    miss = np.nonzero(at < 0)[0]
    if miss.size:
        g = grams[miss]
        k = _find(top.contexts, g >> _W) if order > 1 else np.zeros(miss.size, np.int64)
        lam = np.where(k >= 0, top.backoff[k], 1.0)
        out[miss] = lam * _prob(levels[:-1], g & np.uint64((1 << 16 * (order - 1)) - 1))
    return out


@dataclass
class Model:
    """Sorted arrays of all n-grams any language has, with one row of log-probabilities each, and calibration."""

    langs: list[str]
    levels: list[list[Level]]
    keys: np.ndarray
    rows: np.ndarray
    beta: float = 40.0
    reject: float = 0.0

    def entropies(self, texts: list[str | None], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in each language, and the number of characters scored, of every whole text."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for i, j in blocks([len(t or "") for t in texts], limit):
            for r, c in ((r, padded(texts[r])) for r in range(i, j)) if j - i < 3 else ():
                for a in range(0, max(0, c.size - ORDER + 1), limit):
                    g = packed(c[a : a + limit + ORDER - 1])
                    out[r] -= self._logs(g).sum(0)
                    sizes[r] += g.size
            if j - i < 3:
                continue
            parts = [packed(padded(t)) for t in texts[i:j]]
            sizes[i:j] = [p.size for p in parts]
            some = np.nonzero(sizes[i:j])[0]
            if some.size:
                starts = np.r_[0, np.cumsum(sizes[i:j][some])[:-1]]
                out[i + some] = -np.add.reduceat(self._logs(np.concatenate(parts)), starts, axis=0)
        return out / np.maximum(sizes, 1)[:, None], sizes

    def _logs(self, g: np.ndarray) -> np.ndarray:
        at = _find(self.keys, g)
        out = self.rows[at]
        miss = np.nonzero(at < 0)[0]
        if miss.size:
            u, inv = np.unique(g[miss], return_inverse=True)
            out[miss] = np.stack([np.log(_prob(v, u)) for v in self.levels], 1).astype(np.float32)[inv]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of every text: the lowest entropy, and its softmax share."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, sizes = self.entropies(texts)
        best = h.argmin(1)
        # a short text says less: its share shrinks towards even
        gap = (h - h.min(1, keepdims=True)) * self.beta * (sizes / (sizes + 20.0))[:, None]
        score = np.where(sizes > 0, 1 / np.exp(-np.minimum(gap, 500)).sum(1), 0.0)
        return [self.langs[k] if n else "und" for k, n in zip(best, sizes, strict=True)], score, (score < self.reject) | (sizes == 0)


_KEY = ["lang", "gram"]


def smoothed(counts: DataFrame, most: int = MAX_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Interpolated Kneser-Ney of (lang, gram, n): rows (lang, o, gram, p) and back-off weights (lang, o, ctx, w).

    Lower orders count the distinct characters before an n-gram; counts, counts of counts, and so the discounts, and the
    totals of contexts cover every n-gram. Of a language with more than `most` n-grams of an order, those are left out
    without which the text counted would lose least likelihood; their contexts' weights are computed anew, so that the
    probabilities after every context still sum up to one.
    """
    own = F.broadcast(counts.select("lang").distinct())  # one row a language
    orders = [counts.select(*_KEY, F.col("n").cast("double").alias("n"))]
    for order in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))
        orders.insert(0, staged(orders[0].select("lang", low.alias("gram")).groupBy(*_KEY).agg(F.count("*").cast("double").alias("n")), f"langid-{order}"))
    probs, weights = [], []
    lower = own.select("lang", F.lit(0).cast("long").alias("low"), F.lit(1 / 65536).alias("q"))
    for order, table in enumerate(orders, 1):
        seen = table.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("ones"), F.count(F.when(F.col("n") == 2, 1)).alias("twos"), F.count("*").alias("all"))
        raw = F.col("ones") / (F.col("ones") + 2 * F.col("twos"))
        d = seen.select("lang", "all", F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.when(F.col("ones") + F.col("twos") > 0, raw))), F.lit(0.5)).alias("d"))
        low = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
        t = table.join(F.broadcast(d), "lang").withColumn("ctx", F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")).withColumn("low", low)
        ctx = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        t = t.join(ctx, ["lang", "ctx"]).join(lower, ["lang", "low"]).withColumn("lam", F.col("d") * F.col("kinds") / F.col("total"))
        t = t.withColumn("p", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("lam") * F.col("q"))
        t = staged(t.withColumn("loss", F.col("n") * F.log(F.col("p") / (F.col("lam") * F.col("q")))), f"langid-p{order}")
        # of each language, the least loss that is kept, among a thousand cuts; a row a language
        cuts = t.groupBy("lang").agg(F.first("all").alias("c"), F.percentile_approx("loss", [k / 1000 for k in range(1000)], 10_000).alias("q"))
        at = F.element_at("q", F.least(F.lit(1000), F.ceil((1 - most / F.col("c")) * 1000) + 1).cast("int"))
        cuts = cuts.select("lang", F.when(F.col("c") > most, at).otherwise(F.lit(float("-inf"))).alias("cut"))
        t = t.join(F.broadcast(cuts), "lang").withColumn("kept", F.col("loss") >= F.col("cut"))
        left = F.when(F.col("kept"), F.col("p")), F.when(F.col("kept"), F.col("q"))
        w = t.groupBy("lang", "ctx").agg(F.first("lam").alias("lam"), F.sum(left[0]).alias("mass"), F.sum(left[1]).alias("below"), F.count(F.when(~F.col("kept"), 1)).alias("gone"))
        anew = (1 - F.coalesce("mass", F.lit(0.0))) / F.greatest(F.lit(1e-12), 1 - F.coalesce("below", F.lit(0.0)))
        w = staged(w.select("lang", "ctx", F.when(F.col("gone") == 0, F.col("lam")).otherwise(anew).alias("w"), F.col("mass").isNotNull().alias("some")), f"langid-w{order}")
        # a context of which no n-gram is kept has the weight 1, which is what a missing row means
        weights.append(w.where("some").select("lang", F.lit(order).alias("o"), "ctx", "w"))
        probs.append(t.where("kept").select("lang", F.lit(order).alias("o"), "gram", "p"))
        lower = t.join(w, ["lang", "ctx"]).select("lang", F.col("gram").alias("low"), F.when(F.col("kept"), F.col("p")).otherwise(F.col("w") * F.col("q")).alias("q"))
        lower = staged(lower, f"langid-q{order}")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(probs), union(weights)


def _sorted(table: DataFrame, key: str, value: str) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """(language, order) to sorted keys and their values."""
    got = table.select("lang", "o", key, value).toArrow()
    lang, o, k, v = got.column(0).to_numpy(zero_copy_only=False), got.column(1).to_numpy(), got.column(2).to_numpy().view(np.uint64), got.column(3).to_numpy()
    out = {}
    for name in sorted(set(lang.tolist())):
        for order in range(1, ORDER + 1):
            own = np.nonzero((lang == name) & (o == order))[0]
            own = own[np.argsort(k[own])]
            out[name, order] = (k[own], v[own])
    return out


def build(counts: DataFrame, most: int = MAX_GRAMS) -> Model:
    """Model from (lang, gram, n); the driver gets at most `most` n-grams and contexts of a language and order."""
    probs, weights = smoothed(counts, most)
    grams, contexts = _sorted(probs, "gram", "p"), _sorted(weights, "ctx", "w")
    langs = sorted({k for k, _ in grams})
    none = (np.empty(0, np.uint64), np.empty(0))
    levels = [[Level(*grams[k, o], *contexts.get((k, o), none)) for o in range(1, ORDER + 1)] for k in langs]
    if not langs:
        return Model([], [], np.empty(0, np.uint64), np.empty((0, 0), np.float32))
    keys, seen = np.unique(np.concatenate([v[-1].grams for v in levels]), return_counts=True)
    if keys.size * len(langs) > TABLE:
        keys = np.sort(keys[np.argsort(-seen, kind="stable")[: TABLE // len(langs)]])
    rows = np.stack([np.log(_prob(v, keys)) for v in levels], 1).astype(np.float32)
    return Model(langs, levels, keys, rows)


def calibrate(model: Model, h: np.ndarray, sizes: np.ndarray, langs: list[str], share: float = REJECT_SHARE) -> None:
    """Choose the softmax scale by likelihood on texts the model has not counted, then the score to reject below.

    `h` and `sizes` are the texts' entropies and scored characters.
    """
    at = {k: i for i, k in enumerate(model.langs)}
    use = [i for i, k in enumerate(langs) if k in at and sizes[i]]
    if not use:
        return
    h, sizes, y = h[use], sizes[use], np.array([at[langs[i]] for i in use])
    gap = (h - h.min(1, keepdims=True)) * (sizes / (sizes + 20.0))[:, None]
    likelihood = lambda b: np.mean(np.log(np.exp(-np.minimum(gap * b, 500)).sum(1)) + np.minimum(gap * b, 500)[np.arange(len(y)), y])
    model.beta = float(min((5.0 * 1.3**k for k in range(20)), key=likelihood))
    right = h.argmin(1) == y
    if right.any():
        score = 1 / np.exp(-np.minimum(gap * model.beta, 500)).sum(1)
        model.reject = float(np.quantile(score[right], share))


def _measure(model: Model):
    """Rows (lang, text) to rows (lang, size, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, sizes = model.entropies(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(list(h), pa.list_(pa.float64()))], ["lang", "size", "h"])

    return run


def _count(batches: Iterator[pa.RecordBatch], flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (lang, gram, n), merged in the task as far as `flush` distinct n-grams."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang, keys, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * keys.size, pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for k, t in zip(langs, texts, strict=True) if k == lang]
            for i, j in blocks([len(t) for t in own], 2 << 20):
                u, n = np.unique(np.concatenate([packed(padded(t)) for t in own[i:j]]), return_counts=True)
                if lang in held:
                    keys, inv = np.unique(np.concatenate([held[lang][0], u]), return_inverse=True)
                    u, n = keys, np.bincount(inv, np.concatenate([held[lang][1], n]), keys.size).astype(np.int64)
                held[lang] = (u, n.astype(np.int64))
                if u.size > flush:
                    yield out(lang, *held.pop(lang))
    for lang, (u, n) in held.items():
        for i in range(0, u.size, 100_000):
            yield out(lang, u[i : i + 100_000], n[i : i + 100_000])


def train(docs: DataFrame) -> Model:
    """Count the n-grams of every row to learn from, and calibrate on the few that are not counted.

    Counts cover the whole texts of all those rows and everything is computed from them in the cluster. At most
    CALIBRATION_ROWS rows, their whole texts, are measured for the calibration; the driver gets their entropies.
    """
    crc = id_crc("doc_id")
    learn = docs.where("lang is not null and text is not null").where(F.coalesce(crc % FOLDS != HELD_OUT, F.lit(True)))
    aside = F.coalesce((F.floor(crc / FOLDS) % CALIBRATE_EVERY) == 0, F.lit(False))
    counts = learn.where(~aside).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    model = build(staged(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams"))
    some = sampled(learn.where(aside).select("doc_id", "text", "lang"), CALIBRATION_ROWS, "doc_id", "text").select("lang", "text")
    if model.langs:
        held = some.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(_measure(model), "lang string, size long, h array<double>").toArrow()
        calibrate(model, np.array(held.column(2).to_pylist()).reshape(held.num_rows, len(model.langs)), held.column(1).to_numpy(), held.column(0).to_pylist())
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, lang_pred, score, rejected).

    The language with the lowest cross-entropy per character; `und`, score 0 and rejected where the text is null or has
    no letter, or nothing could be learned. rejected: the score is below what all but REJECT_SHARE of right
    calibration texts reach. Null ids are predicted like others, not held out. Repeated rows repeat.
    """
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")
    return out.select(F.col("id").alias("doc_id"), F.coalesce(id_crc("id") % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
