"""Embeddings, exact nearest neighbours, and fusion of rankings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING_RANK, RRF_K, l2, normalized, rrf_score, words

# fixed values: the hashing embedding
DIMENSIONS, TOKEN_WEIGHT, BIGRAM_WEIGHT = 128, 1.0, 1.25
SCHEMA = "chunk_id long, provider string, model string, dims int, chunk_fingerprint string, vector array<float>"


def hash_vector(tokens: list[str], dims: int = DIMENSIONS) -> list[float]:
    """Signed feature hashing of tokens and pairs of neighbours, at length one; the first axis if nothing is left."""
    v = [0.0] * dims
    features = [(f"tok:{t}", TOKEN_WEIGHT) for t in tokens] + [(f"big:{a}:{b}", BIGRAM_WEIGHT) for a, b in zip(tokens, tokens[1:], strict=False)]
    for name, weight in features:
        d = hashlib.blake2b(name.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "big") % dims] += weight if d[4] % 2 else -weight
    size = sum(x * x for x in v) ** 0.5
    return [x / size for x in v] if size else [1.0] + [0.0] * (dims - 1)


def spread(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text) dealt by chunk: a file is read in as many tasks as it has row groups, which may be one."""
    return chunks.select("chunk_id", "text").repartition(4 * chunks.sparkSession.sparkContext.defaultParallelism, "chunk_id")


def hash_embed(chunks: DataFrame, dims: int = DIMENSIONS) -> DataFrame:
    """(chunk_id, vector): words are cut by Spark; only the blake2b hashing runs in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [hash_vector(t, dims) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["chunk_id", "vector"])

    return spread(chunks).select(F.col("chunk_id").cast("long").alias("chunk_id"), words(F.coalesce("text", F.lit(""))).alias("w")).mapInArrow(run, "chunk_id long, vector array<float>")


def sha_features(chunks: DataFrame, dims: int = DIMENSIONS) -> DataFrame:
    """(chunk_id, bucket, weight): the same scheme over SHA-256 in built-in functions only, as sparse rows.

    The texts are shuffled, by chunk, instead of their features, so a chunk's features are summed where they are made.
    """
    t = spread(chunks).select("chunk_id", words("text").alias("w"))
    token = F.transform("w", lambda x: F.struct(F.concat(F.lit("tok:"), x).alias("name"), F.lit(TOKEN_WEIGHT).alias("weight")))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.concat(F.lit("big:"), F.element_at("w", i), F.lit(":"), F.element_at("w", i + 1)).alias("name"), F.lit(BIGRAM_WEIGHT).alias("weight"))))
    rows = t.select("chunk_id", F.explode(F.concat(token, F.coalesce(pairs, F.array().cast("array<struct<name:string,weight:double>>")))).alias("f"))
    h = F.sha2(F.col("f.name"), 256)
    # five bytes: the bucket from four, the sign from the last one
    rows = rows.select("chunk_id", F.conv(F.substring(h, 1, 10), 16, 10).cast("long").alias("h"), F.col("f.weight").alias("w"))
    bucket = (F.shiftright("h", 8) % dims).cast("int")
    return rows.select("chunk_id", bucket.alias("bucket"), F.when(F.col("h") % 2 == 1, F.col("w")).otherwise(-F.col("w")).alias("weight")).groupBy("chunk_id", "bucket").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def stale(chunks: DataFrame, stored: DataFrame, provider: str, model: str, dims: int) -> DataFrame:
    """Chunks without an embedding of this provider, model and size for their present fingerprint."""
    own = stored.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == dims))
    return chunks.join(own.select("chunk_id", F.col("chunk_fingerprint").alias("fingerprint")), ["chunk_id", "fingerprint"], "left_anti")


def refresh(chunks: DataFrame, stored: DataFrame, embed: Callable[[DataFrame], DataFrame], provider: str, model: str, dims: int) -> DataFrame:
    """The embedding table brought up to date: stale rows embedded anew, rows whose chunk is gone dropped."""
    todo = stale(chunks, stored, provider, model, dims)
    new = embed(todo).join(todo.select("chunk_id", F.col("fingerprint").alias("chunk_fingerprint")), "chunk_id")
    new = new.select("chunk_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dims).alias("dims"), "chunk_fingerprint", "vector")
    mine = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == dims)
    live = chunks.select("chunk_id", F.col("fingerprint").alias("chunk_fingerprint"))
    kept = stored.where(mine).join(live, ["chunk_id", "chunk_fingerprint"], "left_semi").select(*stored.columns)
    return stored.where(~mine).unionByName(kept).unionByName(new)


def indexed_count(stored: DataFrame, provider: str, model: str, dims: int) -> DataFrame:
    """One row (n): the embeddings of this provider, model and size."""
    return stored.agg(F.count(F.when((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == dims), 1)).alias("n"))


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, key: str = "chunk_id") -> DataFrame:
    """(key, distance, position): the exact `limit` nearest by L2; the query vector is a literal.

    One scan; each task keeps its own best `limit` and only these meet, so nothing is shuffled by key.
    """
    q = F.lit([float(x) for x in query])
    d = vectors.select(key, l2("vector", q).alias("distance"))
    top = d.orderBy("distance", key).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("distance", key)))


def semantic_search(chunks: DataFrame, stored: DataFrame, query: list[float], limit: int, provider: str, model: str) -> DataFrame:
    """Evidence rows of the nearest chunks, with distance as rank. Raises if nothing is indexed."""
    own = stored.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == len(query)))
    if own.isEmpty():
        raise ValueError("the vector index is empty; index the chunks first")
    top = nearest(own.select("chunk_id", "vector"), query, limit)
    return chunks.join(F.broadcast(top), "chunk_id").withColumnRenamed("distance", "rank")


def unit(vector):
    return normalized(vector)


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int | None = 10, key: str = "evidence_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (key, position): ranks, score and position.

    Order: score, then the lexical, then the semantic rank (a missing one comes last), then the key. With limit None
    all candidates stay, as a trace.
    """
    a, b = lexical.select(key, F.col("position").alias("lexical_rank")), semantic.select(key, F.col("position").alias("semantic_rank"))
    both = a.join(b, key, "full").withColumn("score", rrf_score("lexical_rank", "semantic_rank", k=k))
    order = (F.col("score").desc(), F.coalesce("lexical_rank", F.lit(MISSING_RANK)), F.coalesce("semantic_rank", F.lit(MISSING_RANK)), F.col(key))
    top = both.orderBy(*order).limit(limit) if limit else both
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # two lists of limited length


def candidate_limit(limit: int) -> int:
    return max(limit, 4 * limit)


class HashProvider:
    """The local embedding provider."""

    provider, model, dims = "hash", "local-hash-v1", DIMENSIONS

    def embed_query(self, spark, text: str) -> list[float]:
        return hash_embed(spark.createDataFrame([(0, text)], "chunk_id long, text string")).first()["vector"]

    def __call__(self, chunks: DataFrame) -> DataFrame:
        return hash_embed(chunks, self.dims)


class HttpProvider:
    """Vectors from an embedding server, requested in batches from the executors and brought to length one."""

    def __init__(self, url: str, model: str, dims: int, batch: int = 16, timeout: float = 30.0):
        self.url, self.model, self.dims, self.batch, self.timeout, self.provider = url, model, dims, batch, timeout, "ollama"

    def request(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        body = json.dumps({"model": self.model, "input": texts}).encode()
        call = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(call, timeout=self.timeout) as answer:
            got = json.load(answer).get("embeddings")
        if not isinstance(got, list) or len(got) != len(texts):
            raise ValueError("the embedding server returned another number of vectors")
        out = []
        for v in got:
            size = sum(float(x) ** 2 for x in v) ** 0.5
            if not size:
                raise ValueError("the embedding server returned a zero vector")
            out.append([float(x) / size for x in v])
        return out

    def embed_query(self, spark, text: str) -> list[float]:
        del spark
        return self.request([text])[0]

    def __call__(self, chunks: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                got = [v for i in range(0, len(texts), self.batch) for v in self.request(texts[i : i + self.batch])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float32()))], ["chunk_id", "vector"])

        return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").mapInArrow(run, "chunk_id long, vector array<float>")


HASH_NAMES = ("hash", "local", "local-hash", "local_hash")


def resolve_provider(name: str | None = None, env: dict | None = None, config: dict | None = None, default: str = "ollama", **http):
    """The embedding provider: the argument, then PALAVER_EMBEDDINGS of the environment, then the settings, then the default."""
    import os

    env, config = os.environ if env is None else env, config or {}
    chosen = (name or env.get("PALAVER_EMBEDDINGS") or config.get("provider") or default).casefold()
    if chosen in HASH_NAMES:
        return HashProvider()
    if chosen != "ollama":
        raise ValueError(f"unknown embedding provider: {chosen}")
    url = http.get("url") or env.get("PALAVER_EMBEDDINGS_URL") or config.get("url") or "http://127.0.0.1:11434/api/embed"
    return HttpProvider(url, http.get("model") or config.get("model") or "nomic-embed-text", int(http.get("dims") or config.get("dims") or 768))
