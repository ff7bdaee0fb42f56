"""Embedding texts: a provider protocol, the feature-hashing provider, and the cache of vectors as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.ids import stable_hash

TOKEN_WEIGHT, TRIGRAM_WEIGHT, BIGRAM_WEIGHT = 1.0, 0.35, 0.6


class EmbeddingProvider(Protocol):
    """What computes vectors; one is made in each Python worker by the factory that ``embed`` gets."""

    name: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


def features(tokens: Column | str) -> Column:
    """An array of (feature, weight): tokens, character trigrams of the padded tokens, and neighbouring pairs."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    weighted = lambda f, w: F.struct(f.alias("feature"), F.lit(w).alias("weight"))
    words = F.transform(t, lambda x: weighted(x, TOKEN_WEIGHT))
    padded = F.transform(t, lambda x: F.concat(F.lit("^"), x, F.lit("$")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: weighted(F.substring(p, i, F.lit(3)), TRIGRAM_WEIGHT))))
    pairs = F.when(F.size(t) > 1, F.transform(F.arrays_zip(F.slice(t, 1, F.size(t) - 1).alias("a"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1))).alias("b")), lambda p: weighted(F.concat_ws("_", p["a"], p["b"]), BIGRAM_WEIGHT)))
    return F.concat(words, grams, F.coalesce(pairs, F.slice(words, 1, 0)))


class HashingEmbedder:
    """Signed feature hashing: no model, the same vector everywhere."""

    def __init__(self, dimensions: int = 256):
        self.dimensions, self.name = dimensions, "hashing"
        self.memo: dict[str, tuple[int, float]] = {}
        self.stop = frozenset(tx.STOP_WORDS)

    def _place(self, feature: str) -> tuple[int, float]:
        if feature not in self.memo:
            if len(self.memo) >= 1_000_000:
                self.memo.clear()
            h = stable_hash(feature)
            self.memo[feature] = int(h[:12], 16) % self.dimensions, 1.0 if int(h[12], 16) & 1 else -1.0
        return self.memo[feature]

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            t = [w for w in re.findall(tx.TOKEN, (text or "").lower()) if len(w) > 1 and w not in self.stop]
            for features_, weight in ((t, TOKEN_WEIGHT), ((p[i : i + 3] for w in t for p in (f"^{w}$",) for i in range(len(w))), TRIGRAM_WEIGHT), ((f"{a}_{b}" for a, b in zip(t, t[1:])), BIGRAM_WEIGHT)):
                for f in features_:
                    at, sign = self._place(f)
                    row[at] += sign * weight
        length = np.linalg.norm(out, axis=1)
        return out / np.where(length > 0, length, 1.0)[:, None]


def embed(rows: DataFrame, factory: Callable[[], EmbeddingProvider], text_col: str = "text", out_col: str = "vec") -> DataFrame:
    """Adds the vector of ``text_col``; the provider is made once per worker and gets whole Arrow batches."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider = factory()
        for texts in batches:
            m = provider.embed_batch([t or "" for t in texts.to_pylist()]).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel())) if len(m) else pa.array([], type=pa.list_(pa.float32()))

    return rows.withColumn(out_col, vectors(text_col))


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors from token states (texts, tokens, width): the mean over the tokens that the mask keeps; zero without any."""
    m = mask[:, :, None].astype(np.float64)
    mean = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(length > 0, length, 1.0)


class OnnxEmbedder:
    """A sentence encoder from local files: an ONNX model and its tokenizer. Texts are cut to ``tokens`` tokens by the model's
    own limit, and run in batches."""

    def __init__(self, model: str, tokenizer: str, dimensions: int, tokens: int = 256, batch: int = 32):
        import os

        for f in (model, tokenizer):
            if not os.path.exists(f):
                raise FileNotFoundError(f"the encoder needs {f}, which isn't there")
        import onnxruntime
        import tokenizers

        self.name, self.dimensions, self.batch = os.path.basename(model), dimensions, batch
        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        self.tokenizer = tokenizers.Tokenizer.from_file(tokenizer)
        self.tokenizer.enable_truncation(tokens)
        self.tokenizer.enable_padding()

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        wanted = {i.name for i in self.session.get_inputs()}
        out = [np.zeros((0, self.dimensions))]
        for i in range(0, len(texts), self.batch):
            coded = self.tokenizer.encode_batch(texts[i : i + self.batch])
            mask = np.array([c.attention_mask for c in coded], dtype=np.int64)
            given = {"input_ids": np.array([c.ids for c in coded], dtype=np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = self.session.run(None, {k: v for k, v in given.items() if k in wanted})[0]
            out.append(mean_pooled(states, mask))
        return np.concatenate(out)


class RemoteEmbedder:
    """Vectors from an endpoint: ``call(texts)`` gives (index, vector) pairs in any order; failures worth it are tried again."""

    def __init__(self, call: Callable[[list[str]], list[tuple[int, list[float]]]], name: str, dimensions: int, batch: int = 128, attempts: int = 4):
        self.call, self.name, self.dimensions, self.batch, self.attempts = call, name, dimensions, batch, attempts

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        from gleaner.functions.retries import with_retries

        out = np.zeros((len(texts), self.dimensions))
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            answers = with_retries(lambda: self.call(part), self.attempts)  # noqa: B023
            if sorted(n for n, _ in answers) != list(range(len(part))):
                raise ValueError("the endpoint gave other vectors than were asked for")
            for n, v in answers:
                out[i + n] = v
        return out


def preflight(provider: EmbeddingProvider) -> None:
    """One vector of a short text, so that a wrong model or endpoint shows before a corpus is read."""
    got = provider.embed_batch(["a short text to try"])
    if got.shape != (1, provider.dimensions):
        raise ValueError(f"the provider {provider.name} gives vectors of shape {got.shape[1:]}, not {provider.dimensions} numbers")


# --- the cache ----------------------------------------------------------------------------------------------------


def cache_hits(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The cached rows that are wanted; of repeated ones the last."""
    return last_wins(cache, keys, "cached_at").join(wanted.select(*keys).distinct(), keys, "left_semi")


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted keys that the cache lacks, each once."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def cache_put(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with new rows in the place of old ones."""
    return cache.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last_wins(new, keys, "cached_at"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(order).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))).alias("r"), F.max(order).alias(order))
    return last.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest), order)


def evict(entries: DataFrame, most: int, hits: str, order: str) -> DataFrame:
    """The ``most`` entries with the most hits, of equal ones the newest: a sorted limit, not a window over one partition."""
    return entries.orderBy(F.col(hits).desc(), F.col(order).desc()).limit(most)


CACHE = "model string, dim int, key string, vec array<float>, cached_at timestamp_ntz"


class CacheTable:
    """The cache of vectors as a folder of appended Parquet files; of repeated keys the last row counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(CACHE).parquet(self.path) if there else self.spark.createDataFrame([], CACHE)

    def put(self, new: DataFrame) -> None:
        new.select("model", "dim", "key", "vec", "cached_at").write.mode("append").parquet(self.path)

    def count(self) -> int:
        return self.read().select("model", "dim", "key").distinct().count()

    def clear(self) -> None:
        self.spark.createDataFrame([], CACHE).write.mode("overwrite").parquet(self.path)


def text_key(text: Column | str) -> Column:
    """The cache's key of a text."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256)


def embed_through(rows: DataFrame, cache: DataFrame, factory: Callable[[], EmbeddingProvider], model: str, dim: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``vec``, new cache rows): each distinct text is embedded once, and only if the cache doesn't hold it.

    The cache's key is (model, dim, key of the text), so models and widths never mix. The new rows are written to the shared
    folder, so that they are computed once, whatever reads them.
    """
    from gleaner.runtime import table_in_shared_dir

    mine = cache.where((F.col("model") == model) & (F.col("dim") == dim))
    keyed = rows.withColumn("vector_key", text_key(text_col))
    missing = keyed.select(F.col("vector_key").alias("key"), F.coalesce(text_col, F.lit("")).alias("text")).join(mine.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    new = embed(missing, factory).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "key", "vec", F.current_timestamp().cast("timestamp_ntz").alias("cached_at"))
    new = table_in_shared_dir(new, "vectors-new")
    every = last_wins(mine, ["model", "dim", "key"], "cached_at").select("key", "vec").unionByName(new.select("key", "vec"))
    return keyed.join(every.withColumnRenamed("key", "vector_key"), "vector_key").drop("vector_key"), new
