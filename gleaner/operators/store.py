"""An index as immutable numbered snapshots: upsert, delete, lookups, and a manifest that is written last and checked.

``{path}/snapshots/N`` holds rows, ``{path}/manifests/N.json`` says that they are complete. A save writes a new number and
renames its manifest into place at the end, so a save that fails leaves the index as it was, and a table that was loaded
can be saved to where it came from. The snapshot before the newest is kept for those who still read it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
#: Snapshots that a save leaves.
KEPT = 2


def dedupe(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order`` (nulls first, then by all of the row's text)."""
    rest = [c for c in rows.columns if c != key]
    by = F.struct(*(F.col(c) for c in order))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in the place of old ones with their key; a key that ``new`` repeats must have been deduped before."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the documents in ``new`` (by ``key``) in the place of the old ones, so none of an edited document is left."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def dedupe_on_text(rows: DataFrame, key: str) -> DataFrame:
    """One row for each distinct text, that of the least key; rows without a text stay as they are."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    least = rows.where("text is not null").groupBy(digest.alias("digest")).agg(F.min(key).alias(key)).select(key)
    return rows.join(least, key, "left_semi").unionByName(rows.where("text is null"))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def get_many(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted(key, ord) with the rows found; the caller's order is the column ``ord``."""
    return wanted.join(rows, key)


def check_width(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """Fails while it runs on a vector of another width."""
    wrong = F.concat(F.lit("a vector has "), F.size(vec).cast("string"), F.lit(f" numbers, the index has {dim}"))
    return rows.withColumn(vec, F.when(F.size(vec) == dim, F.col(vec)).otherwise(F.raise_error(wrong).cast(rows.schema[vec].dataType)))


# --- snapshots ----------------------------------------------------------------------------------------------------


class _Files:
    """A few calls of the file system that holds a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.make, self.base = spark._jvm.org.apache.hadoop.fs.Path, path.rstrip("/")
        self.fs = self.make(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, folder: str, end: str = "") -> list[int]:
        at = self.make(f"{self.base}/{folder}")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(end)) for n in names if n.endswith(end) and n.removesuffix(end).isdigit())

    def write(self, name: str, text: str) -> None:
        """Written under another name first: under its own it is there as a whole or not at all."""
        target, draft = self.make(f"{self.base}/{name}"), self.make(f"{self.base}/{name}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(draft, target):
            raise FileExistsError(f"{target} was written by another save")

    def delete(self, name: str) -> None:
        self.fs.delete(self.make(f"{self.base}/{name}"), True)


def _digest() -> list[Column]:
    """The number of rows and a sum of the hashes of their ids, which are made from their contents: one narrow column is read."""
    return [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("d")]


def save(rows: DataFrame, path: str, vec: str, dim: int, embedder: str, beside=None) -> dict:
    """Writes a snapshot; the manifest names the embedder, so vectors of different models never mix. ``beside``: writes what
    belongs to the snapshot, given its rows and a folder of its own, before the manifest makes both valid."""
    spark = rows.sparkSession
    files = _Files(spark, path)
    number = max([0, *files.numbers("snapshots"), *files.numbers("manifests", ".json")]) + 1
    target = f"{path}/snapshots/{number}"
    check_width(rows, vec, dim).write.mode("errorifexists").parquet(target)
    stored = spark.read.parquet(target)
    digest = stored.agg(*_digest()).first()
    if beside is not None:
        beside(stored, f"{path}/beside/{number}")
    manifest = {"version": VERSION, "number": number, "dimensions": dim, "count": digest["n"], "digest": digest["d"], "embedder": embedder, "beside": beside is not None}
    files.write(f"manifests/{number}.json", json.dumps(manifest))
    for old in files.numbers("manifests", ".json")[:-KEPT]:
        files.delete(f"manifests/{old}.json")
    valid = files.numbers("manifests", ".json")
    for old in files.numbers("snapshots"):
        if old < valid[0]:
            files.delete(f"snapshots/{old}")
            files.delete(f"beside/{old}")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    """The newest manifest."""
    numbers = _Files(spark, path).numbers("manifests", ".json")
    if not numbers:
        raise FileNotFoundError(f"{path} holds no index")
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/manifests/{numbers[-1]}.json").first()["value"])


def load(spark: SparkSession, path: str, dim: int | None = None, embedder: str | None = None) -> DataFrame:
    """The newest snapshot, after the manifest's version, width and embedder and the rows' number and digest were checked."""
    m = manifest_of(spark, path)
    for name, want in (("version", VERSION), ("dimensions", dim), ("embedder", embedder)):
        if want is not None and m[name] != want:
            raise ValueError(f"the index has {name} {m[name]}, not {want}")
    rows = spark.read.parquet(f"{path}/snapshots/{m['number']}")
    found = rows.agg(*_digest()).first()
    if found["n"] != m["count"]:
        raise ValueError("the index is incomplete: its manifest counts other rows")
    if found["d"] != m["digest"]:
        raise ValueError("the index isn't the one that was saved: its rows have another digest")
    return rows


def beside_of(spark: SparkSession, path: str) -> str | None:
    """The folder that was written beside the newest snapshot, if one was."""
    m = manifest_of(spark, path)
    return f"{path}/beside/{m['number']}" if m.get("beside") else None
