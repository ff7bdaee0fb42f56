"""Texts that differ by small edits (problem 1), by multi-index hashing.

A text's fingerprint is a row of ``SEGMENTS * WIDTH`` symbols, each the least of its word shingles under one hash
function, so that two texts differ in a symbol with probability 1 - Jaccard similarity: the Hamming distance over symbols
is the distance that is searched. The fingerprint is cut into segments of WIDTH symbols. Of each segment the Hamming ball
of radius 1 is enumerated, as the WIDTH keys that leave one symbol out; two texts meet in a table when one of their
segments lies within the other's ball. The complete fingerprint distance and then the exact similarity of the shingle
sets decide. (Bits in place of symbols would need balls of radius 5 and more: at similarity 0.6 a fifth of all bits differ.)

A pair at similarity 0.6 is missed with probability 0.003, one at 0.65 with 0.0006, one at 0.7 with 0.0001.

Texts with equal shingle sets are one class and are searched once. Table entries that more than ``BLOCK`` classes share
are compared as blocks of fingerprints, spread over tasks, and only pairs within the distance leave a task. Those that a
sample shows to be shared by many are cut into blocks before they are shuffled.
Texts with fewer shingle words have no shingles; among them only equal texts are alike. Null texts are left out.
Repeated rows count once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import bits, copies
from gleaner.llm import textnum as tn
from gleaner.runtime import table_in_shared_dir

SHINGLE_WORDS = 3
THRESHOLD = 0.6
WIDTH = 4
SEGMENTS = 9
SYMBOLS = WIDTH * SEGMENTS
#: Symbols that must be equal: at similarity 0.6 fewer are equal with probability 0.0002.
LEAST_EQUAL = 11
#: Classes that meet in one table entry and are paired at once; beyond that, blocks.
BLOCK = 128
#: Of how many classes one is looked at to find hot keys beforehand, and how many such keys are sent to all tasks at most.
ONE_IN, SUSPECTS = 64, 100_000

_rng = np.random.default_rng(20240101)
_MUL = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * tn.U64(2) + tn.U64(1)
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def _shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text and ascending, and the bounds of each text."""
    w = tn.Words(texts)
    g = w.grams(words)
    keep = g != tn._NONE
    of, g = w.text_of[keep], g[keep]
    order = np.lexsort((g, of))
    of, g = of[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    of, g = of[new], g[new]
    return g, np.searchsorted(of, np.arange(len(texts) + 1))


def fingerprints(texts: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, digest, symbols): symbols is empty for a text without shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_texts = batch.column("id"), batch.column("text").to_pylist()
            for lo, hi in tn.passes(all_texts):
                part = all_texts[lo:hi]
                g, bounds = _shingles(part, words)
                full = np.flatnonzero(np.diff(bounds))
                symbols = np.empty((len(full), SYMBOLS), dtype=np.int32)
                for k in range(SYMBOLS):
                    if len(full):
                        symbols[:, k] = tn.mix(np.minimum.reduceat((g ^ _XOR[k]) * _MUL[k], bounds[full])).astype(np.uint32).view(np.int32)
                raw = g.tobytes()
                digests = [
                    hashlib.blake2b(raw[8 * a : 8 * b] if b > a else b"\0" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for t, a, b in zip(part, bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                counts = np.zeros(hi - lo + 1, dtype=np.int32)
                counts[1:][full] = SYMBOLS
                offsets = pa.array(np.cumsum(counts, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(digests, type=pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(symbols.ravel()))], names=["id", "digest", "symbols"])

    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(scan, "id string, digest binary, symbols array<int>")


def _ball_keys() -> list:
    """The keys of every segment: the number of the segment and of the symbol left out, and the other symbols."""
    return [
        F.xxhash64(F.lit(s * WIDTH + out), *(F.get("symbols", F.lit(s * WIDTH + i)) for i in range(WIDTH) if i != out))
        for s in range(SEGMENTS)
        for out in range(WIDTH)
    ]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cid), sorted by key, to the pairs that meet in a key; the rows of a key with more than BLOCK pass as hot."""
    rest_k, rest_c, hot_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    last = False
    batches = iter(batches)
    while not last:
        batch = next(batches, None)
        last = batch is None
        k, c = (rest_k, rest_c) if last else (np.concatenate([rest_k, batch.column("key").to_numpy()]), np.concatenate([rest_c, batch.column("cid").to_numpy()]))
        out: list[tuple[np.ndarray, np.ndarray, bool]] = []
        if len(k):
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(starts, len(k)))
            run = np.repeat(np.arange(len(starts)), size)
            hot = (size > BLOCK) | (k[starts] == hot_key if hot_key is not None else False)
            is_hot = hot[run]
            keep_from = len(k) if last or hot[-1] else starts[-1]  # an unfinished short run waits for the next batch
            hot_key = k[-1] if hot[-1] else None
            if is_hot.any():
                out.append((k[is_hot], c[is_hot], True))
            rest_k, rest_c = k[keep_from:], c[keep_from:]
            k, c, run = k[:keep_from], c[:keep_from], run[:keep_from]
            k, c, run = k[~is_hot[:keep_from]], c[~is_hot[:keep_from]], run[~is_hot[:keep_from]]
            d = 1
            while len(run) > d and (i := np.flatnonzero(run[d:] == run[:-d])).size:
                x, y = c[i], c[i + d]
                differ = x != y
                out.append((np.minimum(x, y)[differ], np.maximum(x, y)[differ], False))
                d += 1
        for a, b, h in out:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), h))], schema=_PAIR)


def _suspects(prints: DataFrame) -> list[int]:
    """Keys that many classes share, as a sample of the classes shows: where rows are routed depends on them, no result does."""
    some = prints.where((F.size("symbols") > 0) & (F.pmod(F.xxhash64(F.lit("hot"), "cid"), F.lit(ONE_IN)) == 0))
    seen = some.select(F.explode(F.array(*_ball_keys())).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * BLOCK // ONE_IN)
    return [r["key"] for r in seen.orderBy(F.desc("n")).limit(SUSPECTS).collect()]


def _hot_pairs(members: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs within the fingerprint distance among all classes that share a hot key (members: key, cid), block against block."""
    members = members.distinct()
    blocks = F.ceil(F.col("n") / (4 * BLOCK)).cast("int")
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("blocks", blocks)
    own = sized.withColumn("own", F.pmod("cid", F.col("blocks")).cast("int")).join(small, "cid")
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "symbols")

    def task(key: tuple, t: pa.Table) -> pa.Table:
        cid, own = t.column("cid").to_numpy(), t.column("own").to_numpy()
        s = t.column("symbols").combine_chunks().flatten().to_numpy().reshape(len(cid), SYMBOLS)
        cross = key[1].as_py() != key[2].as_py()
        a, b = [], []
        for x in range(len(cid) - 1):
            near = np.flatnonzero(((s[x] == s[x + 1 :]).sum(axis=1) >= LEAST_EQUAL) & (cid[x + 1 :] != cid[x]) & ((own[x + 1 :] != own[x]) if cross else True)) + x + 1
            a.append(np.minimum(cid[x], cid[near]))
            b.append(np.maximum(cid[x], cid[near]))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})

    return spread.groupBy("key", "i", "j").applyInArrow(task, "a long, b long")


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b): cids of two classes within the fingerprint distance, that met in the ball of some segment.

    The distance is taken over a byte of each symbol: unequal symbols agree in it once in 256 times, and the exact
    similarity decides later. It is the same for all keys, hot or not.
    """
    prints = prints.where("size(symbols) > 0")
    keys = prints.select("cid", F.explode(F.array(*_ball_keys())).alias("key"))
    # what a sample shows as hot goes to its blocks at once; what only shows in its task follows from there
    suspects = _suspects(prints)
    hot = None
    if suspects:
        many = F.broadcast(prints.sparkSession.createDataFrame([(k,) for k in suspects], "key long"))  # SUSPECTS rows at most
        hot, keys = keys.join(many, "key", "left_semi"), keys.join(many, "key", "left_anti")
    met = table_in_shared_dir(keys.repartition("key").sortWithinPartitions("key").select("key", "cid").mapInArrow(_meet, "a long, b long, hot boolean").distinct(), "met")
    pairs = met.where("not hot").select("a", "b")
    small = prints.select("cid", F.transform("symbols", lambda x: F.pmod(x, F.lit(256)) - 128).cast("array<tinyint>").alias("symbols"))
    for c in ("a", "b"):
        pairs = pairs.join(small.select(F.col("cid").alias(c), F.col("symbols").alias(f"symbols_{c}")), c)
    equal = F.aggregate(F.zip_with("symbols_a", "symbols_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    near = pairs.where(equal >= LEAST_EQUAL).select("a", "b")
    late = met.where("hot").select(F.col("a").alias("key"), F.col("b").alias("cid"))
    if not late.isEmpty():
        hot = late if hot is None else hot.select("key", "cid").unionByName(late)
    return near if hot is None else near.unionByName(_hot_pairs(hot.select("key", "cid"), small)).distinct()


def exact_candidates(texts: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float, words: int) -> DataFrame:
    """(a, b): cids of all classes that can reach the threshold. Two such sets share one of their rarest shingles: of n the
    first n - ceil(threshold * n) + 1. Nothing is missed; shingles that are rare nowhere make it costly."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            for lo, hi in tn.passes(all_texts):
                g, bounds = _shingles(all_texts[lo:hi], words)
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(g.view(np.int64)))], names=["cid", "shingles"])

    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(reps.select("id", "cid"), "id").dropDuplicates(["cid"])
    held = table_in_shared_dir(rows.select("cid", "text").mapInArrow(sets, "cid long, shingles array<long>"), "near-shingles")
    each = held.select("cid", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    counted = each.join(each.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "g")
    # shingles that stand in one class only come first and meet nobody
    first = held.select("cid", F.size("shingles").alias("n")).join(counted.groupBy("cid").agg(F.count("*").alias("met")), "cid").select("cid", (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.col("met"))).alias("most"))
    rare = counted.selectExpr("cid", "n", "g", "row_number() over (partition by cid order by m, g) as nth").join(first, "cid").where("nth <= most")
    a, b = (rare.select("g", F.col("cid").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9)
    return a.join(b, "g").where(near).select("a", "b").distinct()


def verify(pairs: DataFrame, texts: DataFrame, id_col: str, text_col: str, threshold: float, words: int) -> DataFrame:
    """(a, b, similarity) of the pairs whose shingle sets reach the threshold; a and b are ids.

    The sets are compared as 32-bit hashes: two sets of 140 shingles hold a false match with probability 5e-6. Texts that
    are in no pair are dropped, before anything is shuffled, by a bit table of bounded size; the joins decide.
    """

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    maybe = bits.Filter(wanted, "cid", 2 * pairs.count())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe.holds(batch.column("cid").to_numpy())))
            all_texts = batch.column("text").to_pylist()
            for lo, hi in tn.passes(all_texts):
                g, bounds = _shingles(all_texts[lo:hi], words)
                small = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((g >> tn.U64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("cid").slice(lo, hi - lo), small], names=["id", "cid", "shingles"])

    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).withColumn("cid", F.xxhash64("id"))
    found = rows.where("id is not null and text is not null").select("id", "cid", "text").mapInArrow(sets, "id string, cid long, shingles array<int>").dropDuplicates(["id"])
    a, b = (found.select(F.col("cid").alias(c), F.col("id").alias(f"id_{c}"), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    similarity = common / (F.size("set_a") + F.size("set_b") - common)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)


class NearCopies:
    """Near copies within one table of texts; ``exact`` looks for candidates in another way, which misses none."""

    def __init__(self, texts: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, exact: bool = False):
        prints = table_in_shared_dir(fingerprints(texts, id_col, text_col, words), "near-prints")
        ids = prints.select("id", "digest").distinct()
        self.classes = copies.classes(ids, "id", "digest")
        self.members = copies.members(ids, self.classes, "id", "digest")
        reps = prints.groupBy("digest").agg(F.min("id").alias("id"), F.first("symbols").alias("symbols")).select("id", F.xxhash64("id").alias("cid"), "symbols")
        reps = table_in_shared_dir(reps, "near-classes")
        self.ids = ids.select("id")
        found = exact_candidates(texts, reps, id_col, text_col, threshold, words) if exact else candidates(reps)
        self.pairs_of_classes = verify(table_in_shared_dir(found, "near-candidates"), texts, id_col, text_col, threshold, words)

    def pairs(self, a: str, b: str) -> DataFrame:
        """All similar pairs of ids, a < b, copies included, whatever the size of a class (its texts may differ)."""
        return copies.all_pairs(self.pairs_of_classes.select(F.col("a").alias(a), F.col("b").alias(b)), self.members, a, b)

    def groups(self, id_col: str) -> DataFrame:
        """One row for each id: its group (the least id that links reach), its class of equal shingle sets (the least id in
        it) and how many ids that has, and to how many other classes it is linked. A record without any link is a group of its own."""
        from gleaner.llm.components import components

        links = table_in_shared_dir(self.pairs_of_classes.select("a", "b"), "near-links")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("n_links"))
        labels = components(links, "a", "b")
        of = self.ids.join(self.members.select(F.col("member").alias("id"), "rep", "copies"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
        rows = of.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(both.withColumnRenamed("a", "rep"), "rep", "left")
        return rows.select(
            F.col("id").alias(id_col), F.coalesce("label", "rep").alias("group_id"), F.col("rep").alias("class_id"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
