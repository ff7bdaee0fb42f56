"""Filling containers of fixed capacity with texts (problem 6), by large-item matching on the histogram of sizes.

Texts are measured in tokens. A text above the capacity is cut into full containers and a rest; nothing else is cut.
The number of pieces of every size (at most ``capacity`` numbers) goes to the driver, where it is packed: pieces above a
third of the capacity share a container with at most one other such piece, matched greedily from the largest with the
largest that still fits; smaller pieces go, from the largest, into the least sufficient gap. All pieces of a size that
meet the same kind of container are placed in one step, so the plan's cost depends on the capacity and not on the corpus.
On the cluster each piece gets its rank among the pieces of its size, salted so that a size that many texts share is
counted in many tasks, and the plan turns (size, rank) into a container.

Null, empty and tokenless texts occupy nothing: they come out with 0 tokens and without a container. A window whose
capacity less reserve is null or not positive has no containers and is left out. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import collect_bounded, table_in_shared_dir

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: The pattern that this public vocabulary was made with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of one size that are ranked in one task.
RANKED = 50_000
WINDOWS = 10_000
#: Sizes over all windows: the sum of their capacities at most.
SIZES = 5_000_000

_encoding: dict[str, object] = {}


def _encode(folder: str):
    if folder not in _encoding:
        import base64

        import tiktoken

        with open(f"{folder}/{RANKS}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoding[folder] = tiktoken.Encoding("gleaner", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[folder]


def count_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every document."""

    @F.arrow_udf("int")
    def n_tokens(texts: pa.Array) -> pa.Array:
        encode = _encode(tokenizers).encode_ordinary
        return pa.array([len(encode(t)) for t in texts.to_pylist()], type=pa.int32())

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for all pieces: (size, rank from, rank to, first container), and the number of containers.

    The pieces of a size with ranks from a to b - 1 go into as many consecutive containers.
    """
    left = {s: n for s, n in sizes.items() if 0 < s <= capacity and n > 0}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, deque] = defaultdict(deque)  # gap: ranges of containers (first, number)
    order: list[int] = []  # the gaps that some container has
    places: list[tuple[int, int, int, int]] = []
    bins = 0

    def place(size: int, first: int, n: int) -> None:
        places.append((size, used[size], used[size] + n, first))
        used[size] += n
        left[size] -= n

    def add_gap(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        fit = bisect_right(large, capacity - s) - 1
        if fit < 0:
            n, p = left[s], 0
        elif large[fit] == s:
            n, p = left[s] // 2, s
            if not n:  # one piece is left: the next smaller size
                fit -= 1
                n, p = (1, large[fit]) if fit >= 0 else (1, 0)
        else:
            p = large[fit]
            n = min(left[s], left[p])
        place(s, bins, n)
        if p:
            place(p, bins, n)
        add_gap(capacity - s - p, bins, n)
        bins += n
        for x in {s, p} - {0}:
            if not left[x]:
                del large[bisect_left(large, x)]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                n = -(-left[s] // (capacity // s))
                add_gap(capacity, bins, n)
                bins += n
                continue
            gap = order[at]
            first, n = gaps[gap].popleft()
            t = min(n, left[s])
            if t < n:
                gaps[gap].appendleft((first + t, n - t))
            elif not gaps[gap]:
                del order[at]
            place(s, first, t)
            add_gap(gap - s, first, t)
    return places, bins


def _pieces(tokens: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """(window_id, capacity, doc_id, piece, n): every text in every window, cut where it exceeds the capacity."""
    w = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("id"), F.lit(c).cast("int").alias("capacity")) for i, c in windows)))
    rows = tokens.where("n_tokens > 0").select("doc_id", "n_tokens", w.alias("w")).select("doc_id", "n_tokens", F.col("w.id").alias("window_id"), F.col("w.capacity").alias("capacity"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).cast("int"))))
    return rows.select("window_id", "capacity", "doc_id", "piece", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("n"))


def pack(documents: DataFrame, windows: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(window_id, container_id, doc_id, piece, token_start, n_tokens): every text packed once for each window."""
    spark = documents.sparkSession
    usable = windows.select("window_id", (F.col("capacity_tokens") - F.coalesce("reserved_tokens", F.lit(0))).alias("c")).where("c > 0 and window_id is not null").distinct()
    sizes_of = [(r["window_id"], r["c"]) for r in collect_bounded(usable, WINDOWS, "container sizes")]
    empty_schema = "window_id int, container_id long, doc_id long, piece int, token_start long, n_tokens int"
    if not sizes_of:
        return spark.createDataFrame([], empty_schema)
    tokens = table_in_shared_dir(count_tokens(documents, tokenizers), "tokens")
    pieces = _pieces(tokens, sizes_of)
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in collect_bounded(pieces.groupBy("window_id", "n").agg(F.count("*").alias("pieces")), SIZES, "piece sizes"):
        histogram[r["window_id"]][r["n"]] = r["pieces"]
    tables = {}
    for window, capacity in sizes_of:
        p = sorted(plan(histogram[window], capacity)[0])
        tables[window] = tuple(np.array([x[i] for x in p], dtype=np.int64) for i in (0, 1, 3))
    sent = spark.sparkContext.broadcast(tables)  # its size depends on the capacities only

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {w: (s << 40) + r for w, (s, r, _) in sent.value.items()}
        for batch in batches:
            window, size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("window_id", "n", "rank"))
            out = np.zeros(len(window), dtype=np.int64)
            for w in np.unique(window):
                mine = np.flatnonzero(window == w)
                at = np.searchsorted(keys[w], (size[mine] << 40) + rank[mine], side="right") - 1
                _, begin, first = sent.value[w]
                out[mine] = first[at] + rank[mine] - begin[at]
            start = batch.column("piece").to_numpy().astype(np.int64) * batch.column("capacity").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("window_id"), pa.array(out), batch.column("doc_id"), batch.column("piece"), pa.array(start), batch.column("n")], names=["window_id", "container_id", "doc_id", "piece", "token_start", "n_tokens"])

    salts = max([1, *(-(-n // RANKED) for sizes in histogram.values() for n in sizes.values())])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    numbered = salted.selectExpr("*", "row_number() over (partition by window_id, n, salt order by doc_id, piece) - 1 as nth")
    before = salted.groupBy("window_id", "n", "salt").agg(F.count("*").alias("m")).selectExpr("window_id", "n", "salt", "sum(m) over (partition by window_id, n order by salt) - m as before")
    ranked = numbered.join(before, ["window_id", "n", "salt"]).select("window_id", "capacity", "doc_id", "piece", "n", (F.col("nth") + F.col("before")).alias("rank"))
    ids = F.explode(F.array(*(F.lit(i).cast("int") for i, _ in sizes_of)))
    nothing = tokens.where("n_tokens = 0").select(ids.alias("window_id"), F.lit(None).cast("long").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.lit(0).alias("n_tokens"))
    return ranked.mapInArrow(assign, empty_schema).unionByName(nothing)


def fill(packed: DataFrame) -> DataFrame:
    """One row per window: containers, tokens in them and pieces."""
    return packed.where("container_id is not null").groupBy("window_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))


def kept(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per window: documents that were packed as a whole, documents whose pieces don't make up one text without gaps or
    that were cut without need, and containers beyond the capacity."""
    capacity = windows.select("window_id", (F.col("capacity_tokens") - F.coalesce("reserved_tokens", F.lit(0))).alias("capacity")).distinct()
    some = packed.where("container_id is not null").join(F.broadcast(capacity), "window_id")  # WINDOWS rows at most
    docs = some.groupBy("window_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.countDistinct("piece").alias("distinct"), F.max("capacity").alias("capacity"))
    bad = (F.col("tokens") != F.col("end")) | (F.col("pieces") != F.col("distinct")) | (F.col("pieces") != F.ceil(F.col("tokens") / F.col("capacity")))
    by_doc = docs.groupBy("window_id").agg(F.count("*").alias("documents"), F.count_if(bad).alias("parted"))
    full = some.groupBy("window_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    return by_doc.join(full.groupBy("window_id").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull")), "window_id")
