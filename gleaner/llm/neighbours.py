"""The most similar vectors for every vector (problem 4), by additive quantisation.

1. Regions: the centroids of each group (one model and width) are trained on a bounded sample (``SAMPLE`` distinct vectors of
   the group, those with the least hashes). Every distinct vector lives in the region of its nearest centroid, and is sent
   as a query to the regions whose squared distance exceeds the nearest by less than ``margin``, ``probes`` at most.
2. In a region the vectors are written as sums of full-dimensional codewords, one from each codebook: cells, then
   ``LEVELS`` codebooks of residuals, all trained on the region's own vectors. The codes are found by a beam search. A query
   scores the vectors of its nearest cells by lookup tables (its products with all codewords, summed over a vector's codes,
   over the stored length of that sum); the best ``rerank`` are scored again exactly.
3. The lists of the regions are merged for each query. With ``exact`` every query goes to every region of its group and is
   compared with all vectors there: the same result without any of these bounds, at a quadratic cost.

Regions hold about ``REGION`` vectors, so their number grows with the group and the work for a vector doesn't, until the
sample can't train more (``SAMPLE_FLOATS`` numbers over all groups); beyond that regions grow, and are cut into blocks. A
region's load is estimated from the sample, and one with more than a block's share of vectors or queries is spread over
tasks. All rows are indexed and all rows are queries.

Equal vectors are searched once; each class then stands for its least keys. A class with many keys is reduced to one row
before anything is shuffled, so one that holds a third of all rows costs one search.
Similarities are cosines, computed in double precision; equal ones are ordered by key.

Unusable vectors (null, null or infinite or NaN elements, wrong length, all zero) and rows without a key are left out.
Repeated rows of one key count once; if their vectors differ, one of them counts. A group of one vector has no neighbours.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import collect_bounded, table_in_shared_dir

K = 5
#: Vectors in one region, distinct vectors in a group's sample (at least; 32 for each region), and numbers in all samples.
REGION, SAMPLE, PER_REGION, SAMPLE_FLOATS = 8192, 8192, 32, 16 << 20
MARGIN, PROBES, RERANK = 0.1, 16, 160
#: In a region: vectors of a cell, cells that a query scores, candidates that a cell hands on, vectors that train its books.
CELL, NEAR_CELLS, PER_CELL, TRAIN = 256, 12, 64, 4096
CODEWORDS, LEVELS, BEAM = 64, 3, 4
#: Stands for a score where there is no candidate; scores of candidates are near -1 to 1 and clipped to -5.
NONE = -7.0
BLOCK_VECTORS, BLOCK_QUERIES = 16384, 65536
GROUPS = 1000
#: Classes of equal vectors with more keys than this are hot; the HOT_CLASSES largest of them are reduced before the shuffle.
HOT_KEYS, HOT_CLASSES = 256, 4096

_ROUTED = pa.schema([("g", pa.int32()), ("s", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("id", pa.int64()), ("role", pa.int8()), ("vec", pa.binary())])
_HIT = pa.struct([("c", pa.float64()), ("other", pa.int64())])


def usable(vectors: DataFrame) -> DataFrame:
    """(model, dim, key, vec, id) of the rows that can be compared; id stands for the class of equal vectors."""
    rows = vectors.select("model", "dim", "key", "vec").where("vec is not null and key is not null and size(vec) = dim")
    # array_contains is null, not false, where an element is null and none is NaN
    rows = rows.where(~F.array_contains("vec", F.lit(float("nan")).cast("float")))
    rows = rows.where((F.array_max("vec") < float("inf")) & (F.array_min("vec") > float("-inf")) & ((F.array_max("vec") != 0) | (F.array_min("vec") != 0)))
    return rows.withColumn("id", F.xxhash64("model", "dim", "vec"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, c)
        order = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=k)
        some = n > 0
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances less the squared lengths of x."""
    return (c * c).sum(1) - 2 * (x @ c.T)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])


def train(x: np.ndarray, cells: int, seed: int = 7) -> list[np.ndarray]:
    """Codebooks for unit vectors: cells first, then LEVELS codebooks of residuals."""
    rng = np.random.default_rng(seed)
    books, rest = [], x.astype(np.float32)
    for k in (cells, *(CODEWORDS,) * LEVELS):
        c = _kmeans(rest, k, rng)
        books.append(c)
        rest = rest - c[_nearest(rest, c)]
    return books


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each codebook) and the length of the sum of codewords, by a beam search over the codebooks."""
    n = len(x)
    rest, codes, cost = x[:, None, :], np.zeros((n, 1, 0), dtype=np.int32), None
    rows = np.arange(n)[:, None]
    for c in books:
        w, k = rest.shape[1], len(c)
        d = ((rest * rest).sum(2)[:, :, None] + _distances(rest.reshape(n * w, -1), c).reshape(n, w, k)).reshape(n, w * k)
        keep = min(beam, w * k)
        best = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < w * k else np.tile(np.arange(w * k), (n, 1))
        source, word = best // k, best % k
        cost = d[rows, best]
        codes = np.concatenate([codes[rows, source], word[:, :, None].astype(np.int32)], axis=2)
        rest = rest[rows, source] - c[word]
    codes = codes[np.arange(n), cost.argmin(1)]
    total = sum(c[codes[:, i]] for i, c in enumerate(books))
    return codes, np.maximum(np.sqrt((total * total).sum(1)), 1e-6)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest numbers of each row, in no order."""
    return np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))


def _top_scores(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_top``, with the numbers. Numbers from NONE to 7 and places go through one partition of small integers."""
    if k >= score.shape[1] or score.shape[1] > 4096:
        at = _top(score, k)
        return at, np.take_along_axis(score, at, 1)
    packed = (np.clip(score, NONE, 7) * np.float32(1 << 16)).astype(np.int32)
    packed <<= 12
    packed |= np.arange(score.shape[1], dtype=np.int32)
    packed.partition(score.shape[1] - k, axis=1)
    packed = packed[:, score.shape[1] - k :]
    return packed & 4095, (packed >> 12).astype(np.float32) / np.float32(1 << 16)


# --- regions ------------------------------------------------------------------------------------------------------


class Regions:
    """The centroids of a group and into how many blocks each region's vectors and queries are cut."""

    def __init__(self, sample: np.ndarray, vectors: int, margin: float, probes: int, exact: bool):
        self.margin, self.probes, self.exact = margin, probes, exact
        n = max(1, min(round(vectors / REGION), len(sample) // (PER_REGION // 2)))
        self.centroids = _kmeans(sample, n, np.random.default_rng(11))
        home, asked = self.of(sample)
        share = vectors / len(sample)
        self.vector_blocks = np.ceil(np.bincount(home, minlength=n) * share / BLOCK_VECTORS).astype(np.int64).clip(1)
        self.query_blocks = np.ceil(asked.sum(0) * share / BLOCK_QUERIES).astype(np.int64).clip(1)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each unit vector, and for each which regions it asks."""
        d = _distances(x, self.centroids)
        home = d.argmin(1)
        if self.exact:
            return home, np.ones(d.shape, dtype=bool)
        asked = d < d.min(1)[:, None] + self.margin
        if d.shape[1] > self.probes:
            few = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(few, np.argpartition(d, self.probes - 1, axis=1)[:, : self.probes], True, axis=1)
            asked &= few
        asked[np.arange(len(x)), home] = True
        return home, asked


def _spread(rows: np.ndarray, s: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row as often as its region has blocks of the other kind, with their numbers."""
    n = times[s]
    return np.repeat(rows, n), np.repeat(s, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _route(rows: DataFrame, regions: list[Regions]) -> DataFrame:
    """Rows for the blocks: role 1 a vector, 2 a query, 3 both; each class once for each task of the input."""
    sent = rows.sparkSession.sparkContext.broadcast(regions)  # SAMPLE_FLOATS / 16 numbers at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_numpy()
            g = batch.column("g").to_numpy()
            first = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], dtype=bool)
            for one in np.unique(g[first]):
                mine = np.flatnonzero(first & (g == one))
                r, column = sent.value[one], batch.column("vec").take(pa.array(mine))
                raw = _matrix(column, r.centroids.shape[1])
                home, asked = r.of(_unit(raw))
                h = ids[mine].view(np.uint64)
                own_i = ((h >> np.uint64(3)) % r.vector_blocks[home].astype(np.uint64)).astype(np.int64)
                at, s, j = _spread(np.arange(len(mine)), home, r.query_blocks)
                q_at, q_s = np.nonzero(asked)
                own_j = ((h[q_at] >> np.uint64(7)) % r.query_blocks[q_s].astype(np.uint64)).astype(np.int64)
                q_of, q_region, i = _spread(np.arange(len(q_at)), q_s, r.vector_blocks)
                q_row, q_j = q_at[q_of], own_j[q_of]
                # a query that comes to its own block comes with the vector
                together = (home[q_row] == q_region) & (own_i[q_row] == i)
                mine_j = np.zeros(len(mine), dtype=np.int64)
                mine_j[q_row[together]] = q_j[together]
                both = mine_j[at] == j
                rows_ = np.concatenate([at, q_row[~together]])
                width = raw.shape[1] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows_), one, dtype=np.int32)), pa.array(np.concatenate([s, q_region[~together]]).astype(np.int32)), pa.array(np.concatenate([own_i[at], i[~together]]).astype(np.int32)),
                        pa.array(np.concatenate([j, q_j[~together]]).astype(np.int32)), pa.array(ids[mine][rows_]), pa.array(np.concatenate([np.where(both, 3, 1), np.full(len(rows_) - len(at), 2)]).astype(np.int8)),
                        pa.Array.from_buffers(pa.binary(), len(rows_), [None, pa.py_buffer(np.arange(0, width * len(rows_) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw[rows_]))]),
                    ],
                    schema=_ROUTED,
                )

    return rows.select("g", "id", "vec").mapInArrow(scan, "g int, s int, i int, j int, id long, role tinyint, vec binary")


# --- the search inside a block ------------------------------------------------------------------------------------


class Block:
    """Vectors with their codes, in the order of their cells."""

    def __init__(self, x: np.ndarray):
        self.unit = _unit(x)
        step = max(1, len(x) // TRAIN)
        self.books = train(self.unit[::step], max(1, round(len(x) / CELL)))
        codes, length = zip(*(encode(self.unit[i : i + 2048], self.books) for i in range(0, len(x), 2048)))
        codes, length = np.concatenate(codes), np.concatenate(length)
        self.order = np.argsort(codes[:, 0], kind="stable")
        self.codes, self.length = codes[self.order, 1:], length[self.order]
        self.bounds = np.searchsorted(codes[self.order, 0], np.arange(len(self.books[0]) + 1))

    def candidates(self, q: np.ndarray, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """For each unit query the places of its best vectors by the lookup tables, and their scores; ``NONE`` where there are fewer."""
        cells = self.books[0]
        near = _top(-_distances(q, cells), min(NEAR_CELLS, len(cells)))
        base = cells @ q.T
        tables = [b @ q.T for b in self.books[1:]]
        place = np.zeros((len(q), near.shape[1] * PER_CELL), dtype=np.int64)
        score = np.full(place.shape, NONE, dtype=np.float32)
        flat = np.argsort(near.ravel(), kind="stable")
        of, slot = flat // near.shape[1], flat % near.shape[1]
        asked = np.searchsorted(near.ravel()[flat], np.arange(len(cells) + 1))
        for c in range(len(cells)):
            lo, hi = self.bounds[c], self.bounds[c + 1]
            who, at = of[asked[c] : asked[c + 1]], slot[asked[c] : asked[c + 1]]
            if hi == lo or not len(who):
                continue
            s = tables[0][:, who][self.codes[lo:hi, 0]]
            for level in range(1, LEVELS):
                s += tables[level][:, who][self.codes[lo:hi, level]]
            s += base[c, who]
            s = np.maximum((s / self.length[lo:hi, None]).T, np.float32(-5), order="C")
            best, numbers = _top_scores(s, min(PER_CELL, hi - lo))
            columns = at[:, None] * PER_CELL + np.arange(best.shape[1])
            place[who[:, None], columns] = best + lo
            score[who[:, None], columns] = numbers
        keep, score = _top_scores(score, min(rerank, score.shape[1]))
        return self.order[np.take_along_axis(place, keep, 1)], score


def search_block(q: np.ndarray, x: np.ndarray, k: int, rerank: int = RERANK, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of x with the greatest cosine for each row of q, and these; -inf where a query has fewer."""
    unit_q = _unit(q)
    block = None if exact else Block(x)
    unit_x = _unit(x) if exact else block.unit
    norm_x, norm_q = (np.sqrt((a.astype(np.float64) ** 2).sum(1)) for a in (x, q))
    places, cosines = [], []
    for i in range(0, len(q), 1024):
        part = unit_q[i : i + 1024]
        if exact:
            at = _top(part @ unit_x.T, min(2 * k, len(x)))
            some = np.ones(at.shape, dtype=bool)
        else:
            at, approximate = block.candidates(part, rerank)
            s = np.concatenate([np.einsum("qrd,qd->qr", unit_x[at[j : j + 128]], part[j : j + 128]) for j in range(0, len(part), 128)])
            s[approximate <= NONE + 1] = -np.inf
            best = _top(s, min(2 * k, s.shape[1]))
            at, some = np.take_along_axis(at, best, 1), np.take_along_axis(s, best, 1) > -np.inf
        # the last places are decided in double precision
        dot = np.einsum("qrd,qd->qr", x[at].astype(np.float64), q[i : i + 1024].astype(np.float64))
        c = np.where(some, dot / norm_x[at] / norm_q[i : i + 1024, None], -np.inf)
        order = np.argsort(-c, axis=1, kind="stable")[:, :k]
        places.append(np.take_along_axis(at, order, 1))
        cosines.append(np.take_along_axis(c, order, 1))
    return np.concatenate(places), np.concatenate(cosines)


def _search(routed: DataFrame, dims: list[int], k: int, rerank: int, exact: bool) -> DataFrame:
    """(id, found): the k best of each block that a class asked, its own class among them."""

    def task(key: tuple, t: pa.Table) -> pa.Table:
        dim = dims[key[0].as_py()]
        t = t.combine_chunks()
        ids, role = t.column("id").to_numpy(), t.column("role").to_numpy()
        raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim)
        here, at = np.unique(ids[role & 1 > 0], return_index=True)
        x = raw[np.flatnonzero(role & 1)[at]]
        asking, at = np.unique(ids[role & 2 > 0], return_index=True)
        q = raw[np.flatnonzero(role & 2)[at]]
        if not len(here) or not len(asking):
            return pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], pa.list_(_HIT))})
        place, cosine = search_block(q, x, k, rerank, exact)
        some = cosine > -np.inf
        ends = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
        hits = pa.StructArray.from_arrays([pa.array(-cosine[some]), pa.array(here[place[some]])], fields=list(_HIT))
        return pa.table({"id": asking, "found": pa.ListArray.from_arrays(pa.array(ends), hits)})

    return routed.groupBy("g", "s", "i", "j").applyInArrow(task, "id long, found array<struct<c:double,other:long>>")


# --- all of it ----------------------------------------------------------------------------------------------------


def neighbours(vectors: DataFrame, k: int = K, margin: float = MARGIN, probes: int = PROBES, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """(model, dim, key, rank, neighbour, cosine): the k most similar vectors of every usable vector."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    keys = table_in_shared_dir(rows.groupBy("model", "dim", "key").agg(F.min("id").alias("id")), "vector-keys")
    sizes = keys.groupBy("model", "dim", "id").agg(F.count("*").alias("copies"))
    counts = collect_bounded(sizes.groupBy("model", "dim").agg(F.count("*").alias("n"), F.max("copies").alias("most")), GROUPS, "groups of vectors")
    if not counts:
        return spark.createDataFrame([], "model string, dim int, key string, rank int, neighbour string, cosine double")
    wanted = [max(PER_REGION, min(max(SAMPLE, PER_REGION * r["n"] // REGION), SAMPLE_FLOATS // (r["dim"] * len(counts)))) for r in counts]
    groups = F.broadcast(spark.createDataFrame([(r["model"], r["dim"], i, min(1.0, w / r["n"])) for i, (r, w) in enumerate(zip(counts, wanted))], "of_model string, of_dim int, g int, part double"))  # GROUPS rows at most
    rows = rows.join(groups, F.col("model").eqNullSafe(F.col("of_model")) & (F.col("dim") == F.col("of_dim"))).select("g", "part", "id", "vec")
    if max(r["most"] for r in counts) > HOT_KEYS:
        hot = [r["id"] for r in sizes.where(F.col("copies") > HOT_KEYS).orderBy(F.desc("copies")).limit(HOT_CLASSES).collect()]
        once = rows.where(F.col("id").isin(hot)).groupBy("id").agg(*(F.first(c).alias(c) for c in ("g", "part", "vec")))
        rows = rows.where(~F.col("id").isin(hot)).unionByName(once)
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.where(chance < F.col("part")).groupBy("id").agg(F.first("g").alias("g"), F.first("vec").alias("vec")).orderBy("id").toArrow().combine_chunks()  # about SAMPLE_FLOATS numbers
    regions = []
    for i, (r, w) in enumerate(zip(counts, wanted)):
        mine = sample.filter(pa.array(sample.column("g").to_numpy() == i)).slice(0, 2 * w)
        x = _unit(_matrix(mine.column("vec").combine_chunks(), r["dim"])) if len(mine) else np.eye(1, r["dim"], dtype=np.float32)
        regions.append(Regions(x, r["n"], margin, probes, exact))
    found = _search(_route(rows, regions), [r["dim"] for r in counts], k + 1, rerank, exact)
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")).select("id", F.explode("found").alias("x"))
    # classes back to keys: a class stands for its k + 1 least keys
    least = keys.selectExpr("id", "key", "row_number() over (partition by id order by key) as nth").where(F.col("nth") <= k + 1).groupBy("id").agg(F.collect_list("key").alias("keys"))
    named = best.select("id", F.col("x.other").alias("other"), F.when(F.col("x.other") == F.col("id"), F.lit(-1.0)).otherwise(F.col("x.c")).alias("c")).join(least.withColumnRenamed("id", "other"), "other")
    lists = named.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("keys", lambda x: F.struct(F.col("c").alias("c"), x.alias("key")))))), 1, k + 1).alias("list"))
    mine = keys.join(lists, "id").select("model", "dim", "key", F.posexplode(F.slice(F.filter("list", lambda x: x["key"] != F.col("key")), 1, k)).alias("pos", "x"))
    return mine.select("model", "dim", "key", (F.col("pos") + 1).alias("rank"), F.col("x.key").alias("neighbour"), (-F.col("x.c")).alias("cosine"))


def similar_pairs(found: DataFrame) -> DataFrame:
    """(model, dim, key_a, key_b), key_a < key_b: at least one is among the other's most similar."""
    return found.select("model", "dim", F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
