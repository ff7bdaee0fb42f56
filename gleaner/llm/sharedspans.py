"""Long exact spans shared between records (problem 8), by repeated-phrase automata.

1. Fingerprint: hashes of ``k``-character grams, winnowed so that any ``min_chars`` shared characters leave both texts
   with one common hash. Exact copies are collapsed first: one representative of each distinct text goes on.
2. Phrases: grams whose hash occurs in two or more distinct texts, cut out of the least document that holds them.
3. Automata: phrases are sharded by the document they were cut from; each shard compiles a pyahocorasick automaton and
   streams the documents that have a fingerprint in that shard, which confirms recurrence character for character and
   locates every occurrence. A document without any recurring fingerprint can't hold a shared span of ``min_chars``.
   A shard with much text is split into blocks, each with its own copy of the automaton.
4. Extension: occurrences of one phrase are compared by the ``min_chars - k`` characters on both sides; a pair is kept
   when phrase and equal sides reach ``min_chars``. The union of these spans is the whole shared part of a text.
   Phrases with many occurrences are compared block by block.

Null texts and texts under ``min_chars`` have no spans. Repeated rows of one id count once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import copies
from gleaner.llm import textnum as tn
from gleaner.runtime import table_in_shared_dir

MIN_CHARS = 400
K = 200
#: Phrases in one automaton (of K characters each): bounds an executor's memory whatever the corpus is.
SHARD_PHRASES = 2000
#: Characters streamed through one automaton by one task.
BLOCK_CHARS = 4 << 20
#: Occurrences of one phrase compared within one task.
BLOCK_OCCURRENCES = 256
#: Occurrences that one task compares, of phrases that aren't cut into blocks: about this many, and GROUPS tasks at least.
GROUP_OCCURRENCES, GROUPS = 16384, 16

_FP = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_chars", pa.int32()), ("grams", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
_OCC = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("left", pa.string()), ("right", pa.string())])
_SPAN = pa.schema([("doc_id_a", pa.int64()), ("doc_id_b", pa.int64()), ("a_start", pa.int32()), ("b_start", pa.int32()), ("n_chars", pa.int32())])


def fingerprints(documents: DataFrame, min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """(doc_id, digest, n_chars, grams, at): the distinct winnowed grams of each text and where each begins first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in tn.passes(texts):
                part = texts[lo:hi]
                cps, bounds = tn.codepoints(part)
                g = tn.char_grams(cps, bounds, k)
                at = tn.winnow(g, min_chars - k + 1)
                of = np.searchsorted(bounds, at, side="right") - 1
                keep = np.sort(np.unique(np.rec.fromarrays([of, g[at]]), return_index=True)[1])
                at, of = at[keep], of[keep]
                ends = pa.array(np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo), pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part], type=pa.binary()),
                        pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(g[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array((at - bounds[of]).astype(np.int32))),
                    ],
                    schema=_FP,
                )

    long_enough = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= min_chars)
    return long_enough.mapInArrow(scan, "doc_id long, digest binary, n_chars int, grams array<long>, at array<int>")


def _stream(phrases: list[tuple[int, str]], docs: Iterator[tuple[int, str]], side: int) -> Iterator[tuple]:
    """(gram, doc_id, positions, left, right) of every occurrence of the phrases; equal surroundings share a row."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for gram, phrase in phrases:
        automaton.add_word(phrase, (gram, len(phrase)))
    if not phrases:
        return
    automaton.make_automaton()
    for doc, text in docs:
        seen: dict[tuple, list[int]] = {}
        for end, (gram, n) in automaton.iter(text):
            at = end + 1 - n
            seen.setdefault((gram, text[max(0, at - side) : at], text[end + 1 : end + 1 + side]), []).append(at)
        for (gram, left, right), at in seen.items():
            yield gram, doc, at, left, right


def _table(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    """The rows as a table, made in pieces, so that no more than one piece stands as Python objects."""
    pieces = []
    while part := list(islice(rows, 10000)):
        pieces.append(pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*part), schema)], schema=schema))
    return pa.Table.from_batches(pieces, schema=schema)


def occurrences(documents: DataFrame, fps: DataFrame, min_chars: int = MIN_CHARS, k: int = K) -> tuple[DataFrame, int]:
    """Every occurrence of every recurring phrase, with the characters on both sides; and how many groups to compare them in."""
    each = fps.select("doc_id", F.explode(F.arrays_zip("grams", "at")).alias("x")).select("doc_id", F.col("x.grams").alias("gram"), F.col("x.at").alias("at"))
    phrases = table_in_shared_dir(each.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("owner")).where("n > 1"), "phrases")
    shards = max(1, -(-phrases.count() // SHARD_PHRASES))
    groups = max(GROUPS, -(-(phrases.agg(F.sum("n")).first()[0] or 0) // GROUP_OCCURRENCES))
    shard = F.pmod(F.xxhash64("owner.doc_id"), F.lit(shards)).cast("int")
    phrases = phrases.select("gram", "n", "owner", shard.alias("shard"))
    own = phrases.groupBy(F.col("owner.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("gram", F.col("owner.at").alias("at"))).alias("own"))
    routes = each.select("doc_id", "gram").join(phrases.select("gram", "shard"), "gram").groupBy("doc_id").agg(F.collect_set("shard").alias("shards"))
    wanted = routes.join(own, "doc_id", "left")
    texts = table_in_shared_dir(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= min_chars).join(wanted, "doc_id").dropDuplicates(["doc_id"]), "phrase-texts")
    cut = texts.where("own is not null").select("text", F.explode("own").alias("o")).select(F.col("o.gram").alias("gram"), F.expr(f"substring(text, o.at + 1, {k})").alias("phrase"))
    streams = texts.select("doc_id", "text", F.explode("shards").alias("shard"))
    load = streams.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / BLOCK_CHARS).cast("int").alias("blocks"))  # a row per shard
    streams = streams.join(load, "shard").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    compiled = cut.join(phrases.select("gram", "shard"), "gram").join(load, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = min_chars - k

    def shard_task(p: pa.Table, d: pa.Table) -> pa.Table:
        words = zip(p.column("gram").to_pylist(), p.column("phrase").to_pylist())
        docs = ((i, t) for b in d.to_batches(1000) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        return _table(_stream(list(words), docs, side), _OCC)

    a, b = compiled.select("shard", "block", "gram", "phrase"), streams.select("shard", "block", "doc_id", "text")
    return a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInArrow(shard_task, "gram long, doc_id long, at array<int>, left string, right string"), groups


def _ends(texts: list[str], width: int) -> np.ndarray:
    """A row of code points for each text; behind its end a number that no other row has."""
    out = np.empty((len(texts), width), dtype=np.uint32)
    out[:] = (0x200000 + np.arange(len(texts), dtype=np.uint32))[:, None]
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


def _compare(doc: list[int], at: list[list[int]], left: list[str], right: list[str], k: int, min_chars: int, cross: list[int] | None) -> Iterator[tuple]:
    """Spans of at least min_chars through one phrase; cross: compare only rows of different blocks."""
    side = min_chars - k
    ls, rs = _ends([x[::-1] for x in left], side + 1), _ends(right, side + 1)
    ids = np.array(doc)
    for i in range(len(doc) - 1):
        l = (ls[i] != ls[i + 1 :]).argmax(axis=1)
        r = (rs[i] != rs[i + 1 :]).argmax(axis=1)
        for j in np.flatnonzero((l + r >= side) & (ids[i + 1 :] != ids[i])):
            x, y = (i, i + 1 + j) if doc[i] < doc[i + 1 + j] else (i + 1 + j, i)
            if cross is not None and cross[x] == cross[y]:
                continue
            n = int(k + l[j] + r[j])
            # every place is covered once on either side; repeated places are aligned with the first of the other
            for p in at[x]:
                yield doc[x], doc[y], p - int(l[j]), at[y][0] - int(l[j]), n
            for q in at[y][1:]:
                yield doc[x], doc[y], at[x][0] - int(l[j]), q - int(l[j]), n


def spans(occ: DataFrame, groups: int, min_chars: int = MIN_CHARS, k: int = K) -> DataFrame:
    """Verified shared spans between different texts; one pair of texts has a row for each phrase they share."""
    counted = occ.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK_OCCURRENCES).cast("int")
    parts = occ.join(counted, "gram").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    several = F.col("blocks") > 1
    parts = parts.select(
        F.when(several, F.col("gram")).otherwise(F.pmod("gram", F.lit(groups).cast("long"))).alias("g"),
        F.when(several, F.least("own", "other") + 1).otherwise(F.lit(0)).alias("i"),
        F.when(several, F.greatest("own", "other") + 1).otherwise(F.lit(0)).alias("j"),
        "own", "gram", "doc_id", "at", "left", "right",
    )

    def task(key: tuple, table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        i, j = key[1].as_py(), key[2].as_py()
        for r in zip(*(table.column(c).to_pylist() for c in ("gram", "doc_id", "at", "left", "right", "own"))):
            by.setdefault(r[0], []).append(r[1:])

        def rows() -> Iterator[tuple]:
            for r in by.values():
                if len(r) > 1:
                    doc, at, left, right, own = map(list, zip(*r))
                    yield from _compare(doc, at, left, right, k, min_chars, own if i != j else None)

        return _table(rows(), _SPAN)

    return parts.groupBy("g", "i", "j").applyInArrow(task, "doc_id_a long, doc_id_b long, a_start int, b_start int, n_chars int")


class SharedSpans:
    """The stages over one table of documents; what several results need is written once to the shared folder."""

    def __init__(self, documents: DataFrame, min_chars: int = MIN_CHARS, k: int = K):
        fps = table_in_shared_dir(fingerprints(documents, min_chars, k).dropDuplicates(["doc_id"]), "fingerprints")
        ids = fps.select("doc_id", "digest")
        self.classes = copies.classes(ids, "doc_id", "digest")
        self.members = copies.members(ids, self.classes, "doc_id", "digest")
        self.lengths = fps.select("doc_id", "n_chars")
        reps = fps.join(self.classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        self.spans = spans(*occurrences(documents, reps, min_chars, k), min_chars, k)

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), a < b: texts with a common substring of the least length; whole copies count, all pairs of them."""
        return copies.all_pairs(self.spans.select("doc_id_a", "doc_id_b").distinct(), self.members, "doc_id_a", "doc_id_b")

    def shares(self) -> DataFrame:
        """One row for each text that shares a span: its length, how many of its characters stand elsewhere too, with how
        many other distinct texts, how many whole copies it has, and the least id among these (its own without copies).
        Members of a copy class are shared from end to end."""
        s = table_in_shared_dir(self.spans, "spans")
        a = s.select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("partner"), F.col("a_start").alias("x"), (F.col("a_start") + F.col("n_chars")).alias("y"))
        b = s.select(F.col("doc_id_b").alias("doc_id"), F.col("doc_id_a").alias("partner"), F.col("b_start").alias("x"), (F.col("b_start") + F.col("n_chars")).alias("y"))
        both = a.unionByName(b)
        partners = both.select("doc_id", "partner").distinct().groupBy("doc_id").agg(F.count("*").alias("n_partners"))
        # the union of intervals: count what reaches beyond all earlier ends
        distinct = both.groupBy("doc_id", "x").agg(F.max("y").alias("y"))
        covered = distinct.selectExpr("doc_id", "x", "y", "coalesce(max(y) over (partition by doc_id order by x rows between unbounded preceding and 1 preceding), 0) as reached")
        covered = covered.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("y") - F.greatest("x", "reached"))).cast("int").alias("covered"))
        reps = covered.join(partners, "doc_id")
        all_ids = self.members.select(F.col("member").alias("doc_id"), "rep", "copies").join(reps.withColumnRenamed("doc_id", "rep"), "rep", "left")
        lone = reps.join(self.members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti").select("doc_id", "covered", "n_partners", F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("rep"))
        every = lone.unionByName(all_ids.select("doc_id", "covered", "n_partners", "copies", "rep")).join(self.lengths, "doc_id")
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("covered"))
        return every.select(
            "doc_id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("share"),
            F.coalesce("n_partners", F.lit(0).cast("long")).alias("n_partners"), F.col("copies").cast("long").alias("n_copies"), F.col("rep").alias("class_id"),
        )
