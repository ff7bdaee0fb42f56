"""Cutting oversized texts at natural boundaries (problem 2), by a recursive hierarchy of separators.

A text is cut into sections (before headings); what is still too long into paragraphs, lines, sentences, words and at
last characters. The parts are then packed greedily into pieces up to the limit; a piece that is well filled also ends before
a section or paragraph that has to be cut itself. Every piece after the first begins
``overlap`` before the end of the piece before it, or, where that lies in a word, at the beginning of the word, if it is no
more than a quarter of the overlap away; else at the character that a mark belongs to. So neighbours share at least 64
tokens by the estimate and fewer than 81. Offsets are counted in characters of the item's own text and
the estimate is computed from the piece; ``placed`` adds the offset in the document, where a chunk's text is looked up.
``token_estimate`` of the input is never read, and ``char_start`` only to choose among places where the text does stand.

Null and empty texts and texts within the limit have no pieces. Repeated rows of one key give the pieces once. A text
without any boundary is cut between characters, though never before a combining mark. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 512
OVERLAP_TOKENS = 64
CHARS_PER_TOKEN = 4

#: Patterns whose end is a place to cut, from the coarsest to the finest.
SEPARATORS = [
    re.compile(r"\n(?=#{1,6}[ \t])"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*"),
    re.compile(r"\s+"),
]
#: Levels of the hierarchy (sections, paragraphs) whose boundaries a piece keeps before an oversized part.
COARSE = 2
_MARK = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u200d\U0001f3fb-\U0001f3ff]")


def _cuts(text: str, lo: int, hi: int, most: int, level: int) -> Iterator[tuple[int, bool]]:
    """Ends of the parts of text[lo:hi], each at most ``most`` long and cut by the coarsest separator that suffices; and
    whether a section or paragraph that must be cut itself begins there."""
    if hi - lo <= most:
        yield hi, False
    elif level == len(SEPARATORS):
        while hi - lo > most:
            at = lo + most
            while at > lo + 1 and _inside(text, at):
                at -= 1
            if at == lo + 1:  # nothing but marks
                at = lo + most
            yield at, False
            lo = at
        yield hi, False
    else:
        ends = [m.end() for m in SEPARATORS[level].finditer(text, lo, hi)]
        if not ends or ends[-1] != hi:
            ends.append(hi)
        for end in ends:
            if end > lo:
                if level < COARSE and end - lo > most:
                    yield lo, True
                yield from _cuts(text, lo, end, most, level + 1)
                lo = end


def _inside(text: str, at: int) -> bool:
    """Whether a cut would part a mark from its letter."""
    return at > 0 and (_MARK.match(text, at) is not None or text[at - 1] == "\u200d")


def start(text: str, end: int, overlap: int) -> int:
    """Where the piece after one that ends at ``end`` begins."""
    at = end - overlap
    back = max(0, at - overlap // 4)
    if at <= 0 or text[at - 1].isspace() or text[at].isspace():
        return max(0, at)
    word = at - 1
    while word > back and not text[word - 1].isspace():
        word -= 1
    if word == 0 or text[word - 1].isspace():
        return word
    while at > back + 1 and _inside(text, at):
        at -= 1
    return end - overlap if _inside(text, at) else at


def pieces(text: str, limit: int, overlap: int) -> list[int]:
    """Begin and end of each piece, one after another: packed greedily, each at most ``limit`` characters long.

    A piece that is filled to a quarter also ends before a section or paragraph that is too long to be added whole.
    """
    out: list[int] = []
    begin = end = 0
    least = max(limit // 4, overlap + overlap // 4 + 1)
    for cut, breaks in _cuts(text, 0, len(text), limit - overlap - overlap // 4, 0):
        if cut - begin > limit:
            out += (begin, end)
            begin = start(text, end, overlap)
        end = cut
        if breaks and end - begin - (out[-1] - begin if out else 0) >= least:
            out += (begin, end)
            begin = start(text, end, overlap)
    return [*out, begin, end] if not out or end > out[-1] else out


def estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / CHARS_PER_TOKEN)).cast("int")


def split_oversized(items: DataFrame, limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of the oversized rows of items(item_kind, item_key, text): (item_kind, item_key, piece_index, char_start,
    char_end, token_estimate, text).

    Only oversized texts leave the JVM; what a caller doesn't select (the pieces' text, say) isn't made.
    """
    limit, overlap = limit_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, overlap_tokens * CHARS_PER_TOKEN
    if overlap < 0 or 2 * overlap >= limit:
        raise ValueError("the overlap must be less than half of the limit")

    @F.arrow_udf("array<int>")
    def bounds(texts: pa.Array) -> pa.Array:
        return pa.array([pieces(t, limit, overlap) for t in texts.to_pylist()], type=pa.list_(pa.int32()))

    oversized = items.where(F.floor(F.length("text") / CHARS_PER_TOKEN) > limit_tokens).dropDuplicates(["item_kind", "item_key"])
    cut = oversized.withColumn("bounds", bounds("text"))
    each = cut.select("item_kind", "item_key", "text", "bounds", F.explode(F.expr("sequence(0, int(size(bounds) div 2) - 1)")).alias("piece_index"))
    at = F.col("piece_index") * 2
    each = each.withColumn("char_start", F.get("bounds", at)).withColumn("char_end", F.get("bounds", at + 1))
    n = F.col("char_end") - F.col("char_start")
    return each.select("item_kind", "item_key", "piece_index", "char_start", "char_end", estimate(n).alias("token_estimate"), F.substring(F.col("text"), F.col("char_start") + 1, n).alias("text"))


def items(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks and documents as one table of items."""
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text")
    return c.unionByName(documents.select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_key"), "text"))


def placed(pieces_: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The pieces with ``doc_start``, their offset in the document's text: of a document's piece ``char_start``, of a chunk's
    where the chunk's text stands in the document of its key, plus ``char_start``. Null where the document isn't there or
    doesn't hold the text. Of several places, the one that a row's own ``char_start`` names counts, else the first.

    Only oversized chunks are looked up; of the documents, only those they name are compared.
    """
    c = chunks.select(F.col("chunk_id").alias("item_key"), "text", F.col("doc_id").alias("doc_key"), F.col("char_start").alias("said"))
    c = c.where((F.floor(F.length("text") / CHARS_PER_TOKEN) > LIMIT_TOKENS) & F.col("item_key").isNotNull() & F.col("doc_key").isNotNull())
    held = c.join(documents.where("text is not null").select("doc_key", F.col("text").alias("whole")), "doc_key")
    first = F.expr("instr(whole, text)") - 1
    # substring counts from the end below 0
    named = (F.col("said") >= 0) & (F.expr("substring(whole, said + 1, length(text))") == F.col("text"))
    places = held.select("item_key", F.when(named, F.col("said")).alias("named"), first.alias("first")).where("first >= 0")
    places = places.groupBy("item_key").agg(F.coalesce(F.min("named"), F.min("first")).cast("int").alias("chunk_at")).withColumn("item_kind", F.lit("chunk"))
    found = pieces_.join(places, ["item_kind", "item_key"], "left")
    at = F.when(F.col("item_kind") == "document", F.lit(0)).otherwise(F.col("chunk_at"))
    return found.select(*pieces_.columns, (at + F.col("char_start")).alias("doc_start"))


def reassembled(pieces_: DataFrame) -> DataFrame:
    """(item_kind, item_key, digest, n_chars, within) of each item: what its pieces give when they are put together again, every
    piece without the characters that the one before it has, and whether all pieces keep the limit."""
    piece = F.struct("piece_index", "char_start", "char_end", "text")
    whole = F.aggregate(
        F.sort_array(F.collect_list(piece)),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("end")),
        lambda s, p: F.struct(F.concat(s["text"], F.substring(p["text"], s["end"] - p["char_start"] + 1, F.length(p["text"]))).alias("text"), p["char_end"].alias("end")),
    )
    rows = pieces_.groupBy("item_kind", "item_key").agg(whole["text"].alias("text"), F.max("token_estimate").cast("long").alias("most_tokens"))
    return rows.select("item_kind", "item_key", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), (F.col("most_tokens") <= LIMIT_TOKENS).alias("within"))
