"""Queries of the operators for large text collections, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import garbled, leakage, nearcopies, neighbours, packing, sharedspans, splitting
from gleaner.runtime import spread_table, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(spread_table(spark, d, "chunks"), "chunk_id", "text").pairs("chunk_id_a", "chunk_id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(spread_table(spark, d, "chunks"), "chunk_id", "text").groups("chunk_id")


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(splitting.items(table(spark, d, "chunks"), table(spark, d, "documents")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("item_kind", "item_key").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.placed(_p2(spark, d), table(spark, d, "chunks"), table(spark, d, "documents"))


def p2_reassembled(spark: SparkSession, d: str) -> DataFrame:
    return splitting.reassembled(_p2(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.neighbours(table(spark, d, "vectors")))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "vectors")).withColumn("cosine", F.round("cosine", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(spread_table(spark, d, "documents")).select("doc_id").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(spread_table(spark, d, "documents"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spread_table(spark, d, "documents"), table(spark, d, "context_windows"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    return packing.kept(p6_packed(spark, d), table(spark, d, "context_windows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_pairs(leakage.leaked_spans(spread_table(spark, d, "documents"), table(spark, d, "eval_cases")))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(leakage.leaked_spans(spread_table(spark, d, "documents"), table(spark, d, "eval_cases")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.SharedSpans(spread_table(spark, d, "documents")).pairs()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.SharedSpans(spread_table(spark, d, "documents")).shares()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_reassembled": p2_reassembled,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_kept": p6_kept,
    "p7_found": p7_found,
    "p7_documents": p7_documents,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}

#: Usable vectors, each key once, as double precision.
_VECTORS = """v AS (SELECT model, dim, key, any_value(vec)::DOUBLE[] AS v FROM vectors
            WHERE vec IS NOT NULL AND key IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY ALL),
        s AS (SELECT a.model, a.dim, a.key, b.key AS neighbour, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS c
            FROM v a JOIN v b ON a.model IS NOT DISTINCT FROM b.model AND a.dim = b.dim AND a.key <> b.key),
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, dim, key ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s) WHERE rank <= 5)"""
#: Of every text the runs of 400 characters, and those that another text holds too.
_SHARED = """t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400),
        c AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM t GROUP BY text),
        g AS (SELECT doc_id, i, hash(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM c)),
        r AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        f AS (SELECT g.* FROM g JOIN r USING (h))"""
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"

ORACLE: dict[str, str] = {
    "p1_found": f"""
        WITH c AS (SELECT DISTINCT chunk_id, text, {_WORDS.format("text")} AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        s AS (SELECT DISTINCT chunk_id, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 3)),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY ALL),
        common AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT a AS chunk_id_a, b AS chunk_id_b FROM common JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE m / (x.n + y.n - m) >= 0.6
        UNION
        SELECT x.chunk_id, y.chunk_id FROM c x JOIN c y ON x.text = y.text AND x.chunk_id < y.chunk_id""",
    "p2_found": """
        SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_key FROM chunks WHERE floor(length(text) / 4) > 512
        UNION ALL
        SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE floor(length(text) / 4) > 512""",
    "p2_reassembled": """
        SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_key, md5(text) AS digest, length(text) AS n_chars, true AS within FROM chunks WHERE floor(length(text) / 4) > 512
        UNION ALL
        SELECT 'document', CAST(doc_id AS VARCHAR), md5(text), length(text), true FROM documents WHERE floor(length(text) / 4) > 512""",
    "p1_groups": f"""
        WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, text, {_WORDS.format("text")} AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        s AS (SELECT DISTINCT chunk_id, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 3)),
        d AS (SELECT chunk_id, coalesce(string_agg(g, ' ' ORDER BY g), '-' || any_value(text)) AS digest FROM c LEFT JOIN s USING (chunk_id) GROUP BY chunk_id),
        k AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY digest) AS rep, count(*) OVER (PARTITION BY digest) AS copies FROM d),
        x AS (SELECT s.chunk_id AS rep, g FROM s JOIN k USING (chunk_id) WHERE k.chunk_id = rep),
        n AS (SELECT rep, count(*) AS n FROM x GROUP BY ALL),
        m AS (SELECT a.rep AS a, b.rep AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
        l AS (SELECT a, b FROM m JOIN n p ON p.rep = a JOIN n q ON q.rep = b WHERE m / (p.n + q.n - m) >= 0.6),
        z AS (SELECT DISTINCT rep AS node, rep AS label FROM k UNION SELECT l.b, z.label FROM z JOIN l ON l.a = z.node)
        SELECT chunk_id, (SELECT min(label) FROM z WHERE node = rep) AS group_id, rep AS class_id, copies AS n_copies, (SELECT count(*) FROM l WHERE a = rep) AS n_links FROM k""",
    "p4_found": f"""
        WITH {_VECTORS} SELECT DISTINCT model, dim, least(key, neighbour) AS key_a, greatest(key, neighbour) AS key_b FROM n""",
    "p4_neighbours": f"""
        WITH {_VECTORS} SELECT model, dim, key, CAST(rank AS INTEGER) AS rank, neighbour, round(c, 9) AS cosine FROM n""",
    "p8_found": f"""
        WITH {_SHARED}, o AS (SELECT c.doc_id AS rep, t.doc_id FROM t JOIN c USING (text))
        SELECT DISTINCT least(x.doc_id, y.doc_id) AS doc_id_a, greatest(x.doc_id, y.doc_id) AS doc_id_b
        FROM (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.h = b.h AND a.doc_id < b.doc_id) p JOIN o x ON x.rep = p.a JOIN o y ON y.rep = p.b
        UNION SELECT x.doc_id, y.doc_id FROM o x JOIN o y ON x.rep = y.rep AND x.doc_id < y.doc_id""",
    "p8_shares": f"""
        WITH {_SHARED}, e AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), 1000000000) AS next FROM f),
        u AS (SELECT doc_id, CAST(sum(least(400, next - i)) AS INTEGER) AS covered FROM e GROUP BY doc_id),
        p AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS partners FROM f a JOIN f b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id)
        SELECT t.doc_id, CAST(length(t.text) AS INTEGER) AS n_chars, CASE WHEN copies > 1 THEN CAST(length(t.text) AS INTEGER) ELSE covered END AS shared_chars,
            round(CASE WHEN copies > 1 THEN length(t.text) ELSE covered END / length(t.text), 6) AS share, coalesce(partners, 0) AS n_partners, copies AS n_copies, c.doc_id AS class_id
        FROM t JOIN c USING (text) LEFT JOIN u ON u.doc_id = c.doc_id LEFT JOIN p ON p.doc_id = c.doc_id WHERE copies > 1 OR covered IS NOT NULL""",
    "p6_kept": """
        SELECT window_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, CAST(0 AS BIGINT) AS parted, CAST(0 AS BIGINT) AS overfull FROM context_windows WHERE capacity_tokens > coalesce(reserved_tokens, 0)""",
    "p7_documents": f"""
        WITH t AS (SELECT case_id, 'query' AS field, {_WORDS.format("query")} AS w FROM eval_cases UNION ALL SELECT case_id, 'passage', {_WORDS.format("passage")} FROM eval_cases),
        c AS (SELECT case_id, field, i, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT case_id, field, w, unnest(range(1, len(w) - 8)) AS i FROM t WHERE len(w) >= 10)),
        d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
        h AS (SELECT DISTINCT case_id, field, doc_id, g.i AS x, g.i - c.i AS diagonal FROM c JOIN g USING (g)),
        r AS (SELECT case_id, field, doc_id, count(*) + 9 AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY case_id, field, doc_id, diagonal ORDER BY x) AS island FROM h) GROUP BY case_id, field, doc_id, diagonal, island)
        SELECT doc_id, list_sort(list(DISTINCT case_id)) AS case_ids, CAST(max(n) AS INTEGER) AS longest_words, count(DISTINCT case_id || field) AS n_texts FROM r GROUP BY doc_id""",
    "p7_found": f"""
        WITH t AS (SELECT case_id, {_WORDS.format("query")} AS w FROM eval_cases UNION ALL SELECT case_id, {_WORDS.format("passage")} FROM eval_cases),
        c AS (SELECT DISTINCT case_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT case_id, w, unnest(range(1, len(w) - 8)) AS i FROM t WHERE len(w) >= 10)),
        d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        g AS (SELECT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10))
        SELECT DISTINCT case_id, doc_id FROM c JOIN g USING (g)""",
}
