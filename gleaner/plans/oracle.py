"""The core's queries in DuckDB's SQL, over whole tables. Written apart from the operators, from their definitions."""

from __future__ import annotations

from gleaner.functions.text import STOP_WORDS
from gleaner.operators.answer import INSTRUCTION, NO_ANSWER

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Unicode white space.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _tok(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


_C = "c AS (SELECT chunk_id AS id, any_value(text) AS text, any_value(source) AS source, any_value(doc_id) AS doc_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
_T = f"{_C}, t AS (SELECT id, w, len(w) AS dl FROM (SELECT id, {_tok('text')} AS w FROM c) WHERE len(w) > 0)"
_TF = f"{_T}, tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS term FROM t) GROUP BY ALL)"
_Q = f"q AS (SELECT case_id AS qid, query, {_tok('query')} AS w FROM eval_cases)"
_RANK = "CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS BIGINT)"
_BM25 = f"""{_TF}, {_Q},
    qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(w) AS term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM t),
    bs AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
           FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY qid, id)"""
_OVER = f"""os AS (SELECT qid, id, round(m / (nq + nt - m), 9) AS score FROM (
        SELECT qid, id, nq, nt, count(*) AS m FROM (SELECT qid, len(list_distinct(w)) AS nq, unnest(list_distinct(w)) AS term FROM q) a
        JOIN (SELECT id, len(list_distinct(w)) AS nt, unnest(list_distinct(w)) AS term FROM t) b USING (term) GROUP BY ALL))"""


def _top(scores: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, {_RANK} AS rank FROM {scores}) WHERE rank <= {k}"


_LEGS = f"""{_BM25}, {_OVER}, s AS ({_top('bs', 10)}), d AS ({_top('os', 10)}),
    m AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank,
        round(coalesce(0.6 / (60 + d.rank), 0) + coalesce(0.4 / (60 + s.rank), 0), 12) AS fused,
        list_filter([CASE WHEN d.rank IS NOT NULL THEN 'dense' END, CASE WHEN s.rank IS NOT NULL THEN 'sparse' END], lambda x: x IS NOT NULL) AS retrieved_by,
        CAST(coalesce(d.rank, 1000000000 + s.rank) AS BIGINT) AS ord
        FROM d FULL JOIN s ON d.qid = s.qid AND d.id = s.id)"""
_RERANK = f"""{_LEGS},
    x AS (SELECT m.qid, m.id, fused, ord, q.w AS qw, t.w AS dw, list_filter(list_distinct(q.w), lambda y: list_contains(t.w, y)) AS common FROM m JOIN q USING (qid) JOIN t USING (id)),
    y AS (SELECT *, len(common) AS n, list_transform(common, lambda c: len(qw) - list_position(list_reverse(qw), c)) AS last FROM x),
    r AS (SELECT qid, id, ord, CASE WHEN len(qw) = 0 THEN fused ELSE round(0.55 * n / len(list_distinct(qw)) + 0.15 * least(1.0, 12.0 * n / len(dw))
        + 0.2 * least(1.0, 2.0 * n / CASE WHEN n > 0 THEN list_max(last) - list_min(last) + 1 ELSE 1 END) + 0.1 * fused, 9) END AS score FROM y),
    rr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS BIGINT) AS position FROM r) WHERE position <= 10)"""


_DENSE = f"""v AS (SELECT key AS id, any_value(vec)::DOUBLE[] AS v FROM vectors WHERE model = 'hashing' AND dim = 64 AND key IS NOT NULL AND vec IS NOT NULL AND len(vec) = 64
        AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY key),
    q AS (SELECT v.id AS qid, {_tok('c.source')} AS w FROM v JOIN c ON c.id = v.id WHERE v.id LIKE '%0')"""
_NEAR = "ds AS (SELECT a.id AS qid, b.id AS id, round(list_dot_product(a.v, b.v), 9) AS score FROM v a, v b WHERE a.id LIKE '%0')"


def _hits(k: int) -> str:
    return f"{_BM25}, h AS (SELECT b.qid, b.id, b.score, b.rank AS position, c.text, c.source FROM ({_top('bs', k)}) b JOIN c USING (id))"


_SENT = f"""{_hits(5)},
    e AS (SELECT qid, position, source, unnest(l) AS sentence, generate_subscripts(l, 1) AS nr FROM (
        SELECT qid, position, source, string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?]){_WS}+', concat('\\1', chr(1)), 'g'), chr(1)) AS l FROM h)),
    f AS (SELECT qid, position, source, nr, {_strip('sentence')} AS sentence FROM e),
    g AS (SELECT f.*, {_tok('f.sentence')} AS w, list_distinct(q.w) AS qw FROM f JOIN q USING (qid) WHERE length(f.sentence) >= 15),
    i AS (SELECT *, len(list_filter(qw, lambda y: list_contains(w, y))) AS n FROM g WHERE len(w) > 0 AND len(qw) > 0),
    j AS (SELECT *, round(0.75 * n / len(qw) + 0.25 * least(1.0, 8.0 * n / len(w)), 9) AS score FROM i WHERE n > 0),
    k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, position, nr) AS BIGINT) AS nth FROM j) WHERE nth <= 4),
    l AS (SELECT qid, nth, position, coalesce(source, '') AS source, sentence, score, min(nth) OVER (PARTITION BY qid, coalesce(source, '')) AS first_use FROM k),
    z AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY qid ORDER BY first_use) AS BIGINT) AS citation FROM l)"""
_EVAL = f"""{_hits(8)},
    fl AS (SELECT h.qid, h.position AS rank, len(list_filter(relevant, lambda x: x IS NOT NULL AND x <> '' AND contains(lower(coalesce(source, '')), lower(x)))) > 0 AS rel FROM h JOIN eval_cases e ON e.case_id = h.qid),
    ag AS (SELECT qid, count(*) FILTER (rel) AS n, min(rank) FILTER (rel) AS first, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM fl GROUP BY qid),
    pq AS (SELECT e.case_id AS qid, CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS recall, round(coalesce(n, 0) / 8, 9) AS precision, round(coalesce(1 / first, 0), 9) AS reciprocal_rank,
        round(CASE WHEN coalesce(n, 0) > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 9) AS ndcg, coalesce(n, 0) > 0 AS hit
        FROM eval_cases e LEFT JOIN ag ON ag.qid = e.case_id)"""


def _meta(column: str) -> str:
    """meta as JSON; a JSON string that holds JSON is that JSON; null where it doesn't parse."""
    inner = f"CASE WHEN json_type({column}::JSON) = 'VARCHAR' THEN CASE WHEN json_valid({column}::JSON ->> '$') THEN ({column}::JSON ->> '$') END ELSE {column} END"
    return f"CASE WHEN json_valid({column}) THEN {inner} END"


_SPANS = "sp AS (SELECT trace_id, arrived_at, i, spans[i + 1] AS x FROM (SELECT trace_id, arrived_at, spans, unnest(range(len(spans))) AS i FROM traces WHERE trace_id IS NOT NULL) WHERE spans[i + 1] IS NOT NULL)"
_CALLS = f"{_SPANS}, ca AS (SELECT trace_id, arrived_at, i, j, x.calls[j + 1] AS x FROM (SELECT *, unnest(range(len(x.calls))) AS j FROM sp) WHERE x.calls[j + 1] IS NOT NULL)"
_BATCHES = f"{_CALLS}, ba AS (SELECT trace_id, arrived_at, i, j, k, x.batches[k + 1] AS x FROM (SELECT *, unnest(range(len(x.batches))) AS k FROM ca) WHERE x.batches[k + 1] IS NOT NULL)"
_LEGNODES = f"""mj AS (SELECT trace_id, arrived_at, m::JSON -> '$.legs' AS legs FROM (SELECT trace_id, arrived_at, {_meta('meta')} AS m FROM traces WHERE trace_id IS NOT NULL) WHERE m IS NOT NULL AND json_type(m::JSON) = 'OBJECT'),
    ln AS (
        SELECT trace_id, arrived_at, leg ->> '$.leg' AS name, leg FROM (SELECT trace_id, arrived_at, unnest(CAST(legs AS JSON[])) AS leg FROM mj WHERE json_type(legs) = 'ARRAY')
        UNION ALL SELECT trace_id, arrived_at, legs ->> '$.leg', legs FROM mj WHERE json_type(legs) = 'OBJECT' AND json_exists(legs, '$.leg')
        UNION ALL SELECT trace_id, arrived_at, k, legs -> ('$."' || k || '"') FROM (SELECT trace_id, arrived_at, legs, unnest(json_keys(legs)) AS k FROM mj WHERE json_type(legs) = 'OBJECT' AND NOT json_exists(legs, '$.leg'))),
    lo AS (SELECT * FROM ln WHERE name IS NOT NULL AND json_type(leg) = 'OBJECT'),
    lh AS (
        SELECT trace_id, arrived_at, name, unnest(range(CAST(json_array_length(leg -> '$.hits') AS BIGINT))) AS i, leg -> '$.hits' AS hits FROM lo WHERE json_type(leg -> '$.hits') = 'ARRAY'
        UNION ALL SELECT trace_id, arrived_at, name, 0, json_array(leg -> '$.hits') FROM lo WHERE json_type(leg -> '$.hits') = 'OBJECT')"""
_CIT = "ci AS (SELECT trace_id, created_at AS arrived_at, i, citations[i + 1] AS x FROM (SELECT trace_id, created_at, citations, unnest(range(len(citations))) AS i FROM responses WHERE trace_id IS NOT NULL) WHERE citations[i + 1] IS NOT NULL)"
_FAILED = "len(list_filter(x.calls, lambda c: c.error IS NOT NULL)) > 0"
_BATCHED = "len(list_filter(x.batches, lambda b: b IS NOT NULL)) > 0"
_CALL_STATE = f"(CASE WHEN x.error IS NULL THEN 'call' ELSE 'call_failed' END || CASE WHEN {_BATCHED} THEN '_batched' ELSE '' END)"
_SPAN_STATE = f"CASE WHEN {_FAILED} THEN 'span_with_failure' WHEN len(list_filter(x.calls, lambda c: c IS NOT NULL)) > 0 THEN 'span_with_calls' ELSE 'span' END"



def _mmr(k: int) -> str:
    """Choices one after another over the reranked hits: s holds what is left and its greatest similarity to those chosen."""
    steps = [
        f"""{_RERANK}, tt AS MATERIALIZED (SELECT rr.*, list_distinct(t.w) AS w FROM rr JOIN t USING (id)),
        j AS MATERIALIZED (SELECT a.qid, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0) AS sim FROM tt a JOIN tt b ON a.qid = b.qid AND a.id <> b.id),
        s1 AS (SELECT qid, id, position, score, 0.0::DOUBLE AS near FROM tt)"""
    ]
    for i in range(1, k + 1):
        steps.append(f"c{i} AS MATERIALIZED (SELECT qid, id FROM s{i} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.7 * score - 0.3 * near, 9) DESC, position) = 1)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT s.qid, s.id, s.position, s.score, greatest(s.near, coalesce(j.sim, 0)) AS near FROM s{i} s JOIN c{i} c ON c.qid = s.qid AND c.id <> s.id LEFT JOIN j ON j.qid = s.qid AND j.a = s.id AND j.b = c.id)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT qid, id, CAST({i} AS BIGINT) AS mmr_rank FROM c{i}" for i in range(1, k + 1))


_EST = "greatest(1, length({0}) // 4)"
#: Sentences packed up to 320 tokens, closed at 512; then pieces under 24 tokens folded into the one before.
_SENTENCE_CHUNKS = f"""WITH RECURSIVE b AS (SELECT doc_id, {_strip('text')} AS body FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, string_split(regexp_replace(body, '([.!?])({_WS}+)([A-Z0-9"''(])', concat('\\1', chr(1), '\\2', chr(2), '\\3'), 'g'), chr(1)) AS parts FROM b WHERE body <> ''),
        e AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM l),
        t AS (SELECT doc_id, n, CASE WHEN n = 1 THEN part ELSE split_part(part, chr(2), 2) END AS sentence, length(replace(part, chr(2), '')) AS chars FROM e),
        o AS MATERIALIZED (SELECT doc_id, n, sentence, sum(chars) OVER (PARTITION BY doc_id ORDER BY n) - length(sentence) AS start FROM t),
        r AS (SELECT doc_id, n, 0 AS piece, length(sentence) AS held FROM o WHERE n = 1
            UNION ALL SELECT o.doc_id, o.n, r.piece + CASE WHEN full_ THEN 1 ELSE 0 END, CASE WHEN full_ THEN length(o.sentence) ELSE r.held + 1 + length(o.sentence) END
            FROM (SELECT r.*, o.sentence AS next, greatest(1, r.held // 4) >= 512 OR greatest(1, r.held // 4) + {_EST.format("o.sentence")} > 320 AS full_ FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1) r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1),
        p AS MATERIALIZED (SELECT r.doc_id, piece, string_agg(sentence, ' ' ORDER BY r.n) AS text, min(start) AS start FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n GROUP BY ALL),
        f AS (SELECT doc_id, piece, piece AS chunk_index, {_strip('text')} AS text, start, {_EST.format('text')} AS est FROM p WHERE piece = 0
            UNION ALL SELECT doc_id, piece, CASE WHEN fold THEN chunk_index ELSE piece END, CASE WHEN fold THEN merged ELSE {_strip('next')} END, CASE WHEN fold THEN start ELSE next_start END, CASE WHEN fold THEN {_EST.format('merged')} ELSE {_EST.format('next')} END
            FROM (SELECT *, {_EST.format('next')} < 24 AND {_EST.format('merged')} <= 512 AS fold FROM (
                SELECT f.doc_id, p.piece, f.chunk_index, f.text, f.start, p.text AS next, p.start AS next_start, f.text || ' ' || p.text AS merged FROM f JOIN p ON p.doc_id = f.doc_id AND p.piece = f.piece + 1)))
        SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, arg_max(text, piece) AS text, CAST(arg_max(start, piece) AS INTEGER) AS char_start, CAST(arg_max(est, piece) AS INTEGER) AS token_estimate FROM f GROUP BY doc_id, chunk_index"""


_NUMBER = "CASE WHEN json_type({0}) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST({0} AS DOUBLE) END"
_HIT = "(hits -> ('$[' || i || ']'))"

ORACLE: dict[str, str] = {
    "tokenize_docs": f"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, coalesce(array_to_string(w[1:8], ' '), '') AS first, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS estimate
        FROM (SELECT doc_id, text, {_tok('text')} AS w FROM documents)""",
    "term_freq": f"WITH {_TF} SELECT id AS chunk_id, term, tf FROM tf",
    "doc_freq": f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "corpus_stats": f"WITH {_T} SELECT count(*) AS n, round(avg(dl), 9) AS avgdl FROM t",
    "index_stats": f"WITH {_TF} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources, (SELECT count(DISTINCT term) FROM tf) AS terms FROM c",
    "bm25_topk": f"WITH {_BM25} {_top('bs', 10)}",
    "bm25_filtered": f"WITH {_BM25}, kept AS (SELECT * FROM bs WHERE id IN (SELECT id FROM c WHERE doc_id IN (SELECT doc_key FROM documents WHERE lang = 'de'))) {_top('kept', 10)}",
    "overlap_topk": f"WITH {_T}, {_Q}, {_OVER} {_top('os', 10)}",
    "dense_topk": f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) {_top('s', 10)}",
    "dense_filtered": f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label = 3) {_top('s', 10)}",
    "l2_normalize": "SELECT vec_id, round(n, 9) AS norm, round(v[1] / n, 9) AS first, 1.0::DOUBLE AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "cosine_next": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "rrf_fusion": f"WITH {_BM25}, {_OVER}, u AS (SELECT qid, id, rank FROM ({_top('bs', 10)}) UNION ALL SELECT qid, id, rank FROM ({_top('os', 10)})) SELECT qid, id, round(sum(1 / (60 + rank)), 12) AS score FROM u GROUP BY qid, id",
    "hybrid_merge": f"WITH {_LEGS} SELECT * FROM m",
    "hybrid_dense": f"WITH {_LEGS.replace(_Q, _DENSE).replace(_OVER, _NEAR).replace(_top('os', 10), _top('ds', 10))} SELECT * FROM m",
    "rerank": f"WITH {_RERANK} SELECT qid, id, score, position FROM rr",
    "score_floor": f"WITH {_RERANK} SELECT qid, id, score, position FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM rr) WHERE best <= 0 OR score >= 0.35 * best",
    "mmr": _mmr(10),
    "stream_documents": f"SELECT doc_id, CAST(0 AS BIGINT) AS first_index FROM documents WHERE {_strip('text')} <> ''",
    "jaccard_pairs": f"""WITH {_BM25}, b AS ({_top('bs', 5)}), h AS (SELECT b.qid, b.id, list_distinct(t.w) AS w FROM b JOIN t USING (id)),
        p AS (SELECT x.qid, x.id AS id_a, y.id AS id_b, len(list_intersect(x.w, y.w)) AS n, len(x.w) AS na, len(y.w) AS nb FROM h x JOIN h y ON x.qid = y.qid AND x.id < y.id)
        SELECT qid, id_a, id_b, round(n / (na + nb - n), 9) AS jaccard FROM p""",
    "chunk_fixed": f"""WITH b AS (SELECT doc_id, {_strip('text')} AS body FROM documents), n AS (SELECT *, greatest(1, ceil((length(body) - 1280) / 1024) + 1)::INT AS n FROM b WHERE body <> ''),
        e AS (SELECT doc_id, body, unnest(range(n)) AS i FROM n), s AS (SELECT doc_id, i AS chunk_index, i * 1024 AS char_start, substring(body, i * 1024 + 1, 1280) AS text FROM e)
        SELECT * FROM s WHERE {_strip('text')} <> ''""",
    "chunk_sentence": _SENTENCE_CHUNKS,
    "sentence_split": f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+', concat('\\1', chr(1)), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)",
    "headings": rf"""SELECT doc_id, len(h) AS n, array_to_string(list_transform(h, lambda x: trim(x)), '|') AS headings FROM
        (SELECT doc_id, regexp_extract_all(regexp_replace(text, '^---([\s\S]*?)\n---{_WS}*', ''), '(?m)^#{{1,6}}\s+(.*)$', 1) AS h FROM documents WHERE text IS NOT NULL) WHERE len(h) > 0""",
    "front_matter": rf"""WITH f AS (SELECT doc_id, length(regexp_replace(text, '^---([\s\S]*?)\n---{_WS}*', '')) AS body_chars, string_split(regexp_extract(text, '^---([\s\S]*?)\n---', 1), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, body_chars, unnest(l) AS line, generate_subscripts(l, 1) AS nr FROM f),
        p AS (SELECT doc_id, body_chars, nr, trim(split_part(line, ':', 1)) AS key, regexp_replace(trim(regexp_replace(line, '^[^:]*:', '')), '^["'']+|["'']+$', '', 'g') AS value FROM e WHERE contains(line, ':') AND NOT starts_with(ltrim(line), '#'))
        SELECT doc_id, body_chars, key, arg_max(value, nr) AS value FROM p WHERE key <> '' GROUP BY ALL""",
    "html_clean": r"""SELECT doc_id, CASE WHEN t <> '' THEN t END AS title, md5(trim(regexp_replace(coalesce(source, '') || ' ' || replace(replace(text, '<', '('), '&nbsp', ' '), '\s+', ' ', 'g'))) AS digest
        FROM (SELECT *, trim(regexp_replace(coalesce(source, ''), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)""",
    "csv_fold": "SELECT c_custkey, concat_ws(chr(10), CASE WHEN c_name <> '' THEN 'c_name: ' || c_name END, 'c_nationkey: ' || c_nationkey, CASE WHEN c_mktsegment <> '' THEN 'c_mktsegment: ' || c_mktsegment END) AS body FROM customer",
    "json_fields": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events) GROUP BY event_type",
    "stable_ids": "SELECT doc_id, doc_key FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_key IS NOT NULL",
    "chunk_ids": "SELECT DISTINCT chunk_id AS stored, chunk_id FROM chunks WHERE text IS NOT NULL AND doc_id IS NOT NULL AND chunk_index IS NOT NULL",
    "feature_weights": f"""WITH {_T}, f AS (
        SELECT unnest(w) AS feature, 1.0 AS weight FROM t
        UNION ALL SELECT substring(p, i, 3), 0.35 FROM (SELECT p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT '^' || unnest(w) || '$' AS p FROM t))
        UNION ALL SELECT w[i] || '_' || w[i + 1], 0.6 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t))
        SELECT feature, count(*) AS n, round(CAST(sum(weight) AS DOUBLE), 3) AS weight FROM f GROUP BY feature""",
    "cache_misses": "SELECT DISTINCT chunk_id AS key FROM chunks WHERE chunk_id NOT IN (SELECT key FROM vectors WHERE key IS NOT NULL)",
    "cache_lookup": "SELECT model, dim, key, max(cached_at) AS cached_at FROM vectors WHERE key IN (SELECT chunk_id FROM chunks) GROUP BY ALL",
    "cache_eviction": "SELECT query, count(*) AS hits FROM traces WHERE query IS NOT NULL GROUP BY query ORDER BY hits DESC, query DESC LIMIT 200",
    "answer_sentences": f"WITH {_SENT} SELECT qid, nth, position, source, sentence, score, citation FROM z",
    "extractive_answer": f"""WITH {_SENT}, a AS (SELECT qid, string_agg(regexp_replace(sentence, '\\.+$', '') || ' [' || citation || '].', ' ' ORDER BY nth) AS answer FROM z GROUP BY qid)
        SELECT case_id AS qid, coalesce(answer, '{NO_ANSWER.replace("'", "''")}') AS answer, answer IS NOT NULL AS confident FROM eval_cases LEFT JOIN a ON a.qid = case_id""",
    "answer_stream": """WITH r AS (SELECT trace_id AS qid, max(answer) AS answer FROM responses WHERE trace_id IS NOT NULL AND answer IS NOT NULL GROUP BY trace_id)
        SELECT qid, nth, substring(answer, nth * 24 + 1, 24) AS slice FROM (SELECT qid, answer, unnest(range(CAST(greatest(1, ceil(length(answer) / 24)) AS BIGINT))) AS nth FROM r)""",
    "prompt_context": f"""WITH {_hits(10)}, b AS (SELECT qid, position, '[Context ' || position || ']' || chr(10) || 'Source: ' || coalesce(source, '') || chr(10) || text || chr(10) AS block FROM h),
        k AS (SELECT *, sum(length(block)) OVER (PARTITION BY qid ORDER BY position) <= 6000 AS kept FROM b),
        p AS (SELECT qid, coalesce(string_agg(block, '' ORDER BY position) FILTER (kept), '') AS blocks, count(*) FILTER (NOT kept) AS n FROM k GROUP BY qid)
        SELECT case_id AS qid, coalesce(blocks, '') || CASE WHEN coalesce(n, 0) > 0 THEN '[Context truncated: ' || n || ' further sources omitted]' ELSE '' END || chr(10) || 'Question: ' || query || chr(10) || chr(10) || '{INSTRUCTION}' AS prompt
        FROM eval_cases LEFT JOIN p ON p.qid = case_id""",
    "history_window": """WITH t AS (SELECT trace_id, max(client_key) AS qid, max(query) AS query, max(started_at) AS began FROM traces WHERE trace_id IS NOT NULL GROUP BY trace_id)
        SELECT qid, trace_id, query FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY began DESC, trace_id DESC) AS back FROM t) WHERE back <= 4""",
    "eval_per_query": f"WITH {_EVAL} SELECT * FROM pq",
    "eval_summary": f"WITH {_EVAL} SELECT count(*) AS cases, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(reciprocal_rank), 9) AS mrr, round(avg(ndcg), 9) AS ndcg, round(avg(hit::INT), 9) AS hit_rate FROM pq",
    "latency_percentiles": """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS nr, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, max(v) FILTER (nr = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (nr = round_even(0.95 * (n - 1), 0)) AS p95, max(v) FILTER (nr = round_even(0.99 * (n - 1), 0)) AS p99, max(v) AS most FROM r GROUP BY event_type""",
    "stage_durations": "SELECT s.name AS name, count(*) AS n, round(sum(s.ms), 3) AS ms FROM (SELECT unnest(spans) AS s FROM traces) WHERE s IS NOT NULL GROUP BY s.name",
    "dedup_chunks": "SELECT chunk_id, arg_max(doc_id, indexed_at) AS doc_id, arg_max(chunk_index, indexed_at) AS chunk_index, max(indexed_at) AS indexed_at FROM chunks GROUP BY chunk_id",
    "label_recall": f"""WITH {_hits(8)}, l AS (SELECT DISTINCT case_id AS qid, unnest(relevant) AS label FROM eval_cases), m AS (SELECT qid, label FROM l WHERE label <> ''),
        f AS (SELECT m.qid, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.qid = m.qid AND contains(lower(coalesce(source, '')), lower(label)))) AS found FROM m GROUP BY m.qid)
        SELECT case_id AS qid, round(coalesce(found / n, 0), 9) AS label_recall FROM eval_cases LEFT JOIN f ON f.qid = case_id""",
    "dedupe_text": f"WITH {_C} SELECT min(id) AS chunk_id FROM c WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT id FROM c WHERE text IS NULL",
    "replace_source": f"""WITH {_C}, n AS (SELECT source, 'new ' || min(doc_id) AS chunk_id FROM documents WHERE lang = 'de' AND source IS NOT NULL GROUP BY source)
        SELECT id AS chunk_id, source FROM c WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM n) UNION ALL SELECT chunk_id, source FROM n""",
    "upsert_chunks": f"WITH {_C} SELECT id AS chunk_id, CASE WHEN id >= '8' THEN 'again' ELSE source END AS source FROM c",
    "delete_documents": f"WITH {_C} SELECT id AS chunk_id, doc_id FROM c WHERE doc_id NOT IN (SELECT doc_key FROM documents WHERE lang = 'fr' AND doc_key IS NOT NULL)",
    "get_many": f"WITH {_C}, w AS (SELECT DISTINCT trace_id, i AS ord, citations[i + 1].chunk_id AS chunk_id FROM (SELECT trace_id, citations, unnest(range(len(citations))) AS i FROM responses) WHERE citations[i + 1] IS NOT NULL) SELECT w.trace_id, w.ord, w.chunk_id, c.source FROM w JOIN c ON c.id = w.chunk_id",
    "metadata_keys": "SELECT e.key AS key, count(*) AS n, count(DISTINCT e.value) AS n_values FROM (SELECT unnest(map_entries(metadata)) AS e FROM documents) GROUP BY e.key",
    "metadata_filter": """SELECT doc_id FROM documents WHERE metadata['ext'] = '".md"' AND (metadata['row'] IS NULL OR metadata['row'] = 'null')""",
    "unknown_filter_keys": "SELECT DISTINCT key FROM (SELECT unnest(map_keys(metadata)) AS key FROM eval_cases) WHERE key NOT IN (SELECT unnest(map_keys(metadata)) FROM documents)",
    "save_load_roundtrip": "SELECT DISTINCT chunk_id, CAST(256 AS BIGINT) AS n FROM chunks",
    "token_bucket": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        b AS (SELECT key, id, s, n, 3.0::DOUBLE AS tokens FROM e WHERE n = 1
        UNION ALL SELECT e.key, e.id, e.s, e.n, least(3.0, b.tokens - CASE WHEN b.tokens >= 1 THEN 1 ELSE 0 END + (e.s - b.s) / 3600) FROM b JOIN e ON e.key = b.key AND e.n = b.n + 1)
        SELECT key, id, tokens >= 1 AS admitted FROM b""",
    "p3_found": f"""WITH {_BATCHES}, {_LEGNODES}, {_CIT}
        SELECT trace_id, 'span' AS node_kind, i || '' AS node_path FROM sp UNION SELECT trace_id, 'call', i || '.' || j FROM ca UNION SELECT trace_id, 'batch', i || '.' || j || '.' || k FROM ba
        UNION SELECT trace_id, 'leg', name FROM lo UNION SELECT trace_id, 'leg_hit', name || '.' || i FROM lh WHERE json_type(hits -> ('$[' || i || ']')) <> 'NULL' UNION SELECT trace_id, 'citation', i || '' FROM ci""",
    "p3_traces": """SELECT trace_id, emissions, v.* FROM (SELECT trace_id, count(*) AS emissions,
        arg_max(struct_pack(arrived_at := arrived_at, started_at := started_at, client_key := client_key, query := query, total_ms := total_ms), arrived_at) AS v FROM traces WHERE trace_id IS NOT NULL GROUP BY trace_id)""",
    "p3_spans": f"""WITH {_SPANS} SELECT trace_id, 'span' AS node_kind, i || '' AS node_path, CAST(NULL AS VARCHAR) AS parent_path, v.* FROM (
        SELECT trace_id, i, arg_max(struct_pack(state := {_SPAN_STATE}, name := x.name, ms := x.ms, meta := list_sort(list_transform(map_entries(x.meta), lambda e: e.key || '=' || coalesce(e.value, ''))), n_calls := coalesce(len(x.calls), 0)), arrived_at) AS v FROM sp GROUP BY ALL)""",
    "p3_legs": f"""WITH {_LEGNODES} SELECT trace_id, 'leg' AS node_kind, name AS node_path, CAST(NULL AS VARCHAR) AS parent_path, v.* FROM (
        SELECT trace_id, name, arg_max(struct_pack(state := CASE WHEN json_exists(leg, '$.leg') THEN 'leg' ELSE 'body' END, ms := {_NUMBER.format("(leg -> '$.ms')")},
            n_hits := CAST(CASE json_type(leg -> '$.hits') WHEN 'ARRAY' THEN len(list_filter(CAST(leg -> '$.hits' AS JSON[]), lambda h: json_type(h) <> 'NULL')) WHEN 'OBJECT' THEN 1 ELSE 0 END AS BIGINT)), arrived_at) AS v FROM lo GROUP BY ALL)""",
    "p3_leg_hits": f"""WITH {_LEGNODES} SELECT trace_id, 'leg_hit' AS node_kind, name || '.' || i AS node_path, name AS parent_path, v.* FROM (
        SELECT trace_id, name, i, arg_max(struct_pack(state := 'hit', chunk_id := CASE WHEN json_type({_HIT} -> '$.chunk_id') = 'VARCHAR' THEN {_HIT} ->> '$.chunk_id' END,
            rank := {_NUMBER.format("(" + _HIT + " -> '$.rank')")}, score := {_NUMBER.format("(" + _HIT + " -> '$.score')")},
            tags := CASE WHEN json_type({_HIT} -> '$.tags') = 'ARRAY' THEN list_transform(list_filter(CAST({_HIT} -> '$.tags' AS JSON[]), lambda t: json_type(t) = 'VARCHAR'), lambda t: t ->> '$') END), arrived_at) AS v
        FROM lh WHERE json_type({_HIT}) <> 'NULL' GROUP BY ALL)""",
    "p3_failed_calls": f"""WITH {_CALLS} SELECT trace_id, 'call' AS node_kind, i || '.' || j AS node_path, i || '' AS parent_path, v.* FROM (
        SELECT trace_id, i, j, arg_max(struct_pack(state := {_CALL_STATE}, provider := x.provider, attempt := CAST(x.attempt AS BIGINT), ms := x.ms, error_code := CAST(x.error.code AS BIGINT), error_message := x.error.message), arrived_at) AS v FROM ca GROUP BY ALL) WHERE v.state = 'call_failed'""",
    "p3_calls": f"""WITH {_CALLS} SELECT trace_id, 'call' AS node_kind, i || '.' || j AS node_path, i || '' AS parent_path, v.* FROM (
        SELECT trace_id, i, j, arg_max(struct_pack(state := {_CALL_STATE}, provider := x.provider, attempt := CAST(x.attempt AS BIGINT), ms := x.ms, error_code := CAST(x.error.code AS BIGINT), error_message := x.error.message), arrived_at) AS v FROM ca GROUP BY ALL)""",
    "p3_batches": f"""WITH {_BATCHES} SELECT trace_id, 'batch' AS node_kind, i || '.' || j || '.' || k AS node_path, i || '.' || j AS parent_path, v.* FROM (
        SELECT trace_id, i, j, k, arg_max(struct_pack(state := CASE WHEN x.cached IS NULL THEN 'batch' ELSE 'batch_cached' END, batch_size := CAST(x.batch_size AS BIGINT), cached := CAST(x.cached AS BIGINT)), arrived_at) AS v FROM ba GROUP BY ALL)""",
    "p3_citations": f"""WITH {_CIT} SELECT trace_id, 'citation' AS node_kind, i || '' AS node_path, CAST(NULL AS VARCHAR) AS parent_path, v.* FROM (
        SELECT trace_id, i, arg_max(struct_pack(state := CASE WHEN len(x.retrieved_by) > 1 THEN 'citation_both' WHEN len(x.retrieved_by) = 1 THEN 'citation_one' ELSE 'citation' END, idx := CAST(x.idx AS BIGINT), chunk_id := x.chunk_id, source := x.source, text := x.text, score := x.score, retrieved_by := x.retrieved_by), arrived_at) AS v FROM ci GROUP BY ALL)""",
    "p3_variants": f"""WITH {_BATCHES}, {_LEGNODES}, {_CIT}, a AS (
        SELECT 'span' AS node_kind, {_SPAN_STATE} AS state FROM sp UNION ALL SELECT 'call', {_CALL_STATE} FROM ca UNION ALL SELECT 'batch', CASE WHEN x.cached IS NULL THEN 'batch' ELSE 'batch_cached' END FROM ba
        UNION ALL SELECT 'leg', CASE WHEN json_exists(leg, '$.leg') THEN 'leg' ELSE 'body' END FROM lo
        UNION ALL SELECT 'leg_hit', 'hit' FROM lh WHERE json_type(hits -> ('$[' || i || ']')) <> 'NULL'
        UNION ALL SELECT 'citation', CASE WHEN len(x.retrieved_by) > 1 THEN 'citation_both' WHEN len(x.retrieved_by) = 1 THEN 'citation_one' ELSE 'citation' END FROM ci)
        SELECT node_kind, state, count(*) AS nodes FROM a GROUP BY ALL""",
}
