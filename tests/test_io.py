import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import embed, store
from gleaner.pipeline import Engine
from gleaner.settings import RetrievalSettings
from gleaner.sources import loaders
from gleaner.streaming import ingest, ratelimit


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / ".hidden").mkdir()
    (d / "a.md").write_text("---\ntitle: Auth\nowner: ops\n---\n# Tokens\nTokens expire hourly and refresh tokens rotate.")
    (d / "b.html").write_text("<title>Page</title><script>no</script><p>Rollback &amp; release</p>")
    (d / "c.jsonl").write_text('{"k": "v", "n": {"x": [1]}}\n\nbroken\n"plain string"\n')
    (d / "d.json").write_text('[{"a": 1}, "two", ""]')
    (d / "e.csv").write_text('name,role\nAlice,"Dev, ops"\nBob,\n,\n')
    (d / "sub" / "f.txt").write_bytes("caf\xe9".encode("latin-1"))
    (d / "g.bin").write_bytes(b"skip")
    (d / "h.json").write_text("{broken")
    (d / ".hidden" / "i.txt").write_text("hidden")
    return d


def test_loaders(spark, folder):
    rows = {r.source.replace(str(folder), ""): r for r in loaders.load(spark, str(folder)).collect()}
    assert set(rows) == {"/a.md", "/b.html", "/c.jsonl::0", "/c.jsonl::3", "/d.json::0", "/d.json::1", "/e.csv::row0", "/e.csv::row1", "/sub/f.txt"}
    assert rows["/a.md"].text.startswith("# Tokens") and json.loads(rows["/a.md"].metadata["title"]) == "Auth" and json.loads(rows["/a.md"].metadata["headings"]) == ["Tokens"]
    assert rows["/b.html"].text == "Page Rollback & release" and rows["/c.jsonl::0"].text == 'k: v\nn: {"x": [1]}'
    assert rows["/e.csv::row0"].text == "name: Alice\nrole: Dev, ops" and rows["/e.csv::row1"].text == "name: Bob" and rows["/sub/f.txt"].text == "café"
    assert loaders.load(spark, str(folder), recursive=False).where("source like '%f.txt'").count() == 0
    assert [r.source.rpartition("/")[2] for r in loaders.load(spark, str(folder), limit=4).collect()] == ["a.md", "b.html", "c.jsonl::0", "c.jsonl::3"]
    assert json.loads(rows["/b.html"].metadata["title"]) == "Page" and rows["/e.csv::row1"].metadata == {"row": "1"}
    assert loaders.load(spark, str(folder / "g.bin")).first().text == "skip"
    with pytest.raises(FileNotFoundError):
        loaders.load(spark, str(folder / "none"))
    with pytest.raises(ValueError):
        loaders.records("{", ".json")
    with pytest.raises(Exception, match="can't be read as .json"):
        loaders.load(spark, str(folder), strict=True).collect()


def test_cases_and_filters(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"query": "q1", "relevant": ["a"], "name": "n"}\n{"query": "q2", "relevant": []}\n')
    assert [r.query for r in loaders.load_cases(spark, str(tmp_path / "cases.jsonl")).collect()] == ["q1", "q2"]
    (tmp_path / "bad.jsonl").write_text('{"relevant": ["a"]}\n')
    with pytest.raises(Exception):
        loaders.load_cases(spark, str(tmp_path / "bad.jsonl")).collect()
    m = spark.createDataFrame([(1, {"row": "3", "ext": '".md"'}), (2, {"row": '"3"'}), (3, {"row": "3.0"}), (4, {"ext": "null"}), (5, None)], "i long, metadata map<string,string>")
    pick = lambda f: [r.i for r in m.where(loaders.matches("metadata", f)).collect()]
    assert pick({"row": 3}) == [1, 3] and pick({"row": "3"}) == [2] and pick({"ext": None}) == [2, 3, 4, 5] and pick({"ext": ".md", "row": 3.0}) == [1] and pick({}) == [1, 2, 3, 4, 5]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d1", [1.0, 0.0]), ("b", "d2", [0.0, 1.0])], "chunk_id string, doc_id string, vec array<float>")
    path = str(tmp_path / "index")
    assert store.save(rows, path, "vec", 2, "hashing")["count"] == 2
    assert {tuple(r) for r in store.load(spark, path, 2, "hashing").select("chunk_id", "doc_id").collect()} == {("a", "d1"), ("b", "d2")}
    for wrong in ({"dim": 3}, {"embedder": "other"}):
        with pytest.raises(ValueError):
            store.load(spark, path, **wrong)
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "nothing"))
    read = lambda: {r.chunk_id for r in store.load(spark, path, 2, "hashing").collect()}
    with pytest.raises(Exception):
        store.save(rows, path, "vec", 3, "hashing")  # a save that fails leaves the index as it was
    assert read() == {"a", "b"}
    store.save(store.load(spark, path), path, "vec", 2, "hashing")  # unchanged, to where it came from
    assert read() == {"a", "b"}
    store.save(store.load(spark, path).where("chunk_id = 'a'"), path, "vec", 2, "hashing")
    assert read() == {"a"}
    store.save(store.upsert(store.load(spark, path), rows.where("chunk_id = 'b'"), "chunk_id"), path, "vec", 2, "hashing")
    assert read() == {"a", "b"}
    newest = store.manifest_of(spark, path)["number"]
    spark.createDataFrame([("x", "d1", [1.0, 0.0]), ("y", "d2", [0.0, 1.0])], rows.schema).write.mode("overwrite").parquet(f"{path}/snapshots/{newest}")
    with pytest.raises(ValueError, match="digest"):
        store.load(spark, path)
    same = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None), ("d", "u")], "chunk_id string, text string")
    assert {r.chunk_id for r in store.dedupe_on_text(same, "chunk_id").collect()} == {"a", "c", "d"}
    new = spark.createDataFrame([("b", "d3", [1.0, 1.0]), ("c", "d3", [1.0, 1.0])], rows.schema)
    up = store.upsert(rows, new, "chunk_id")
    assert {(r.chunk_id, r.doc_id) for r in up.collect()} == {("a", "d1"), ("b", "d3"), ("c", "d3")}
    assert {r.chunk_id for r in store.delete(up, new.select("doc_id"), "doc_id").collect()} == {"a"}
    order = spark.createDataFrame([("c", 0), ("a", 1), ("zz", 2)], "chunk_id string, ord long")
    assert [r.chunk_id for r in store.get_many(up, order, "chunk_id").orderBy("ord").collect()] == ["c", "a"]


def test_embedder_and_cache(spark):
    e = embed.HashingEmbedder(64)
    m = e.embed_batch(["token refresh", "", None, "the of"])
    assert abs((m[0] ** 2).sum() - 1) < 1e-9 and not m[1:].any() and (e.embed_batch(["token refresh"]) == m[0]).all()
    rows = embed.embed(spark.createDataFrame([("a", "token refresh"), ("b", None)], "id string, text string"), lambda: embed.HashingEmbedder(64)).orderBy("id").collect()
    assert max(abs(x - y) for x, y in zip(rows[0].vec, m[0])) < 1e-6 and len(rows[1].vec) == 64
    t0 = datetime(2024, 1, 1)
    cache = spark.createDataFrame([("m", "a", 1, t0), ("m", "a", 2, t0 + timedelta(1)), ("m", "b", 3, None)], "model string, key string, v int, cached_at timestamp_ntz")
    wanted = spark.createDataFrame([("m", "a"), ("m", "x"), ("m", "x")], "model string, key string")
    assert [(r.key, r.v) for r in embed.cache_hits(wanted, cache, ["model", "key"]).collect()] == [("a", 2)]
    assert [r.key for r in embed.cache_misses(wanted, cache, ["model", "key"]).collect()] == ["x"]
    new = spark.createDataFrame([("m", "b", 9, t0)], cache.schema)
    assert {(r.key, r.v) for r in embed.cache_put(cache, new, ["model", "key"]).collect()} == {("a", 1), ("a", 2), ("b", 9)}
    hits = spark.createDataFrame([("x", 1, 1), ("y", 5, 2), ("z", 1, 3)], "k string, hits int, seq int")
    assert {r.k for r in embed.evict(hits, 2, "hits", "seq").collect()} == {"y", "z"}


def test_tables_of_a_session_can_be_dropped(spark):
    import os

    from gleaner import runtime

    runtime.drop_tables(spark)
    t = runtime.table_in_shared_dir(spark.range(5), "some")
    folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert t.count() == 5 and os.path.isdir(folder)
    assert runtime.drop_tables(spark) == 1 and not os.path.exists(folder) and runtime.drop_tables(spark) == 0


def test_made_up_documents(spark):
    from gleaner.sources import synthetic

    a, b = (synthetic.corpus(spark, 20, seed).orderBy("source").collect() for seed in (7, 8))
    assert a == synthetic.corpus(spark, 20, 7).repartition(3).orderBy("source").collect() and a != b
    sentences = [r.text.count(".") for r in a]
    assert len({r.doc_id for r in a}) == 20 and min(sentences) >= 8 and max(sentences) <= 20 and any("\n\n" in r.text for r in a)


def test_other_providers(tmp_path):
    import numpy as np

    states, mask = np.arange(12, dtype=float).reshape(2, 3, 2), np.array([[1, 1, 0], [0, 0, 0]])
    pooled = embed.mean_pooled(states, mask)
    assert np.allclose(pooled[0], np.array([1.0, 2.0]) / np.sqrt(5)) and not pooled[1].any()
    with pytest.raises(FileNotFoundError, match="model.onnx"):
        embed.OnnxEmbedder(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), 8)
    calls = []

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("busy")
        return [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(texts)))]

    remote = embed.RemoteEmbedder(call, "m", 2, batch=2)
    assert remote.embed_batch(["a", "bbb", "cc"]).tolist() == [[1.0, 0.0], [3.0, 0.0], [2.0, 0.0]] and calls == [2, 2, 1]
    embed.preflight(remote)
    with pytest.raises(ValueError):
        embed.preflight(embed.RemoteEmbedder(lambda t: [(5, [1.0, 2.0])], "m", 2))


def bucket(times, rate, burst):
    tokens, last, out = burst, None, []
    for t in times:
        tokens = burst if last is None else min(burst, tokens + (t - last) * rate)
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out


def test_token_bucket(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=s), i) for i, (k, s) in enumerate([("a", 0), ("a", 0), ("a", 0), ("a", 0), ("b", 1), ("a", 10), ("a", 10.5), ("a", 11)])]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id int")
    got = {r.id: r.admitted for r in ratelimit.admit(df, 0.1, 3.0).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 5, 6, 7)] == bucket([0, 0, 0, 0, 10, 10.5, 11], 0.1, 3.0) and got[4]
    assert {r.key: (r.requests, r.admitted) for r in ratelimit.admitted_counts(ratelimit.admit(df, 0.1, 3.0)).collect()} == {"a": (7, 4), "b": (1, 1)}


def test_token_bucket_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "key string, ts timestamp_ntz, id int"
    source = str(tmp_path / "in")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = ratelimit.admit_stream(spark.readStream.schema(schema).parquet(source), 0.1, 3.0)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        if not q.awaitTermination(60):
            q.stop()
            raise AssertionError("the stream didn't end")

    spark.createDataFrame([("a", start, i) for i in range(4)], schema).write.parquet(source)
    run()
    spark.createDataFrame([("a", start + timedelta(seconds=10), 9), ("b", start, 5)], schema).write.mode("append").parquet(source)
    run()
    assert {r.id: r.admitted for r in spark.read.parquet(out).collect()} == {0: True, 1: True, 2: True, 3: False, 9: True, 5: True}


def test_ingest_is_incremental(spark, tmp_path):
    source, index, ck = (str(tmp_path / n) for n in ("in", "index", "ck"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "first document " * 10), (2, None)], schema).write.parquet(source)
    ingest.ingest_available(spark, source, schema, index, ck)
    spark.createDataFrame([(1, "first document " * 10), (3, "third document " * 10)], schema).write.mode("append").parquet(source)
    ingest.ingest_available(spark, source, schema, index, ck)
    ingest.ingest_available(spark, source, schema, index, ck)
    assert sorted(r.doc_id for r in ingest.indexed(spark, index).collect()) == [1, 3]
    spark.createDataFrame([(1, "the first document was edited " * 5), (3, None)], schema).write.mode("append").parquet(source)
    ingest.ingest_available(spark, source, schema, index, ck)
    assert [(r.doc_id, r.text[:9]) for r in ingest.indexed(spark, index).collect()] == [(1, "the first")]


def test_engine(spark, folder, tmp_path):
    e = Engine(spark)
    with pytest.raises(ValueError):
        e.stats()
    e.cache = embed.CacheTable(spark, str(tmp_path / "cache"))
    assert e.cache.count() == 0
    counts = e.index_path(str(folder))
    first = e.stats()
    assert counts == {"documents": 9, "chunks": first["chunks"], "embedded": first["chunks"], "skipped": 0}
    assert e.index_path(str(folder))["embedded"] == 0  # all texts are in the cache
    assert e.stats() == first  # the same files again change nothing
    assert e.cache.count() == first["chunks"]
    e.cache.clear()
    assert e.cache.count() == 0
    assert e.ready()["status"] == "ok" and Engine(spark).ready()["status"] == "failing"
    with pytest.raises(ValueError, match="odd"):
        e.check_filters({"ext": ".md", "odd": 1})
    q = e.questions(["When do refresh tokens rotate?", "rollback release", "zebra crossing"])
    plain = [tuple(r) for r in e.retrieve(q).orderBy("qid", "position").collect()]
    e.save(str(tmp_path / "i"))
    e = Engine(spark)
    e.load(str(tmp_path / "i"))
    assert e.postings is not None  # the postings came with the snapshot
    stored = [tuple(r) for r in e.retrieve(q).orderBy("qid", "position").collect()]
    assert stored == plain and plain[0][5].endswith("a.md")
    a = {r.qid: r for r in e.answer(q).collect()}
    assert a[0].confident and "[1]" in a[0].answer and a[0].citations[0].source.endswith("a.md")
    only = e.retrieve(q, filters={"ext": ".html"}).select("source").distinct().collect()
    assert [r.source.rsplit("/", 1)[1] for r in only] == ["b.html"]
    cases = q.limit(2).withColumn("relevant", F.when(F.col("qid") == 0, F.array(F.lit("A.md"))).otherwise(F.array(F.lit("b.html"))))
    rows, mean = e.evaluate(cases)
    assert mean.first().mrr == 1.0 and mean.first().hit_rate == 1.0
    (folder / "a.md").write_text("# Tokens\nTokens never expire now.")
    edited = Engine(spark, replace_source=True, index=e.index)
    edited.index_path(str(folder / "a.md"))
    assert [r.text for r in edited.index.where("source like '%a.md'").collect()] == ["# Tokens\nTokens never expire now."]
    gone = e.index.where("source like '%a.md'").select("doc_id")
    e.delete_documents(gone)
    assert e.stats()["documents"] == first["documents"] - 1
    for bad in ("", "x" * 2001):
        with pytest.raises(ValueError):
            e.questions([bad])


def test_settings():
    s = RetrievalSettings.from_env({"GLEANER_TOP_K": "5", "GLEANER_RERANK": "off", "GLEANER_FLOOR": "much"}, candidates=20)
    assert (s.top_k, s.rerank, s.floor, s.candidates) == (5, False, 0.35, 20)
    for bad in ({"top_k": 0}, {"floor": 2}, {"dense_weight": -1}):
        with pytest.raises(ValueError):
            RetrievalSettings(**bad)
