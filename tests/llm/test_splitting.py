import random

from gleaner.llm import splitting


def check(text, limit, overlap):
    p = splitting.pieces(text, limit, overlap)
    spans = list(zip(p[::2], p[1::2]))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(b - overlap - overlap // 4 <= c <= b - overlap and c > a and d > b for (a, b), (c, d) in zip(spans, spans[1:]))
    return spans


def test_pieces_cover_and_overlap():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", ". ", "\n", "\n\n", "é", "# ", "\n## x", "。", "\t"]) for _ in range(rng.randint(60, 1500)))
        check(text, 51, 12)
    check("x" * 5000, 2051, 256)
    check("\u0301" * 5000, 2051, 256)
    check("é" * 3000, 2051, 256)


def test_natural_boundaries():
    text = "Intro sentence one. Intro two.\n\nSecond paragraph here.\n\n" + "# Title\n" + "Long words follow here. " * 6
    cuts = [b for _, b in check(text, 80, 10)]
    assert all(text[b - 1].isspace() or b == len(text) for b in cuts)
    assert text.index("# Title") in cuts  # before a heading
    marked = "e\u0301" * 100
    assert all(not marked[b:].startswith("\u0301") for _, b in check(marked, 51, 10))  # a mark never leaves its letter
    assert all(not marked[a:].startswith("\u0301") for a, _ in check(marked, 51, 10))
    words = "some words of up to nine letters " * 40
    assert all(a == 0 or words[a - 1] == " " for a, _ in check(words, 200, 48))  # pieces begin with whole words


def test_table(spark, cluttered):
    chunks = spark.createDataFrame([("c1", "word " * 600), ("c1", "word " * 600), ("c2", "short"), ("c3", None), ("c4", ""), (None, "y" * 4000)], "chunk_id string, text string")
    docs = spark.createDataFrame([(1, "x" * 2052), (2, "x" * 2051), (3, None), (4, "ж" * 100000)], "doc_id long, text string")
    out = splitting.split_oversized(splitting.items(cluttered(chunks), cluttered(docs)))
    rows = out.collect()
    assert {(r.item_kind, r.item_key) for r in rows} == {("chunk", "c1"), ("chunk", None), ("document", "1"), ("document", "4")}
    source = {"c1": "word " * 600, None: "y" * 4000, "1": "x" * 2052, "4": "ж" * 100000}
    for r in rows:
        assert r.text == source[r.item_key][r.char_start : r.char_end] and r.token_estimate == max(1, len(r.text) // 4) <= 512
    for key in source:
        mine = sorted(r.piece_index for r in rows if r.item_key == key)
        shared = [(a.char_end - b.char_start) // 4 for a, b in zip(*(sorted((r for r in rows if r.item_key == key), key=lambda r: r.piece_index)[i:] for i in (0, 1)))]
        assert all(64 <= n < 81 for n in shared)
        assert mine == list(range(len(mine)))


def test_offsets_in_the_document(spark, cluttered):
    from gleaner.llm import queries

    rng = random.Random(4)
    whole = "é\U0001f600 " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))
    twice = "".join(rng.choice("abc déf\n") for _ in range(2100)) * 2
    docs = spark.createDataFrame([(1, whole, "k1"), (2, whole, "k1"), (3, twice, "k2"), (4, None, "k3")], "doc_id long, text string, doc_key string")
    rows = [
        ("wrong", whole[700:3700], "k1", 5), ("null", whole[41:3000], "k1", None), ("wrong", whole[700:3700], "k1", None), ("below", whole[1:3000], "k1", -1),
        ("second", twice[2100:], "k2", 2100), ("first", twice[2100:], "k2", 3), ("gone", whole[:2500], "k9", 0), ("other", "z" * 2500, "k1", 0), ("empty", "z" * 2500, "k3", 0), ("keyless", whole[:2500], None, 0), (None, whole[:2500], "k1", 0),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, doc_id string, char_start int")
    chunks, docs = cluttered(chunks), cluttered(docs)
    out = splitting.placed(splitting.split_oversized(splitting.items(chunks, docs)), chunks, docs).collect()
    starts = {"wrong": 700, "null": 41, "below": 1, "second": 2100, "first": 0, "1": 0, "2": 0, "3": 0}
    assert {r.item_key for r in out} == starts.keys() | {"gone", "other", "empty", "keyless", None}
    for r in out:
        assert r.doc_start == (starts[r.item_key] + r.char_start if r.item_key in starts else None)
        if r.doc_start is not None:
            source = twice if r.item_key in ("second", "first", "3") else whole
            assert source[r.doc_start : r.doc_start + len(r.text)] == r.text
    assert "doc_start" in queries.p2_pieces(spark, "/root/testdata/sf0.001").columns


def test_empty(spark):
    e = spark.createDataFrame([], "item_kind string, item_key string, text string")
    assert splitting.split_oversized(e).count() == 0


def test_put_together_again(spark):
    import hashlib

    rng = random.Random(9)
    texts = {str(i): "".join(rng.choice(["a", "bcd ", ". ", "\n\n", "é", "e\u0301", "\U0001f600", "# x\n"]) for _ in range(2500)) for i in range(12)}
    items = spark.createDataFrame([("document", k, t) for k, t in texts.items()], "item_kind string, item_key string, text string")
    got = {r.item_key: (r.digest, r.within) for r in splitting.reassembled(splitting.split_oversized(items)).collect()}
    assert got == {k: (hashlib.md5(t.encode()).hexdigest(), True) for k, t in texts.items() if len(t) // 4 > 512}
