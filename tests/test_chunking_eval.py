import pytest

from gleaner.operators import answer, chunking, evaluate
from gleaner.operators.chunking import ChunkSettings


def test_sizes_and_offsets():
    s = ChunkSettings(target=50, overlap=10, hard=100, least=5)
    chunks = chunking.chunk_text("word " * 600, s)
    assert chunks and all(chunking.estimate(t) <= 100 for _, t, _, _ in chunks)
    assert chunking.chunk_text("  \n ", s) == [] and chunking.chunk_text(None, s) == []
    assert chunking.chunk_text("short", s) == [(0, "short", 0, 1)]


def test_recursive_by_hand():
    s = ChunkSettings(target=2, overlap=0, hard=4, least=0)  # 8 characters
    assert chunking.recursive_pieces("aaaa. bbbb. cc", s) == [("aaaa. ", 0), ("bbbb. ", 6), ("cc\n. ", 12)]  # separators of three levels
    assert chunking.recursive_pieces("x" * 20, s, 0, 8) == [("x" * 8, 0), ("x" * 8, 8), ("x" * 4, 16)]
    o = ChunkSettings(target=2, overlap=1, hard=4, least=0)
    assert chunking.recursive_pieces("aaaa. bbbb. cc", o, 0, 2)[1] == ("aa. bbbb. ", 2)
    assert chunking.recursive_pieces("aaaa. bbbb. cc", o)[1] == ("aa. aa. aa. bbbb", -6)  # once at each of three levels, then cut


def test_fold_of_a_tiny_tail():
    s = ChunkSettings(target=40, overlap=0, hard=100, least=10)
    text = "A" * 100 + ". " + "B" * 100 + ". tiny"
    out = chunking.chunk_text(text, s)
    assert "tiny" in out[-1][1]
    assert all(chunking.estimate(t) >= 10 for _, t, _, _ in out)


def test_sentences_stay_whole():
    s = ChunkSettings("sentence", target=10, overlap=0, hard=20, least=0)
    out = chunking.chunk_text("One sentence here. Another sentence follows. Dr. Smith too! Yes?", s)
    assert " ".join(t for _, t, _, _ in out) == "One sentence here. Another sentence follows. Dr. Smith too! Yes?"


def test_fixed_native_and_python_agree(spark):
    docs = [(1, " " + "abc def " * 500), (2, "x"), (3, None), (4, "  "), (5, "é" * 1281)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    native = {(r.doc_id, r.chunk_index, r.char_start, r.text) for r in chunking.fixed_windows(df, 320, 64).collect()}
    want = {(i, j, b, t) for i, x in docs if x and x.strip() for j, (t, b) in enumerate(chunking.window_pieces(x.strip(), ChunkSettings("fixed")))}
    assert native == want
    rows = chunking.chunk_documents(df, ChunkSettings("fixed", least=0)).collect()
    assert len(rows) == len(want) and len({r.chunk_id for r in rows}) == len(rows)


def test_settings_are_checked():
    for bad in ({"target": 0}, {"overlap": 400}, {"overlap": -1}, {"hard": 0}):
        with pytest.raises(ValueError):
            ChunkSettings(**bad)


def test_metrics_golden(spark):
    flags = [True, False, True, False, True]
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate(flags, 1)], "qid long, rank long, relevant boolean")
    cases = spark.createDataFrame([(1,), (2,)], "qid long")
    at3, at5 = ({r.qid: r for r in evaluate.per_query(f, cases, k).collect()} for k in (3, 5))
    assert at3[1].recall == round(2 / 3, 9) and at5[1].precision == 0.6 and at3[1].reciprocal_rank == 1.0
    assert abs(at3[1].ndcg - 0.7039180890341347) < 1e-8 and abs(at5[1].ndcg - 0.8854598815714874) < 1e-8
    assert tuple(at3[2])[1:] == (0.0, 0.0, 0.0, 0.0, False)
    s = evaluate.summary(evaluate.per_query(f, cases, 3)).first()
    assert s.cases == 2 and s.hit_rate == 0.5 and s.mrr == 0.5
    with pytest.raises(ValueError):
        evaluate.per_query(f, cases, 0)


def test_relevance(spark):
    rows = [("docs/Auth.md", ["auth.md"]), ("docs/a.md", ["b.md", None]), (None, ["a"]), ("a", [""]), ("a", None)]
    df = spark.createDataFrame(rows, "source string, labels array<string>")
    assert [r[0] for r in df.select(evaluate.is_relevant("source", "labels")).collect()] == [True, False, False, False, False]


def test_answers(spark):
    q = spark.createDataFrame([(1, "rollback release"), (2, "the of"), (3, "nothing here matches zebra")], "qid long, query string")
    h = spark.createDataFrame([(1, 1, "b.md", "A rollback restores the release. Too short. Unrelated words stand in here."), (1, 2, "a.md", "Release notes mention\nthe rollback.... Another release goes out."), (3, 1, "c", "Sentences without any shared term.")], "qid long, position long, source string, text string")
    got = {r.qid: r for r in answer.extractive_answers(q, h).collect()}
    assert got[2].answer == got[3].answer == answer.NO_ANSWER and not got[2].confident
    assert got[1].answer == "A rollback restores the release [1]. Release notes mention the rollback [2]. Another release goes out [2]." and got[1].confident
    assert {r.citation for r in answer.answer_sentences(q, h).where("source = 'a.md'").collect()} == {2}
    p = answer.prompts(q, h, budget=100).collect()
    one = next(r for r in p if r.qid == 1).messages[1].content
    assert "[Context 1]" in one and "[Context truncated: 1 further sources omitted]" in one and one.endswith(answer.INSTRUCTION)
    past = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(7)], "qid long, turn long, role string, text string")
    said = next(r for r in answer.prompts(q, h, history=past).collect() if r.qid == 1).messages[1].content
    assert said.startswith("Conversation so far:\nUser: turn 3\nAssistant: turn 4\nUser: turn 5\nAssistant: turn 6\n")
    slices = answer.answer_slices(spark.createDataFrame([(1, "x" * 50), (2, "")], "qid long, answer string")).collect()
    assert [len(r.slice) for r in sorted(slices, key=lambda r: (r.qid, r.nth))] == [24, 24, 2, 0]
