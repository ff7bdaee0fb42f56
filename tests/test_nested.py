import json

from gleaner.operators import nested

TRACE = "trace_id string, arrived_at timestamp_ntz, spans array<struct<name:string,ms:double,meta:map<string,string>,calls:array<struct<provider:string,attempt:int,ms:double,error:struct<code:int,message:string>,batches:array<struct<batch_size:int,cached:int>>>>>>, meta string"
RESPONSE = "trace_id string, created_at timestamp_ntz, citations array<struct<idx:int,chunk_id:string,source:string,text:string,score:double,retrieved_by:array<string>>>"


def legs_of(value):
    return [(n["node_kind"], n["node_path"], n["state"]) for n in nested.legs(value if value is None or isinstance(value, str) else json.dumps(value))]


def test_variants_of_legs():
    hit = {"chunk_id": "a", "rank": 1, "score": 0.5}
    assert legs_of({"legs": [{"leg": "dense", "hits": [hit, None, hit]}, None, {"leg": "sparse", "hits": hit}, {"leg": "third"}]}) == [
        ("leg", "dense", "leg"), ("leg_hit", "dense.0", "hit"), ("leg_hit", "dense.2", "hit"), ("leg", "sparse", "leg"), ("leg_hit", "sparse.0", "hit"), ("leg", "third", "leg"),
    ]
    assert legs_of({"legs": {"leg": "dense", "hits": None}}) == [("leg", "dense", "leg")]
    assert legs_of({"legs": {"dense": {}, "sparse": {"hits": [hit]}, "none": None}}) == [("leg", "dense", "body"), ("leg", "sparse", "body"), ("leg_hit", "sparse.0", "hit")]
    assert legs_of(json.dumps(json.dumps({"legs": {"dense": {"hits": []}}}))) == [("leg", "dense", "body")]
    for other in (None, "", "{", "null", "3", "[1]", '"text"', {"legs": 3}, {"legs": []}, {"hits": 4}, {"legs": [{"hits": [hit]}]}):
        assert legs_of(other) == []


def test_automaton():
    assert nested.run([{"leg": "a"}, None])[0] == "legs" and nested.run([None])[0] == "empty" and nested.run([1, "a"])[0] == "scalars"
    assert nested.run({"dense": {"hits": []}})[0] == "legs_by_name" and nested.run({"x": [1, {}]})[0] == "object"


def test_state_decides_the_route(monkeypatch):
    hit = {"chunk_id": "a"}
    named = {"legs": {"dense": {"hits": [hit, 3, None, [hit]]}, "odd": {"x": 1}, "list": [hit], "none": None}}
    assert legs_of(named) == [
        ("leg", "dense", "body"), ("leg_hit", "dense.0", "hit"), ("leg_hit", "dense.1", "number"), ("leg_hit", "dense.3", "hits"), ("leg", "odd", "object"),
    ]
    monkeypatch.delitem(nested.ROUTES["named"], "object")
    monkeypatch.setitem(nested.ROUTES["hits"], "number", "other_kind")
    assert legs_of(named) == [("leg", "dense", "body"), ("leg_hit", "dense.0", "hit"), ("other_kind", "dense.1", "number"), ("leg_hit", "dense.3", "hits")]


def test_tables(spark, cluttered):
    call = lambda error=None, batches=None: ("p", 1, 2.0, error, batches)
    spans = [("embed", 1.0, {"k": "v"}, [call(), None, call((500, "no"), [(8, 1), None, (4, None)])]), None, ("rank", None, None, None)]
    from datetime import datetime

    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("t", late, spans, '{"legs": {"dense": {"hits": [{"chunk_id": "x", "rank": 1, "score": 0.5, "tags": ["a", 3]}]}}}'), ("t", early, spans[:1], None), ("u", None, [], "{"), ("v", early, None, None), (None, early, spans, None)]
    responses = [("t", early, [(1, "c", "s", "x", 0.5, ["dense", "sparse"]), None, (2, "d", "s", "x", 0.4, None)]), ("t", early, None)]
    flat = nested.Flat(cluttered(spark.createDataFrame(rows, TRACE)), cluttered(spark.createDataFrame(responses, RESPONSE)))
    assert {tuple(r) for r in flat.all_nodes().collect()} == {
        ("t", "span", "0"), ("t", "span", "2"), ("t", "call", "0.0"), ("t", "call", "0.2"), ("t", "batch", "0.2.0"), ("t", "batch", "0.2.2"), ("t", "leg", "dense"), ("t", "leg_hit", "dense.0"), ("t", "citation", "0"), ("t", "citation", "2"),
    }
    calls = {r.node_path: r for r in flat.table("call").collect()}
    assert calls["0.0"].state == "call" and calls["0.2"].state == "call_failed_batched" and calls["0.2"].error_code == 500 and calls["0.2"].parent_path == "0"
    assert {r.node_path: r.state for r in flat.table("span").collect()} == {"0": "span_with_failure", "2": "span"}
    assert flat.table("leg_hit").first().tags == ["a"] and flat.table("leg_hit").first().parent_path == "dense"
    assert {r.node_path: r.state for r in flat.table("citation").collect()} == {"0": "citation_both", "2": "citation"}


def test_typed_states_decide_too(spark, monkeypatch):
    from datetime import datetime

    call = ("p", 1, 2.0, (500, "no"), None)
    traces = spark.createDataFrame([("t", datetime(2024, 1, 1), [("a", 1.0, {"k": "v"}, [call]), ("b", 1.0, None, None)], None)], TRACE)
    responses = spark.createDataFrame([], RESPONSE)
    found = lambda: {tuple(r)[1:] for r in nested.Flat(traces, responses).all_nodes().collect()}
    assert found() == {("span", "0"), ("span", "1"), ("call", "0.0")}
    failed = nested.Flat(traces, responses).subtype("call", "call_failed")
    assert failed.columns == [*nested.KEYS, "provider", "attempt", "ms", "error_code", "error_message"] and failed.first().error_code == 500
    assert nested.Flat(traces, responses).subtype("span", "span").columns == [*nested.KEYS, "name", "ms", "meta"]
    monkeypatch.setitem(nested.STATES, "calls", lambda c: nested.F.lit("something else"))  # a rule of the automaton less
    assert found() == {("span", "0"), ("span", "1")}
    monkeypatch.delitem(nested.ROUTES["spans"], "span")
    assert found() == {("span", "0")}


def test_last_emission_wins(spark):
    from datetime import datetime

    rows = [("t", datetime(2024, 1, d), [(f"name{d}", float(d), None, None)], None) for d in (2, 3, 1)]
    flat = nested.Flat(spark.createDataFrame(rows, TRACE), spark.createDataFrame([], RESPONSE))
    assert [(r.name, r.ms) for r in flat.table("span").collect()] == [("name3", 3.0)]


def test_empty(spark):
    flat = nested.Flat(spark.createDataFrame([], TRACE), spark.createDataFrame([], RESPONSE))
    assert flat.all_nodes().count() == 0 and flat.variants().count() == 0 and all(flat.table(k).count() == 0 for k in flat.nodes)
