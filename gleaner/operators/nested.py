"""Deeply nested records as related flat tables (problem 3), by structural variants.

A bottom-up tree automaton gives every object a state from its own symbol and the states of its children: typed arrays
of structs are run through it as column expressions, free-form JSON as a walk over the parsed value. The state says which
variant an object is (a hit, a leg with its name, a leg's body keyed by the name, a failed call, ...), and together with the
place it decides (``ROUTES``) whether a value is a node, and of which kind: a value in a state that its place has no route
for is no node. ``SUBTYPES`` gives every variant its typed table: ``Flat.subtype`` has the columns of that variant alone,
``Flat.table`` all variants of a kind (their supertype), ``Flat.root`` the traces that all of them belong to. All tables share
the keys ``trace_id``, ``node_kind``, ``node_path``, ``parent_path`` and ``state``. Paths are positions from 0, joined by dots;
a leg's position is its name.

A null element is no node but keeps its position. Null and empty levels have no nodes below them. JSON that holds JSON
as a string counts as that JSON; JSON that doesn't parse, and rows without a trace id, have no nodes. A record that was
emitted more than once contributes the nodes of all its emissions, and each node's values are those of the emission that
arrived last. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["trace_id", "node_kind", "node_path", "parent_path", "state"]

# --- the automaton over JSON values -------------------------------------------------------------------------------

_HIT_KEYS = {"chunk_id", "rank", "score"}


def transition(symbol: str, children: dict[str, str] | list[str]) -> str:
    """The state of a value from its symbol and its children's states.

    Leaves: ``null bool number string``. Arrays: ``empty``, ``hits``, ``legs``, ``scalars`` or ``mixed``. Objects:
    ``hit``, ``leg`` (names itself), ``body`` (a leg whose name stands outside), ``legs_by_name`` or ``object``.
    """
    if symbol == "array":
        some = {s for s in children if s != "null"}
        if not some:
            return "empty"
        if some <= {"hit"}:
            return "hits"
        if some <= {"leg"}:
            return "legs"
        return "scalars" if some <= {"bool", "number", "string"} else "mixed"
    if symbol == "object":
        if children.get("leg") == "string":
            return "leg"
        if _HIT_KEYS & children.keys():
            return "hit"
        if "hits" in children and children["hits"] in ("hits", "hit", "empty", "null", "mixed", "scalars"):
            return "body"
        if children and set(children.values()) <= {"body", "null"}:
            return "legs_by_name"
        return "body" if children.keys() <= {"ms"} else "object"
    return symbol


def run(value: object) -> tuple[str, dict | list]:
    """(state, children): the automaton's run over a parsed value; children are such pairs themselves."""
    if isinstance(value, dict):
        below = {k: run(v) for k, v in value.items()}
        return transition("object", {k: s for k, (s, _) in below.items()}), below
    if isinstance(value, list):
        below = [run(v) for v in value]
        return transition("array", [s for s, _ in below]), below
    leaf = "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    return leaf, {}


_ARRAYS = ("empty", "hits", "legs", "scalars", "mixed")
_OBJECTS = ("leg", "hit", "body", "legs_by_name", "object")

#: The kind of node that a value is, by its place and its state; without a kind it is no node. ``list``: an element of
#: ``legs``; ``lone``: the value of ``legs`` itself; ``named``: an entry of that value; ``hits``: a hit of a leg; the others:
#: an element of the array of that name.
ROUTES: dict[str, dict[str, str]] = {
    "list": {"leg": "leg"},
    "lone": {"leg": "leg"},
    "named": dict.fromkeys(_OBJECTS, "leg"),
    "hits": dict.fromkeys((*_OBJECTS, *_ARRAYS, "bool", "number", "string"), "leg_hit"),
    "spans": dict.fromkeys(("span", "span_with_calls", "span_with_failure"), "span"),
    "calls": dict.fromkeys(("call", "call_batched", "call_failed", "call_failed_batched"), "call"),
    "batches": dict.fromkeys(("batch", "batch_cached"), "batch"),
    "citations": dict.fromkeys(("citation", "citation_one", "citation_both"), "citation"),
}

_CALL, _CITED = ["provider", "attempt", "ms"], ["idx", "chunk_id", "source", "text", "score"]
#: What the table of each variant has besides the keys.
SUBTYPES: dict[str, dict[str, list[str]]] = {
    "span": {"span": ["name", "ms", "meta"], "span_with_calls": ["name", "ms", "meta", "n_calls"], "span_with_failure": ["name", "ms", "meta", "n_calls"]},
    "call": {"call": _CALL, "call_batched": _CALL, "call_failed": [*_CALL, "error_code", "error_message"], "call_failed_batched": [*_CALL, "error_code", "error_message"]},
    "batch": {"batch": ["batch_size"], "batch_cached": ["batch_size", "cached"]},
    "leg": dict.fromkeys(_OBJECTS, ["ms", "n_hits"]),
    "leg_hit": {**dict.fromkeys((*_OBJECTS, *_ARRAYS, "bool", "number", "string"), []), "hit": ["chunk_id", "rank", "score", "tags"]},
    "citation": {"citation": _CITED, "citation_one": [*_CITED, "retrieved_by"], "citation_both": [*_CITED, "retrieved_by"]},
}


def parse(text: str | None) -> object:
    """The JSON value; a string that holds JSON is that JSON. None where it doesn't parse."""
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def legs(meta: str | None) -> Iterator[dict]:
    """The legs and leg hits under ``legs``, each routed by its state."""
    value = parse(meta)
    given = value.get("legs") if isinstance(value, dict) else None
    state, below = run(given)
    if state in _ARRAYS:
        some = [("list", None, v, r) for v, r in zip(given, below)]
    elif state in ROUTES["lone"]:
        some = [("lone", None, given, (state, below))]
    elif state in _OBJECTS:
        some = [("named", k, v, below[k]) for k, v in given.items()]
    else:
        some = []
    for place, key, leg, (s, parts) in some:
        kind = ROUTES[place].get(s)
        if kind is None:
            continue
        name = leg["leg"] if key is None else key
        hits, (hits_state, hit_runs) = leg.get("hits"), parts.get("hits", ("null", {}))
        runs = list(zip(hits, hit_runs)) if hits_state in _ARRAYS else [(hits, (hits_state, hit_runs))]
        routed = [(i, hit, h, ROUTES["hits"][h]) for i, (hit, (h, _)) in enumerate(runs) if h in ROUTES["hits"]]
        yield {"node_kind": kind, "node_path": name, "parent_path": None, "state": s, "ms": _number(leg.get("ms")), "n_hits": len(routed)}
        for i, hit, hit_state, hit_kind in routed:
            h = hit if isinstance(hit, dict) else {}
            tags = h.get("tags")
            yield {
                "node_kind": hit_kind, "node_path": f"{name}.{i}", "parent_path": name, "state": hit_state,
                "chunk_id": h.get("chunk_id") if isinstance(h.get("chunk_id"), str) else None, "rank": _number(h.get("rank")), "score": _number(h.get("score")),
                "tags": [t for t in tags if isinstance(t, str)] if isinstance(tags, list) else None,
            }


_LEGS = pa.schema(
    [(c, pa.string()) for c in ("trace_id", "node_kind", "node_path", "parent_path", "state")]
    + [("arrived_at", pa.timestamp("us")), ("ms", pa.float64()), ("n_hits", pa.int64()), ("chunk_id", pa.string()), ("rank", pa.float64()), ("score", pa.float64()), ("tags", pa.list_(pa.string()))]
)


def _leg_nodes(traces: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for trace, at, meta in zip(*(batch.column(c).to_pylist() for c in ("trace_id", "arrived_at", "meta"))):
                rows += ({"trace_id": trace, "arrived_at": at, **node} for node in legs(meta))
            yield pa.RecordBatch.from_pylist(rows, schema=_LEGS)

    some = traces.select("trace_id", F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"), "meta").where("trace_id is not null and meta is not null")
    return some.mapInArrow(scan, "trace_id string, node_kind string, node_path string, parent_path string, state string, arrived_at timestamp_ntz, ms double, n_hits long, chunk_id string, rank double, score double, tags array<string>")


# --- the automaton over typed arrays ------------------------------------------------------------------------------


def _some(children: Column, test=lambda x: F.lit(True)) -> Column:
    """Whether an array has an element that isn't null and whose state passes the test."""
    return F.coalesce(F.exists(children, lambda x: x.isNotNull() & test(x)), F.lit(False))


def batch_state(b: Column) -> Column:
    return F.when(b["cached"].isNull(), "batch").otherwise(F.lit("batch_cached"))


def call_state(c: Column) -> Column:
    kind = F.when(c["error"].isNull(), "call").otherwise(F.lit("call_failed"))
    return F.when(_some(c["batches"]), F.concat(kind, F.lit("_batched"))).otherwise(kind)


def span_state(s: Column) -> Column:
    failed = _some(s["calls"], lambda c: call_state(c).startswith("call_failed"))
    return F.when(failed, "span_with_failure").when(_some(s["calls"]), "span_with_calls").otherwise(F.lit("span"))


def citation_state(c: Column) -> Column:
    legs = F.coalesce(F.size(c["retrieved_by"]), F.lit(0))
    return F.when(legs > 1, "citation_both").when(legs == 1, "citation_one").otherwise(F.lit("citation"))


#: The automaton over typed arrays: the state of an element, by its place.
STATES = {"spans": span_state, "calls": call_state, "batches": batch_state, "citations": citation_state}


def _placed(rows: DataFrame, place: str, array: str, at: list[str]) -> DataFrame:
    """The elements of an array as (trace_id, arrived_at, *at, x, state, node_kind); at: the positions down to theirs."""
    each = rows.select("trace_id", "arrived_at", *at[:-1], F.posexplode(array).alias(at[-1], "x")).where("x is not null").withColumn("state", STATES[place](F.col("x")))
    kind = F.create_map(*(F.lit(y) for pair in ROUTES[place].items() for y in pair)) if ROUTES[place] else None
    return each.withColumn("node_kind", F.lit(None).cast("string") if kind is None else F.try_element_at(kind, F.col("state")))


def _nodes(placed: DataFrame, at: list[str], **values: Column) -> DataFrame:
    """Those of the elements that have a route, with the keys and their values."""
    parent = F.concat_ws(".", *at[:-1]) if len(at) > 1 else F.lit(None).cast("string")
    keys = [F.col("trace_id"), F.col("node_kind"), F.concat_ws(".", *at).alias("node_path"), parent.alias("parent_path"), F.col("state"), F.col("arrived_at")]
    return placed.where("node_kind is not null").select(*keys, *(v.alias(k) for k, v in values.items()))


class Flat:
    """The flat tables of traces(trace_id, arrived_at, spans, meta) and responses(trace_id, created_at, citations)."""

    def __init__(self, traces: DataFrame, responses: DataFrame):
        self.traces = traces
        t = traces.select("trace_id", F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"), "spans").where("trace_id is not null")
        x = F.col("x")
        spans = _placed(t, "spans", "spans", ["i"])
        calls = _placed(spans, "calls", "x.calls", ["i", "j"])
        batches = _placed(calls, "batches", "x.batches", ["i", "j", "k"])
        r = responses.select("trace_id", F.col("created_at").cast("timestamp_ntz").alias("arrived_at"), "citations").where("trace_id is not null")
        cited = _placed(r, "citations", "citations", ["i"])
        long = lambda c: F.col(c).cast("long")
        meta = F.sort_array(F.transform(F.map_entries("x.meta"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
        self.leg_nodes = _leg_nodes(traces)
        self.nodes = {
            "span": _nodes(spans, ["i"], name=x["name"], ms=x["ms"], meta=meta, n_calls=F.coalesce(F.size("x.calls"), F.lit(0)).cast("long")),
            "call": _nodes(calls, ["i", "j"], provider=x["provider"], attempt=long("x.attempt"), ms=x["ms"], error_code=long("x.error.code"), error_message=x["error"]["message"]),
            "batch": _nodes(batches, ["i", "j", "k"], batch_size=long("x.batch_size"), cached=long("x.cached")),
            "leg": self.leg_nodes.where("node_kind = 'leg'").select(*KEYS, "arrived_at", "ms", "n_hits"),
            "leg_hit": self.leg_nodes.where("node_kind = 'leg_hit'").select(*KEYS, "arrived_at", "chunk_id", "rank", "score", "tags"),
            "citation": _nodes(cited, ["i"], idx=long("x.idx"), chunk_id=x["chunk_id"], source=x["source"], text=x["text"], score=x["score"], retrieved_by=x["retrieved_by"]),
        }

    def root(self) -> DataFrame:
        """One row for each trace, with the values of the emission that arrived last (of two at once the greater)."""
        t = self.traces.where("trace_id is not null")
        last = F.max(F.struct(*(F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else F.col(c) for c in ("arrived_at", "started_at", "client_key", "query", "total_ms"))))
        return t.groupBy("trace_id").agg(F.count("*").alias("emissions"), last.alias("v")).select("trace_id", "emissions", "v.*")

    def subtype(self, kind: str, state: str) -> DataFrame:
        """The table of one variant: the keys and the columns that this variant has."""
        return self.table(kind).where(F.col("state") == state).select(*KEYS, *SUBTYPES[kind][state])

    def table(self, kind: str) -> DataFrame:
        """The supertype's table, of all variants of a kind: one row for each node, with the values that arrived last (of two at once the greater)."""
        rows = self.nodes[kind]
        values = [c for c in rows.columns if c not in ("trace_id", "node_kind", "node_path")]
        values.sort(key=lambda c: c != "arrived_at")
        last = rows.groupBy("trace_id", "node_kind", "node_path").agg(F.max(F.struct(*values)).alias("v"))
        return last.select("trace_id", "node_kind", "node_path", *(F.col(f"v.{c}").alias(c) for c in values if c != "arrived_at"))

    def all_nodes(self) -> DataFrame:
        """(trace_id, node_kind, node_path) of every node that a state was routed to, each once: the union of all subtypes."""
        rows = [self.nodes[k] for k in ("span", "call", "batch", "citation")] + [self.leg_nodes]
        every = rows[0].select("trace_id", "node_kind", "node_path")
        for r in rows[1:]:
            every = every.unionByName(r.select("trace_id", "node_kind", "node_path"))
        return every.distinct()

    def variants(self) -> DataFrame:
        """(node_kind, state, nodes): how many nodes each variant has, over all emissions."""
        every = None
        for rows in [*(self.nodes[k] for k in ("span", "call", "batch", "citation")), self.leg_nodes]:
            part = rows.select("node_kind", "state")
            every = part if every is None else every.unionByName(part)
        return every.groupBy("node_kind", "state").agg(F.count("*").alias("nodes"))
