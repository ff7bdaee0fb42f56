"""Command line: ``python -m gleaner.service.cli ingest|ask|eval|stats|serve|doctor --index DIR ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.pipeline import Engine
from gleaner.runtime import table_in_shared_dir
from gleaner.settings import RetrievalSettings
from gleaner.sources import loaders


MISSES = 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("ingest", ["path"]), ("ask", ["question"]), ("eval", ["cases"]), ("stats", []), ("serve", []), ("doctor", [])):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--index", required=True)
        c.add_argument("--top-k", type=int, default=None)
        c.add_argument("--json", action="store_true")
        if name == "ingest":
            c.add_argument("--no-recursive", action="store_true")
            c.add_argument("--no-load", action="store_true")
        if name == "serve":
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
            c.add_argument("--ingest-root", default=None)
            c.add_argument("--key", default=None)
    return p


def report(name: str, mean: dict, misses: list[str]) -> str:
    """The means of an evaluation and the first queries that found nothing relevant."""
    lines = [f"=== {name} ({mean['cases']} queries) ===", *(f"  {label:<13} {mean[key]:.3f}" for label, key in (("hit_rate", "hit_rate"), ("recall@k", "recall"), ("precision@k", "precision"), ("MRR", "mrr"), ("nDCG@k", "ndcg")))]
    missed = round(mean["cases"] * (1 - mean["hit_rate"]))
    return "\n".join([*lines, *([f"  misses ({missed}):", *(f"    - {q}" for q in misses[:MISSES])] if misses else [])])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gleaner").getOrCreate()
    engine = Engine(spark, retrieval=RetrievalSettings.from_env(**({"top_k": a.top_k} if a.top_k else {})))
    try:
        if a.command == "ingest":
            if not a.no_load:
                try:
                    engine.load(a.index)
                except FileNotFoundError:
                    pass
            out = engine.index_path(a.path, not a.no_recursive) | engine.save(a.index)
        elif a.command == "doctor":
            try:
                engine.load(a.index)
            except FileNotFoundError:
                pass
            out = engine.ready() | {"shared_dir": spark.conf.get("spark.checkpoint.dir", "none"), "executors": spark.sparkContext.defaultParallelism, "spark": spark.version}
            print("\n".join(f"  {k:<12} {v}" for k, v in out.items()) if not a.json else json.dumps(out))
            return 0 if out["status"] == "ok" else 1
        else:
            engine.load(a.index)
            if a.command == "serve":
                from gleaner.service.http import serve

                serve(engine, a.host, a.port, a.ingest_root, a.key, a.index)
                return 0
            if a.command == "ask":
                out = engine.answer(engine.questions([a.question])).first().asDict(recursive=True)
            elif a.command == "eval":
                cases = table_in_shared_dir(loaders.load_cases(spark, a.cases).withColumn("qid", F.monotonically_increasing_id()), "cases")
                rows, mean = engine.evaluate(cases)
                if not a.json:
                    print(report(a.cases, mean.first().asDict(), [r["query"] for r in rows.where("not hit").join(cases, "qid").orderBy("qid").select("query").limit(MISSES).collect()]))
                    return 0
                out = mean.first().asDict()
            else:
                out = engine.stats()
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if a.command == "ask" and not a.json:
        print(out["answer"])
        for c in out["citations"] or []:
            print(f"  [{c['idx']}] {c['source']} ({c['score']}): " + (c["text"] or "").replace("\n", " "))
    else:
        print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
