"""Command line: ``python -m gatewright.cli benchmark|validate|suite|extract|verify|corpus|serve``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import metrics as M
from .operators import scoring, suites
from .operators import validate as V
from .sources import cases as K
from .sources import tools as T


def _session() -> SparkSession:
    return SparkSession.builder.appName("gatewright").getOrCreate()


def benchmark(args) -> dict:
    """Score cases with the demonstration rules and report."""
    cases = K.read_cases(_session(), args.path)
    report = M.run_benchmark(scoring.rule_scorer("context")(cases), args.thresholds)
    return {"summary": report["summary"].first().asDict(), "coverage": [r.asDict() for r in report["coverage"].orderBy("ordinal").collect()]}


def validate(args) -> dict:
    """Leakage between a calibration and a test file: ids and contexts that both have."""
    spark = _session()
    a, b = (K.read_cases(spark, p).withColumn("context_key", scoring.same_value("context")) for p in (args.calibration, args.test))
    found = {"case_ids": V.overlap(a, b, "case_id").count(), "contexts": V.overlap(a, b, "context_key").count(), "repeated": V.repeated_ids(a.unionByName(b)).count()}
    return {"valid": not any(found.values())} | found


def suite(args) -> dict:
    """Write covered and missing suites of all sizes, partitioned by coverage and strategy."""
    spark = _session()
    tools = T.load_inventory(spark, args.inventory)
    cases = K.read_cases(spark, args.cases).select("case_id", "gold", F.col("context").alias("query"))
    made = [suites.suite(cases, tools, args.sizes, s, args.seed, missing) for s in args.strategies for missing in (False, True)]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    out.write.mode("overwrite").partitionBy("distractor_strategy", "coverage").json(args.out)
    files = K.file_digests(spark, args.out).where(F.col("path").endswith(".json"))
    return {"schema_version": "m5-stress-suite/v2", "files": [r.asDict() for r in files.orderBy("path").collect()]}


def extract(args) -> dict:
    """The tools of a Python source tree as an inventory document."""
    inventory = T.tree_inventory(_session(), args.root, args.id, args.repository, args.revision)
    T.write_inventory(inventory, args.out)
    return {"tools": len(inventory["tools"]), "sha256": inventory["sha256"]}


def verify(args) -> dict:
    """What is wrong with artifact files, null where nothing is."""
    from .operators import seal

    return {path: seal.problem_in(json.loads(Path(path).read_text(encoding="utf-8"))) for path in args.paths}


def corpus(args) -> dict:
    """Broken rules of an annotated corpus file; with a split, its label is checked, too."""
    from .operators import validate as V

    cases = K.annotated(K.read_cases(_session(), args.path))
    broken = V.annotation_violations(cases, args.grounded)
    if args.split:
        broken = broken.unionByName(V.split_labels(cases, args.split))
    rows = [r.asDict() for r in broken.orderBy("case_id", "rule").collect()]
    return {"cases": cases.count(), "valid": not rows, "violations": rows}


def serve(args) -> dict:
    from .service import build_server

    if args.mode != "demo":
        raise SystemExit("only the demonstration scorer is served")
    build_server(args.host, args.port).serve_forever()
    return {}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gatewright")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("benchmark")
    b.add_argument("path")
    b.add_argument("--thresholds", type=float, nargs="+", default=list(M.DEFAULT_THRESHOLDS))
    v = sub.add_parser("validate")
    v.add_argument("calibration")
    v.add_argument("test")
    s = sub.add_parser("suite")
    for name in ("--cases", "--inventory", "--out"):
        s.add_argument(name, required=True)
    s.add_argument("--sizes", type=int, nargs="+", default=[5, 10, 20, 50, 100])
    s.add_argument("--strategies", nargs="+", default=["random", "lexical"])
    s.add_argument("--seed", type=int, default=0)
    e = sub.add_parser("extract")
    e.add_argument("root")
    for name in ("--id", "--out"):
        e.add_argument(name, required=True)
    e.add_argument("--repository", default="")
    e.add_argument("--revision", default="")
    y = sub.add_parser("verify")
    y.add_argument("paths", nargs="+")
    c = sub.add_parser("corpus")
    c.add_argument("path")
    c.add_argument("--split")
    c.add_argument("--grounded", action="store_true")
    w = sub.add_parser("serve")
    w.add_argument("--mode", default="demo")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8080)
    args = parser.parse_args(argv)
    print(json.dumps(globals()[args.command](args), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
