"""Command line: validate, heal, apply, test and convert one document."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from routegraph.operators.convert import converted_documents
from routegraph.operators.coverage import coverage
from routegraph.operators.healing import link, recommend
from routegraph.operators.patching import apply_patches, decision_errors, stamped
from routegraph.operators.report import markdown_reports
from routegraph.operators.validation import validate
from routegraph.sources import sinks
from routegraph.sources.documents import Corpus, decisions_of, normalise
from routegraph.store import land


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="routegraph", description="Validate, repair and test questionnaire routing graphs.")
    sub = top.add_subparsers(dest="command", required=True)
    every = {name: sub.add_parser(name) for name in ("validate", "heal", "apply", "test", "convert")}
    for p in every.values():
        p.add_argument("survey_path", type=Path)
    every["validate"].add_argument("--report", type=Path)
    every["validate"].add_argument("--schema", help="a draft-07 schema file, instead of the built-in document rules")
    every["heal"].add_argument("--output", type=Path)
    every["heal"].add_argument("--decisions-template", type=Path)
    every["apply"].add_argument("decisions_path", type=Path)
    every["apply"].add_argument("--output", type=Path, required=True)
    every["test"].add_argument("--coverage", choices=["node", "edge"], default="edge")
    every["test"].add_argument("--minimal", action="store_true", help="the fewest tests that take every edge")
    every["test"].add_argument("--output", type=Path)
    every["convert"].add_argument("output_path", type=Path)
    return top


def corpus_of(spark: SparkSession, text: str) -> Corpus:
    json.loads(text)
    return normalise(spark.createDataFrame([(0, text)], "survey_key int, doc string")).landed(land)


def survey_id(corpus: Corpus) -> str:
    return corpus.surveys.first()["survey_id"]


def run_validate(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, int]:
    corpus = corpus_of(spark, args.survey_path.read_text("utf-8"))
    issues = land(validate(corpus, schema=args.schema), "issues")
    if args.report:
        args.report.write_text(markdown_reports(corpus, issues).first()["report"], "utf-8")
    found = [sinks.issue_payload(r) for r in issues.orderBy("issue_no").collect()]
    return {"survey_id": survey_id(corpus), "status": "invalid" if found else "valid", "issue_count": len(found), "issues": found}, int(bool(found))


def run_heal(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, int]:
    corpus = corpus_of(spark, args.survey_path.read_text("utf-8"))
    issues = land(validate(corpus), "issues")
    recommendations = land(recommend(corpus, issues), "recommendations")
    linked = [sinks.issue_payload(r) for r in link(issues, recommendations).orderBy("issue_no").collect()]
    advised = [sinks.recommendation_payload(r) for r in recommendations.orderBy("rec_no").collect()]
    payload = {"survey_id": survey_id(corpus), "issue_count": len(linked), "issues": linked, "recommendation_count": len(advised), "recommendations": advised}
    if args.decisions_template:
        rows = sinks.decision_template(recommendations).orderBy("rec_no").drop("survey_key", "rec_no").collect()
        args.decisions_template.write_text(json.dumps([r.asDict() for r in rows], indent=2), "utf-8")
        payload["decisions_template"] = str(args.decisions_template)
    return payload, 0


def run_apply(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, int]:
    text = args.survey_path.read_text("utf-8")
    corpus = corpus_of(spark, text)
    recommendations = land(recommend(corpus, land(validate(corpus), "issues")), "recommendations")
    told = json.loads(args.decisions_path.read_text("utf-8"))
    if not isinstance(told, list):
        raise ValueError("Decisions must be a list")
    for d in told:
        if not isinstance(d, dict):
            raise ValueError("Each decision must be an object")
        if missing := sorted({"recommendation_id", "decision", "approver", "rationale"} - set(d)):
            raise ValueError(f"Decision is missing required fields: {', '.join(missing)}")
    decisions = land(decisions_of(spark.createDataFrame([(0, json.dumps(told))], "survey_key int, decisions string")), "decisions")
    if error := decision_errors(decisions).first():
        raise ValueError(error["error"])
    patched, log, counts = apply_patches(corpus, recommendations, decisions)
    rows = [{k: r[k] for k in ("timestamp", "approver", "issue_id", "recommendation_id", "decision", "rationale")} for r in stamped(log).orderBy("pos").collect()]
    document = sinks.patched_document(text, patched, rows)
    args.output.write_text(json.dumps(document, indent=2), "utf-8")
    left = validate(corpus_of(spark, json.dumps(document))).count()
    n = counts.first()
    payload: dict[str, Any] = {"status": "applied" if n and n["applied_count"] else "no_changes", "output": str(args.output)}
    payload |= {k: n[k] if n else 0 for k in ("decision_count", "applied_count", "skipped_count", "logged_count")}
    return payload | {"post_validation_status": "invalid" if left else "valid", "post_issue_count": left}, int(bool(left))


def run_test(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, int]:
    corpus = corpus_of(spark, args.survey_path.read_text("utf-8"))
    tests, unverified, summary = coverage(corpus, args.coverage, minimal=args.minimal)
    s = summary.first()
    plain = [{"id": r["id"], "responses": json.loads(r["responses"]), "expected_path": r["expected_path"], "covered_edges": r["covered_edges"]} for r in tests.orderBy("id").collect()]
    bad = [{k: v for k, v in r.asDict().items() if k not in ("survey_key", "path_ix") and v is not None} for r in unverified.orderBy("path_ix").collect()]
    payload = {
        "survey_id": s["survey_id"], "coverage_target": args.coverage, "tests": plain, "unverified_paths": bad, "uncovered_nodes": s["uncovered_nodes"], "uncovered_edges": s["uncovered_edges"],
        "coverage": {"node_percent": s["node_percent"], "edge_percent": s["edge_percent"]}, "coverage_status": "complete" if s["complete"] else "incomplete",
    }
    return payload, int(not s["complete"])


def run_convert(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, int]:
    corpus = corpus_of(spark, args.survey_path.read_text("utf-8"))
    bare = json.loads(corpus.documents.first()["doc"])
    if "survey" not in bare:
        corpus = corpus_of(spark, json.dumps({"survey": bare}))
    document = json.loads(converted_documents(corpus).first()["doc"])
    args.output_path.write_text(json.dumps(document, indent=2), "utf-8")
    edges = document["survey"]["dag"]["edges"]
    return {"output": str(args.output_path), "questions": len(document["survey"]["questions"]), "edges": len(edges), "unparsed": sum((e["condition"] or [""])[0] == "UNPARSED" for e in edges)}, 0


COMMANDS = {"validate": run_validate, "heal": run_heal, "apply": run_apply, "test": run_test, "convert": run_convert}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("routegraph").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        payload, code = COMMANDS[args.command](spark, args)
    except json.JSONDecodeError as error:
        payload, code = {"error": "invalid_json", "message": str(error)}, 2
    except OSError as error:
        payload, code = {"error": "file_error", "message": str(error)}, 2
    except ValueError as error:
        payload, code = {"error": "input_error", "message": str(error)}, 2
    text = json.dumps(payload, indent=2)
    if code != 2 and getattr(args, "output", None) and args.command in ("heal", "test"):
        args.output.write_text(text, "utf-8")
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
