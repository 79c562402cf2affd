"""Payloads of one survey as Python values and text, and bulk writers of many surveys."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.sources.documents import Corpus

ISSUE_KEYS = ("id", "severity", "type", "node_id", "edge_id", "message", "evidence", "recommendation_ids", "status")


def issue_payload(row: Any) -> dict[str, Any]:
    out = {k: row[k] for k in ISSUE_KEYS}
    out["evidence"] = json.loads(row["evidence"])
    return {k: v for k, v in out.items() if v is not None or k not in ("node_id", "edge_id")}


def edge_payload(row: Any) -> dict[str, Any]:
    condition = json.loads(row["condition"]) if row["condition"] is not None else None
    return {"id": row["id"], "source": row["source"], "target": row["target"], "condition": condition, "condition_text": row["condition_text"], "priority": row["priority"], "type": row["type"]}


def recommendation_payload(row: Any) -> dict[str, Any]:
    patch = []
    for p in row["patch"]:
        patch.append({"op": p["op"], "edge": edge_payload(p["edge"])} if p["op"] == "add_edge" else {"op": p["op"], "edge_id": p["edge_id"], "changes": {"priority": p["priority"]}})
    return {"id": row["id"], "issue_id": row["issue_id"], "type": row["type"], "confidence": row["confidence"], "rationale": row["rationale"], "patch": patch, "requires_approval": row["requires_approval"]}


def decision_template(recommendations: DataFrame) -> DataFrame:
    """Decisions to fill in, one for each recommendation."""
    why = F.format_string("Review recommendation %s: approve or reject with rationale.", F.col("id"))
    return recommendations.select("survey_key", "rec_no", F.col("id").alias("recommendation_id"), F.lit("pending").alias("decision"), F.lit("").alias("approver"), why.alias("rationale"))


def patched_document(doc: str, corpus: Corpus, log: list[dict[str, Any]]) -> dict[str, Any]:
    """The document of one survey with the edges of ``corpus`` and its audit rows. Edges keep keys that tables do not hold."""
    document = json.loads(doc)
    survey = document["survey"]
    edges = survey["dag"]["edges"]
    for r in corpus.edges.orderBy("ord").collect():
        if r["ord"] < len(edges):
            if r["priority"] is not None and isinstance(edges[r["ord"]], dict):
                edges[r["ord"]]["priority"] = r["priority"]
        else:
            edges.append(edge_payload({**r.asDict(), "id": r["edge_id"]}))
    survey.setdefault("metadata", {}).setdefault("decision_log", []).extend(log)
    return document


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One text row for each survey, in files under ``path``."""
    reports.select("report").write.mode("overwrite").text(path, lineSep="\n\n")
