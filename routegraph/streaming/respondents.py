"""Respondents as a stream.

A compiled route is a projection, so a stream of complete answers is routed without state. Answers that arrive one
by one are first gathered for each respondent, in event time, until the watermark has passed the respondent's session.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.functions.conditions import json_answers
from routegraph.operators.routes import compiled_routes


def routed_stream(respondents: DataFrame, entry: str | None, edges: list[dict[str, Any]], terminals: list[str]) -> DataFrame:
    """``respondents`` (with ``answers``, a JSON object) with path, edge_ids and reason; streaming or not."""
    parsed = respondents.withColumn("_answers", json_answers(F.col("answers")))
    return compiled_routes(parsed, entry, edges, terminals, lambda name: F.col("_answers")[name]).drop("_answers")


def gathered_answers(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(respondent, session, answers) of events (respondent, ts, question, answer as JSON): the last answer to each question
    in a session that ends after ``gap`` without an event. Events later than ``late`` are dropped by the watermark."""
    sessions = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "respondent")
    last = sessions.agg(F.array_sort(F.collect_list(F.struct("ts", "question", "answer"))).alias("said"))
    pairs = F.aggregate("said", F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["question"]), F.create_map(e["question"], e["answer"])))
    shown = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",")
    return last.select("respondent", "session", F.concat(F.lit("{"), shown, F.lit("}")).alias("answers"))
