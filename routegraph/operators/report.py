"""Reports in Markdown, one text for each survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.sources.documents import Corpus


def markdown_reports(corpus: Corpus, issues: DataFrame) -> DataFrame:
    """(survey_key, report)."""
    def tick(c):
        return F.concat(F.lit("`"), F.coalesce(c.cast("string"), F.lit("None")), F.lit("`"))

    def named(label, c):
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"- {label}: none")).otherwise(F.concat(F.lit(f"- {label}: "), tick(c)))

    count = lambda df, name: df.groupBy("survey_key").agg(F.count("*").alias(name))
    unique = lambda df, c: df.select("survey_key", c).distinct()
    section = F.concat_ws(
        "\n", F.concat(F.lit("### "), F.col("id"), F.lit(": "), F.col("type")), F.lit(""), F.concat(F.lit("- Severity: "), tick(F.col("severity"))), F.concat(F.lit("- Status: "), tick(F.col("status"))),
        named("Node", F.col("node_id")), named("Edge", F.col("edge_id")), F.concat(F.lit("- Message: "), F.col("message")), F.lit(""),
    )
    sections = issues.groupBy("survey_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("issue_no", section.alias("text")))), lambda x: x["text"]), "\n").alias("sections"), F.count("*").alias("n_issues"))
    rows = corpus.surveys.join(count(unique(corpus.questions, "qid"), "n_questions"), "survey_key", "left").join(count(unique(corpus.terminals, "tid"), "n_terminals"), "survey_key", "left")
    rows = rows.join(count(corpus.edges, "n_edges"), "survey_key", "left").join(sections, "survey_key", "left").na.fill(0, ["n_questions", "n_terminals", "n_edges", "n_issues"])
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    body = F.when(F.col("n_issues") == 0, F.lit("## Result\n\nNo validation issues found.\n")).otherwise(F.concat(F.lit("## Issues\n\n"), F.col("sections")))
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Validation Report: "), F.col("survey_id")), F.lit(""), F.concat(F.lit("- Entry node: "), tick(F.col("entry_node"))), line("Questions", "n_questions"),
        line("Terminal nodes", "n_terminals"), line("Edges", "n_edges"), line("Issues", "n_issues"), F.lit(""),
    )
    return rows.select("survey_key", F.concat(head, F.lit("\n"), body).alias("report"))
