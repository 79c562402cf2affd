"""Registered queries over the derived corpora, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from routegraph.functions.conditions import status
from routegraph.operators import convert, coverage, covers, document_rules, graph, healing, impossible, patching, routes, sketches, validation
from routegraph.plans.derived import (
    CORPUS_SQL, CUSTOMER_EDGES, CUSTOMER_SQL, CUSTOMER_TERMINALS, DOCUMENT_BREAKS_SQL, ORDER_ROUTES_SQL, ORDER_SCHEMA, PATHS_SQL, RANGED_SQL, customer_answers, customer_corpus, customer_json, damaged_corpus,
    lookup, order_corpus, order_documents, order_respondents, ranged_corpus, table,
)
from routegraph.schema import DOCUMENT_RULES, LOWER_ID
from routegraph.store import fresh, land
from routegraph.streaming.windows import WindowedCounts

QUERIES, ORACLES = {}, {}


def query(sql: str | None, *preludes: str):
    """Register a query under its function's name. ``sql`` follows the common table expressions of ``preludes``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + ",".join(preludes) + " " if preludes else "") + sql
        return f

    return add


def _corpus(spark: SparkSession, d: str):
    """The tables of all orders, as plans that each query prunes; operators that read a table again and again land it."""
    return order_corpus(spark, d)


# ---- checks ----------------------------------------------------------------------------------------------------


@query("SELECT * FROM reached", CORPUS_SQL)
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_corpus(spark, d))


@query("SELECT survey_key, edge_id, target AS node_id FROM edge e WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.survey_key = e.survey_key AND n.node = e.target)", CORPUS_SQL)
def missing_edge_target(spark: SparkSession, d: str) -> DataFrame:
    return validation.found_by(_corpus(spark, d), "targets").select("survey_key", "edge_id", "node_id")


@query("SELECT survey_key, edge_id, variable AS node_id FROM edge e WHERE variable IS NOT NULL AND NOT EXISTS (SELECT 1 FROM question q WHERE q.survey_key = e.survey_key AND q.qid = e.variable)", CORPUS_SQL)
def missing_condition_variable(spark: SparkSession, d: str) -> DataFrame:
    return validation.condition_issues(_corpus(spark, d)).where("type = 'missing_condition_variable'").select("survey_key", "edge_id", "node_id")


@query("SELECT survey_key, qid AS node_id FROM question q WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.survey_key = q.survey_key AND e.source = q.qid)", CORPUS_SQL)
def missing_outgoing_edge(spark: SparkSession, d: str) -> DataFrame:
    return validation.missing_outgoing(_corpus(spark, d)).select("survey_key", "node_id")


@query("SELECT survey_key, source, priority, string_agg(edge_id, ',' ORDER BY ord) AS edge_ids FROM edge GROUP BY 1, 2, 3 HAVING count(*) > 1", CORPUS_SQL)
def duplicate_priority(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_priorities(_corpus(spark, d)).select("survey_key", "source", "priority", F.array_join("edge_ids", ",").alias("edge_ids"))


FALL_SQL = "SELECT survey_key, source FROM edge GROUP BY 1, 2 HAVING bool_or(type = 'branch') AND NOT bool_or(type = 'fallthrough')"


@query(FALL_SQL, CORPUS_SQL)
def missing_fallthrough(spark: SparkSession, d: str) -> DataFrame:
    return validation.missing_fallthroughs(_corpus(spark, d)).select("survey_key", "source")


UNREACHED_SQL = """SELECT n.survey_key, n.node FROM node n JOIN survey s USING (survey_key) WHERE n.node <> s.entry AND {kind}
  AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.survey_key = n.survey_key AND r.node = n.node)"""


@query(UNREACHED_SQL.format(kind="NOT terminal"), CORPUS_SQL)
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return validation.unreached_nodes(c, graph.reachable(c)).where("not is_terminal").select("survey_key", "node")


@query(UNREACHED_SQL.format(kind="terminal"), CORPUS_SQL)
def unreachable_terminals(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return validation.unreached_nodes(c, graph.reachable(c)).where("is_terminal").select("survey_key", "node")


DEAD_SQL = "SELECT r.survey_key, r.node FROM reached r WHERE r.node <> 'END' AND NOT EXISTS (SELECT 1 FROM ending e WHERE e.survey_key = r.survey_key AND e.node = r.node)"


@query(DEAD_SQL, CORPUS_SQL)
def dead_ends(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return validation.dead_ends(c, graph.reachable(c))


@query(
    "SELECT DISTINCT survey_key, a AS node FROM pair WHERE a = b", CORPUS_SQL,
    "pair AS (SELECT survey_key, source AS a, target AS b FROM step WHERE target <> 'END' UNION SELECT p.survey_key, p.a, s.target FROM pair p JOIN step s ON s.survey_key = p.survey_key AND s.source = p.b WHERE s.target <> 'END')",
)
def cyclic_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.cyclic_nodes(_corpus(spark, d)).distinct()


@query(None)
def cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(_corpus(spark, d)).select("survey_key", "cycle_ix", F.array_join("cycle", ">").alias("cycle"))


# ---- order -----------------------------------------------------------------------------------------------------


@query("SELECT survey_key, edge_id, source, CAST(rank AS INTEGER) AS rank FROM ranked", CORPUS_SQL)
def edge_ranks(spark: SparkSession, d: str) -> DataFrame:
    return graph.outgoing_ranks(_corpus(spark, d).edges).select("survey_key", "edge_id", "source", "rank")


@query("SELECT survey_key, edge_id, target, CAST(row_number() OVER (PARTITION BY survey_key, target ORDER BY edge_id, ord) AS INTEGER) AS rank FROM edge", CORPUS_SQL)
def incoming_ranks(spark: SparkSession, d: str) -> DataFrame:
    return graph.incoming_ranks(_corpus(spark, d).edges).select("survey_key", "edge_id", "target", "rank")


@query("SELECT survey_key, CAST(ord AS INTEGER) AS ord, qid FROM placed", CORPUS_SQL)
def block_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.block_order(_corpus(spark, d))


@query("SELECT survey_key, qid, lead(qid) OVER (PARTITION BY survey_key ORDER BY ord) AS next_qid FROM placed", CORPUS_SQL)
def next_question(spark: SparkSession, d: str) -> DataFrame:
    return graph.next_questions(graph.block_order(_corpus(spark, d)))


NEAREST_SQL = """SELECT a.survey_key, a.qid, (SELECT arg_max(b.qid, b.ord) FROM placed b JOIN reached r ON r.survey_key = b.survey_key AND r.node = b.qid
  WHERE b.survey_key = a.survey_key AND b.ord < a.ord) AS predecessor FROM placed a"""


@query(NEAREST_SQL, CORPUS_SQL)
def nearest_predecessor(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return graph.nearest_predecessors(graph.block_order(c), graph.reachable(c))


# ---- conditions ------------------------------------------------------------------------------------------------


def _evaluated(spark: SparkSession, d: str, **conditions) -> DataFrame:
    return customer_answers(spark, d).select("c_custkey", *[(status(c, lookup)).alias(k) for k, c in conditions.items()])


WHO = CUSTOMER_SQL.split("), hop AS")[0] + ")"
_T = "CASE WHEN {} THEN 'T' ELSE 'F' END AS {}"


@query("SELECT c_custkey, " + ", ".join(_T.format(*x) for x in (("segment = 'BUILDING'", "eq"), ("segment <> 'BUILDING'", "ne"), ("balance > 1000.5", "gt"), ("balance < 1000.5", "lt"), ("coalesce(nation >= 12, false)", "ge"), ("coalesce(nation <= 12, false)", "le"), ("segment < 'F'", "text_lt"))) + " FROM who", WHO)
def eval_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, eq=["=", "SEGMENT", "BUILDING"], ne=["!=", "SEGMENT", "BUILDING"], gt=[">", "BALANCE", 1000.5], lt=["<", "BALANCE", 1000.5], ge=[">=", "NATION", 12], le=["<=", "NATION", 12], text_lt=["<", "SEGMENT", "F"])


@query("SELECT c_custkey, " + ", ".join(_T.format(*x) for x in (("coalesce(nation IN (1, 2, 3), false)", "is_in"), ("NOT coalesce(nation IN (1, 2, 3), false)", "not_in"), ("list_contains(tags, 2)", "has"), ("nation IS NULL OR nation IN (1, 2)", "in_null"), ("false", "in_none"))) + " FROM who", WHO)
def eval_set_ops(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, is_in=["in", "NATION", [1, 2, 3]], not_in=["not_in", "NATION", [1, 2.0, 3]], has=["contains", "TAGS", 2], in_null=["in", "NATION", [None, 1, 2]], in_none=["in", "NATION", []])


@query("SELECT c_custkey, " + ", ".join(_T.format(*x) for x in (("balance > 0 AND segment = 'MACHINERY'", "both"), ("balance > 9000 OR coalesce(nation < 5, false)", "either"), ("NOT coalesce(nation < 5, false)", "neither"), ("balance > 0 AND NOT (segment = 'BUILDING' OR segment = 'FURNITURE')", "nested"), ("true", "yes"))) + " FROM who", WHO)
def eval_logic(spark: SparkSession, d: str) -> DataFrame:
    both = ["AND", [">", "BALANCE", 0], ["=", "SEGMENT", "MACHINERY"]]
    nested = ["AND", [">", "BALANCE", 0], ["NOT", ["OR", ["=", "SEGMENT", "BUILDING"], ["=", "SEGMENT", "FURNITURE"]]]]
    return _evaluated(spark, d, both=both, either=["OR", [">", "BALANCE", 9000], ["<", "NATION", 5]], neither=["NOT", ["<", "NATION", 5]], nested=nested, yes=["OR", ["FALSE"], ["TRUE"]])


NULLS = ("nation IS NULL", "is_null"), ("nation IS NOT NULL", "not_null"), ("nation IS DISTINCT FROM 5", "not_five"), ("true", "no_answer"), ("false", "no_greater")


@query("SELECT c_custkey, " + ", ".join(_T.format(*x) for x in NULLS) + ", CASE WHEN nation IS NULL THEN 'F' ELSE 'E:Unsupported operands for condition operator >' END AS clash, CASE WHEN segment = 'BUILDING' THEN 'T' ELSE 'E:Unknown condition operator: ~' END AS lazy FROM who", WHO)
def eval_nulls(spark: SparkSession, d: str) -> DataFrame:
    frame = customer_answers(spark, d).withColumn("NONE", F.when(F.lit(False), F.col("NATION")))
    conditions = dict(is_null=["=", "NATION", None], not_null=["!=", "NATION", None], not_five=["!=", "NATION", 5], no_answer=["NOT", [">", "NONE", 1]], no_greater=[">", "NONE", 1], clash=[">", "NATION", "x"], lazy=["OR", ["=", "SEGMENT", "BUILDING"], ["~", "NATION", 1]])
    return frame.select("c_custkey", *[status(c, lookup).alias(k) for k, c in conditions.items()])


# ---- routes ----------------------------------------------------------------------------------------------------


def _compiled(spark: SparkSession, d: str) -> DataFrame:
    return routes.compiled_routes(customer_answers(spark, d), "Q1", CUSTOMER_EDGES, CUSTOMER_TERMINALS, lookup)


def _shown(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("c_custkey"), F.array_join("path", ">").alias("path"), F.array_join("edge_ids", ">").alias("edge_ids"), "reason")


ROUTES_SQL = "SELECT c_custkey, path, edge_ids, reason FROM route"


@query(ROUTES_SQL, CUSTOMER_SQL)
def routes_compiled(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_compiled(spark, d), "c_custkey")


@query(ROUTES_SQL, CUSTOMER_SQL)
def routes_data_driven(spark: SparkSession, d: str) -> DataFrame:
    return _shown(routes.corpus_routes(customer_json(spark, d), customer_corpus(spark)), "respondent")


@query(
    """SELECT survey_key, respondent, array_to_string(path, '>') AS path, array_to_string(edge_ids, '>') AS edge_ids,
      CASE WHEN closed THEN 'max_steps' WHEN path[-1] = 'END' THEN 'terminal' ELSE 'no_matching_edge' END AS reason
    FROM ride r WHERE closed OR path[-1] = 'END' OR NOT EXISTS (SELECT 1 FROM choice c WHERE c.survey_key = r.survey_key AND c.respondent = r.respondent AND c.source = r.path[-1])""",
    CORPUS_SQL, ORDER_ROUTES_SQL,
)
def routes_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """The customer of every order through that order's survey."""
    routed = routes.corpus_routes(order_respondents(spark, d), _corpus(spark, d))
    return routed.select("survey_key", "respondent", F.array_join("path", ">").alias("path"), F.array_join("edge_ids", ">").alias("edge_ids"), "reason")


@query("SELECT path, reason, count(*) AS respondents FROM route GROUP BY 1, 2", CUSTOMER_SQL)
def route_histogram(spark: SparkSession, d: str) -> DataFrame:
    return routes.route_histogram(_compiled(spark, d))


@query("SELECT node, count(*) AS respondents FROM (SELECT unnest(string_split(path, '>')) AS node FROM route) GROUP BY 1", CUSTOMER_SQL)
def question_reach(spark: SparkSession, d: str) -> DataFrame:
    return routes.question_reach(_compiled(spark, d))


# ---- paths and coverage ----------------------------------------------------------------------------------------


@query("SELECT survey_key, CAST(path_ix AS INTEGER) AS path_ix, array_to_string(path, '>') AS path, array_to_string(edge_ids, '>') AS edge_ids FROM found", CORPUS_SQL, PATHS_SQL)
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_paths(_corpus(spark, d)).select("survey_key", "path_ix", F.array_join("path", ">").alias("path"), F.array_join("edge_ids", ">").alias("edge_ids"))


CHOSEN_SQL = """SELECT DISTINCT survey_key, CAST(path_ix AS INTEGER) AS path_ix FROM (
  SELECT f.survey_key, item, min(path_ix) AS path_ix FROM (SELECT survey_key, path_ix, unnest({column}) AS item FROM found) f
  WHERE EXISTS (SELECT 1 FROM {items} x WHERE x.survey_key = f.survey_key AND x.{name} = f.item) GROUP BY 1, 2)"""


@query(CHOSEN_SQL.format(column="path", items="node", name="node"), CORPUS_SQL, PATHS_SQL)
def coverage_nodes(spark: SparkSession, d: str) -> DataFrame:
    return coverage.first_fit_numbers(_corpus(spark, d), "node")


@query(CHOSEN_SQL.format(column="edge_ids", items="edge", name="edge_id"), CORPUS_SQL, PATHS_SQL)
def coverage_edges(spark: SparkSession, d: str) -> DataFrame:
    return coverage.first_fit_numbers(_corpus(spark, d), "edge")


FIRST_FIT_SQL = """SELECT c.survey_key, CAST(row_number() OVER (PARTITION BY c.survey_key ORDER BY c.path_ix) - 1 AS INTEGER) AS test_no, array_to_string(f.path, '>') AS path, array_to_string(f.edge_ids, '>') AS edge_ids
FROM ({chosen}) c JOIN found f ON f.survey_key = c.survey_key AND f.path_ix = c.path_ix"""


def _first_fit(spark: SparkSession, d: str, target: str) -> DataFrame:
    c = _corpus(spark, d).landed(land)
    found = graph.first_fit_paths(c, coverage.universe(c, target), target == "node")
    return found.select("survey_key", F.col("path_ix").alias("test_no"), F.array_join("path", ">").alias("path"), F.array_join("edge_ids", ">").alias("edge_ids"))


@query(FIRST_FIT_SQL.format(chosen=CHOSEN_SQL.format(column="path", items="node", name="node")), CORPUS_SQL, PATHS_SQL)
def first_fit_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tests of ``coverage_nodes``, found without listing all paths."""
    return _first_fit(spark, d, "node")


@query(FIRST_FIT_SQL.format(chosen=CHOSEN_SQL.format(column="edge_ids", items="edge", name="edge_id")), CORPUS_SQL, PATHS_SQL)
def first_fit_edges(spark: SparkSession, d: str) -> DataFrame:
    """The tests of ``coverage_edges``, found without listing all paths."""
    return _first_fit(spark, d, "edge")


@query(
    """SELECT s.survey_key, CAST(round_even(nc / nt * 100, 0) AS INTEGER) AS node_percent, CAST(round_even(ec / et * 100, 0) AS INTEGER) AS edge_percent FROM survey s
    JOIN (SELECT survey_key, count(*) AS nt FROM node GROUP BY 1) USING (survey_key) JOIN (SELECT survey_key, count(DISTINCT edge_id) AS et FROM edge GROUP BY 1) USING (survey_key)
    JOIN (SELECT survey_key, count(DISTINCT item) AS nc FROM (SELECT survey_key, unnest(path) AS item FROM found) GROUP BY 1) USING (survey_key)
    LEFT JOIN (SELECT survey_key, count(DISTINCT item) AS ec FROM (SELECT survey_key, unnest(edge_ids) AS item FROM found) GROUP BY 1) USING (survey_key)""",
    CORPUS_SQL, PATHS_SQL,
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    tests = land(graph.simple_paths(c), "paths").select("survey_key", F.col("path").alias("expected_path"), F.col("edge_ids").alias("covered_edges"))
    none = tests.where("false")
    return coverage.coverage_summary(c, "edge", tests, none).select("survey_key", "node_percent", "edge_percent")


def _tests(tests: DataFrame) -> DataFrame:
    return tests.select("survey_key", "id", "responses", F.array_join("expected_path", ">").alias("path"), F.array_join("covered_edges", ">").alias("edge_ids"))


@query(None)
def coverage_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of the edges of every order's survey, with answers made up for each and checked by simulation."""
    return _tests(coverage.coverage(order_corpus(spark, d), "edge")[0])


@query(None)
def coverage_tests_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The same for nodes."""
    return _tests(coverage.coverage(order_corpus(spark, d), "node")[0])


@query(None)
def coverage_verified_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the verified tests cover of every order's survey; ``coverage_summary`` counts all structural paths."""
    summary = coverage.coverage(order_corpus(spark, d), "edge")[2]
    return summary.select("survey_key", "node_percent", "edge_percent", "n_unverified", "complete")


# ---- repairs ---------------------------------------------------------------------------------------------------

USED_SQL = "used AS (SELECT survey_key, source, list(DISTINCT priority) AS used FROM edge GROUP BY 1, 2)"


@query(
    f"""SELECT f.survey_key, f.source, coalesce(n.next_qid, 'END') AS target, CAST(999 AS BIGINT) AS priority FROM ({FALL_SQL}) f
    JOIN (SELECT survey_key, qid, lead(qid) OVER (PARTITION BY survey_key ORDER BY ord) AS next_qid FROM placed) n ON n.survey_key = f.survey_key AND n.qid = f.source""",
    CORPUS_SQL,
)
def heal_fallthrough(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    rows = healing.fallthrough_targets(c, validation.missing_fallthroughs(c).select("survey_key", "source"))
    used = healing._used_priorities(c)
    return rows.join(used, ["survey_key", "source"]).select("survey_key", "source", "target", healing.fallthrough_priority(F.col("used")).alias("priority"))


@query(
    f"""SELECT p.survey_key, p.predecessor AS source, p.qid AS target,
      coalesce((SELECT max(x) FROM (SELECT unnest(generate_series(1, m - 1)) AS x) WHERE x NOT IN (SELECT priority FROM edge e WHERE e.survey_key = p.survey_key AND e.source = p.predecessor)), 999) AS priority
    FROM ({NEAREST_SQL}) p JOIN ({UNREACHED_SQL.format(kind="NOT terminal")}) o ON o.survey_key = p.survey_key AND o.node = p.qid
    LEFT JOIN (SELECT survey_key, source, min(priority) AS m FROM edge WHERE type <> 'branch' GROUP BY 1, 2) m ON m.survey_key = p.survey_key AND m.source = p.predecessor
    WHERE p.predecessor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.survey_key = p.survey_key AND e.source = p.predecessor AND e.target = p.qid)""",
    CORPUS_SQL,
)
def heal_orphan(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    reached = land(graph.reachable(c), "reachable")
    orphans = validation.unreached_nodes(c, reached).where("not is_terminal").select("survey_key", F.col("node").alias("target"))
    rows = healing.orphan_sources(c, orphans, reached).join(healing._used_priorities(c), ["survey_key", "source"], "left")
    used = F.coalesce("used", F.array().cast("array<bigint>"))
    return rows.select("survey_key", "source", "target", healing.reconnect_priority(used, F.col("m")).alias("priority"))


@query("SELECT survey_key, qid AS source, 'END' AS target FROM question q WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.survey_key = q.survey_key AND e.source = q.qid)", CORPUS_SQL)
def heal_terminal_exit(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return validation.missing_outgoing(c).select("survey_key", F.col("node_id").alias("source")).join(healing.first_terminals(c), "survey_key").withColumnRenamed("terminal", "target")


MOVES_SQL = """doubled AS (
  SELECT survey_key, source, priority, edge_id, row_number() OVER (PARTITION BY survey_key, source, priority ORDER BY ord) - 1 AS k FROM edge
), free AS (
  SELECT g.survey_key, g.source, g.priority, x AS new_priority, row_number() OVER (PARTITION BY g.survey_key, g.source, g.priority ORDER BY x) AS k
  FROM (SELECT survey_key, source, priority, unnest(generate_series(priority + 1, priority + 60)) AS x FROM (SELECT DISTINCT survey_key, source, priority FROM doubled WHERE k > 0)) g
  WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.survey_key = g.survey_key AND e.source = g.source AND e.priority = g.x)
), moved AS (
  SELECT d.survey_key, d.source, d.edge_id, d.priority, f.new_priority FROM doubled d JOIN free f ON f.survey_key = d.survey_key AND f.source = d.source AND f.priority = d.priority AND f.k = d.k WHERE d.k > 0
)"""


def _moves(c) -> DataFrame:
    rows = healing.priority_moves(c, validation.duplicate_priorities(c).select("survey_key", "source", "priority", "edge_ids"))
    return rows.select("survey_key", "source", "priority", F.explode("moves").alias("m")).select("survey_key", "source", F.col("m.edge_id").alias("edge_id"), "priority", F.col("m.priority").alias("new_priority"))


@query("SELECT * FROM moved", CORPUS_SQL, MOVES_SQL)
def heal_duplicate_priority(spark: SparkSession, d: str) -> DataFrame:
    return _moves(_corpus(spark, d))


def _patched(spark: SparkSession, d: str):
    """Priority moves of surveys with an even key approved, of others rejected."""
    c = _corpus(spark, d).landed(land, "edges")
    issues = validation.numbered(c, without=set(validation.CHECKS) - {"priorities"}).withColumn("id", F.format_string("ISSUE_%04d", F.col("issue_no")))
    recommendations = land(healing.recommend(c, issues), "recommendations")
    decision = F.when(F.col("survey_key") % 2 == 0, "approved").otherwise("rejected")
    decisions = recommendations.select("survey_key", F.col("rec_no").alias("pos"), F.col("id").alias("recommendation_id"), decision.alias("decision"), F.lit("reviewer").alias("approver"), F.lit("as advised").alias("rationale"))
    return c, patching.apply_patches(c, recommendations, land(decisions, "decisions"))


@query("SELECT e.survey_key, e.edge_id, coalesce(m.new_priority, e.priority) AS priority FROM edge e LEFT JOIN moved m ON m.survey_key = e.survey_key AND m.edge_id = e.edge_id AND e.survey_key % 2 = 0", CORPUS_SQL, MOVES_SQL)
def apply_patches(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[1][0].edges.select("survey_key", "edge_id", "priority")


@query(
    """SELECT survey_key, count(*) AS decision_count, CAST(sum(CASE WHEN survey_key % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS applied_count, CAST(sum(CASE WHEN survey_key % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS skipped_count, count(*) AS logged_count
    FROM (SELECT DISTINCT survey_key, source, priority FROM moved) GROUP BY 1""",
    CORPUS_SQL, MOVES_SQL,
)
def decision_log_counts(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[1][2]


@query(
    """SELECT survey_key, source, priority, count(*) AS n FROM (
      SELECT e.survey_key, e.source, coalesce(m.new_priority, e.priority) AS priority FROM edge e LEFT JOIN moved m ON m.survey_key = e.survey_key AND m.edge_id = e.edge_id AND e.survey_key % 2 = 0)
    GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    CORPUS_SQL, MOVES_SQL,
)
def post_patch_issues(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_priorities(_patched(spark, d)[1][0]).select("survey_key", "source", "priority", F.size("edge_ids").cast("long").alias("n"))


# ---- all issues ------------------------------------------------------------------------------------------------

ISSUES_SQL = f"""issue AS (
  SELECT survey_key, 'missing_edge_target' AS type, target AS node_id, edge_id, 1 AS stage, ord AS o1, 0 AS o2, '' AS o3 FROM edge e WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.survey_key = e.survey_key AND n.node = e.target)
  UNION ALL SELECT survey_key, 'missing_condition_variable', variable, edge_id, 2, ord, 0, '' FROM edge e WHERE variable IS NOT NULL AND NOT EXISTS (SELECT 1 FROM question q WHERE q.survey_key = e.survey_key AND q.qid = e.variable)
  UNION ALL SELECT survey_key, 'duplicate_priority', source, NULL, 3, min(first), min(ord), '' FROM (SELECT *, min(ord) OVER (PARTITION BY survey_key, source) AS first FROM edge) GROUP BY survey_key, source, priority HAVING count(*) > 1
  UNION ALL SELECT survey_key, 'missing_outgoing_edge', qid, NULL, 4, ord, 0, '' FROM question q WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.survey_key = q.survey_key AND e.source = q.qid)
  UNION ALL SELECT survey_key, 'orphan_node', node, NULL, 5, 0, 0, node FROM ({UNREACHED_SQL.format(kind="NOT terminal")})
  UNION ALL SELECT survey_key, 'unreachable_terminal', node, NULL, 5, 0, 0, node FROM ({UNREACHED_SQL.format(kind="terminal")})
  UNION ALL SELECT survey_key, 'dead_end', node, NULL, 7, 0, 0, node FROM ({DEAD_SQL})
  UNION ALL SELECT survey_key, 'missing_fallthrough', source, NULL, 8, 0, 0, source FROM ({FALL_SQL})
)"""


def _unordered(spark: SparkSession, d: str) -> DataFrame:
    return validation.unnumbered(order_corpus(spark, d), without=("cycles",), texts=False)


@query("SELECT survey_key, CAST(row_number() OVER (PARTITION BY survey_key ORDER BY stage, o1, o2, o3) AS INTEGER) AS issue_no, type, node_id, edge_id FROM issue", CORPUS_SQL, ISSUES_SQL)
def issue_stream(spark: SparkSession, d: str) -> DataFrame:
    """All issues but cycles, numbered within their survey."""
    return validation.numbered(order_corpus(spark, d), without=("cycles",), texts=False).select("survey_key", "issue_no", "type", "node_id", "edge_id")


@query("SELECT type, count(*) AS issues, count(DISTINCT survey_key) AS surveys FROM issue GROUP BY 1", CORPUS_SQL, ISSUES_SQL)
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    return _unordered(spark, d).groupBy("type").agg(F.count("*").alias("issues"), F.countDistinct("survey_key").alias("surveys"))


@query(None)
def full_validation(spark: SparkSession, d: str) -> DataFrame:
    """All issues of all surveys, cycles included, with their messages and evidence."""
    return validation.validate(order_corpus(spark, d)).drop("recommendation_ids")


# ---- conversion and document rules -----------------------------------------------------------------------------


def _expressions(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    size, name = F.col("p_size").cast("string"), F.concat(F.lit("P"), (F.col("p_partkey") % 9).cast("string"))
    text = (
        F.when(F.col("p_size") % 6 == 0, "always_show").when(F.col("p_size") % 6 == 1, F.concat(name, F.lit(" > "), size)).when(F.col("p_size") % 6 == 2, F.concat(name, F.lit(" includes "), size))
        .when(F.col("p_size") % 6 == 3, F.concat(F.lit("("), name, F.lit(" = "), size, F.lit(") AND ("), name, F.lit(" != 3)"))).when(F.col("p_size") % 6 == 4, F.concat(name, F.lit(" == "), size, F.lit(" or "), name, F.lit(" <= 2")))
        .otherwise(F.concat(F.lit("see "), F.col("p_brand")))
    )
    return part.select("p_partkey", text.alias("expression"))


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN '[">","' || n || '",' || p_size || ']' WHEN 2 THEN '["IN","' || n || '",' || p_size || ']'
    WHEN 3 THEN '["AND",["=","' || n || '",' || p_size || '],["!=","' || n || '",3]]' WHEN 4 THEN '["OR",["=","' || n || '",' || p_size || '],["<=","' || n || '",2]]'
    ELSE '["UNPARSED","see ' || p_brand || '"]' END AS condition FROM (SELECT *, 'P' || (p_partkey % 9) AS n FROM part)"""
)
def convert_expressions(spark: SparkSession, d: str) -> DataFrame:
    return convert.with_condition(_expressions(spark, d), "expression").select("p_partkey", "condition")


@query(
    """SELECT conv_id AS survey_key, 'E' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS VARCHAR), 3, '0') AS edge_id, source, target, CAST(CASE part WHEN 0 THEN 1 ELSE 999 END AS BIGINT) AS priority,
    CASE part WHEN 0 THEN 'branch' ELSE 'fallthrough' END AS type FROM (
      SELECT conv_id, turn, 0 AS part, 'T0' AS source, 'T' || turn AS target FROM conversations c WHERE turn % 3 = 1 AND EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = c.conv_id AND z.turn = 0)
      UNION ALL SELECT conv_id, turn, 1, source, target FROM (SELECT conv_id, turn, lag('T' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS source, 'T' || turn AS target FROM conversations) WHERE source IS NOT NULL AND turn % 3 <> 1)"""
)
def convert_edges(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as questionnaires: every third turn asks for an answer to the first."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("survey_key"), F.col("turn").cast("int").alias("ord"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("qid"))
    asks = F.col("ord") % 3 == 1
    universe = turns.select("survey_key", "qid", F.when(asks, "T0 = 1").otherwise("always").alias("expression"), F.when(asks, F.array(F.lit("T0"))).alias("dependencies"))
    return convert.universe_edges(turns, universe).select("survey_key", "edge_id", "source", "target", "priority", "type")


@query("SELECT p_partkey, regexp_matches(p_brand, '^[a-z0-9_]+$') AS id_ok, p_size BETWEEN 1 AND 2147483647 AS order_ok, p_type IN ('radio', 'checkbox', 'number', 'text', 'instruction', 'table', 'multi_field') AS type_ok FROM part")
def schema_rules(spark: SparkSession, d: str) -> DataFrame:
    """Three document rules as columns: an id's pattern, an order's minimum, a type's vocabulary."""
    kinds = DOCUMENT_RULES["Question"][1]["type"][1]["enum"]
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").rlike(LOWER_ID).alias("id_ok"), (F.col("p_size") >= 1).alias("order_ok"), F.col("p_type").isin(kinds).alias("type_ok"))


@query("SELECT survey_key, path, keyword FROM found", DOCUMENT_BREAKS_SQL)
def schema_file(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a document, damaged by its key, against a draft-07 schema that is compiled to tables of rules."""
    found = document_rules.schema_breaks(order_documents(spark, d), ORDER_SCHEMA, texts=False)
    return found.select("survey_key", document_rules.path_json("path").alias("path"), "keyword")


# ---- damaged surveys -------------------------------------------------------------------------------------------

_NAMED = "CASE WHEN survey_key % 3 = 0 AND ord = 0 THEN 'E_AUTO_0002' ELSE edge_id END"


def _said(issues: DataFrame) -> DataFrame:
    return issues.select("survey_key", "type", "node_id", "edge_id", "message")


@query(
    """SELECT survey_key, 'missing_entry_node' AS type, CASE WHEN survey_key % 11 = 1 THEN 'NOPE' END AS node_id, CAST(NULL AS VARCHAR) AS edge_id,
      CASE WHEN survey_key % 11 = 1 THEN 'Entry node NOPE does not exist.' ELSE 'DAG has no entry_node.' END AS message FROM survey WHERE survey_key % 11 < 2""",
    CORPUS_SQL,
)
def missing_entry_node(spark: SparkSession, d: str) -> DataFrame:
    return _said(validation.found_by(damaged_corpus(spark, d), "entries"))


@query(
    """SELECT survey_key, 'missing_terminal_node' AS type, 'LOST' AS node_id, CAST(NULL AS VARCHAR) AS edge_id, 'Terminal node LOST is listed in dag.terminal_nodes but is not defined.' AS message
    FROM survey WHERE survey_key % 7 = 0""",
    CORPUS_SQL,
)
def missing_terminal_node(spark: SparkSession, d: str) -> DataFrame:
    return _said(validation.found_by(damaged_corpus(spark, d), "terminals"))


@query(
    f"SELECT survey_key, 'missing_edge_source' AS type, 'GONE' AS node_id, {_NAMED} AS edge_id, 'Edge ' || {_NAMED} || ' source GONE does not exist.' AS message FROM edge WHERE (survey_key + ord) % 13 = 0",
    CORPUS_SQL,
)
def missing_edge_source(spark: SparkSession, d: str) -> DataFrame:
    return _said(validation.found_by(damaged_corpus(spark, d), "sources"))


@query(
    f"""SELECT survey_key, 'unparsed_condition' AS type, CAST(NULL AS VARCHAR) AS node_id, {_NAMED} AS edge_id, 'Edge ' || {_NAMED} || ' has an unparsed condition.' AS message FROM edge WHERE (survey_key + ord) % 10 = 3
    UNION ALL SELECT survey_key, 'unknown_condition_operator', NULL, {_NAMED}, 'Edge ' || {_NAMED} || ' uses unknown condition operator ~.' FROM edge WHERE (survey_key + ord) % 10 = 4""",
    CORPUS_SQL,
)
def condition_operators(spark: SparkSession, d: str) -> DataFrame:
    return _said(validation.condition_issues(damaged_corpus(spark, d)).where("type <> 'missing_condition_variable'"))


@query(
    f"""SELECT survey_key, edge_id, source, target, priority, type FROM (
      SELECT survey_key, {_NAMED} AS edge_id, CASE WHEN (survey_key + ord) % 13 = 0 THEN 'GONE' ELSE source END AS source, target, priority, type FROM edge
      UNION ALL
      SELECT survey_key, 'E_AUTO_' || lpad(CAST(CASE WHEN i = 2 AND survey_key % 3 = 0 THEN 3 ELSE i END AS VARCHAR), 4, '0'), source, target, CAST(999 AS BIGINT), 'fallthrough' FROM advised
      WHERE survey_key % 2 = 0 AND NOT (survey_key % 3 = 0 AND i = 3))""",
    CORPUS_SQL,
    """hurt AS (
      SELECT survey_key, CASE WHEN (survey_key + ord) % 13 = 0 THEN 'GONE' ELSE source END AS source, type, type = 'fallthrough' AND (survey_key + ord) % 10 NOT IN (3, 4) AS falls FROM edge
    ), bare AS (
      SELECT survey_key, source FROM hurt GROUP BY 1, 2 HAVING bool_or(type = 'branch') AND NOT bool_or(falls)
    ), advised AS (
      SELECT b.survey_key, b.source, coalesce(n.next_qid, 'END') AS target, row_number() OVER (PARTITION BY b.survey_key ORDER BY b.source) AS i
      FROM bare b LEFT JOIN (SELECT survey_key, qid, lead(qid) OVER (PARTITION BY survey_key ORDER BY ord) AS next_qid FROM placed) n ON n.survey_key = b.survey_key AND n.qid = b.source
    )""",
)
def apply_added_edges(spark: SparkSession, d: str) -> DataFrame:
    """Fallthrough edges advised for every survey, added where the key is even. Where an id is taken, two of them come to the same free one, and
    the second is not added."""
    c = damaged_corpus(spark, d).landed(land, "edges")
    issues = validation.fallthrough_issues(c).withColumn("issue_no", F.row_number().over(W.partitionBy("survey_key").orderBy("o3")))
    recommendations = land(healing.recommend(c, issues.withColumn("id", F.format_string("ISSUE_%04d", F.col("issue_no")))), "recommendations")
    decision = F.when(F.col("survey_key") % 2 == 0, "approved").otherwise("rejected")
    decisions = recommendations.select("survey_key", F.col("rec_no").alias("pos"), F.col("id").alias("recommendation_id"), decision.alias("decision"), F.lit("reviewer").alias("approver"), F.lit("as advised").alias("rationale"))
    return patching.apply_patches(c, recommendations, land(decisions, "decisions"))[0].edges.select("survey_key", "edge_id", "source", "target", "priority", "type")


@query(
    """SELECT survey_key, count(*) AS paths, CAST(min(len(edge_ids)) AS INTEGER) AS shortest, CAST(max(len(edge_ids)) AS INTEGER) AS longest FROM found
    GROUP BY 1 HAVING NOT bool_or(len(path) <> len(list_distinct(path)))""",
    CORPUS_SQL, PATHS_SQL,
)
def path_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many ways lead through each order's survey and how many edges they take, by sums over hops; surveys in which a cycle can be
    entered are left out."""
    return graph.path_counts(_corpus(spark, d)).where("paths is not null").withColumn("paths", F.col("paths").cast("long"))


@query(
    "SELECT l.survey_key, l.edges, coalesce(a.tests, 1) AS tests, l.edges AS taken FROM (SELECT survey_key, count(*) AS edges FROM live GROUP BY 1) l JOIN (SELECT survey_key, max(size) AS tests FROM apart GROUP BY 1) a USING (survey_key)",
    CORPUS_SQL,
    """live AS (
      SELECT e.survey_key, e.ord, e.source, e.target, CAST(1 AS BIGINT) << e.ord AS bit FROM edge e JOIN reached r ON r.survey_key = e.survey_key AND r.node = e.source
    ), onward AS (
      SELECT survey_key, target AS a, target AS b FROM live UNION SELECT p.survey_key, p.a, l.target FROM onward p JOIN live l ON l.survey_key = p.survey_key AND l.source = p.b
    ), later AS (
      SELECT DISTINCT x.survey_key, x.ord AS i, y.ord AS j FROM live x JOIN onward p ON p.survey_key = x.survey_key AND p.a = x.target JOIN live y ON y.survey_key = x.survey_key AND y.source = p.b
    ), along AS (
      SELECT survey_key, i, bit_or(CAST(1 AS BIGINT) << j) AS mask FROM (SELECT survey_key, i, j FROM later UNION ALL SELECT survey_key, j, i FROM later) GROUP BY 1, 2
    ), masked AS (
      SELECT l.survey_key, l.ord, l.bit, coalesce(a.mask, 0) AS mask FROM live l LEFT JOIN along a ON a.survey_key = l.survey_key AND a.i = l.ord
    ), apart AS (
      SELECT survey_key, ord, CAST(1 AS BIGINT) AS size, mask FROM masked
      UNION ALL SELECT a.survey_key, m.ord, a.size + 1, a.mask | m.mask FROM apart a JOIN masked m ON m.survey_key = a.survey_key AND m.ord > a.ord AND a.mask & m.bit = 0
    )""",
)
def minimal_cover(spark: SparkSession, d: str) -> DataFrame:
    """How few walks take every edge of each order's survey, and how many edges they take. The SQL looks for the largest set of edges of which no
    walk takes two, whose size is the same by Dilworth's theorem."""
    walks = covers.minimal_cover(_corpus(spark, d)).groupBy("survey_key").agg(F.count("*").alias("tests"), F.size(F.array_distinct(F.flatten(F.collect_list("edge_ids")))).cast("long").alias("taken"))
    live = _live_edges(spark, d).groupBy("survey_key").agg(F.count("*").alias("edges"))
    return live.join(walks, "survey_key").select("survey_key", "edges", "tests", "taken")


def _live_edges(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return c.edges.join(graph.reachable(c).withColumnRenamed("node", "source"), ["survey_key", "source"], "left_semi")


@query(
    """SELECT survey_key, source, edge_id, CASE WHEN EXISTS (SELECT 1 FROM held h WHERE h.survey_key = l.survey_key AND h.source = l.source AND h.rank = l.rank) THEN 'shadowed' ELSE 'never' END AS verdict
    FROM line l WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.survey_key = l.survey_key AND t.source = l.source AND t.rank = l.rank)""",
    RANGED_SQL,
)
def impossible_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that no answers lead along, by domains; the SQL tries an answer of every kind."""
    return impossible.impossible_edges(ranged_corpus(spark, d)).select("survey_key", "source", "edge_id", "verdict")


# ---- streams and reports ---------------------------------------------------------------------------------------


@query(
    """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n
    FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2"""
)
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files in no order of time, in windows of an hour every half hour; what came late is added again. The same as in batch."""
    place = fresh(spark, "window-stream")
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.repartition(4, "event_type").write.parquet(f"{place}/in")
    w = WindowedCounts(f"{place}/out", "1 hour", "30 minutes", "6 hours", ("event_type",))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    w.start(stream, f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return w.corrected(spark).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query(
    """SELECT type, CASE WHEN grouping(kind) = 1 THEN '*' ELSE kind END AS kind, CASE WHEN grouping(parity) = 1 THEN '*' ELSE parity END AS parity, count(*) AS issues, count(DISTINCT survey_key) AS surveys
    FROM (SELECT coalesce(type, '?') AS type, survey_key, CASE WHEN node_id = 'END' THEN 'terminal' WHEN node_id IS NULL THEN 'edge' ELSE 'question' END AS kind, CASE WHEN survey_key % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM issue)
    GROUP BY type, CUBE (kind, parity)""",
    CORPUS_SQL, ISSUES_SQL,
)
def issue_cube(spark: SparkSession, d: str) -> DataFrame:
    """Issues by type, kind of place and half of the surveys, and by all that can be left out of the latter two."""
    kind = F.when(F.col("node_id") == "END", "terminal").when(F.col("node_id").isNull(), "edge").otherwise("question")
    issues = _unordered(spark, d).select("type", "survey_key", kind.alias("kind"), F.when(F.col("survey_key") % 2 == 0, "even").otherwise("odd").alias("parity"))
    sets = [["type", "kind", "parity"], ["type", "kind"], ["type", "parity"], ["type"]]
    out = issues.groupingSets(sets, "type", "kind", "parity").agg(F.count("*").alias("issues"), F.countDistinct("survey_key").alias("surveys"), F.grouping("kind").alias("k"), F.grouping("parity").alias("p"))
    shown = [F.when(F.col(g) == 1, "*").otherwise(F.col(c)).alias(c) for c, g in (("kind", "k"), ("parity", "p"))]
    return out.select("type", *shown, "issues", "surveys")


SKETCHED_SQL = "SELECT {keys}, count(*) AS n_rows, true AS distinct_near, true AS median_near FROM {table} GROUP BY {keys}"


def _sketched(spark: SparkSession, d: str, name: str, key: str, distinct: str, value: str, part: str) -> DataFrame:
    """Sketches stored for each part of a table and merged, held against exact answers: near means within four standard errors of a distinct
    count, and twice the stated error of a rank."""
    kept = sketches.StoredSketches(fresh(spark, f"sketches-{name}"), [key], distinct, value)
    rows = table(spark, d, name).withColumn("_part", F.expr(part))
    for r in rows.select("_part").distinct().orderBy("_part").collect():  # a dozen parts, as the expressions below make them
        kept.add(str(r["_part"]), rows.where(F.col("_part").eqNullSafe(r["_part"])))
    merged = kept.merged(spark).select(key, "n_rows", "n_distinct", F.col("quantiles")[0].alias("median"))
    told = F.broadcast(merged.withColumnRenamed(key, "_key"))  # a row for each key: an event type or a flag
    exact = rows.join(told, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key, "n_rows", "n_distinct", "median").agg(
        F.countDistinct(distinct).alias("exact"), F.count(value).alias("n"), F.count_if(F.col(value) < F.col("median")).alias("below"), F.count_if(F.col(value) <= F.col("median")).alias("upto")
    )
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * sketches.DISTINCT_ERROR * F.col("exact"))
    return exact.select(key, "n_rows", near.alias("distinct_near"), sketches.rank_holds(F.col("below"), F.col("upto"), F.col("n"), 0.5, 2 * sketches.RANK_ERROR).alias("median_near"))


@query(SKETCHED_SQL.format(keys="event_type", table="events"))
def sketched_events(spark: SparkSession, d: str) -> DataFrame:
    """Different users and the median value of each type of event, from sketches of each quarter of the day."""
    return _sketched(spark, d, "events", "event_type", "user_id", "value", "concat('q', cast(floor(hour(ts) / 6) as string))")


@query(SKETCHED_SQL.format(keys="l_returnflag", table="lineitem"))
def sketched_lines(spark: SparkSession, d: str) -> DataFrame:
    """Different parts and the median price of each return flag, from sketches of each month's shipments."""
    return _sketched(spark, d, "lineitem", "l_returnflag", "l_partkey", "l_extendedprice", "concat('m', cast(month(l_shipdate) as string))")
