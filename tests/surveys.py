"""Small survey documents for the tests."""

import json


def edge(name, source, target, condition=None, priority=1, kind=None):
    kind = kind or ("branch" if condition is not None else "fallthrough")
    return {"id": name, "source": source, "target": target, "condition": condition, "condition_text": "", "priority": priority, "type": kind}


def survey(edges, questions=("Q1", "Q2"), terminals=("END",), entry="Q1", listed=None, **more):
    body = {
        "id": "small_survey", "title": "Small", "version": "2.0",
        "metadata": {"created_date": "2026-02-03T04:05:06Z", "total_questions": len(questions), "total_blocks": 1},
        "blocks": {"main": {"id": "main", "title": "Main", "order": 1, "questions": list(questions)}},
        "questions": {q: {"id": q, "type": "number", "text": q} for q in questions},
        "terminal_nodes": {t: {"id": t, "type": "terminal", "text": t} for t in terminals},
        "dag": {"entry_node": entry, "terminal_nodes": list(terminals if listed is None else listed), "edges": edges},
    }
    return {"survey": body | more}


VALID = survey([edge("E1", "Q1", "Q2"), edge("E2", "Q2", "END", kind="terminal")])
ORPHAN = survey([edge("E1", "Q1", "END", kind="terminal")])
NO_DEFAULT = survey([edge("E1", "Q1", "Q2", ["=", "Q1", 1]), edge("E2", "Q2", "END", kind="terminal")])
DANGLING = survey([edge("E1", "Q1", "NOWHERE"), edge("E2", "Q2", "END", kind="terminal")])
LOOP = survey([edge("E1", "Q1", "Q2"), edge("E2", "Q2", "Q1")])


def corpus(spark, *documents):
    from routegraph.sources.documents import normalise

    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return normalise(spark.createDataFrame(rows, "survey_key int, doc string"))
