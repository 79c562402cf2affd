"""Column layouts of the normalised tables, and the document rules.

All tables carry ``survey_key``, which tells documents apart; ``survey_id`` is what a document calls itself.
"""

from __future__ import annotations

EDGE = "ord INT, edge_id STRING, source STRING, target STRING, condition STRING, condition_text STRING, priority LONG, type STRING"

ISSUE_COLUMNS = ("survey_key", "id", "severity", "type", "node_id", "edge_id", "message", "evidence", "recommendation_ids", "status")
RECOMMENDATION_COLUMNS = ("survey_key", "id", "issue_id", "type", "confidence", "rationale", "patch", "requires_approval")

PATCH = (
    "array<struct<op:string,edge:struct<id:string,source:string,target:string,condition:string,condition_text:string,priority:bigint,type:string>,"
    "edge_id:string,priority:bigint>>"
)

# The operators of the expression language.
LOGICAL = ("AND", "OR", "NOT")
CONSTANT = ("TRUE", "FALSE")
COMPARISON = ("=", "!=", ">", "<", ">=", "<=", "in", "not_in", "contains")
OPERATORS = COMPARISON + LOGICAL + CONSTANT
UNKNOWN = "<unknown>"
NO_PRIORITY = 999

# What a document must look like. Each kind of object: its required keys, and the rules of its keys.
# A rule is a type, or (type, {keyword: value}); {"Kind"} stands for an object of that kind, ["Kind"] for an array
# of it and {"*": "Kind"} for an object whose values are of that kind.
LOWER_ID, UPPER_ID = "^[a-z0-9_]+$", "^[A-Z0-9_]+$"
INPUTS = ["text", "number", "email", "phone"]
COUNT = ("integer", {"minimum": 1})
TIME = ("string", {"format": "date-time"})
DOCUMENT_RULES = {
    "Document": (["survey"], {"survey": {"Survey"}}),
    "Survey": (
        ["id", "title", "version", "metadata", "blocks", "questions", "terminal_nodes", "dag"],
        {
            "id": ("string", {"pattern": LOWER_ID}), "title": "string", "version": "string", "metadata": {"Metadata"}, "blocks": {"*": "Block"},
            "questions": {"*": "Question"}, "terminal_nodes": {"*": "TerminalNode"}, "dag": {"DAG"},
        },
    ),
    "Metadata": (
        ["created_date", "total_questions", "total_blocks"],
        {
            "created_date": TIME, "source_file": "string", "extraction_method": "string", "extraction_date": TIME,
            "total_questions": COUNT, "total_blocks": COUNT, "estimated_duration_minutes": COUNT,
        },
    ),
    "Block": (["id", "title", "order", "questions"], {"id": ("string", {"pattern": LOWER_ID}), "title": "string", "order": COUNT, "questions": ["string"], "description": "string"}),
    "Question": (
        ["id", "type", "text"],
        {
            "id": ("string", {"pattern": UPPER_ID}),
            "type": ("string", {"enum": ["radio", "checkbox", "number", "text", "instruction", "table", "multi_field"]}),
            "text": "string", "required": "boolean", "options": ["Option"], "validation": {"Validation"}, "fields": ["Field"],
        },
    ),
    "Option": (
        ["value", "text"],
        {"value": "integer", "text": "string", "exclusive": "boolean", "has_text_input": "boolean", "input_type": ("string", {"enum": INPUTS})},
    ),
    "Validation": ([], {"min": "number", "max": "number", "pattern": "string", "max_length": "integer"}),
    "Field": (["id", "type", "label"], {"id": "string", "type": ("string", {"enum": INPUTS}), "label": "string", "required": "boolean"}),
    "TerminalNode": (
        ["id", "type", "text"],
        {"id": ("string", {"pattern": UPPER_ID}), "type": ("string", {"const": "terminal"}), "text": "string", "is_final": "boolean"},
    ),
    "DAG": (["entry_node", "terminal_nodes", "edges"], {"entry_node": "string", "terminal_nodes": ["string"], "edges": ["Edge"]}),
    "Edge": (
        ["id", "source", "target", "condition", "condition_text", "priority", "type"],
        {
            "id": "string", "source": "string", "target": "string", "condition": "condition", "condition_text": "string",
            "priority": COUNT, "type": ("string", {"enum": ["branch", "fallthrough", "terminal"]}),
        },
    ),
}
