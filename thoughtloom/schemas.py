"""Logical schemas of the tables the operators exchange."""

from __future__ import annotations

TURN = "source_file string, source string, role string, text string, timestamp string, scan_order struct<file:string,major:bigint,minor:bigint>"

FRAGMENT = "id string, source_file string, source string, role string, text string, timestamp string"

ATOM = (
    "id string, source string, role string, text string, summary string, kind string, "
    "tags array<string>, timestamp string, importance double, activation double, "
    "metadata map<string,string>"
)

QUEUE = (
    f"{FRAGMENT}, status string, attempts int, last_error string, atom_id string, "
    "created_at timestamp, updated_at timestamp"
)

EVIDENCE = (
    "struct<type:string, shared_tags:array<string>, left_tags:array<string>, "
    "right_tags:array<string>, run_id:string, feedback_id:string, status:string, "
    "atom_ids:array<string>, note:string, suggestion_id:string>"
)

EDGE = (
    "from_id string, to_id string, relation string, weight double, confidence double, "
    f"last_used timestamp, evidence {EVIDENCE}"
)

SIGNAL = (
    "struct<keep:boolean, kind:string, summary:string, tags:array<string>, confidence:double, "
    "reason:string, route:string, signals:array<string>, noise:array<string>, handoff:string>"
)
