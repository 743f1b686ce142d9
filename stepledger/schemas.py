"""Explicit schemas of every table; no reader infers one.

Documents on disk use camelCase keys, tables use snake_case. A schema is kept once, as field -> type in
table spelling, and the document spelling is derived from it; both have the same field order, so a cast
from one to the other renames the fields.
"""

from __future__ import annotations

import re


def _camel(text: str) -> str:
    return re.sub(r"_([a-z])", lambda match: match.group(1).upper(), text)


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {data_type}" for name, data_type in fields.items())


def struct(fields: dict[str, str]) -> str:
    return "STRUCT<" + ", ".join(f"`{name}`: {data_type}" for name, data_type in fields.items()) + ">"


def document(fields: dict[str, str], **renamed: str) -> dict[str, str]:
    """The same fields in document spelling."""
    return {renamed.get(name, _camel(name)): _camel(data_type) for name, data_type in fields.items()}


INPUT = {"step": "STRING", "copy_to_output": "BOOLEAN", "optional": "BOOLEAN"}
_CACHES = "ARRAY<STRUCT<name: STRING, path: STRING, exclusive: BOOLEAN>>"
_MOUNTS = "ARRAY<STRUCT<host: STRING, container: STRING>>"

STEP = {
    "id": "STRING",
    "name": "STRING",
    "image": "STRING",
    "cmd": "ARRAY<STRING>",
    "setup": f"STRUCT<cmd: ARRAY<STRING>, caches: {_CACHES}, allow_network: BOOLEAN>",
    "env": "MAP<STRING, STRING>",
    "env_file": "STRING",
    "inputs": f"ARRAY<{struct(INPUT)}>",
    "output_path": "STRING",
    "caches": _CACHES,
    "mounts": _MOUNTS,
    "sources": _MOUNTS,
    "timeout_sec": "DOUBLE",
    "allow_failure": "BOOLEAN",
    "allow_network": "BOOLEAN",
    "retries": "INT",
    "retry_delay_ms": "BIGINT",
    "condition": "STRING",
    "uses": "STRING",
    "params": "MAP<STRING, STRING>",
}
STEP_DOCUMENT = document(STEP, condition="if", params="with")
PIPELINE_DOCUMENT = {"id": "STRING", "name": "STRING", "steps": f"ARRAY<{struct(STEP_DOCUMENT)}>"}

RUN = {
    "run_id": "STRING",
    "step_id": "STRING",
    "step_name": "STRING",
    "started_at": "TIMESTAMP",
    "finished_at": "TIMESTAMP",
    "duration_ms": "BIGINT",
    "exit_code": "INT",
    "image": "STRING",
    "cmd": "ARRAY<STRING>",
    "env": "MAP<STRING, STRING>",
    "inputs": "ARRAY<STRUCT<step: STRING, run_id: STRING, mounted_as: STRING>>",
    "mounts": "ARRAY<STRUCT<host_path: STRING, container_path: STRING>>",
    "setup": "STRUCT<cmd: ARRAY<STRING>, caches: ARRAY<STRING>, allow_network: BOOLEAN>",
    "caches": "ARRAY<STRING>",
    "allow_network": "BOOLEAN",
    "fingerprint": "STRING",
    "status": "STRING",
}
RUN_DOCUMENT = document(RUN)

STATE_DOCUMENT = {"steps": "MAP<STRING, STRUCT<runId: STRING, fingerprint: STRING>>"}

_STEP_REF = "STRUCT<id: STRING, display_name: STRING>"
EVENT = {
    "event": "STRING",
    "workspace_id": "STRING",
    "job_id": "STRING",
    "group_id": "STRING",
    "pipeline_name": "STRING",
    "steps": f"ARRAY<{_STEP_REF}>",
    "step": _STEP_REF,
    "run_id": "STRING",
    "reason": "STRING",
    "duration_ms": "BIGINT",
    "artifact_size": "BIGINT",
    "ephemeral": "BOOLEAN",
    "exit_code": "INT",
    "attempt": "INT",
    "max_retries": "INT",
    "total_artifact_size": "BIGINT",
    "stream": "STRING",
    "line": "STRING",
}
EVENT_DOCUMENT = document(EVENT)
ENVELOPE_DOCUMENT = {
    "seq": "BIGINT",
    "timestamp": "TIMESTAMP",
    "version": "INT",
    "type": "STRING",
    "event": struct(EVENT_DOCUMENT),
}

# The event types.
PIPELINE_START = "PIPELINE_START"
STEP_STARTING = "STEP_STARTING"
STEP_SKIPPED = "STEP_SKIPPED"
STEP_FINISHED = "STEP_FINISHED"
STEP_FAILED = "STEP_FAILED"
STEP_RETRYING = "STEP_RETRYING"
STEP_WOULD_RUN = "STEP_WOULD_RUN"
STEP_LOG = "STEP_LOG"
PIPELINE_FINISHED = "PIPELINE_FINISHED"
PIPELINE_FAILED = "PIPELINE_FAILED"

STEP_STATE_TYPES = (STEP_STARTING, STEP_SKIPPED, STEP_FINISHED, STEP_FAILED)
TERMINAL_TYPES = (PIPELINE_FINISHED, PIPELINE_FAILED)
FOLDED_TYPES = (PIPELINE_START, *STEP_STATE_TYPES, *TERMINAL_TYPES)
