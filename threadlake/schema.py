"""The canonical event and the values it may take."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

# Event kinds, in the order of the format.
KINDS = (
    "user_message", "assistant_message", "system_message", "tool_call", "tool_result", "file_read", "file_write", "patch",
    "shell_command", "command_result", "git_state", "plan", "task", "decision", "checkpoint", "compaction", "error",
    "subagent_spawn", "session_start", "session_end", "unknown",
)
#: Kinds that conversation-only retention drops.
DISPOSABLE = ("tool_call", "tool_result", "file_read", "file_write", "patch", "shell_command", "command_result")
CONVERSATION = ("user_message", "assistant_message")
PRECISIONS = ("second", "millisecond", "microsecond", "nanosecond", "unknown")

TOOL = T.StructType([T.StructField("family", T.StringType(), False), T.StructField("surface", T.StringType(), False), T.StructField("profile", T.StringType(), False)])
WORKSPACE = T.StructType([T.StructField(n, T.StringType()) for n in ("cwd", "repository_id", "branch", "head")])
PROVENANCE = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("original_path", T.StringType()),
        T.StructField("source_offset", T.LongType()),
        T.StructField("source_generation", T.StringType()),
        T.StructField("adapter_version", T.StringType()),
        T.StructField("ingestion_sequence", T.LongType()),
        T.StructField("ordering_confidence", T.DoubleType()),
    ]
)
#: One normalized event; payload_json holds canonical JSON.
EVENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("tool", TOOL),
        T.StructField("native_session_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("timestamp_precision", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("workspace", WORKSPACE),
        T.StructField("payload_json", T.StringType()),
        T.StructField("provenance", PROVENANCE),
    ]
)
#: The total order of events.
CHRONOLOGY = ("ts_seconds", "ts_nanos", "sequence", "source_generation", "source_offset", "ingestion_sequence", "event_id")
