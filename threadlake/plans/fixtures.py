"""The test tables as an event log, in SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COMMON = """
select concat('conv:', cast(conv_id as string)) as native_session_id, turn as sequence,
  case role when 'user' then 'user_message' when 'assistant' then 'assistant_message' else 'system_message' end as kind,
  case conv_id % 3 when 0 then 'codex' when 1 then 'claude-code' else 'opencode' end as tool_family,
  concat('/work/p', cast(conv_id % 10 as string), '/') as cwd,
  1704067200 + conv_id * 3600 + turn * 60 as ts_seconds, 0 as ts_nanos,
  {payload} as payload_json, conv_id * 1000 + turn as ingestion_id
from conversations
union all
select native_session_id, sequence, kind, tool_family, cwd, ts_seconds, ts_nanos, payload_json, ingestion_id from (
  select concat('user:', cast(user_id as string)) as native_session_id,
    cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as sequence,
    case event_type when 'signup' then 'session_start' when 'view' then 'user_message' when 'purchase' then 'assistant_message'
      when 'click' then 'tool_call' else 'error' end as kind,
    case user_id % 2 when 0 then 'codex' else 'grok' end as tool_family, cast(null as string) as cwd,
    {seconds} as ts_seconds, {nanos} as ts_nanos, props as payload_json, 1000000000 + event_id as ingestion_id
  from events) numbered
"""

_LOG = """
select concat(native_session_id, '#', cast(sequence as string)) as event_id, native_session_id, cast(sequence as bigint) as sequence, kind, tool_family,
  cwd, cast(ts_seconds as bigint) as ts_seconds, cast(ts_nanos as int) as ts_nanos, payload_json, cast(ingestion_id as bigint) as ingestion_id,
  'g0' as source_generation, cast(sequence as bigint) as source_offset, cast(sequence as bigint) as ingestion_sequence,
  cast({octets}(payload_json) as bigint) as canonical_bytes, cast(null as string) as origin_collector_id, {text} as text
from ({common}) raw
"""

_SPARK = _LOG.format(
    octets="octet_length",
    text="get_json_object(payload_json, '$.text')",
    common=_COMMON.format(payload="to_json(named_struct('text', text))", seconds="unix_micros(cast(ts as timestamp)) div 1000000", nanos="cast((unix_micros(cast(ts as timestamp)) % 1000000) * 1000 as int)"),
)
_DUCK = _LOG.format(
    octets="strlen",
    text="json_extract_string(payload_json, '$.text')",
    common=_COMMON.format(payload="cast(to_json(struct_pack(text := text)) as varchar)", seconds="epoch_us(ts) // 1000000", nanos="cast((epoch_us(ts) % 1000000) * 1000 as int)"),
)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the tables conversations and events."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _SPARK.replace("from conversations", "from {conversations}").replace("from events)", "from {events})")
    return spark.sql(sql, conversations=read("conversations"), events=read("events"))


def oracle(sql: str, *ctes: str) -> str:
    """DuckDB SQL over a table ``log`` of the same events."""
    return "with log as (" + _DUCK + ")" + "".join(f", {c}" for c in ctes) + "\n" + sql
