"""What is kept: conversation-only retention, newest handoffs, referenced blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.schema import DISPOSABLE

ORPHAN_SECONDS = 24 * 3600


def keep_conversation(events: DataFrame) -> DataFrame:
    """Events that conversation-only retention keeps."""
    return events.where(~F.col("kind").isin(*DISPOSABLE))


def kept_raws(raws: DataFrame, events: DataFrame) -> DataFrame:
    """Raw records except those all of whose events are dropped; one without events (a bad line) stays."""
    fate = events.groupBy("raw_object_id").agg(F.bool_or(~F.col("kind").isin(*DISPOSABLE)).alias("keep"))
    return raws.join(fate.where("not keep"), "raw_object_id", "left_anti")


def latest_per_group(rows: DataFrame, group: str, keep: int) -> DataFrame:
    """The newest rows of each group by (created_at, id)."""
    w = Window.partitionBy(group).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("rank")


def orphans(rows: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Rows whose key nothing refers to."""
    return rows.join(referenced.select(key).distinct(), key, "left_anti")


def collectable_blobs(blobs: DataFrame, raws: DataFrame, queued: DataFrame, now: int) -> DataFrame:
    """Unreferenced blobs that are queued for deletion or older than a day."""
    free = orphans(blobs, raws, "blob_hash").join(queued.select("blob_hash", F.lit(True).alias("queued")).distinct(), "blob_hash", "left")
    return free.where(F.col("queued") | (F.col("stored_at") < now - ORPHAN_SECONDS)).drop("queued")


def legacy_envelopes(events: DataFrame) -> DataFrame:
    """Messages of one family that only wrapped tool calls: no text at all."""
    text = F.get_json_object("payload_json", "$.text")
    return events.where((F.col("tool_family") == "claude-code") & F.col("kind").isin("user_message", "assistant_message") & (text == ""))


@dataclass(frozen=True)
class MaintenanceReport:
    """Rows that maintenance removed, by table."""

    events: int = 0
    handoffs: int = 0
    snapshots: int = 0
    raws: int = 0
    blobs: int = 0
