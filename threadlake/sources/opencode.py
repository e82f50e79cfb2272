"""Sessions in a SQLite database as a Spark data source, ``opencode_db``.

Options: path, since (milliseconds: sessions with parts updated from then on).
Each session with news is read whole, so that ranks are right.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_ROWS, PAGE_BYTES = 128, 4 << 20
SCHEMA = "table_name string, id string, session_id string, message_id string, time_created bigint, time_updated bigint, data string"
TABLES = {
    "session": "select id, id, null, null, null, directory from session",
    "message": "select id, session_id, null, null, null, data from message",
    "part": "select id, session_id, message_id, time_created, time_updated, data from part",
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in TABLES]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(TABLES[partition.value]):
                yield (partition.value, *row)


class OpenCodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opencode_db"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OpenCodeSource)


def parts(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Text parts with role, workspace and rank in their session, of sessions with news since then."""
    rows = spark.read.format("opencode_db").option("path", path).load()
    of = lambda t: rows.where(F.col("table_name") == t)
    part = of("part").select("id", "session_id", "message_id", "time_created", "time_updated", "data")
    news = part.where(F.col("time_updated") >= since).select("session_id").distinct()
    message = of("message").select(F.col("id").alias("m_id"), F.col("session_id").alias("m_session"), F.get_json_object("data", "$.role").alias("role"))
    session = of("session").select(F.col("id").alias("s_id"), F.col("data").alias("directory"))
    joined = part.join(news, "session_id", "left_semi").join(message, (F.col("message_id") == F.col("m_id")) & (F.col("session_id") == F.col("m_session"))).join(session, F.col("session_id") == F.col("s_id"))
    text = joined.where((F.get_json_object("data", "$.type") == "text") & F.col("role").isin("user", "assistant", "system"))
    w = Window.partitionBy("session_id").orderBy("time_created", "id")
    return text.select("id", "session_id", "role", "directory", "time_created", "time_updated", "data", (F.row_number().over(w) - 1).cast("long").alias("rank"))


def page(rows: DataFrame, after: tuple[int, str, int] | None = None, limit: int = PAGE_ROWS, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """The next parts by (time, id), at most ``limit`` rows and, but for the first, ``most_bytes`` bytes."""
    if after is not None:
        rows = rows.where(F.struct("time_created", "id") > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1])))
    first = rows.orderBy("time_created", "id").limit(limit)
    running = F.sum(F.octet_length("data")).over(Window.orderBy("time_created", "id"))
    return first.withColumn("running", running).where((F.col("running") <= most_bytes) | (F.col("running") == F.octet_length("data"))).drop("running")


def high_water(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("time_updated").alias("high_water"))
