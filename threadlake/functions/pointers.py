"""Where JSON documents hold fields whose names look like credentials, found level by level in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.plans.lineage import settled
from threadlake.sources.records import SENSITIVE


def sensitive_fields(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, pointer) of each field, in objects or arrays at any depth, whose name says api_key, authorization, password, secret or token.

    Each round opens the objects and arrays of one level, until none is left. A
    document that is no JSON, or null, has no fields. Rows of one key are told apart by nothing.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("_of"), F.lit("").alias("_at"), F.col(document).alias("_json"))
    found = None
    while True:
        opened = level.select("_of", "_at", F.try_parse_json("_json").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        name = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        telling = reduce(lambda a, b: a | b, (F.contains(F.lower("key"), F.lit(word)) for word in SENSITIVE))
        kind = F.schema_of_variant("value")
        level = settled(opened.select("_of", F.concat("_at", F.lit("/"), name).alias("_at"), F.coalesce(telling, F.lit(False)).alias("_telling"), F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.to_json("value")).alias("_json")))
        here = level.where("_telling").select(F.col("_of").alias(key), F.col("_at").alias("pointer"))
        found = here if found is None else found.unionByName(here)
        level = level.where("_json is not null").select("_of", "_at", "_json")
        if not level.limit(1).count():
            return found
