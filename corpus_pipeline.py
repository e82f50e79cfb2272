"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import mixing, ngram_join, packing, repeats, toxicity
from threadlake.llm.steps import checkpoint_folder, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of removed documents up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def _unique(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return not counts.where("n > 1 or doc_id is null").limit(1).count()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5.

    A null text is scored as an empty one; rows with equal texts go or stay
    together, whatever their keys; columns that documents doesn't have are left
    out. Without labelled rows the words that are known beforehand decide. An empty
    table stays empty.
    """
    model = toxicity.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8 or more.

    It is the one with the least key. Rows that share a key, or lack one, are
    told apart by a digest of all their columns; wholly equal rows are one. A text
    without words is near to nothing and stays.
    """
    docs = docs.select(*COLUMNS)
    if _unique(docs):
        keyed, key = docs, "doc_id"
    else:
        keyed, key = docs.dropDuplicates().withColumn("row_key", F.sha2(F.to_json(F.struct(*COLUMNS)), 256)), "row_key"
    groups = ngram_join.jaccard_components(keyed, key, "text", n=5, share=(80, 100))
    gone = groups.where(F.col("component_id") != F.col(key)).select(F.col(key).alias("gone"))
    gone = settled(gone)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return keyed.join(side, F.col(key) == F.col("gone"), "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that occur earlier.

    A character of which a byte goes, goes whole. n_chars is counted anew. A null
    text becomes an empty one; rows with equal key and text are cut alike.
    """
    cut = repeats.remove_repeats(docs, carry=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them, in whole copies.

    The one document of a source that the mix takes in part is taken whole with
    the odds of that part. A null source is one of its own, last in order; a null
    or empty text has size 0 and is never taken; rows with one key, or none, are
    told apart by source, size and a number; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    drawn = F.pmod(F.xxhash64(F.lit(29), "doc_id", "nth"), F.lit(1 << 20)) / float(1 << 20)
    whole = F.when((F.col("part") > 0) & (drawn * F.col("size") < F.col("part")), 1).otherwise(0)
    plan = mixing.mix(docs).select(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "nth", "doc_id", "part", "size", "copies")
    plan = plan.withColumn("times", F.col("copies") + whole).where("times > 0").select("k", "s", "z", F.col("nth").alias("m"), "times")
    if _unique(docs):
        joined = docs.join(plan, F.col("doc_id") == F.col("k"))
    else:
        numbered = mixing.numbered(docs)
        joined = numbered.join(plan, F.col("doc_id").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("nth") == F.col("m")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences.

    A null text is empty and gives its end mark alone; repeated rows and keys are
    documents of their own; a text of any length is cut into as many pieces as it
    needs; an empty table has no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned score, nor the suffix comparison, nor the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written to the shared folder.

    The last stage reads what the one before has written, so the folder stays
    until its owner cleans the checkpoint directory.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
