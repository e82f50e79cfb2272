"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words: the mix's size, shared by the
sources' weights, none above ``cap`` times its own size, and what the cap cuts
off shared anew among the others (the level that fills up is found in closed
form, from running sums over the sources ordered by cap per weight).

Every document of a source is then due the same expected number of copies,
target / size. Its whole part is sure. The fractional parts are settled by
pivotal rounding: two documents with masses (probability times words) meet, and
mass moves from one to the other, in either direction with the odds that keep
both expectations, until one of them has none left or is full. So the source's
words stay what they were. Documents meet in blocks of about ``BLOCK``, split by
a hash of the key; the one document that a block leaves undecided goes to the
next level of a reduction tree, until one is left in each source, which takes
the remaining words as a partial copy. Draws come from hashes of the keys, so
reruns agree, whatever the layout of the input.

Defined cases: a null source is a source of its own, ordered last; a null or
empty text has size 0 and gives no words; a source without words has target 0;
repeated rows with one key are documents of their own (they are told apart by a
number within their key); a null key is kept; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import mixed
from threadlake.llm.steps import settled

BLOCK = 4096
#: Sources up to which their table of targets is broadcast.
BROADCAST_SOURCES = 20_000
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    spaces = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaces, " +"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source_size and target of each row of sizes(source, source_size).

    The rows are as many as there are sources; the windows run over them alone.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    leveled = weighed.select("*", F.coalesce(F.sum("most").over(filled), F.lit(0.0)).alias("full"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("open"), (share * F.sum("source_size").over(everything)).alias("total"))
    level = leveled.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # The sources before the first whose cap lies above the level are full.
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("at"), "rank", "level"))).over(everything)
    return level.withColumn("first", first).select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("most"))).alias("target"))


def _draws(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) ^ np.uint64(mixed(np.array([seed], np.uint64))[0])) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pivot(mass: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Settles masses 0 <= mass <= size in turn; what they become and who is left (-1: none).

    The one that is left keeps a mass strictly between; all others have none or are full.
    """
    out, left = mass.astype(np.float64).tolist(), -1
    for i, (u, full_b) in enumerate(zip(draw.tolist(), size.tolist(), strict=True)):
        b = out[i]
        if b <= 0 or b >= full_b:
            continue
        if left < 0:
            left = i
            continue
        a, full_a = out[left], float(size[left])
        give, take = min(a, full_b - b), min(b, full_a - a)
        if u * (give + take) < take:  # from left to i
            a, b = (0.0, b + a) if a <= full_b - b else (a - (full_b - b), full_b)
        else:  # from i to left
            a, b = (a + b, 0.0) if b <= full_a - a else (full_a, b - (full_a - a))
        out[left], out[i] = a, b
        if not 0 < a < full_a:
            left = i if 0 < b < full_b else -1
    return np.array(out), left


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size and nth, the number of a row among those of equal key, source and size."""
    sized = docs.withColumn("size", word_count(F.col(text)))
    return sized.withColumn("nth", F.row_number().over(Window.partitionBy(key, source, "size").orderBy(text)).cast("long"))


SCHEMA = "source string, uid bigint, size bigint, mass double, block bigint, done boolean"


def _level(seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["uid", "size"], kind="stable")
        size = frame["size"].to_numpy(np.float64)
        mass, left = pivot(frame["mass"].to_numpy(), size, _draws(frame["uid"].to_numpy(np.int64), seed))
        done = np.ones(len(frame), bool)
        if left >= 0:
            done[left] = False
        return frame.assign(mass=mass, done=done)[["source", "uid", "size", "mass", "block", "done"]]

    return run


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """key, size, source_size, target, taken, copies, part, source and nth of each row of docs.

    copies: whole copies. part: words of one further, partial copy; over 0 in
    one document of each source at most. taken = copies * size + part.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    # Equal (key, source, size) rows are told apart by a number; one key can repeat often, so it is dealt with its size.
    rows = rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    rows = settled(rows)
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n"))
    per_source = settled(per_source)
    targets = source_targets(per_source.select("source", "source_size"), weights, share, cap)
    plan = targets.join(per_source.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = settled(plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")))
    each = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).withColumn("uid", F.xxhash64("key", "source", "size", "nth"))
    # A row per source: broadcast where they are few, else left to the optimizer.
    side = plan.withColumnRenamed("source", "ps")
    side = F.broadcast(side) if plan.count() <= BROADCAST_SOURCES else side
    joined = each.join(side, F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    whole = F.floor(F.col("rate")).cast("long")
    due = joined.withColumn("whole", whole).withColumn("mass", (F.col("rate") - F.floor("rate")) * F.col("size"))
    due = settled(due.select("key", "source", "size", "source_size", "target", "nth", "uid", "whole", "mass", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.col("blocks")).alias("block")))
    open_rows = due.where("mass > 0").select("source", "uid", "size", "mass", "block", F.lit(False).alias("done"))
    level, parts = 0, []
    while True:
        done = settled(open_rows.groupBy("source", "block").applyInPandas(_level(seed + level), SCHEMA))
        parts.append(done.where("done").select("source", "uid", "size", "mass"))
        rest = done.where("not done")
        level += 1
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0]
        if not most or most == 1:
            parts.append(rest.select("source", "uid", "size", "mass"))
            break
        # The next level's blocks each join BLOCK neighbours.
        open_rows = rest.withColumn("block", F.floor(F.col("block") / block).cast("long")).withColumn("done", F.lit(False))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    words = result.select(F.col("source").alias("ws"), F.col("uid").alias("wu"), F.col("size").alias("wz"), F.col("mass").alias("settled"))
    out = due.join(words, (F.col("uid") == F.col("wu")) & (F.col("size") == F.col("wz")) & F.col("source").eqNullSafe(F.col("ws")), "left").withColumn("got", F.coalesce("settled", F.lit(0.0)))
    full = (F.col("got") >= F.col("size")) & (F.col("size") > 0)
    out = out.withColumn("copies", F.col("whole") + full.cast("long")).withColumn("part", F.when(full, F.lit(0)).otherwise(F.round("got")).cast("long"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part", "source", "nth")
