"""Running folds over an order of any length, without a task that sees all of it.

The order's integers are cut into blocks of 2^BITS, blocks into blocks of blocks,
until one is left. Within a block a window does the work; what stands before the
block comes from the same fold over the blocks' totals, one level up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.steps import stored

BITS = 10
FOLDS = {"sum": F.sum, "max": F.max}


def before(rows: DataFrame, at: str, what: Mapping[str, tuple[str, str]], by: Sequence[str] = (), ties: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """rows with one column more for each ``name: (column, "sum" or "max")``: its fold over the rows before.

    Before means: of equal ``by`` and less (at, *ties). at is a bigint; at and by hold
    no nulls. A sum of nothing is 0, a maximum of nothing null. A task gets
    at most 2^bits integers of one ``by``; only rows with equal ``at`` add to that.
    The number of levels follows from the span of ``at``: four for 10^12 integers.
    """
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    return _level(rows, at, what, list(by), list(ties), bits, span["lo"] or 0, span["hi"] or 0)


def _level(rows: DataFrame, at: str, what: Mapping[str, tuple[str, str]], by: list[str], ties: list[str], bits: int, lo: int, hi: int) -> DataFrame:
    first, blocks = lo >> bits, (hi >> bits) - (lo >> bits)
    dealt = rows.withColumn("_block", F.shiftright(at, bits) - F.lit(first))  # shifted before it is moved to 0, so that it fits
    w = Window.partitionBy(*by, "_block").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({name: FOLDS[how](column).over(w) for name, (column, how) in what.items()})
    if blocks:
        totals = dealt.groupBy(*by, "_block").agg(*(FOLDS[how](column).alias(f"_{name}") for name, (column, how) in what.items())).withColumnRenamed("_block", "_at")
        if blocks >> bits:  # more levels follow: they start from here, not from the rows
            totals = stored(totals)
        upper = _level(totals, "_at", {f"_up_{name}": (f"_{name}", how) for name, (_, how) in what.items()}, by, [], bits, 0, blocks)
        inner = inner.join(upper.select(*by, F.col("_at").alias("_block"), *(f"_up_{name}" for name in what)), [*by, "_block"])
        inner = inner.withColumns({name: F.coalesce(name, F.lit(0)) + F.coalesce(f"_up_{name}", F.lit(0)) if how == "sum" else F.greatest(name, f"_up_{name}") for name, (_, how) in what.items()})
    else:
        inner = inner.withColumns({name: F.coalesce(name, F.lit(0)) for name, (_, how) in what.items() if how == "sum"})
    return inner.select(*rows.columns, *what)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """rows with their place from 0 in an order of any columns, nulls first.

    They are sorted by ranges and written; the driver sees one count for each partition.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    there = stored(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    starts, n = {}, 0
    for r in there.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts[r["p"]] = n
        n += r["count"]
    first = rows.sparkSession.createDataFrame(list(starts.items()), "_p bigint, _first bigint")
    return there.withColumn("_p", part).join(F.broadcast(first), "_p").select(*rows.columns, (F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias(name))


def tree_key(column: str):
    """A text column without nulls, in the same order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit("-"))
