"""Token counts by prefix dynamic programming.

``count_tokens`` gives each text's exact number of tokens and, for any token
budgets, how many of its bytes the first so many tokens cover, from the counts
of prefixes; nothing is encoded again. Each worker keeps a bounded memo of the
pieces it has met.

Defined cases: a null or empty text has 0 tokens and 0 bytes; other columns,
whatever their names, are left alone; repeated rows each get their row; an empty
table gives an empty result. Memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import released
from threadlake.llm import bpe

BATCH_ROWS = 512


@lru_cache(maxsize=2)
def counter(name: str) -> bpe.PrefixCounter:
    return bpe.PrefixCounter(bpe.Vocabulary(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", budgets: tuple[int, ...] = (512,)) -> DataFrame:
    """key, n_bytes, n_tokens and, for each budget b, fit_bytes_b, for every row of docs."""
    names = [f"fit_bytes_{b}" for b in budgets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                sizes, counts, fits = [], [], [[] for _ in budgets]
                for value in part.column(1):
                    t = value.as_py() or ""
                    n, size = tool.count(t), len(t.encode())
                    sizes.append(size)
                    counts.append(n)
                    for b, out in zip(budgets, fits, strict=True):
                        out.append(size if n <= b else tool.fitting_bytes(t, b))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, counts, *fits))], names=["key", "n_bytes", "n_tokens", *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, n_tokens bigint" + "".join(f", {n} bigint" for n in names)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(released(run), schema).withColumnRenamed("key", key)
