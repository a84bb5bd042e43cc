"""Token counts (operator 1): rank-synchronous array merging in Arrow batches, without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlore.llm import wordbpe
from hexlore.llm.hashing import slices


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); null and repeated ids are carried as they are; an empty table
    gives no rows. Only id_col and text_col are read, so further columns of any name are harmless.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_field = T.StructField(id_col, source.schema["id"].dataType)
    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        bpe = wordbpe.load(path)
        for batch in batches:
            counts = np.concatenate([bpe.token_counts(part.to_pylist()) for _, part in slices(batch.column(1))] or [np.empty(0, np.int64)])
            n_bytes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts), pa.array(counts > limit)], names=schema.names)

    return source.mapInArrow(run, schema)
