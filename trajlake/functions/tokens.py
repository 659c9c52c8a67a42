"""Token ids of a given vocabulary, at a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.text import canonical, clean, collapse
from trajlake.session import importable

#: How a text is cleaned first, by name.
CLEAN = {None: lambda x: x, "whitespace": lambda x: collapse(clean(x)), "lower": lambda x: F.lower(collapse(clean(x))), "canonicalize": lambda x: canonical(clean(x))}


def tokenized(rows: DataFrame, text: str, vocabulary: str, length: int | None = None, pad_id: int = 0, how: str | None = None) -> DataFrame:
    """rows with ids and mask.  vocabulary: a file of the package tokenizers, which every executor sees; each task loads it once.  With
    `length`, ids are cut or filled up with `pad_id` to it, and mask is 1 where there is a token.  Null is an empty text."""
    from pyspark.sql import types as T

    if how not in CLEAN:
        raise ValueError(f"{how!r} is none of {', '.join(map(str, CLEAN))}")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("ids array<int>, mask array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        for batch in batches:
            ids, mask = [], []
            for e in tokenizer.encode_batch(batch.column("__cleaned").to_pylist()):
                own = e.ids[:length]
                fill = (length or len(own)) - len(own)
                ids.append(own + [pad_id] * fill)
                mask.append([1] * len(own) + [0] * fill)
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in rows_), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int32()))], names=[*rows_, "ids", "mask"])

    importable(rows.sparkSession)
    rows_: list[str] = rows.columns
    cleaned: Column = F.coalesce(CLEAN[how](F.col(text)), F.lit(""))
    return rows.withColumn("__cleaned", cleaned).mapInArrow(run, schema)
