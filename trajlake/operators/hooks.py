"""Hooks: user code on batches of rows, such as an encoder, that says of each row whether it went well."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajlake.session import importable

Hook = Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | dict]


def hooked(rows: DataFrame, set_up: Callable[[], Hook], added: str, rows_per_call: int = 64, bytes_per_call: int = 8 << 20) -> DataFrame:
    """rows with the columns `added` (DDL) that a hook gives, and ok, err.

    set_up() runs once a task, where it may load what the hook needs, and gives the hook: a function of a batch that returns the added
    columns, one row for each.  A call gets at most `rows_per_call` rows and about `bytes_per_call` bytes, a row that is larger alone.  If a
    call fails, its rows are tried one by one: the others of its batch are whole, and a row that fails has nulls, ok false and the kind
    and text of the error in err.  Only set_up() can fail a task."""
    names = T.StructType.fromDDL(added).fieldNames()
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields, T.StructField("ok", T.BooleanType()), T.StructField("err", T.StringType())])
    clash = set(rows.columns) & {*names, "ok", "err"}
    if clash:
        raise ValueError(f"columns that the hook adds are there already: {', '.join(sorted(clash))}")
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [to_arrow_schema(schema).field(n).type for n in names]

    def answer(hook: Hook, batch: pa.RecordBatch) -> pa.RecordBatch:
        given = hook(batch)
        columns = []
        for n, kind in zip(names, kinds):
            column = given[n] if isinstance(given, dict) else given.column(n)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            columns.append(column.cast(kind) if isinstance(column, pa.Array) else pa.array(column, kind))
        if any(len(c) != batch.num_rows for c in columns):
            raise ValueError(f"the hook gave {', '.join(str(len(c)) for c in columns)} values for {batch.num_rows} rows")
        return full(batch, columns, True, None)

    def full(batch: pa.RecordBatch, columns: list[pa.Array], ok: bool, err: str | None) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([ok] * n, pa.bool_()), pa.array([err] * n, pa.string())], names=[*batch.schema.names, *names, "ok", "err"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hook = set_up()
        for batch in batches:
            rows_ = max(1, min(rows_per_call, bytes_per_call * batch.num_rows // max(batch.nbytes, 1)))
            for a in range(0, batch.num_rows, rows_):
                part = batch.slice(a, rows_)
                try:
                    yield answer(hook, part)
                except Exception:
                    for i in range(part.num_rows):
                        one = part.slice(i, 1)
                        try:
                            out = answer(hook, one)
                        except Exception as e:
                            out = full(one, [pa.nulls(1, k) for k in kinds], False, f"{type(e).__name__}: {e}"[:1000])
                        yield out

    importable(rows.sparkSession)
    return rows.mapInArrow(run, schema)
