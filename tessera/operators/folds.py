"""Ordered folds: what a row gets depends on what the rows before it got, so no window can say it.

Rows are dealt by key, sorted within a partition and streamed through a step, batch by batch.  A task holds one batch and
the state of one key, however many rows a key has; a key's rows are read in one task, as each needs the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Step = Callable[[Any, dict[str, Any]], tuple[Any, tuple]]


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str | Column], step: Step, outputs: str, reads: list[str] | None = None) -> DataFrame:
    """rows with the columns of outputs (a DDL string), in the order of order within each combination of keys.

    step(state, row) gives the next state and the row's outputs; state is None at a key's first row.  Null keys are a
    key like any other.  With reads, only these columns are given to step beside the keys; the others pass as they are.
    """
    added = StructType.fromDDL(outputs)
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in (batch if reads is None else batch.select(list(dict.fromkeys([*keys, *reads])))).to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, None
                state, values = step(state, row)
                out.append(values)
            columns = [pa.array([v[i] for v in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    dealt = rows.repartition(*keys).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], *order)
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))
