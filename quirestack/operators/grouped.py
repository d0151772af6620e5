"""Order-dependent work on small groups (a page, a question): whole groups as arrays, many to a batch, without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirestack.operators.hierarchy import whole_groups

BATCH_ROWS = 20_000


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[dict[str, np.ndarray]], tuple], made: str) -> DataFrame:
    """``run`` gets the columns of each group in ``order`` and gives columns of ``made``; the keys are put in front.

    Groups have to be small by their nature, like the blocks of a page: a task holds one group and BATCH_ROWS rows.  Null
    numbers arrive as NaN.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(made)])
    kinds = to_arrow_schema(schema)
    names = [c for c in df.columns if c not in keys]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, BATCH_ROWS):
            changed = np.zeros(max(0, t.num_rows - 1), bool)
            for k in keys:
                codes = t.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed |= codes[1:] != codes[:-1]
            first = np.r_[0, np.flatnonzero(changed) + 1]
            columns = {c: t.column(c).to_numpy() for c in names}
            out = [run({c: v[a:z] for c, v in columns.items()}) for a, z in zip(first, np.r_[first[1:], t.num_rows], strict=True)]
            size = np.array([len(x[0]) for x in out])
            heads = [t.column(k).combine_chunks().take(pa.array(np.repeat(first, size))) for k in keys]
            rest = [pa.array(np.concatenate([np.asarray(x[i]) for x in out]), f.type, from_pandas=True) for i, f in enumerate(list(kinds)[len(keys) :])]
            yield pa.RecordBatch.from_arrays([h.cast(f.type) for h, f in zip(heads, kinds, strict=False)] + rest, schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
