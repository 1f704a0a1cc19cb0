"""Top N items within every group by a secondary sort and a streaming pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values get equal codes; nulls are one value, and so are NaNs."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _same(a: tuple, b: tuple | None) -> bool:
    return b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _first_n(n: int, n_keys: int, ranked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by group, order and item, pass the first N distinct items of each group.

    Between batches only the key of the open group and its at most N items are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        taken: list = []
        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in range(n_keys):
                codes = _codes(b.column(c))
                change[1:] |= codes[1:] != codes[:-1]
            group = np.cumsum(change)
            items = b.column(n_keys)
            codes = _codes(items).astype(np.int64)
            keep = ~pd.Series(group * (codes.max() + 1) + codes).duplicated().to_numpy()
            before = 0
            if _same(tuple(b.column(c)[0].as_py() for c in range(n_keys)), open_key):
                before = len(taken)
                first = group == 0
                if before >= n:
                    keep &= ~first
                else:
                    seen = pc.is_in(items, pa.array(taken, items.type)).to_numpy(zero_copy_only=False)
                    keep &= ~(first & seen)
            count = np.cumsum(keep)
            starts = np.flatnonzero(np.append(True, change[1:]))
            base = np.where(starts > 0, count[starts - 1], 0)
            base[0] -= before
            rank = count - base[group]
            chosen = np.flatnonzero(keep & (rank <= n))
            of_last = pc.take(items, pa.array(chosen[group[chosen] == group[-1]])).to_pylist()
            open_key, taken = tuple(b.column(c)[-1].as_py() for c in range(n_keys)), (taken if group[-1] == 0 and before else []) + of_last
            if len(chosen):
                out = b.take(pa.array(chosen))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rank[chosen].astype(np.int64))], [*b.schema.names, "_rank"]) if ranked else out

    return run


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], item: str, n: int, rank_name: str = "rank_no") -> DataFrame:
    """The `n` best distinct items of every group: `groups`, `rank_name` (long, from 1), `item`, the order columns.

    order: (column, ascending) pairs, best first; remaining ties go to the smallest item. An item that
    stands more than once in a group counts once, with its best row. Rows are sorted by group and order
    within each input partition and only the first `n` items of each group leave it, so a group that owns
    most rows sends at most `n` rows per partition into the shuffle by group; the same pass over the
    sorted partitions after the shuffle gives the ranks. Neither pass holds more of a group than `n` items.

    Null group values form a group of their own. Null order values come last. Rows whose item is null
    are left out, as they name nothing. Repeated rows count once, an empty table gives no rows. Other
    columns of `df` are ignored, whatever their names.
    """
    if len(set([*groups, rank_name, item])) < len(groups) + 2:
        raise ValueError("group, rank and item columns need different names")
    g = [f"g{i}" for i in range(len(groups))]
    o = [f"o{i}" for i in range(len(order))]
    columns = [*(F.col(c).alias(x) for c, x in zip(groups, g, strict=True)), F.col(item).alias("item"), *(F.col(c).alias(x) for (c, _), x in zip(order, o, strict=True))]
    rows = df.select(*columns).where(F.col("item").isNotNull())
    sort = [F.col(x).asc_nulls_first() for x in g]
    sort += [F.col(x).asc_nulls_last() if up else F.col(x).desc_nulls_last() for x, (_, up) in zip(o, order, strict=True)]
    sort.append(F.col("item").asc())
    ranked = T.StructType([*rows.schema.fields, T.StructField("_rank", T.LongType())])
    few = rows.sortWithinPartitions(*sort).mapInArrow(_first_n(n, len(g), False), rows.schema)
    best = few.repartition(*g).sortWithinPartitions(*sort).mapInArrow(_first_n(n, len(g), True), ranked)
    shown = [F.col(x).alias(c) for c, x in zip(groups, g, strict=True)] + [F.col("_rank").alias(rank_name), F.col("item").alias(item)]
    taken = {*groups, rank_name, item}
    shown += [F.col(x).alias(c) for (c, _), x in zip(order, o, strict=True) if c not in taken]
    return best.select(*shown)
