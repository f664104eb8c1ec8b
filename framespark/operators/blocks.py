"""Windows over the frames of an item without a task per item.

``blocked`` serves windows of frame *numbers*: a block also gets the frames within a margin on either side, and
only a block's own rows are kept. ``windowed`` serves windows of *rows*, whatever frames are missing: rows
inside a block are finished there; those near its ends go up, with as many neighbours as they need, to a level of far
longer blocks, and what is near the ends of these to the item. Each level has a small fraction of the rows of the one
below, so an item that holds a third of all rows is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK = 8192
#: Blocks of one level in a block of the next.
SPAN = 512


def windowed(df: DataFrame, reach: int, build: Callable[[DataFrame, WindowSpec], DataFrame], item: str = "item", frame: str = "frame") -> DataFrame:
    """``build(rows, window)`` over all rows, ``window`` being the item's rows in the order of ``frame``.

    ``build`` adds columns whose value at a row depends on rows at most ``reach`` before or after it (by count, not by
    frame number), or, where there are fewer than that, on the item's first or last row. It must keep all rows and columns.
    The shuffle by (item, block) is read twice, by the finished rows and by those that go up; ``4 * reach`` rows a block go up.
    """
    rows, done = df.withColumn("_todo", F.lit(True)), []
    for size in (BLOCK, BLOCK * SPAN):
        d = rows.withColumn("_block", F.floor(F.col(frame) / size))
        w = Window.partitionBy(item, "_block").orderBy(frame)
        ends = lambda r: F.lag(F.lit(True), r).over(w).isNull() | F.lead(F.lit(True), r).over(w).isNull()  # noqa: B023, E731
        done.append(build(d.withColumn("_near", ends(reach)), w).where("_todo and not _near").drop("_near", "_block"))
        rows = d.withColumns({"_near": ends(reach), "_far": ends(2 * reach)}).where("_far")
        rows = rows.withColumn("_todo", F.col("_todo") & F.col("_near")).drop("_near", "_far", "_block")
    done.append(build(rows, Window.partitionBy(item).orderBy(frame)).where("_todo"))
    return reduce(DataFrame.unionByName, done).drop("_todo")


def blocked(df: DataFrame, margin: int, frame: str = "frame", block: int | None = None) -> DataFrame:
    """Rows by block, ``_block`` and ``_own`` added; rows within ``margin`` frame numbers of a neighbour block are in both."""
    block = block or BLOCK
    low, high = F.floor((F.col(frame) - margin) / block), F.floor((F.col(frame) + margin) / block)
    return df.withColumn("_block", F.explode(F.sequence(low, high))).withColumn("_own", F.floor(F.col(frame) / block) == F.col("_block"))


def groups(batches, keys: tuple[str, ...]):
    """Yields the rows of each group as an Arrow table, from batches in which a group's rows are consecutive."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            new |= codes[1:] != codes[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def matrix(column):
    """An Arrow column of lists of one width as a matrix of doubles."""
    import numpy as np

    lists = column.combine_chunks()
    lists = lists.chunk(0) if hasattr(lists, "chunks") else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def vectors(values, kind="float64"):
    """A matrix as an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa

    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel().astype(kind)))
