"""Match two tables cell by cell without ever putting a whole cell into one task.

A cell (an entity, a bucket, or the whole table) may hold a third of all rows. Each side of a cell
is cut into blocks of a bounded number of rows, and every left block meets every right block of the
same cell in a task of its own. The task returns only its best matches, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from reviewlens.operators.grouping import spread
from reviewlens.sources.storage import cut_lineage

#: Rows of a block, and cells whose sizes are broadcast.
BLOCK, FEW_CELLS = 16_384, 16_384


def match_blocks(left: DataFrame, right: DataFrame, cell: Sequence[str], left_id: str, right_id: str,
                 fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
                 left_rows: int = BLOCK, right_rows: int = BLOCK) -> DataFrame:
    """Apply ``fn`` to every pair of blocks of the same cell and union what it returns.

    A cell is named by one or more columns. Blocks are chosen by a hash of the id, so a task that is
    run again after an executor is lost sees the same rows. Every row is sent once for each block that
    it meets, so larger blocks send less. The sizes of up to ``FEW_CELLS`` cells are broadcast, so that
    rows move only once.
    """
    cell = list(cell)
    # New column identities, so that a table may be matched with itself.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])

    def blocks(side: DataFrame, rows: int, name: str) -> DataFrame:
        return side.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))

    grid = cut_lineage(blocks(left, left_rows, "_rows").join(blocks(right, right_rows, "_cols"), cell))
    if grid.count() <= FEW_CELLS:
        grid = F.broadcast(grid)

    def own_block(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count))

    def every_block(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    placed_left = (left.join(grid, cell).withColumn("_i", own_block(left_id, "_rows"))
                   .withColumn("_j", every_block("_cols")).drop("_rows", "_cols"))
    placed_right = (right.join(grid, cell).withColumn("_j", own_block(right_id, "_cols"))
                    .withColumn("_i", every_block("_rows")).drop("_rows", "_cols"))
    keys = [*cell, "_i", "_j"]
    a, b = spread(placed_left, *keys), spread(placed_right, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fn, schema)
