"""Let every row of one side meet every row of a catalog, cell by cell.

The catalog is hashed on its key into blocks and the left side on its key into shards; each left
row is sent once per block, each catalog row once per shard, through an equi-join on both numbers.
So shards x blocks cells share the work, whatever the size of either side. The number of cells
follows the session's parallelism, never an estimate of bytes: the planner does not count the copies
of a catalog, so left to itself it would collect and broadcast all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.session import width


def side(df: DataFrame) -> int:
    """Blocks, and as many shards: their product is at least twice the session's partitions."""
    return math.ceil(math.sqrt(2 * width(df)))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def pack(catalog: DataFrame, key: str, blocks: int) -> DataFrame:
    """`_block`, `_rows`: at most `PACKED` rows or so in one row; the hash spreads unique keys evenly."""
    rows = F.struct(*catalog.columns)
    return catalog.groupBy(block_of(key, blocks).alias("_block")).agg(F.collect_list(rows).alias("_rows"))


#: Catalog rows in one packed array, on average.
PACKED = 4096


def meet(left: DataFrame, catalog: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """Left rows once per block, with the block's rows in the array column `_rows`.

    The number of blocks follows the catalog's row count, so an array stays small.
    """
    blocks = blocks or max(side(catalog), -(-catalog.count() // PACKED))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    return left.withColumn("_block", F.explode(numbers)).join(pack(catalog, key, blocks), "_block").drop("_block")


def place(users: DataFrame, key: str = "user_id") -> DataFrame:
    """Spread the rows by key over a fixed number of partitions; joins with a catalog keep the placement.

    The number is not left to adaptive coalescing: few bytes per user still mean a catalog's worth of
    work. It differs from the session's own number, because an equal partitioning below would be
    reused as it is, coalesced.
    """
    return users.repartition(2 * width(users) + 1, key)


def meet_rows(
    left: DataFrame, catalog: DataFrame, key: str, cells: DataFrame | None = None, left_key: str = "user_id"
) -> DataFrame:
    """Every left row with every catalog row, for operators that look at each pair once.

    The pairs are consumed where they arise (an aggregate per left row, a filter, the result
    itself); they are not sorted, buffered or shuffled. `cells` (`left_key`, `_block` and more) has
    what else belongs to a left row in each block; see `rated_cells`.
    """
    n = side(left)
    if cells is None:
        sent = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    else:
        more = [c for c in cells.columns if c != left_key]
        sent = left.drop(*more).join(place(cells, left_key), left_key)
    sent = sent.withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), left_key), F.lit(n)).cast("int"))
    shards = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = catalog.withColumn("_block", block_of(key, n)).withColumn("_shard", shards)
    keys, parts = ["_shard", "_block"], 2 * width(left) + 1
    # A task holds the catalog rows of its cells; the left rows stream past them.
    return sent.repartition(parts, *keys).join(placed.repartition(parts, *keys).hint("shuffle_hash"), keys).drop(*keys)


def rated_cells(users: DataFrame, ratings: DataFrame) -> DataFrame:
    """`user_id`, `_block`, `_rated`: what a user rated among the items of a block, a row for every block.

    A set holds at most a block of the catalog, however much one user rated.
    """
    n = side(users)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sets = ratings.select("user_id", "item", block_of("item", n).alias("_block")).groupBy("user_id", "_block").agg(
        F.collect_set("item").alias("_rated")
    )
    return users.select("user_id", numbers.alias("_block")).join(sets, ["user_id", "_block"], "left")
