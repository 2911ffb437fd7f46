"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many places of a ring of CELLS cells. A row's hash names its cell and belongs to the next shard
clockwise; what a full shard can't take goes on clockwise to the next that has room. The bounds are row counts that sum
to the number of rows (the first shards hold one more where they don't divide), so counts differ by one at most: law
`rows`. With a slack above 0 the bounds are that much larger, fewer rows go on, and fewer move when a shard is added.

The walk is done by counts: rows of each cell are counted (CELLS numbers, whatever the number of rows), the driver lets
whole runs of rows flow round the ring, and the outcome - for each cell the shards that its rows go to, in order of
their rank inside the cell, and the first slot of each run - is a table of CELLS rows and a few runs more. A cell's rows
are ranked in PARTS parts, dealt by a hash of the whole row and its place in the table, and the parts' counts are added
up; so rows of one id, or without one, which all are in one cell, are not one task's work.

Sizes, checksums and hashes are Spark's own functions: no row passes through Python.

Defined results: a null text has size 1 and CRC 0, as an empty one; a null id hashes as a value of its own; repeated
rows each take a slot, in any order among themselves; a table without rows gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.runtime import cut, ship

#: Cells of the ring, and a shard's places on it.
CELLS = 1 << 14
PLACES = 128
#: Parts that a cell's rows are ranked in.
PARTS = 64


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


def ring(shards: int, places: int = PLACES, cells: int = CELLS) -> np.ndarray:
    """For each cell the shard that owns it: that of the first place at or after it. A shard's places never depend on how many others there are."""
    at = sorted((_mixed(_mixed(s + 1) + p * 0x9E3779B97F4A7C15 & (1 << 64) - 1) % cells, _mixed(s * 1_000_003 + p), s) for s in range(shards) for p in range(places))
    owner = np.full(cells, -1)
    for cell, _, s in at:
        if owner[cell] < 0:
            owner[cell] = s
    nxt = next(int(owner[c]) for c in range(cells) if owner[c] >= 0)
    for c in range(cells - 1, -1, -1):
        nxt = int(owner[c]) if owner[c] >= 0 else nxt
        owner[c] = nxt
    return owner


def bounds(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """How many rows each shard may hold."""
    even = np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)
    return even + np.ceil(even * slack).astype(np.int64)


def walk(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs (cell, first rank, shard, number of rows): each cell's rows in the first shard clockwise that has room.

    In a turn all rows that are under way ask the shard they stand at; it takes them in the order of cells while it has
    room. The rest go on to the next shard clockwise with room. Every turn fills a shard or is the last.
    """
    cells, shards = len(counts), len(room)
    room, after = room.copy(), np.arange(1, cells + 1) % cells
    change = owner != owner[after]  # the last cell of a place
    under_way = [(c, c, 0, int(n)) for c, n in enumerate(counts) if n]  # (home, where, first rank, rows)
    runs: list[tuple[int, int, int, int]] = []
    while under_way:
        rest = []
        for home, where, first, n in under_way:
            s = int(owner[where])
            took = min(n, int(room[s]))
            room[s] -= took
            if took:
                runs.append((home, first, s, took))
            if took < n:
                rest.append((home, where, first + took, n - took))
        if rest and not room.any():
            raise ValueError("the bounds hold fewer rows than there are")
        following = np.full(cells, -1)  # the next cell clockwise that belongs to a shard with room
        if rest:
            seen = -1
            for c in range(2 * cells - 1, -1, -1):
                if change[(c - 1) % cells] and room[owner[c % cells]]:
                    seen = c % cells
                if c < cells:
                    following[c] = seen if not room[owner[c]] else c
        under_way = [(home, int(following[where]), first, n) for home, where, first, n in rest]
    return sorted(runs)


def assign(df: DataFrame, shards: int = 8, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES, cells: int = CELLS) -> DataFrame:
    """id, size (UTF-8 bytes and 1), text_crc32, shard and slot (0, 1, ... in each shard) of every row.

    The text is read once, for its size and CRC; a narrow table in the shared folder serves both the counts and the ranks.
    """
    spark = ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")).withColumn("within", F.xxhash64("id", "text_crc32", "size", F.monotonically_increasing_id()))
    rows = cut(rows.withColumn("part", F.pmod("within", F.lit(PARTS)).cast("int")), "ring")
    counts = np.zeros(cells, dtype=np.int64)
    for cell, n in rows.groupBy("cell").count().collect():  # CELLS rows at most
        counts[cell] = n
    runs = walk(counts, ring(shards, places, cells), bounds(int(counts.sum()), shards, slack))
    filled, plan = [0] * shards, []
    for cell, first, shard, n in runs:
        plan.append((cell, first, first + n, shard, filled[shard]))
        filled[shard] += n
    kinds = T.StructType([T.StructField("cell", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("first", "stop")] + [T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])
    plan_df = spark.createDataFrame(plan, kinds)  # CELLS and a few rows more: bounded, whatever the input
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("rows"))  # CELLS x PARTS rows at most
    before = parts.select("cell", "part", (F.sum("rows").over(Window.partitionBy("cell").orderBy("part")) - F.col("rows")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("within", "id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("nth", rank).join(before, ["cell", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    here = (ranked["cell"] == plan_df["cell"]) & (ranked["rank"] >= plan_df["first"]) & (ranked["rank"] < plan_df["stop"])
    return ranked.join(F.broadcast(plan_df), here).select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
