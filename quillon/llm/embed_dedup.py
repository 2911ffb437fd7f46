"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are turned to unit length and to the axes of their second moments (one d x d sum over all rows), so the leading
dimensions hold most of every product. Rows with equal label and dimension are put in the order of the first axis, in
GRID cells, and dealt into blocks of about a tile's side. Linked vectors differ by sqrt(2 - 2 threshold) at most, along
that axis too, so a row meets just the blocks whose cells lie within that reach; a pair of blocks is one tile, a group
of bounded size, worked off in strips. In a strip, products of the leading dimensions are summed first; what the rest
can add is bounded by the product of the suffix norms, and rows and columns without a pair that can still reach the
threshold drop out. Survivors are decided by the cosine of the original vectors in double precision.

Equal vectors of a label are compared once, as one with a weight, and never paired among themselves; a tile returns each
vector's weighted number of links and a spanning set of them, so its output is no larger than its input. Inside, groups
of equal vectors have numbers of their own; ids only name the outcome.

Defined results: a row with a null label, or a vector that is null, empty, zero or holds null or non-finite components,
links with nothing; vectors of different dimensions don't link. A component is named by its least id that isn't null, for
rows without an id too, and has a null name if none has one; rows without an id count as links of others and are never
kept. Rows of equal id are told apart by label and vector: each has its own links and component, and repeated rows link
with each other. A table without rows gives none.

Every pair within reach has to meet, as the result is exact for any data: work grows with the square of a label's
distinct vectors (copies with that over a tile's side, which grows with the root of their number up to MOST_TILE); the
order and the suffix bound make the factor small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.components import joined
from quillon.runtime import cut, ship

#: Vectors of a block, about, at least and at most; vectors of a strip; the leading dimensions after which bounds are taken.
TILE, MOST_TILE, STRIP, STEPS = 1024, 8192, 2048, (8, 16, 32)
#: Cells of the first axis, from -1 to 1.
GRID = 4096
_EPS = 1e-6


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        vec, dim = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        flat, offsets = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(dim)]
        for d in np.unique(dim).tolist():
            x = np.stack([flat[offsets[k] : offsets[k] + d] for k in np.flatnonzero(dim == d)])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0.0) + x.T @ x
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int64()), pa.array(s.ravel(), pa.float64())], ["dim", "at", "v"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension d the d x d matrix whose columns are the axes, the strongest first. vectors: vec, dim."""
    sums = vectors.mapInArrow(_moments, "dim int, at bigint, v double").groupBy("dim", "at").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():  # the square of each dimension, whatever the number of rows
        found.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["at"]] = r["v"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in found.items()}


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of rows of a and b whose cosine reaches the threshold; with i < j if b is a itself."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total, done = np.zeros((len(a), len(b))), 0
    for stop in [s for s in STEPS if s < a.shape[1]]:
        total += ra[rows, done:stop] @ rb[cols, done:stop].T
        done = stop
        left = np.linalg.norm(ra[rows, stop:], axis=1)[:, None] * np.linalg.norm(rb[cols, stop:], axis=1)[None]
        can = total + left >= threshold - _EPS
        if same:
            can &= rows[:, None] < cols[None]
        kr, kc = can.any(1), can.any(0)
        if not kr.any():
            return rows[:0], cols[:0]
        rows, cols, total = rows[kr], cols[kc], total[np.ix_(kr, kc)]
    total += ra[rows, done:] @ rb[cols, done:].T
    i, j = np.nonzero(total >= threshold - _EPS)
    i, j = rows[i], cols[j]
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    sure = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):  # the deciding cosine, from the vectors as they are
        s = slice(k, k + 100_000)
        sure[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) / (na[i[s]] * nb[j[s]]) >= threshold
    return i[sure], j[sure]


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that links i-j connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, one, two = key[1], key[2], key[3]
        rows = rows.sort_values("rep", kind="stable")
        vec = np.array(rows["vec"].tolist(), dtype=np.float64).reshape(len(rows), dim)
        rep, weight, block = rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
        own, other = np.flatnonzero(block == one), np.flatnonzero(block == two)
        found = [(own[:0], other[:0])]
        for a in range(0, len(own), STRIP):
            for b in range(a if one == two else 0, len(other), STRIP):
                x, y = own[a : a + STRIP], other[b : b + STRIP]
                i, j = close_pairs(vec[x], vec[y], axes[dim], threshold, one == two and a == b)
                found.append((x[i], y[j]))
        i, j = (np.concatenate(k) for k in zip(*found))
        links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        root = _spanning(len(rows), i, j)
        hit = links > 0
        return pd.DataFrame({"rep": rep[hit], "links": links[hit].astype(np.int64), "root": rep[root[hit]]})

    return run


def _in_cells(axes: dict[int, np.ndarray], schema: str):
    """Rows (..., vec, dim) with the cell of the first axis that each vector, at unit length, lies in."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, dim = b.column(names.index("vec")), b.column(names.index("dim")).to_numpy(zero_copy_only=False)
            flat, offsets = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(dim)]
            at = np.zeros(b.num_rows)
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                x = np.stack([flat[offsets[k] : offsets[k] + d] for k in rows])
                at[rows] = x @ axes[d][:, 0] / np.linalg.norm(x, axis=1)
            cell = np.clip(np.floor((at + 1) * (GRID / 2)), 0, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names)

    return run


def _tiles(reps: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """rep, links, root of every vector with a link in a tile, for all tiles."""
    kind = dict(reps.dtypes)["vec"]
    schema = f"label string, dim int, rep bigint, n bigint, vec {kind}, cell int"
    placed = reps.select("label", "dim", "rep", "n", "vec").mapInArrow(_in_cells(axes, schema), schema)
    reach = math.ceil(math.sqrt(max(0.0, 2 - 2 * threshold)) * GRID / 2) + 1
    own = Window.partitionBy("label", "dim")  # GRID rows at most
    before = F.sum("rows").over(own.orderBy("cell")) - F.col("rows")
    side = F.greatest(F.lit(tile), F.least(F.lit(MOST_TILE), F.sqrt(F.sum("rows").over(own)).cast("int")))
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("rows")).select("label", "dim", "cell", F.floor(before / side).cast("int").alias("first"), F.floor((before + F.col("rows") - 1) / side).cast("int").alias("last"))
    low = F.min("first").over(own.orderBy("cell").rangeBetween(-reach, Window.unboundedFollowing))
    high = F.max("last").over(own.orderBy("cell").rangeBetween(Window.unboundedPreceding, reach))
    cells = cells.select("*", low.alias("low"), high.alias("high"))
    dealt = placed.join(cells, ["label", "dim", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("last") - F.col("first") + 1).cast("int"))
    meets = dealt.withColumn("with", F.explode(F.sequence("low", "high")))
    keys = ["label", "dim", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two")]
    return meets.select(*keys, "block", "rep", "n", "vec").groupBy("label", "dim", "one", "two").applyInPandas(_tile(axes, threshold), "rep bigint, links bigint, root bigint")


def link_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    # equal vectors of a label find each other by 128 bits, so only numbers are joined
    key = [F.xxhash64(F.lit(k), "label", "vec").alias(f"key{k}") for k in (1, 2)]
    reps = rows.where(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    reps = cut(reps.select(*key, "label", "vec", "n", "first", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("rep")), "vectors")
    axes = principal_axes(reps.select("vec", "dim"))
    tiles = cut(_tiles(reps, axes, threshold, tile), "tiles")
    links = tiles.groupBy("rep").agg(F.sum("links").alias("links"))
    ends = tiles.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = joined(joined(None, ends.groupBy("a").agg(F.min("b").alias("b"))), ends)
    of_rep = reps.select("key1", "key2", "rep", "n", "first").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = cut(of_rep.select("key1", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"), "first"), "groups")
    names = of_rep.groupBy("root").agg(F.min("first").alias("component_id"))
    of_rep = of_rep.join(names, "root").select("key1", "key2", "n_links", "component_id")
    whole = rows.where(usable).select("vec_id", *key).join(of_rep, ["key1", "key2"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
