"""Near-duplicate embeddings: exact cosine links inside labels by PCA-ordered tiles with early stopping.

Vectors are turned onto principal axes, so that leading coordinates hold most of every product. A label's vectors
are cut into strips along the axis on which they spread most around the labels' means, and strips into tiles along
the next one; two tiles farther apart on these axes than linked vectors can be are never compared. Inside a
pair of tiles products are summed over leading axes first, and pairs whose sum plus the product of the rest's
norms stays under the threshold are dropped; what is left is decided by the cosine of the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealmark.operators.components import connected_components
from sealmark.scratch import written

#: Vectors and bytes (as doubles) a tile holds at most, and bins along an axis from which strips and tiles are made.
TILE, TILE_BYTES, BINS = 4096, 32 << 20, 64
#: Rows of a tile that are compared with the other tile at once.
BLOCK = 1024
#: Leading axes summed before each test.
STEP = 16
#: Vectors that the axes are fitted on, in the order of a hash of their ids. Links are exact on any axes.
AXES_ROWS = 4096
#: Rows of a table of bins that is broadcast (about 40 bytes each); a longer one is joined by a shuffle.
BROADCAST_BINS = 100_000
_SLACK = 1e-9


def principal_axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension: orthonormal axes by falling second moment, and two directions of most variance around label means.

    They are fitted on at most AXES_ROWS of the vectors; a dimension that isn't among them keeps its own axes.
    """
    sample = vectors.orderBy(F.xxhash64("class_id"), "class_id").limit(AXES_ROWS).select("v", F.xxhash64("label").alias("of")).toArrow()
    axes = {}
    of = sample["of"].to_numpy()
    for d, x, rows in _matrices(sample["v"]):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        names, code = np.unique(of[rows], return_inverse=True)
        means = np.zeros((len(names), d))
        np.add.at(means, code, u)
        spread = u - (means / np.bincount(code)[:, None])[code]
        order = np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :2]
        axes[d] = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy(), order.copy() if d > 1 else np.ones((1, 2)) * [1, 0]
    return axes


def _matrices(lists: pa.Array):
    """The vectors of a list column by dimension: (d, matrix of doubles, row numbers)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), flat[starts[rows][:, None] + np.arange(d)[None, :]], rows


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> np.ndarray:
    """Boolean matrix: which rows of a and b have a cosine of at least threshold."""
    ua, ub = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    ya, yb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    ra, rb = (np.sqrt(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]) for y in (ya, yb))
    return np.concatenate([_block_links(ua[k : k + BLOCK], ub, ya[k : k + BLOCK], yb, ra[k : k + BLOCK], rb, threshold) for k in range(0, len(a), BLOCK)])


def _block_links(ua, ub, ya, yb, ra, rb, threshold: float) -> np.ndarray:
    """linked() for unit vectors u, their coordinates y and the norms r of what is left from each axis on."""
    d, at = ya.shape[1], 0
    sums = np.zeros((len(ua), len(ub)))
    out = np.zeros(sums.shape, bool)
    i = j = None
    while at < d:
        to = min(d, at + STEP)
        if i is None:
            sums += ya[:, at:to] @ yb[:, at:to].T
            rest = np.outer(ra[:, to], rb[:, to]) if to < d else 0.0
            alive = sums + rest >= threshold - _SLACK
            count = int(alive.sum())
            if not count:
                return out
            if count < alive.size // 16:  # few pairs are left: go on with those alone
                i, j = np.nonzero(alive)
                sums = sums[i, j]
        else:
            sums = sums + np.einsum("ij,ij->i", ya[i, at:to], yb[j, at:to])
            alive = sums + (ra[i, to] * rb[j, to] if to < d else 0.0) >= threshold - _SLACK
            i, j, sums = i[alive], j[alive], sums[alive]
            if not len(i):
                return out
        at = to
    if i is None:
        return ua @ ub.T >= threshold
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[p, q] = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
    return out


def _over_links(found: np.ndarray, values: np.ndarray, how) -> np.ndarray:
    """how(values of the rows linked with it) for every row; block by block."""
    return np.concatenate([how(found[k : k + 256], values) for k in range(0, len(found), 256)])


def _least(block: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.where(block, values[None, :], np.iinfo(np.int64).max).min(1)


def _roots(left: np.ndarray, right: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row of left and right reaches by the links found between them."""
    while True:
        new_left = np.minimum(left, _over_links(found, right, _least))
        new_right = np.minimum(right, _over_links(found.T, new_left, _least))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def embedding_near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept (it is its own).

    Two vectors are linked when their labels are equal and not null and the cosine in doubles is at least
    threshold. Equal vectors of a label are compared as one and counted as many. Null or zero vectors, those with
    null, NaN or infinite components and those without a label have no links; vectors of different length don't
    link. A null id: no links, component_id null, kept. Rows that repeat an id count as vectors of their own. Ties
    don't matter: components don't depend on order; an empty table gives no rows. Other columns are not read.
    Every pair of tiles that may hold links is compared, so the work inside a label that its axes don't cut grows
    with the square of its vectors; they are shipped as they came (floats as floats).
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(ok, F.col("v")))
    classes = written(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")), "classes")
    axes = principal_axes(classes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, 2))
            for d, x, at in _matrices(batch.column(2)):
                p[at] = x @ (axes[d][1] if d in axes else np.eye(d, 2)) / np.linalg.norm(x, axis=1, keepdims=True)
            bins = np.clip(np.floor((p + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins[:, 0]), pa.array(bins[:, 1])], [*batch.schema.names, "bin1", "bin2"])

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("class_id", "label", "v", "n").mapInArrow(project, f"class_id long, label {label}, v array<{kind}>, n long, bin1 int, bin2 int")
    placed = written(placed, "placed")
    cells = written(placed.groupBy("label", "bin1", "bin2").agg(F.count("*").alias("c")), "cells")
    most = max(256, min(TILE, TILE_BYTES // (8 * max(axes, default=1))))
    # strips of a label along the first axis: as many as tiles in a strip, when all are half full
    strips = cells.groupBy("label", "bin1").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("label").orderBy("bin1").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    total = F.sum("c").over(Window.partitionBy("label"))
    strips = strips.select("label", "bin1", F.floor(upto / F.greatest(total / F.ceil(F.sqrt(total / (most // 2))), F.lit(1))).cast("int").alias("strip"))
    # tiles of a strip along the second; a cell of more vectors than a tile holds is dealt to several by a hash
    bins = cells.join(strips, ["label", "bin1"])
    in_bin = bins.groupBy("label", "strip", "bin2").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("label", "strip").orderBy("bin2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    runs = in_bin.select("label", "strip", "bin2", "c", F.floor(upto / (most // 2)).cast("int").alias("run"))
    runs = runs.select("label", "strip", "bin2", "run", F.ceil(F.sum("c").over(Window.partitionBy("label", "strip", "run")) / most).cast("int").alias("parts"))
    cells = written(bins.join(runs, ["label", "strip", "bin2"]).select("label", "bin1", "bin2", "strip", "run", "parts"), "tiles")
    few = F.broadcast(cells) if cells.count() <= BROADCAST_BINS else cells
    placed = placed.join(few, ["label", "bin1", "bin2"]).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    reach = (2 - 2 * threshold) ** 0.5 + 1e-9
    box = [x for k in (1, 2) for x in (F.min(f"bin{k}").alias(f"lo{k}"), (F.max(f"bin{k}") + 1).alias(f"hi{k}"))]
    tile = (F.col("strip").cast("long") * 2**21 + F.col("run")) * 2**21 + F.col("part")
    tiles = cells.groupBy("label", "strip", "run").agg(*box, F.max("parts").alias("parts"))
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("tile", tile)
    one, two = (tiles.select("label", *(F.col(c).alias(f"{c}_{k}") for c in ("tile", "lo1", "hi1", "lo2", "hi2"))) for k in ("a", "b"))
    gap = lambda k: F.greatest(F.col(f"lo{k}_a") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}_a"), F.lit(0)) * (2 / BINS)
    near = gap(1) * gap(1) + gap(2) * gap(2) <= reach * reach
    pairs = one.join(two, "label").where((F.col("tile_a") <= F.col("tile_b")) & near).select("label", "tile_a", "tile_b")
    side = lambda k, x: F.struct(F.col(k).alias("tile"), F.lit(x).alias("side"))
    sides = F.when(F.col("tile_a") == F.col("tile_b"), F.array(side("tile_a", 1))).otherwise(F.array(side("tile_a", 1), side("tile_b", 2)))
    work_list = pairs.select("label", "tile_a", "tile_b", F.explode(sides).alias("s")).select("label", "tile_a", "tile_b", "s.*")
    dealt = placed.select("label", tile.alias("tile"), "class_id", "v", "n").join(work_list, ["label", "tile"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, own in pdf.groupby(pdf["v"].map(len)):
            own = own.sort_values("class_id")
            left, right = own[own["side"] == 1], own[own["side"] == 2]
            alone = own["alone"].iat[0]
            right = left if alone else right
            if left.empty or right.empty:
                continue
            a, b = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (left, right))
            found = linked(a, b, axes[d][0] if d in axes else None, threshold)
            if alone:
                found |= found.T
                np.fill_diagonal(found, False)
            weighed = lambda block, n: block @ n
            for ids, count, root in zip(
                (left["class_id"], right["class_id"]), (_over_links(found, right["n"].to_numpy(np.float64), weighed), _over_links(found.T, left["n"].to_numpy(np.float64), weighed)),
                _roots(left["class_id"].to_numpy(), right["class_id"].to_numpy(), found),
            ):
                some = count > 0
                out.append(pd.DataFrame({"class_id": ids[some], "links": count[some].astype(np.int64), "root": root[some]}))
                if alone:
                    break
        return pd.concat(out) if out else pd.DataFrame({"class_id": [], "links": [], "root": []}).astype("int64")

    dealt = dealt.select("label", "tile_a", "tile_b", (F.col("tile_a") == F.col("tile_b")).alias("alone"), "side", "class_id", "v", "n")
    partial = written(dealt.groupBy("label", "tile_a", "tile_b").applyInPandas(compare, "class_id long, links long, root long"), "links")
    components = connected_components(partial.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    links = partial.groupBy("class_id").agg(F.sum("links").alias("links"))
    done = classes.join(links, "class_id", "left").join(components.withColumnRenamed("node", "class_id"), "class_id", "left")
    done = done.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    out = rows.join(done, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
