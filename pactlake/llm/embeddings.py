"""Embedding near-duplicates with a forest of random-projection trees.

Within a label (and vector length), random projections split the vectors again and again, where they lie
sparsest between the quarters; vectors close to the split go to both sides (spill), until LEAF or fewer
are left. Leaves are compared by one matrix product each, in double precision, and pairs at the threshold
or above are links. Equal vectors of a label are one class with a count, so a group of copies is one entry.

A label of CELL classes or fewer is one cell, whose TREES trees one task grows and compares: each class
moves once. A larger label is split by distributed steps in TOP trees until its cells are as small; only
ids and projections go through these steps, and vectors join their cells at the end. A pair of several
cells counts in the least of them alone, which both vectors' lists of cells tell, and there all TREES
trees look for it. So links are counted without writing pairs, and components come from a spanning forest
of each cell.

Where the band of a split would hold over SPILL of a node, as in a dense group whose vectors all link,
the node isn't split, and the band is never narrowed: a leaf or cell that no projection of TRIES splits is
compared whole, a cell of over CELL classes tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_step, materialize, table
from .graph import components

THRESHOLD = 0.93
TREES, LEAF, SEED = 6, 64, 42
#: Classes of a cell, which one task holds; trees that cut larger labels into cells; and the most splits of a
#: branch of these, after which a cell is compared in tiles.
CELL, TOP, DEPTH = 8192, 4, 24
#: Half-width of the band around a split that goes to both sides, as a share of the largest distance
#: of linked unit vectors over the root of the dimension; the most of a node that the band may hold
#: for it to be split; and the projections tried before a node is left whole.
BAND, SPILL, TRIES = 1.0, 0.3, 4
#: Where a node may be split, as shares of its vectors in order.
CUTS = (0.25, 0.35, 0.45, 0.5, 0.55, 0.65, 0.75)
#: Tiles a side of a cell that is compared whole, if they have TILE classes each, and the most bytes of a tile.
TILES, TILE, TILE_BYTES = 4, 4096, 64 << 20
#: Rows of a block of the matrices of products.
BLOCK = 1024


def _direction(tree: int, depth: int, dim: int) -> np.ndarray:
    """A random unit vector, the same wherever it is asked for."""
    v = np.random.default_rng([SEED, tree, depth, dim]).standard_normal(dim)
    return v / np.linalg.norm(v)


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal length, brought to unit length in double precision."""
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _band(dim: int, threshold: float) -> float:
    return BAND * np.sqrt(max(0.0, 2 - 2 * threshold)) / np.sqrt(dim) / 2


def _sides(p: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions left and right of the cut of CUTS whose band holds the fewest of the projections p, those
    within the band on both sides. None if it holds over SPILL of all."""
    s, n = np.sort(p), len(p)
    cuts = s[(np.array(CUTS) * (n - 1)).astype(np.int64)]
    held = np.searchsorted(s, cuts + band, "right") - np.searchsorted(s, cuts - band, "left")
    k = int(held.argmin())
    if held[k] > SPILL * n:
        return None
    return np.flatnonzero(p <= cuts[k] + band), np.flatnonzero(p >= cuts[k] - band)


def leaves(x: np.ndarray, tree: int, threshold: float) -> Iterator[np.ndarray]:
    """Positions of the unit rows of x in each leaf of a tree."""
    band = _band(x.shape[1], threshold)
    todo = [(np.arange(len(x)), 0, 0)]
    while todo:
        of, d, tries = todo.pop()
        if len(of) <= LEAF or tries == TRIES:
            yield of
            continue
        sides = _sides(x[of] @ _direction(TOP + tree, d, x.shape[1]), band)
        if sides is None:
            todo.append((of, d + 1, tries + 1))
        else:
            todo += [(of[s], d + 1, 0) for s in sides]


def linked(x: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each two of the unit rows of x, of CELL or fewer, share a leaf and are at the threshold."""
    out = np.zeros((len(x), len(x)), np.bool_)
    for tree in range(TREES):
        for of in leaves(x, tree, threshold):
            if len(of) <= BLOCK:
                out[np.ix_(of, of)] |= x[of] @ x[of].T >= threshold
                continue
            for at in range(0, len(of), BLOCK):
                out[np.ix_(of[at : at + BLOCK], of)] |= x[of[at : at + BLOCK]] @ x[of].T >= threshold
            if len(of) == len(x):  # all pairs are compared
                return out
    return out


def classes(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(label, dim, vector, id, n, key): distinct comparable vectors of a label, their least id, how many
    rows have them, and a hash that stands for the class from here on."""
    v = F.col("vector")
    fit = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    lean = _lean(df, vec_id, embedding, label)
    good = lean.where(fit & F.coalesce(finite & F.exists(v, lambda x: x != 0.0), F.lit(False)))
    grouped = good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("dim", F.size("vector")).withColumn("key", F.xxhash64("label", "vector"))


def _lean(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, vector, label; floats stay floats, all other numbers become doubles."""
    single = df.schema[embedding].dataType == T.ArrayType(T.FloatType())
    kind = "array<float>" if single or df.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast(kind).alias("vector"), F.col(f"`{label}`").alias("label"))


NODE = ["label", "dim", "tree", "path"]


def _projected(known: DataFrame) -> DataFrame:
    """(label, dim, key, tree, p): the projections of each class on the directions of every depth of a tree."""
    kept = known.select("label", "dim", "key", "vector")

    def run(batches):
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            for dim in sorted(set(batch.column(1).to_pylist())):
                part = table_.filter(pc.equal(table_["dim"], dim)).combine_chunks()
                x = _units(part["vector"].combine_chunks())
                for tree in range(TOP):
                    p = x @ np.column_stack([_direction(tree, d, dim) for d in range(DEPTH)])
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), DEPTH).cast(pa.list_(pa.float64()))
                    columns = [part["label"], part["dim"], part["key"], pa.array(np.full(len(x), tree, np.int32)), rows]
                    yield from pa.table(columns, ["label", "dim", "key", "tree", "p"]).to_batches()

    schema = T.StructType([kept.schema[c] for c in ("label", "dim", "key")]).add("tree", "integer").add("p", T.ArrayType(T.DoubleType()))
    return kept.mapInArrow(run, schema)


def _rows(known: DataFrame, threshold: float) -> DataFrame:
    """(cell, size, key, vector, n, cells): the classes of every cell, and all cells that each is in. A label
    of CELL classes or fewer is one cell; of a larger one every tree of TOP has its own, as small, or whole
    where no projection splits it."""
    sizes = materialize(known.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")))
    small = known.join(sizes.where(F.col("size").between(2, CELL)), ["label", "dim"]).withColumn("cell", _cell(F.lit(-1), F.lit("")))
    small = small.select("cell", "size", "key", "vector", "n", F.array("cell").alias("cells"))
    large = sizes.where(F.col("size") > CELL).select("label", "dim")
    if large.isEmpty():
        return small
    cells = _cells(known.join(large, ["label", "dim"]), threshold)  # a class is in a cell once
    lists = cells.groupBy("key").agg(F.collect_list("cell").alias("cells"))  # TOP times the spill, whatever the table's size
    more = known.select("key", "vector", "n").join(lists, "key").join(cells.where(F.col("size") > 1), "key")
    return small.union(more.select("cell", "size", "key", "vector", "n", "cells"))


def _cell(tree, path):
    return F.xxhash64("label", "dim", tree, path)


def _cells(known: DataFrame, threshold: float) -> DataFrame:
    """(cell, size, key) of labels of over CELL classes, by distributed steps."""
    done: list[DataFrame] = []
    begin = _projected(known)
    at = materialize(begin.select(*NODE[:3], F.lit("").alias("path"), "key", "p", F.lit(0).alias("tries")))
    band = F.lit(_band(1, threshold)) / F.sqrt(F.col("dim").cast("double"))
    for depth in range(DEPTH + 1):
        here = F.col("p")[min(depth, DEPTH - 1)]
        split = at.groupBy(*NODE, "tries").agg(F.count(F.lit(1)).alias("size"), F.percentile_approx(here, list(CUTS), 1000).alias("cuts"))
        held = [F.count_if(F.abs(here - F.col("cuts")[k]) <= band).alias(f"held{k}") for k in range(len(CUTS))]
        counted = at.join(split, [*NODE, "tries"]).groupBy(*NODE, "tries", "size", "cuts").agg(*held)
        best = F.array_min(F.array(*[F.struct(F.col(f"held{k}").alias("held"), F.col("cuts")[k].alias("cut")) for k in range(len(CUTS))]))
        nodes = materialize(counted.select(*NODE, "tries", "size", best.alias("best")))
        crowded = F.col("best.held") > SPILL * F.col("size")
        last = F.lit(depth == DEPTH) | (crowded & (F.col("tries") == TRIES - 1))
        joined = at.join(nodes.withColumn("ended", (F.col("size") <= CELL) | last).withColumn("crowded", crowded), [*NODE, "tries"])
        # a whole label is the same cell in every tree
        cell = _cell(F.when(F.col("path") == "", -1).otherwise(F.col("tree")), F.col("path")).alias("cell")
        done.append(materialize(joined.where("ended").select(cell, "size", "key").distinct()))
        to = F.array_compact(F.array(F.when(here <= F.col("best.cut") + band, "0"), F.when(here >= F.col("best.cut") - band, "1")))
        to = F.when(F.col("crowded"), F.array(F.lit(""))).otherwise(to)
        onward = joined.where(~F.col("ended")).withColumn("side", F.explode(to))
        tries = F.when(F.col("crowded"), F.col("tries") + 1).otherwise(0)
        before, at = at, materialize(onward.select(*NODE[:3], F.concat("path", "side").alias("path"), "key", "p", tries.alias("tries")))
        drop_step(before)
        if at.isEmpty():
            break
    drop_step(at)
    return reduce(DataFrame.union, done)


def _count(x: np.ndarray, other: np.ndarray | None, found, n: np.ndarray, lists: list, other_lists: list, cell: int, group: np.ndarray, threshold: float):
    """Links between the rows of x and of other (None: of x among themselves), by blocks: those of every row
    of x, and of other, that count in this cell, weighed by n (of x, then of other). group: a number for each
    row of both that linked ones get in common. found: which pairs to count, if known already."""
    a, b = len(x), len(x if other is None else other)
    mine, back = np.zeros(a), np.zeros(b)
    offset = 0 if other is None else a
    several = any(len(v) > 1 for v in lists) or any(len(v) > 1 for v in other_lists)
    of: dict[int, list[int]] = {}
    if several:  # members of a smaller cell that is common count there
        for k, cells in enumerate(other_lists):
            for v in cells:
                if v < cell:
                    of.setdefault(v, []).append(k)
    for at in range(0, a, BLOCK):
        rows = np.arange(at, min(at + BLOCK, a))
        link = found[rows] if found is not None else x[rows] @ (x if other is None else other).T >= threshold
        if other is None:
            link[np.arange(len(rows)), rows] = False
        for k in np.flatnonzero(link.any(axis=1)).tolist():
            near = group[offset + np.flatnonzero(link[k])]
            own = group[rows[k]]
            if (near != own).any():
                group[np.isin(group, np.append(near, own))] = min(near.min(), own)
        shared: dict[int, list[int]] = {}
        if of:
            for k, r in enumerate(rows.tolist()):
                for v in lists[r]:
                    if v in of:
                        shared.setdefault(v, []).append(k)
            link = link.copy()
            for v, some in shared.items():
                link[np.ix_(some, of[v])] = False
        mine[rows] = link @ n[offset:]
        if other is not None:
            back += link.T @ n[rows]
    return mine, back


def _told(keys: np.ndarray, counts: np.ndarray, group: np.ndarray) -> pa.Table:
    """(a, b, links): of each key its links (b null), and a link to the least one of its group."""
    _, place = np.unique(group, return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, place, keys)
    other, some = keys != least[place], counts > 0
    a, b = np.concatenate([keys[some], keys[other]]), np.concatenate([keys[some], least[place][other]])
    links = np.concatenate([counts[some].astype(np.int64), np.zeros(int(other.sum()), np.int64)])
    return pa.table({"a": a, "b": pa.array(b, mask=np.arange(len(b)) < some.sum()), "links": links})


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """Of (cell, size, key, vector, n, cells): (a, b, links) as of _told()."""
    out = "a long, b long, links long"

    def read(frame):
        frame = frame.sort_by("key")  # whatever the order of arrival, the same result
        keys, n = frame.column("key").to_numpy(), frame.column("n").to_numpy().astype(np.float64)
        return frame, keys, n, _units(frame.column("vector").combine_chunks()), frame.column("cells").to_pylist()

    def grow(key, frame):
        _, keys, n, x, cells = read(frame)
        group = np.arange(len(keys))
        counts, _ = _count(x, None, linked(x, threshold), n, cells, cells, key[0].as_py(), group, threshold)
        return _told(keys, counts, group)

    def tiles(key, frame):
        frame, keys, n, x, cells = read(frame)
        cell, one, two = (k.as_py() for k in key)
        side = frame.column("tile").to_numpy()
        own = np.concatenate([np.flatnonzero(side == one), np.flatnonzero(side != one)])
        a = int((side == one).sum())
        keys, n, x, cells, group = keys[own], n[own], x[own], [cells[k] for k in own], np.arange(len(own))
        if one == two:
            counts, _ = _count(x, None, None, n, cells, cells, cell, group, threshold)
        else:
            counts = np.concatenate(_count(x[:a], x[a:], None, n, cells[:a], cells[a:], cell, group, threshold))
        return _told(keys, counts, group)

    found = rows.where(F.col("size") <= CELL).groupBy("cell").applyInArrow(grow, out)
    big = rows.where(F.col("size") > CELL)
    per = F.greatest(F.lit(1), F.least(F.greatest(F.lit(TILE), F.ceil(F.col("size") / TILES)), F.floor(TILE_BYTES / 8 / F.size("vector"))))
    big = big.withColumn("tiles", F.ceil(F.col("size") / per).cast("int")).withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int"))
    big = big.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    big = big.select("cell", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), "tile", "key", "vector", "n", "cells")
    return found.union(big.groupBy("cell", "one", "two").applyInArrow(tiles, out))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept per row of df.

    Only vectors of equal, not null label and equal length link, by a cosine of `threshold` or more.
    A vector that is null, empty, zero, or holds null or non-finite components has no links and is
    its own component. Equal vectors link to each other; repeated rows count as other vectors. A row
    with a null vec_id takes no part: n_links 0, component_id null, kept null. vec_id may be of any type
    that has an order. An empty table gives no rows; other columns are ignored.
    """
    known = materialize(classes(df, vec_id, embedding, label))
    links = materialize(_links(_rows(known, threshold), threshold))
    counted = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    groups = materialize(components(links.where(F.col("b").isNotNull())).withColumnRenamed("node", "key").join(known.select("key", "id"), "key"))
    least = groups.groupBy("component").agg(F.min("id").alias("least"))
    groups = groups.join(least, "component").select("key", "least")
    of_class = known.select("label", "vector", "key", "id", "n").join(counted, "key", "left").join(groups, "key", "left")
    more = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    labels = materialize(of_class.select("label", "vector", more, F.coalesce("least", "id").alias("component_id")))
    own = _lean(df, vec_id, embedding, label).withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector")))
    joined = own.join(labels, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
