"""SimHash near-duplicates, found with BK-trees.

A fingerprint has a bit set if over half the hashes of the text's shingles have it. Fingerprints
link at `radius` or fewer differing bits. Texts of one fingerprint are one class, so a group of
copies, however large, is one entry from there on.

One tree of all fingerprints could not be broadcast at scale, and with a tree at random distances
nearly every edge is within the radius. So the trees are of shards, and each stays in the task that
searches it: the 64 bits fall into radius + 1 blocks; two fingerprints within the radius agree in one
of them at least, hence meet in the shard of that block's lowest bits, of which there are as many as make
shards of SHARD fingerprints. Each shard gets a BK-tree, whose children are keyed by their Hamming
distance to the parent, and is searched along edges within the radius. A shard gives a spanning forest
of its links, never all pairs. A shard of over SHARD_MAX fingerprints is cut again, by the whole block
and by parts of the bits outside it.

Near copies that differ in more than a few shingles are further apart (about 10 bits at a similarity of
0.8), where trees of all fingerprints prune nothing. similar_one_of_each() therefore brings texts together
first: BANDS hashes a text, each of the ROWS shingles that come first under ROWS orders of their own;
texts of similarity s share one of them but for a chance of (1 - s**ROWS)**BANDS, 6e-7 at 0.8. What such
hashes connect is a shard, cut into tiles if it is large; the fingerprints of a tile's texts make a
BK-tree, which is searched along edges within SIMILAR_RADIUS (a pair at 0.8 is beyond it with a chance
of 4e-6 at most), and the pairs that it proposes are compared by their whole sets of shingles, exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, table, unused
from .graph import components

SEED = 42
SHINGLE, RADIUS = 3, 2
#: Fingerprints of one tree on average; and at most, unless all its bits but a third are shared.
SHARD, SHARD_MAX = 1024, 8192
#: Of similar texts: words of a shingle, common share of all shingles of both (Jaccard).
SIMILAR_SHINGLE, SIMILAR, SIMILAR_RADIUS = 5, 0.8, 26
BANDS, ROWS = 36, 5
#: Texts, and shingles of theirs, that one task compares with one another, or with as many more; and texts that
#: are compared with all others of their tile before the rest.
TILE_TEXTS, TILE_SHINGLES, HUBS = 10_000, 2_000_000, 8
#: Rows of a table that is broadcast, of 24 bytes each; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Of each shingle of the text; of all words if they are fewer than a shingle has."""
    words = text.lower().split() if text else []  # bytes: A-Z and the white space of ASCII only
    if not words:
        return np.empty(0, "<u8")
    joined, n = b" ".join(words), len(words)
    if n < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed=SEED)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], "<u8")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of the whole text as unsigned 64 bits; 0 if it has no words."""
    return majority(_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Over distinct fingerprints. Built and searched level by level: a step deals all that are below the
    nodes of a level to the next, or goes along all edges of a level that are within the radius."""

    def __init__(self, values: np.ndarray):
        self.values = values
        edges, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        below, node = np.arange(1, len(values)), np.zeros(max(0, len(values) - 1), np.int64)
        while len(below):
            edge = 65 * node + np.bitwise_count(values[below] ^ values[node])
            order = np.argsort(edge, kind="stable")  # the first of each node and distance becomes the child
            below, edge = below[order], edge[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(edge) != 0]))
            edges.append(edge[first])
            children.append(below[first])
            node = np.repeat(below[first], np.diff(np.append(first, len(below))))
            rest = np.ones(len(below), np.bool_)
            rest[first] = False
            below, node = below[rest], node[rest]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        #: Of every edge 65 * node + distance, in order, and the child at its end.
        self.edge, self.child = edge[order], child[order]

    def within(self, queries: np.ndarray, radius: int, batch: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, positions of queries) of those within the radius, found along edges within the radius."""
        for at in range(0, len(queries) if len(self.values) else 0, batch):
            asked = np.arange(at, min(at + batch, len(queries)))
            node = np.zeros(len(asked), np.int64)
            while len(asked):
                distance = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
                hit = distance <= radius
                if hit.any():
                    yield node[hit], asked[hit]
                begin = np.searchsorted(self.edge, 65 * node + np.maximum(0, distance - radius))
                number = np.searchsorted(self.edge, 65 * node + np.minimum(64, distance + radius), "right") - begin
                node, asked = self.child[_ranges(begin, number)], np.repeat(asked, number)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def forest(values: np.ndarray, radius: int, cuts: list[list[tuple[int, int]]] | None = None) -> list[tuple[int, int]]:
    """Links (value, value) that connect the distinct values within the radius of one another. cuts: by
    which bits (lowest, number) too large a shard is cut again, step by step: by each of a step's, so
    that two values of a shard within the radius agree in one of them."""
    n = len(values)
    if n > SHARD_MAX and cuts:
        out = []
        for low, bits in cuts[0]:
            part = (values >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            order = np.argsort(part, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(group) > 1:
                    out += forest(values[group], radius, cuts[1:])
        return out
    parent = list(range(n))
    for nodes, asked in BKTree(values).within(values, radius):
        other = nodes != asked
        for a, b in zip(nodes[other].tolist(), asked[other].tolist(), strict=True):
            parent[_root(parent, b)] = _root(parent, a)
    return [(int(values[k]), int(values[r])) for k in range(n) if (r := _root(parent, k)) != k]


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the radius + 1 blocks of 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _parts(blocks: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """The blocks cut into radius + 1 parts or more: two values within the radius agree in one of them."""
    while blocks and len(blocks) < radius + 1:
        blocks = [p for low, bits in blocks for p in ((low, bits // 2), (low + bits // 2, bits - bits // 2))]
    return blocks


def links(fingerprints: DataFrame, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """Of distinct 64-bit fingerprints (long): links (a, b) whose components are those of all pairs
    within the radius."""
    blocks = _blocks(radius)
    width = min(min(n for _, n in blocks), max(0, math.ceil(math.log2(max(1, fingerprints.count()) / SHARD))))
    low_bits = lambda low: F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1))
    shards = F.array(*[F.struct(F.lit(c).alias("c"), low_bits(low).alias("k")) for c, (low, _) in enumerate(blocks)])
    dealt = fingerprints.select(F.explode(shards).alias("s"), F.col(fp).alias("fp")).select("s.c", "s.k", "fp")
    dealt = dealt.repartition("c", "k").sortWithinPartitions("c", "k")
    cuts = [[[b], _parts([x for x in blocks if x != b], radius)] for b in blocks]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last shard seen, which may go on
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, ends = (np.concatenate(held) if held else np.empty((0, 3), np.int64)), True
            else:
                rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
                if not len(rows):
                    continue
                if held and (rows[-1, :2] == held[0][0, :2]).all():
                    held.append(rows)
                    continue
                rows, ends = np.concatenate([*held, rows]), False
            where = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1
            bounds = [0, *where.tolist(), len(rows)]
            if not ends:
                held = [rows[bounds[-2] :]]
                bounds.pop()
            found: list[tuple[int, int]] = []
            starts = np.array(bounds)
            for k in np.flatnonzero(np.diff(starts) > 1).tolist():
                a, b = bounds[k], bounds[k + 1]
                found += forest(rows[a:b, 2].view(np.uint64), radius, cuts[int(rows[a, 0])])
            if found:
                both = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return dealt.mapInArrow(search, "a long, b long")


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE, into: str = "fp") -> DataFrame:
    """Columns `keep` and `into`, the fingerprint as a signed long. A kept column named as `into` gives way."""

    def start():
        return lambda x: (_signed(fingerprint(x, shingle)),)

    return map_texts(df, text, keep, T.StructType().add(into, "long"), start)


def groups(lean: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of rows (doc_id, fp): (fp, first, component_id, stays) for each fingerprint: its least doc_id,
    that of its component, and whether it is the fingerprint of the component's one row to stay."""
    classes = materialize(lean.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return _groups(classes, links(classes.select("fp"), radius))


def _groups(classes: DataFrame, linked: DataFrame) -> DataFrame:
    of = components(linked).withColumnRenamed("node", "fp")
    linked = materialize(of.join(classes, "fp"))
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("least"))
    own = linked.join(least, "component")
    own = own.select("fp", "first", F.col("least.first").alias("component_id"), (F.col("fp") == F.col("least.fp")).alias("stays"))
    alone = classes.join(linked, "fp", "left_anti").select("fp", "first", F.col("first").alias("component_id"), F.lit(True).alias("stays"))
    return materialize(own.union(alone))


def near_duplicates(
    df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, itself included) per row.

    Texts without words, null ones too, have the fingerprint 0 and link like any other. Repeated
    rows stay; a null doc_id is no component's smallest unless all are null. An empty table gives
    no rows; other columns are ignored.
    """
    renamed = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    lean = materialize(fingerprints(renamed, ["doc_id"], "text", shingle))
    return lean.join(groups(lean, radius).select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, with its columns, that are left when one of each component stays: that with
    the smallest doc_id, and of repeated rows one. Texts are read by one Python pass and move only if over
    BROADCAST_ROWS rows are dropped or repeated."""
    lean = materialize(fingerprints(_hashed(df, doc_id, text), ["doc_id", "h"], "text", shingle))
    return _staying(df, _marks(lean, groups(lean, radius)), doc_id, text)


def _hashed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.col(f"`{text}`").cast("string")
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("h"))


def _marks(lean: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows (doc_id, h, fp), h the hash of the text, and groups(): (doc_id, h, again) of the rows that don't
    all stay: none of them does (again false), or one of several equal ones (true)."""
    each = materialize(lean.groupBy("doc_id", "h", "fp").agg(F.count(F.lit(1)).alias("n")))
    stay = found.where("stays").select("fp", "first")
    # texts of one fingerprint and id may differ: one of them stays
    keeper = each.join(stay, "fp").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("fp").agg(F.min("h").alias("h"))
    keeper = keeper.join(stay, "fp").select(F.col("fp").alias("f"), F.col("h").alias("g"), "first")
    all_ = each.join(keeper, (F.col("fp") == F.col("f")) & (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    again = F.col("f").isNotNull() & (F.col("n") > 1)
    return materialize(all_.where(F.col("f").isNull() | (F.col("n") > 1)).select("doc_id", "h", again.alias("again")))


def _staying(df: DataFrame, marks: DataFrame, doc_id: str, text: str) -> DataFrame:
    names = df.columns
    own_id, of, again, h, number = (unused(names, n) for n in ("__id", "__of", "__again", "__h", "__number"))
    marks = marks.select(F.col("doc_id").alias(own_id), F.col("h").alias(of), F.col("again").alias(again))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    hashed = df.withColumn(h, F.xxhash64(F.col(f"`{text}`").cast("string")))
    joined = hashed.join(marks, (F.col(h) == F.col(of)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)), "left")
    order = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ranked = joined.where(again).withColumn(number, F.row_number().over(Window.partitionBy(own_id, h).orderBy(*order)))
    own = [F.col(f"`{c}`") for c in names]
    return joined.where(F.col(again).isNull()).select(*own).union(ranked.where(F.col(number) == 1).select(*own))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_set(text: bytes | None, shingle: int = SIMILAR_SHINGLE) -> tuple[int, np.ndarray]:
    """(hash of the set, sorted hashes of its shingles); (0, none) without words."""
    held = np.unique(_hashes(text, shingle))
    return (_signed(xxhash.xxh64_intdigest(held.tobytes(), SEED)) if len(held) else 0), held


def _orders() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def subset_fingerprints(held: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """BANDS fingerprints of the set, each of the shingles that are first under its ROWS orders."""
    if not len(held):
        return []
    first = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(held), 128):
        np.minimum(first, ((held[at : at + 128, None] ^ orders[0]) * orders[1]).min(axis=0), out=first)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(first.reshape(BANDS, ROWS))]


def similar(sets: list[np.ndarray], threshold: float = SIMILAR) -> list[int]:
    """For each of the sets a number that those share which links of `threshold` or more connect. The pairs
    that a BK-tree of their fingerprints proposes are compared exactly, but for those that are connected
    already. Sets that are connected with the hub, a set that links to many, don't search: what could link
    to them finds them. So a large group of near copies costs no square."""
    n, parent = len(sets), np.arange(len(sets))
    if not n:
        return []
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), sizes)[np.argsort(code, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))]) if len(code) else np.zeros(1, np.int64)

    def roots() -> np.ndarray:
        nonlocal parent
        while (parent != (further := parent[parent])).any():
            parent = further
        return parent

    def connect(k: int) -> None:
        """Links set k with all that are similar: how many elements each has in common with it, by their holders."""
        own = code[ends[k] - sizes[k] : ends[k]]
        number = begin[own + 1] - begin[own]
        common = np.bincount(holder[_ranges(begin[own], number)], minlength=n)
        group = np.unique(roots()[np.append(np.flatnonzero(common >= threshold * (sizes + sizes[k] - common) - 1e-9), k)])
        parent[group] = group.min()

    for k in dict.fromkeys(np.linspace(0, n - 1, min(n, HUBS)).astype(int).tolist()):
        connect(k)  # which connects most of a group of near copies
    hub = int(np.bincount(roots()).argmax())
    prints, place = np.unique(np.array([majority(x) for x in sets], np.uint64), return_inverse=True)
    tree, order = BKTree(prints), np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], np.arange(len(prints) + 1))
    for at in range(0, n, 64):
        asked = np.arange(at, min(at + 64, n))
        asked = asked[roots()[asked] != roots()[hub]]
        proposed: dict[int, list[np.ndarray]] = {}
        for nodes, which in tree.within(prints[place[asked]], SIMILAR_RADIUS):
            number = np.diff(first)[nodes]
            one, other = np.repeat(asked[which], number), order[_ranges(first[nodes], number)]  # every set of a node's fingerprint
            near = (parent[one] != parent[other]) & (np.minimum(sizes[one], sizes[other]) >= threshold * np.maximum(sizes[one], sizes[other]) - 1e-9)
            one, other = one[near], other[near]
            for k in np.unique(one).tolist():
                proposed.setdefault(k, []).append(other[one == k])
        for k, others in proposed.items():
            label = roots()
            if any((label[x] != label[k]).any() for x in others):
                connect(k)
    return roots().tolist()


def _ranges(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, `number` of them."""
    return np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())


def _similar_links(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of (fp, group) and (fp, shingles): links (a, b) that connect the similar ones of each group. A
    group of over TILE_SHINGLES is compared tile by tile: a row for each pair of tiles that its own is in."""
    rows = materialize(sets.join(candidates, "fp"))
    tiles = F.greatest(F.ceil(F.sum(F.octet_length("shingles")) / (8 * TILE_SHINGLES)), F.ceil(F.count(F.lit(1)) / TILE_TEXTS))
    sizes = rows.groupBy("group").agg(F.greatest(tiles, F.lit(1)).cast("int").alias("tiles"))
    rows = rows.join(sizes, "group").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("group", F.least("tile", "with").alias("tile_a"), F.greatest("tile", "with").alias("tile_b"), "fp", "shingles")

    def compare(key, frame):
        frame = frame.sort_by("fp")
        fps = frame.column("fp").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in frame.column("shingles").to_pylist()]
        edges = [(fps[k], fps[r]) for k, r in enumerate(similar(sets, threshold)) if k != r]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("group", "tile_a", "tile_b").applyInArrow(compare, "a long, b long")


def similar_groups(df: DataFrame, shingle: int = SIMILAR_SHINGLE, threshold: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of the rows of df, and (fp, first, component_id, stays) as of groups(), where fp is the hash of a text's set of shingles
    and texts link from a common share of `threshold` of their shingles on. Texts without words are one class."""

    def start():
        orders = _orders()

        def one(x):
            fp, held = shingle_set(x, shingle)
            return fp, subset_fingerprints(held, orders)

        return one

    def whole():
        def one(x):
            fp, held = shingle_set(x, shingle)
            return fp, held.tobytes()

        return one

    texts = _hashed(df, doc_id, text)
    lean = materialize(map_texts(texts, "text", ["doc_id", "h"], T.StructType().add("fp", "long").add("parts", T.ArrayType(T.LongType())), start))
    classes = materialize(lean.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = lean.select("fp", F.explode("parts").alias("part"))
    least = parts.groupBy("part").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where(F.col("a") != F.col("last")).select("part", "a")
    proposed = parts.join(least, "part").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    candidates = materialize(components(proposed).select(F.col("node").alias("fp"), F.col("component").alias("group")))
    # one row of each candidate: that of its least id, and of the texts of that id with this set one
    one = classes.join(candidates, "fp", "left_semi")
    one = one.join(lean.select("doc_id", "h", F.col("fp").alias("f")), (F.col("fp") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("first")))
    one = materialize(one.groupBy("fp", "first").agg(F.min("h").alias("g")).select("first", "g"))
    few = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
    some = texts.join(few, (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    sets = map_texts(some, "text", [], T.StructType().add("fp", "long").add("shingles", "binary"), whole)
    # repeated rows of one id and text come several times
    return lean.select("doc_id", "h", "fp"), _groups(classes, _similar_links(candidates, sets.dropDuplicates(["fp"]), threshold))


def similar_one_of_each(df: DataFrame, shingle: int = SIMILAR_SHINGLE, threshold: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, with its columns, that are left when one of each component of similar texts
    stays, as in one_of_each()."""
    lean, found = similar_groups(df, shingle, threshold, doc_id, text)
    return _staying(df, _marks(lean, found), doc_id, text)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
