"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Native: DataFrame functions only. Rows get numbers 0..N-1 that depend on the rows alone; a keyed
bijection of 0..N-1 sends number x to place p, and shard = p mod n, slot = p div n. So shards differ
by one row at most (law `rows`), slots have no gaps, and both can be computed from x and N alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

ROUNDS = 4
#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 1_000
MAX_BUCKETS = 65_536
#: Rows that are equal in all columns are dealt in pieces of so many.
PIECE = 1_000


def _div(x: Column, by: int) -> Column:
    """Integer division: a double would be inexact from 2^53 rows."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def _feistel(x: Column, base: int, seed: int) -> Column:
    """A bijection of 0..base*base-1: each round sends (l, r) to (r, l + f(r) mod base)."""
    size = F.lit(base).cast("long")
    halves = F.struct(_div(x, base).alias("l"), F.pmod(x, size).alias("r"))
    key = lambda s, k: F.pmod(F.xxhash64(s["r"], F.lit(seed), k), size)
    one = lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + key(s, k), size).alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), halves, one, lambda s: s["l"] * size + s["r"])


def _before(y: Column, base: int, seed: int) -> Column:
    """The number that _feistel() sends to y: the rounds backwards."""
    size = F.lit(base).cast("long")
    halves = F.struct(_div(y, base).alias("l"), F.pmod(y, size).alias("r"))
    key = lambda s, k: F.pmod(F.xxhash64(s["l"], F.lit(seed), k), size)
    one = lambda s, k: F.struct(F.pmod(s["r"] - key(s, k), size).alias("l"), s["l"].alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in reversed(range(ROUNDS))]), halves, one, lambda s: s["l"] * size + s["r"])


def _base(n: int) -> int:
    base = max(2, int(n**0.5))
    while base * base < n:
        base += 1
    return base


def walk_length(spark, n: int, base: int, seed: int) -> int:
    """Steps that the longest walk through numbers n..base*base-1 takes before it comes back below n.
    There are at most 2*sqrt(n)+1 such numbers. Those that a number below n is sent to are followed in
    one job, again with a higher bound if a walk is longer; their walks end, while numbers that only
    others above n lead to may go round for ever. Lambda variables keep each step's expression small."""
    limit = 64
    while True:
        walked = lambda s, _: F.when(
            s["p"] >= n, F.struct(_feistel(s["p"], base, seed).alias("p"), (s["k"] + 1).alias("k"))
        ).otherwise(s)
        begin = F.struct(F.col("id").alias("p"), F.lit(0).alias("k"))
        entered = spark.range(n, base * base).where(_before(F.col("id"), base, seed) < n)
        ends = entered.select(F.aggregate(F.sequence(F.lit(1), F.lit(limit)), begin, walked).alias("s"))
        steps, furthest = ends.agg(F.max("s.k"), F.max("s.p")).first()
        if furthest is None or furthest < n:
            return steps or 0
        limit *= 8


def permute(x: Column, n: int, base: int, seed: int, walk: int) -> Column:
    """The place of row number x in 0..n-1: one Feistel pass, repeated while the result is not below n."""
    step = lambda p, k: F.when((k == 0) | (p >= n), _feistel(p, base, seed)).otherwise(p)
    return F.aggregate(F.sequence(F.lit(0), F.lit(walk)), x, step)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with `row_number` 0..N-1, and N. Rows are dealt into buckets by a hash of all `order`
    columns and numbered within their bucket in that order; buckets follow one another. Neither
    partitions nor task order matter, and no task sees more than a bucket or two. Rows equal in every
    column share a bucket: count them first (as shard() does) if there may be many."""
    total = int(df.agg(F.sum("__copies")).first()[0] or 0)
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)))
    sizes = dealt.groupBy("__bucket").agg(F.sum("__copies").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__bucket", before.alias("__start"))  # at most MAX_BUCKETS rows
    within = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("__within", F.coalesce(F.sum("__copies").over(within), F.lit(0)))
    numbered = numbered.join(F.broadcast(starts), "__bucket")
    first = F.col("__start") + F.col("__within")
    out = numbered.withColumn("row_number", F.explode(F.sequence(first, first + F.col("__copies") - 1)))
    return out.drop("__bucket", "__start", "__within", "__copies"), total


def shard(df: DataFrame, shards: int = 40, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row of df, by the law `rows`.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard (null: only
    the law `key` has it), row_number. A null text has no bytes and the crc32 0 of empty text; null
    doc_ids are numbered like others; rows that are equal in doc_id and text are told apart by
    number only; an empty table gives no rows; other columns of df are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lean = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("__hash"),
    )
    order = ["doc_id", "size", "text_crc32", "__hash"]
    counted = lean.groupBy(*order).agg(F.count(F.lit(1)).alias("__all"))
    # a row that is repeated often goes to many buckets, a piece to each
    pieces = counted.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("__all") - 1, PIECE))))
    order = [*order, "__piece"]
    lean = materialize(pieces.select(*order, F.least(F.lit(PIECE).cast("long"), F.col("__all") - F.col("__piece") * PIECE).alias("__copies")))
    numbered, n = number_rows(lean, order)
    base = _base(n)
    walk = walk_length(df.sparkSession, n, base, seed) if n else 1
    place = permute(F.col("row_number"), n, base, seed, walk)
    return numbered.withColumn("__place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        _div(F.col("__place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op5_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
