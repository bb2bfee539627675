"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 10 words of every benchmark item (a shorter item is one window). For
the windows of one length m, a shift table says for each block of two words how far the search may
jump ahead, which is m - 1 words for a block that no window holds; where a window may end, the bucket
of the block's hash and the window's first word select the windows to test, and a direct comparison
confirms them. Texts are scanned in one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, table, unused

WINDOW = 10
#: Bytes of benchmark text whose tables a worker holds at once; a larger benchmark is scanned in blocks of items.
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and turns every byte outside a word into a space: words are runs of digits, a-z and non-ASCII.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class WuManber:
    """Search for all windows of one length m (in words)."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                key = self._key(window, end)
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets[self._key(window, m)][window[0]].append((list(window), items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def find(self, words: list[bytes], found) -> None:
        """Calls found(start, items) for every occurrence of a window."""
        m, far, shift, n, at = self.m, self.far, self.shift, len(words), self.m
        pairs = self.block == 2
        while at <= n:
            key = (words[at - 2], words[at - 1]) if pairs else words[at - 1]
            step = shift.get(key, far)
            if step:
                at += step
                continue
            start = at - m
            for window, items in self.buckets[key].get(words[start], ()):
                if words[start:at] == window:
                    found(start, items)
            at += 1


def searchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each window length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[k : k + m])].add(item_id)
    return [WuManber(dict(w), m) for m, w in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """Lean blocks of items (id as string, text), each of about BLOCK_BYTES, by a hash of their id and text."""
    lean = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    total = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    if n == 1:
        return [lean]
    return [lean.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def scan(
    df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, into: tuple[str, str, str] | list[str] = ("n_words", "hits", "items"),
) -> DataFrame:
    """Columns `keep` and, of every whole text, named by `into`: n_words, hits (positions of the words inside
    any occurrence of a window, ascending) and items (ids of the items with occurring windows, sorted as
    strings). A kept column of such a name gives way.

    A null text has no words. A null item id counts as the empty one, items of equal id as one item,
    items without words match nothing; with no items nothing is hit. The benchmark is sent to the
    workers in blocks of checked size; beyond one block the texts are passed over once a block, with
    a written table in between.
    """
    ints, strings = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    n_words, hits, ids = into
    old_hits, old_ids = unused(df.columns, "__hits"), unused(df.columns, "__items")
    out = T.StructType().add(n_words, "long").add(hits, ints).add(ids, strings)
    blocks = _blocks(benchmark, item_id, item_text)
    rows = df
    for k, block in enumerate(blocks):
        # at most about BLOCK_BYTES, or one item
        found = [(r["item"], bytes(r["text"])) for r in block.select("item", F.col("text").cast("binary").alias("text")).toLocalIterator()]
        shared = df.sparkSession.sparkContext.broadcast(found)

        def start(shared=shared):
            machines = searchers(shared.value, window)

            def one(x):
                words, hit, items = words_of(x), set(), set()
                for machine in machines:
                    machine.find(words, lambda at, ids, m=machine.m: (hit.update(range(at, at + m)), items.update(ids)))
                return len(words), sorted(hit), sorted(items)

            return one

        before = [old_hits, old_ids] if k else []
        last = k == len(blocks) - 1
        carried = list(dict.fromkeys([*keep, *([] if last else [text])]))
        rows = map_texts(rows, text, [*carried, *before], out, start)
        if k:
            rows = rows.withColumn(hits, F.array_sort(F.array_union(hits, old_hits)))
            rows = rows.withColumn(ids, F.array_sort(F.array_union(ids, old_ids))).drop(old_hits, old_ids)
        if not last:
            rows = materialize(rows.withColumnsRenamed({hits: old_hits, ids: old_ids}).drop(n_words))
    return rows


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
