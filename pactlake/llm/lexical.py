"""Ranked lexical search over inverted treaps.

A text's terms are its runs of letters, digits and non-ASCII characters. The queries are a bounded set that goes to the
workers; documents never move. One pass counts what the weights need (documents, terms, documents of each query
term). In a second one every task cuts its rows into blocks and builds, for each query term, the treap of
the block's postings: doc_id is the search order, impact (the posting's part of a score) the heap order. A query walks the treaps of
its terms together, by ranges of documents, those with the largest sum of maxima first: a range whose sum can't enter the
best k is left out with all below it, a small range is scored whole, and any other is split at the document of its
largest summand. The k best of a task carry over to its next block and are merged by a ranking.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scan_texts, table

TOP = 20
#: Bytes of query texts that the workers hold at once; more are ranked block by block.
BLOCK_BYTES = 8 << 20
#: Documents of a range that is scored whole, postings of a block of treaps.
SMALL_RANGE = 128
BLOCK_POSTINGS = 1 << 20
#: Fixed values of the score: saturation and length parts, in integers.
UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_PART = 1_000_000_000, 1000, 12, 25
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_TO_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
_TERMS = re.compile(rb"[^\x20]+")


def terms_of(text: bytes | None) -> list[bytes]:
    return _TERMS.findall(text.translate(_TO_TERMS)) if text else []


class Treap:
    """Postings of one term in one block: docs ascending (search order), no child's impact above its parent's."""

    def __init__(self, docs: list[int], impacts: list[int]):
        self.docs, self.impacts = array("i", docs), array("q", impacts)
        n = len(docs)
        self.left, self.right = array("i", [-1]) * n, array("i", [-1]) * n
        spine: list[int] = []  # the right spine: each new posting is the last in search order
        for k, x in enumerate(impacts):
            below = -1
            while spine and impacts[spine[-1]] < x:
                below = spine.pop()
            self.left[k] = below
            if spine:
                self.right[spine[-1]] = k
            spine.append(k)
        self.root = spine[0] if spine else -1
        self.doc_view, self.impact_view = np.frombuffer(self.docs, np.int32), np.frombuffer(self.impacts, np.int64)

    def top(self, node: int, low: int, high: int) -> int:
        """The posting of the largest impact among those of low <= doc < high at or below node, or -1."""
        docs, left, right = self.docs, self.left, self.right
        while node >= 0:
            d = docs[node]
            if d < low:
                node = right[node]
            elif d >= high:
                node = left[node]
            else:
                return node
        return -1


def search(treaps: list[tuple[Treap, int]], n_docs: int, best: list[tuple[int, int]], base: int, k: int) -> None:
    """Puts the k best documents of a block into `best`, a heap of (score, -number). treaps: of a query's terms, with
    their weights (times their repeats). A document's number is base + its place, and rises through the blocks."""

    def bound(nodes: list[int]) -> int:
        return sum(w * t.impacts[x] for (t, w), x in zip(treaps, nodes, strict=True) if x >= 0)

    def enters(score: int, first: int) -> bool:
        """Whether a score could be among the best, of a document from `first` on; equal scores go to the earlier one."""
        return score > 0 and (len(best) < k or (score, -(base + first)) > best[0])

    def put(score: int, place: int) -> None:
        if enters(score, place):
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -(base + place)))

    roots = [t.root for t, _ in treaps]
    ranges = [(-bound(roots), 0, n_docs, roots)]
    while ranges:
        most, low, high, nodes = heapq.heappop(ranges)
        if len(best) == k and -most < best[0][0]:
            return  # what is left has no larger sum
        if not enters(-most, low):
            continue
        if high - low <= SMALL_RANGE:
            scores = np.zeros(high - low, np.int64)
            for (t, w), x in zip(treaps, nodes, strict=True):
                if x >= 0:
                    a, b = bisect_left(t.docs, low), bisect_left(t.docs, high)
                    scores[t.doc_view[a:b] - low] += w * t.impact_view[a:b]
            able = np.flatnonzero(scores >= max(1, best[0][0])) if len(best) == k else np.flatnonzero(scores)
            for place in able.tolist():
                put(int(scores[place]), low + place)
            continue
        chief = max((w * t.impacts[x], j) for j, ((t, w), x) in enumerate(zip(treaps, nodes, strict=True)) if x >= 0)[1]
        cut = treaps[chief][0].docs[nodes[chief]]
        at_cut = [t.top(x, cut, cut + 1) for (t, _), x in zip(treaps, nodes, strict=True)]
        put(bound(at_cut), cut)
        for a, b in ((low, cut), (cut + 1, high)):
            if a < b:
                part = [t.top(x, a, b) for (t, _), x in zip(treaps, nodes, strict=True)]
                if (most := bound(part)) and enters(most, a):
                    heapq.heappush(ranges, (-most, a, b, part))


def _blocks(queries: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """Different (item, text), by hash in blocks of about BLOCK_BYTES."""
    lean = queries.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    return [lean.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _statistics(docs: DataFrame, text: str, number_of: dict[bytes, int], shared) -> tuple[int, int, list[int]]:
    """Documents with terms, all their terms, and the documents of each query term."""
    out = T.StructType().add("what", "integer").add("n", "long")
    size = len(number_of)

    def start():
        number = shared.value

        def count(rows):
            df, n, total = np.zeros(size, np.int64), 0, 0
            for (x,) in rows:
                words = terms_of(x)
                n, total = n + bool(words), total + len(words)
                held = list({number[w] for w in set(words) if w in number})
                df[held] += 1
            yield from [(-1, n), (-2, total), *((int(k), int(df[k])) for k in np.flatnonzero(df))]

        return count

    counted = {r["what"]: r["n"] for r in scan_texts(docs, [text], out, start).groupBy("what").agg(F.sum("n").alias("n")).collect()}  # a row a query term
    return counted.get(-1, 0), counted.get(-2, 0), [counted.get(k, 0) for k in range(size)]


def _rank_block(docs: DataFrame, items: list, doc_id: str, text: str, k: int) -> DataFrame:
    """(query, doc_id, score) of the k best of every task."""
    spark = docs.sparkSession
    wanted = [Counter(terms_of(t)) for _, t in items]
    number_of = {w: j for j, w in enumerate(sorted(set().union(*wanted)))}
    shared = spark.sparkContext.broadcast(number_of)  # words of a block of queries
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.make_valid_utf8(F.col(f"`{text}`").cast("string")).alias("text"))
    n_docs, n_terms, df = _statistics(docs, "text", number_of, shared)
    # weights as Spark computes logarithms
    ratios = spark.createDataFrame([(j, (2.0 * n_docs + 2) / (2.0 * d + 1)) for j, d in enumerate(df)], "j int, x double")
    weight = {r["j"]: r["w"] for r in ratios.select("j", F.floor(F.lit(1000) * F.log("x")).alias("w")).collect()} if df else {}
    plans = spark.sparkContext.broadcast([{number_of[w]: n * weight[number_of[w]] for w, n in q.items() if weight[number_of[w]] > 0} for q in wanted])
    kind = docs.schema["doc_id"].dataType
    out = T.StructType().add("query", "integer").add("doc_id", kind).add("score", "long")

    def start():
        number, queries = shared.value, plans.value
        used = {j for q in queries for j in q}
        number = {w: j for w, j in number.items() if j in used}

        def rank(rows: Iterator[tuple]) -> Iterator[tuple]:
            best: list[list[tuple]] = [[] for _ in queries]  # of the blocks so far: (doc_id, score)
            block: list[tuple] = []
            postings = 0
            for doc, x in rows:
                words = terms_of(x)
                found = [(number[w], tf) for w, tf in Counter(words).items() if w in number]
                if found:
                    m = 100 - LENGTH_PART + (LENGTH_PART * len(words) * n_docs) // n_terms
                    block.append((doc, [(j, (UNIT * tf) // (TF_UNIT * tf + LENGTH_UNIT * m)) for j, tf in found]))
                    postings += len(found)
                if postings >= BLOCK_POSTINGS:
                    best = _search_block(block, queries, best, k)
                    block, postings = [], 0
            if block:
                best = _search_block(block, queries, best, k)
            for j, rows_of in enumerate(best):
                yield from ((j, doc, score) for doc, score in rows_of)

        return rank

    return scan_texts(docs, ["doc_id", "text"], out, start)


def _order(doc) -> tuple:
    return (doc is not None, doc)  # null first


def _search_block(block: list[tuple], queries: list[dict[int, int]], best: list[list[tuple]], k: int) -> list[list[tuple]]:
    """The k best of each query among a block and those found before: [(doc_id, score)]."""
    block.sort(key=lambda x: _order(x[0]))
    lists: dict[int, tuple[list[int], list[int]]] = {}
    for place, (_, found) in enumerate(block):
        for j, impact in found:
            docs, impacts = lists.setdefault(j, ([], []))
            docs.append(place)
            impacts.append(impact)
    treaps = {j: Treap(*lists.pop(j)) for j in list(lists)}
    out = []
    for query, before in zip(queries, best, strict=True):
        own = [(treaps[j], w) for j, w in query.items() if j in treaps]
        if not own:
            out.append(before)
            continue
        # scores found before only bound the search here; ties with them are settled below, by doc_id
        least = min((s for _, s in before), default=0) if len(before) == k else 0
        heap = [(least - 1, -place - len(block)) for place in range(k)] if least else []
        search(own, len(block), heap, 0, k)
        new = [(block[-place][0], score) for score, place in heap if -place < len(block)]
        out.append(sorted(before + new, key=lambda x: (-x[1], _order(x[0])))[:k])
    return out


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each query the k documents with the highest score above 0, all if fewer;
    equal scores by ascending doc_id, null first. Every row of docs is a document of its own, so repeated rows rank
    one after the other. Null and empty texts have no terms: as documents they count nowhere, as queries they
    return nothing. Equal rows of queries count once. No documents or no queries give no rows. Other columns don't matter.

    Queries go to the workers in blocks of checked size; each block takes two passes over docs.
    """
    kind = T.StructType().add("item_id", queries.schema[item_id].dataType).add("rank", "integer").add("doc_id", docs.schema[doc_id].dataType).add("score", "long")
    parts = []
    for block in _blocks(queries, item_id, item_text):
        items = [(r["item"], bytes(r["text"])) for r in block.select("item", F.make_valid_utf8("text").cast("binary").alias("text")).toLocalIterator()]
        names = docs.sparkSession.createDataFrame([(j, item) for j, (item, _) in enumerate(items)], T.StructType().add("query", "integer").add("item_id", kind["item_id"].dataType))
        found = _rank_block(docs, items, doc_id, text, k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        top = found.withColumn("rank", place).where(F.col("rank") <= k)
        parts.append(top.join(F.broadcast(names), "query").select(*kind.names))  # names: a row a query of the block
    if not parts:
        return docs.sparkSession.createDataFrame([], kind)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_lexical_treaps(spark, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
