"""Removal of passages that recur anywhere, by sharded Aho-Corasick automata of confirmed phrases.

A window is `window` consecutive words; those whose words also start elsewhere recur. Every window has an
anchor, the run of ANCHOR words in it with the least hash, so that equal windows have equal anchors, and the windows of a
text fall into stretches around one anchor each, some 14 windows long.

1. Anchors are counted. Stretches of an anchor that occurs once go no further.
2. Stretches that recur are shuffled by anchor, equal ones combined before. All occurrences of a window
   meet in the shard of its anchor, where the recurring ones are confirmed by their words; runs of them are the recurring passages.
   Each shard compiles its passages into an automaton over words and streams the documents' stretches through it: whatever it
   finds is covered by recurring windows, and nothing else is.
3. Documents collect the places found, by the hash of the stretch, and drop these words.

An anchor of HOT occurrences or more may stand in ever new surroundings. Its windows are counted first (combined before they move),
and stretches are trimmed to those that recur, so that a shard holds the different passages around an anchor, not its occurrences.

The sets of anchors and windows reach the passes as bitmaps of hashes, of MOST_BITS at most. They only save work: with
collisions, or a bitmap that a very large corpus fills, more stretches are shuffled and the shards' comparison decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_128_digest

from .common import as_bytes, map_texts, materialize, small_batches, table, unused

WINDOW = 35
ANCHOR = 10
HOT = 256
MOST_BITS = 1 << 28
#: Words of stretches whose passages share an automaton.
AUTOMATON_WORDS = 1 << 18
#: Windows whose anchors are looked for at once, rows combined at once before they move.
PART, COMBINED_ROWS = 1 << 15, 1 << 16
#: Letters hashed at once, bytes of texts looked at together.
BLOCK, TEXT_BYTES = 1 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TEXTS_KEPT = 1 << 18


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []  # by the six kinds of ASCII white space


class Words:
    """The words of some texts, joined by one space: where each begins and ends, its hash, and which texts they are of."""

    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes | None]):
        lists = [words_of(x) for x in texts]
        self.text_starts = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        self.joined = b" ".join(chain.from_iterable(lists))
        letters = np.frombuffer(self.joined, np.uint8)
        spaces = np.flatnonzero(letters == 32)
        self.starts = np.concatenate(([0], spaces + 1)) if len(letters) else np.zeros(0, np.int64)
        self.ends = np.append(spaces, len(letters)) if len(letters) else self.starts
        self.n = len(self.starts)

    def windows(self, size: int) -> np.ndarray:
        """The first words of the windows that lie in one text."""
        inside = np.ones(max(0, self.n - size + 1), bool)
        for a, b in zip(self.text_starts[:-1].tolist(), self.text_starts[1:].tolist(), strict=True):
            inside[max(a, b - size + 1) : b] = False
        return np.flatnonzero(inside)

    def codes(self) -> np.ndarray:
        """Hashes of the words: of each, the sum of its letters times powers, by sums over the text, BLOCK letters at a time."""
        letters, out, at = np.frombuffer(self.joined, np.uint8), np.empty(self.n, np.uint64), 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK, "right")))
            base = int(self.starts[at])
            size = int(self.ends[to - 1]) - base
            powers, inverses = self._powers_of(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((letters[base : base + size].astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
            starts = self.starts[at:to] - base
            out[at:to] = (sums[self.ends[at:to] - base] - sums[starts]) * inverses[starts]
            at = to
        return _mixed(out)

    @classmethod
    def _powers_of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers) < size:
            steps = np.full(max(BLOCK, size), _BASE, np.uint64), np.full(max(BLOCK, size), pow(_BASE, -1, 1 << 64), np.uint64)
            for s in steps:
                s[0] = 1
            cls._powers, cls._inverses = np.cumprod(steps[0]), np.cumprod(steps[1])
        return cls._powers, cls._inverses


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def runs(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k codes, from runs of powers of two."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    known, n = {1: codes}, 1
    while 2 * n <= k:
        known[2 * n] = known[n][:-n] * power(n) + known[n][n:]
        n *= 2
    out, width = known[n], n
    for n in sorted(known, reverse=True):
        while width + n <= k:
            size = max(0, len(codes) - (width + n) + 1)
            out, width = out[:size] * power(n) + known[n][width : width + size], width + n
    return _mixed(out)


def _least_places(grams: np.ndarray, span: int) -> np.ndarray:
    """Of every `span` neighbours, 2^16 in all at most, the place of the least by its leading 48 bits, the first of equal ones."""
    least, width = (grams & ~np.uint64(0xFFFF)) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (least & np.uint64(0xFFFF)).astype(np.int64)


class Stretches:
    """The windows of some texts, by their first words, in stretches around one anchor each."""

    def __init__(self, words: Words, window: int):
        self.codes = words.codes()
        self.window = window
        self.first_words = words.windows(window)
        width = min(ANCHOR, window)
        span = window - width + 1
        grams = runs(self.codes, width)
        anchor_at = np.concatenate([_least_places(grams[at : at + PART + span - 1], span) + at for at in range(0, words.n - window + 1, PART)])[self.first_words]
        changes = np.flatnonzero(np.diff(anchor_at, prepend=-1))
        self.anchors = grams[anchor_at[changes]]
        self.of = np.repeat(np.arange(len(changes)), np.diff(changes, append=len(anchor_at)))  # each window's stretch

    def window_hashes(self) -> np.ndarray:
        return runs(self.codes, self.window)[self.first_words]


class Bits:
    """A set of hashes as a bitmap over their leading bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of hashes, in words of 64 bits: 16 bits a hash, MOST_BITS (32 MB) at most."""
    bits = 1 << 12
    n = hashes.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = F.shiftrightunsigned(F.col(column), 64 - bits.bit_length() + 1)
    mask = F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")
    by_word = hashes.select(place.alias("place")).groupBy(F.shiftrightunsigned("place", 6).cast("int").alias("word")).agg(mask)
    words = np.zeros(bits // 64, np.uint64)
    found = by_word.toArrow()  # a row a word of the bitmap at most
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return words


def _scan(docs: DataFrame, out: T.StructType, start: Callable[[], Callable[..., Iterator[list]]]) -> DataFrame:
    """An Arrow pass over (k1, k2, text) without a shuffle: start() gives, once a task, a function of the columns of some rows, or of
    None at the end, to columns of `out`."""
    small_batches(docs.sparkSession)
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        batch_of = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        for whole in batches:
            texts, held, at = as_bytes(whole.column("text")), 0, 0
            k1, k2 = whole.column("k1").to_numpy(), whole.column("k2").to_numpy()
            for k, x in enumerate(texts, 1):
                held += len(x)
                if held > TEXT_BYTES or k == len(texts):
                    for columns in one(k1[at:k], k2[at:k], texts[at:k]):
                        yield batch_of(columns)
                    held, at = 0, k
        for columns in one(None, None, None):
            yield batch_of(columns)

    return docs.select("k1", "k2", "text").mapInArrow(run, out)


def _counts(docs: DataFrame, hashes_of: Callable[[], Callable[[Stretches], np.ndarray]], window: int) -> DataFrame:
    """(hash, n) of hashes of every text's stretches, combined in the task before they move."""
    out = T.StructType().add("hash", "long").add("n", "long")

    def start():
        of, held, size = hashes_of(), [], 0

        def one(k1, k2, texts):
            nonlocal held, size
            if texts is not None:
                words = Words(texts)
                if words.n < window:
                    return
                own = of(Stretches(words, window))
                held.append(own)
                size += len(own)
            if held and (texts is None or size >= 16 * COMBINED_ROWS):
                values, n = np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
                for at in range(0, len(values), COMBINED_ROWS):
                    yield values[at : at + COMBINED_ROWS].view(np.int64), n[at : at + COMBINED_ROWS]

        return one

    return _scan(docs, out, start).groupBy("hash").agg(F.sum("n").alias("n"))


def _pieces(words: Words, window: int, recurring: Bits, hot: Bits, windows: Bits) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Anchors, first words and texts of the stretches that may hold recurring windows."""
    s = Stretches(words, window)
    able = recurring.has(s.anchors)
    if not able.any():
        return [], np.zeros(0, np.int64), []
    on = able[s.of]
    trimmed = (hot.has(s.anchors) & able)[s.of]
    if trimmed.any():
        on &= ~trimmed | windows.has(s.window_hashes())
    changes = np.diff(s.of, prepend=-1, append=-1) != 0
    edge = np.concatenate(([False], on, [False]))
    first = np.flatnonzero(on & (changes[:-1] | ~edge[:-2]))
    last = np.flatnonzero(on & (changes[1:] | ~edge[2:]))
    joined, first_words = words.joined, s.first_words[first]
    begins, ends = words.starts[first_words].tolist(), words.ends[s.first_words[last] + window - 1].tolist()
    return s.anchors[s.of[first]].view(np.int64).tolist(), first_words, [joined[a:b] for a, b in zip(begins, ends, strict=True)]


_FOUND = T.StructType().add("id", "binary").add("first", "integer").add("end", "integer")


def _stretch_id(anchor: int, stretch: bytes) -> bytes:
    return xxh3_128_digest(stretch, anchor & (2**64 - 1))


def confirm(stretches: list[bytes], split: list[list[bytes]], counts: list[int], window: int) -> Iterator[tuple[int, int, int]]:
    """Passages of one anchor's stretches (words joined by a space, and split): runs of windows that occur twice or more, as
    (stretch, first word, end)."""
    if len(stretches) == 1:
        if counts[0] > 1:
            yield 0, 0, len(split[0])
        return
    times: dict[bytes, int] = {}
    windows_of = []
    for x, words, n in zip(stretches, split, counts, strict=True):
        ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
        windows = [x[a:b] for a, b in zip([0, *[e + 1 for e in ends]], ends[window - 1 :], strict=False)]
        windows_of.append(windows)
        for w in windows:
            times[w] = times.get(w, 0) + n
    for j, windows in enumerate(windows_of):
        first = None
        for k, w in enumerate((*windows, None)):
            recurs = w is not None and times[w] > 1
            if recurs and first is None:
                first = k
            elif not recurs and first is not None:
                yield j, first, k + window - 1
                first = None


def locate(anchors: list[tuple[int, dict[bytes, int]]], window: int) -> Iterator[tuple[bytes, int, int]]:
    """_FOUND of the stretches of some anchors, with their counts: the words of each that occurrences of confirmed passages
    cover, by an automaton over words."""
    import ahocorasick

    number: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    texts: list[tuple[int, bytes, tuple]] = []
    for anchor, counts in anchors:
        stretches = list(counts)
        if len(stretches) == 1 and counts[stretches[0]] == 1:
            continue
        split = [x.split(b" ") for x in stretches]
        spans = list(confirm(stretches, split, list(counts.values()), window))
        if spans:  # the windows of a stretch are all of its anchor
            numbers = [tuple([number.setdefault(w, len(number)) for w in words]) for words in split]
            for j, first, end in spans:
                machine.add_word(numbers[j][first:end], end - first)
            texts += zip(repeat(anchor), stretches, numbers)
    if not len(machine):
        return
    machine.make_automaton()
    for anchor, x, numbers in texts:
        spans: list[list[int]] = []
        for last, n in machine.iter(numbers):
            first, end = last - n + 1, last + 1
            while spans and spans[-1][0] >= first:
                spans.pop()
            if spans and spans[-1][1] >= first:
                spans[-1][1] = end
            else:
                spans.append([first, end])
        for first, end in spans:
            yield _stretch_id(anchor, x), first, end


def _in_shards(stretches: DataFrame, window: int) -> DataFrame:
    """_FOUND of different stretches, by shards of anchors."""
    kinds = to_arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple[int, dict[bytes, int]]] = []

        def found():
            rows = list(locate(chunk, window))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], schema=kinds)

        size, now = 0, None
        for batch in batches:
            for anchor, x, n in zip(batch.column("anchor").to_pylist(), batch.column("stretch").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if anchor != now:
                    if size > AUTOMATON_WORDS:
                        yield found()
                        chunk, size = [], 0
                    chunk.append((anchor, {}))
                    now = anchor
                held = chunk[-1][1]
                size += 0 if x in held else x.count(b" ") + 1
                held[x] = held.get(x, 0) + n
        if chunk:
            yield found()

    return stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def _keyed(docs: DataFrame, text: str, k1: str, k2: str, own: str) -> DataFrame:
    """docs with the text read as UTF-8 and two hashes of it: equal texts have equal results."""
    out = docs.withColumn(own, F.make_valid_utf8(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    return out.withColumns({k1: F.xxhash64(F.col(own)), k2: F.xxhash64(F.lit(1), F.col(own))})


def covered(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """k1, k2 (hashes of a text), spans (first word, end): the words of each text that recurring windows cover. Spans may
    touch or overlap. Texts without such words have no row."""
    if window < 1:
        raise ValueError("a window has one word or more")
    spark = docs.sparkSession
    lean = _keyed(docs.select(text), text, "k1", "k2", "__whole").select("k1", "k2", F.col("__whole").alias("text"))

    anchors = materialize(_counts(lean, lambda: lambda s: s.anchors, window).where(F.col("n") > 1))
    recurring = spark.sparkContext.broadcast(_bitmap(anchors, "hash"))
    hot = spark.sparkContext.broadcast(_bitmap(anchors.where(F.col("n") >= HOT), "hash"))

    def hot_windows():
        bits = Bits(hot.value)

        def of(s):
            chosen = bits.has(s.anchors)
            return s.window_hashes()[chosen[s.of]] if chosen.any() else np.zeros(0, np.uint64)

        return of

    windows = spark.sparkContext.broadcast(_bitmap(materialize(_counts(lean, hot_windows, window).where(F.col("n") > 1)), "hash"))

    def pieces_of():
        sets = Bits(recurring.value), Bits(hot.value), Bits(windows.value)
        return lambda words: _pieces(words, window, *sets) if words.n >= window else ([], np.zeros(0, np.int64), [])

    combined = T.StructType().add("anchor", "long").add("stretch", "binary").add("n", "long")
    refers = T.StructType().add("k1", "long").add("k2", "long").add("id", "binary").add("at", "integer")

    def stretches():
        pieces, held, size = pieces_of(), {}, 0

        def one(k1, k2, texts):
            nonlocal held, size
            if texts is not None:
                anchors_of, _, own = pieces(Words(texts))
                for key in zip(anchors_of, own, strict=True):
                    if key in held:
                        held[key] += 1
                    else:
                        held[key] = 1
                        size += len(key[1])
            if held and (texts is None or size > 32 << 20):
                rows = list(held.items())
                held, size = {}, 0
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield [k[0] for k, _ in part], [k[1] for k, _ in part], [n for _, n in part]

        return one

    def references():
        pieces, told = pieces_of(), set()

        def one(k1, k2, texts):
            if texts is None:
                return
            if len(told) > _TEXTS_KEPT:
                told.clear()
            new = []  # a copy in the same task refers to the same stretches
            for k, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                if key not in told:
                    told.add(key)
                    new.append(k)
            words = Words([texts[k] for k in new])
            anchors_of, first_words, own = pieces(words)
            if own:
                text = np.searchsorted(words.text_starts, first_words, "right") - 1
                row = np.asarray(new)[text]
                yield k1[row], k2[row], [_stretch_id(a, x) for a, x in zip(anchors_of, own, strict=True)], first_words - words.text_starts[text]

        return one

    found = materialize(_in_shards(_scan(lean, combined, stretches), window))
    placed = _scan(lean, refers, references).join(found, "id")
    span = F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("end")).alias("end"))
    return placed.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def without_repeats(
    docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, into: tuple[str, str, str] = ("n_words", "n_removed", "kept")
) -> DataFrame:
    """Columns `keep` and, named by `into`, the words of the whole text, those removed, and the kept words joined by one space.

    A word goes if any window that covers it also starts elsewhere, in another row or in the same text. Null texts have
    no words; texts shorter than a window keep all; repeated rows are copies of each other and lose every window. Windows are judged on the
    input. A kept column named as in `into` gives way; an empty table gives no rows.
    """
    k1, k2, spans, own = (unused(docs.columns, n) for n in ("__k1", "__k2", "__spans", "__whole"))
    marks = covered(docs, text, window).withColumnsRenamed({"k1": k1, "k2": k2, "spans": spans})
    rows = _keyed(docs.select(*dict.fromkeys([*keep, text])), text, k1, k2, own).join(marks, [k1, k2], "left").drop(k1, k2)
    n_words, n_removed, kept = into
    out = T.StructType().add(n_words, "long").add(n_removed, "long").add(kept, "string")

    def start():
        def one(x, places):
            words = words_of(x)
            if not places:
                return len(words), 0, b" ".join(words).decode()
            stay = bytearray(b"\1") * len(words)
            for p in places:
                stay[p["first"] : p["end"]] = bytes(p["end"] - p["first"])
            left = [w for w, s in zip(words, stay, strict=True) if s]
            return len(words), len(words) - len(left), b" ".join(left).decode()

        return one

    return map_texts(rows, own, keep, out, start, beside=(spans,))


def op12_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
