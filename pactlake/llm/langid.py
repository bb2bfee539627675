"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (1 to 3, of lower-case letters, what is
no letter being a space) that both hold, n by n (a blended spectrum of presence), over the root of
their own numbers. A bounded set of landmark texts gives Nystrom features, in which one ridge
regression per language tells it from the rest. n-grams are hashed to 2^BITS places, so the kernel is
a product of indicator matrices, and landmarks, whitening and weights fold into one matrix of a row
per place and a column per language: texts are scored in batches by one product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, held_out, map_texts, materialize, small_batches, table, text_of

BITS, ORDERS = 15, (1, 2, 3)
#: Bounds of the sample that the model is fitted on: texts of all languages together, but LEAST_ROWS of each
#: however many they are; and landmarks among them, one for each language at least.
TRAIN_ROWS, LEAST_ROWS, LANDMARKS = 6000, 20, 400
#: The model has 128 KB a language, 131 MB at most; a column of more values than these is refused, none are left out.
MOST_LANGUAGES = 1000
#: Places of a block of indicators while the model is made, and numbers gathered at a time while it scores.
PLACES, GATHERED = 4096, 1 << 22
RIDGE, SHARPNESS, SEED = 0.01, 6.0, 42
UNKNOWN = "und"
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_alphabet: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code of each code point: its lower case if it is a letter, otherwise a space."""
    if not _alphabet:
        codes = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                codes[c] = ord(low) if len(low) == 1 else c
        _alphabet.append(codes)
    return _alphabet[0]


class Spectrum:
    """Places of the n-grams that occur in a text, each once; empty for a text without a letter."""

    def __init__(self):
        self.flags, self.letters = np.zeros(1 << BITS, np.bool_), _letters()

    def __call__(self, text: bytes | None) -> np.ndarray:
        flags = self.set(text)
        places = np.flatnonzero(flags)
        flags[places] = False
        return places

    def set(self, text: bytes | None) -> np.ndarray:
        """The same as flags, which the next call reuses."""
        self.flags[:] = False
        points = np.frombuffer(text_of(text).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.letters[points]
        if not (codes != 32).any():
            return self.flags
        codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
        for n in ORDERS:
            mixed = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * _PRIMES[k]
            mixed ^= mixed >> np.uint32(15)
            self.flags[(mixed * _PRIMES[3]) >> np.uint32(32 - BITS)] = True
        return self.flags


def dense(rows: list[np.ndarray], low: int = 0, high: int = 1 << BITS) -> np.ndarray:
    """Indicators of unit length, a row each, of the places from low to high."""
    out = np.zeros((len(rows), high - low), np.float32)
    for k, places in enumerate(rows):
        if len(places):
            out[k, places[(places >= low) & (places < high)] - low] = len(places) ** -0.5
    return out


def kernel(rows: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Of every row with every landmark, added up by blocks of places."""
    out = np.zeros((len(rows), len(marks)))
    for low in range(0, 1 << BITS, PLACES):
        of = dense(marks, low, low + PLACES).astype(np.float64).T
        for k in range(0, len(rows), 1024):
            out[k : k + 1024] += dense(rows[k : k + 1024], low, low + PLACES) @ of
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # a row per place, a column per language
    offset: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of a batch: the product of its sparse indicator matrix with the weights, as shares of 1. Weights are
        gathered for GATHERED / languages places at a time."""
        counts = np.array([len(r) for r in rows])
        places, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), counts)
        sums, step = np.zeros((len(rows), len(self.languages))), max(1, GATHERED // len(self.languages))
        for at in range(0, len(places), step):
            own = row[at : at + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[first]] += np.add.reduceat(self.weights[places[at : at + step]], first, axis=0)
        raw = SHARPNESS * (sums / np.sqrt(counts)[:, None] + self.offset)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def fit(rows: list[np.ndarray], languages: list[str]) -> Model | None:
    """From n-gram sets (not empty) and their languages. None without rows."""
    if not rows:
        return None
    names = sorted(set(languages))
    own = np.array([names.index(x) for x in languages])
    # landmarks by turns from each language
    order = np.random.default_rng(SEED).permutation(len(rows))
    turn = np.zeros(len(rows))
    for c in range(len(names)):
        of = order[own[order] == c]
        turn[of] = np.arange(len(of))
    chosen = order[np.argsort(turn[order], kind="stable")][: max(LANDMARKS, len(names))]
    marks = [rows[k] for k in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = kernel(rows, marks) @ whiten
    # each language weighs the same, its rows too
    share = 1 / np.bincount(own)[own] / len(names)
    x = np.column_stack([features, np.ones(len(rows))])
    y = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = np.diag([RIDGE / len(names)] * features.shape[1] + [0.0])
    w = np.linalg.solve((x * share[:, None]).T @ x + penalty, (x * share[:, None]).T @ y)
    folded = whiten @ w[:-1]  # a row per landmark, a column per language
    weights = np.concatenate([(dense(marks, low, low + PLACES).T @ folded).astype(np.float32) for low in range(0, 1 << BITS, PLACES)])
    return Model(names, weights, w[-1])


def train(documents: DataFrame, parts: int = 4, part: int = 2, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of documents that aren't held out and have a language: of every language as many different
    texts, TRAIN_ROWS in all (LEAST_ROWS of each at least), the first by a hash of the whole text. Copies of
    a text count once, so they crowd out neither texts nor languages."""
    own = documents.select(F.col("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    known = own.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id", parts, part)).withColumn("h", F.xxhash64("text", F.lit(SEED)))
    # hashes alone are counted and ranked; one document of each chosen text is looked up again
    copies = materialize(known.groupBy("lang", "h").agg(F.min(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id")))
    counts = copies.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    number = counts.count()
    if number > MOST_LANGUAGES:
        raise ValueError(f"{number} values of {lang!r} can't be languages")
    if not number:
        return None
    each = max(LEAST_ROWS, TRAIN_ROWS // number)
    # a share of each language's different texts by their hash, a little more than is needed, before any are ranked
    share = F.least(F.lit(1.0), F.lit(1.3 * each + 50) / F.col("texts"))
    some = copies.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = materialize(some.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "h", "id"))
    few = known.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(F.broadcast(chosen), ["lang", "h", "id"])

    def start():
        of = Spectrum()
        return lambda x: (np.packbits(of.set(x)).tobytes(),)

    sets = map_texts(few, "text", ["lang", "h"], T.StructType().add("places", "binary"), start).groupBy("lang", "h").agg(F.min("places").alias("places"))
    found = sorted(((r["lang"], bytes(r["places"])) for r in sets.toLocalIterator()))  # 4 KB each
    sets, names = [np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))).astype(np.int32) for _, p in found], [x for x, _ in found]
    return fit([s for s in sets if len(s)], [x for x, s in zip(names, sets, strict=True) if len(s)])


def identify(df: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, lang_pred and score of every whole text: the language with the largest share
    and that share. `und` with score 0 if the text is null or has no letter, or if nothing was learned.
    Bytes that aren't UTF-8 are no letters. A kept column of the name of a result column gives way."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text__"))
    schema = T.StructType([source.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = Spectrum(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                sets = [of(x) for x in as_bytes(batch.column(len(keep)))]
                names, scores = [UNKNOWN] * len(sets), [0.0] * len(sets)
                able = [k for k, s in enumerate(sets) if len(s)] if m else []
                if able:
                    shares = m.scores([sets[k] for k in able])
                    for k, best, row in zip(able, shares.argmax(axis=1).tolist(), shares, strict=True):
                        names[k], scores[k] = m.languages[best], float(row[best])
                columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def op10_language_string_kernel(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, train(documents), ["doc_id"])
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
