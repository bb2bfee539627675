"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams (1 to 4 bytes, hashed to 2^BITS places) are scaled by the log-count ratio
of the classes and separated by a linear hinge-loss model that is fitted by
dual coordinate descent (Wang and Manning, 2012; Hsieh et al., 2008). Margins become probabilities by
a logistic curve fitted on margins of folds that the model didn't see.
"""

from __future__ import annotations

import itertools
import mmap
import tempfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_texts, table

BITS, ORDERS = 18, (1, 2, 3, 4)
#: Runs of a word that equals its neighbour have indicators of their own, behind those of the n-grams.
REPEATS = (1, 2, 3, 4)
SIZE = (1 << BITS) + len(REPEATS)
#: Labelled rows of each class that the model is fitted on, the first by a hash of their doc_id.
TRAIN_ROWS = 4000
#: Parts in which the sample comes to the driver, one after the other: 16 MB each as a rule at most.
PARTS = 16
SMOOTHING, COST, EPOCHS, FOLDS, SEED = 1.0, 1.0, 12, 3, 42
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


class Indicators:
    """Places of the n-grams that occur in a text, each once; the flags are reused from text to text."""

    def __init__(self):
        self.flags = np.zeros(SIZE, np.bool_)

    def __call__(self, text: bytes | None) -> np.ndarray:
        codes = np.frombuffer(text or b"", np.uint8).astype(np.uint32) + 1
        for n in ORDERS:
            if len(codes) < n:
                break
            mixed = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * _PRIMES[k]
            mixed ^= mixed >> np.uint32(15)
            self.flags[(mixed * _PRIMES[3]) >> np.uint32(32 - BITS)] = True
        words = text.split() if text else []
        same = bytes([a == b for a, b in itertools.pairwise(words)])
        for k, n in enumerate(REPEATS):
            self.flags[(1 << BITS) + k] = b"\x01" * n in same
        places = np.flatnonzero(self.flags)
        self.flags[places] = False
        return places


def pack(places: np.ndarray) -> bytes:
    """Places as their list or as SIZE bits, whichever is shorter: 32 KB at most, whatever the text."""
    if 4 * len(places) < SIZE // 8:
        return b"l" + places.astype("<i4").tobytes()
    flags = np.zeros(SIZE, np.bool_)
    flags[places] = True
    return b"b" + np.packbits(flags).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"l":
        return np.frombuffer(packed, "<i4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), count=SIZE))


class Spool:
    """Byte strings in a temporary file of this process: memory only as long as the system has it to spare."""

    def __init__(self, rows: Iterable[bytes]):
        self.ends = [0]
        with tempfile.TemporaryFile() as file:
            for row in rows:
                self.ends.append(self.ends[-1] + file.write(row))
            file.flush()
            self.bytes = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if self.ends[-1] else b""

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> bytes:
        return self.bytes[self.ends[k] : self.ends[k + 1]]


class Packed:
    """Sets of places, kept packed and unpacked one at a time. at: which of the rows, each as often as it is named; all by default."""

    def __init__(self, rows: Sequence[bytes] | Spool, at: np.ndarray | None = None):
        self.rows, self.at = rows, np.arange(len(rows)) if at is None else at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k: int) -> np.ndarray:
        return unpack(self.rows[self.at[k]])

    def take(self, at: np.ndarray) -> Packed:
        return Packed(self.rows, self.at[at])


def log_count_ratio(rows: Packed | list[np.ndarray], y: np.ndarray) -> np.ndarray:
    sums = np.full((2, SIZE), SMOOTHING)
    for k, label in enumerate(y.tolist()):
        sums[label, rows[k]] += 1
    shares = sums / sums.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def descend(rows: Packed | list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of the squared hinge loss with L2 penalty, one dual
    coordinate at a time. rows: the places of each row, where it has the values scale[place]."""
    w, alpha, sign = np.zeros(len(scale) + 1), np.zeros(len(rows)), 2.0 * y - 1
    norms = np.array([np.square(scale[rows[k]]).sum() + 1.0 for k in range(len(rows))])
    diagonal = 0.5 / cost
    random = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)).tolist():
            places, s = rows[k], sign[k]
            v = scale[places]
            slope = s * (w[places] @ v + w[-1]) - 1 + diagonal[k] * alpha[k]
            new = max(0.0, alpha[k] - slope / (norms[k] + diagonal[k]))
            if (step := (new - alpha[k]) * s) != 0.0:
                w[places] += step * v
                w[-1] += step
                alpha[k] = new
    return w


def logistic(margins: np.ndarray, y: np.ndarray, totals: tuple[int, int]) -> tuple[float, float]:
    """Slope and offset of P(1) = 1 / (1 + exp(-(a * margin + b))) by Newton steps on smoothed targets;
    the classes weigh as their totals among all labelled rows."""
    n1, n0 = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)[:, None]
    weight = weight / weight.mean()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.column_stack([margins, np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        step = np.linalg.solve((weight * x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), (weight * x).T @ (target - p))
        ab += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


@dataclass
class Model:
    """score = logistic(slope * (scaled indicators . weights + bias) + offset)."""

    scaled: np.ndarray  # ratio * weights
    bias: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.scaled[places].sum(dtype=np.float64)) + self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.offset, -35, 35))))


def _fit(rows: Packed, y: np.ndarray) -> Model:
    ratio = log_count_ratio(rows, y)
    # one scale for all, so that short texts, with little evidence, stay near the bias
    ratio /= np.sqrt(np.mean([np.square(ratio[rows[k]]).sum() for k in range(len(rows))])) or 1.0
    share = y.mean()
    cost = COST * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w = descend(rows, ratio, y, cost)
    return Model((ratio * w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)


def fit(rows: Packed, y: np.ndarray, totals: tuple[int, int]) -> Model | float:
    """The model of labelled indicator sets, from classes of these totals. With one class only, its
    label; without rows, 0.5."""
    if len(y) == 0 or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    fold = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        seen, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if y[seen].min() == y[seen].max():
            continue
        part = _fit(rows.take(seen), y[seen])
        margins[other] = [part.margin(rows[i]) for i in other]
    model = _fit(rows, y)
    model.slope, model.offset = logistic(margins, y, totals)
    return model


def labelled(labels: DataFrame, column: str, parts: int, part: int, rows: int = TRAIN_ROWS) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, y): at most `rows` labelled doc_ids of each class that aren't held out, the first by
    a hash of the id; and how many there are of each. A doc_id with both labels counts as 1; other
    label values are ignored."""
    y = F.col(column).cast("int")
    known = labels.select("doc_id", column).where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
    known = known.groupBy("doc_id").agg(F.max(y).alias("y"))
    hashed = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    first = [known.where(F.col("y") == c).orderBy(hashed, "doc_id").limit(rows) for c in (0, 1)]
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    return first[0].union(first[1]), (totals.get(0, 0), totals.get(1, 0))


def indicators(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    def start():
        of = Indicators()
        return lambda x: (pack(of(x)),)

    return map_texts(df, text, keep, T.StructType().add("places", "binary"), start)


def sample(sets: DataFrame, most: int) -> tuple[Packed, np.ndarray]:
    """The first `most` rows (places, y) by a hash of the places, in this order: equal ones as one row and
    their number, a part at a time from the executors into a file, never all of them in the driver's memory."""
    hashed = F.xxhash64("places")
    each = sets.groupBy("places", "y").agg(F.count(F.lit(1)).alias("n"))
    parts = each.repartitionByRange(PARTS, hashed).sortWithinPartitions(hashed, "places", "y")
    y: list[int] = []
    at: list[int] = []

    def read():
        for k, r in enumerate(parts.toLocalIterator()):
            n = min(r["n"], most - len(y))
            y.extend([r["y"]] * n)
            at.extend([k] * n)
            yield r["places"]
            if len(y) == most:
                break

    rows = Spool(read())
    return Packed(rows, np.array(at, np.int64)), np.array(y, np.int64)


def train(documents: DataFrame, labels: DataFrame, column: str = "quality", parts: int = 3, part: int = 1, text: str = "text") -> Model | float:
    """The model of labelled documents outside the held-out part: at most 2 * TRAIN_ROWS of them, of
    whole texts, of which only the places of their n-grams come to the driver (32 KB each at most), into a file."""
    ids, totals = labelled(labels, column, parts, part)
    own = documents.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "doc_id")
    return fit(*sample(indicators(own, ["y"], "text"), 2 * TRAIN_ROWS), totals)


def score(df: DataFrame, model: Model | float, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """Columns `keep` and `into` (0 to 1, higher: good quality likelier) of every whole text. A null
    text counts as the empty one, which gets the score of a text without any n-gram. A kept column named
    as `into` gives way."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        of, m = Indicators(), shared.value
        return lambda x: ((m if isinstance(m, float) else m.score(of(x))),)

    return map_texts(df, text, keep, T.StructType().add(into, "double"), start)


def op9_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, ["doc_id"]).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
