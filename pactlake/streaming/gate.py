"""The gate: the same rules over records that arrive, each routed by its verdict.

A record passes, is blocked (dead letter only) or, under policy warn, passes with a dead letter. Rules
on one row are column expressions on the stream. Uniqueness needs memory: REFUSE won't start, SKIP
leaves it out, TRACK keeps the seen keys of each micro-batch in a table beside the checkpoint.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from collections import Counter, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shapes import preview
from ..plans import rules as R
from ..plans.spec import Contract, ContractError, Model
from ..sources.read import LINE, ROW
from .records import judge_texts

REFUSE, SKIP, TRACK = "refuse", "skip", "track"
MAX_BYTES = 16 << 20
PREVIEW_BYTES = 256
_VIOLATIONS = T.ArrayType(T.StructType().add("field", "string").add("rule", "string").add("value", "string"))


def with_records(df: DataFrame, value: str = "value") -> DataFrame:
    """LINE and RECORD of a stream or table of lines, as text or bytes. Bytes that aren't UTF-8, and
    records over 16 MiB, have no RECORD."""
    raw = F.col(value)
    if isinstance(df.schema[value].dataType, T.BinaryType):
        text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    else:
        text = raw
    small = F.when(F.octet_length(raw) <= MAX_BYTES, text)
    return df.withColumn(LINE, small).withColumn(R.RECORD, R.parse_records(small))


def violations(model: Model) -> Column:
    """Of a parsed record with R.with_members(): what it breaks, uniqueness aside."""
    compiled = R.compile_records(model, True)
    one = lambda field, rule, text: F.struct(field.alias("field"), rule.alias("rule"), preview(text).alias("value"))
    found = F.array_compact(F.array(*[F.when(r.broken, one(F.lit(r.field).cast("string"), F.lit(r.rule), r.text)) for r in compiled.rules]))
    if not model.strict:
        return found
    keys = F.when(F.col(R.RECORD).isNotNull(), R.unexpected_keys(model, F.col(LINE)))
    extra = F.transform(keys, lambda k: one(k, F.lit("unexpected_field"), F.lit(None).cast("string")))
    return F.concat(found, F.coalesce(extra, F.array().cast(_VIOLATIONS)))


def verdict(found: Column, contract: Contract) -> Column:
    return F.when(F.size(found) == 0, "pass").otherwise("warn" if contract.policy.on_violation == "warn" else "block")


def judge(df: DataFrame, contract: Contract, model: str | None = None, unique: str = REFUSE, value: str = "value") -> DataFrame:
    """df with `violations` and `verdict`. A null value (a tombstone) passes unjudged. Stateless, so it
    runs on a stream too; TRACK needs gate()."""
    name, m = _model(contract, model, unique)
    assert name
    judged = R.with_members(with_records(df, value), m)
    judged = judged.withColumn("violations", F.when(F.col(value).isNull(), F.array().cast(_VIOLATIONS)).otherwise(violations(m)))
    judged = R.without_members(judged, m)
    # the outer explode keeps a filter on the verdict from being pushed below, where it would repeat all this
    return judged.select("*", F.explode_outer(F.array(verdict(F.col("violations"), contract))).alias("verdict"))


def each_violation(judged: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, field, rule and value: a row a violation. Spark would test judge()'s whole expression
    for violations again before it unfolds them; with the outer form it doesn't."""
    return judged.select(*keep, F.inline_outer("violations")).where(F.col("rule").isNotNull())


def _model(contract: Contract, model: str | None, unique: str) -> tuple[str, Model]:
    if errors := [f for f in contract.lint() if f.level == "error"]:
        raise ContractError("; ".join(f"{f.path}: {f.message}" for f in errors))
    name, m = contract.model(model)
    if unique == REFUSE and any(f.unique for f in m.fields.values()):
        raise ContractError("unique fields need memory of past records: choose track or skip")
    return name, m


def envelope(contract: Contract, model: str, value: str = "value") -> Column:
    """The dead letter of a judged record: who judged it, the record itself, and what it broke. Of a
    record over 16 MiB only the beginning."""
    raw = F.col(value).cast("string")
    kept = F.when(F.octet_length(value) <= MAX_BYTES, raw).otherwise(F.substring(raw, 1, PREVIEW_BYTES))
    return F.to_json(
        F.struct(
            F.lit(contract.id).alias("contract_id"), F.lit(contract.version).alias("contract_version"), F.lit(model).alias("model"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), kept.alias("record"), F.col("violations"),
        )
    )


def track(judged: DataFrame, m: Model, contract: Contract, order: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Judged records with `unique` violations of the second and later records of a key, in `order`,
    and (field, key) of all keys seen so far. A record counts whether or not it was blocked."""
    if not any(f.unique for f in m.fields.values()):
        return judged, judged.select(F.lit("").alias("field"), F.lit("").alias("key")).limit(0)
    each = unique_keys(judged, m, order)
    # the first record of each key is a minimum: no window gathers the records of a frequent key
    first = each.groupBy("field", "key").agg(F.min("__order").alias("__first"))
    if seen is not None:
        first = first.join(seen.withColumn("__seen", F.lit(True)), ["field", "key"], "left")
    else:
        first = first.withColumn("__seen", F.lit(None).cast("boolean"))
    repeated = each.join(first, ["field", "key"]).where((F.col("__order") > F.col("__first")) | F.coalesce("__seen", F.lit(False)))
    one = F.struct("field", F.lit("unique").alias("rule"), preview(F.col("key")).alias("value"))
    more = repeated.groupBy("__order").agg(F.sort_array(F.collect_list(one)).alias("__more"))
    out = judged.join(more, judged[order] == more["__order"], "left")
    out = out.withColumn("violations", F.concat("violations", F.coalesce("__more", F.array().cast(_VIOLATIONS)))).drop("__more", "__order")
    fresh = first.where(F.col("__seen").isNull()).select("field", "key")
    return out.withColumn("verdict", verdict(F.col("violations"), contract)), fresh


#: Seconds of a bucket of recent throughput, and how many buckets are kept.
RECENT_SECONDS, RECENT_BUCKETS = 10, 36


@dataclass
class GateStats:
    """Counters of a run. Latency is that of micro-batches, shared out to their records, as there is no
    clock for a single one."""

    records: int = 0
    passed: int = 0
    blocked: int = 0
    warned: int = 0
    violations: int = 0
    tombstones: int = 0
    per_rule: Counter = field(default_factory=Counter)  # (field, rule) -> count
    nanos: Counter = field(default_factory=Counter)  # by power of two -> records
    recent: deque = field(default_factory=lambda: deque(maxlen=RECENT_BUCKETS))  # [slot, records, blocked]
    started_at: str = field(default_factory=lambda: _now())

    def add(self, counts: dict[str, int], per_rule: dict[tuple[str, str], int], seconds: float, now: float | None = None) -> None:
        """A batch: counts by name, violations by (field, rule), how long it took."""
        for name, n in counts.items():
            setattr(self, name, getattr(self, name) + n)
        self.per_rule.update(per_rule)
        if not counts["records"]:
            return
        self.nanos[int(1e9 * seconds / counts["records"]).bit_length()] += counts["records"]
        slot = int((time.time() if now is None else now) // RECENT_SECONDS)
        if not self.recent or self.recent[-1][0] != slot:
            self.recent.append([slot, 0, 0])
        self.recent[-1][1] += counts["records"]
        self.recent[-1][2] += counts.get("blocked", 0)

    def counters(self) -> dict[str, int]:
        return {n: getattr(self, n) for n in ("records", "passed", "blocked", "warned", "violations", "tombstones")}

    def p99_micros(self) -> float | None:
        """An upper bound of what 99 of 100 records took, a power of two of nanoseconds."""
        want, done = 0.99 * sum(self.nanos.values()), 0
        for power, n in sorted(self.nanos.items()):
            done += n
            if done >= want:
                return 2**power / 1000
        return None

    def snapshot(self, contract: Contract, model: str) -> dict:
        rules = sorted(self.per_rule.items(), key=lambda x: (-x[1], x[0]))
        return {
            "gate_stats": 1, "contract": contract.id, "version": contract.version, "model": model, "started_at": self.started_at, "updated_at": _now(), **self.counters(),
            "p99_validate_micros": self.p99_micros(), "per_rule": [{"field": f, "rule": r, "count": n} for (f, r), n in rules],
            "recent": [{"records": n, "blocked": b} for _, n, b in self.recent],
        }

    def failed(self, contract: Contract) -> bool:
        return contract.policy.on_violation == "block" and self.violations > contract.policy.max_violations


def _now() -> str:
    return datetime.now(UTC).isoformat()


class SeenKeys:
    """Keys of the batches so far, as 128 bits each, in a folder of runs.

    A run holds the keys of some batches in buckets by the leading bits of their hash, about BUCKET_KEYS in each. A batch adds a
    run, and COMPACT runs of one level are merged into one of the next, so that there are few and a key is written again only
    as often as the levels grow. A batch reads the buckets of its own keys, one in each run: that depends on its keys, not on how many were seen.
    """

    BUCKET_KEYS, COMPACT = 4096, 8
    SCHEMA = T.StructType().add("a", "long").add("b", "long")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        return self.store.exists(self.path(path))

    def _runs(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, bits of its buckets) of the runs that were written to their end, without those
        that a merged run contains."""
        if not self._exists(self.folder):
            return []
        names = [x.getPath().getName() for x in self.store.listStatus(self.path(self.folder))]
        runs = [tuple(map(int, n.removeprefix("run=").split("-"))) for n in names if n.startswith("run=")]
        runs = sorted((r for r in runs if self._exists(f"{self._at(r)}/_SUCCESS")), reverse=True)
        return [r for r in runs if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in runs)]

    def _at(self, run: tuple) -> str:
        return f"{self.folder}/run={'-'.join(map(str, run))}"

    def _delete(self, run: tuple) -> None:
        self.store.delete(self.path(self._at(run)), True)

    @staticmethod
    def _hashed(keys: DataFrame) -> DataFrame:
        """keys (field, key) with a and b."""
        return keys.withColumns({"a": F.xxhash64("field", "key"), "b": F.xxhash64(F.lit(1), "field", "key")})

    @staticmethod
    def _bucket(bits: int) -> Column:
        return F.shiftrightunsigned("a", 64 - bits).cast("long") if bits else F.lit(0).cast("long")

    def _write(self, level: int, first: int, last: int, hashes: DataFrame, n: int) -> None:
        bits = max(0, (n - 1) // self.BUCKET_KEYS).bit_length()
        out = hashes.select("a", "b", self._bucket(bits).alias("bucket"))
        (out.repartition("bucket") if bits else out.coalesce(1)).write.mode("overwrite").partitionBy("bucket").parquet(self._at((level, first, last, bits)))

    def _compact(self, number: int) -> None:
        """Merges the runs of earlier batches, which are done with, where a level has too many."""
        level = 0
        while True:
            runs = [r for r in self._runs() if r[2] < number]
            if not any(r[0] >= level for r in runs):
                return
            own = [r for r in runs if r[0] == level]
            if len(own) >= self.COMPACT:
                merged = self._read([self._at(r) for r in own])
                self._write(level + 1, min(r[1] for r in own), max(r[2] for r in own), merged, merged.count())
                for r in own:
                    self._delete(r)
            level += 1

    def of_buckets(self, number: int, hashes: DataFrame) -> DataFrame | None:
        """(a, b) of earlier batches in the buckets of the hashes; None if there are none."""
        runs = [r for r in self._runs() if r[2] < number]
        if not runs:
            return None
        n = hashes.count()
        # of a run of many more buckets than the batch has keys, those of the keys; others whole
        fine = max((r[3] for r in runs if 8 * n < 1 << r[3]), default=0)
        leading = [r[0] for r in hashes.select(self._bucket(fine)).distinct().collect()] if fine else []
        paths = []
        for r in runs:
            if 8 * n < 1 << r[3]:
                each = [f"{self._at(r)}/bucket={k}" for k in {x >> (fine - r[3]) for x in leading}]
                paths += [p for p in each if self._exists(p)]
            else:
                paths.append(self._at(r))
        return self._read(paths) if paths else None

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.folder).parquet(*paths).select("a", "b")

    def before(self, number: int, keys: DataFrame) -> DataFrame | None:
        """Those of keys (field, key) that earlier batches had, each once; None if there were no earlier keys."""
        self._compact(number)
        asked = self._hashed(keys.select("field", "key").distinct())
        held = self.of_buckets(number, asked)
        return None if held is None else asked.join(held, ["a", "b"], "left_semi").select("field", "key")

    def add(self, number: int, fresh: DataFrame) -> None:
        """Keeps the new keys of a batch, in place of those of failed attempts at it."""
        for r in self._runs():
            if r[1] >= number:
                self._delete(r)
        hashes = self._hashed(fresh).select("a", "b").persist()
        if n := hashes.count():
            self._write(0, number, number, hashes, n)
        hashes.unpersist()


class BatchJudge:
    """Judges the micro-batches of a stream, in turn: what the file gate and the Kafka gate share."""

    def __init__(self, spark: SparkSession, contract: Contract, checkpoint: str, model: str | None = None, unique: str = REFUSE, value: str = "value", stats: str | None = None):
        self.name, self.model = _model(contract, model, unique)
        self.spark, self.contract, self.value, self.stats = spark, contract, value, stats
        self.mode = SKIP if unique == TRACK else unique
        self.totals = GateStats()
        self.seen = SeenKeys(spark, f"{checkpoint.rstrip('/')}-seen") if unique == TRACK and any(f.unique for f in self.model.fields.values()) else None

    @contextmanager
    def batch(self, rows: DataFrame, number: int) -> Iterator[DataFrame]:
        """The judged rows of a batch, to be written whole. What is counted is observed as they are first written. When the outputs are
        written, the batch's keys are kept."""
        began = time.perf_counter()
        judged = first = judge(rows, self.contract, self.name, self.mode, self.value).withColumn(ROW, F.monotonically_increasing_id()).persist()
        fresh = None
        try:
            if self.seen is not None:
                keys = unique_keys(first, self.model, ROW).select("field", "key")
                judged, fresh = track(first, self.model, self.contract, ROW, self.seen.before(number, keys))
                judged = judged.persist()
            told = Observation()
            yield judged.observe(told, *_metrics(self.model, self.value))
            if fresh is not None:
                self.seen.add(number, fresh)
            self._count(told.get, began)
        finally:
            if judged is not first:
                judged.unpersist()
            first.unpersist()

    def _count(self, told: dict, began: float) -> None:
        self.totals.add(*_counted(told, self.model), time.perf_counter() - began)
        if self.stats:
            self.stats = write_stats(self.stats, self.totals.snapshot(self.contract, self.name))


def _told_rules(m: Model) -> list[tuple[str, str]]:
    """Every (field, rule) that a record can break. A field that the model doesn't declare counts as the empty name:
    there is no bound to such keys."""
    rules = [(r.field or "", r.rule) for r in R.compile_records(m).rules] + [(n, "unique") for n, f in m.fields.items() if f.unique]
    return rules + ([("", "unexpected_field")] if m.strict else [])


def _metrics(m: Model, value: str) -> list[Column]:
    """Counters of judged records as aggregates that can be observed: by name, and r0, r1, ... by rule."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    many = F.size("violations")
    out = [
        F.count(F.lit(1)).alias("records"), is_("pass").alias("passed"), is_("block").alias("blocked"), is_("warn").alias("warned"),
        F.coalesce(F.sum(many), F.lit(0)).cast("long").alias("violations"), F.count_if(F.col(value).isNull()).alias("tombstones"),
    ]
    for k, (name, rule) in enumerate(_told_rules(m)):
        # records that break nothing aren't looked through
        out.append(F.coalesce(F.sum(F.when(many > 0, F.size(F.filter("violations", _is_of(name, rule))))), F.lit(0)).cast("long").alias(f"r{k}"))
    return out


def _is_of(name: str, rule: str) -> Callable[[Column], Column]:
    return lambda x: (x["rule"] == rule) & (x["field"] == name if name else F.lit(True))


def _counted(told: dict, m: Model) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    by_rule = {key: told[f"r{k}"] for k, key in enumerate(_told_rules(m)) if told[f"r{k}"]}
    return {n: told[n] for n in ("records", "passed", "blocked", "warned", "violations", "tombstones")}, by_rule


def batch_counts(judged: DataFrame, m: Model, value: str = "value") -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Of judged records: counts by name, and violations by (field, rule), in one pass."""
    return _counted(judged.agg(*_metrics(m, value)).first().asDict(), m)


def unique_keys(judged: DataFrame, m: Model, order: str) -> DataFrame:
    """(__order, field, key) of each record's values of unique fields."""
    compiled = R.compile_records(m)
    keys = F.array(*[F.struct(F.lit(n).alias("field"), F.when(v.ok, v.key.cast("string")).alias("key")) for n, v in compiled.unique.items()])
    return judged.select(F.col(order).alias("__order"), F.explode(keys).alias("k")).select("__order", "k.field", "k.key").where(F.col("key").isNotNull())


def gate(stream: DataFrame, contract: Contract, clean: str, dead: str, checkpoint: str, model: str | None = None, unique: str = REFUSE, value: str = "value", stats: str | None = None, trigger: dict | None = None):
    """Starts the gate on a stream of lines: clean records, verbatim, under `clean`, dead letters under
    `dead`, one folder a micro-batch, so a batch that runs again replaces its own output and nothing is
    lost or doubled. Returns (query, GateStats of this run)."""
    judges = BatchJudge(stream.sparkSession, contract, checkpoint, model, unique, value, stats)

    def route(batch: DataFrame, number: int) -> None:
        with judges.batch(batch, number) as judged:
            ok = judged.where(F.col("verdict") != "block").where(F.col(value).isNotNull() & (F.octet_length(value) <= MAX_BYTES))
            ok.select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(f"{clean}/batch={number}")
            bad = judged.where(F.col("verdict") != "pass")
            bad.select(envelope(contract, judges.name, value).alias("value")).write.mode("overwrite").text(f"{dead}/batch={number}")

    writer = stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(), judges.totals


def write_stats(path: str, snapshot: dict) -> str | None:
    """Replaces the snapshot as a whole. Returns the path, or None if it can't be written: told once, and
    never a reason to stop the gate."""
    try:
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(snapshot, f, ensure_ascii=False)
        os.replace(f"{path}.tmp", path)
    except OSError as e:
        print(f"warning: no more statistics to {path}: {e}", file=sys.stderr)
        return None
    return path


def throughput(df: DataFrame, ts: str, seconds: int = 10) -> DataFrame:
    """(start, records) of each window of so many seconds."""
    return df.groupBy(F.window(F.col(ts), f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("records")).select(F.col("w.start").alias("start"), "records")


def newest_dead_letters(spark: SparkSession, dead: str, limit: int = 50) -> tuple[list[dict], int]:
    """The newest letters (1 to 500), and how many of the lines read for it hold none. Batches are read from the newest
    backwards, twice as many each time, until there are enough letters: what is read doesn't grow with the folder."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    path = spark._jvm.org.apache.hadoop.fs.Path(dead)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    # batches by number; other files and folders by their age
    listed = [x for x in store.listStatus(path) if not x.getPath().getName().startswith(("_", "."))]
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"batch=(\d+)", x.getPath().getName())) else -1
    newest = [x.getPath().toString() for x in sorted(listed, key=lambda x: (number(x), x.getModificationTime()), reverse=True)]
    found: list[tuple[str, str]] = []
    skipped, at, many = 0, 0, 1
    while at < len(newest) and len(found) < limit:
        lines = spark.read.text(newest[at : at + many]).select("value", F.get_json_object("value", "$.ts").alias("ts"))
        told = Observation()
        top = lines.observe(told, F.count_if(F.col("ts").isNull()).alias("skipped")).where(F.col("ts").isNotNull()).orderBy(F.desc("ts")).limit(limit).collect()
        found += [(r["ts"], r["value"]) for r in top]
        skipped, at, many = skipped + told.get["skipped"], at + many, 2 * many
    found.sort(key=lambda x: x[0], reverse=True)
    return [json.loads(v) for _, v in found[:limit]], skipped


def register_functions(spark: SparkSession, contract: Contract, model: str | None = None, unique: str = REFUSE, prefix: str = "contract") -> None:
    """SQL functions of the same rules; null gives null. <prefix>_judge(text) gives a struct of verdict and dead_letter, for
    those who need both; <prefix>_verdict(text) and <prefix>_dead_letter(text) give one of them. A batch of texts is judged by one gate."""
    name, m = _model(contract, model, unique)
    assert m and name

    # columns can't be bound inside a SQL function, so texts are judged in Python, by Arrow batch
    @F.pandas_udf("verdict string, dead_letter string")
    def both(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge_texts(text, contract, name), columns=["verdict", "dead_letter"], dtype="object")

    def one(k: int):
        @F.pandas_udf("string")
        def run(text: pd.Series) -> pd.Series:
            return pd.Series([r[k] for r in judge_texts(text, contract, name)], dtype="object")

        return run

    spark.udf.register(f"{prefix}_judge", both)
    spark.udf.register(f"{prefix}_verdict", one(0))
    spark.udf.register(f"{prefix}_dead_letter", one(1))
