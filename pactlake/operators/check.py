"""Checking data against a contract: exact counts in one aggregation, samples only where rules broke.

The counts of all rules are one aggregate over the source, without a shuffle but for its last row; the keys of
all unique fields are one more. Samples are a second pass, run for the rules that broke, and keep the first
rows of each rule by a window that Catalyst cuts to the sample's size before rows move.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shapes import observed, preview
from ..plans import rules as R
from ..plans.spec import Contract, ContractError, DatasetRule, Model, load
from ..sources.read import FILE, HIDDEN, LINE, RAGGED, ROW, Source, files_of, format_of, plain_path, read, typed_cells


@dataclass
class Sample:
    model: str
    field: str | None
    rule: str
    row: int | None
    value: str | None
    observed: dict | None = None
    file: str | None = None

    @property
    def message(self) -> str:
        where = f"{self.field}: " if self.field else ""
        return f"{where}{self.rule.replace('_', ' ')}" + (f" ({self.value})" if self.value is not None else "")


@dataclass
class Report:
    """Of one source: exact counts by (field, rule), samples, and whether the contract passed."""

    contract: str
    version: str
    model: str
    source: str
    rows: int
    per_rule: list[tuple[str | None, str, int]]
    samples: list[Sample]
    policy: Any
    unenforced: list = field(default_factory=list)

    @property
    def violations(self) -> int:
        return sum(n for _, _, n in self.per_rule)

    @property
    def within_budget(self) -> bool:
        return self.violations <= self.policy.max_violations

    @property
    def passed(self) -> bool:
        return self.within_budget or self.policy.on_violation == "warn"

    @property
    def partial(self) -> bool:
        return bool(self.unenforced)

    def to_dict(self) -> dict:
        return {
            "contract": self.contract, "version": self.version, "model": self.model, "source": self.source, "rows": self.rows,
            "violations": self.violations, "passed": self.passed, "partial": self.partial,
            "per_rule": [{"field": f, "rule": r, "count": n} for f, r, n in self.per_rule],
            "samples": [{"field": s.field, "rule": s.rule, "row": s.row, "value": s.value, "message": s.message} | ({"file": s.file} if s.file else {}) for s in self.samples],
            "unenforced": [vars(u) for u in self.unenforced],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2)


def bind(model: Model, source: Source) -> tuple[DataFrame, R.Compiled]:
    """The frame of a source and the model's rules over it."""
    if source.kind == "records":
        return R.with_members(source.frame, model), R.compile_records(model, True)
    if source.kind == "columns":
        schema = [f for f in source.frame.schema if f.name not in HIDDEN]
        return source.frame, R.compile_columns(model, type(source.frame.schema)(schema))
    frame, bad = typed_cells(model, source.frame)
    names = [f for f in frame.schema if f.name not in HIDDEN and not f.name.startswith("__cell_")]
    compiled = R.compile_columns(model, type(frame.schema)(names))
    # a null that stands for an unreadable cell is a mismatch, not a null
    fixed = [R.Rule(r.field, r.rule, r.broken & ~bad[r.field] if r.field in bad and r.rule == "null_not_allowed" else r.broken, r.text) for r in compiled.rules]
    more = [R.Rule(n, "type_mismatch", c, F.col(f"__cell_{n}")) for n, c in bad.items()]
    # a record of more or fewer cells than the header is one mismatch: which cell is whose can't be told. Spark's reader wants some
    # other column read beside RAGGED
    other = [F.length(F.coalesce(F.col(f"`{names[0].name}`").cast("string"), F.lit(""))) >= 0] if names else []
    ragged = reduce(lambda a, b: a & b, other, F.col(RAGGED).isNotNull())
    rules = [R.Rule(None, "type_mismatch", ragged, F.col(RAGGED))] + [R.Rule(r.field, r.rule, r.broken & ~ragged, r.text) for r in more + fixed]
    even = lambda v: replace(v, ok=v.ok & ~ragged)
    return frame, R.Compiled(model, rules, {n: even(v) for n, v in compiled.unique.items()}, {n: even(v) for n, v in compiled.values.items()}, compiled.schema)


#: 128 bits of a file's path, which is longer than most keys and would be held with each of them.
FILE_KEYS = ("__file_a", "__file_b")
#: Rows are told by blocks of 2 to this power where later copies are looked for.
BLOCK_BITS = 16


def _with_file_keys(frame: DataFrame, file: str) -> DataFrame:
    return frame.withColumns(dict(zip(FILE_KEYS, [F.xxhash64(file), F.xxhash64(F.lit(1), file)], strict=True)))


def rule_counts(frame: DataFrame, compiled: R.Compiled, *by: str) -> DataFrame:
    """(by, rows, c0, c1, ...): one row, or one of each group; one aggregate for all rules."""
    counts = [F.count_if(r.broken).alias(f"c{k}") for k, r in enumerate(compiled.rules)]
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *counts)


def _keys(frame: DataFrame, unique: dict[str, R.Value], *more: Column | str, text: bool = False) -> DataFrame:
    """A row for each value of a unique field: `more`, f (the field's place), the key and, if so wanted, its text. Of one field the
    key is the value itself; of several, 128 bits of it, so that all fields share one aggregate."""
    told = lambda v: [v.text.cast("string").alias("text")] if text else []
    if len(unique) == 1:
        ((_, v),) = unique.items()
        return frame.where(v.ok).select(*more, F.lit(0).alias("f"), v.key.alias("a"), F.lit(0).alias("b"), *told(v))
    each = [F.when(v.ok, F.struct(F.lit(k).alias("f"), F.xxhash64(v.key).alias("a"), F.xxhash64(F.lit(1), v.key).alias("b"), *told(v))) for k, v in enumerate(unique.values())]
    # inline() evaluates the structs once; explode and x.* would once for each of their fields
    return frame.select(*more, F.inline(F.array(*each))).where(F.col("f").isNotNull())


def _copies(frame: DataFrame, unique: dict[str, R.Value], *by: str) -> DataFrame:
    """(by, f, n): of each unique field the values beyond their first. Keys of all fields are counted in one pass,
    before they move, so a key that fills a third of the rows moves as one row a task."""
    per_key = _keys(frame, unique, *by).groupBy(*by, "f", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(*by, "f").agg(F.sum(F.col("n") - 1).alias("n"))


def duplicates(frame: DataFrame, unique: dict[str, R.Value]) -> DataFrame:
    """(field, rule, violations) of every unique field."""
    by_field = _copies(frame, unique).agg(F.map_from_entries(F.collect_list(F.struct("f", "n"))).alias("n"))  # a row a field
    told = [F.struct(F.lit(n).alias("field"), F.lit("unique").alias("rule"), F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0)).cast("long").alias("violations")) for k, n in enumerate(unique)]
    return by_field.select(F.explode(F.array(*told)).alias("x")).select("x.*")


def later_copies(frame: DataFrame, key: Column, order: Column) -> DataFrame:
    """Rows of a key beyond its first in `order`, which is of columns (not of when or where a row is read). Only rows
    of keys that repeat are compared with their first; it is a minimum, combined before it moves, and the join with it can be
    split; no window gathers a key's rows in one task."""
    keyed_rows = frame.withColumn("__key", key).withColumn("__order", order).where(F.col("__key").isNotNull())
    first = keyed_rows.groupBy("__key").agg(F.min("__order").alias("__first"), F.count(F.lit(1)).alias("__times")).where(F.col("__times") > 1)
    return keyed_rows.join(first, "__key").where(F.col("__order") > F.col("__first")).drop("__first", "__times", "__order", "__key")


def _first_later(frame: DataFrame, unique: dict[str, R.Value], cap: int, by: list[str]) -> DataFrame:
    """(row, file, f, text) of rows whose key came before, the first `cap` of each field among them, and of each `by`. Rows aren't sorted for
    it: a key's first row is a minimum, combined before it moves, and a block of rows holds as many later copies as it has rows
    less keys that begin in it. Only rows of the first blocks that hold `cap` of them are compared with their key's first."""
    group = [*by, "f", "a", "b"]
    block = lambda row: F.shiftright(row, BLOCK_BITS).alias("block")
    keys = _keys(frame, unique, *by, "row").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    firsts = keys.groupBy(*group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # a sum over n, and keys that aren't null, as the join below needs them: so Spark makes one exchange for both
    begun = firsts.select(*by, "f", block("first"), "n").groupBy(*by, "f", "block").agg(F.sum(-F.least("n", F.lit(1))).alias("n"))
    blocks = keys.groupBy(*by, "f", block("row")).agg(F.count(F.lit(1)).alias("n")).unionByName(begun)
    blocks = blocks.groupBy(*by, "f", "block").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    order = Window.partitionBy(*by, "f").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).withColumn("before", before).where(F.col("before") < cap)
    rows = _keys(frame, unique, *by, "row", "file", text=True).withColumn("block", block("row"))
    rows = rows.join(F.broadcast(blocks.select(*by, "f", "block")), [*by, "f", "block"], "left_semi")  # cap blocks a field and file at most
    return rows.join(firsts.where(F.col("n") > 1), group).where(F.col("row") > F.col("first")).select("row", "file", "f", "text")


def counts_frame(frame: DataFrame, compiled: R.Compiled) -> DataFrame:
    """(field, rule, violations) of every rule of the model, zeros too."""
    named = F.explode(
        F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(r.rule).alias("rule"), F.col(f"c{k}").alias("violations")) for k, r in enumerate(compiled.rules)])
    )
    out = rule_counts(frame, compiled).select(named.alias("x")).select("x.*") if compiled.rules else None
    if compiled.unique:
        copies = duplicates(frame, compiled.unique)
        out = copies if out is None else out.unionByName(copies)
    return out


def outside(frame: DataFrame, v: R.Value, allowed: DataFrame, *by: str) -> DataFrame:
    """(by, key, n): values of a field that the first column of `allowed` doesn't hold, with their rows. Values are counted before they
    move, so a hot one moves as a row a task; Spark broadcasts the set if it is small and shuffles both sides otherwise."""
    per_key = frame.where(v.ok).select(*by, v.key.alias("key")).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))
    kind = per_key.schema["key"].dataType
    held = allowed.select(F.col(f"`{allowed.columns[0]}`").try_cast(kind).alias("key")).distinct()
    return per_key.join(held, "key", "left_anti")


def sample_rows(
    frame: DataFrame, compiled: R.Compiled, hit: set[int], unique: set[str], cap: int, by_file: bool = False, sets: dict[str, DataFrame] | None = None
) -> DataFrame | None:
    """(k, row, file, text): of each rule k, and of each file if so wanted, (unique fields come after the rules), the first `cap` rows that break it. The frame
    has ROW, the same at each reading of it."""
    places = [F.col(ROW).alias("row"), (F.col(FILE) if FILE in frame.columns else F.lit(None).cast("string")).alias("file")]
    own = frame.select("*", *places)
    found: DataFrame | None = None
    chosen = [(k, r) for k, r in enumerate(compiled.rules) if k in hit]
    if chosen:
        # a rule that didn't hold is null in the array, and array_compact drops it before the explode
        told = F.array(*[F.when(r.broken, F.struct(F.lit(k).alias("k"), r.text.cast("string").alias("text"))) for k, r in chosen])
        found = own.select("row", "file", F.explode(F.array_compact(told)).alias("x")).select("x.k", "row", "file", "x.text")
    if unique:
        fields = {n: v for n, v in compiled.unique.items() if n in unique}
        numbers = F.element_at(F.array(*[F.lit(len(compiled.rules) + list(compiled.unique).index(n)) for n in fields]), F.col("f") + 1)
        later = _first_later(_with_file_keys(own, "file") if by_file else own, fields, cap, list(FILE_KEYS) if by_file else [])
        later = later.select(numbers.alias("k"), "row", "file", F.col("text").cast("string").alias("text"))
        found = later if found is None else found.unionByName(later)
    for k, (n, allowed) in enumerate((sets or {}).items(), len(compiled.rules) + len(compiled.unique)):
        v = compiled.values[n]
        bad = outside(frame, v, allowed).select("key")
        rows = own.where(v.ok).select(F.lit(k).alias("k"), "row", "file", v.text.cast("string").alias("text"), v.key.alias("key"))
        rows = rows.join(bad, "key", "left_semi").select("k", "row", "file", "text")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return None
    rank = F.row_number().over(Window.partitionBy(*(["file"] if by_file else []), "k").orderBy("row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def _samples(
    frame: DataFrame, compiled: R.Compiled, hit: set[int], unique: set[str], cap: int, model: str, by_file: bool, sets: dict[str, DataFrame]
) -> list[Sample]:
    few = sample_rows(frame, compiled, hit, unique, cap, by_file, sets)
    if few is None:
        return []
    text = F.col("text")
    told = observed(F.lit("string"), F.length(text), text)
    rows = few.select("k", "row", "file", preview(text).alias("text"), told.alias("seen")).orderBy("k", "row").toLocalIterator()  # cap rows a rule and file
    names = [(r.field, r.rule) for r in compiled.rules] + [(n, "unique") for n in compiled.unique] + [(n, "allowed") for n in sets]
    return [Sample(model, *names[r["k"]], r["row"], r["text"], r["seen"].asDict() if r["text"] is not None else None, r["file"]) for r in rows]


def check_source(spark: SparkSession, source: Source, contract: Contract, model: str | None = None, samples: bool = True, sets: dict[str, DataFrame] | None = None) -> Report:
    return _reports(source, contract, model, samples, None, sets)[source.name]


def _reports(source: Source, contract: Contract, model: str | None, samples: bool, files: list[str] | None, sets: dict[str, DataFrame] | None = None) -> dict[str, Report]:
    """The report of a source by its name; or of each of its files, all in the same jobs: aggregates by file, keys and samples too."""
    name, m = contract.model(model)
    if errors := [f for f in contract.lint() if f.level == "error"]:
        raise ContractError("; ".join(f"{f.path}: {f.message}" for f in errors))
    by = [] if files is None else list(FILE_KEYS)
    names: dict[tuple, str] = {}
    named = lambda r: names[tuple(r[c] for c in by)] if by else source.name
    frame, compiled = bind(m, source)
    frame = _with_file_keys(frame, FILE) if by else frame
    counted = list(rule_counts(frame, compiled, *([FILE, *by] if by else [])).toLocalIterator())  # a row a file
    names |= {tuple(r[c] for c in by): plain_path(r[FILE]) for r in counted} if by else {}
    totals = {named(r): r for r in counted}
    per_rule: dict[str, list[tuple[str | None, str, int]]] = {n: [(s.field, s.rule, 1) for s in compiled.schema] for n in (files if by else [source.name])}
    hit = {k for k in range(len(compiled.rules)) for t in totals.values() if t[f"c{k}"]}
    for n, t in totals.items():
        per_rule[n] += [(compiled.rules[k].field, compiled.rules[k].rule, t[f"c{k}"]) for k in sorted(hit) if t[f"c{k}"]]
    if source.kind == "records" and m.strict:
        extra = frame.where(F.col(R.RECORD).isNotNull()).select(*by, F.explode(R.unexpected_keys(m, F.col(LINE))).alias("key"))
        for r in extra.groupBy(*by, "key").count().orderBy("key").toLocalIterator():
            per_rule[named(r)].append((r["key"], "unexpected_field", r["count"]))
    repeated: set[str] = set()
    for r in _copies(frame, compiled.unique, *by).toLocalIterator() if compiled.unique else ():
        if r["n"]:
            field_name = list(compiled.unique)[r["f"]]
            repeated.add(field_name)
            per_rule[named(r)].append((field_name, "unique", r["n"]))
    if unknown := set(sets or {}) - set(m.fields):
        raise ContractError(f"sets of values for fields that the model lacks: {', '.join(sorted(unknown))}")
    sets = {n: s for n, s in (sets or {}).items() if n in compiled.values}  # a missing or unfit column is told already
    unlisted: dict[str, DataFrame] = {}
    for n, allowed in sets.items():
        for r in outside(frame, compiled.values[n], allowed, *by).groupBy(*by).agg(F.sum("n").alias("n")).toLocalIterator():
            if r["n"]:
                unlisted[n] = allowed
                per_rule[named(r)].append((n, "allowed", r["n"]))
    for rule in m.dataset:
        values = {named(r): r["value"] for r in dataset_value(frame, rule, compiled, *by).toLocalIterator()}
        for n, own in per_rule.items():
            if not dataset_holds(rule, values.get(n) or 0, totals[n]["rows"] if n in totals else 0):
                own.append((",".join(rule.fields) or None, rule.metric, 1))
    order = {r: k for k, r in enumerate(R.RULES)}
    places = {n: k for k, n in enumerate(m.fields)}
    cap = contract.policy.sample_violations
    found: dict[str, list[Sample]] = {n: [Sample(name, s.field, s.rule, None, None) for s in compiled.schema] for n in per_rule}
    if samples and cap and (hit or repeated or unlisted):
        for s in _samples(*bind(m, source.with_rows(bool(by))), hit, repeated, cap, name, bool(by), unlisted):
            found[plain_path(s.file) if by else source.name].append(s)
    out = {}
    for n, own in per_rule.items():
        own.sort(key=lambda x: (x[0] is not None, places.get(x[0], len(places)), order.get(x[1], 99), str(x[0])))
        out[n] = Report(contract.id, contract.version, name, n, totals[n]["rows"] if n in totals else 0, own, found[n], contract.policy, list(contract.unenforced))
    return out


def dataset_holds(rule: DatasetRule, value: float, rows: int) -> bool:
    return rule.holds(100.0 * value / rows if rule.percent and rows else float(value))


def dataset_value(frame: DataFrame, rule: DatasetRule, compiled: R.Compiled, *by: str) -> DataFrame:
    """(by, value) of a rule's metric: rows, nulls of a field, or rows whose combination of fields came before."""
    if rule.metric == "row_count":
        return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("value"))
    values = [compiled.values[f] for f in rule.fields]
    if rule.metric == "null_values":
        return frame.groupBy(*by).agg(F.count_if(~values[0].present | values[0].null).alias("value"))
    able = reduce(lambda a, v: a & v.ok, values, F.lit(True))
    names = [f"k{k}" for k in range(len(values))]
    per_key = frame.where(able).select(*by, *[v.key.alias(n) for n, v in zip(names, values, strict=True)]).groupBy(*by, *names).count()
    return per_key.groupBy(*by).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("value"))


def _refuse_unenforced(c: Contract, allow: bool) -> None:
    if c.unenforced and not allow:
        raise ContractError("rules that can't be enforced: " + "; ".join(f"{u.path}: {u.reason}" for u in c.unenforced))


def check(spark: SparkSession, data: Any, contract: Contract | str, model: str | None = None, allow_unenforced: bool = False, source: str | None = None, data_format: str | None = None, samples: bool = True, sets: dict[str, DataFrame] | None = None) -> Report:
    """Checks a path, a DataFrame, a table or a list of dicts. A contract with rules that can't be
    enforced is refused unless allow_unenforced; the report is then partial. sets: by field a frame whose first column holds the
    values that it may take, of any size, as a rule `allowed` beside the contract's own."""
    c = load(contract) if isinstance(contract, str) else contract
    _refuse_unenforced(c, allow_unenforced)
    return check_source(spark, read(spark, data, source, data_format), c, model, samples, sets)


def check_all(spark: SparkSession, paths: list[str], contract: Contract | str, model: str | None = None, allow_unenforced: bool = False, data_format: str | None = None, samples: bool = True) -> tuple[list[Report], bool]:
    """Reports of several sources, each on its own (uniqueness and row numbers too), and whether the sum of their
    violations keeps the budget. Single files with the same columns are checked together, by the same jobs; folders and the rest one by one."""
    c = load(contract) if isinstance(contract, str) else contract
    _refuse_unenforced(c, allow_unenforced)
    done: dict[str, Report] = {}
    of_kind: dict[str, list[str]] = {}
    for p in dict.fromkeys(paths):
        if _is_file(spark, p):
            of_kind.setdefault(format_of(p, data_format), []).append(p)
    for kind, singles in of_kind.items():
        for same, source in files_of(spark, singles, kind) if len(singles) > 1 else ():
            given = {plain_path(_absolute(spark, p)): p for p in same}
            found = _reports(source, c, model, samples, list(given))
            done |= {given[n]: replace(r, source=given[n]) for n, r in found.items()}
    reports = [done.get(p) or check(spark, p, c, model, True, None, data_format, samples) for p in paths]
    total = sum(r.violations for r in reports)
    return reports, not reports or c.policy.on_violation == "warn" or total <= c.policy.max_violations


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _is_file(spark: SparkSession, path: str) -> bool:
    store, p = _hadoop(spark, path)
    return not re.search(r"[*?{\[]", path) and store.exists(p) and store.getFileStatus(p).isFile()


def _absolute(spark: SparkSession, path: str) -> str:
    store, p = _hadoop(spark, path)
    return store.makeQualified(p).toString()


def assert_conforms(spark: SparkSession, data: Any, contract: Contract | str, **more) -> Report:
    report = check(spark, data, contract, **more)
    assert report.passed, report.to_json()
    return report


def keyed(sample: Sample, key: bytes) -> str | None:
    """A hash of a sample's value that only holders of the key (16 bytes or more) can recompute."""
    if len(key) < 16:
        raise ValueError("the key must have 16 bytes or more")
    if sample.observed is None:
        return None
    return hmac.new(key, bytes.fromhex(sample.observed["digest"]), hashlib.sha256).digest()[:16].hex()


def key_id(key: bytes) -> str:
    return hashlib.sha256(b"sample-key\0" + key).digest()[:8].hex()
