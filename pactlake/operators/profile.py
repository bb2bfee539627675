"""Profiles of a model's data, as partial aggregates that merge by addition.

Counters, minima and maxima of all fields are one aggregate; category counts, histogram buckets and
distinct sketches are grouped partials of bounded size. Two profiles of one model merge to the profile
of their union, whatever the order.
"""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import buckets
from ..plans.spec import Contract, ContractError, Field, Version
from ..sources.read import Source, read
from .check import bind

SKETCH_BITS = 12
VERSION = 1


@dataclass
class FieldProfile:
    type: str
    rows: int = 0
    present: int = 0
    nulls: int = 0
    invalid: int = 0
    non_finite: int = 0
    empty: int = 0
    numbers: dict | None = None  # count, min, max, sum
    lengths: dict | None = None
    span: list | None = None  # least and greatest, as text
    categories: dict | None = None  # counts of declared values, other
    other: int = 0
    histogram: dict[str, int] | None = None  # "sign:bucket" -> count
    sketch: str | None = None  # distinct values, base64
    distinct: int | None = None

    @property
    def valid(self) -> int:
        return self.present - self.nulls - self.invalid


@dataclass
class Profile:
    contract: str
    version: str
    model: str
    runs: int
    rows: int
    fields: dict[str, FieldProfile] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"profile": VERSION, **vars(self), "fields": {k: vars(v) for k, v in self.fields.items()}}, ensure_ascii=False)

    @staticmethod
    def parse(text: str) -> Profile:
        d = json.loads(text)
        if d.pop("profile", None) != VERSION:
            raise ValueError("not a profile of this revision")
        d["fields"] = {k: FieldProfile(**v) for k, v in d["fields"].items()}
        out = Profile(**d)
        for name, f in out.fields.items():
            if f.rows > out.rows or f.nulls + f.invalid > f.present or f.present > f.rows:
                raise ValueError(f"the counters of {name!r} contradict each other")
        return out


def _has_categories(f: Field) -> bool:
    return f.type == "boolean" or (f.allowed is not None and f.type in ("string", "integer", "float"))


def counters(frame: DataFrame, compiled, *by: str) -> DataFrame:
    """One row, or one of each group: every field's counters, numbers, lengths, spans and distinct sketch."""
    out = [F.count(F.lit(1)).alias("rows")]
    for k, (name, v) in enumerate(compiled.values.items()):
        f = compiled.model.fields[name]
        out += [
            F.count_if(v.present).alias(f"present{k}"), F.count_if(v.present & v.null).alias(f"nulls{k}"),
            F.count_if(v.present & ~v.null & ~v.ok).alias(f"invalid{k}"),
            F.hll_sketch_agg(F.when(v.ok, v.key.cast("string")), SKETCH_BITS).alias(f"sketch{k}"),
        ]
        if f.type in ("integer", "float"):
            x = _number(v)
            finite = v.ok & _finite(x)
            out += [F.count_if(v.ok & ~_finite(x)).alias(f"non_finite{k}"), F.count_if(finite).alias(f"count{k}")]
            out += [g(F.when(finite, x)).alias(f"{n}{k}") for n, g in (("min", F.min), ("max", F.max), ("sum", F.sum))]
        elif f.type == "string":
            n = F.length(v.typed)
            out += [F.count_if(v.ok & (n == 0)).alias(f"empty{k}"), F.count_if(v.ok).alias(f"count{k}")]
            out += [g(F.when(v.ok, n)).alias(f"{m}{k}") for m, g in (("min", F.min), ("max", F.max), ("sum", F.sum))]
        elif f.type in ("timestamp", "date"):
            when = instant(v, f.type)
            out += [F.min(when).alias(f"min{k}"), F.max(when).alias(f"max{k}")]
    return frame.groupBy(*by).agg(*out)


def _number(v):
    """As a double; a 32-bit float by its shortest decimal form, so that 0.1 is 0.1."""
    return v.typed.cast("string").try_cast("double") if v.kind == "float32" else v.typed.try_cast("double")


def _finite(x):
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def instant(v, kind: str):
    """Of a timestamp or date in either lane: text that sorts as time does, in UTC."""
    if kind == "date":
        return F.date_format(F.when(v.ok, v.typed.cast("string")).try_cast("date"), "yyyy-MM-dd")
    if v.kind == "native":
        return F.date_format(v.typed.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    whole = F.regexp_replace(F.upper(v.typed.cast("string")), r"\.[0-9]+", "")
    seconds = F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    part = F.rpad(F.coalesce(F.regexp_extract(v.typed.cast("string"), r"\.([0-9]+)", 1), F.lit("")), 9, "0")
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss."), part, F.lit("Z"))


def histogram(frame: DataFrame, compiled, *by: str) -> DataFrame:
    """(by, field, sign, bucket, n): the log histogram of every numeric field, one shuffle of partial counts."""
    parts = []
    for name, v in compiled.values.items():
        if compiled.model.fields[name].type in ("integer", "float"):
            x = _number(v)
            parts.append(F.when(v.ok & _finite(x), F.struct(F.lit(name).alias("field"), x.alias("x"))))
    # inline() evaluates the structs once; explode and x.* would once for each of their fields
    told = frame.select(*by, F.inline(F.array(*parts))).where(F.col("field").isNotNull())
    told = told.select(*by, "field", buckets.sign(F.col("x")).alias("sign"), buckets.bucket(F.col("x")).alias("bucket"))
    return told.groupBy(*by, "field", "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def categories(frame: DataFrame, compiled, *by: str) -> DataFrame:
    """(by, field, value, n) of the declared values; value null stands for all others."""
    parts = []
    for name, v in compiled.values.items():
        f = compiled.model.fields[name]
        if _has_categories(f):
            declared = [_text(x) for x in f.allowed] if f.allowed is not None else ["false", "true"]
            text = v.typed.cast("double").cast("string") if f.type == "float" else v.typed.cast("string")
            parts.append(F.when(v.ok, F.struct(F.lit(name).alias("field"), F.when(text.isin(declared), text).alias("value"))))
    # inline() evaluates the structs once; explode and x.* would once for each of their fields
    told = frame.select(*by, F.inline(F.array(*parts))).where(F.col("field").isNotNull())
    return told.groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def _text(x: Any) -> str:
    return str(x).lower() if isinstance(x, bool) else str(x)


def profile_source(spark: SparkSession, source: Source, contract: Contract, model: str | None = None) -> Profile:
    name, m = contract.model(model)
    frame, compiled = bind(m, source)
    row = counters(frame, compiled).first()
    estimates = [F.hll_sketch_estimate(F.lit(bytes(row[f"sketch{k}"]))).alias(f"d{k}") for k in range(len(compiled.values))]
    distinct = spark.range(1).select(*estimates).first() if estimates else None
    out = Profile(contract.id, contract.version, name, 1, row["rows"])
    for k, (fname, _) in enumerate(compiled.values.items()):
        f = m.fields[fname]
        p = FieldProfile(f.type, row["rows"], row[f"present{k}"], row[f"nulls{k}"], row[f"invalid{k}"])
        p.sketch, p.distinct = base64.b64encode(bytes(row[f"sketch{k}"])).decode(), distinct[f"d{k}"]
        if f.type in ("integer", "float", "string"):
            kept = {n: row[f"{n}{k}"] for n in ("count", "min", "max", "sum")}
            if f.type == "string":
                p.lengths, p.empty = kept, row[f"empty{k}"]
            else:
                p.numbers, p.non_finite, p.histogram = kept, row[f"non_finite{k}"], {}
        elif f.type in ("timestamp", "date") and row[f"min{k}"]:
            p.span = [row[f"min{k}"], row[f"max{k}"]]
        if _has_categories(f):
            p.categories = dict.fromkeys([_text(x) for x in f.allowed] if f.allowed is not None else ["false", "true"], 0)
        out.fields[fname] = p
    if any(p.histogram is not None for p in out.fields.values()):
        for r in histogram(frame, compiled).toLocalIterator():
            out.fields[r["field"]].histogram[f"{r['sign']}:{r['bucket']}"] = r["n"]
        for p in out.fields.values():
            if p.histogram is not None:
                p.histogram = fold(p.histogram)
    if any(p.categories is not None for p in out.fields.values()):
        for r in categories(frame, compiled).collect():
            p = out.fields[r["field"]]
            if r["value"] is None:
                p.other = r["n"]
            else:
                p.categories[r["value"]] = r["n"]
    return out


def profile(spark: SparkSession, data: Any, contract: Contract, model: str | None = None, data_format: str | None = None) -> Profile:
    return profile_source(spark, read(spark, data, None, data_format), contract, model)


def fold(histogram: dict[str, int]) -> dict[str, int]:
    """At most MAX_BUCKETS of each sign: those of the smallest magnitude become the least one kept."""
    out: dict[str, int] = {}
    for s in ("-1", "0", "1"):
        own = sorted(((int(k.split(":")[1]), n) for k, n in histogram.items() if k.split(":")[0] == s), reverse=True)
        kept, rest = own[: buckets.MAX_BUCKETS], own[buckets.MAX_BUCKETS :]
        if rest:
            kept[-1] = (kept[-1][0], kept[-1][1] + sum(n for _, n in rest))
        out |= {f"{s}:{b}": n for b, n in kept}
    return out


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def merge(spark: SparkSession, a: Profile, b: Profile) -> Profile:
    """The profile of both runs' data. Another contract, model or field type is refused; the newer
    version's name stays."""
    if (a.contract, a.model) != (b.contract, b.model):
        raise ContractError("profiles of different contracts or models don't merge")
    versions = sorted((a.version, b.version), key=lambda v: Version.parse(v).order if Version.parse(v) else (0,))
    out = Profile(a.contract, versions[-1], a.model, a.runs + b.runs, a.rows + b.rows)
    for name in [*a.fields, *[n for n in b.fields if n not in a.fields]]:
        x, y = a.fields.get(name), b.fields.get(name)
        if x is None or y is None:
            out.fields[name] = x or y
            continue
        if x.type != y.type:
            raise ContractError(f"{name!r} changed its type from {x.type} to {y.type}")
        z = FieldProfile(x.type)
        for c in ("rows", "present", "nulls", "invalid", "non_finite", "empty", "other"):
            setattr(z, c, getattr(x, c) + getattr(y, c))
        for c in ("numbers", "lengths"):
            p, q = getattr(x, c), getattr(y, c)
            if p and q:
                total = p["sum"] if q["sum"] is None else q["sum"] if p["sum"] is None else p["sum"] + q["sum"]
                setattr(z, c, {"count": p["count"] + q["count"], "min": _least(p["min"], q["min"]), "max": _most(p["max"], q["max"]), "sum": total})
            else:
                setattr(z, c, p or q)
        if x.span or y.span:
            z.span = [_least(*(s[0] if s else None for s in (x.span, y.span))), _most(*(s[1] if s else None for s in (x.span, y.span)))]
        if x.categories is not None or y.categories is not None:
            keys = dict.fromkeys([*(x.categories or {}), *(y.categories or {})])
            z.categories = {k: (x.categories or {}).get(k, 0) + (y.categories or {}).get(k, 0) for k in keys}
        if x.histogram is not None or y.histogram is not None:
            keys = {*(x.histogram or {}), *(y.histogram or {})}
            z.histogram = fold({k: (x.histogram or {}).get(k, 0) + (y.histogram or {}).get(k, 0) for k in keys})
        if x.sketch and y.sketch:
            both = spark.range(1).select(F.hll_union(F.lit(base64.b64decode(x.sketch)), F.lit(base64.b64decode(y.sketch))).alias("u"))
            r = both.select("u", F.hll_sketch_estimate("u").alias("d")).first()
            z.sketch, z.distinct = base64.b64encode(bytes(r["u"])).decode(), r["d"]
        else:
            z.sketch, z.distinct = x.sketch or y.sketch, x.distinct if x.sketch else y.distinct
        out.fields[name] = z
    return out


def ordered(histogram: dict[str, int]) -> list[tuple[float, int]]:
    """(middle of the bucket, count) from the least number to the greatest."""
    out = []
    for k, n in histogram.items():
        s, b = map(int, k.split(":"))
        out.append((s * buckets.middle(b) if s else 0.0, n))
    return sorted(out)


def quantile(histogram: dict[str, int], q: float) -> float | None:
    """The middle of the bucket in which the q-th number lies."""
    rows = ordered(histogram)
    total = sum(n for _, n in rows)
    if not total:
        return None
    want, done = max(1, math.ceil(q * total)), 0
    for x, n in rows:
        done += n
        if done >= want:
            return x
    return rows[-1][0]


def quantile_buckets(counts: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """(field, q, sign, bucket) of histogram(): the first bucket, from the least number up, at which the running
    count reaches the rank. A histogram has thousands of buckets at most, whatever the table."""
    of = Window.partitionBy("field")
    done = F.sum("n").over(of.orderBy(F.col("sign") * F.col("bucket")))
    each = counts.select("field", "sign", "bucket", done.alias("done"), F.sum("n").over(of).alias("total"), F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q"))
    first = each.where(F.col("done") >= F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total")))).groupBy("field", "q")
    return first.agg(F.min_by(F.struct("sign", "bucket"), "done").alias("b")).select("field", "q", "b.sign", "b.bucket")


def cdf(histogram: dict[str, int], x: float) -> float:
    """The share of numbers in buckets whose middle is x or less."""
    rows = ordered(histogram)
    total = sum(n for _, n in rows)
    return sum(n for m, n in rows if m <= x) / total if total else 0.0


def summary(p: Profile) -> str:
    lines = [f"{p.contract} v{p.version}, model {p.model}: {p.rows:,} rows in {p.runs} run{'s' * (p.runs != 1)}"]
    for name, f in p.fields.items():
        parts = [f.type, f"{f.nulls:,} null", f"{f.rows - f.present:,} missing", f"{f.invalid:,} invalid", f"about {f.distinct or 0:,} distinct"]
        if f.numbers and f.numbers["count"]:
            parts.append(f"{f.numbers['min']:g} to {f.numbers['max']:g}, median {quantile(f.histogram, 0.5):g}")
        if f.lengths and f.lengths["count"]:
            parts.append(f"length {f.lengths['min']} to {f.lengths['max']}")
        if f.span:
            parts.append(f"{f.span[0]} to {f.span[1]}")
        if f.categories:
            parts.append(", ".join(f"{k}: {n:,}" for k, n in f.categories.items()) + (f", other: {f.other:,}" if f.other else ""))
        lines.append(f"  {name}: " + "; ".join(parts))
    return "\n".join(lines)
