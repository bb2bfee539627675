"""Profiles as a table: a row a counter, category, histogram bucket, range or sketch.

Rows of one (field, part, item) merge by one aggregate, so that any number of profiles, of files or of groups of one table, become one
without the driver; and two profiles are compared by a full outer join of their rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Contract
from ..sources.read import Source
from . import profile as P
from .check import bind

#: Of numbers and lengths n counts, least, most and total are theirs; of spans first and last.
VALUES = ("n", "least", "most", "total", "first", "last", "sketch")
ROWS = T.StructType()
for _name, _kind in zip(("field", "type", "part", "item", *VALUES), ("string",) * 4 + ("long",) + ("double",) * 3 + ("string",) * 2 + ("binary",), strict=True):
    ROWS.add(_name, _kind)
_COUNTERS = ("rows", "present", "nulls", "invalid", "non_finite", "empty")


def of_groups(source: Source, contract: Contract, by: str, model: str | None = None) -> DataFrame:
    """The profile's rows of each value of the column `by`, from the aggregates that a single profile is made of."""
    _, m = contract.model(model)
    frame, compiled = bind(m, source)
    null = F.lit(None)
    row = lambda f, part, item="", n=null, least=null, most=null, total=null, first=null, last=null, sketch=null: F.struct(
        *[c.cast(k.dataType).alias(k.name) for c, k in zip((F.lit(f), F.lit(m.fields[f].type), F.lit(part), F.lit(item), n, least, most, total, first, last, sketch), ROWS, strict=True)]
    )
    told: list[Column] = []
    for k, f in enumerate(compiled.values):
        kind = m.fields[f].type
        col = lambda name, k=k: F.col(f"{name}{k}")
        told += [row(f, "counter", "rows", F.col("rows")), *[row(f, "counter", c, col(c)) for c in ("present", "nulls", "invalid")], row(f, "sketch", sketch=col("sketch"))]
        if kind in ("integer", "float", "string"):
            told.append(row(f, "lengths" if kind == "string" else "numbers", "", col("count"), col("min"), col("max"), col("sum")))
            told.append(row(f, "counter", "empty" if kind == "string" else "non_finite", col("empty" if kind == "string" else "non_finite")))
        elif kind in ("timestamp", "date"):
            told.append(row(f, "span", first=col("min"), last=col("max")))
    out = P.counters(frame, compiled, by).select(by, F.inline(F.array(*told)))
    types = F.create_map(*[F.lit(x) for n, f in m.fields.items() for x in (n, f.type)])
    typed = lambda df, part, item: df.select(by, "field", types[F.col("field")].alias("type"), F.lit(part).alias("part"), item.alias("item"), "n")
    if any(m.fields[n].type in ("integer", "float") for n in compiled.values):
        own = typed(P.histogram(frame, compiled, by), "histogram", F.concat_ws(":", "sign", "bucket"))
        out = out.unionByName(own, allowMissingColumns=True)
    if any(P._has_categories(m.fields[n]) for n in compiled.values):
        own = P.categories(frame, compiled, by)
        out = out.unionByName(typed(own.where("value IS NOT NULL"), "category", F.col("value")), allowMissingColumns=True)
        out = out.unionByName(typed(own.where("value IS NULL"), "other", F.lit("")), allowMissingColumns=True)
    return out


def merge(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of many profiles as those of one, or of one for each group: a single aggregate, combined before it moves. A field whose
    type isn't the same in all is refused."""
    kind = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise(F.raise_error(F.concat(F.lit("the type changed of the field "), F.first("field"))))
    sums = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last")]
    sketch = F.hll_union_agg(F.col("sketch")).alias("sketch")
    plain = rows.where(F.col("part") != "sketch").groupBy(*by, "field", "part", "item").agg(kind.alias("type"), *sums)
    sketches = rows.where(F.col("part") == "sketch").groupBy(*by, "field", "part", "item").agg(kind.alias("type"), sketch)
    return plain.unionByName(sketches, allowMissingColumns=True).select(*by, *ROWS.names)


def distinct(rows: DataFrame, *by: str) -> DataFrame:
    """(by, field, distinct): the estimates of the sketches."""
    return rows.where(F.col("part") == "sketch").select(*by, "field", F.hll_sketch_estimate("sketch").alias("distinct"))


# --- files -----------------------------------------------------------------


def rows_of(p: P.Profile) -> Iterator[tuple]:
    for name, f in p.fields.items():
        row = lambda part, item="", n=None, least=None, most=None, total=None, first=None, last=None, sketch=None, name=name, kind=f.type: (
            name, kind, part, item, n, *[None if x is None else float(x) for x in (least, most, total)], first, last, sketch)
        yield from (row("counter", c, getattr(f, c)) for c in _COUNTERS)
        for part, of in (("numbers", f.numbers), ("lengths", f.lengths)):
            if of:
                yield row(part, "", of["count"], of["min"], of["max"], of["sum"])
        if f.span:
            yield row("span", first=f.span[0], last=f.span[1])
        yield from (row("category", k, n) for k, n in (f.categories or {}).items())
        yield from (row("histogram", k, n) for k, n in (f.histogram or {}).items())
        if f.categories is not None:
            yield row("other", "", f.other)
        if f.sketch:
            yield row("sketch", sketch=base64.b64decode(f.sketch))


def read_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contract, model, version, runs, rows of each profile file): a file is read by one task."""
    out = T.StructType().add("contract", "string").add("model", "string").add("version", "string").add("runs", "long")
    out = T.StructType([*out, *ROWS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch["value"]:
                p = P.Profile.parse(text)
                made += [(p.contract, p.model, p.version, p.runs, *r) for r in rows_of(p)]
            yield pd.DataFrame(made, columns=out.names).astype({"n": "Int64"})

    return spark.read.option("wholetext", True).text(paths).mapInPandas(run, out)


def to_profile(rows: DataFrame, contract: str, version: str, model: str, runs: int) -> P.Profile:
    """The profile of merged rows, which are bounded by the fields and MAX_BUCKETS."""
    out = P.Profile(contract, version, model, runs, 0)
    estimates = {r["field"]: r["distinct"] for r in distinct(rows).collect()}
    for r in rows.orderBy("field", "part", "item").toLocalIterator():
        f = out.fields.setdefault(r["field"], P.FieldProfile(r["type"], distinct=estimates.get(r["field"])))
        if r["part"] == "counter":
            setattr(f, r["item"], r["n"])
        elif r["part"] in ("numbers", "lengths"):
            whole = f.type != "float" and r["least"] is not None
            setattr(f, r["part"], {"count": r["n"], **{k: int(r[c]) if whole and k != "sum" else r[c] for k, c in (("min", "least"), ("max", "most"), ("sum", "total"))}})
        elif r["part"] == "span" and r["first"] is not None:
            f.span = [r["first"], r["last"]]
        elif r["part"] == "category":
            f.categories = (f.categories or {}) | {r["item"]: r["n"]}
        elif r["part"] == "other":
            f.other, f.categories = r["n"], f.categories or {}
        elif r["part"] == "histogram":
            f.histogram = (f.histogram or {}) | {r["item"]: r["n"]}
        elif r["part"] == "sketch":
            f.sketch = base64.b64encode(bytes(r["sketch"])).decode()
    for f in out.fields.values():
        out.rows = max(out.rows, f.rows)
        if f.histogram:
            f.histogram = P.fold(f.histogram)
    return out


# --- drift -----------------------------------------------------------------


def rates(baseline: DataFrame, current: DataFrame, *by: str) -> DataFrame:
    """(by, field, metric, baseline, current, score) of all fields that both sides have: null, missing and invalid rates, and the distance of
    category shares (square root of the Jensen-Shannon divergence, base 2), by a full outer join of the two profiles' rows."""
    keys = [*by, "field", "part", "item"]
    parts = F.col("part").isin("counter", "category", "other")
    side = lambda rows, name: rows.where(parts).select(*keys, F.col("n").alias(name))
    both = side(baseline, "x").join(side(current, "y"), keys, "full").fillna(0, ["x", "y"])
    counts = both.where(F.col("part") == "counter").groupBy(*by, "field").pivot("item", ["rows", "present", "nulls", "invalid"]).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    share = {"null_rate": lambda s: F.col(f"nulls_{s}"), "missing_rate": lambda s: F.col(f"rows_{s}") - F.col(f"present_{s}"), "invalid_rate": lambda s: F.col(f"invalid_{s}")}
    told = [F.struct(F.lit(m).alias("metric"), *[(of(s) / F.col(f"rows_{s}")).alias(n) for s, n in (("x", "baseline"), ("y", "current"))]) for m, of in share.items()]
    able = counts.where((F.col("rows_x") > 0) & (F.col("rows_y") > 0))
    out = able.select(*by, "field", F.inline(F.array(*told))).withColumn("score", F.abs(F.col("current") - F.col("baseline")))
    cats = both.where(F.col("part").isin("category", "other"))
    totals = cats.groupBy(*by, "field").agg(F.sum("x").alias("nx"), F.sum("y").alias("ny")).where((F.col("nx") > 0) & (F.col("ny") > 0))
    p, q = F.col("x") / F.col("nx"), F.col("y") / F.col("ny")
    half = lambda s: F.when(s > 0, 0.5 * s * F.log2(s / ((p + q) / 2))).otherwise(0.0)
    distance = cats.join(totals, [*by, "field"]).groupBy(*by, "field").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(half(p) + half(q)))).alias("score"))
    none = F.lit(None).cast("double")
    return out.unionByName(distance.select(*by, "field", F.lit("categories").alias("metric"), none.alias("baseline"), none.alias("current"), "score"))

