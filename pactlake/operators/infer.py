"""A draft contract from sample records: what was seen, with a note at every guess.

Any source is brought to JSON records first, so that one aggregation by key reads them all; a second
one counts the distinct texts of each key, up to a cap.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shapes
from ..plans.rules import RECORD
from ..plans.spec import Contract, Field, Model
from ..sources.read import HIDDEN, LINE, ROW, SourceError, format_of, has_line_breaks, read, records

#: Fixed limits: records of a sample, values of a drafted set, distinct values counted, values behind a guess.
SAMPLE, MAX_ENUM, DISTINCT_CAP, FLOOR = 10_000, 12, 512, 20


@dataclass
class Draft:
    contract: Contract
    sampled: int
    truncated: bool
    sources: list[str]
    notes: list[tuple[str, str, bool]] = field(default_factory=list)  # path, message, whether to confirm

    def to_yaml(self) -> str:
        return render(self)


def _as_lines(spark: SparkSession, data: Any) -> DataFrame:
    """(ROW, LINE) of any source, whole."""
    if isinstance(data, str) and format_of(data) == "csv":
        data = spark.read.options(header=True, multiLine=has_line_breaks(spark, data), escape='"').csv(data, inferSchema=True)
    source = read(spark, data, rows=True)
    return source.frame.select(ROW, LINE) if source.kind == "records" else source.frame.select(ROW, _line_of(source.frame))


def _line_of(frame: DataFrame) -> Column:
    """LINE of a row of typed columns."""
    cells = []
    for f in frame.schema:
        c = F.col(f"`{f.name}`")
        if f.name in HIDDEN:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif isinstance(f.dataType, T.BinaryType):
            hexed = F.lower(F.hex(c))
            dashed = F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
            c = F.when(F.octet_length(c) == 16, dashed).otherwise(hexed)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cells.append(c.alias(f.name))
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(LINE)


def _first_lines(spark: SparkSession, data: Any, n: int) -> tuple[DataFrame, int]:
    """(ROW, LINE) of the first n records of a source and how many there are, one more if there are more than n."""
    kind = format_of(data) if isinstance(data, str) else None
    if kind == "csv":
        return _first_csv(spark, data, n)
    if kind is None:
        frame = read(spark, data).frame
        lines = [r[0] for r in (frame if LINE in frame.columns else frame.select(_line_of(frame))).select(LINE).take(n + 1)]
    else:
        whole = spark.read.parquet(data) if kind == "parquet" else spark.read.text(data)
        load = (lambda fs: (f := spark.read.schema(whole.schema).parquet(*fs)).select(_line_of(f), f["_metadata.file_path"].alias("file"))) if kind == "parquet" else (
            lambda fs: spark.read.text(fs).where(F.trim("value") != "").select(F.col("value").alias(LINE), F.col("_metadata.file_path").alias("file")))
        lines = _take(sorted(whole.inputFiles()), load, n + 1)
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines[:n])], T.StructType().add(ROW, "long").add(LINE, "string")), len(lines)


def _take(files: list[str], load: Callable[[list[str]], DataFrame], n: int) -> list[str]:
    """The first n lines of files in their order. One file is read split by split until there are enough; as long as files turn
    out to be small, twice as many are read at once."""
    out: list[str] = []
    at, many = 0, 1
    while at < len(files) and len(out) < n:
        own = load(files[at : at + many]).select(LINE, "file")
        if many > 1:
            own = own.withColumn("place", F.monotonically_increasing_id()).orderBy("file", "place")
        out += [r[0] for r in own.select(LINE).take(n - len(out))]
        at, many = at + many, 2 * many
    return out


def _first_csv(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, int]:
    """Types are those of the cells of the records taken."""
    text = spark.read.option("lineSep", "\n").text(path)
    records: list[str] = []
    header = None
    for file in sorted(text.inputFiles()):
        records_of, want = [], n + 2 - len(records)
        while True:
            lines = [r[0] for r in spark.read.option("lineSep", "\n").text(file).take(want)]
            records_of, held, inside = [], [], False
            for line in lines:
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    records_of.append("\n".join(held).removesuffix("\r"))
                    held = []
            records_of = [r for r in records_of if r.strip()]
            if len(lines) < want or len(records_of) >= n + 2 - len(records):
                records_of += ["\n".join(held)] if held and len(lines) < want else []
                break
            want *= 2
        header = header or (records_of[0] if records_of else None)
        records += records_of[1:]
        if len(records) > n:
            break
    rows = spark.createDataFrame([(r,) for r in [header or "", *records[:n]]], "value string").coalesce(1)
    frame = spark.read.options(header=True, escape='"', inferSchema=True, multiLine=True).csv(rows.rdd.map(lambda r: r[0]))
    lines = [r[0] for r in frame.select(_line_of(frame)).collect()]
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], T.StructType().add(ROW, "long").add(LINE, "string")), min(len(records), n + 1)


def _observed(spark: SparkSession, lines: DataFrame) -> tuple[int, int, dict[str, dict], dict[str, list[str] | None]]:
    """Records, key shapes, counters by key, distinct texts by key (None over the cap)."""
    parsed = records(lines)
    objects = parsed.where(F.col(RECORD).isNotNull()).persist()
    n = objects.count()
    shape = F.array_join(F.array_sort(F.json_object_keys(LINE)), "\0")
    kinds = objects.select(shape.alias("s")).distinct().limit(65).count()
    order = objects.select(ROW, F.posexplode(F.json_object_keys(LINE)).alias("pos", "key"))
    first = {r["key"]: (r["r"], r["p"]) for r in order.groupBy("key").agg(F.min(ROW).alias("r"), F.min_by("pos", ROW).alias("p")).collect()}
    cells = spark.sql(f"SELECT e.key, e.value AS v FROM {{objects}}, LATERAL variant_explode({RECORD}) AS e", objects=objects)
    kind = F.schema_of_variant("v")
    text = F.try_variant_get("v", "$", "string")
    number = F.try_variant_get("v", "$", "double")
    is_string, is_bool = kind == "STRING", kind == "BOOLEAN"
    is_int = kind == "BIGINT"
    is_number = is_int | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    s = F.when(is_string, text)
    c = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    seen = cells.groupBy("key").agg(
        F.count(F.lit(1)).alias("present"), c(F.is_variant_null("v"), "nulls"), c(is_string, "strings"), c(is_bool, "booleans"), c(is_number, "numbers"),
        c(is_number & ~is_int, "tokens"), c(is_number & (number != F.floor(number)), "fractions"),
        c(kind.startswith("ARRAY") | kind.startswith("OBJECT"), "nested"), F.min(F.when(is_number, number)).alias("least"), F.max(F.when(is_number, number)).alias("most"),
        F.min(F.length(s)).alias("shortest"), F.max(F.length(s)).alias("longest"), c(s == "", "empty"),
        *[c(shapes.SHAPES[k](s), k) for k in shapes.SHAPES], *[c(shapes.FORMATS[k](s), k) for k in shapes.FORMATS],
    )
    counters = {r["key"]: r.asDict() for r in seen.collect()}
    values = cells.where(is_string).select("key", text.alias("text")).distinct()
    few = values.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("text"))).where(F.col("k") <= DISTINCT_CAP + 1)
    distinct: dict[str, list[str] | None] = {k: [] for k in counters}
    for r in few.orderBy("key", "text").toLocalIterator():
        if distinct[r["key"]] is not None:
            distinct[r["key"]].append(r["text"])
            if len(distinct[r["key"]]) > DISTINCT_CAP:
                distinct[r["key"]] = None
    objects.unpersist()
    return n, kinds, {k: counters[k] for k in sorted(counters, key=lambda k: first.get(k, (1 << 62, 0)))}, distinct


def infer(spark: SparkSession, data: Any, id: str | None = None, model: str | None = None, sample: int = SAMPLE, max_enum: int = MAX_ENUM, ranges: bool = True) -> Draft:
    """From a path, several, or data in memory; of each the records in order until `sample` is full
    (0: all)."""
    paths = data if isinstance(data, list) and data and all(isinstance(x, str) for x in data) else [data]
    lines, base, left, more = None, 0, sample, False
    for p in paths:
        if sample:
            part, found = _first_lines(spark, p, left)
            left, more = left - min(left, found), more or found > left
        else:
            part = _as_lines(spark, p)
        part = part.withColumn(ROW, F.col(ROW) + base)
        lines = part if lines is None else lines.unionByName(part)
        base += 1 << 40
    n, kinds, counters, distinct = _observed(spark, lines)
    if not n:
        raise SourceError("no record could be read, so nothing can be drafted")
    stem = re.sub(r"\W+", "_", paths[0].rstrip("/").rpartition("/")[2].partition(".")[0]) if isinstance(paths[0], str) else "draft"
    name = model or stem
    notes: list[tuple[str, str, bool]] = []
    fields = {k: _draft(f"models.{name}.fields.{k}", c, distinct[k], n, max_enum, ranges, notes) for k, c in counters.items()}
    strict = kinds == 1
    notes.append((f"models.{name}.strict", "every record had the same keys" if strict else "records had different keys", True))
    return Draft(Contract(id or name, "0.1.0", {name: Model(fields, strict=strict)}), n, more, [str(p) if isinstance(p, str) else "<data>" for p in paths], notes)


def _type(path: str, c: dict, notes: list) -> str:
    note = lambda m: notes.append((path, m, True))
    families = [k for k in ("booleans", "numbers", "strings") if c[k]]
    if c["nested"]:
        note("some values are objects or arrays, which no type takes: drafted as string")
        return "string"
    if not families:
        note("no value was seen: drafted as string")
        return "string"
    if len(families) > 1:
        note(f"values of several kinds were seen ({', '.join(families)}): drafted as string")
        return "string"
    if families == ["booleans"]:
        return "boolean"
    if families == ["numbers"]:
        if c["fractions"]:
            return "float"
        if c["tokens"]:
            note(f"{c['tokens']} values are written with a fraction but whole: drafted as integer, choose float if fractions may come")
        return "integer"
    return next((k for k in ("uuid", "date", "timestamp") if c[k] == c["strings"]), "string")


def _draft(path: str, c: dict, distinct: list[str] | None, n: int, max_enum: int, ranges: bool, notes: list) -> Field:
    confirm = lambda where, m: notes.append((where, m, True))
    kind = _type(path, c, notes)
    f: dict[str, Any] = {"type": kind, "required": c["present"] == n, "nullable": c["nulls"] > 0}
    valued = c["present"] - c["nulls"]
    pure = kind == "string" and c["strings"] == valued and valued > 0
    if c["present"] < n:
        confirm(path, f"absent from {n - c['present']} of {n} records: drafted as optional")
    if c["nulls"]:
        notes.append((path, f"{c['nulls']} of {c['present']} values were null", False))
    if pure:
        f["format"] = next((k for k in ("email", "uri") if c[k] == c["strings"]), None)
        if f["format"] is None and max_enum and distinct and len(distinct) <= max_enum and valued >= FLOOR and 4 * len(distinct) <= valued:
            f["allowed"] = tuple(sorted(distinct))
            confirm(f"{path}.allowed", f"{len(distinct)} distinct values in {valued}: a sample can't prove that the set is closed")
        if f["format"] is None and "allowed" not in f and valued >= FLOOR and (pattern := common_pattern(distinct)):
            f["pattern"] = pattern
            confirm(f"{path}.pattern", "every value seen matches; check it for values to come")
    if ranges and valued and kind in ("integer", "float") and c["least"] is not None:
        f["min"], f["max"] = _plain(c["least"]), _plain(c["most"])
        confirm(f"{path}.min", f"observed from {f['min']} to {f['max']}: a sample is no bound")
    if ranges and pure and "allowed" not in f:
        if c["shortest"] == c["longest"] and c["longest"] > 0 and valued >= FLOOR:
            f["min_length"] = f["max_length"] = c["longest"]
            confirm(f"{path}.max_length", f"every value had {c['longest']} characters")
        elif c["shortest"] != c["longest"] and "pattern" not in f:
            confirm(f"{path}.max_length", f"lengths from {c['shortest']} to {c['longest']} were seen; none is drafted")
    if pure and c["empty"]:
        confirm(path, f"{c['empty']} values were empty: perhaps nulls in disguise")
    if distinct and c["strings"] and valued >= FLOOR and len(distinct) == valued:
        confirm(f"{path}.unique", "all values were distinct; not drafted, as a sample can't prove it")
    return Field(**{k: v for k, v in f.items() if v is not None})


def _plain(x: float) -> float | int:
    return int(x) if x == int(x) and abs(x) < 1 << 53 else x


def common_pattern(values: list[str] | None) -> str | None:
    """^prefix[class]{n}$ if all values share a prefix up to a separator and tails of one width and class."""
    if not values or len(values) < 2 or not all(v and v.isascii() for v in values):
        return None
    low, high = min(values), max(values)  # these two share what all share
    k = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    cut = max(low.rfind(s, 0, k) for s in "_-:/") + 1
    tails = {v[cut:] for v in values}
    width = len(next(iter(tails)))
    if not cut or not width or any(len(t) != width for t in tails):
        return None
    for chars in ("0-9", "a-z0-9", "A-Za-z0-9"):
        if all(re.fullmatch(f"[{chars}]+", t) for t in tails):
            return f"^{re.sub(r'([^A-Za-z0-9_:/-])', r'\\\1', low[:cut])}[{chars}]{{{width}}}$"
    return None


def render(d: Draft) -> str:
    q = lambda x: json.dumps(x, ensure_ascii=False)  # noqa: E731  JSON scalars are YAML scalars
    told = lambda path: [f"# {'confirm: ' if ask else ''}{m}" for p, m, ask in d.notes if p == path]
    c = d.contract
    out = [f"# Draft from {d.sampled} records{' (a part of the data)' if d.truncated else ''}: " + ", ".join(x.replace("\n", " ") for x in d.sources)]
    out += ["# Every line marked confirm is a guess from the sample: keep, widen or delete the rule below it.", "contract: 1", f"id: {q(c.id)}", f"version: {c.version}", "models:"]
    for name, m in c.models.items():
        base = f"models.{name}"
        out += [f"  {q(name)}:", *[f"    {x}" for x in told(f"{base}.strict")], f"    strict: {str(m.strict).lower()}", "    fields:"]
        for fname, f in m.fields.items():
            path = f"{base}.fields.{fname}"
            out += [*[f"      {x}" for x in told(path)], f"      {q(fname)}:", f"        type: {f.type}"]
            for key in ("required", "nullable", "format", "pattern", "allowed", "min", "max", "min_length", "max_length", "unique"):
                v = getattr(f, key)
                out += [f"        {x}" for x in told(f"{path}.{key}")]
                if v not in (None, False) or (v == 0 and v is not False and v is not None):
                    out.append(f"        {key}: {q(list(v) if key == 'allowed' else v)}")
    return "\n".join(out) + "\n"
