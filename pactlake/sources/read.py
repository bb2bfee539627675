"""Sources: a path by its extension, a DataFrame, Arrow data, or records, as frames; on demand with row numbers.

Row numbers run from 0 in the order of files and of lines in them, over all splits and files. Rows never move for it: what a split
or file holds is counted, and a row's number is its split's first one and its place there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rules import RECORD, parse_records
from ..plans.spec import Model

ROW = "__row"
FILE = "__file"
LINE = "__line"
#: The text of a CSV record that has more or fewer cells than the header; else null.
RAGGED = "__ragged"
HIDDEN = (ROW, FILE, RAGGED)
_EXTENSIONS = {"ndjson": "ndjson", "jsonl": "ndjson", "json": "ndjson", "csv": "csv", "parquet": "parquet"}
#: Without all of its cells a record can't be seen to be ragged.
_CSV = {"emptyValue": "", "escape": '"', "columnNameOfCorruptRecord": RAGGED, "columnPruning": False}


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """A frame to check. kind: columns (typed columns), records (LINE and RECORD), cells (columns of
    text cells that are read by the contract's types, and RAGGED). name: what reports call it. numbered: it has ROW and, if it comes
    from files, FILE; otherwise with_rows() is the same source with them."""

    frame: DataFrame
    kind: str
    name: str
    numbered: bool = False
    rows: Callable[[bool], DataFrame] | None = None

    def with_rows(self, anew: bool = False) -> Source:
        """anew: each file counts from 0."""
        return self if self.numbered or not self.rows else replace(self, frame=self.rows(anew), numbered=True, rows=None)


def files_of(spark: SparkSession, paths: list[str], kind: str) -> list[tuple[list[str], Source]]:
    """Single files of one format as few sources: those with the same columns are one, with FILE in its frame. CSV files
    whose header isn't one plain line are left out."""
    if kind == "ndjson":
        text = spark.read.text(paths)
        lines = text.select(F.col("value").alias(LINE), F.col("_metadata.file_path").alias(FILE)).where(F.trim(F.col(LINE)) != "")
        return [(paths, Source(records(lines), "records", "<files>", rows=lambda anew: records(_lines(text, anew))))]
    alike: dict[Any, list[str]] = {}
    if kind == "parquet":
        for p in paths:  # footers, on the driver
            alike.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
        out = []
        for same in alike.values():
            source = _read(spark, same, None, kind, None)
            out.append((same, replace(source, frame=source.frame.select("*", F.col("_metadata.file_path").alias(FILE)))))
        return out
    if has_line_breaks(spark, paths):
        return []
    first = _with_splits(spark.read.text(paths), "value").where((F.col("__at") == 0) & (F.trim("value") != ""))
    headers = {plain_path(r[FILE]): r["header"] for r in first.groupBy(FILE).agg(F.min_by("value", "__id").alias("header")).toLocalIterator()}
    for p in paths:
        if header := headers.get(plain_path(p)):
            alike.setdefault(header, []).append(p)
    out = []
    for same in alike.values():
        source = _csv(spark, same, False, "<files>")
        out.append((same, replace(source, frame=source.frame.select("*", F.col("_metadata.file_path").alias(FILE)))))
    return out


def plain_path(path: str) -> str:
    """A path, or the address that Spark gives of it, in one spelling."""
    path = unquote(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path) else path
    return re.sub(r"^file:/*(?=/)", "", path) if path.startswith("file:") else path


def format_of(path: str, given: str | None = None) -> str:
    if given:
        if given not in set(_EXTENSIONS.values()):
            raise SourceError(f"unknown data format {given!r}")
        return given
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in _EXTENSIONS:
        raise SourceError(f"the format of {path!r} isn't known by its extension; name it")
    return _EXTENSIONS[extension]


#: Splits of files whose first row numbers are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def _numbered(df: DataFrame, by: list[str], place: str, few: bool, anew: bool = False) -> DataFrame:
    """df with ROW in place of the columns `by` (a part of the source, FILE stays) and `place` (a number that rises by one
    within a part). few: there are so few parts that their first numbers may be broadcast. anew: each file counts from 0."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__least"))
    before = (Window.partitionBy(FILE) if anew else Window).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    # a part that wasn't counted means that the source was cut up in another way, or changed, between two readings
    shift = F.coalesce("__shift", F.raise_error(F.lit("the source changed while its rows were numbered")).cast("long"))
    out = df.join(F.broadcast(starts) if few else starts, by, "left").withColumn(ROW, (shift + F.col(place)).cast("long"))
    return out.drop("__shift", place, *[c for c in by if c != FILE])


def _few_splits(df: DataFrame) -> bool:
    return len(df.inputFiles()) <= BROADCAST_SPLITS and df.rdd.getNumPartitions() <= BROADCAST_SPLITS


def _with_splits(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of a frame read from text files, with FILE, the split's start and an id that rises by one within it."""
    places = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id")]
    return df.select(*columns, *places)


def _lines(text: DataFrame, anew: bool) -> DataFrame:
    """Lines that aren't blank, numbered."""
    kept = _with_splits(text, F.col("value").alias(LINE)).where(F.trim(F.col(LINE)) != "")
    # ids count the blank lines too, so the others are counted anew
    lines = kept.drop("__id").withColumn("__id", F.monotonically_increasing_id())
    return _numbered(lines, [FILE, "__at"], "__id", _few_splits(text), anew)


def _numbered_frame(df: DataFrame) -> DataFrame:
    """Rows of any frame in the order of its partitions. A frame whose order differs each time it is evaluated has no row numbers
    to speak of: cache it, or sort it, before."""
    own = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    return _numbered(own, ["__part"], "__id", True)  # a number a task


def has_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a cell of a CSV file may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


_PIECES = T.StructType().add(FILE, "string").add("__at", "long").add("__id", "long").add("whole", "boolean").add("text", "string")


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """FILE, __at, __id, text: the records of CSV files whose cells may hold line breaks, headers left out.

    A line begins inside a cell if the quotes before it in its file are odd in number. Sums of the splits' quotes say so for
    each split's first line; from there a task joins the lines of its splits. What a split leaves open and what it begins with inside a cell are pieces,
    two a split at most, that are put together by their order.
    """
    lines = _with_splits(spark.read.option("lineSep", "\n").text(path), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy(FILE, "__at").agg(F.sum(quotes).alias("q"))
    before = Window.partitionBy(FILE).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(FILE, "__at", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    text = spark.read.text(path)
    told = lines.join(F.broadcast(begins) if _few_splits(text) else begins, [FILE, "__at"]).select(FILE, "__at", "inside", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, number, parts = None, False, 0, []
        out: list[tuple] = []
        for batch in batches:
            for file, at, begins_inside, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, at) != split:
                    if parts:
                        out.append((*split, number, False, "\n".join(parts)))
                    split, inside, number, parts = (file, at), begins_inside, -1 if begins_inside else 0, []
                if not inside and not line.strip():
                    continue
                parts.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    out.append((*split, number, number >= 0, "\n".join(parts)))
                    number, parts = number + 1, []
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, r, strict=True)) for r in out])
                out = []
        if parts:
            out.append((*split, number, False, "\n".join(parts)))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, r, strict=True)) for r in out])

    if not _few_splits(text):  # a join by a shuffle lost the lines' order
        told = lines.join(begins, [FILE, "__at"]).sortWithinPartitions(FILE, "__at", "__id").select(FILE, "__at", "inside", "value")
    pieces = told.mapInArrow(run, _PIECES)
    open_ = pieces.where(~F.col("whole"))
    order = Window.partitionBy(FILE).orderBy("__at", "__id")
    head = F.last(F.when(F.col("__id") >= 0, F.struct("__at", "__id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = open_.withColumn("head", head).groupBy(FILE, "head").agg(F.sort_array(F.collect_list(F.struct("__at", "__id", "text"))).alias("parts"))
    across = joined.select(FILE, "head.__at", "head.__id", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    every = pieces.where("whole").select(FILE, "__at", "__id", "text").unionByName(across)
    return every.where((F.col("__at") > 0) | (F.col("__id") > 0)).withColumn("text", F.regexp_replace("text", "\r\\z", ""))


def _csv(spark: SparkSession, path: str | list[str], multiline: bool, name: str) -> Source:
    one = path if isinstance(path, str) else path[0]
    header = spark.read.options(header=True, multiLine=multiline, **_CSV).csv(one, inferSchema=False).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, RAGGED)])
    if not multiline:
        df = spark.read.options(header=True, **_CSV).schema(schema).csv(path)
        return Source(df, "cells", name, rows=lambda anew: _numbered(_with_splits(df, "*"), [FILE, "__at"], "__id", _few_splits(df), anew))
    ddl = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in schema.names)
    cells = F.from_csv("text", ddl, {**_CSV, "multiLine": "true"})
    found = _csv_records(spark, path)
    typed = lambda df: df.withColumn("cells", cells).drop("text").select(*[c for c in df.columns if c != "text"], "cells.*")
    return Source(typed(found.select("text")), "cells", name, rows=lambda anew: _numbered(typed(found), [FILE, "__at"], "__id", _few_splits(spark.read.text(path)), anew))


def records(frame: DataFrame) -> DataFrame:
    """LINE, and RECORD parsed from it."""
    return frame.withColumn(RECORD, parse_records(F.col(LINE)))


def read(spark: SparkSession, data: Any, name: str | None = None, data_format: str | None = None, rows: bool = False, multiline: bool | None = None) -> Source:
    """A source of a path, a DataFrame, a pandas or Arrow table, or a list of dicts. rows: number the
    rows, as samples need; counts don't. multiline: CSV cells may hold line breaks; None looks for such cells first, as without
    them lines are records and stay in the JVM."""
    source = _read(spark, data, name, data_format, multiline)
    return source.with_rows() if rows else source


def _read(spark: SparkSession, data: Any, name: str | None, data_format: str | None, multiline: bool | None) -> Source:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if isinstance(data, str) or data_format == "parquet":
        kind = data_format if isinstance(data, list) else format_of(data, data_format)
        if kind == "parquet":
            df = spark.read.parquet(*([data] if isinstance(data, str) else data))
            places = lambda: df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias("__id"))
            return Source(df, "columns", name or str(data), rows=lambda anew: _numbered(places(), [FILE], "__id", len(df.inputFiles()) <= BROADCAST_SPLITS, anew))
        if kind == "csv":
            return _csv(spark, data, has_line_breaks(spark, data) if multiline is None else multiline, name or data)
        text = spark.read.text(data)
        lines = text.select(F.col("value").alias(LINE)).where(F.trim(F.col(LINE)) != "")
        return Source(records(lines), "records", name or data, rows=lambda anew: records(_lines(text, anew)))
    if isinstance(data, (list, tuple)):
        # one line each, as a file of them would have; values that JSON lacks are refused
        lines = [(k, json.dumps(r, allow_nan=False, ensure_ascii=False)) for k, r in enumerate(data)]
        df = spark.createDataFrame(lines, T.StructType().add(ROW, "long").add(LINE, "string"))
        return Source(records(df), "records", name or "<records>", True)
    df = data if isinstance(data, DataFrame) else spark.createDataFrame(data)
    return Source(df, "columns", name or ("<frame>" if isinstance(data, DataFrame) else "<table>"), rows=lambda anew: _numbered_frame(df))


_CELLS: dict[str, tuple[str, str]] = {
    "integer": (r"\A-?[0-9]+\z", "decimal(20,0)"),
    "float": (r"\A[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|NaN|nan|inf|-?Infinity)\z", "double"),
    "boolean": (r"\A(?i:true|false)\z", "boolean"),
}


def typed_cells(model: Model, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Cells of a CSV file by the contract's types; and for each field the condition that its cell
    isn't readable as such."""
    bad: dict[str, Column] = {}
    out = df
    for name, f in model.fields.items():
        if name in df.columns and f.type in _CELLS:
            shape, kind = _CELLS[f.type]
            cell = F.col(f"`{name}`")
            value = F.when(cell.rlike(shape), cell).try_cast(kind)
            out = out.withColumn(f"__cell_{name}", cell).withColumn(name, value)
            bad[name] = F.col(f"__cell_{name}").isNotNull() & F.col(f"`{name}`").isNull()
    return out, bad
