"""What a model compiles to: one list of (field, rule, violating condition), for either kind of data.

A lane says how a field's value is reached and typed in a DataFrame; the rules are the same. Checks,
gates, profiles and SQL functions all use this one list. Conditions never hold for null, and never
raise: every conversion is a try_cast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import linear, shapes
from .spec import ContractError, Field, Model

#: Every rule, in the order in which reports list them.
RULES = (
    "record_not_object", "schema_missing_field", "schema_type_mismatch", "unexpected_field", "required_missing", "null_not_allowed",
    "type_mismatch", "min", "max", "min_length", "max_length", "pattern", "format", "allowed", "multiple_of", "unique",
)
_LONG = 1 << 63


@dataclass(frozen=True)
class Value:
    """A field in a lane: conditions and typed forms. `typed` is null wherever `ok` doesn't hold."""

    present: Column  # the key was sent; a column always is
    null: Column  # an explicit null
    ok: Column  # not null, and of the field's type
    typed: Column
    text: Column  # for previews
    key: Column  # equal for what uniqueness holds equal
    kind: str  # the Spark type's family: string, integer, decimal, float32, float64, boolean, native
    null_breaks: bool  # whether an explicit null breaks an optional field that isn't nullable


@dataclass(frozen=True)
class Rule:
    field: str | None
    rule: str
    broken: Column
    text: Column


@dataclass(frozen=True)
class SchemaFinding:
    field: str
    rule: str
    message: str


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _integer(n: int) -> Column:
    return F.lit(n) if -_LONG <= n < _LONG else F.lit(str(n)).cast("decimal(38,0)")


def _bound(v: Value, f: Field, bound: float, low: bool) -> Column:
    strict = f.min_exclusive if low else f.max_exclusive
    if f.type == "integer":
        if abs(bound) >= 1e37:
            return F.lit(bound > 0) if low else F.lit(bound < 0)
        n = math.ceil(bound) if low else math.floor(bound)
        n += (1 if low else -1) if strict and n == bound else 0
        return v.typed < _integer(n) if low else v.typed > _integer(n)
    limit = F.lit(float(bound)).cast("float") if v.kind == "float32" else F.lit(float(bound))
    value = v.typed if v.kind.startswith("float") else v.typed.cast("double")
    if low:
        return (value <= limit) if strict else (value < limit)
    return ((value >= limit) if strict else (value > limit)) & ~F.isnan(value)  # Spark holds NaN above all


def _not_allowed(v: Value, f: Field) -> Column:
    if f.type == "integer":
        return ~v.typed.isin(*[_integer(int(x)) for x in f.allowed])
    if f.type == "float":
        cast = "float" if v.kind == "float32" else "double"
        return ~v.typed.cast(cast).isin(*[F.lit(float(x)).cast(cast) for x in f.allowed])
    return ~v.typed.isin(list(f.allowed))


def _multiple(v: Value, f: Field) -> Column:
    if f.type == "integer" and f.multiple_of == int(f.multiple_of):
        return F.pmod(v.typed, _integer(int(f.multiple_of))) != 0
    ratio = v.typed.cast("double") / F.lit(float(f.multiple_of))
    return F.abs(ratio - F.round(ratio)) > 1e-9


def field_rules(name: str, f: Field, v: Value, refuse_allowed: bool = False) -> list[Rule]:
    """Rules of a field in their canonical order, `unique` aside (it is no condition on one row)."""
    out: list[Rule] = []
    add = lambda rule, broken: out.append(Rule(name, rule, _never_null(broken), v.text))
    if f.required:
        add("required_missing", ~v.present)
    if not f.nullable and (f.required or v.null_breaks):
        add("null_not_allowed", v.present & v.null)
    add("type_mismatch", v.present & ~v.null & ~v.ok)
    ok = lambda c: v.ok & c
    if f.min is not None:
        add("min", ok(_bound(v, f, f.min, True)))
    if f.max is not None:
        add("max", ok(_bound(v, f, f.max, False)))
    if f.min_length is not None:
        add("min_length", ok(F.length(v.typed) < f.min_length))
    if f.max_length is not None:
        add("max_length", ok(F.length(v.typed) > f.max_length))
    if f.pattern is not None:
        add("pattern", ok(~linear.matches(v.typed, f.pattern)))
    if f.format is not None:
        add("format", ok(~shapes.FORMATS[f.format](v.typed)))
    if f.allowed is not None and not refuse_allowed:
        add("allowed", ok(_not_allowed(v, f)))
    if f.multiple_of is not None:
        add("multiple_of", ok(_multiple(v, f)))
    return out


@dataclass(frozen=True)
class Compiled:
    """A model bound to a DataFrame: its rules, its unique keys, its findings about the schema."""

    model: Model
    rules: list[Rule]
    unique: dict[str, Value]
    values: dict[str, Value]
    schema: list[SchemaFinding]

    def broken(self) -> Column:
        """Whether a row breaks any rule but `unique`."""
        any_of = F.lit(False)
        for r in self.rules:
            any_of = any_of | r.broken
        return any_of


# --- the columnar lane -----------------------------------------------------

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_kind(kind: T.DataType, fixed_binary: bool = False) -> str | None:
    """The family of a Spark type, or None if no contract type takes it."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, _INTEGERS):
        return "integer"
    if isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (20, 0):  # how Spark reads unsigned 64 bits
        return "decimal"
    if isinstance(kind, T.FloatType):
        return "float32"
    if isinstance(kind, T.DoubleType):
        return "float64"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.BinaryType) and fixed_binary:
        return "binary"
    return None


TAKES = {
    "string": {"string"},
    "integer": {"integer", "decimal"},
    "float": {"integer", "decimal", "float32", "float64"},
    "boolean": {"boolean"},
    "timestamp": {"string", "timestamp"},
    "date": {"string", "date"},
    "uuid": {"string", "binary"},
}


def _column_value(f: Field, c: Column, kind: str) -> Value:
    null = c.isNull()
    ok = c.isNotNull()
    text, key = c.cast("string"), c
    if kind == "string" and f.type in shapes.SHAPES:
        ok = ok & shapes.SHAPES[f.type](c)
    if kind in ("float32", "float64"):
        key = F.when(c == 0, F.lit(0.0).cast(c_type(kind))).otherwise(c)
    if kind == "binary":
        text = key = F.lower(F.hex(c))
    native = kind in ("timestamp", "date", "binary")
    return Value(F.lit(True), null, _never_null(ok), F.when(_never_null(ok), c), text, key, "native" if native else kind, False)


def c_type(kind: str) -> str:
    return "float" if kind == "float32" else "double"


def compile_columns(model: Model, schema: T.StructType, fixed_binary: frozenset[str] = frozenset()) -> Compiled:
    """A model over typed columns. Missing or unfit columns are findings about the schema, once; an
    unfit column is skipped. A null breaks only required fields. fixed_binary: columns known to hold
    16 bytes, which may be uuids."""
    have = {f.name: f.dataType for f in schema}
    rules, unique, values, found = [], {}, {}, []
    for name, f in model.fields.items():
        if name not in have:
            if f.required:
                found.append(SchemaFinding(name, "schema_missing_field", "the required column is missing"))
            continue
        kind = column_kind(have[name], name in fixed_binary)
        if kind not in TAKES[f.type]:
            found.append(SchemaFinding(name, "schema_type_mismatch", f"a {have[name].simpleString()} column can't hold {f.type} values"))
            continue
        v = _column_value(f, F.col(f"`{name.replace('`', '``')}`"), kind)
        refuse = f.allowed is not None and v.kind == "native"
        if refuse:
            found.append(SchemaFinding(name, "schema_type_mismatch", f"allowed compares text, not a {have[name].simpleString()} column"))
        own = field_rules(name, f, v, refuse)
        # a column is always present, and only shapes can make its type unfit
        rules += [r for r in own if r.rule != "required_missing" and (r.rule != "type_mismatch" or (kind == "string" and f.type in shapes.SHAPES))]
        values[name] = v
        if f.unique:
            unique[name] = v
    if model.strict:
        found += [SchemaFinding(c, "unexpected_field", "the column isn't declared") for c in have if c not in model.fields]
    return Compiled(model, rules, unique, values, found)


# --- the JSON lane ---------------------------------------------------------

#: Column names of the JSON lane.
RECORD = "__record"
_MAX_BYTES = 16 << 20


def parse_records(value: Column) -> Column:
    """The record of a line as a variant; null unless the line is one JSON object of 16 MiB at most.
    Wrapping it in an array refuses trailing text."""
    array = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    kind = F.schema_of_variant(array)
    alone = F.try_variant_get(array, "$[1]", "variant").isNull()
    first = F.try_variant_get(array, "$[0]", "variant")
    is_object = kind.startswith("ARRAY<OBJECT") & alone
    return F.when((F.octet_length(value) <= _MAX_BYTES) & is_object, first)


def _member(name: str) -> Column:
    """A key's value. A path takes any name in quotes, but none that holds both kinds of them."""
    for quote in ('"', "'"):
        if quote not in name:
            return F.try_variant_get(F.col(RECORD), f"$[{quote}{name}{quote}]", "variant")
    raise ContractError(f"the field name {name!r} holds both kinds of quotes, which no path can name")


_TYPED = {"integer": "decimal(38,0)", "float": "double", "boolean": "boolean"}


def with_members(df: DataFrame, model: Model) -> DataFrame:
    """df with columns of the members of RECORD that compile_records(model, True) refers to, so that each
    is looked up, typed and tested once a row, however many rules there are."""
    names = list(enumerate(model.fields.items()))
    df = df.withColumns({f"__m{k}": _member(n) for k, (n, _) in names})
    df = df.withColumns({f"__k{k}": F.schema_of_variant(F.col(f"__m{k}")) for k, _ in names} | {f"__t{k}": _as_type(F.col(f"__m{k}"), f) for k, (_, f) in names})
    return df.withColumns({f"__ok{k}": _of_type(f, F.col(f"__m{k}"), F.col(f"__k{k}"), F.col(f"__t{k}")) for k, (_, f) in names})


def without_members(df: DataFrame, model: Model) -> DataFrame:
    return df.drop(*[f"{c}{k}" for k in range(len(model.fields)) for c in ("__m", "__k", "__t", "__ok")])


def _as_type(v: Column, f: Field) -> Column:
    return F.try_variant_get(v, "$", _TYPED.get(f.type, "string"))


def _of_type(f: Field, v: Column, kind: Column, typed: Column) -> Column:
    """Whether a member is there, no null, and of the field's type."""
    if f.type == "integer":
        # beyond 64 bits with a sign, where an integer is told from 1.0 by its size alone
        large = kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & typed.between(_integer(_LONG), _integer(2 * _LONG - 1))
        ok = (kind == "BIGINT") | large
    elif f.type == "float":
        ok = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & ~F.abs(typed).isin(float("inf"))
    elif f.type == "boolean":
        ok = kind == "BOOLEAN"
    else:
        ok = kind == "STRING"
        if f.type in shapes.SHAPES:
            ok = ok & shapes.SHAPES[f.type](typed)
    return _never_null(v.isNotNull() & ~_never_null(F.is_variant_null(v)) & ok)


def _json_value(f: Field, name: str, at: int | None) -> Value:
    """at: the field's number, if the members have columns of their own."""
    if at is None:
        v = _member(name)
        kind, typed = F.schema_of_variant(v), _as_type(v, f)
        ok = _of_type(f, v, kind, typed)
    else:
        v, kind, typed, ok = (F.col(f"{c}{at}") for c in ("__m", "__k", "__t", "__ok"))
    text, key = F.to_json(v), typed
    if f.type == "integer":
        family, key = "decimal", typed.cast("string")
    elif f.type == "float":
        family, key = "float64", F.when(typed == 0, F.lit(0.0)).otherwise(typed)
    elif f.type == "boolean":
        family = "boolean"
    else:
        family, text = "string", F.when(kind == "STRING", typed).otherwise(text)
    return Value(v.isNotNull(), _never_null(F.is_variant_null(v)), ok, F.when(ok, typed), text, F.when(ok, key), family, True)


def compile_records(model: Model, members: bool = False) -> Compiled:
    """A model over parsed records in the column RECORD: an absent key and a null differ. members: the frame
    is one of with_members()."""
    readable = F.col(RECORD).isNotNull()
    rules = [Rule(None, "record_not_object", ~readable, F.lit(None).cast("string"))]
    unique, values = {}, {}
    for k, (name, f) in enumerate(model.fields.items()):
        v = _json_value(f, name, k if members else None)
        own = field_rules(name, f, v)
        rules += [Rule(r.field, r.rule, readable & r.broken, r.text) for r in own]
        values[name] = v
        if f.unique:
            unique[name] = v
    return Compiled(model, rules, unique, values, [])


def unexpected_keys(model: Model, line: Column) -> Column:
    """Keys of a line that the model doesn't declare, each once: one violation a key."""
    return F.array_except(F.array_distinct(F.json_object_keys(line)), F.array(*[F.lit(n) for n in model.fields]).cast("array<string>"))
