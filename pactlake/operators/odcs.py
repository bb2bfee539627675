"""Open Data Contract Standard v3 documents as contracts: a rule is enforced exactly or listed as not enforced."""

from __future__ import annotations

import dataclasses
import math
import re
from typing import Any

from ..plans.spec import Contract, ContractError, DatasetRule, Field, Model, Unenforced
from .diff import same_value

#: Versions of the standard that are read in full.
VERSIONS = ("v3.0.0", "v3.0.1", "v3.0.2", "v3.1.0", "v3.2.0")
_TYPES = {"string": "string", "integer": "integer", "number": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}
_VARIABLE = re.compile(r"\$\{[A-Za-z_][A-Za-z0-9_]*(?::-[^}]*)?\}")
_OPERATORS = ("mustBe", "mustNotBe", "mustBeGreaterThan", "mustBeGreaterOrEqualTo", "mustBeLessThan", "mustBeLessOrEqualTo", "mustBeBetween", "mustNotBeBetween")
_DAY_FORMATS = ("yyyy-MM-dd", "YYYY-MM-DD", "%Y-%m-%d")


class _Reading:
    """What a document yields besides its fields."""

    def __init__(self, extended: bool):
        self.extended = extended
        self.unenforced: list[Unenforced] = []
        self.notes: list[tuple[str, str]] = []
        self.dataset: list[DatasetRule] = []

    def skip(self, path: str, rule: str, reason: str) -> None:
        self.unenforced.append(Unenforced(path, rule, reason))


def _number(v: Any) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _variable(v: Any) -> bool:
    return isinstance(v, str) and _VARIABLE.search(v) is not None


def convert(doc: dict, extended: bool = False) -> Contract:
    if doc.get("kind") != "DataContract":
        raise ContractError(f"kind {doc.get('kind')!r} is not DataContract")
    version = str(doc.get("apiVersion"))
    if not version.startswith("v3."):
        raise ContractError(f"version {version} of the standard is not supported")
    r = _Reading(extended)
    if version not in VERSIONS:
        r.skip("apiVersion", f"apiVersion {version}", "this version may have rules that aren't known here")
    models: dict[str, Model] = {}
    for o in doc.get("schema") or []:
        if "name" not in o:
            raise ContractError("a schema object has no name")
        if o["name"] in models:
            raise ContractError(f"schema {o['name']!r} is declared twice")
        models[o["name"]] = _object(o, r)
    text = lambda v: "" if v is None else v if isinstance(v, str) else str(v)
    about = doc.get("description")
    about = about.get("purpose") if isinstance(about, dict) else about
    return Contract(text(doc.get("id")), text(doc.get("version")), models, 1, doc.get("name"), _owner(doc.get("team")), about if isinstance(about, str) else None, unenforced=tuple(r.unenforced), notes=tuple(r.notes))


def _owner(team: Any) -> str | None:
    if isinstance(team, dict):
        return team.get("name")
    if isinstance(team, list) and team and isinstance(team[0], dict):
        return team[0].get("username") or team[0].get("name")
    return None


def _object(o: dict, r: _Reading) -> Model:
    path, r.dataset = f"schema.{o['name']}", []
    _relationships(o, path, r)
    properties = o.get("properties") or []
    keys = [p["name"] for p in properties if p.get("primaryKey") is True]
    fields: dict[str, Field] = {}
    columns: dict[str, str] = {}
    for p in properties:
        where = f"{path}.properties.{p['name']}"
        f = _property(p, where, keys, r)
        if f is None:
            continue
        column = p.get("physicalName") or p["name"]
        if _variable(column):
            r.skip(where, "physicalName" if p.get("physicalName") else "name", "the column's name holds a variable")
        elif column in fields:
            r.skip(where, "physicalName", f"another property has the column {column!r}")
        else:
            columns[p["name"]], fields[column] = column, f
    if len(keys) > 1:
        if r.extended and all(k in columns for k in keys):
            r.dataset.append(DatasetRule("duplicate_values", tuple(columns[k] for k in keys), equals=0))
        else:
            r.skip(path, "primaryKey", f"uniqueness of ({', '.join(keys)}) together")
    for i, q in enumerate(o.get("quality") or []):
        _object_quality(q, f"{path}.quality[{i}]", fields, columns, r)
    for name, p in ((p.get("physicalName") or p["name"], p) for p in properties):
        for i, q in enumerate(p.get("quality") or []):
            if name in fields and columns.get(p["name"]) == name:
                fields[name] = _quality(fields[name], name, q, f"{path}.properties.{p['name']}.quality[{i}]", r)
    return Model(fields, o.get("description"), False, tuple(r.dataset))


def _relationships(o: dict, path: str, r: _Reading) -> None:
    for i in range(len(o.get("relationships") or [])):
        r.skip(f"{path}.relationships[{i}]", "relationship", "references to other data aren't checked at one boundary")


def _property(p: dict, path: str, keys: list[str], r: _Reading) -> Field | None:
    promises = any(p.get(k) is True for k in ("required", "unique", "primaryKey")) or any(p.get(k) for k in ("enum", "logicalTypeOptions", "quality", "relationships"))
    meaning = p.get("semanticType")
    if meaning == "measure":
        if promises:
            r.skip(path, "semanticType measure", "a measure is an aggregate, not a value of each record")
        else:
            r.notes.append((path, "a measure is no column and isn't checked as one"))
        return None
    if meaning not in (None, "column", "dimension"):
        r.skip(path, "semanticType", f"unknown semanticType {meaning!r}")
        return None
    kind = p.get("logicalType")
    if kind not in _TYPES:
        if kind is not None or promises:
            r.skip(path, "logicalType", "no logicalType is declared" if kind is None else f"{kind} values aren't checked")
        return None
    key = p.get("primaryKey") is True
    required = p.get("required") is True or key
    if key and p.get("required") is False:
        r.notes.append((path, "part of the primary key: not null, although required is false"))
    f = Field(
        _TYPES[kind], p.get("description"), required, not required, p.get("unique") is True or (key and len(keys) == 1),
        deprecated="" if p.get("deprecated") is True else None,
    )
    f = _options(f, p.get("logicalTypeOptions") or {}, path, r)
    if f is None:
        return None
    if p.get("enum") is not None:
        values = [v["value"] if isinstance(v, dict) and "value" in v else v for v in p["enum"]]
        if any(map(_variable, values)):
            r.skip(f"{path}.enum", "enum", "a value holds a variable")
        else:
            f = _restrict(f, values)
    _relationships(p, path, r)
    return f


def _restrict(f: Field, values: list) -> Field:
    values = [v for v in values if v is not None]
    if f.allowed is not None:
        values = [v for v in f.allowed if any(same_value(v, w) for w in values)]
    return dataclasses.replace(f, allowed=tuple(values))


def _tightest(f: Field, low: bool, bound: float, exclusive: bool = False) -> Field:
    name, strict = ("min", "min_exclusive") if low else ("max", "max_exclusive")
    have = getattr(f, name)
    if have is None or (bound > have) == low and bound != have:
        return dataclasses.replace(f, **{name: bound, strict: exclusive})
    return dataclasses.replace(f, **{strict: getattr(f, strict) or (bound == have and exclusive)})


def _options(f: Field, options: dict, path: str, r: _Reading) -> Field | None:
    at = f"{path}.logicalTypeOptions"
    number, text_format = f.type in ("integer", "float"), None
    for key, v in options.items():
        where, n = f"{at}.{key}", _number(v)
        bad = lambda where=where, key=key, v=v: r.skip(where, key, f"the value {v!r} can't be read")
        if key in ("exclusiveMinimum", "exclusiveMaximum"):
            low = key == "exclusiveMinimum"
            inclusive = options.get("minimum" if low else "maximum")
            if v is False or (v is True and inclusive is None):
                continue
            n = _number(inclusive) if v is True else n
            if not number:
                r.skip(where, key, f"{key} isn't checked on {f.type} values")
            elif n is None:
                bad()
            elif f.type == "integer":
                f = _tightest(f, low, math.floor(n) + 1.0 if low else math.ceil(n) - 1.0)
            elif r.extended:
                f = _tightest(f, low, n, True)
            else:
                r.skip(where, key, "exclusive bounds of numbers aren't checked unless the extended rules are on")
        elif f.type == "string" and key in ("minLength", "maxLength"):
            if isinstance(v, int) and not isinstance(v, bool) and v >= 0:
                f = dataclasses.replace(f, **{"min_length" if key == "minLength" else "max_length": v})
            else:
                bad()
        elif f.type == "string" and key == "pattern":
            if not isinstance(v, str):
                bad()
            elif _variable(v):
                r.skip(where, key, "the pattern holds a variable")
            else:
                f = dataclasses.replace(f, pattern=v)
        elif f.type == "string" and key == "format":
            text_format = v
        elif number and key in ("minimum", "maximum"):
            if n is None:
                bad()
            else:
                f = _tightest(f, key == "minimum", n)
        elif number and key == "multipleOf":
            if r.extended and n:
                f = dataclasses.replace(f, multiple_of=n)
            else:
                r.skip(where, key, "multiples aren't checked unless the extended rules are on")
        elif f.type == "date" and key == "format" and v in _DAY_FORMATS:
            continue
        elif f.type in ("date", "timestamp") and key == "format":
            r.skip(path, f"{f.type} format", f"values of the format {v!r} aren't checked")
            return None
        else:
            r.skip(where, key, f"{key} isn't checked on {f.type} values")
    if text_format in ("email", "uri"):
        f = dataclasses.replace(f, format=text_format)
    elif text_format == "uuid" and f.pattern is None and f.min_length is None and f.max_length is None:
        f = dataclasses.replace(f, type="uuid")
    elif text_format is not None:
        r.skip(f"{at}.format", "format", f"the format {text_format!r} isn't checked" + (" together with other options" if text_format == "uuid" else ""))
    return f


# --- quality rules ---------------------------------------------------------


def _metric(q: dict, path: str, r: _Reading) -> str | None:
    """The library metric of a rule, or None if it is of a kind that isn't checked."""
    kind = q.get("type")
    metric = q.get("metric") or q.get("rule")
    if kind in (None, "library") and metric:
        return metric
    why = {"text": "prose can't be checked", "sql": "SQL rules aren't run", "custom": f"a rule of the engine {q.get('engine') or 'unnamed'}"}
    r.skip(path, kind if kind in why else "quality", why.get(kind, "the rule isn't understood"))
    return None


def _bounds(q: dict) -> tuple[dict | None, str]:
    """The bounds of a rule for a DatasetRule, or why they can't be read."""
    if q.get("unit", "rows") not in ("rows", "percent"):
        return None, f"unknown unit {q['unit']!r}"
    given = [k for k in _OPERATORS if q.get(k) is not None]
    if len(given) != 1:
        return None, "the rule needs exactly one operator such as mustBe"
    k, v = given[0], q[given[0]]
    names = {"mustBe": "equals", "mustNotBe": "differs", "mustBeGreaterThan": "above", "mustBeGreaterOrEqualTo": "at_least", "mustBeLessThan": "below", "mustBeLessOrEqualTo": "at_most"}
    if k in names:
        return ({names[k]: float(v)}, "") if _number(v) is not None else (None, f"{k} needs a number")
    if not isinstance(v, list) or len(v) != 2 or any(_number(x) is None for x in v):
        return None, f"{k} needs two numbers"
    return {k: tuple(sorted(map(float, v)))}, ""


def _zero(bounds: dict, percent: bool) -> bool | str:
    """Whether a rule tolerates no row at all, or why that can't be told."""
    whole = lambda hi: hi == 0 if percent else 0 <= hi < 1  # noqa: E731  counts are whole numbers
    (k, v), *_ = bounds.items()
    if k == "equals":
        return v == 0
    if k == "below":
        return not percent and 0 < v <= 1
    if k == "at_most":
        return whole(v)
    if k == "mustBeBetween":
        with_ends = v[0] <= 0 and whole(v[1])
        without = not percent and v[0] < 0 < v[1] <= 1
        return with_ends if with_ends == without else "the standard both includes and excludes the bounds, and here it matters; write mustBe: 0"
    return False


def _quality(f: Field, name: str, q: dict, path: str, r: _Reading) -> Field:
    metric = _metric(q, path, r)
    if metric is None:
        return f
    bounds, why = _bounds(q)
    zero = _zero(bounds, q.get("unit") == "percent") if bounds is not None else why
    if isinstance(zero, str):
        r.skip(path, metric, zero)
        return f
    arguments = q.get("arguments") or {}
    if not zero or metric == "rowCount":
        known = {"nullValues": "null_values", "duplicateValues": "duplicate_values", "rowCount": "row_count"}
        if r.extended and metric in known and not any(k.startswith("must") for k in bounds):
            r.dataset.append(DatasetRule(known[metric], () if metric == "rowCount" else (name,), q.get("unit") == "percent", **bounds))
        else:
            r.skip(path, metric, "only zero tolerance (mustBe: 0) is a rule on each value")
        return f
    if metric == "nullValues":
        return dataclasses.replace(f, required=True, nullable=False)
    if metric == "duplicateValues":
        return dataclasses.replace(f, unique=True)
    if metric == "invalidValues":
        valid, pattern = arguments.get("validValues"), arguments.get("pattern")
        if (isinstance(valid, list) and any(map(_variable, valid))) or _variable(pattern):
            r.skip(path, metric, "an argument holds a variable")
        elif isinstance(valid, list) and pattern is None:
            return _restrict(f, valid)
        elif isinstance(pattern, str) and valid is None:
            if f.pattern in (None, pattern):
                return dataclasses.replace(f, pattern=pattern)
            r.skip(path, metric, "a second pattern on the property")
        else:
            r.skip(path, metric, "either validValues (a list) or pattern is needed")
    elif metric == "missingValues":
        values = arguments.get("missingValues")
        if not isinstance(values, list):
            r.skip(path, metric, "missingValues (a list) is needed")
        elif any(v is not None and v != "" for v in values):
            r.skip(path, metric, "only null and the empty text can be checked as missing")
        else:
            if None in values:
                f = dataclasses.replace(f, required=True, nullable=False)
            if "" in values and f.type == "string":
                f = dataclasses.replace(f, min_length=max(1, f.min_length or 0))
    else:
        r.skip(path, metric, "the metric isn't known")
    return f


def _object_quality(q: dict, path: str, fields: dict[str, Field], columns: dict[str, str], r: _Reading) -> None:
    metric = _metric(q, path, r)
    if metric is None:
        return
    bounds, why = _bounds(q)
    plain = bounds is not None and not any(k.startswith("must") for k in bounds)
    if metric == "rowCount":
        if r.extended and plain:
            r.dataset.append(DatasetRule("row_count", (), False, **bounds))
        else:
            r.skip(path, metric, why or "a rule on the whole data, checked only with the extended rules")
        return
    if metric != "duplicateValues":
        r.skip(path, metric, f"{metric} of a whole schema isn't checked")
        return
    zero = _zero(bounds, q.get("unit") == "percent") if bounds is not None else why
    names = [n for n in (q.get("arguments") or {}).get("properties") or [] if isinstance(n, str)]
    if zero is not True and not (r.extended and plain and zero is False):
        r.skip(path, metric, zero if isinstance(zero, str) else "only zero tolerance is checked")
    elif not names:
        r.skip(path, metric, "arguments.properties is needed")
    elif missing := [n for n in names if n not in columns]:
        r.skip(path, metric, f"not checked themselves: {', '.join(missing)}")
    elif zero is True and len(names) == 1:
        fields[columns[names[0]]] = dataclasses.replace(fields[columns[names[0]]], unique=True)
    elif r.extended:
        r.dataset.append(DatasetRule("duplicate_values", tuple(columns[n] for n in names), q.get("unit") == "percent", **bounds))
    else:
        r.skip(path, metric, f"uniqueness of ({', '.join(names)}) together")
