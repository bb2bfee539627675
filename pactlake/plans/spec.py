"""Contracts: reading, linting, versions. Driver-side only; no Spark job.

A contract is a YAML document with the revision key `contract: 1`, or an Open Data Contract Standard
v3 document (`apiVersion`, `kind: DataContract`), which operators/odcs.py reads.
"""

from __future__ import annotations

import dataclasses
import math
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..functions import linear, shapes

TYPES = ("string", "integer", "float", "boolean", "timestamp", "date", "uuid")
FORMATS = ("email", "uri")
I64, U64 = 1 << 63, 1 << 64


class ContractError(ValueError):
    """A contract that can't be read, isn't enforceable, or lacks what is asked of it."""


@dataclass(frozen=True)
class Field:
    type: str
    description: str | None = None
    required: bool = False
    nullable: bool = False
    unique: bool = False
    pattern: str | None = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    allowed: tuple | None = None
    format: str | None = None
    deprecated: str | None = None
    # only documents of the open standard, read with extended=True, set what follows
    min_exclusive: bool = False
    max_exclusive: bool = False
    multiple_of: float | None = None


@dataclass(frozen=True)
class DatasetRule:
    """A rule on an aggregate of the records: metric (row_count, null_values, duplicate_values), the
    fields it reads, and the bounds that the value (a count, or a percentage) must keep."""

    metric: str
    fields: tuple[str, ...] = ()
    percent: bool = False
    at_least: float | None = None
    at_most: float | None = None
    above: float | None = None
    below: float | None = None
    equals: float | None = None
    differs: float | None = None

    def holds(self, value: float) -> bool:
        return (
            (self.at_least is None or value >= self.at_least) and (self.at_most is None or value <= self.at_most)
            and (self.above is None or value > self.above) and (self.below is None or value < self.below)
            and (self.equals is None or value == self.equals) and (self.differs is None or value != self.differs)
        )


@dataclass(frozen=True)
class Model:
    fields: dict[str, Field]
    description: str | None = None
    strict: bool = False
    dataset: tuple[DatasetRule, ...] = ()


@dataclass(frozen=True)
class Policy:
    on_violation: str = "block"
    max_violations: int = 0
    sample_violations: int = 10


@dataclass(frozen=True)
class Unenforced:
    path: str
    rule: str
    reason: str


@dataclass(frozen=True)
class Finding:
    level: str  # error or warning
    path: str
    message: str


@dataclass(frozen=True)
class Contract:
    id: str
    version: str
    models: dict[str, Model]
    contract: int = 1
    name: str | None = None
    owner: str | None = None
    description: str | None = None
    policy: Policy = field(default_factory=Policy)
    unenforced: tuple[Unenforced, ...] = ()
    notes: tuple[tuple[str, str], ...] = ()

    def lint(self) -> list[Finding]:
        return lint(self)

    def enforceable(self) -> bool:
        return all(f.level != "error" for f in lint(self))

    def model(self, name: str | None = None) -> tuple[str, Model]:
        """The model asked for, or the only one."""
        if name is None:
            if len(self.models) != 1:
                raise ContractError(f"contract {self.id!r} has several models, name one of: {', '.join(self.models)}")
            name = next(iter(self.models))
        if name not in self.models:
            raise ContractError(f"contract {self.id!r} has no model {name!r}, only: {', '.join(self.models)}")
        return name, self.models[name]


# --- reading ---------------------------------------------------------------


class _Loader(yaml.SafeLoader):
    """Safe YAML whose dates stay text and whose repeated keys are errors."""


_Loader.yaml_implicit_resolvers = {
    k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
}


def _mapping(loader: _Loader, node: yaml.MappingNode, deep: bool = False) -> dict:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if len(set(map(str, keys))) != len(keys):
        raise ContractError(f"a key is given twice near line {node.start_mark.line + 1}")
    return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def read_yaml(text: str) -> Any:
    try:
        return yaml.load(text, _Loader)  # noqa: S506  a subclass of SafeLoader
    except yaml.YAMLError as e:
        raise ContractError(f"not YAML: {e}") from e


def _known(what: str, given: Any, known: set[str]) -> dict:
    if not isinstance(given, dict):
        raise ContractError(f"{what} must be a mapping")
    if extra := [str(k) for k in given if k not in known]:
        raise ContractError(f"{what} has unknown keys: {', '.join(extra)}")
    return given


def _typed(what: str, value: Any, kind: type | tuple) -> Any:
    if value is not None and (not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool)):
        raise ContractError(f"{what} has the wrong type: {value!r}")
    return value


def _field(path: str, given: Any) -> Field:
    g = _known(path, given, {f.name for f in dataclasses.fields(Field)} - {"min_exclusive", "max_exclusive", "multiple_of"})
    if g.get("type") not in TYPES:
        raise ContractError(f"{path}.type must be one of {', '.join(TYPES)}, not {g.get('type')!r}")
    if g.get("format") is not None and g["format"] not in FORMATS:
        raise ContractError(f"{path}.format must be one of {', '.join(FORMATS)}, not {g['format']!r}")
    for k in ("required", "nullable", "unique"):
        _typed(f"{path}.{k}", g.get(k), bool)
    for k in ("description", "pattern"):
        _typed(f"{path}.{k}", g.get(k), str)
    for k in ("min", "max"):
        _typed(f"{path}.{k}", g.get(k), (int, float))
    for k in ("min_length", "max_length"):
        if (n := _typed(f"{path}.{k}", g.get(k), int)) is not None and n < 0:
            raise ContractError(f"{path}.{k} must not be negative")
    allowed = _typed(f"{path}.allowed", g.get("allowed"), list)
    deprecated = g.get("deprecated")
    deprecated = {True: "", False: None}.get(deprecated, deprecated) if isinstance(deprecated, bool) else _typed(f"{path}.deprecated", deprecated, str)
    return Field(**{k: v for k, v in g.items() if v is not None} | {"allowed": None if allowed is None else tuple(allowed), "deprecated": deprecated})


def parse(text: str, extended: bool = False) -> Contract:
    """The contract of a document, native or of the open standard. extended: also enforce what the
    standard's rules on aggregates, exclusive bounds and multiples ask."""
    doc = read_yaml(text)
    if isinstance(doc, dict) and "contract" not in doc and ("apiVersion" in doc or doc.get("kind") == "DataContract"):
        from ..operators.odcs import convert

        return convert(doc, extended)
    g = _known("the contract", doc, {"contract", "id", "version", "name", "owner", "description", "models", "policy"})
    if missing := [k for k in ("contract", "id", "version", "models") if g.get(k) is None]:
        raise ContractError(f"the contract lacks: {', '.join(missing)}")
    for k in ("id", "version", "name", "owner", "description"):
        _typed(k, g.get(k), str)
    models = {}
    for name, m in _typed("models", g["models"], dict).items():
        m = _known(f"models.{name}", m, {"description", "strict", "fields"})
        fields = _typed(f"models.{name}.fields", m.get("fields") or {}, dict)
        _typed(f"models.{name}.strict", m.get("strict"), bool)
        models[str(name)] = Model(
            {str(f): _field(f"models.{name}.fields.{f}", x) for f, x in fields.items()}, m.get("description"), bool(m.get("strict"))
        )
    p = _known("policy", g.get("policy") or {}, {"on_violation", "max_violations", "sample_violations"})
    policy = Policy(**{k: v for k, v in p.items() if v is not None})
    if policy.on_violation not in ("block", "warn"):
        raise ContractError("policy.on_violation must be block or warn")
    for k in ("max_violations", "sample_violations"):
        if _typed(f"policy.{k}", getattr(policy, k), int) < 0:
            raise ContractError(f"policy.{k} must not be negative")
    return Contract(g["id"], g["version"], models, _typed("contract", g["contract"], int), g.get("name"), g.get("owner"), g.get("description"), policy)


def load(source: str | Path, extended: bool = False) -> Contract:
    """From a path, or from text with a line break."""
    text = str(source)
    return parse(text if "\n" in text else Path(text).read_text(encoding="utf-8"), extended)


# --- lint ------------------------------------------------------------------


def lint(c: Contract) -> list[Finding]:
    out: list[Finding] = []
    error = lambda path, message: out.append(Finding("error", path, message))
    warning = lambda path, message: out.append(Finding("warning", path, message))
    if c.contract != 1:
        error("contract", f"revision {c.contract} is not supported, only 1")
    if not c.id.strip():
        error("id", "the id is empty")
    if Version.parse(c.version) is None:
        error("version", f"{c.version!r} is not a semantic version such as 1.2.0")
    if not c.models:
        error("models", "no models are declared")
    if c.owner is None:
        warning("owner", "no owner: reports can't name a responsible team")
    for name, m in c.models.items():
        if not m.fields:
            error(f"models.{name}", "no fields are declared")
        for fname, f in m.fields.items():
            _lint_field(f, f"models.{name}.fields.{fname}", error, warning)
    return out


def _lint_field(f: Field, path: str, error, warning) -> None:
    text, number = f.type == "string", f.type in ("integer", "float")
    if f.pattern is not None:
        if not text:
            error(path, f"pattern is for strings, not for {f.type}")
        if why := linear.check(f.pattern):
            error(path, f"the pattern can't be used: {why}")
    if f.format is not None and not text:
        error(path, f"format is for strings, not for {f.type}")
    if (f.min is not None or f.max is not None) and not number:
        error(path, f"min and max are for numbers, not for {f.type}")
    for name, bound in (("min", f.min), ("max", f.max)):
        if bound is not None and not math.isfinite(bound):
            error(path, f"{name} must be finite")
    if f.min is not None and f.max is not None and f.min > f.max:
        error(path, f"min {f.min} is above max {f.max}")
    if (f.min_length is not None or f.max_length is not None) and not text:
        error(path, f"lengths are for strings, not for {f.type}")
    if f.min_length is not None and f.max_length is not None and f.min_length > f.max_length:
        error(path, f"min_length {f.min_length} is above max_length {f.max_length}")
    if f.allowed is not None and not f.allowed:
        error(path, "allowed is empty: nothing could pass")
    for v in f.allowed or ():
        if not _of_type(v, f.type):
            error(path, f"the allowed value {v!r} is no {f.type}")
        elif f.type in shapes.SHAPES and not shapes.fits(f.type, v):
            error(path, f"the allowed value {v!r} doesn't have the shape of a {f.type}: nothing could match it")
    if f.unique and f.nullable:
        warning(path, "unique and nullable: nulls are exempt from uniqueness")


def _of_type(v: Any, kind: str) -> bool:
    if kind == "boolean":
        return isinstance(v, bool)
    if isinstance(v, bool):
        return False
    if kind == "integer":
        return isinstance(v, int) and -I64 <= v < U64
    return isinstance(v, (int, float)) if kind == "float" else isinstance(v, str)


# --- versions --------------------------------------------------------------

_SEMVER = re.compile(
    r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?"
    r"(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?"
)


@dataclass(frozen=True)
class Version:
    major: int
    minor: int
    patch: int
    pre: tuple[str, ...] = ()

    @staticmethod
    def parse(text: str) -> Version | None:
        m = _SEMVER.fullmatch(text)
        return Version(int(m[1]), int(m[2]), int(m[3]), tuple(m[4].split(".")) if m[4] else ()) if m else None

    @property
    def order(self) -> tuple:
        """Sorts by precedence: a prerelease before its release, numbers before words."""
        pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in self.pre)
        return self.major, self.minor, self.patch, not self.pre, pre

    @property
    def breaking(self) -> tuple[int, int]:
        """The part whose rise announces a break: the major, or the minor below 1.0."""
        return self.major, self.minor if self.major == 0 else 0

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}" + (f"-{'.'.join(self.pre)}" if self.pre else "")
