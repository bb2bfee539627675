"""Drift between two profiles of one model: volume, rates, categories, distributions, distinct values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .profile import FieldProfile, Profile, ordered

#: Valid values of a field that each side needs to be compared.
MIN_VALUES = 100
#: Least share of a bin, so that an empty bin has a finite weight.
_FLOOR = 1e-4


@dataclass(frozen=True)
class Thresholds:
    rate: float = 0.05
    psi: float = 0.25
    js: float = 0.1
    distinct: float = 0.1
    volume: float = 0.5


@dataclass(frozen=True)
class Drift:
    field: str | None
    metric: str
    baseline: float
    current: float
    score: float
    threshold: float
    message: str


@dataclass(frozen=True)
class DriftReport:
    findings: list[Drift]
    compared: list[str]
    not_compared: list[tuple[str, str]]

    @property
    def stable(self) -> bool:
        return not self.findings


def _change(a: float, b: float) -> float:
    return math.inf if a == 0 and b else abs(b - a) / a if a else 0.0


def drift(baseline: Profile, current: Profile, limits: Thresholds = Thresholds()) -> DriftReport:  # noqa: B008
    if (baseline.contract, baseline.model) != (current.contract, current.model):
        raise ValueError("profiles of different contracts or models can't be compared")
    found: list[Drift] = []
    per_run = [p.rows / max(1, p.runs) for p in (baseline, current)]
    if (score := _change(*per_run)) > limits.volume:
        found.append(Drift(None, "volume", *per_run, score, limits.volume, f"rows a run went from {per_run[0]:,.0f} to {per_run[1]:,.0f}"))
    compared, skipped = [], []
    for name in [*baseline.fields, *[f for f in current.fields if f not in baseline.fields]]:
        a, b = baseline.fields.get(name), current.fields.get(name)
        if a is None or b is None:
            skipped.append((name, "only one profile has it"))
        elif a.type != b.type:
            skipped.append((name, f"its type went from {a.type} to {b.type}"))
        elif not a.rows or not b.rows:
            skipped.append((name, "one side has no rows"))
        else:
            why = _field(name, a, b, limits, found)
            if why:
                skipped.append((name, why))
            else:
                compared.append(name)
    return DriftReport(found, compared, skipped)


def _field(name: str, a: FieldProfile, b: FieldProfile, limits: Thresholds, found: list[Drift]) -> str | None:
    """Adds the field's findings; says why its values weren't compared, if they weren't."""
    rates = {
        "null_rate": lambda f: f.nulls / f.rows,
        "missing_rate": lambda f: (f.rows - f.present) / f.rows,
        "invalid_rate": lambda f: f.invalid / f.rows,
    }
    for metric, rate in rates.items():
        x, y = rate(a), rate(b)
        if abs(y - x) > limits.rate:
            found.append(Drift(name, metric, x, y, abs(y - x), limits.rate, f"{metric.replace('_', ' ')} went from {x:.1%} to {y:.1%}"))
    if min(a.valid, b.valid) < MIN_VALUES:
        return f"fewer than {MIN_VALUES} valid values on a side"
    if a.categories is not None and b.categories is not None:
        score, value, x, y = jensen_shannon(a, b)
        if score > limits.js:
            found.append(Drift(name, "categories", x, y, score, limits.js, f"the share of {value} went from {x:.1%} to {y:.1%}"))
        return None
    if a.numbers and b.numbers and min(a.numbers["count"], b.numbers["count"]) >= MIN_VALUES:
        score, x, y = psi(a.histogram, b.histogram)
        if score > limits.psi:
            found.append(Drift(name, "distribution", x, y, score, limits.psi, f"the median went from {x:g} to {y:g}"))
    _distinct(name, a, b, limits, found)
    return None


def jensen_shannon(a: FieldProfile, b: FieldProfile) -> tuple[float, str, float, float]:
    """Distance of the category shares (square root of the divergence, base 2), and the value whose
    share moved most with its shares."""
    keys = dict.fromkeys([*a.categories, *b.categories])
    count = lambda f: {**{k: f.categories.get(k, 0) for k in keys}, "(other)": f.other}
    x, y = count(a), count(b)
    nx, ny = max(1, sum(x.values())), max(1, sum(y.values()))
    total, moved = 0.0, (0.0, "", 0.0, 0.0)
    for k in x:
        p, q = x[k] / nx, y[k] / ny
        m = (p + q) / 2
        total += sum(0.5 * s * math.log2(s / m) for s in (p, q) if s)
        if abs(p - q) > moved[0]:
            moved = (abs(p - q), k, p, q)
    return math.sqrt(max(0.0, total)), moved[1], moved[2], moved[3]


def psi(a: dict[str, int], b: dict[str, int]) -> tuple[float, float, float]:
    """Population stability index over the baseline's deciles, and both medians."""
    x, y = ordered(a), ordered(b)

    def at(rows, q):
        want, done = max(1, math.ceil(q * sum(n for _, n in rows))), 0
        for v, n in rows:
            done += n
            if done >= want:
                return v
        return rows[-1][0]

    edges = list(dict.fromkeys(at(x, k / 10) for k in range(1, 10)))

    def shares(rows):
        total = sum(n for _, n in rows)
        bins = [0] * (len(edges) + 1)
        for v, n in rows:
            bins[sum(v > e for e in edges)] += n
        return [max(_FLOOR, n / total) for n in bins]

    return sum((q - p) * math.log(q / p) for p, q in zip(shares(x), shares(y), strict=True)), at(x, 0.5), at(y, 0.5)


def _distinct(name: str, a: FieldProfile, b: FieldProfile, limits: Thresholds, found: list[Drift]) -> None:
    x, y = min(1.0, (a.distinct or 0) / a.valid), min(1.0, (b.distinct or 0) / b.valid)
    if x >= 0.9:
        if x - y > limits.distinct:
            found.append(Drift(name, "distinct", x, y, x - y, limits.distinct, f"distinct values fell from {x:.1%} to {y:.1%} of values"))
    elif (a.distinct or 0) < 1000 and min(a.valid, b.valid) >= 10 * max(a.distinct or 0, b.distinct or 0):
        score = _change(a.distinct or 0, b.distinct or 0)
        if score > limits.distinct and abs((b.distinct or 0) - (a.distinct or 0)) >= 2:
            found.append(Drift(name, "distinct", a.distinct or 0, b.distinct or 0, score, limits.distinct, f"distinct values went from {a.distinct} to {b.distinct}"))
