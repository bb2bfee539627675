"""One record at a time, without Spark: for embedding and for SQL functions. The same rules and verdicts
as the column expressions, which tests hold side by side."""

from __future__ import annotations

import datetime
import json
import math
from typing import Any

from ..functions import linear, shapes
from ..plans.spec import I64, U64, Contract, Field, Model


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


def parse(text: str) -> dict | None:
    """The JSON object of a line, or None. Of repeated keys the last one counts."""
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _typed(kind: str, v: Any) -> bool:
    if isinstance(v, bool) or kind == "boolean":
        return isinstance(v, bool) and kind == "boolean"
    if kind == "integer":
        return isinstance(v, int) and -I64 <= v < U64
    if kind == "float":
        return isinstance(v, (int, float)) and math.isfinite(v)
    return isinstance(v, str) and (kind == "string" or shapes.fits(kind, v))


def _constraints(f: Field, v: Any) -> list[str]:
    out = []
    if f.type in ("integer", "float"):
        if f.min is not None and (v <= f.min if f.min_exclusive else v < f.min):
            out.append("min")
        if f.max is not None and (v >= f.max if f.max_exclusive else v > f.max):
            out.append("max")
    if f.type == "string":
        if f.min_length is not None and len(v) < f.min_length:
            out.append("min_length")
        if f.max_length is not None and len(v) > f.max_length:
            out.append("max_length")
        if f.pattern is not None and not linear.searcher(f.pattern)(v):
            out.append("pattern")
        if f.format is not None and not shapes.fits_format(f.format, v):
            out.append("format")
    if f.allowed is not None and v not in f.allowed:
        out.append("allowed")
    if f.multiple_of is not None and abs(v / f.multiple_of - round(v / f.multiple_of)) > 1e-9:
        out.append("multiple_of")
    return out


def _text(v: Any) -> str:
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return text if len(text) <= 64 else text[:64] + "…"


def broken(record: dict | None, model: Model, seen: dict[str, set] | None = None) -> list[dict]:
    """What a parsed record breaks, in the order of the rules. seen: keys of each unique field so far."""
    if record is None:
        return [{"field": None, "rule": "record_not_object", "value": None}]
    out = []
    add = lambda field, rule, value: out.append({"field": field, "rule": rule, "value": value})
    for name, f in model.fields.items():
        if name not in record:
            if f.required:
                add(name, "required_missing", None)
            continue
        v = record[name]
        if v is None:
            if not f.nullable:
                add(name, "null_not_allowed", "null")
        elif not _typed(f.type, v):
            add(name, "type_mismatch", _text(v))
        else:
            for rule in _constraints(f, v):
                add(name, rule, _text(v))
            if f.unique and seen is not None:
                key = float(v) + 0.0 if f.type == "float" else v
                if key in seen.setdefault(name, set()):
                    add(name, "unique", _text(v))
                seen[name].add(key)
    if model.strict:
        for k in record:
            if k not in model.fields:
                add(k, "unexpected_field", None)
    return out


class RecordGate:
    """Judges records in turn; counts them; keeps unique keys if unique is `track`."""

    def __init__(self, contract: Contract, model: str | None = None, unique: str = "track"):
        self.contract = contract
        self.name, self.model = contract.model(model)
        if unique == "refuse" and any(f.unique for f in self.model.fields.values()):
            raise ValueError("unique fields need memory of past records: choose track or skip")
        self.seen: dict[str, set] | None = {} if unique == "track" else None
        self.counts = {"records": 0, "passed": 0, "blocked": 0, "warned": 0, "violations": 0}
        self.last: tuple[str, list[dict]] = ("", [])

    def judge(self, text: str | bytes) -> str:
        shown = text
        if isinstance(text, bytes):
            shown = text.decode(errors="replace")
            text = shown if shown.encode() == text else ""  # no record, but told in its dead letter
        found = broken(parse(text), self.model, self.seen)
        verdict = "pass" if not found else "warn" if self.contract.policy.on_violation == "warn" else "block"
        self.counts["records"] += 1
        self.counts[{"pass": "passed", "warn": "warned", "block": "blocked"}[verdict]] += 1
        self.counts["violations"] += len(found)
        self.last = (shown, found)
        return verdict

    def dead_letter(self) -> str | None:
        """Of the record judged last; None if it passed."""
        text, found = self.last
        if not found:
            return None
        now = datetime.datetime.now(datetime.UTC).isoformat()
        return json.dumps({"contract_id": self.contract.id, "contract_version": self.contract.version, "model": self.name, "ts": now, "record": text, "violations": found}, ensure_ascii=False)

    def failed(self) -> bool:
        return self.contract.policy.on_violation == "block" and self.counts["violations"] > self.contract.policy.max_violations


MAX_BYTES = 16 << 20
PREVIEW_BYTES = 256


def answer_lines(gate: RecordGate, lines, out, withheld, dlq=None) -> None:
    """Binary streams, one line back for each line in, flushed at once: a record that goes on, as it came, to
    `out`; the dead letter of one that is withheld to `withheld`, and to `dlq`, which gets those of warned
    records too. A blank line is answered by a blank one. A record over MAX_BYTES is read no further than
    that, never goes on, and its dead letter has its beginning."""
    while raw := lines.readline(MAX_BYTES + 1):
        large = len(raw) > MAX_BYTES and not raw.endswith(b"\n")
        while large and (more := lines.readline(MAX_BYTES)) and not more.endswith(b"\n"):
            pass
        body = raw.removesuffix(b"\n").removesuffix(b"\r")
        if not body.strip():
            out.write(b"\n")
            out.flush()
            continue
        verdict = gate.judge(body[:PREVIEW_BYTES].decode(errors="replace") if large else body)
        letter = gate.dead_letter()
        goes_on = verdict != "block" and not large
        for to in [*([] if goes_on else [withheld]), *([dlq] if dlq is not None and letter else [])]:
            to.write((letter or "").encode() + b"\n")
            to.flush()
        if goes_on:
            out.write(body + b"\n")
            out.flush()


def judge_texts(texts, contract: Contract, model: str) -> list[tuple[str | None, str | None]]:
    """(verdict, dead letter) of each text, without memory of the ones before; a null has neither."""
    gate = RecordGate(contract, model, "skip")
    return [(None, None) if t is None else (gate.judge(t), gate.dead_letter()) for t in texts]
