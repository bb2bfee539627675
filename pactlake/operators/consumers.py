"""Consumer manifests: what a consumer reads, whether that still holds, and what a change does to it."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from pathlib import Path

from ..plans.spec import Contract, ContractError, Finding, Version, read_yaml
from .diff import SEVERITIES, DiffReport, targets


@dataclass(frozen=True)
class Consumption:
    contract: str
    model: str | None = None
    fields: tuple[str, ...] | None = None
    verified: str | None = None


@dataclass(frozen=True)
class Manifest:
    id: str
    consumes: tuple[Consumption, ...]
    owner: str | None = None
    description: str | None = None


def parse(text: str) -> Manifest:
    doc = read_yaml(text)
    if not isinstance(doc, dict) or (extra := set(doc) - {"consumer", "id", "owner", "description", "consumes"}):
        raise ContractError(f"not a consumer manifest{': unknown keys ' + ', '.join(map(str, extra)) if isinstance(doc, dict) else ''}")
    if doc.get("consumer") != 1 or not str(doc.get("id") or "").strip() or not doc.get("consumes"):
        raise ContractError("a manifest needs consumer: 1, an id and consumes")
    blocks = []
    for b in doc["consumes"]:
        if not isinstance(b, dict) or set(b) - {"contract", "model", "fields", "verified"} or not b.get("contract"):
            raise ContractError("a block of consumes has contract, and may have model, fields, verified")
        if b.get("fields") is not None and not b["fields"]:
            raise ContractError("fields must not be empty; leave it out to read whole models")
        if b.get("verified") is not None and Version.parse(str(b["verified"])) is None:
            raise ContractError(f"verified {b['verified']!r} is not a semantic version")
        blocks.append(Consumption(b["contract"], b.get("model"), None if b.get("fields") is None else tuple(map(str, b["fields"])), b.get("verified")))
    return Manifest(doc["id"], tuple(blocks), doc.get("owner"), doc.get("description"))


def load_dir(folder: str) -> list[Manifest]:
    """Of every .yaml and .yml file of a folder, in order of path; two of one id are an error."""
    out = [parse(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).rglob("*.y*ml"))]
    ids = [m.id for m in out]
    if again := {i for i in ids if ids.count(i) > 1}:
        raise ContractError(f"several manifests have the id {', '.join(sorted(again))}")
    return out


def verify(manifest: Manifest, contract: Contract) -> list[Finding]:
    """Errors: a block names what the contract lacks, or its pin is behind a breaking version.
    Warnings: deprecated fields, pins that aren't current, fields named twice."""
    out: list[Finding] = []
    error = lambda path, message: out.append(Finding("error", path, message))
    warning = lambda path, message: out.append(Finding("warning", path, message))
    for i, b in enumerate(manifest.consumes):
        if b.contract != contract.id:
            continue
        at = f"consumes[{i}]"
        if b.model is not None and b.model not in contract.models:
            error(f"{at}.model", f"the contract has no model {b.model!r}")
            continue
        models = [contract.models[m] for m in ([b.model] if b.model else contract.models)]
        if b.fields is None:
            if old := list(dict.fromkeys(n for m in models for n, f in m.fields.items() if f.deprecated is not None)):
                warning(at, f"whole models are read, deprecated fields too: {', '.join(old)}")
        for k, name in enumerate(b.fields or ()):
            where = f"{at}.fields.{name}"
            have = [m.fields[name] for m in models if name in m.fields]
            if name in b.fields[:k]:
                warning(where, "named twice")
            elif not have:
                error(where, "no model that the block reads has the field")
            elif notes := [f.deprecated for f in have if f.deprecated is not None]:
                warning(where, "deprecated" + (f": {notes[0]}" if notes[0] else ""))
        if b.verified:
            pin, now = Version.parse(b.verified), Version.parse(contract.version)
            if pin is None or now is None:
                error(f"{at}.verified", "the pin or the contract's version is not semantic")
            elif now.breaking > pin.breaking:
                error(f"{at}.verified", f"verified at {pin}, but {now} is a breaking version: review it")
            elif pin.order != now.order:
                warning(f"{at}.verified", f"verified at {pin}, the contract is {now}")
    return out


def annotate(report: DiffReport, old: Contract, new: Contract, manifests: list[Manifest]) -> DiffReport:
    """Adds the consumers that the changes reach, the worst first, and those they don't."""
    ids = {old.id, new.id}
    report.impacted, report.unaffected = [], []
    for m in manifests:
        blocks = [b for b in m.consumes if b.contract in ids]
        if not blocks:
            continue
        worst, fields, paths = -1, [], []
        for c in report.changes:
            if c.impact == "producers":
                continue
            for model, field in targets(c.path, old, new):
                reads = lambda b, model=model, field=field: (model is None or b.model in (None, model)) and (field is None or b.fields is None or field in b.fields)
                if any(reads(b) for b in blocks):
                    worst = max(worst, SEVERITIES.index(c.severity))
                    paths.append(c.path)
                    fields += [field] if field else []
        if worst < 0:
            report.unaffected.append(m.id)
        else:
            report.impacted.append({"consumer": m.id, "owner": m.owner, "severity": SEVERITIES[worst], "fields": list(dict.fromkeys(fields)), "changes": list(dict.fromkeys(paths))})
    report.impacted.sort(key=lambda i: (-SEVERITIES.index(i["severity"]), i["consumer"]))
    return report


def scope(contract: Contract, manifest: Manifest, model: str | None = None) -> Contract:
    """The contract as one consumer reads it: only its fields, and not strict. A stale manifest is refused."""
    name, m = contract.model(model)
    if errors := [f for f in verify(manifest, contract) if f.level == "error"]:
        raise ContractError("the manifest is stale: " + "; ".join(f"{f.path}: {f.message}" for f in errors))
    blocks = [b for b in manifest.consumes if b.contract == contract.id and b.model in (None, name)]
    fields = m.fields
    if all(b.fields is not None for b in blocks):
        read = {f for b in blocks for f in b.fields}
        fields = {n: f for n, f in m.fields.items() if n in read}
    if not blocks or not fields:
        raise ContractError(f"consumer {manifest.id!r} reads nothing of model {name!r}")
    return dataclasses.replace(contract, models={**contract.models, name: dataclasses.replace(m, fields=fields, strict=False)})
