"""The command line. Exit codes: 0 passed, 1 a contract or comparison failed, 2 it couldn't be run."""

from __future__ import annotations

import argparse
import contextlib
import dataclasses
import datetime
import json
import sys
import time
from pathlib import Path

from .operators import conformance, consumers, documents, drift, export, infer, profile
from .operators.check import check_source
from .operators.diff import FAIL_ON, diff
from .plans.spec import ContractError, load
from .sources.read import read
from .streaming import gate, kafka, records

PASS, FAIL, ERROR = 0, 1, 2


def session():
    """A session for these commands: UTC, and otherwise the cluster's own settings."""
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pactlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(args, human: str, machine) -> None:
    print(json.dumps(machine, ensure_ascii=False, indent=2, default=str) if args.format == "json" else human)


def _enforceable(path: str, allow: bool):
    c = load(path)
    if c.unenforced and not allow:
        raise ContractError("rules that can't be enforced (see --allow-unenforced): " + "; ".join(f"{u.path}: {u.reason}" for u in c.unenforced))
    return c


def _validate(args) -> int:
    c = load(args.contract)
    found = c.lint()
    lines = [f"{f.level}: {f.path}: {f.message}" for f in found] + [f"not enforced: {u.path}: {u.reason}" for u in c.unenforced]
    _show(args, "\n".join(lines) or "valid", {"findings": [vars(f) for f in found], "unenforced": [vars(u) for u in c.unenforced]})
    return FAIL if any(f.level == "error" for f in found) else PASS


def _check(args) -> int:
    c = _enforceable(args.contract, args.allow_unenforced)
    if args.max_violations is not None:
        c = dataclasses.replace(c, policy=dataclasses.replace(c.policy, max_violations=args.max_violations))
    if args.as_consumer:
        c = consumers.scope(c, consumers.parse(Path(args.as_consumer).read_text(encoding="utf-8")), args.model)
    spark, began, started = session(), time.time(), datetime.datetime.now(datetime.UTC)
    reports = [check_source(spark, read(spark, d, None, args.data_format), c, args.model) for d in args.data]
    total = sum(r.violations for r in reports)
    verdict = documents.outcome(total, c.policy.max_violations, c.policy.on_violation == "warn")
    lines = []
    for r in reports:
        lines.append(f"{r.source}: {r.rows:,} rows, {r.violations:,} violations")
        lines += [f"  {f or '(record)'} {rule}: {n:,}" for f, rule, n in r.per_rule]
        lines += [f"    row {s.row}: {s.message}" for s in r.samples]
    _show(args, "\n".join([*lines, verdict.upper()]), {"verdict": verdict, "reports": [r.to_dict() for r in reports]})
    if args.profile:
        found = None
        for d in args.data:
            one = profile.profile(spark, d, c, args.model, args.data_format)
            found = one if found is None else profile.merge(spark, found, one)
        Path(args.profile).write_text(found.to_json(), encoding="utf-8")
    key = args.sample_key.encode() if args.sample_key else None
    doc = documents.for_check(reports, started, time.time() - began, args.report_samples, key)
    _publish(args, doc, c)
    return FAIL if verdict == "fail" else PASS


def _publish(args, doc: dict, c=None) -> None:
    if args.report_json:
        Path(args.report_json).write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    if args.report_to:
        documents.send(doc, args.report_to, args.token)
    if getattr(args, "openlineage", None):
        for e in documents.lineage(doc, c):
            documents.send(e, args.openlineage, args.token)


def _profile(args) -> int:
    spark, out = session(), None
    for p in args.profiles:
        one = profile.Profile.parse(Path(p).read_text(encoding="utf-8"))
        out = one if out is None else profile.merge(spark, out, one)
    if args.out:
        Path(args.out).write_text(out.to_json(), encoding="utf-8")
    _show(args, profile.summary(out), json.loads(out.to_json()))
    return PASS


def _drift(args) -> int:
    a, b = (profile.Profile.parse(Path(p).read_text(encoding="utf-8")) for p in (args.baseline, args.current))
    r = drift.drift(a, b, drift.Thresholds(args.rate, args.psi, args.js, args.distinct, args.volume))
    lines = [f"{f.field or 'rows'} {f.metric}: {f.message}" for f in r.findings] + [f"{n}: not compared, {why}" for n, why in r.not_compared]
    _show(args, "\n".join(lines) or "stable", {"findings": [vars(f) for f in r.findings], "not_compared": r.not_compared})
    return PASS if r.stable else FAIL


def _diff(args) -> int:
    began, started = time.time(), datetime.datetime.now(datetime.UTC)
    old, new = load(args.old), load(args.new)
    r = diff(old, new)
    if args.consumers:
        consumers.annotate(r, old, new, consumers.load_dir(args.consumers))
    lines = [f"{c.severity} ({c.impact}) {c.path}: {c.message}" for c in r.changes] + [f"reaches {i['consumer']}: {i['severity']}" for i in r.impacted or []]
    doc = documents.for_diff(old, r, args.fail_on, started, time.time() - began)
    _show(args, "\n".join(lines) or "no changes", doc)
    _publish(args, doc)
    return FAIL if r.fails(args.fail_on) else PASS


def _consumer_check(args) -> int:
    c = load(args.contract)
    found = []
    for p in args.manifests:
        ms = consumers.load_dir(p) if Path(p).is_dir() else [consumers.parse(Path(p).read_text(encoding="utf-8"))]
        found += [(m.id, f) for m in ms for f in consumers.verify(m, c)]
    _show(args, "\n".join(f"{i}: {f.level}: {f.path}: {f.message}" for i, f in found) or "all hold", [{"consumer": i, **vars(f)} for i, f in found])
    return FAIL if any(f.level == "error" for _, f in found) else PASS


def _gate(args) -> int:
    if args.source == "-":
        return _gate_lines(args)
    if not (args.to and args.dlq and args.checkpoint):
        raise ContractError("a gate on a folder or topic needs --to, --dlq and --checkpoint")
    c = _enforceable(args.contract, args.allow_unenforced)
    spark = session()
    trigger = {"availableNow": True} if args.exit_at_end else {"processingTime": "1 second"}
    if args.brokers:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", args.brokers).option("subscribe", args.source)
        stream = stream.option("startingOffsets", "earliest").option("includeHeaders", True).load()
        query, stats = kafka.gate(stream, c, args.brokers, args.to, args.dlq, args.checkpoint, args.model, args.unique, trigger, args.stats)
    else:
        stream = spark.readStream.text(args.source)
        query, stats = gate.gate(stream, c, args.to, args.dlq, args.checkpoint, args.model, args.unique, stats=args.stats, trigger=trigger)
    query.awaitTermination()
    _show(args, ", ".join(f"{k}: {v:,}" for k, v in stats.counters().items()), stats.snapshot(c, c.model(args.model)[0]))
    return FAIL if stats.failed(c) else PASS


def _gate_lines(args) -> int:
    """Standard input to standard output, one line for one line, without Spark."""
    c = _enforceable(args.contract, args.allow_unenforced)
    one = records.RecordGate(c, args.model, args.unique)
    with open(args.dlq, "ab") if args.dlq else contextlib.nullcontext() as dlq:
        records.answer_lines(one, sys.stdin.buffer, sys.stdout.buffer, sys.stderr.buffer, dlq)
    return FAIL if one.failed() else PASS


def _infer(args) -> int:
    d = infer.infer(session(), args.data if len(args.data) > 1 else args.data[0], args.id, args.model, args.sample, args.max_enum, not args.no_ranges)
    text = d.to_yaml()
    if args.out:
        Path(args.out).write_text(text, encoding="utf-8")
    else:
        print(text, end="")
    return PASS


def _conformance(args) -> int:
    counts, results = conformance.run_folder(session(), args.vectors, args.extended)
    _show(args, "\n".join(f"{o}: {i} {why}".rstrip() for i, o, why in results), {"counts": counts, "results": results})
    return FAIL if counts["fail"] or counts["error"] else PASS


def _push(args) -> int:
    for p in args.documents:
        documents.send(json.loads(Path(p).read_text(encoding="utf-8")), args.to, args.token)
    return PASS


def _init(args) -> int:
    if Path(args.path).exists():
        raise ContractError(f"{args.path} is there already")
    Path(args.path).write_text(documents.STARTER, encoding="utf-8")
    return PASS


def _export(args) -> int:
    e = export.postgres(load(args.contract), args.model, args.table, args.allow_unenforced)
    if args.out:
        Path(args.out).write_text(e.sql, encoding="utf-8")
    else:
        print(e.sql, end="")
    return PASS


def _explain(args) -> int:
    print(documents.explain(load(args.contract)))
    return PASS


def _serve(args) -> int:
    from .serve import serve

    serve(session(), load(args.contract), args.model, args.addr, args.dlq, args.gate_stats)
    return PASS


def _mcp(args) -> int:
    from .serve import tools_over_stdio

    tools_over_stdio(session())
    return PASS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pactlake", description="Data contracts on Spark")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *positional, many: str | None = None, contract: bool = False, publish: bool = False):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--format", choices=("human", "json"), default="human")
        for x in positional:
            c.add_argument(x)
        if many:
            c.add_argument(many, nargs="+")
        if contract:
            c.add_argument("-c", "--contract", required=True)
            c.add_argument("-m", "--model")
            c.add_argument("--allow-unenforced", action="store_true")
        if publish:
            c.add_argument("--report-json")
            c.add_argument("--report-to")
            c.add_argument("--token")
        return c

    command("validate", _validate, "contract")
    c = command("check", _check, many="data", contract=True, publish=True)
    c.add_argument("--data-format", choices=("ndjson", "csv", "parquet"))
    c.add_argument("--max-violations", type=int)
    for x in ("--as-consumer", "--profile", "--openlineage", "--sample-key"):
        c.add_argument(x)
    c.add_argument("--report-samples", choices=documents.SAMPLE_MODES, default="masked")
    c = command("profile", _profile, many="profiles")
    c.add_argument("-o", "--out")
    c = command("drift", _drift, "baseline", "current")
    for f in dataclasses.fields(drift.Thresholds):
        c.add_argument(f"--{f.name}", type=float, default=f.default)
    command("consumer-check", _consumer_check, many="manifests", contract=True)
    c = command("diff", _diff, "old", "new", publish=True)
    c.add_argument("--consumers")
    c.add_argument("--fail-on", choices=FAIL_ON, default="breaking")
    c = command("gate", _gate, "source", contract=True)
    for x in ("--to", "--dlq", "--checkpoint", "--stats", "--brokers"):
        c.add_argument(x)
    c.add_argument("--exit-at-end", action="store_true")
    c.add_argument("--unique", choices=(gate.REFUSE, gate.SKIP, gate.TRACK), default=gate.TRACK)
    c = command("infer", _infer, many="data")
    c.add_argument("--id")
    c.add_argument("--model")
    c.add_argument("--sample", type=int, default=infer.SAMPLE)
    c.add_argument("--max-enum", type=int, default=infer.MAX_ENUM)
    c.add_argument("--no-ranges", action="store_true")
    c.add_argument("-o", "--out")
    c = command("conformance", _conformance, "vectors")
    c.add_argument("--extended", action="store_true")
    c = command("push", _push, many="documents")
    c.add_argument("--to", required=True)
    c.add_argument("--token")
    command("init", _init, "path")
    c = command("export", _export, contract=True)
    c.add_argument("--table")
    c.add_argument("-o", "--out")
    command("explain", _explain, "contract")
    c = command("serve", _serve, contract=True)
    c.add_argument("--addr", default="127.0.0.1:8787")
    c.add_argument("--dlq")
    c.add_argument("--gate-stats")
    command("mcp", _mcp)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return ERROR if e.code else PASS
    try:
        return args.run(args)
    except (ContractError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
