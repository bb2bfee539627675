"""The same functions over HTTP (/v1/...) and as tools over standard input and output (JSON-RPC)."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .operators import consumers, documents, drift, profile
from .operators.check import check_source
from .operators.diff import diff
from .plans.spec import Contract, ContractError, parse
from .sources.read import read
from .streaming.gate import newest_dead_letters

BODY_LIMIT = 64 << 20


def validate(text: str) -> dict:
    c = parse(text)
    found = c.lint()
    return {"valid": all(f.level != "error" for f in found), "findings": [vars(f) for f in found], "unenforced": [vars(u) for u in c.unenforced]}


def check_records(spark: SparkSession, contract: Contract, records: list, model: str | None = None) -> dict:
    return check_source(spark, read(spark, records, "<records>", rows=True), contract, model).to_dict()


def compare(old: str, new: str, manifests: list[str] = ()) -> dict:
    a, b = parse(old), parse(new)
    r = diff(a, b)
    if manifests:
        consumers.annotate(r, a, b, [consumers.parse(m) for m in manifests])
    return {"changes": [vars(c) for c in r.changes], "worst": r.worst, "impacted": r.impacted, "unaffected": r.unaffected}


def compare_profiles(baseline: str, current: str) -> dict:
    r = drift.drift(profile.Profile.parse(baseline), profile.Profile.parse(current))
    return {"stable": r.stable, "findings": [vars(f) for f in r.findings], "not_compared": r.not_compared}


def handle(spark: SparkSession, contract: Contract, model: str | None, method: str, path: str, body: dict, dlq: str | None = None, stats: str | None = None) -> tuple[int, Any]:
    """(status, answer) of a request; needs no socket."""
    route, _, query = path.partition("?")
    try:
        if (method, route) == ("GET", "/v1/health"):
            return 200, {"status": "ok", **documents.ENGINE}
        if (method, route) == ("GET", "/v1/contract"):
            return 200, {"id": contract.id, "version": contract.version, "models": {n: {f: documents.explain_field(x) for f, x in m.fields.items()} for n, m in contract.models.items()}}
        if (method, route) == ("POST", "/v1/validate"):
            return 200, validate(body["contract"])
        if (method, route) == ("POST", "/v1/check"):
            return 200, check_records(spark, contract, body["records"], body.get("model", model))
        if (method, route) == ("POST", "/v1/diff"):
            return 200, compare(body["old"], body["new"], body.get("manifests", ()))
        if (method, route) == ("POST", "/v1/consumers/verify"):
            return 200, {"findings": [vars(f) for f in consumers.verify(consumers.parse(body["manifest"]), contract)]}
        if (method, route) == ("GET", "/v1/gate/stats"):
            return (200, json.loads(Path(stats).read_text(encoding="utf-8"))) if stats and Path(stats).exists() else (404, {"error": "no gate statistics"})
        if (method, route) == ("GET", "/v1/dlq"):
            if not dlq:
                return 404, {"error": "no dead letters"}
            limit = int(dict(p.partition("=")[::2] for p in query.split("&") if p).get("limit", 50))
            letters, skipped = newest_dead_letters(spark, dlq, limit)
            return 200, {"letters": letters, "skipped": skipped}
    except (ContractError, ValueError, KeyError, TypeError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such route"}


def serve(spark: SparkSession, contract: Contract, model: str | None, addr: str, dlq: str | None = None, stats: str | None = None) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > BODY_LIMIT:
                status, answer = 413, {"error": "the body is too large"}
            else:
                try:
                    body = json.loads(self.rfile.read(size) or b"{}")
                    status, answer = handle(spark, contract, model, method, self.path, body, dlq, stats)
                except json.JSONDecodeError as e:
                    status, answer = 400, {"error": str(e)}
            raw = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

    host, _, port = addr.rpartition(":")
    ThreadingHTTPServer((host, int(port)), Handler).serve_forever()


_TEXT, _LIST = {"type": "string"}, {"type": "array"}
TOOLS = {
    "validate": ("Lints a contract", {"contract": _TEXT}),
    "check": ("Checks records, or a file, against a contract", {"contract": _TEXT, "records": _LIST, "path": _TEXT, "model": _TEXT}),
    "diff": ("Classifies the changes between two contracts", {"old": _TEXT, "new": _TEXT, "manifests": _LIST}),
    "explain": ("Says in words what a contract asks", {"contract": _TEXT}),
    "drift": ("Compares two profiles", {"baseline": _TEXT, "current": _TEXT}),
}


def call_tool(spark: SparkSession, name: str, a: dict) -> Any:
    if name == "validate":
        return validate(a["contract"])
    if name == "check":
        c = parse(a["contract"])
        if "path" in a:
            return check_source(spark, read(spark, a["path"]), c, a.get("model")).to_dict()
        return check_records(spark, c, a["records"], a.get("model"))
    if name == "diff":
        return compare(a["old"], a["new"], a.get("manifests", ()))
    if name == "explain":
        return documents.explain(parse(a["contract"]))
    if name == "drift":
        return compare_profiles(a["baseline"], a["current"])
    raise ValueError(f"no tool {name!r}")


def answer(spark: SparkSession, request: dict) -> dict | None:
    """The JSON-RPC answer to a request; None to a notification."""
    if "id" not in request:
        return None
    base = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return base | {"result": {"protocolVersion": params.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": documents.ENGINE}}
    if method == "tools/list":
        return base | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p) in TOOLS.items()]}}
    if method == "tools/call":
        try:
            got = call_tool(spark, params.get("name"), params.get("arguments") or {})
            text = got if isinstance(got, str) else json.dumps(got, ensure_ascii=False, default=str)
            return base | {"result": {"content": [{"type": "text", "text": text}], "isError": False}}
        except (ContractError, ValueError, KeyError, TypeError, OSError) as e:
            return base | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    if method == "ping":
        return base | {"result": {}}
    return base | {"error": {"code": -32601, "message": f"no method {method!r}"}}


def tools_over_stdio(spark: SparkSession) -> None:
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            out = answer(spark, json.loads(line))
        except json.JSONDecodeError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if out is not None:
            print(json.dumps(out, ensure_ascii=False), flush=True)
