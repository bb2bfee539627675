"""Diffs, consumers, standard documents, conformance, export, documents, command line."""

import datetime
import json
from pathlib import Path

import pytest

from pactlake.cli import main
from pactlake.operators import conformance, consumers, documents, export
from pactlake.operators.check import check
from pactlake.operators.diff import diff
from pactlake.plans.spec import ContractError, parse

BASE = """
contract: 1
id: orders
version: {version}
owner: team
models:
  orders:
    strict: {strict}
    fields:
      id: {id}
{more}
policy: {policy}
"""


def contract(version="1.2.0", strict="false", id="{type: string, required: true}", more="      cur: {type: string, allowed: [USD, EUR]}", policy="{max_violations: 0}"):
    return parse(BASE.format(version=version, strict=strict, id=id, more=more, policy=policy))


#: (change, severity, impact)
CHANGES = [
    ({"id": "{type: integer, required: true}"}, "breaking", "both"),
    ({"id": "{type: string}"}, "risky", "consumers"),
    ({"id": "{type: string, required: true, nullable: true}"}, "breaking", "consumers"),
    ({"id": "{type: string, required: true, unique: true}"}, "risky", "producers"),
    ({"id": "{type: string, required: true, pattern: x}"}, "risky", "producers"),
    ({"id": "{type: string, required: true, format: uri}"}, "risky", "producers"),
    ({"id": "{type: string, required: true, min_length: 1}"}, "risky", "producers"),
    ({"id": "{type: string, required: true, deprecated: use key}"}, "info", "consumers"),
    ({"strict": "true"}, "risky", "producers"),
    ({"more": ""}, "breaking", "consumers"),
    ({"more": "      cur: {type: string, allowed: [USD]}"}, "risky", "producers"),
    ({"more": "      cur: {type: string, allowed: [USD, EUR, GBP]}"}, "risky", "consumers"),
    ({"more": "      cur: {type: string}"}, "risky", "consumers"),
    ({"more": "      cur: {type: string, allowed: [USD, EUR]}\n      n: {type: float}"}, "info", "consumers"),
    ({"more": "      cur: {type: string, allowed: [USD, EUR]}\n      n: {type: float, required: true}"}, "breaking", "producers"),
    ({"policy": "{on_violation: warn}"}, "risky", "consumers"),
    ({"policy": "{max_violations: 5}"}, "risky", "consumers"),
]


@pytest.mark.parametrize(("change", "severity", "impact"), CHANGES)
def test_each_change(change, severity, impact):
    r = diff(contract(), contract("2.0.0", **change))
    assert [(c.severity, c.impact) for c in r.changes] == [(severity, impact)]
    assert r.fails("any") and r.fails("breaking") == (severity == "breaking") and not r.fails("never")


def test_bounds_and_numbers_by_value():
    a, b = (parse(BASE.format(version=v, strict="false", id=f, more="", policy="{}")) for v, f in (("1.0.0", "{type: integer, min: 1, max: 9, allowed: [1, 2]}"), ("1.1.0", "{type: integer, min: 2, max: 10, allowed: [2, 1]}")))
    assert [(c.impact, c.message.split()[0]) for c in diff(a, b).changes] == [("producers", "min"), ("consumers", "max")]
    f = parse(BASE.format(version="1.1.0", strict="false", id="{type: float, min: 1, max: 9, allowed: [1.0, 2]}", more="", policy="{}"))
    assert [c.severity for c in diff(a, f).changes] == ["risky"]


@pytest.mark.parametrize(
    ("old", "new", "more", "found"),
    [
        ("1.2.0", "1.2.1", "", "breaking"), ("1.2.0", "2.0.0", "", None), ("1.2.0", "1.3.0", "      cur: {type: string}", None), ("1.2.0", "1.2.1", "      cur: {type: string}", "breaking"),
        ("2.0.0-a.1", "2.0.0-a.2", "", None), ("2.0.0-a.1", "2.0.0", "", None), ("0.1.0", "0.2.0", "", "breaking"), ("1.2.0", "x", "", "risky"),
        ("1.2.0", "1.1.0", "      cur: {type: string, allowed: [USD, EUR]}", "risky"),
    ],
)
def test_versions_must_rise_enough(old, new, more, found):
    assert next((c.severity for c in diff(contract(old), contract(new, more=more)).changes if c.path == "version"), None) == found


MANIFEST = "consumer: 1\nid: {id}\nconsumes:\n  - {{contract: orders, {rest}}}\n"


def manifest(id, rest):
    return consumers.parse(MANIFEST.format(id=id, rest=rest))


def test_blast_radius():
    old, new = contract(), contract("2.0.0", more="", policy="{max_violations: 3}")
    ms = [manifest("a", "fields: [cur]"), manifest("b", "fields: [id]"), manifest("c", "model: other"), manifest("d", "verified: 1.0.0"), consumers.parse("consumer: 1\nid: e\nconsumes: [{contract: else}]")]
    r = consumers.annotate(diff(old, new), old, new, ms)
    assert [(i["consumer"], i["severity"]) for i in r.impacted] == [("a", "breaking"), ("d", "breaking"), ("b", "risky"), ("c", "risky")]
    assert r.unaffected == [] and r.fails("breaking-with-consumers")
    r = consumers.annotate(diff(old, contract("2.0.0", more="")), old, contract("2.0.0", more=""), ms[1:2])
    assert r.unaffected == ["b"] and not r.fails("breaking-with-consumers") and r.fails()
    with pytest.raises(ValueError):
        diff(old, new).fails("breaking-with-consumers")


def test_verification_and_scope():
    c = contract("2.1.0", id="{type: string, required: true, deprecated: ''}")
    levels = lambda rest: [(f.level, f.path.rpartition(".")[2]) for f in consumers.verify(manifest("m", rest), c)]
    assert levels("fields: [cur], verified: 2.1.0") == []
    assert levels("fields: [gone]") == [("error", "gone")] and levels("model: none") == [("error", "model")]
    assert levels("fields: [id, id], verified: 1.9.0") == [("warning", "id"), ("warning", "id"), ("error", "verified")]
    assert levels("verified: 2.0.0") == [("warning", "consumes[0]"), ("warning", "verified")]
    assert list(consumers.scope(c, manifest("m", "fields: [cur]")).models["orders"].fields) == ["cur"]
    with pytest.raises(ContractError):
        consumers.scope(c, manifest("m", "fields: [gone]"))
    with pytest.raises(ContractError):
        consumers.scope(c, consumers.parse("consumer: 1\nid: e\nconsumes: [{contract: else}]"))


@pytest.mark.parametrize("bad", ["consumer: 2\nid: x\nconsumes: [{contract: a}]", "consumer: 1\nid: x", "consumer: 1\nid: x\nconsumes: [{contract: a, fields: []}]", "consumer: 1\nid: x\nconsumes: [{contract: a, verified: x}]", "[]"])
def test_unreadable_manifests(bad):
    with pytest.raises(ContractError):
        consumers.parse(bad)


# --- standard documents ----------------------------------------------------

DOC = "apiVersion: v3.1.0\nkind: DataContract\nid: v\nversion: 1.0.0\nschema:\n  - name: t\n    properties:\n      - name: v\n        logicalType: {kind}\n{rest}"


def vector(kind, rest, records, verdict, failing=None):
    return {"contract": DOC.format(kind=kind, rest=rest), "records": records, "expect": {"verdict": verdict, **({"failing": failing} if failing is not None else {})}}


Q = "        quality:\n          - {%s}\n"
VECTORS = [
    (vector("integer", "        required: true\n", [{"v": 1}, {}, {"v": None}], "fail", [1, 2]), "pass", "pass"),
    (vector("integer", "", [{}, {"v": None}], "pass"), "pass", "pass"),
    (vector("string", "        primaryKey: true\n", [{"v": "a"}, {"v": "a"}, {}], "fail", [1, 2]), "pass", "pass"),
    (vector("integer", "        logicalTypeOptions: {exclusiveMaximum: 10}\n", [{"v": 9}, {"v": 10}], "fail", [1]), "pass", "pass"),
    (vector("number", "        logicalTypeOptions: {exclusiveMaximum: 10}\n", [{"v": 9.9}, {"v": 10}], "fail", [1]), "unsupported", "pass"),
    (vector("integer", "        logicalTypeOptions: {multipleOf: 3}\n", [{"v": 9}, {"v": 10}], "fail", [1]), "unsupported", "pass"),
    (vector("string", "        logicalTypeOptions: {format: uuid}\n", [{"v": "x"}], "fail", [0]), "pass", "pass"),
    (vector("string", Q % "metric: invalidValues, arguments: {validValues: [a, b]}, mustBe: 0", [{"v": "a"}, {"v": "c"}], "fail", [1]), "pass", "pass"),
    (vector("string", Q % "metric: missingValues, arguments: {missingValues: ['', null]}, mustBeLessThan: 1", [{"v": ""}, {"v": None}, {"v": "x"}], "fail", [0, 1]), "pass", "pass"),
    (vector("integer", Q % "metric: nullValues, mustBeLessThan: 50, unit: percent", [{"v": None}, {"v": 1}, {"v": 1}], "pass"), "unsupported", "pass"),
    (vector("integer", Q % "metric: nullValues, mustBeBetween: [0, 1]", [{"v": 1}], "pass"), "unsupported", "unsupported"),
    (vector("integer", Q % "type: sql, query: x", [{"v": 1}], "pass"), "unsupported", "unsupported"),
    (vector("integer", "    quality:\n      - {metric: rowCount, mustBeGreaterThan: 5}\n", [{"v": 1}], "fail"), "unsupported", "pass"),
    (vector("integer", "      - {name: w, logicalType: integer}\n    quality:\n      - {metric: duplicateValues, arguments: {properties: [v, w]}, mustBe: 0}\n", [{"v": 1, "w": 1}, {"v": 1, "w": 1}], "fail"), "unsupported", "pass"),
    (vector("object", "        required: true\n", [{"v": 1}], "pass"), "unsupported", "unsupported"),
    (vector("string", "        logicalTypeOptions: {pattern: '${P}'}\n", [{"v": "a"}], "pass"), "unsupported", "unsupported"),
]


@pytest.mark.parametrize("k", range(len(VECTORS)))
def test_vectors(spark, k):
    v, plain, extended = VECTORS[k]
    assert conformance.run(spark, v) [0] == plain
    assert conformance.run(spark, v, True)[0] == extended


def test_columns_owner_and_refusals(spark):
    c = parse(DOC.format(kind="string", rest="        physicalName: col\n").replace("id: v\n", "id: 7\nteam: {name: data}\ndescription: {purpose: why}\n"))
    assert list(c.models["t"].fields) == ["col"] and (c.id, c.owner, c.description) == ("7", "data", "why")
    for bad in (DOC.replace("DataContract", "Else"), DOC.replace("v3.1.0", "v2.2.2")):
        with pytest.raises(ContractError):
            parse(bad.format(kind="string", rest=""))
    with pytest.raises(ContractError):
        check(spark, [{"v": 1}], DOC.format(kind="array", rest="        required: true\n"))


# --- export ----------------------------------------------------------------


def test_postgres_tables():
    c = parse("""
contract: 1
id: o
version: 1.0.0
models:
  t:
    fields:
      a: {type: string, required: true, unique: true, pattern: "^x[0-9]+$", max_length: 9}
      n: {type: integer, min: 1.5, max: 9, allowed: [2, 3]}
      f: {type: float, max: 0.1}
      d: {type: date, allowed: ['2026-01-01']}
      'q"x': {type: uuid}
""")
    sql = export.postgres(c, table="s.t").sql
    for part in ('CREATE TABLE "s"."t"', '"a" text NOT NULL', "char_length(\"a\") <= 9", '("a" COLLATE "C") ~ \'^x[0-9]+$\'', '"n" >= 2', '"n" <= 9', "\"n\" IN (2, 3)", "'NaN'::float8", "'2026-01-01'::date", '"q""x" text', 'UNIQUE ("a")'):
        assert part in sql, part
    lazy = parse("contract: 1\nid: o\nversion: 1.0.0\nmodels: {t: {fields: {a: {type: string, pattern: '\\\\w+'}, t: {type: timestamp, unique: true}}}}\n")
    with pytest.raises(ContractError):
        export.postgres(lazy)
    assert len(export.postgres(lazy, allow_unenforced=True).unenforced) == 2


# --- documents and commands ------------------------------------------------


def test_report_documents_and_lineage(spark):
    c = contract()
    r = check(spark, [{"id": "a", "cur": "GBP"}, {"cur": "USD"}], c)
    started = datetime.datetime(2026, 1, 2, tzinfo=datetime.UTC)
    d = documents.for_check([r], started, 1.5, "hashed", b"0123456789abcdef")
    assert (d["kind"], d["verdict"], d["violations"], d["run"]["duration_ms"]) == ("check", "fail", 2, 1500)
    assert "GBP" not in json.dumps(d) and d["checks"][0]["samples"][1]["hash"]
    assert documents.for_check([r], started, 1, "none")["checks"][0]["samples"] == []
    first, last = documents.lineage(d, c)
    assert first["run"]["runId"] == last["run"]["runId"] and first["run"]["runId"][14] == "7" and first["eventType"] == "START"
    told = {(a.get("column"), a["assertion"]): a["success"] for a in last["inputs"][0]["inputFacets"]["dataQualityAssertions"]["assertions"]}
    assert told[("id", "required_missing")] is False and told[("cur", "allowed")] is False and told[("id", "type_mismatch")] is True
    with pytest.raises(ValueError):
        documents.send(d, "http://example.com")
    assert documents.ci_context({"GITHUB_ACTIONS": "1", "GITHUB_SHA": "abc"})["commit"] == "abc"


def test_commands(spark, tmp_path, capsys):
    path = tmp_path / "c.yaml"
    assert main(["init", str(path)]) == 0 and main(["init", str(path)]) == 2
    assert main(["validate", str(path)]) == 0 and main(["validate", str(tmp_path / "none")]) == 2 and main(["nothing"]) == 2
    data = tmp_path / "x.ndjson"
    data.write_text('{"id":"a","created_at":"2026-01-01T00:00:00Z"}\n{"id":"a","created_at":"2026-01-01T00:00:00Z"}\n')
    prof = tmp_path / "p.json"
    assert main(["check", str(data), "-c", str(path), "--report-json", str(tmp_path / "r.json"), "--profile", str(prof)]) == 1
    assert main(["check", str(data), "-c", str(path), "--max-violations", "1"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["violations"] == 1
    assert main(["profile", str(prof), str(prof), "-o", str(tmp_path / "q.json")]) == 0 and main(["drift", str(prof), str(prof)]) == 0
    assert main(["diff", str(path), str(path)]) == 0 and main(["export", "-c", str(path), "--allow-unenforced"]) == 0
    changed = tmp_path / "d.yaml"
    changed.write_text(path.read_text().replace("      created_at: {type: timestamp, required: true}\n", ""))
    assert main(["diff", str(path), str(changed)]) == 1 and main(["diff", str(path), str(changed), "--fail-on", "never"]) == 0
    m = tmp_path / "m.yaml"
    m.write_text("consumer: 1\nid: x\nconsumes: [{contract: my_dataset, fields: [created_at]}]")
    assert main(["consumer-check", str(m), "-c", str(path)]) == 0 and main(["consumer-check", str(m), "-c", str(changed)]) == 1
    assert main(["infer", str(data), "-o", str(tmp_path / "draft.yaml")]) == 0 and parse((tmp_path / "draft.yaml").read_text()).enforceable()
    assert "created_at" in capsys.readouterr().out + Path(path).read_text()


def test_routes_and_tools(spark, tmp_path):
    from pactlake import serve

    c = contract()
    ask = lambda method, path, **body: serve.handle(spark, c, None, method, path, body, None, str(tmp_path / "s.json"))
    assert ask("GET", "/v1/health")[0] == 200 and ask("GET", "/v1/none")[0] == 404 and ask("POST", "/v1/check")[0] == 400
    assert ask("POST", "/v1/check", records=[{"id": "x"}])[1]["passed"] is True
    assert ask("POST", "/v1/validate", contract="x: 1")[0] == 400 and ask("GET", "/v1/gate/stats")[0] == 404
    assert [t["name"] for t in serve.answer(spark, {"id": 1, "method": "tools/list"})["result"]["tools"]] == ["validate", "check", "diff", "explain", "drift"]
    text = BASE.format(version="1.0.0", strict="false", id="{type: string}", more="", policy="{}")
    got = serve.answer(spark, {"id": 2, "method": "tools/call", "params": {"name": "check", "arguments": {"contract": text, "records": [{"id": 1}]}}})
    assert json.loads(got["result"]["content"][0]["text"])["violations"] == 1
    assert serve.answer(spark, {"method": "x"}) is None and "error" in serve.answer(spark, {"id": 3, "method": "x"})
