import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake import ContractError, RecordGate, assert_conforms, check, check_all, load
from pactlake.operators.check import keyed
from pactlake.plans import rules as R
from pactlake.plans.spec import Field, Model

CONTRACT = """
contract: 1
id: orders
version: 1.2.0
owner: team
models:
  orders:
    strict: true
    fields:
      order_id: {type: string, required: true, unique: true, pattern: "^ord_[a-z0-9]{4}$"}
      amount: {type: integer, required: true, min: 0, max: 100}
      ratio: {type: float, min: 0, max: 1}
      currency: {type: string, allowed: [USD, EUR]}
      email: {type: string, format: email, nullable: true}
      site: {type: string, format: uri}
      created: {type: timestamp, required: true}
      day: {type: date}
      trace: {type: uuid}
      active: {type: boolean}
      note: {type: string, min_length: 2, max_length: 5}
"""
OK = {"order_id": "ord_ab12", "amount": 5, "created": "2026-08-11T09:30:00Z"}

#: (change to a good record, the violations it makes)
CASES = [
    ({}, []),
    ({"email": None}, []),
    ({"order_id": "ord_x"}, [("order_id", "pattern")]),
    ({"amount": 101}, [("amount", "max")]),
    ({"amount": -1}, [("amount", "min")]),
    ({"amount": 5.0}, [("amount", "type_mismatch")]),
    ({"amount": "5"}, [("amount", "type_mismatch")]),
    ({"amount": True}, [("amount", "type_mismatch")]),
    ({"amount": (1 << 64) - 1}, [("amount", "max")]),
    ({"amount": None}, [("amount", "null_not_allowed")]),
    ({"ratio": 1}, []),
    ({"ratio": 1.5}, [("ratio", "max")]),
    ({"ratio": "1"}, [("ratio", "type_mismatch")]),
    ({"currency": "GBP"}, [("currency", "allowed")]),
    ({"currency": None}, [("currency", "null_not_allowed")]),
    ({"email": "a@b.c"}, []),
    ({"email": "a@b@c.d"}, [("email", "format")]),
    ({"email": "a\u00a0b@c.de"}, [("email", "format")]),
    ({"email": "a@b"}, [("email", "format")]),
    ({"site": "mailto:x"}, []),
    ({"site": "1x:y"}, [("site", "format")]),
    ({"site": "http:"}, [("site", "format")]),
    ({"created": "2026-02-28T23:59:59.123456789+23:59"}, []),
    ({"created": "2026-02-29T00:00:00Z"}, [("created", "type_mismatch")]),
    ({"created": "2026-02-28"}, [("created", "type_mismatch")]),
    ({"created": "2026-02-28T24:00:00Z"}, [("created", "type_mismatch")]),
    ({"created": "2026-02-28T00:00:00"}, [("created", "type_mismatch")]),
    ({"day": "2024-02-29"}, []),
    ({"day": "2026-8-1"}, [("day", "type_mismatch")]),
    ({"day": "2026-08-01\n"}, [("day", "type_mismatch")]),
    ({"trace": "12345678-9ABC-def0-1234-56789abcdef0"}, []),
    ({"trace": "123456789abcdef0123456789abcdef0"}, [("trace", "type_mismatch")]),
    ({"active": False}, []),
    ({"active": "true"}, [("active", "type_mismatch")]),
    ({"note": "é\u0301"}, []),
    ({"note": "\U0001f600"}, [("note", "min_length")]),
    ({"note": "abcdef"}, [("note", "max_length")]),
    ({"note": {"a": 1}}, [("note", "type_mismatch")]),
    ({"note": ["a"]}, [("note", "type_mismatch")]),
    ({"extra": 1}, [("extra", "unexpected_field")]),
]


def rows_of(report):
    return {(f, r): n for f, r, n in report.per_rule}


def test_every_rule_on_records(spark):
    records = [{**OK, "order_id": f"ord_{k:04d}", **change} for k, (change, _) in enumerate(CASES)]
    report = check(spark, records, CONTRACT)
    want: dict = {}
    for _, found in CASES:
        for v in found:
            want[v] = want.get(v, 0) + 1
    assert rows_of(report) == want
    assert report.rows == len(CASES) and not report.passed
    by_row: dict = {}
    for s in report.samples:
        by_row.setdefault(s.row, []).append((s.field, s.rule))
    capped = {v for v, n in want.items() if n > 10}
    for k, (_, found) in enumerate(CASES):
        assert set(by_row.get(k, [])) >= {v for v in found if v not in capped and v[1] != "unexpected_field"}, k


def test_the_record_gate_gives_the_same_verdicts():
    c = load(CONTRACT)
    for k, (change, found) in enumerate(CASES):
        gate = RecordGate(c)
        gate.judge(json.dumps({**OK, "order_id": f"ord_{k:04d}", **change}, ensure_ascii=False))
        assert [(v["field"], v["rule"]) for v in gate.last[1]] == found, change


def test_missing_keys_unreadable_lines_and_row_numbers(spark, tmp_path):
    p = tmp_path / "x.ndjson"
    p.write_text('{"order_id":"ord_ab12","amount":5,"created":"2026-08-11T09:30:00Z"}\n\n  \n{"amount":1} x\n[1]\nnope\n{"order_id":"ord_ab13","amount":5,"amount":7}\n{"a":1},{}\n')
    report = check(spark, str(p), CONTRACT)
    assert report.rows == 6
    assert rows_of(report) == {(None, "record_not_object"): 4, ("created", "required_missing"): 1}
    assert sorted(s.row for s in report.samples if s.rule == "record_not_object") == [1, 2, 3, 5]


def test_row_numbers_across_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many.ndjson"
    folder.mkdir()
    for f in range(3):
        (folder / f"part-{f}.json").write_text("".join(json.dumps({**OK, "order_id": f"ord_{f}{k:03d}", "amount": 500 if k == 7 else 1}) + "\n" for k in range(20)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        report = check(spark, str(folder), CONTRACT)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [s.row for s in report.samples] == [7, 27, 47]


def test_uniqueness_counts_later_copies_only(spark):
    records = [{**OK, "order_id": i} for i in ("ord_aaaa", "ord_bbbb", "ord_aaaa", "ord_aaaa", "bad", "bad")]
    report = check(spark, records, CONTRACT)
    assert rows_of(report) == {("order_id", "unique"): 3, ("order_id", "pattern"): 2}
    assert [s.row for s in report.samples if s.rule == "unique"] == [2, 3, 5]


def test_budget_warning_and_samples(spark):
    many = [{**OK, "order_id": f"ord_{k:04d}", "amount": 500} for k in range(30)]
    policy = "policy: {max_violations: 30, sample_violations: 4}\n"
    report = check(spark, many, CONTRACT + policy)
    assert report.passed and report.violations == 30 and len(report.samples) == 4
    assert not check(spark, many + [dict(many[0], order_id="ord_zzzz")], CONTRACT + policy).passed
    assert check(spark, many, CONTRACT + "policy: {on_violation: warn}\n").passed
    with pytest.raises(AssertionError):
        assert_conforms(spark, many, CONTRACT)


def test_several_sources_share_a_budget_but_not_uniqueness(spark, tmp_path):
    paths = []
    for k in range(2):
        p = tmp_path / f"{k}.jsonl"
        p.write_text(json.dumps({**OK, "amount": 500}) + "\n")
        paths.append(str(p))
    reports, passed = check_all(spark, paths, CONTRACT + "policy: {max_violations: 1}\n")
    assert [r.violations for r in reports] == [1, 1] and not passed


COLUMNS = Model(
    {
        "i": Field("integer", required=True, min=1.5, max=1e300), "u": Field("integer", max=10), "f": Field("float", max=0.1), "d": Field("float", min=0, max=1, allowed=(0.0, 1.0)),
        "t": Field("timestamp", unique=True), "day": Field("date"), "s": Field("string", nullable=False), "gone": Field("string", required=True), "soft": Field("string"), "kind": Field("string"),
    },
    strict=True,
)


def test_columns(spark):
    schema = "i int, u decimal(20,0), f float, d double, t timestamp, day date, s string, kind array<int>, more int"
    now, today = datetime.datetime(2026, 1, 1), datetime.date(2026, 1, 1)
    from decimal import Decimal

    rows = [
        (1, Decimal(11), 0.1, float("nan"), now, today, None, None, 1),
        (2, Decimal((1 << 64) - 1), 0.2, -0.0, now, None, "x", None, 1),
        (None, None, None, 2.0, None, None, "x", None, 1),
    ]
    df = spark.createDataFrame(rows, schema)
    compiled = R.compile_columns(COLUMNS, df.schema)
    from pactlake.operators.check import counts_frame

    got = {(r["field"], r["rule"]): r["violations"] for r in counts_frame(df, compiled).collect()}
    assert {k: n for k, n in got.items() if n} == {
        ("i", "null_not_allowed"): 1, ("i", "min"): 1, ("u", "max"): 2, ("f", "max"): 1, ("d", "max"): 1, ("d", "allowed"): 2, ("t", "unique"): 1,
    }
    assert {(s.field, s.rule) for s in compiled.schema} == {("gone", "schema_missing_field"), ("kind", "schema_type_mismatch"), ("more", "unexpected_field")}


def test_parquet_batches_of_one_file_share_uniqueness_and_rows(spark, tmp_path):
    p = str(tmp_path / "x.parquet")
    spark.range(100).select(F.concat(F.lit("ord_"), F.lpad((F.col("id") % 99).cast("string"), 4, "0")).alias("order_id"), F.col("id").alias("amount"), F.lit("2026-08-11T09:30:00Z").alias("created")).coalesce(1).write.parquet(p)
    report = check(spark, p, CONTRACT)
    assert rows_of(report) == {("order_id", "unique"): 1} and report.samples[0].row == 99


def test_csv_cells(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("order_id,amount,created,active\nord_0001,5,2026-08-11T09:30:00Z,true\nord_0002, 5,2026-08-11T09:30:00Z,t\n,7,bad,\n")
    report = check(spark, str(p), CONTRACT)
    assert rows_of(report) == {("amount", "type_mismatch"): 1, ("active", "type_mismatch"): 1, ("order_id", "null_not_allowed"): 1, ("created", "type_mismatch"): 1}
    (tmp_path / "empty.csv").write_text("order_id,amount\n")
    assert rows_of(check(spark, str(tmp_path / "empty.csv"), CONTRACT)) == {("created", "schema_missing_field"): 1}


def test_unknown_formats_and_refused_contracts(spark, tmp_path):
    with pytest.raises(ValueError):
        check(spark, str(tmp_path / "x.txt"), CONTRACT)
    with pytest.raises(ContractError):
        check(spark, [OK], CONTRACT.replace("^ord_", "(?=x)"))
    with pytest.raises(ValueError):
        check(spark, [{"a": float("nan")}], CONTRACT)


def test_empty_frames(spark):
    df = spark.createDataFrame([], T.StructType().add("order_id", "string").add("amount", "long").add("created", "string"))
    report = check(spark, df, CONTRACT)
    assert report.rows == 0 and report.passed


def test_masked_samples(spark):
    s = check(spark, [{**OK, "currency": "GBP"}], CONTRACT).samples[0]
    assert s.observed["length"] == 3 and len(keyed(s, b"0123456789abcdef")) == 32
    with pytest.raises(ValueError):
        keyed(s, b"short")


def test_checks_are_one_scan_without_wide_shuffles(spark):
    df = spark.range(10).select(F.col("id").alias("i"), F.lit("x").alias("unused"))
    compiled = R.compile_columns(Model({"i": Field("integer", min=1, max=5)}), df.schema)
    from pactlake.operators.check import rule_counts

    plan = rule_counts(df, compiled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan
