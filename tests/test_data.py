"""Profiles, drift, inference and gates."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pactlake import ContractError, check, infer, register_functions
from pactlake.functions import buckets
from pactlake.operators import drift as D
from pactlake.operators import profile as P
from pactlake.plans.spec import parse
from pactlake.sources.read import Source
from pactlake.streaming import gate as G

EVENTS = parse("""
contract: 1
id: events
version: 1.0.0
owner: team
models:
  events:
    fields:
      id: {type: string, required: true}
      amount: {type: integer, nullable: true}
      score: {type: float}
      ok: {type: boolean}
      currency: {type: string, allowed: [USD, EUR]}
      at: {type: timestamp}
      day: {type: date}
""")


def records(n, shift=0, nulls=10, share=4):
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    return [
        {
            "id": f"e{i:05d}", "amount": None if i % nulls == 0 else (i * 37) % 1000 + shift, "score": (i % 17) * 0.25, "ok": i % 3 == 0,
            "currency": "EUR" if i % share == 0 else "USD", "at": (start + datetime.timedelta(seconds=60 * i)).isoformat().replace("+00:00", "Z"), "day": f"2026-01-{1 + i % 28:02d}",
        }
        for i in range(n)
    ]


def test_profiles_are_the_same_from_every_format(spark, tmp_path):
    rows = records(1500)
    (tmp_path / "x.ndjson").write_text("".join(json.dumps(r) + "\n" for r in rows))
    df = spark.read.json(str(tmp_path / "x.ndjson")).withColumn("at", F.to_timestamp("at")).withColumn("day", F.to_date("day"))
    df.write.parquet(str(tmp_path / "x.parquet"))
    a, b = (P.profile(spark, str(tmp_path / f"x.{e}"), EVENTS) for e in ("ndjson", "parquet"))
    assert a.rows == b.rows == 1500 and a.fields["amount"].nulls == b.fields["amount"].nulls == 150
    for f in ("amount", "score"):
        assert a.fields[f].numbers == b.fields[f].numbers and a.fields[f].histogram == b.fields[f].histogram
    assert a.fields["currency"].categories == b.fields["currency"].categories == {"USD": 1125, "EUR": 375}
    assert a.fields["ok"].categories["true"] == 500 and a.fields["id"].lengths == b.fields["id"].lengths
    assert a.fields["day"].span == b.fields["day"].span == ["2026-01-01", "2026-01-28"]
    assert abs(a.fields["id"].distinct - 1500) < 75
    assert P.Profile.parse(a.to_json()) == a and "1,500 rows" in P.summary(a)


def test_merging_is_adding(spark):
    rows = records(900)
    whole = P.profile(spark, rows, EVENTS)
    parts = [P.profile(spark, rows[k::3], EVENTS) for k in range(3)]
    for order in ((0, 1, 2), (2, 0, 1)):
        m = P.merge(spark, P.merge(spark, parts[order[0]], parts[order[1]]), parts[order[2]])
        assert m.runs == 3 and m.rows == 900
        for f, p in whole.fields.items():
            q = m.fields[f]
            assert (p.histogram, p.categories, p.span, p.nulls, p.numbers, p.lengths) == (q.histogram, q.categories, q.span, q.nulls, q.numbers, q.lengths)
            assert abs(p.distinct - q.distinct) <= 0.02 * p.distinct
    other = P.Profile("else", "1.0.0", "events", 1, 0)
    with pytest.raises(ContractError):
        P.merge(spark, whole, other)


def test_buckets_and_quantiles(spark):
    random.seed(1)
    xs = [0.0, -0.0, 5e-324, 1.7e308, -2.5, 1.0, 2.0, 0.1, 2.2250738585072014e-308] + [random.choice([-1, 1]) * 10 ** random.uniform(-300, 300) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", buckets.bucket(F.col("x")).alias("b")).collect()
    import struct

    for r in rows:
        bits = struct.unpack(">Q", struct.pack(">d", abs(r["x"])))[0]
        assert r["b"] == bits >> 46, r
        if abs(r["x"]) > 1e-300:
            assert abs(buckets.middle(r["b"]) / abs(r["x"]) - 1) <= 1 / 128
    p = P.profile(spark, [{"id": "a", "score": float(k)} for k in range(1, 1001)], EVENTS).fields["score"]
    assert abs(P.quantile(p.histogram, 0.5) / 500 - 1) < 0.01 and abs(P.cdf(p.histogram, 250.0) - 0.25) < 0.02
    assert len(P.fold({f"1:{k}": 1 for k in range(5000)})) == buckets.MAX_BUCKETS


def test_drift(spark):
    base = P.profile(spark, records(1000), EVENTS)
    metrics = lambda p: {(f.field, f.metric) for f in D.drift(base, p).findings}
    assert D.drift(base, base).stable
    assert metrics(P.profile(spark, records(1000, shift=2000), EVENTS)) == {("amount", "distribution")}
    assert metrics(P.profile(spark, records(1000, nulls=3), EVENTS)) == {("amount", "null_rate")}
    assert metrics(P.profile(spark, records(1000, share=2), EVENTS)) == {("currency", "categories")}
    assert (None, "volume") in metrics(P.profile(spark, records(300), EVENTS))
    few = D.drift(base, P.profile(spark, records(50), EVENTS))
    assert dict(few.not_compared)["score"].startswith("fewer")
    repeats = P.profile(spark, [dict(r, id=f"e{k % 50:05d}") for k, r in enumerate(records(1000))], EVENTS)
    assert ("id", "distinct") in metrics(repeats)


def test_psi_and_distance_by_hand():
    p = lambda shares: P.FieldProfile("string", categories=shares)
    assert D.jensen_shannon(p({"a": 1}), p({"b": 1}))[0] == pytest.approx(1.0)
    assert D.jensen_shannon(p({"a": 3, "b": 1}), p({"a": 6, "b": 2}))[0] == 0
    same = {f"1:{65000 + k}": 10 for k in range(20)}
    assert D.psi(same, same)[0] == 0
    moved = {"1:66000": 200}
    deciles, floor = [0.1] * 9 + [0.1], 1e-4
    assert D.psi(same, moved)[0] == pytest.approx(sum((q - p_) * math.log(q / p_) for p_, q in zip(deciles, [floor] * 9 + [1.0], strict=True)))


def test_drafts_accept_their_sample(spark, tmp_path):
    rows = []
    for i in range(40):
        r = {"order_id": f"ord_{i:06d}", "email": f"u{i}@x.org", "amount": i * 1.5, "status": ["new", "paid", "sent"][i % 3], "trace": f"12345678-1234-1234-1234-{i:012d}",
             "created_at": "2026-01-01T00:00:00Z", "note": None if i % 5 == 0 else "n" * (i + 1), "we:ird \"name\"": True}
        if i % 8:
            r["qty"] = i
        rows.append(r)
    d = infer(spark, rows, id="orders", model="orders")
    f = d.contract.models["orders"].fields
    assert list(f)[:3] == ["order_id", "email", "amount"]
    assert {k: x.type for k, x in f.items()} == {"order_id": "string", "email": "string", "amount": "float", "status": "string", "trace": "uuid", "created_at": "timestamp", "note": "string", "we:ird \"name\"": "boolean", "qty": "integer"}
    assert f["order_id"].pattern == "^ord_[0-9]{6}$" and f["email"].format == "email" and f["status"].allowed == ("new", "paid", "sent")
    assert not f["qty"].required and f["note"].nullable and (f["amount"].min, f["amount"].max) == (0, 58.5) and not d.contract.models["orders"].strict
    assert check(spark, rows, d.to_yaml()).passed
    assert infer(spark, rows, sample=10, ranges=False).truncated
    with pytest.raises(ValueError):
        infer(spark, [])


GATE = """
contract: 1
id: g
version: 1.0.0
owner: team
models:
  g:
    strict: true
    fields:
      k: {type: integer, required: true, max: 9, unique: true}
"""
LINES = ['{"k":1}', '{"k":2}', '{"k":1}', "nope", '{"k":99}', '{"k":3,"x":1}', '{ "k" : 4 }', '{"k":2}']


def read_lines(folder):
    return sorted(p.strip("\n") for f in sorted(folder.rglob("part-*")) if f.suffix == ".txt" for p in f.read_text().splitlines())


@pytest.mark.parametrize("warn", [False, True])
def test_the_stream_routes_and_remembers(spark, tmp_path, warn):
    c = parse(GATE + ("policy: {on_violation: warn}\n" if warn else ""))
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: G.gate(spark.readStream.text(str(source)), c, str(tmp_path / "clean"), str(tmp_path / "dead"), str(tmp_path / "check"), unique=G.TRACK, stats=str(tmp_path / "s.json"))
    (source / "a.txt").write_text("\n".join(LINES[:4]) + "\n")
    query, stats = run()
    query.awaitTermination()
    assert (stats.records, stats.blocked, stats.warned) == ((4, 0, 2) if warn else (4, 2, 0)) and stats.failed(c) != warn
    (source / "b.txt").write_text("\n".join(LINES[4:]) + "\n")
    query, stats = run()
    query.awaitTermination()
    assert stats.records == 4 and json.loads((tmp_path / "s.json").read_text())["records"] == 4
    clean, dead = read_lines(tmp_path / "clean"), [json.loads(x) for x in read_lines(tmp_path / "dead")]
    assert clean == (sorted(LINES) if warn else sorted(['{"k":1}', '{"k":2}', '{ "k" : 4 }']))
    assert sorted(d["record"] for d in dead) == sorted(['{"k":1}', "nope", '{"k":99}', '{"k":3,"x":1}', '{"k":2}'])
    assert {v["rule"] for d in dead for v in d["violations"]} == {"unique", "record_not_object", "max", "unexpected_field"}
    letters, skipped = G.newest_dead_letters(spark, str(tmp_path / "dead"), 2)
    assert len(letters) == 2 and skipped == 0


def test_tombstones_bytes_and_oversize(spark):
    c = parse(GATE.replace(", unique: true", ""))
    big = b'{"k":1,"x":"' + b"a" * (16 << 20) + b'"}'
    df = spark.createDataFrame([(0, None), (1, bytearray(b'{"k":1}')), (2, bytearray(b'\xff{"k":1}')), (3, bytearray(big))], "n int, value binary")
    got = {r["n"]: (r["verdict"], [v["rule"] for v in r["violations"]]) for r in G.judge(df, c).collect()}
    assert got == {0: ("pass", []), 1: ("pass", []), 2: ("block", ["record_not_object"]), 3: ("block", ["record_not_object"])}
    letter = json.loads(G.judge(df.where("n = 3"), c).select(G.envelope(c, "g").alias("e")).first()["e"])
    assert len(letter["record"]) == G.PREVIEW_BYTES


def test_unique_needs_a_decision_and_sql_functions(spark):
    c = parse(GATE)
    with pytest.raises(ContractError):
        G.judge(spark.createDataFrame([("{}",)], "value string"), c)
    with pytest.raises(ContractError):
        register_functions(spark, c)
    register_functions(spark, c, unique=G.SKIP, prefix="g")
    rows = spark.createDataFrame([(x,) for x in [*LINES, None]], "value string").selectExpr("value", "g_verdict(value) v", "g_dead_letter(value) d").collect()
    assert [r["v"] for r in rows] == ["pass", "pass", "pass", "block", "block", "block", "pass", "pass", None]
    assert json.loads(rows[3]["d"])["violations"][0]["rule"] == "record_not_object" and rows[0]["d"] is None


def test_a_source_of_columns_has_profiles_too(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", float("nan")), ("c", float("inf")), (None, None)], "id string, score float")
    p = P.profile_source(spark, Source(df, "columns", "x"), EVENTS)
    assert p.fields["score"].non_finite == 2 and p.fields["score"].numbers == {"count": 1, "min": 0.1, "max": 0.1, "sum": 0.1} and p.fields["id"].nulls == 1


def test_five_hundred_profiles_merge_in_one_aggregate(spark, tmp_path):
    from pactlake.operators import profile as P
    from pactlake.operators import profile_table as PT
    from pactlake.sources.read import Source

    c = parse("contract: 1\nid: p\nversion: 1.0.0\nmodels: {m: {fields: {n: {type: integer}, s: {type: string, allowed: [a, b]}, d: {type: date}, x: {type: float}}}}")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 9).cast("int"))
    df = spark.range(2000).select((F.col("id") % 500).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") - 50).alias("n"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("s"), day.alias("d"), (F.col("id") / 8).alias("x"))
    whole = P.profile_source(spark, Source(df.drop("g"), "columns", "t"), c)
    merged = PT.to_profile(PT.merge(PT.of_groups(Source(df, "columns", "t"), c, "g")), "p", "1.0.0", "m", 1)
    for name, f in whole.fields.items():  # a union keeps its registers in another form
        got = vars(merged.fields[name]) | {"sketch": None, "distinct": None}
        assert got == vars(f) | {"sketch": None, "distinct": None} and abs(merged.fields[name].distinct / f.distinct - 1) < 0.02
    half = [P.profile_source(spark, Source(df.where(w).drop("g"), "columns", "t"), c) for w in ("g < 100", "g >= 100")]
    for k in range(500):
        (tmp_path / f"{k}.json").write_text(half[k % 2].to_json())
    rows = PT.read_profiles(spark, str(tmp_path))
    assert rows.select("contract", "model", "version", "runs").distinct().count() == 1
    both = PT.to_profile(PT.merge(rows.drop("contract", "model", "version", "runs")), "p", "1.0.0", "m", 500)
    pair = P.merge(spark, *half)
    for name, f in pair.fields.items():
        got = both.fields[name]
        assert (got.rows, got.nulls, got.other) == (250 * f.rows, 250 * f.nulls, 250 * f.other) and abs(got.distinct / f.distinct - 1) < 0.02 and got.span == f.span
        assert got.histogram == (f.histogram and {k: 250 * n for k, n in f.histogram.items()})
        assert got.numbers == (f.numbers and {**f.numbers, "count": 250 * f.numbers["count"], "sum": 250 * f.numbers["sum"]})
    plan = PT.merge(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") <= 4  # two, each over one reading


def test_profile_rows_of_a_changed_type_are_refused(spark):
    from pactlake.operators import profile_table as PT

    rows = spark.createDataFrame([("f", k, "counter", "rows", 1, None, None, None, None, None, None) for k in ("string", "integer")], PT.ROWS)
    with pytest.raises(Exception, match="type changed"):
        PT.merge(rows).collect()


def test_rates_of_profiles_that_lack_a_field(spark):
    from pactlake.operators import profile_table as PT

    row = lambda f, item, n, part="counter": (f, "string", part, item, n, None, None, None, None, None, None)
    a = spark.createDataFrame([row("f", "rows", 10), row("f", "present", 10), row("f", "nulls", 5), row("g", "rows", 10), row("f", "a", 5, "category")], PT.ROWS)
    b = spark.createDataFrame([row("f", "rows", 4), row("f", "present", 2), row("f", "nulls", 0), row("f", "b", 2, "category")], PT.ROWS)
    got = {(r["field"], r["metric"]): (r["baseline"], r["current"], r["score"]) for r in PT.rates(a, b).collect()}
    assert got == {("f", "null_rate"): (0.5, 0.0, 0.5), ("f", "missing_rate"): (0.0, 0.5, 0.5), ("f", "invalid_rate"): (None, None, None), ("f", "categories"): (None, None, 1.0)}


def test_a_draft_reads_only_the_first_splits(spark, tmp_path):
    folder = tmp_path / "in.ndjson"
    folder.mkdir()
    for k in range(40):
        (folder / f"{k:02}.ndjson").write_text("".join(f'{{"n": {100 * k + j}}}\n\n' for j in range(100)))
    draft = infer(spark, str(folder), sample=250)
    f = next(iter(draft.contract.models.values())).fields["n"]
    assert (draft.sampled, draft.truncated, f.min, f.max) == (250, True, 0, 249)
    assert infer(spark, str(folder), sample=4000).truncated is False
    csv = tmp_path / "in.csv"
    csv.write_text('n,s\n' + "".join(f'{k},"a\n""{k}"""\n' for k in range(500)))
    draft = infer(spark, str(csv), sample=100)
    f = next(iter(draft.contract.models.values())).fields["n"]
    assert (draft.sampled, draft.truncated, f.type, f.max) == (100, True, "integer", 99)
    parquet = str(tmp_path / "in.parquet")
    spark.range(0, 1000, 1, 10).write.parquet(parquet)
    draft = infer(spark, parquet, sample=150)
    assert (draft.sampled, draft.truncated) == (150, True) and next(iter(draft.contract.models.values())).fields["id"].max == 149


def test_the_tail_of_dead_letters_reads_the_newest_batches(spark, tmp_path):
    dead = tmp_path / "dead"
    for k in range(30):
        (dead / f"batch={k}").mkdir(parents=True)
        (dead / f"batch={k}" / "part-0.txt").write_text("".join(f'{{"ts": "2026-01-01T00:{k:02}:0{j}Z", "n": {k}}}\n' for j in range(3)) + "no letter\n")
    letters, skipped = G.newest_dead_letters(spark, str(dead), 7)
    assert [x["n"] for x in letters] == [29, 29, 29, 28, 28, 28, 27] and skipped == 3
