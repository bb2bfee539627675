"""What the gate counts and remembers: statistics, keys of earlier batches, one line for one line, topics."""

import datetime
import io
import json

import pytest

from pactlake import cli
from pactlake.functions import shapes
from pactlake.plans.spec import parse
from pactlake.sources.read import ROW, read
from pactlake.streaming import gate, kafka, records

CONTRACT = "contract: 1\nid: g\nversion: 1.0.0\nowner: t\nmodels: {g: {fields: {k: {type: integer, required: true, max: 9, unique: true}, s: {type: string, max_length: 2}}}}\n"


def test_statistics_by_rule_latency_and_time():
    c, s = parse(CONTRACT), gate.GateStats()
    assert s.p99_micros() is None
    s.add({"records": 98, "passed": 90, "blocked": 8, "warned": 0, "violations": 9, "tombstones": 0}, {("k", "max"): 3, ("s", "max_length"): 6}, 98e-6, now=100)
    s.add({"records": 2, "passed": 2, "blocked": 0, "warned": 0, "violations": 0, "tombstones": 1}, {}, 2.0, now=104)
    s.add({"records": 0, "passed": 0, "blocked": 0, "warned": 0, "violations": 0, "tombstones": 0}, {}, 5.0, now=115)
    told = s.snapshot(c, "g")
    assert told["per_rule"] == [{"field": "s", "rule": "max_length", "count": 6}, {"field": "k", "rule": "max", "count": 3}]
    assert told["recent"] == [{"records": 100, "blocked": 8}] and told["records"] == 100 and told["tombstones"] == 1
    assert told["p99_validate_micros"] >= 1e6 and s.failed(c)  # of 100 records two took a second each
    for k in range(60):
        s.add({"records": 1}, {}, 1e-6, now=1000 + 10 * k)
    assert len(s.recent) == gate.RECENT_BUCKETS and s.p99_micros() >= 1e6


def test_statistics_that_cannot_be_written_stop_nothing(tmp_path, capsys):
    assert gate.write_stats(str(tmp_path / "no" / "s.json"), {}) is None and "warning" in capsys.readouterr().err
    assert gate.write_stats(str(tmp_path / "s.json"), {"a": 1}) and json.loads((tmp_path / "s.json").read_text()) == {"a": 1}


def test_seen_keys_are_compacted_and_failed_attempts_do_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gate.SeenKeys, "COMPACT", 3)
    seen = gate.SeenKeys(spark, str(tmp_path / "seen"))
    frame = lambda ks: spark.createDataFrame([("k", str(k)) for k in ks], "field string, key string")
    asked = frame(range(40))
    assert seen.before(0, asked) is None
    for n in range(12):
        got = seen.before(n, asked)
        assert got is None or sorted(int(r["key"]) for r in got.collect()) == list(range(2 * n))
        seen.add(n, frame([99]))  # an attempt that failed later on
        assert sorted(int(r["key"]) for r in (seen.before(n, asked) or frame([])).collect()) == list(range(2 * n))
        seen.add(n, frame([2 * n, 2 * n + 1]))
    assert len(list((tmp_path / "seen").iterdir())) <= 5
    assert [r["key"] for r in seen.before(12, frame([3])).where("key = '3'").collect()] == ["3"]


SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, headers array<struct<key: string, value: binary>>"


def test_topics_remember_keys_and_fail_over_budget(spark, tmp_path):
    rows = lambda at, ks: spark.createDataFrame(
        [(b"a", bytearray(f'{{"k":{k}}}'.encode()), "in", 0, at + i, datetime.datetime(2026, 1, 1), None) for i, k in enumerate(ks)], SCHEMA
    )
    c = parse(CONTRACT)
    run = lambda: kafka.gate(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), c, str(tmp_path / "topics"), "ok", "dead", str(tmp_path / "check"), unique=gate.TRACK, sink="parquet")
    rows(0, [1, 2, 1]).coalesce(1).write.parquet(str(tmp_path / "in"))
    query, stats = run()
    query.awaitTermination()
    assert (stats.records, stats.passed, stats.blocked) == (3, 2, 1) and stats.failed(c)
    rows(3, [2, 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query, stats = run()
    query.awaitTermination()
    assert (stats.records, stats.passed, stats.per_rule) == (2, 1, {("k", "unique"): 1})
    out = spark.read.parquet(str(tmp_path / "topics")).collect()
    assert sorted(bytes(r["value"]) for r in out if r["topic"] == "ok") == [b'{"k":1}', b'{"k":2}', b'{"k":3}']
    assert [json.loads(r["value"])["violations"][0]["rule"] for r in out if r["topic"] == "dead"] == ["unique", "unique"]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_a_batch_that_fails_between_two_topics_sends_nothing_twice(spark, tmp_path, monkeypatch):
    values = [b'{"k":1}', b'{"k":10}', b'{"k":2}', b'{"k":1}']
    data = [(b"a", bytearray(v), "in", i % 2, i, datetime.datetime(2026, 1, 1), None) for i, v in enumerate(values)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: kafka.gate(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), parse(CONTRACT), str(tmp_path / "topics"), "ok", "dead", str(tmp_path / "check"), unique=gate.TRACK, sink="parquet")
    send = kafka.send

    def fails(rows, brokers, sink):
        if rows.select("topic").where("topic = 'dead'").count():
            raise RuntimeError("the broker is gone")
        send(rows, brokers, sink)

    monkeypatch.setattr(kafka, "send", fails)
    query, _ = run()
    with pytest.raises(Exception, match="broker"):
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "topics")).count() == 2
    monkeypatch.setattr(kafka, "send", send)
    query, stats = run()
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "topics")).collect()
    assert sorted(bytes(r["value"]) for r in out if r["topic"] == "ok") == [b'{"k":1}', b'{"k":2}']
    assert sorted(json.loads(r["value"])["violations"][0]["rule"] for r in out if r["topic"] == "dead") == ["max", "unique"]
    assert (stats.records, stats.passed, stats.blocked) == (4, 2, 2) and stats.per_rule == {("k", "max"): 1, ("k", "unique"): 1}


def test_marks_of_earlier_batches_go(spark, tmp_path):
    marks = kafka.SentMarks(spark, str(tmp_path / "sent"))
    rows = spark.createDataFrame([("t", 0, 5), ("t", 1, 7)], "topic string, partition int, offset long")
    marks.sent(3, "clean", rows.where("partition = 0"))
    assert [tuple(r) for r in marks.unsent(3, "clean", rows).collect()] == [("t", 1, 7)] and marks.unsent(3, "dead", rows).count() == 2
    marks.forget_before(4)
    assert marks.unsent(3, "clean", rows).count() == 2


def test_work_of_a_batch_depends_on_its_keys(spark, tmp_path, monkeypatch):
    """Over 200 batches: what a batch of three keys reads doesn't grow with the keys seen, and none is forgotten."""
    monkeypatch.setattr(gate.SeenKeys, "BUCKET_KEYS", 16)
    monkeypatch.setattr(gate.SeenKeys, "COMPACT", 6)
    seen = gate.SeenKeys(spark, str(tmp_path / "seen"))
    frame = lambda ks: spark.createDataFrame([("k", str(k)) for k in ks], "field string, key string").coalesce(1)
    read = {}
    for n in range(200):
        seen._compact(n)
        if n % 40 == 39:
            asked = seen._hashed(frame([5 * n, 5, -n]))
            read[n] = seen.of_buckets(n, asked).count()
            assert sorted(r["key"] for r in seen.before(n, frame([0, 60 * (n - 1) + 1, 60 * n, -n])).collect()) == sorted(["0", str(60 * (n - 1) + 1)])
        seen.add(n, frame(range(60 * n, 60 * n + 60)))
    assert read[199] < 900 < 12_000 and read[199] < 2 * max(read[39], read[79])
    assert len(seen._runs()) <= 4 * 6


def test_observed_counters_are_the_batch_s(spark, tmp_path):
    c = parse(CONTRACT.replace("models: {g: {fields", "models: {g: {strict: true, fields"))
    lines = ['{"k":1}', '{"k":10,"x":1,"y":2}', "no", '{"k":null,"s":"long"}', None, '{"k":1}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    judged = gate.judge(df, c, unique=gate.SKIP)
    counts, rules = gate.batch_counts(judged, c.model(None)[1])
    assert counts == {"records": 6, "passed": 3, "blocked": 3, "warned": 0, "violations": 6, "tombstones": 1}
    assert rules == {("k", "max"): 1, ("", "unexpected_field"): 2, ("", "record_not_object"): 1, ("k", "null_not_allowed"): 1, ("s", "max_length"): 1}


def test_one_line_for_one_line(monkeypatch):
    monkeypatch.setattr(records, "MAX_BYTES", 40)
    lines = [b'{"k":1}\n', b"\n", b'{ "k":2 }\r\n', b'{"k":1}\n', b"\xff\n", b'{"k":3,"s":"' + b"x" * 90 + b'"}\n', b'{"k":4}']
    out, held, dlq = io.BytesIO(), io.BytesIO(), io.BytesIO()
    one = records.RecordGate(parse(CONTRACT), None, "track")
    records.answer_lines(one, io.BytesIO(b"".join(lines)), out, held, dlq)
    assert out.getvalue().split(b"\n") == [b'{"k":1}', b"", b'{ "k":2 }', b'{"k":4}', b""]
    letters = [json.loads(x) for x in held.getvalue().splitlines()]
    assert [x["violations"][0]["rule"] for x in letters] == ["unique", "record_not_object", "record_not_object"] and held.getvalue() == dlq.getvalue()
    assert letters[1]["record"] == "\ufffd" and letters[2]["record"].startswith('{"k":3') and one.failed()


def test_the_command_answers_lines(tmp_path, monkeypatch, capsysbinary):
    (tmp_path / "c.yaml").write_text(CONTRACT)
    for text, code in (('{"k":1}\n', 0), ('{"k":1}\n{"k":77}\n', 1)):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
        assert cli.main(["gate", "-", "-c", str(tmp_path / "c.yaml")]) == code
        got = capsysbinary.readouterr()
        assert got.out == b'{"k":1}\n' and (b'"max"' in got.err) == bool(code)
    assert cli.main(["gate", "somewhere", "-c", str(tmp_path / "c.yaml")]) == 2


EMAILS = ["a@b.c", "a@b", "a@@b.c", "@b.c", "a@.b.c", "a@b.c.", "a b@c.d", "a@b.c\n", "a@b..c", "", "@", "a@", ".@b.c", "\u00e9@\u00fc.de", "a@b\u2003.c"]


@pytest.mark.parametrize("kind", ["email", "uri"])
def test_formats_of_both_lanes(spark, kind):
    rows = spark.createDataFrame([(x,) for x in [*EMAILS, "http:x", "9p:x", "a+b:y z", "a:"]], "t string")
    for r in rows.select("t", shapes.FORMATS[kind](rows["t"]).alias("ok")).collect():
        assert r["ok"] == shapes.fits_format(kind, r["t"]), r["t"]
    assert [x for x in EMAILS if shapes.fits_format("email", x)] == ["a@b.c", "a@b..c", ".@b.c", "\u00e9@\u00fc.de"]


def test_cells_with_line_breaks_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"two\nlines"\n2,"a ""quoted"" word"\n')
    assert [r["t"] for r in read(spark, str(tmp_path / "a.csv")).frame.orderBy("k").collect()] == ["two\nlines", 'a "quoted" word']
    (tmp_path / "b.csv").write_text('k,t\n1,"x"\n')
    assert read(spark, str(tmp_path / "b.csv")).frame.count() == 1


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "in.ndjson"
    folder.mkdir()
    for f in range(4):
        (folder / f"{f}.txt").write_text("".join(f'{{"n":{100 * f + k}}}\n' + "\n" * (k % 3) for k in range(100)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        rows = read(spark, str(folder), rows=True).frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r[ROW], json.loads(r["__line"])["n"]) for r in rows) == [(k, k) for k in range(400)]
