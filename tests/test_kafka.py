"""Rows of a Kafka source through the gate, without a broker."""

import datetime
import json

from pactlake.plans.spec import parse
from pactlake.streaming import kafka

CONTRACT = parse("contract: 1\nid: g\nversion: 1.0.0\nowner: t\nmodels: {g: {fields: {k: {type: integer, required: true, max: 9}}}}\n")
SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, headers array<struct<key: string, value: binary>>"
NOW = datetime.datetime(2026, 1, 1)


def rows(spark):
    values = [b'{ "k": 1 }', b'{"k":10}', None, b"\xff", b'{"k":2}']
    data = [(b"a", None if v is None else bytearray(v), "in", k % 2, k, NOW, [("h", b"1")] if k == 0 else None) for k, v in enumerate(values)]
    return kafka.judged(spark.createDataFrame(data, SCHEMA), CONTRACT)


def test_clean_records_keep_their_bytes_key_headers_and_time(spark):
    got = kafka.clean(rows(spark), "out").collect()
    assert [None if r["value"] is None else bytes(r["value"]) for r in got] == [b'{ "k": 1 }', None, b'{"k":2}']
    assert got[0]["headers"][0]["key"] == "h" and got[0]["timestamp"] == NOW and {r["topic"] for r in got} == {"out"}


def test_dead_letters_name_their_origin(spark):
    got = kafka.dead_letters(rows(spark), CONTRACT, "dead").collect()
    assert [json.loads(r["value"])["violations"][0]["rule"] for r in got] == ["max", "record_not_object"]
    assert {h["key"]: bytes(h["value"]).decode() for h in got[0]["headers"]} == {"contract.source.topic": "in", "contract.source.partition": "1", "contract.source.offset": "1"}


def test_partitions_with_a_blocked_record_are_refused(spark):
    got = {r["partition"]: r["refused"] for r in kafka.refused_partitions(rows(spark)).collect()}
    assert got == {0: False, 1: True}
