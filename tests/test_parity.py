"""Random records through both evaluators of the rules: column expressions and one record at a time."""

import json
import random

from pyspark.sql import functions as F

from pactlake import RecordGate
from pactlake.plans.spec import parse
from pactlake.streaming import gate as G

CONTRACT = parse("""
contract: 1
id: p
version: 1.0.0
owner: team
models:
  p:
    strict: true
    fields:
      s: {type: string, required: true, min_length: 1, max_length: 6, pattern: "[a-c]$"}
      e: {type: string, format: email, nullable: true}
      u: {type: string, format: uri}
      i: {type: integer, min: -2.5, max: 7.5}
      n: {type: integer, allowed: [1, 2, 3]}
      f: {type: float, min: -1, max: 1.5, allowed: [-1, 0, 0.5, 2]}
      b: {type: boolean, required: true}
      t: {type: timestamp}
      d: {type: date}
      x: {type: uuid, nullable: true}
      "odd name.with 'dots": {type: string}
""")
VALUES = [
    None, True, False, 0, 1, 2, 3, -2, -3, 8, 7, 0.5, -1.0, 1.5, 2.0, 1e300, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, -(1 << 63), "", "a", "abc\n", "ab c", "é", "\U0001f600\U0001f600", "a@b.c",
    "a@b.c ", "@b.c", "a@.c", "a@b..c", "x:y", "x:", "1:y", "h+t.p-1://z", "2024-02-29", "2023-02-29", "2024-02-29T00:00:00Z", "2024-02-29T23:59:59.1-23:59", "2024-02-29T00:00:60Z",
    "2024-02-29 00:00:00Z", "0001-01-01", "12345678-1234-1234-1234-123456789abc", "12345678-1234-1234-1234-123456789abg", [], [1], {}, {"a": None}, "null", "1",
]


def test_the_same_violations_in_the_same_order(spark):
    random.seed(11)
    names = [*CONTRACT.models["p"].fields, "more", "S"]
    records = [{n: random.choice(VALUES) for n in random.sample(names, random.randint(0, len(names)))} for _ in range(1500)]
    lines = [json.dumps(r, ensure_ascii=random.random() < 0.5) for r in records]
    lines += ["", " ", "{", "[]", "null", "1", '"x"', "{} {}", "{},{}", '{"s":"a","s":"abcb"}', "{'s':'a'}", '{"s":NaN}', '{"s":1e5}', '{"i":01}', '{"s":"a",}', "{}x", "// {}"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    got = {r["n"]: (r["verdict"], [(v["field"], v["rule"]) for v in r["violations"]]) for r in G.judge(df, CONTRACT, unique=G.SKIP).select("n", "verdict", F.col("violations")).collect()}
    gate = RecordGate(CONTRACT, unique="skip")
    for k, line in enumerate(lines):
        verdict = gate.judge(line)
        assert got[k][0] == verdict, line
        assert sorted(got[k][1], key=str) == sorted(((v["field"], v["rule"]) for v in gate.last[1]), key=str), line
