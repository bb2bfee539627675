"""Patterns: rewritten, by sets of states and in every lane, the same answers in time that grows with the value."""

import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from pactlake.operators.check import check
from pactlake.functions import linear, patterns
from pactlake.plans import rules as R
from pactlake.plans.spec import Field, Model, parse
from pactlake.streaming import gate as G
from pactlake.streaming.records import RecordGate

#: Each with a long text that it finds and one that it doesn't.
LONG = [
    ("^(a|b)*$", "ab", "c"), ("^(a+)+$", "a", "b"), ("(x+x+)+y$", "x", "z"), (r"^([a-z]+\.)*[a-z]+$", "abc.d", "!"), (r"^(\w+\s?)*$", "word é ", "-"),
    ("^(a|ab|b)*$", "ab", "c"), ("a.*b.*c$", "abc", "d"), (r"\b(a|aa)+\b.$", "a", "aé"), ("(?i)^(k|ss|S)*$", "KsS", "1"), ("^(a{0,3}b?)*$", "aaab", "c"),
]


def values(piece, last, size):
    body = piece * (size // len(piece))
    good = {"(x+x+)+y$": body + "y", r"^([a-z]+\.)*[a-z]+$": body, r"\b(a|aa)+\b.$": body + "!"}
    return good, body + last


def test_against_another_matcher():
    random.seed(3)

    def some(depth):
        r = random.random()
        if depth == 0 or r < 0.35:
            return random.choice(["a", "b", "c", "[ab]", "[^a]", ".", r"\d", "[b-d1]", r"\w", "a?", "b*", "c+", r"[^\W\d]"])
        if r < 0.6:
            return some(depth - 1) + some(depth - 1)
        if r < 0.75:
            return f"({some(depth - 1)}|{some(depth - 1)})"
        if r < 0.9:
            return f"({some(depth - 1)}){random.choice(['*', '+', '?', '{0,2}', '{2}', '{1,}'])}"
        return random.choice(["^", "$", r"\b", ""]) + some(depth - 1)

    tried = 0
    while tried < 2500:
        p = random.choice(["", "^"]) + some(4) + random.choice(["", "$"])
        if patterns.check(p):
            continue
        tried += 1
        plan = linear.plan(p)
        states, rewritten, plain = linear.StateSets(plan.tree), regex.compile(plan.python, regex.V1), re.compile(p.replace("$", r"\Z"))
        for _ in range(10):
            x = "".join(random.choice("abcd1 \n") for _ in range(random.randint(0, 9)))
            want = plain.search(x) is not None
            assert (states.search(x), rewritten.search(x) is not None) == (want, want), (p, plan.java, x)


def test_java_reads_the_rewritten_pattern_alike(spark):
    found = [p for p, _, _ in LONG] + ["#0+[0-9]*7$", "^[a-z]+(-[a-z0-9]+)*$", "([^a]|b)+c", "(a|.)b", r"^[^@]+@[^@]+\.[a-z]+$", "(?s)a.b", "x(?i)y", "(|a)b$", "[a|b]c", r"\x{e9}+", "(ab){2,3}c?$"]
    random.seed(4)
    texts = sorted({"".join(random.choice("abcxy7#0-@.\n éK1sS") for _ in range(random.randint(0, 12))) for _ in range(300)} | {"#0071237", "ab-c", "a@b.c", "abab", "xY", "A\nb"})
    frame = spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1)
    got = frame.select("x", *[F.col("x").rlike(linear.plan(p).java).alias(f"p{k}") for k, p in enumerate(found)]).collect()
    for r in got:
        for k, p in enumerate(found):
            states = linear.StateSets(linear.plan(p).tree)
            assert r[f"p{k}"] == states.search(r["x"]) == linear.searcher(p)(r["x"]), (p, r["x"])


@pytest.mark.parametrize(("pattern", "piece", "last"), LONG)
def test_long_values_in_every_lane(spark, pattern, piece, last):
    special, bad = values(piece, last, 1_000_000)
    good = special.get(pattern, piece * (1_000_000 // len(piece)))
    contract = parse("contract: 1\nid: p\nversion: 1.0.0\nmodels: {t: {fields: {v: {type: string}}}}")
    model = Model({"v": Field(type="string", pattern=pattern)})
    contract.models["t"] = model
    began = time.perf_counter()
    frame = spark.createDataFrame([(good,), (bad,), (None,)], "v string").coalesce(1)
    assert [(f, r, n) for f, r, n in check(spark, frame, contract, samples=False).per_rule] == [("v", "pattern", 1)]
    lines = frame.where("v IS NOT NULL").select(F.to_json(F.struct("v")).alias("value"))
    verdicts = [r["verdict"] for r in G.judge(lines, contract).select("verdict").collect()]
    assert verdicts == ["pass", "block"]
    gate = RecordGate(contract)
    assert [gate.judge('{"v": "%s"}' % x) for x in (good, bad)] == verdicts  # noqa: UP031
    G.register_functions(spark, contract, prefix="long")
    assert [r[0] for r in lines.selectExpr("long_verdict(value)").collect()] == verdicts
    told = lines.selectExpr("long_judge(value) AS j", "long_judge(NULL) AS n").select("j.*", "n.verdict").collect()
    assert [(r[0], r[1] is None, r[2]) for r in told] == [("pass", True, None), ("block", False, None)]
    assert time.perf_counter() - began < 60


def test_what_stays_in_java():
    assert linear.plan("^ord_[a-z0-9]{12}$").limit is None and linear.plan(r"^[a-z0-9]+(-[a-z0-9]+)*$").limit is None
    assert linear.plan("^(a|b)*$").limit is None and "[ab]*+" in linear.plan("^(a|b)*$").java
    assert linear.plan(r"^(\w+\s?)*$").limit == 0 and 0 < linear.plan("foo.*bar").limit <= 8192


def test_counts_that_are_too_large():
    assert "large" in linear.check("(a{1000}){1000}(b|c)*") and "large" in linear.check("((a|ab){1000}){1000}c")
    assert linear.check("^((a|ab){100}){100}c$") is None
    find = linear.searcher("^((a|ab){100}){100}c$")
    assert find("a" * 10_000 + "c") and find("ab" * 10_000 + "c") and not find("a" * 9_999 + "c")


def test_no_python_where_java_does(spark):
    m = Model({"s": Field(type="string", pattern=r"^[a-z0-9]+(-[a-z0-9]+)*$")})
    df = spark.createDataFrame([("a-b",), ("-",)], "s string")
    broken = R.compile_columns(m, df.schema).rules[0].broken
    assert "ArrowEvalPython" not in df.where(broken)._jdf.queryExecution().executedPlan().toString()
