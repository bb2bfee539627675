"""Every query of the core by name, with the DuckDB SQL that must give the same rows.

Each query goes through the library's own operators over whole tables.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import buckets, shapes
from ..operators import check as C
from ..operators import diff as D
from ..operators import profile as P
from ..sources.read import LINE, ROW, Source, read, records
from ..streaming import gate as G
from ..streaming import kafka as K
from . import rules as R
from .spec import Contract, DatasetRule, Field, Model, Version, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _model(**fields: dict) -> Model:
    return Model({k: Field(**v) for k, v in fields.items()})


def _counts(df: DataFrame, m: Model) -> DataFrame:
    return C.counts_frame(df, R.compile_columns(m, df.schema))


def _union(*rows: tuple[str, str, str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, '{r}' AS rule, CAST({e} AS BIGINT) AS violations FROM {table}" for f, r, e in rows)


def _where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


# --- checks ----------------------------------------------------------------

ORDERS = _model(
    o_orderkey={"type": "integer", "required": True, "unique": True, "min": 1},
    o_orderstatus={"type": "string", "allowed": ("F", "O")},
    o_totalprice={"type": "float", "min": 2000, "max": 400000},
    o_orderpriority={"type": "string", "pattern": "^[1-3]-"},
    o_orderdate={"type": "timestamp", "required": True},
)


@query(_union(
    ("o_orderkey", "null_not_allowed", _where("o_orderkey IS NULL")), ("o_orderkey", "min", _where("o_orderkey < 1")),
    ("o_orderkey", "unique", "count(o_orderkey) - count(DISTINCT o_orderkey)"), ("o_orderstatus", "allowed", _where("o_orderstatus NOT IN ('F','O')")),
    ("o_totalprice", "min", _where("o_totalprice < 2000")), ("o_totalprice", "max", _where("o_totalprice > 400000")),
    ("o_orderpriority", "pattern", _where("NOT regexp_matches(o_orderpriority, '^[1-3]-')")), ("o_orderdate", "null_not_allowed", _where("o_orderdate IS NULL")),
    table="orders"))
def check_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, bounds, set, pattern and uniqueness of orders: exact violations by field and rule."""
    return _counts(_table(spark, sf_dir, "orders"), ORDERS)


LINEITEM = _model(
    l_quantity={"type": "float", "min": 2, "max": 49},
    l_discount={"type": "float", "allowed": (0.0, 0.01, 0.02, 0.03, 0.04, 0.05)},
    l_tax={"type": "float", "max": 0.07},
    l_linenumber={"type": "integer", "min": 1.5, "max": 6.5},
    l_extendedprice={"type": "float", "required": True, "min": 1000.5},
    l_returnflag={"type": "string", "allowed": ("A", "N")},
)


@query(_union(
    ("l_quantity", "min", _where("l_quantity < 2")), ("l_quantity", "max", _where("l_quantity > 49")),
    ("l_discount", "allowed", _where("l_discount NOT IN (0.0::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.03::DOUBLE, 0.04::DOUBLE, 0.05::DOUBLE)")),
    ("l_tax", "max", _where("l_tax > 0.07::DOUBLE")), ("l_linenumber", "min", _where("l_linenumber < 2")), ("l_linenumber", "max", _where("l_linenumber > 6")),
    ("l_extendedprice", "null_not_allowed", _where("l_extendedprice IS NULL")), ("l_extendedprice", "min", _where("l_extendedprice < 1000.5::DOUBLE")),
    ("l_returnflag", "allowed", _where("l_returnflag NOT IN ('A','N')")), table="lineitem"))
def check_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and sets of numbers: integers are compared as integers, with fractional bounds."""
    return _counts(_table(spark, sf_dir, "lineitem"), LINEITEM)


CUSTOMER = _model(
    c_name={"type": "string", "required": True, "min_length": 18, "max_length": 18, "pattern": "#0+[0-9]*7$"},
    c_mktsegment={"type": "string", "allowed": ("BUILDING", "MACHINERY"), "max_length": 9},
    c_acctbal={"type": "float", "min": 0},
)


@query(_union(
    ("c_name", "null_not_allowed", _where("c_name IS NULL")), ("c_name", "min_length", _where("length(c_name) < 18")), ("c_name", "max_length", _where("length(c_name) > 18")),
    ("c_name", "pattern", _where("NOT regexp_matches(c_name, '#0+[0-9]*7$')")), ("c_mktsegment", "max_length", _where("length(c_mktsegment) > 9")),
    ("c_mktsegment", "allowed", _where("c_mktsegment NOT IN ('BUILDING','MACHINERY')")), ("c_acctbal", "min", _where("c_acctbal < 0")), table="customer"))
def check_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in characters, patterns as searches, sets of text."""
    return _counts(_table(spark, sf_dir, "customer"), CUSTOMER)


@query("WITH t AS (SELECT regexp_replace(text, '[^z]', 'a', 'g') AS letters, text AS words, translate(text, chr(10), ' ') AS parts FROM documents) " + _union(
    ("letters", "pattern", _where("NOT regexp_matches(letters, '^(a|b)*$')")), ("words", "pattern", _where("NOT regexp_matches(words, '^([A-Za-z]+[ .,]*)*$')")),
    ("parts", "pattern", _where("NOT regexp_matches(parts, 'the.*and.*(of|ion)+[.]$')")), table="t"))
def long_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that overflow or stall a backtracking matcher, over whole texts of documents."""
    letters, parts = F.regexp_replace("text", "[^z]", "a").alias("letters"), F.translate("text", "\n", " ").alias("parts")
    texts = _table(spark, sf_dir, "documents").select(letters, F.col("text").alias("words"), parts)
    shapes_of = {"letters": "^(a|b)*$", "words": "^([A-Za-z]+[ .,]*)*$", "parts": "the.*and.*(of|ion)+[.]$"}
    return _counts(texts, _model(**{n: {"type": "string", "pattern": p} for n, p in shapes_of.items()}))


def _nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(p, F.lit("5-LOW")).alias("needed"), F.nullif(p, F.lit("1-URGENT")).alias("spare"))


@query(_union(("needed", "null_not_allowed", _where("o_orderpriority = '5-LOW'")), table="orders"))
def check_nulls_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In columns a null breaks a required field and passes an optional one."""
    return _counts(_nulls(spark, sf_dir), _model(needed={"type": "string", "required": True}, spare={"type": "string"}))


@query("SELECT * FROM (VALUES ('needed','required_missing',0),('needed','null_not_allowed',(SELECT count(*) FROM orders WHERE o_orderpriority='5-LOW')),('needed','type_mismatch',0),"
       "('spare','null_not_allowed',(SELECT count(*) FROM orders WHERE o_orderpriority='1-URGENT')),('spare','type_mismatch',0),('o_orderkey','required_missing',0),('o_orderkey','null_not_allowed',0),"
       "('o_orderkey','type_mismatch',0),('o_orderkey','max',(SELECT count(*) FROM orders WHERE o_orderkey > 1000)),(NULL,'record_not_object',0)) AS t(field, rule, violations)")  # fmt: skip
def check_nulls_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In records a null that was sent breaks an optional field too."""
    lines = _nulls(spark, sf_dir).select(F.to_json(F.struct("o_orderkey", "needed", "spare"), {"ignoreNullFields": "false"}).alias(LINE))
    m = _model(needed={"type": "string", "required": True}, spare={"type": "string"}, o_orderkey={"type": "integer", "required": True, "max": 1000})
    return C.counts_frame(*C.bind(m, Source(_records(spark, lines), "records", "orders")))


def _records(spark: SparkSession, lines: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return records(lines)


@query(_union(("l_orderkey", "unique", "count(l_orderkey) - count(DISTINCT l_orderkey)"), ("l_extendedprice", "unique", "count(l_extendedprice) - count(DISTINCT l_extendedprice)"),
              ("l_returnflag", "unique", "count(l_returnflag) - count(DISTINCT l_returnflag)"), table="lineitem"))
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beyond their first, by field: keys are counted before they move."""
    m = _model(**{n: {"type": t, "unique": True} for n, t in (("l_orderkey", "integer"), ("l_extendedprice", "float"), ("l_returnflag", "string"))})
    return _counts(_table(spark, sf_dir, "lineitem"), m)


_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount, l_quantity"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_LINE_ORDER}) AS k FROM lineitem) WHERE k > 1")
def unique_later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a key: the first in order keeps it."""
    order = F.struct(*_LINE_ORDER.split(", "), F.monotonically_increasing_id().alias("id"))
    df = C.later_copies(_table(spark, sf_dir, "lineitem"), F.col("l_partkey"), order)
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(_union(("l_orderkey,l_linenumber", "duplicate_values", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))"), table="lineitem"))
def unique_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose combination of two fields came before."""
    rule = DatasetRule("duplicate_values", ("l_orderkey", "l_linenumber"), equals=0)
    m = Model({"l_orderkey": Field("integer"), "l_linenumber": Field("integer")}, dataset=(rule,))
    df = _table(spark, sf_dir, "lineitem")
    return C.dataset_value(df, rule, R.compile_columns(m, df.schema)).select(F.lit(",".join(rule.fields)).alias("field"), F.lit(rule.metric).alias("rule"), F.col("value").alias("violations"))


@query("""WITH b AS (SELECT 'o_totalprice' AS field, 'min' AS rule, o_orderkey AS row_id, CAST(o_totalprice AS VARCHAR) AS v FROM orders WHERE o_totalprice < 2000
 UNION ALL SELECT 'o_orderstatus', 'allowed', o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F','O')
 UNION ALL SELECT 'o_orderpriority', 'pattern', o_orderkey, o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))
 SELECT field, rule, row_id FROM (SELECT *, row_number() OVER (PARTITION BY field, rule ORDER BY row_id) AS k FROM b) WHERE k <= 10""")
def samples_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten violations of each rule; the limit is the feature."""
    df = _table(spark, sf_dir, "orders")
    compiled = R.compile_columns(ORDERS, df.schema)
    hit = {k for k, r in enumerate(compiled.rules) if (r.field, r.rule) in (("o_totalprice", "min"), ("o_orderstatus", "allowed"), ("o_orderpriority", "pattern"))}
    found = C.sample_rows(df.withColumn(ROW, F.col("o_orderkey")), compiled, hit, set(), 10)
    return _with_rules(found, compiled).withColumnRenamed("row", "row_id").drop("file", "text")


def _with_rules(found: DataFrame, compiled: R.Compiled) -> DataFrame:
    names = [(r.field, r.rule) for r in compiled.rules] + [(n, "unique") for n in compiled.unique]
    told = F.element_at(F.array(*[F.struct(F.lit(f).cast("string").alias("field"), F.lit(r).alias("rule")) for f, r in names]), F.col("k") + 1)
    return found.withColumn("x", told).drop("k").select("x.*", "*").drop("x")


@query("SELECT o_orderkey, CASE WHEN length(t) > 20 THEN substr(t, 1, 20) || '…' ELSE t END AS preview, sha256('string' || chr(0) || t) AS digest, CAST(length(t) AS INTEGER) AS chars "
       "FROM (SELECT o_orderkey, o_orderpriority || ' é ' || o_orderstatus || repeat('x', CAST(o_orderkey % 9 AS INTEGER)) AS t FROM orders)")  # fmt: skip
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reports tell of a value: a preview for people, or its length and digest."""
    t = F.concat("o_orderpriority", F.lit(" é "), "o_orderstatus", F.expr("repeat('x', cast(o_orderkey % 9 as int))"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    seen = shapes.observed(F.lit("string"), F.length("t"), F.col("t"))
    return df.select("o_orderkey", shapes.preview(F.col("t"), 20).alias("preview"), seen["digest"].alias("digest"), F.length("t").alias("chars"))


@query("SELECT * FROM (VALUES ('l_missing','schema_missing_field'),('l_quantity','schema_type_mismatch'),('l_shipdate','schema_type_mismatch'),('l_linestatus','unexpected_field'),"
       "('l_tax','unexpected_field'),('l_discount','unexpected_field'),('l_suppkey','unexpected_field'),('l_partkey','unexpected_field'),('l_linenumber','unexpected_field'),"
       "('l_extendedprice','unexpected_field'),('l_returnflag','unexpected_field')) AS t(field, rule)")  # fmt: skip
def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the columns themselves, once a source: missing, unfit, not declared."""
    m = Model(
        {
            "l_orderkey": Field("integer", required=True), "l_missing": Field("string", required=True), "l_quantity": Field("string"),
            "l_shipdate": Field("timestamp", allowed=("2026-01-01T00:00:00Z",)),
        },
        strict=True,
    )
    compiled = R.compile_columns(m, _table(spark, sf_dir, "lineitem").schema)
    return spark.createDataFrame([(s.field, s.rule) for s in compiled.schema], "field string, rule string")


# --- shapes and formats ----------------------------------------------------


@query("SELECT page_id, regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+') AS is_uri FROM pages")
def format_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", shapes.is_uri(F.col("url")).alias("is_uri"))


_EMAILS = "CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN c_name || '@x.org' WHEN 1 THEN 'a@b' WHEN 2 THEN 'a@b@c.d' WHEN 3 THEN '@x.org' WHEN 4 THEN 'a b@x.org' ELSE CASE WHEN c_custkey % 4 = 1 THEN 'a@.x.org' WHEN c_custkey % 4 = 3 THEN 'a@x.' ELSE 'a@b.c' END END"


@query(f"""WITH d AS (SELECT c_custkey, e, string_split(e, '@') AS s FROM (SELECT c_custkey, {_EMAILS} AS e FROM customer))
 SELECT c_custkey, NOT regexp_matches(e, '\\s') AND len(s) = 2 AND s[1] <> '' AND strpos(s[2], '.') > 1 AND right(s[2], 1) <> '.' AS is_email FROM d""")
def format_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr(_EMAILS.replace("AS INTEGER", "AS INT"))
    return _table(spark, sf_dir, "customer").select("c_custkey", shapes.is_email(e).alias("is_email"))


_DAYS = "strftime(o_orderdate, '%Y-%m-') || lpad(CAST(1 + o_orderkey % 31 AS VARCHAR), 2, '0')"


@query(f"SELECT o_orderkey, try_cast(d AS DATE) IS NOT NULL AS is_date, try_cast(d AS DATE) IS NOT NULL AND o_orderkey % 25 < 24 AS is_timestamp, o_orderkey % 2 = 0 AS is_uuid FROM (SELECT o_orderkey, {_DAYS} AS d FROM orders)")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that exist, timestamps with an offset, uuids in their canonical form."""
    d = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((1 + F.col("o_orderkey") % 31).cast("string"), 2, "0"))
    hour = F.lpad((F.col("o_orderkey") % 25).cast("string"), 2, "0")
    ts = F.concat(d, F.lit("T"), hour, F.lit(":30:00.25+01:00"))
    uuid = F.concat(F.lit("12345678-9abc-DEF0-1234-56789abcdef"), F.when(F.col("o_orderkey") % 2 == 0, "0").otherwise("g"))
    df = _table(spark, sf_dir, "orders")
    return df.select("o_orderkey", shapes.is_date(d).alias("is_date"), shapes.is_timestamp(ts).alias("is_timestamp"), shapes.is_uuid(uuid).alias("is_uuid"))


@query("SELECT p_partkey, p_size % 5 <> 0 AS off FROM part")
def multiple_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part")
    compiled = R.compile_columns(_model(p_size={"type": "integer", "multiple_of": 5}), df.schema)
    return df.select("p_partkey", compiled.rules[0].broken.alias("off"))


@query("SELECT 'rows' AS rule, count(*) BETWEEN 10 AND 100000000 AS holds FROM nation UNION ALL SELECT 'nulls', 100.0 * count(*) FILTER (WHERE n_name IS NULL) / count(*) < 50 FROM nation "
       "UNION ALL SELECT 'copies', count(*) - count(DISTINCT n_regionkey) = 0 FROM nation")  # fmt: skip
def dataset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on aggregates: number of rows, share of nulls, copies."""
    df = _table(spark, sf_dir, "nation")
    rules = {"rows": DatasetRule("row_count", at_least=10, at_most=100000000), "nulls": DatasetRule("null_values", ("n_name",), True, below=50), "copies": DatasetRule("duplicate_values", ("n_regionkey",), equals=0)}
    m = Model({"n_name": Field("string"), "n_regionkey": Field("integer")}, dataset=tuple(rules.values()))
    compiled, n_rows = R.compile_columns(m, df.schema), df.count()
    held = [(n, C.dataset_holds(r, C.dataset_value(df, r, compiled).first()["value"], n_rows)) for n, r in rules.items()]
    return spark.createDataFrame(held, "rule string, holds boolean")


# --- gate ------------------------------------------------------------------

EVENTS = parse("""
contract: 1
id: events
version: 1.0.0
owner: team
models:
  props:
    strict: true
    fields:
      k: {type: integer, required: true, min: 10, max: 89}
""")


@query("SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 89 THEN 'pass' ELSE 'block' END AS verdict FROM events")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every record, by the expressions that the stream uses."""
    return G.judge(_table(spark, sf_dir, "events"), EVENTS, value="props").select("event_id", "verdict")


@query("SELECT event_id, 'k' AS field, CASE WHEN CAST(props->>'k' AS BIGINT) < 10 THEN 'min' ELSE 'max' END AS rule, props->>'k' AS value FROM events WHERE CAST(props->>'k' AS BIGINT) NOT BETWEEN 10 AND 89")
def gate_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dead letters tell: each violation of each blocked record."""
    return G.each_violation(G.judge(_table(spark, sf_dir, "events"), EVENTS, value="props"), "event_id")


@query("SELECT event_id, CASE WHEN k < 10 OR k > 89 OR event_id > first_id THEN 'block' ELSE 'pass' END AS verdict FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, "
       "min(event_id) OVER (PARTITION BY CAST(props->>'k' AS BIGINT)) AS first_id FROM events)")  # fmt: skip
def gate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a unique field: the first record of a key passes, later ones are blocked."""
    m = Model({"k": Field("integer", required=True, min=10, max=89, unique=True)})
    c = Contract("events", "1.0.0", {"props": m}, owner="team")
    judged = G.judge(_table(spark, sf_dir, "events"), c, unique=G.SKIP, value="props")
    tracked, _ = G.track(judged, m, c, "event_id")
    return tracked.select("event_id", "verdict")


_LETTERS = "CAST(props->>'k' AS BIGINT)"


@query(f"""WITH r AS (SELECT 'records' AS counter, count(*) AS n FROM events UNION ALL SELECT 'passed', count(*) FROM events WHERE {_LETTERS} BETWEEN 10 AND 89
 UNION ALL SELECT 'blocked', count(*) FROM events WHERE {_LETTERS} NOT BETWEEN 10 AND 89 UNION ALL SELECT 'k min', count(*) FROM events WHERE {_LETTERS} < 10
 UNION ALL SELECT 'k max', count(*) FROM events WHERE {_LETTERS} > 89 UNION ALL SELECT 'recent', count(*) FROM events) SELECT counter, CAST(n AS BIGINT) AS n FROM r""")
def gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate counts of its batches, here of two: by verdict, by rule, and recent throughput."""
    df, totals = _table(spark, sf_dir, "events"), G.GateStats()
    for k in (0, 1):
        judged = G.judge(df.where(F.pmod("event_id", F.lit(2)) == k), EVENTS, value="props")
        totals.add(*G.batch_counts(judged, EVENTS.model()[1], "props"), seconds=1.0, now=1000.0 + k)
    told = totals.snapshot(EVENTS, "props")
    rows = [(n, told[n]) for n in ("records", "passed", "blocked")] + [(f"{r['field']} {r['rule']}", r["count"]) for r in told["per_rule"]]
    return spark.createDataFrame([*rows, ("recent", sum(b["records"] for b in told["recent"]))], "counter string, n long")


@query("SELECT event_id, 'events' AS contract_id, 'props' AS model, props AS record, 'k' AS field, CASE WHEN CAST(props->>'k' AS BIGINT) < 10 THEN 'min' ELSE 'max' END AS rule FROM events WHERE CAST(props->>'k' AS BIGINT) NOT BETWEEN 10 AND 89")
def gate_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters themselves, read back: who judged the record, the record as it came, what it broke."""
    judged = G.judge(_table(spark, sf_dir, "events"), EVENTS, value="props").where(F.col("verdict") != "pass")
    letter = judged.select("event_id", G.envelope(EVENTS, "props", "props").alias("letter"))
    schema = "contract_id string, model string, record string, violations array<struct<field:string,rule:string>>"
    read = letter.select("event_id", F.from_json("letter", schema).alias("l"))
    return read.select("event_id", "l.contract_id", "l.model", "l.record", F.inline("l.violations"))


@query("SELECT bool_or(CAST(props->>'k' AS BIGINT) NOT BETWEEN 10 AND 89) AS refused_record, CAST(event_id % 5 AS INTEGER) AS partition, min(event_id) AS event_id FROM events GROUP BY 2")
def kafka_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of a topic whose batch holds a blocked record."""
    rows = G.judge(_table(spark, sf_dir, "events").withColumn("topic", F.lit("t")).withColumn("partition", F.pmod("event_id", F.lit(5)).cast("int")), EVENTS, value="props")
    refused = K.refused_partitions(rows).select("partition", F.col("refused").alias("refused_record"))
    return refused.join(rows.groupBy("partition").agg(F.min("event_id").alias("event_id")), "partition").select("refused_record", "partition", "event_id")


@query("SELECT event_id, k AS field FROM (SELECT event_id, unnest(json_keys(j)) AS k FROM (SELECT event_id, json_object('k', event_id, event_type, value, 'z', user_id) AS j FROM events)) WHERE k NOT IN ('k', 'click')")
def strict_unexpected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a strict model doesn't declare, each a violation."""
    m = Model({"k": Field("integer"), "click": Field("float")}, strict=True)
    line = F.concat(F.lit('{"k":'), "event_id", F.lit(',"'), "event_type", F.lit('":'), "value", F.lit(',"z":'), "user_id", F.lit("}"))
    df = _table(spark, sf_dir, "events").select("event_id", line.alias(LINE))
    return df.select("event_id", F.explode(R.unexpected_keys(m, F.col(LINE))).alias("field"))


@query("SELECT event_id, event_id % 4 IN (1, 2, 3) AS broken FROM events")
def record_not_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no JSON object: trailing text, other JSON, no JSON."""
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.col("props")).when(k == 1, F.concat("props", F.lit(" x"))).when(k == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.lit("nope"))
    df = _records(spark, _table(spark, sf_dir, "events").select("event_id", line.alias(LINE)))
    return df.select("event_id", R.compile_records(Model({"k": Field("integer")})).rules[0].broken.alias("broken"))


@query("SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS start, CAST(count(*) AS BIGINT) AS records FROM events GROUP BY 1")
def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.throughput(_table(spark, sf_dir, "events"), "ts")


# --- profiles --------------------------------------------------------------

_LINE_PROFILE = _model(
    l_quantity={"type": "float"}, l_extendedprice={"type": "float"}, l_linenumber={"type": "integer"}, l_returnflag={"type": "string", "allowed": ("A", "N")}, l_shipdate={"type": "timestamp"}
)


def _bound(spark: SparkSession, sf_dir: str, table: str, m: Model):
    return C.bind(m, Source(_table(spark, sf_dir, table), "columns", table))


def _number_sql(c: str) -> str:
    return f"SELECT '{c}' AS field, CAST(count({c}) AS BIGINT) AS n, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, round(CAST(sum({c}) AS DOUBLE), 2) AS total FROM lineitem"


@query(" UNION ALL ".join(map(_number_sql, ("l_quantity", "l_extendedprice", "l_linenumber"))))
def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, least, most and sum of every numeric field, from one aggregate."""
    frame, compiled = _bound(spark, sf_dir, "lineitem", _LINE_PROFILE)
    one = P.counters(frame, compiled)
    at = {n: k for k, n in enumerate(compiled.values)}
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"count{at[n]}").alias("n"), F.col(f"min{at[n]}").alias("least"), F.col(f"max{at[n]}").alias("most"), F.round(f"sum{at[n]}", 2).alias("total")) for n in ("l_quantity", "l_extendedprice", "l_linenumber")]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@query("SELECT 'c_name' AS field, CAST(count(*) AS BIGINT) AS n, CAST(min(length(c_name)) AS INTEGER) AS least, CAST(max(length(c_name)) AS INTEGER) AS most, CAST(sum(length(c_name)) AS BIGINT) AS total FROM customer "
       "UNION ALL SELECT 'c_mktsegment', CAST(count(*) AS BIGINT), CAST(min(length(c_mktsegment)) AS INTEGER), CAST(max(length(c_mktsegment)) AS INTEGER), CAST(sum(length(c_mktsegment)) AS BIGINT) FROM customer")  # fmt: skip
def profile_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, compiled = _bound(spark, sf_dir, "customer", _model(c_name={"type": "string"}, c_mktsegment={"type": "string"}))
    one = P.counters(frame, compiled)
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"count{k}").alias("n"), F.col(f"min{k}").alias("least"), F.col(f"max{k}").alias("most"), F.col(f"sum{k}").alias("total")) for k, n in enumerate(compiled.values)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@query("SELECT 'l_returnflag' AS field, CASE WHEN l_returnflag IN ('A','N') THEN l_returnflag END AS value, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 2")
def profile_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the declared values; a null stands for all others."""
    return P.categories(*_bound(spark, sf_dir, "lineitem", _LINE_PROFILE))


@query("SELECT strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS earliest, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS latest FROM lineitem")
def profile_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, compiled = _bound(spark, sf_dir, "lineitem", _LINE_PROFILE)
    k = list(compiled.values).index("l_shipdate")
    return P.counters(frame, compiled).select(F.col(f"min{k}").alias("earliest"), F.col(f"max{k}").alias("latest"))


_BUCKET_SQL = (
    "SELECT '{f}' AS field, CAST(sign({c}) AS INTEGER) AS sign, CAST(CASE WHEN {c} = 0 THEN 0 ELSE (e + 1023) * 64 + floor((abs({c}) / pow(2.0, e) - 1) * 64) END AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n "
    "FROM (SELECT {c}, CASE WHEN {c} = 0 THEN 0 WHEN pow(2.0, g) > abs({c}) THEN g - 1 WHEN pow(2.0, g + 1) <= abs({c}) THEN g + 1 ELSE g END AS e "
    "FROM (SELECT {c}, CASE WHEN {c} = 0 THEN 0 ELSE floor(log2(abs({c}))) END AS g FROM {t})) GROUP BY 2, 3"
)


@query(_BUCKET_SQL.format(f="c_acctbal", c="c_acctbal", t="customer"))
def profile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log histogram: 64 buckets to a power of two, of each sign."""
    return P.histogram(*_bound(spark, sf_dir, "customer", _model(c_acctbal={"type": "float"})))


@query("""WITH b AS (""" + _BUCKET_SQL.format(f="l_extendedprice", c="l_extendedprice", t="lineitem") + """),
 c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS done, sum(n) OVER () AS total FROM b),
 q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q)
 SELECT CAST(q AS DOUBLE) AS q, CAST(min(bucket) AS BIGINT) AS bucket FROM q JOIN c ON done >= ceil(CAST(q AS DOUBLE) * total) GROUP BY q""")
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the histogram: the first bucket whose running count reaches the rank."""
    counts = P.histogram(*_bound(spark, sf_dir, "lineitem", _model(l_extendedprice={"type": "float"})))
    return P.quantile_buckets(counts, (0.1, 0.25, 0.5, 0.75, 0.9)).select("q", "bucket")


@query("""WITH b AS (""" + _BUCKET_SQL.format(f="c_acctbal", c="c_acctbal", t="(SELECT c_acctbal - 4000 AS c_acctbal FROM customer)") + """),
 c AS (SELECT sign, bucket, sum(n) OVER (ORDER BY sign * bucket) AS done, sum(n) OVER () AS total FROM b), q AS (SELECT unnest([0.05, 0.3, 0.5, 0.95]) AS q)
 SELECT CAST(q AS DOUBLE) AS q, arg_min(sign, done) AS sign, arg_min(bucket, done) AS bucket FROM q JOIN c ON done >= ceil(CAST(q AS DOUBLE) * total) GROUP BY q""")
def profile_quantiles_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of numbers of both signs: of negative ones the larger bucket is the smaller number."""
    df = _table(spark, sf_dir, "customer").select((F.col("c_acctbal") - 4000).alias("c_acctbal"))
    counts = P.histogram(*C.bind(_model(c_acctbal={"type": "float"}), Source(df, "columns", "customer")))
    return P.quantile_buckets(counts, (0.05, 0.3, 0.5, 0.95)).select("q", "sign", "bucket")


@query("SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(min(o_totalprice) AS DOUBLE) AS least, CAST(max(o_totalprice) AS DOUBLE) AS most, round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS total FROM orders")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of three parts of a table, merged: as of the whole."""
    df = _table(spark, sf_dir, "orders")
    c = Contract("orders", "1.0.0", {"orders": _model(o_totalprice={"type": "float"})})
    parts = [P.profile_source(spark, Source(df.where(F.pmod("o_custkey", F.lit(3)) == k), "columns", "part"), c) for k in range(3)]
    whole = P.merge(spark, P.merge(spark, parts[0], parts[1]), parts[2])
    n = whole.fields["o_totalprice"].numbers
    return spark.createDataFrame([(whole.rows, n["min"], n["max"], round(n["sum"], 2))], "row_count long, least double, most double, total double")


@query()
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of distinct values from mergeable sketches; approximate, so without an exact oracle."""
    frame, compiled = _bound(spark, sf_dir, "lineitem", _model(l_partkey={"type": "integer"}, l_suppkey={"type": "integer"}))
    one = P.counters(frame, compiled)
    rows = [F.struct(F.lit(n).alias("field"), F.hll_sketch_estimate(f"sketch{k}").alias("distinct")) for k, n in enumerate(compiled.values)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


# --- drift -----------------------------------------------------------------

_HALF = "CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'a' ELSE 'b' END"


@query(f"""WITH r AS (SELECT count(*) FILTER (WHERE {_HALF} = 'a') AS a, count(*) FILTER (WHERE {_HALF} = 'b') AS b, count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND {_HALF} = 'a') AS x,
 count(*) FILTER (WHERE o_orderpriority IN ('5-LOW', '1-URGENT') AND {_HALF} = 'b') AS y FROM orders),
 f AS (SELECT 'rows' AS field, 'volume' AS metric, a::DOUBLE AS baseline, b::DOUBLE AS current, abs(b - a) / a::DOUBLE AS score, 0.01 AS least FROM r UNION ALL SELECT 'o_orderpriority', 'null_rate', x / a::DOUBLE, y / b::DOUBLE, abs(y / b::DOUBLE - x / a::DOUBLE), 0.01 FROM r)
 SELECT field, metric, round(baseline, 9) AS baseline, round(current, 9) AS current, round(score, 9) AS score FROM f WHERE score > least""")
def drift_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and null rate of two runs, by drift() of their profiles."""
    from ..operators.drift import Thresholds, drift

    df = _table(spark, sf_dir, "orders").withColumn("half", F.expr(_HALF))
    gone = (F.col("o_orderpriority") == "5-LOW") | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("half") == "b"))
    df = df.select("half", F.when(~gone, F.col("o_orderpriority")).alias("o_orderpriority"))
    c = Contract("orders", "1.0.0", {"orders": _model(o_orderpriority={"type": "string", "nullable": True})})
    a, b = (P.profile_source(spark, Source(df.where(F.col("half") == h).drop("half"), "columns", h), c) for h in "ab")
    found = [d for d in drift(a, b, Thresholds(rate=0.01, volume=0.01)).findings if d.metric in ("volume", "null_rate")]
    rows = [(d.field or "rows", d.metric, round(float(d.baseline), 9), round(float(d.current), 9), round(d.score, 9)) for d in found]
    return spark.createDataFrame(rows, "field string, metric string, baseline double, current double, score double")


@query(f"""WITH s AS (SELECT o_orderpriority AS v, count(*) FILTER (WHERE {_HALF} = 'a')::DOUBLE AS x, count(*) FILTER (WHERE {_HALF} = 'b')::DOUBLE AS y FROM orders GROUP BY 1),
 p AS (SELECT v, x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM s)
 SELECT round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END))), 8) AS distance FROM p""")
def drift_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jensen-Shannon distance of the category shares of two runs."""
    from ..operators.drift import jensen_shannon

    df = _table(spark, sf_dir, "orders")
    m = _model(o_orderpriority={"type": "string", "allowed": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")})
    c = Contract("orders", "1.0.0", {"orders": m})
    a, b = (P.profile_source(spark, Source(df.where(F.expr(_HALF) == h), "columns", h), c).fields["o_orderpriority"] for h in "ab")
    return spark.createDataFrame([(round(jensen_shannon(a, b)[0], 8),)], "distance double")


_MIDDLE = "((1 + ({b} % 64) / 64.0) * pow(2.0, ({b} // 64) - 1023) + (1 + (({b} + 1) % 64) / 64.0) * pow(2.0, (({b} + 1) // 64) - 1023)) / 2"


@query(f"""WITH v AS (SELECT {_HALF} AS half, o_totalprice AS x, CAST(floor(log2(o_totalprice)) AS BIGINT) AS g FROM orders),
 e AS (SELECT half, x, CASE WHEN pow(2.0, g) > x THEN g - 1 WHEN pow(2.0, g + 1) <= x THEN g + 1 ELSE g END AS e FROM v),
 h AS (SELECT half, CAST((e + 1023) * 64 + floor((x / pow(2.0, e) - 1) * 64) AS BIGINT) AS bucket, count(*) AS n FROM e GROUP BY 1, 2),
 r AS (SELECT half, bucket, n, sum(n) OVER (PARTITION BY half ORDER BY bucket) AS done, sum(n) OVER (PARTITION BY half) AS total FROM h),
 edges AS (SELECT DISTINCT (SELECT min(bucket) FROM r WHERE half = 'a' AND done >= ceil(CAST(k AS DOUBLE) / 10 * total)) AS e FROM range(1, 10) AS t(k)),
 bins AS (SELECT half, bin, coalesce(sum(n), 0) / max(total) AS share FROM (SELECT half, n, total, (SELECT count(*) FROM edges WHERE edges.e < r.bucket) AS bin FROM r) GROUP BY 1, 2),
 grid AS (SELECT k AS bin FROM range(0, (SELECT count(*) + 1 FROM edges)) AS t(k)),
 both_ AS (SELECT greatest(0.0001, coalesce(x.share, 0)) AS p, greatest(0.0001, coalesce(y.share, 0)) AS q FROM grid LEFT JOIN (SELECT * FROM bins WHERE half = 'a') x USING (bin) LEFT JOIN (SELECT * FROM bins WHERE half = 'b') y USING (bin)),
 m AS (SELECT half, min(bucket) AS bucket FROM r WHERE done >= ceil(0.5 * total) GROUP BY half)
 SELECT round((SELECT sum((q - p) * ln(q / p)) FROM both_), 8) AS score, round((SELECT {_MIDDLE.format(b="bucket")} FROM m WHERE half = 'a'), 6) AS median_before, round((SELECT {_MIDDLE.format(b="bucket")} FROM m WHERE half = 'b'), 6) AS median_after""")
def drift_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability index of two runs over the baseline's deciles, and both medians."""
    from ..operators.drift import psi

    df = _table(spark, sf_dir, "orders")
    c = Contract("orders", "1.0.0", {"orders": _model(o_totalprice={"type": "float"})})
    a, b = (P.profile_source(spark, Source(df.where(F.expr(_HALF) == h), "columns", h), c).fields["o_totalprice"] for h in "ab")
    score, x, y = psi(a.histogram, b.histogram)
    return spark.createDataFrame([(round(score, 8), round(x, 6), round(y, 6))], "score double, median_before double, median_after double")


# --- metadata --------------------------------------------------------------


@query("""WITH c AS (SELECT p_brand, CASE max(p_size) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS r, count(*) % 3 AS i FROM part GROUP BY 1),
 u AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49)
 SELECT 'supplier ' || l_suppkey AS consumer, CASE max(r) WHEN 1 THEN 'info' WHEN 2 THEN 'risky' ELSE 'breaking' END AS severity, list('models.m.fields.' || p_brand ORDER BY p_brand) AS changes
 FROM u JOIN c USING (p_brand) WHERE i > 0 GROUP BY l_suppkey""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers that changes reach, with the worst severity: a change for each brand, a consumer for each supplier that ships some."""
    named = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % 3 + 1).cast("int"))
    brands = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("field")).agg(F.max("p_size").alias("size"), F.count(F.lit(1)).alias("n"))
    changes = brands.select(
        F.concat(F.lit("models.m.fields."), "field").alias("path"), named(("info", "risky", "breaking"), F.col("size")).alias("severity"),
        named(("producers", "consumers", "both"), F.col("n")).alias("impact"), F.lit("m").alias("model"), "field",
    )
    ships = _table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    consumes = ships.groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("fields")).select(F.concat(F.lit("supplier "), "l_suppkey").alias("consumer"), F.lit("m").alias("model"), "fields")
    return D.blast_radius(changes, consumes)


#: By segment of customers the nations of two samples of them: what two versions of a contract allow.
_SEGMENTS = "SELECT c_mktsegment AS f, coalesce(list(DISTINCT c_nationkey) FILTER (WHERE c_custkey % 20 < 2), []) AS o, coalesce(list(DISTINCT c_nationkey) FILTER (WHERE c_custkey % 20 IN (1, 2)), []) AS n FROM customer GROUP BY 1"
_ADDED, _REMOVED = ("len(o) > 0 AND len(n) > 0 AND len(list_filter({}, lambda x: NOT list_contains({}, x))) > 0".format(*x) for x in (("n", "o"), ("o", "n")))


def _segment_contracts(spark: SparkSession, sf_dir: str) -> tuple[Contract, Contract, list]:
    key = F.col("c_custkey") % 20
    nations = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("c_nationkey"))))
    sets = _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(nations(key < 2).alias("o"), nations(key.isin(1, 2)).alias("n")).orderBy("c_mktsegment").collect()  # a row a segment
    of = lambda side, version: Contract("c", version, {"m": Model({r["c_mktsegment"]: Field("integer", allowed=tuple(r[side])) for r in sets if r[side]})}, owner="t")
    return of("o", "1.0.0"), of("n", "2.0.0"), sets


_OLD, _NEW = (
    parse(f"""
contract: 1
id: d
version: {v}
owner: team
models:
  m:
    fields:
      flag: {{type: string, allowed: {allowed}}}
      size: {{type: {kind}, min: {low}, max: 9}}
      {more}
policy: {{max_violations: {budget}}}
""")
    for v, allowed, kind, low, more, budget in (("1.0.0", "[A, N, R]", "integer", 1, "gone: {type: string}", 0), ("1.1.0", "[N, X]", "float", 2, "fresh: {type: string, required: true}", 5))
)


@query(f"""WITH s AS ({_SEGMENTS}), r AS (SELECT f, 'risky' AS severity, 'consumers' AS impact FROM s WHERE {_ADDED} UNION ALL SELECT f, 'risky', 'producers' FROM s WHERE {_REMOVED}
 UNION ALL SELECT f, 'breaking', 'consumers' FROM s WHERE len(o) > 0 AND len(n) = 0 UNION ALL SELECT f, 'info', 'consumers' FROM s WHERE len(o) = 0 AND len(n) > 0)
 SELECT 'models.m.fields.' || f AS path, severity, impact FROM r""")
def segments_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff() of two versions whose sets of allowed values come from a table: sets narrowed and widened, fields gone and new."""
    old, new, _ = _segment_contracts(spark, sf_dir)
    return D.diff(old, new).to_frame(spark).select("path", "severity", "impact")


@query("SELECT * FROM (VALUES ('models.m.fields.flag','risky','producers'), ('models.m.fields.flag','risky','consumers'), ('models.m.fields.size','risky','consumers'), ('models.m.fields.size','risky','producers'), "
       "('models.m.fields.gone','breaking','consumers'), ('models.m.fields.fresh','breaking','producers'), ('policy.max_violations','risky','consumers'), ('version','breaking','both')) AS t(path, severity, impact)")  # fmt: skip
def diff_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff() of two versions: sets narrowed and widened, a type and a bound, fields gone and new, budget, version."""
    return D.diff(_OLD, _NEW).to_frame(spark).select("path", "severity", "impact")


@query("SELECT k, CAST(row_number() OVER (ORDER BY k % 3, k % 2, k // 4, pre IS NULL, pre) AS INTEGER) AS place FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 < 2 THEN n_nationkey END AS pre FROM nation)")
def semver_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by precedence, prereleases before their release."""
    keys = [r[0] for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    version = lambda k: f"{k % 3}.{k % 2}.{k // 4}" + (f"-{k}" if k % 4 < 2 else "")
    ordered = sorted(keys, key=lambda k: Version.parse(version(k)).order)
    return spark.createDataFrame([(k, n + 1) for n, k in enumerate(ordered)], "k int, place int")


_MIXED = "CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '\"x\"' WHEN 2 THEN '1.5' WHEN 3 THEN 'true' WHEN 4 THEN 'null' ELSE '[1]' END"


@query("SELECT * FROM (VALUES (NULL,'record_not_object',0),('n','required_missing',(SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0)),('n','null_not_allowed',(SELECT count(*) FROM orders WHERE o_orderkey % 6 = 4 AND o_orderkey % 7 <> 0)),"
       "('n','type_mismatch',(SELECT count(*) FROM orders WHERE o_orderkey % 6 IN (1,2,3,5) AND o_orderkey % 7 <> 0)),('x','null_not_allowed',(SELECT count(*) FROM orders WHERE o_orderkey % 6 = 4)),"
       "('x','type_mismatch',(SELECT count(*) FROM orders WHERE o_orderkey % 6 IN (1,3,5))),('x','max',(SELECT count(*) FROM orders WHERE o_orderkey % 6 = 2))) AS t(field, rule, violations)")  # fmt: skip
def check_types_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent keys and values of other types, by the rules of records."""
    v = F.expr(_MIXED)
    line = F.concat(F.lit('{"x":'), v, F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit(',"n":'), v)).otherwise(F.lit("")), F.lit("}"))
    lines = _table(spark, sf_dir, "orders").select(line.alias(LINE))
    m = _model(n={"type": "integer", "required": True}, x={"type": "float", "max": 1.2})
    return C.counts_frame(*C.bind(m, Source(_records(spark, lines), "records", "orders")))


@query(_union(("f", "min", _where("(l_discount::FLOAT) < (0.03::FLOAT)")), ("f", "max", _where("(l_discount::FLOAT) > (0.07::FLOAT)")), ("f", "allowed", _where("(l_discount::FLOAT) NOT IN (0.03::FLOAT, 0.04::FLOAT, 0.1::FLOAT)")), table="lineitem"))
def check_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and sets of 32-bit columns: 0.07 as such a number isn't over 0.07."""
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("float").alias("f"))
    return _counts(df, _model(f={"type": "float", "min": 0.03, "max": 0.07, "allowed": (0.03, 0.04, 0.1)}))


@query(_union(("z", "unique", "count(*) - count(DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_linenumber % 3 = 1 THEN 'nan'::DOUBLE ELSE l_tax END)"), table="lineitem"))
def unique_canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as one key: both zeros, and every NaN."""
    zero = F.when(F.col("l_quantity") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0))
    z = F.when(F.col("l_linenumber") % 3 == 0, zero).when(F.col("l_linenumber") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return _counts(_table(spark, sf_dir, "lineitem").select(z.alias("z")), _model(z={"type": "float", "unique": True}))


def _own_folder(spark: SparkSession, kind: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/written-{uuid.uuid4().hex}.{kind}"


def _written(spark: SparkSession, df: DataFrame, kind: str) -> tuple[Source, str]:
    """df written as CSV or NDJSON where the session keeps its tables, and read by its extension."""
    folder = _own_folder(spark, kind)
    if kind == "csv":
        df.write.option("header", True).option("emptyValue", "").csv(folder)
    else:
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    return read(spark, folder, rows=True), folder


@query(_union(("p_partkey", "type_mismatch", _where("p_partkey % 10 = 3")), ("p_size", "type_mismatch", _where("false")), ("p_size", "min", _where("p_size < 5")), ("p_size", "max", _where("p_size > 45")), ("p_name", "pattern", _where("NOT regexp_matches(p_name, '[0-4]$')")), table="part"))
def check_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file: cells are read by the contract's types; an unreadable one is a mismatch."""
    key = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("x"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    source, _ = _written(spark, _table(spark, sf_dir, "part").select(key.alias("p_partkey"), "p_size", "p_name"), "csv")
    m = _model(p_partkey={"type": "integer"}, p_size={"type": "integer", "min": 5, "max": 45}, p_name={"type": "string", "pattern": "[0-4]$"})
    return C.counts_frame(*C.bind(m, source)).where(F.col("field").isNotNull())  # ragged_csv has the rule on whole lines


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS row, s_suppkey FROM supplier")
def ndjson_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An NDJSON file's lines in order, blank ones left out, numbered from 0."""
    df = _table(spark, sf_dir, "supplier").select("s_suppkey").coalesce(1).sortWithinPartitions("s_suppkey")
    folder = _own_folder(spark, "ndjson")
    line = F.concat(F.lit('{"s_suppkey":'), "s_suppkey", F.lit("}"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("\n  ")).otherwise(F.lit("")))
    df.select(line.alias("value")).write.text(folder)
    source = read(spark, folder, rows=True)
    return source.frame.select(F.col(ROW).alias("row"), F.get_json_object(LINE, "$.s_suppkey").cast("long").alias("s_suppkey"))


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || '\"a, b\"' || chr(10) || chr(10) ELSE p_name END AS name FROM part")
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files whose cells hold line breaks, quotes and commas: records in the order of files and lines, numbered from 0."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit('\n"a, b"\n\n'))).otherwise(F.col("p_name"))
    df = _table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey")
    folder = _own_folder(spark, "csv")
    df.write.options(header=True, escape='"', ignoreTrailingWhiteSpace=False).csv(folder)
    return read(spark, folder, rows=True).frame.select(F.col(ROW).alias("row"), F.col("p_partkey").cast("int").alias("p_partkey"), "name")


@query("WITH t AS (SELECT s_suppkey, s_acctbal, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS ragged FROM supplier) " + _union(
    ("", "type_mismatch", _where("ragged")), ("s_suppkey", "type_mismatch", _where("false")), ("s_acctbal", "type_mismatch", _where("false")),
    ("s_suppkey", "min", _where("s_suppkey < 20 AND NOT ragged")), ("s_acctbal", "min", _where("s_acctbal < 0 AND NOT ragged")), table="t"))
def ragged_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of fewer or more cells than the header: each one mismatch, and no other violation."""
    cells = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat_ws(",", "s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.lit("x"))))
    lines = _table(spark, sf_dir, "supplier").select(cells.alias("value"), F.col("s_suppkey").cast("long").alias("k"))
    whole = lines.union(spark.createDataFrame([("s_suppkey,s_acctbal", -1)], "value string, k long")).coalesce(1).sortWithinPartitions("k")
    folder = _own_folder(spark, "csv")
    whole.select("value").write.text(folder)
    counts = C.counts_frame(*C.bind(_model(s_suppkey={"type": "integer", "min": 20}, s_acctbal={"type": "float", "min": 0}), read(spark, folder)))
    return counts.withColumn("field", F.coalesce("field", F.lit("")))


#: Rows that a task sorts for a file, so that files get more, not larger.
SORTED_ROWS = 1_000_000


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_totalprice, o_custkey FROM orders),
 b AS (SELECT 'o_totalprice' AS field, 'min' AS rule, row FROM o WHERE o_totalprice < 2000
  UNION ALL SELECT 'o_custkey', 'unique', row FROM (SELECT row, row_number() OVER (PARTITION BY o_custkey ORDER BY row) AS k FROM o) WHERE k > 1)
 SELECT field, rule, CAST(row AS BIGINT) AS row FROM (SELECT *, row_number() OVER (PARTITION BY field, rule ORDER BY row) AS k FROM b) WHERE k <= 10""")
def samples_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten violations of each rule, later copies too, over several Parquet files whose rows are numbered as one."""
    folder = _own_folder(spark, "parquet")
    orders = _table(spark, sf_dir, "orders")
    files = max(4, math.ceil(orders.count() / SORTED_ROWS))
    orders.repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(folder)
    m = _model(o_totalprice={"type": "float", "min": 2000}, o_custkey={"type": "integer", "unique": True})
    frame, compiled = C.bind(m, read(spark, folder, rows=True))
    hit = {k for k, r in enumerate(compiled.rules) if r.rule == "min"}
    return _with_rules(C.sample_rows(frame, compiled, hit, {"o_custkey"}, 10), compiled).select("field", "rule", "row")


@query("""WITH g AS (SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_totalprice < 2000) AS low, count(*) - count(DISTINCT o_custkey) AS customers, count(*) - count(DISTINCT o_orderdate) AS dates FROM orders GROUP BY 1)
 SELECT status, 'o_totalprice' AS field, CAST(low AS BIGINT) AS violations FROM g WHERE low > 0 UNION ALL SELECT status, 'o_custkey', customers FROM g WHERE customers > 0 UNION ALL SELECT status, 'o_orderdate', dates FROM g WHERE dates > 0""")
def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files checked together, by the same jobs, each with its own uniqueness: a file for each status of orders."""
    folder = _own_folder(spark, "files")
    orders, status = _table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    held = [r[0] for r in orders.select(status).distinct().collect()]  # three
    place = F.coalesce(*[F.when(status.eqNullSafe(v), F.lit(k)) for k, v in enumerate(held)], F.lit(0))
    # a task for each file writes its rows as they come; partitionBy would have them sorted
    orders.repartitionById(max(1, len(held)), place).write.parquet(folder)
    status_of = {r[1]: r[0] for r in spark.read.parquet(folder).select(status, "_metadata.file_path").distinct().collect()}  # three
    m = _model(o_totalprice={"type": "float", "min": 2000}, o_custkey={"type": "integer", "unique": True}, o_orderdate={"type": "timestamp", "unique": True})
    reports, _ = C.check_all(spark, sorted(status_of), Contract("files", "1.0.0", {"t": m}))
    rows = [(status_of[r.source], f, n) for r in reports for f, _, n in r.per_rule]
    return spark.createDataFrame(rows, "status string, field string, violations long")


@query("""WITH p AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 10), s AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal > 0)
 SELECT 'l_partkey' AS field, l_partkey AS key, count(*) AS violations FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM p) GROUP BY ALL
 UNION ALL SELECT 'l_suppkey', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM s) GROUP BY ALL""")
def allowed_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of foreign keys that another table doesn't hold, with their rows."""
    sets = {"l_partkey": ("part", "p_size > 10", "p_partkey"), "l_suppkey": ("supplier", "s_acctbal > 0", "s_suppkey")}
    df = _table(spark, sf_dir, "lineitem")
    compiled = R.compile_columns(_model(l_partkey={"type": "integer"}, l_suppkey={"type": "integer"}), df.schema)
    found = [C.outside(df, compiled.values[f], _table(spark, sf_dir, t).where(w).select(c)).select(F.lit(f).alias("field"), "key", F.col("n").alias("violations")) for f, (t, w, c) in sets.items()]
    return found[0].unionByName(found[1])


@query("SELECT key, CAST(count(*) AS BIGINT) AS present, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most FROM (SELECT 'k' AS key, CAST(props->>'k' AS BIGINT) AS v FROM events) GROUP BY key")
def infer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inference counts of each key of the records."""
    from ..operators.infer import _observed

    lines = _table(spark, sf_dir, "events").select(F.col("event_id").alias(ROW), F.col("props").alias(LINE))
    _, _, counters, _ = _observed(spark, lines)
    return spark.createDataFrame([(k, c["present"], c["least"], c["most"]) for k, c in counters.items()], "key string, present long, least double, most double")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal = 0 THEN 0 ELSE floor(log2(abs(c_acctbal))) END AS BIGINT) AS octave FROM customer")
def bucket_octaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of two that each number's bucket lies in."""
    x = F.col("c_acctbal")
    octave = F.when(x == 0, F.lit(0)).otherwise(F.floor(buckets.bucket(x) / buckets.PER_OCTAVE) - 1023)
    return _table(spark, sf_dir, "customer").select("c_custkey", octave.cast("long").alias("octave"))


from . import report_queries as _report_queries  # noqa: E402, F401 - registers its queries here
