"""Further queries of the core: whole checks, streams, drafts and documents, each with its DuckDB SQL."""

from __future__ import annotations

import datetime
import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import check as C
from ..operators import conformance, consumers, documents, infer
from ..operators import diff as D
from ..operators import profile as P
from ..operators import profile_table as PT
from ..sources.read import Source
from ..streaming import gate as G
from ..streaming import kafka as K
from . import queries as Q
from .queries import _model, _table, _union, _where, query
from .spec import Contract, Field, Model, parse

_COUNTS = "field string, rule string, violations long"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's tables, which every executor sees."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _told(spark: SparkSession, report) -> DataFrame:
    return spark.createDataFrame([(f, r, n) for f, r, n in report.per_rule], _COUNTS)


# --- whole checks ------------------------------------------------------------

ORDERS = Contract("orders", "1.0.0", {"orders": Q.ORDERS}, owner="team")
_BROKEN = f"""SELECT * FROM ({_union(
    ("o_orderstatus", "allowed", _where("o_orderstatus NOT IN ('F','O')")), ("o_totalprice", "min", _where("o_totalprice < 2000")), ("o_totalprice", "max", _where("o_totalprice > 400000")),
    ("o_orderpriority", "pattern", _where("NOT regexp_matches(o_orderpriority, '^[1-3]-')")), ("o_orderkey", "min", _where("o_orderkey < 1")), ("o_orderkey", "unique", "count(o_orderkey) - count(DISTINCT o_orderkey)"), table="orders")}) WHERE violations > 0"""  # fmt: skip


@query(_BROKEN)
def check_parquet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check() of a path, format by its extension: the report's rules that broke."""
    return _told(spark, C.check(spark, f"{sf_dir}/orders.parquet", ORDERS))


@query(_BROKEN)
def check_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check() of a DataFrame."""
    return _told(spark, C.check(spark, _table(spark, sf_dir, "orders"), ORDERS, samples=False))


@query(_union(("n_regionkey", "max", _where("n_regionkey > 2")), ("n_name", "max_length", _where("length(n_name) > 7")), table="nation"))
def check_arrow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check() of an Arrow table in memory."""
    c = Contract("n", "1.0.0", {"n": _model(n_regionkey={"type": "integer", "max": 2}, n_name={"type": "string", "max_length": 7})}, owner="team")
    return _told(spark, C.check(spark, _table(spark, sf_dir, "nation").toArrow(), c))


@query(f"SELECT * FROM ({_union(('n_regionkey', 'null_not_allowed', _where('n_nationkey % 5 = 0')), ('n_regionkey', 'max', _where('n_nationkey % 5 <> 0 AND n_regionkey > 2')), ('extra', 'unexpected_field', 'count(*)'), table='nation')}) WHERE violations > 0")
def check_list_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check() of dicts: keys that a strict model doesn't declare, nulls that were sent."""
    rows = [{"n_regionkey": None if r[0] % 5 == 0 else r[1], "extra": 1} for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()]
    c = Contract("n", "1.0.0", {"n": Model({"n_regionkey": Field("integer", required=True, max=2)}, strict=True)}, owner="team")
    return _told(spark, C.check(spark, rows, c))


@query(_union(("k", "type_mismatch", _where("event_id % 3 = 1")), ("k", "required_missing", _where("event_id % 3 = 2")), ("d", "allowed", _where("strftime(ts, '%d') NOT IN ('01', '02')")), table="events"))
def check_ndjson_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check() of an NDJSON file: absent keys, values of another type, a set of dates as text."""
    k = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"k":'), "event_id")).when(F.col("event_id") % 3 == 1, F.lit(',"k":"x"')).otherwise(F.lit(""))
    line = F.concat(F.lit('{"d":"2026-01-'), F.date_format("ts", "dd"), F.lit('"'), k, F.lit("}"))
    folder = _folder(spark, "events") + ".ndjson"
    _table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    c = Contract("e", "1.0.0", {"e": _model(k={"type": "integer", "required": True}, d={"type": "date", "allowed": ("2026-01-01", "2026-01-02")})}, owner="team")
    return _told(spark, C.check(spark, folder, c))


@query("SELECT b AS budget, (SELECT count(*) FROM customer WHERE c_acctbal < 0) <= b AS within, w OR (SELECT count(*) FROM customer WHERE c_acctbal < 0) <= b AS passed FROM (VALUES (0, false), (0, true), (1000000000, false)) AS t(b, w)")
def violation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations against the policy's budget, and what warning changes."""
    out = []
    for budget, warn in ((0, False), (0, True), (10**9, False)):
        c = parse(f"contract: 1\nid: c\nversion: 1.0.0\nowner: t\nmodels: {{c: {{fields: {{c_acctbal: {{type: float, min: 0}}}}}}}}\npolicy: {{max_violations: {budget}, on_violation: {'warn' if warn else 'block'}}}\n")
        r = C.check(spark, _table(spark, sf_dir, "customer"), c, samples=False)
        out.append((budget, r.within_budget, r.passed))
    return spark.createDataFrame(out, "budget int, within boolean, passed boolean")


@query(f"SELECT field, rule, violations, 'fail' AS verdict, CAST((SELECT count(*) FROM orders) AS BIGINT) AS row_count FROM ({_BROKEN})")
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report document of a check, through JSON and back."""
    report = C.check(spark, _table(spark, sf_dir, "orders"), ORDERS)
    doc = json.loads(json.dumps(documents.for_check([report], datetime.datetime.now(datetime.UTC), 1.0)))
    one = doc["checks"][0]
    return spark.createDataFrame([(r["field"], r["rule"], r["count"], doc["verdict"], one["rows"]) for r in one["per_rule"]], _COUNTS + ", verdict string, row_count long")


@query(f"SELECT d.field, d.rule, b.violations IS NULL AS holds FROM (VALUES ('o_orderkey','required_missing'),('o_orderkey','null_not_allowed'),('o_orderkey','type_mismatch'),('o_orderkey','min'),('o_orderkey','unique'),"
       "('o_orderstatus','null_not_allowed'),('o_orderstatus','type_mismatch'),('o_orderstatus','allowed'),('o_totalprice','null_not_allowed'),('o_totalprice','type_mismatch'),('o_totalprice','min'),('o_totalprice','max'),"
       f"('o_orderpriority','null_not_allowed'),('o_orderpriority','type_mismatch'),('o_orderpriority','pattern'),('o_orderdate','required_missing'),('o_orderdate','null_not_allowed'),('o_orderdate','type_mismatch')) AS d(field, rule) LEFT JOIN ({_BROKEN}) b USING (field, rule)")  # fmt: skip
def lineage_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage event of a check: an assertion for each declared rule, and whether it holds."""
    doc = documents.for_check([C.check(spark, _table(spark, sf_dir, "orders"), ORDERS)], datetime.datetime.now(datetime.UTC), 1.0)
    done = documents.lineage(doc, ORDERS)[-1]
    found = done["inputs"][0]["inputFacets"]["dataQualityAssertions"]["assertions"]
    return spark.createDataFrame([(a.get("column"), a["assertion"], a["success"]) for a in found], "field string, rule string, holds boolean")


# --- gates -------------------------------------------------------------------


@query("SELECT 'clean' AS kind, props AS value, CAST(count(*) AS BIGINT) AS n FROM events WHERE CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 89 GROUP BY 2 UNION ALL "
       "SELECT 'dead', props, CAST(count(*) AS BIGINT) FROM events WHERE CAST(props->>'k' AS BIGINT) NOT BETWEEN 10 AND 89 GROUP BY 2")  # fmt: skip
def gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on a stream of files, run to its end: clean records and dead letters, read back."""
    folder = _folder(spark, "gate")
    _table(spark, sf_dir, "events").select(F.col("props").alias("value")).write.text(f"{folder}/in")
    q, _ = G.gate(spark.readStream.text(f"{folder}/in"), Q.EVENTS, f"{folder}/clean", f"{folder}/dead", f"{folder}/check")
    q.awaitTermination()
    clean = spark.read.text(f"{folder}/clean").select(F.lit("clean").alias("kind"), "value")
    dead = spark.read.text(f"{folder}/dead").select(F.lit("dead").alias("kind"), F.get_json_object("value", "$.record").alias("value"))
    return clean.union(dead).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, CAST(count(*) - 1 AS BIGINT) AS repeated FROM (SELECT CAST(props->>'k' AS BIGINT) AS k FROM events) GROUP BY k HAVING count(*) > 1")
def gate_stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness over the batches of a stream: whatever their order, all but one record of a key are dead letters."""
    folder = _folder(spark, "gate")
    df = _table(spark, sf_dir, "events")
    for k in range(3):
        df.where(F.pmod("event_id", F.lit(3)) == k).select(F.col("props").alias("value")).coalesce(1).write.mode("append").text(f"{folder}/in")
    c = Contract("e", "1.0.0", {"props": Model({"k": Field("integer", required=True, unique=True)})}, owner="team")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{folder}/in")
    q, _ = G.gate(stream, c, f"{folder}/clean", f"{folder}/dead", f"{folder}/check", unique=G.TRACK)
    q.awaitTermination()
    k = F.get_json_object(F.get_json_object("value", "$.record"), "$.k").cast("long")
    return spark.read.text(f"{folder}/dead").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("repeated"))


@query("SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 89 THEN 'pass' ELSE 'block' END AS verdict, CASE WHEN CAST(props->>'k' AS BIGINT) < 10 THEN 'min' WHEN CAST(props->>'k' AS BIGINT) > 89 THEN 'max' END AS rule FROM events")
def gate_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions, which judge one text at a time by the rules of the column expressions."""
    G.register_functions(spark, Q.EVENTS, prefix="gate_query")
    df = _table(spark, sf_dir, "events").select("event_id", F.expr("gate_query_verdict(props)").alias("verdict"), F.expr("gate_query_dead_letter(props)").alias("letter"))
    return df.select("event_id", "verdict", F.get_json_object("letter", "$.violations[0].rule").alias("rule"))


@query("SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 89 THEN 'clean' ELSE 'dead' END AS topic, CAST(user_id AS VARCHAR) AS key, CAST(event_id % 7 AS VARCHAR) AS origin FROM events")
def kafka_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the topics: clean ones as they came, dead letters with the partition they came from."""
    rows = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.lit("in").alias("topic"), F.pmod("event_id", F.lit(7)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.array(F.struct(F.lit("id").alias("key"), F.col("event_id").cast("string").cast("binary").alias("value")), F.struct(F.lit("contract.source.partition").alias("key"), F.lit("none").cast("binary").alias("value"))).alias("headers"),
    )
    judged = K.judged(rows, Q.EVENTS)
    header = lambda name: F.element_at(F.filter("headers", lambda h: h["key"] == name), -1)["value"].cast("string")
    tell = lambda df: df.select(header("id").cast("long").alias("event_id"), "topic", F.col("key").cast("string").alias("key"), header("contract.source.partition").alias("origin"))
    clean, dead = tell(K.clean(judged, "clean")), tell(K.dead_letters(judged, Q.EVENTS, "dead"))
    return clean.withColumn("origin", F.pmod("event_id", F.lit(7)).cast("string")).union(dead)


# --- profiles and drafts -----------------------------------------------------


_GROUPED = {"l_quantity": {"type": "float"}, "l_returnflag": {"type": "string", "allowed": ("A", "N")}}


def _grouped_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PT.of_groups(Source(_table(spark, sf_dir, "lineitem"), "columns", "l"), Contract("l", "1.0.0", {"l": _model(**_GROUPED)}), "l_linenumber")


def _partials(by: str) -> str:
    """The rows of profile tables in SQL, of each group or (by empty) of all."""
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    row = lambda f, part, item, n, more="NULL::DOUBLE AS least, NULL::DOUBLE AS most, NULL::DOUBLE AS total": f"SELECT {key}'{f}' AS field, '{part}' AS part, '{item}' AS item, CAST({n} AS BIGINT) AS n, {more} FROM lineitem {group}"
    stats = lambda x: f"CAST(min({x}) AS DOUBLE) AS least, CAST(max({x}) AS DOUBLE) AS most, CAST(sum({x}) AS DOUBLE) AS total"
    rows = [row(f, "counter", c, n) for f in _GROUPED for c, n in (("rows", "count(*)"), ("present", "count(*)"), ("nulls", f"count(*) - count({f})"), ("invalid", "count(*) FILTER (WHERE false)"))]
    rows += [row("l_quantity", "counter", "non_finite", "count(*) FILTER (WHERE false)"), row("l_quantity", "numbers", "", "count(l_quantity)", stats("l_quantity"))]
    rows += [row("l_returnflag", "counter", "empty", "count(*) FILTER (WHERE l_returnflag = '')"), row("l_returnflag", "lengths", "", "count(l_returnflag)", stats("length(l_returnflag)"))]
    rows += [row("l_returnflag", "category", v, f"count(*) FILTER (WHERE l_returnflag = '{v}')") for v in ("A", "N")]
    return " UNION ALL ".join([*rows, row("l_returnflag", "other", "", "count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N'))")])


@query(_partials("l_linenumber"))
def profile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all groups of a table as rows: counters, numbers, lengths, categories."""
    rows = _grouped_profiles(spark, sf_dir)
    return rows.where(~F.col("part").isin("sketch", "histogram")).select("l_linenumber", "field", "part", "item", "n", "least", "most", "total")


@query(f"SELECT * FROM ({_partials('')}) UNION ALL SELECT 'l_quantity', 'distinct', '', count(DISTINCT l_quantity), NULL, NULL, NULL FROM lineitem UNION ALL SELECT 'l_returnflag', 'distinct', '', count(DISTINCT l_returnflag), NULL, NULL, NULL FROM lineitem")
def profiles_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' profiles merged by one aggregate: that of the whole table, distinct values (so few that sketches are exact) too."""
    rows = PT.merge(_grouped_profiles(spark, sf_dir))
    told = rows.where(~F.col("part").isin("sketch", "histogram")).select("field", "part", "item", "n", "least", "most", "total")
    few = PT.distinct(rows).select("field", F.lit("distinct").alias("part"), F.lit("").alias("item"), F.col("distinct").alias("n"))
    return told.unionByName(few, allowMissingColumns=True)


@query("""WITH t AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS k FROM orders WHERE o_orderstatus IN ('F', 'O')),
 c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(k) AS nk FROM t GROUP BY ALL),
 s AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN k IN (0, 1) THEN k::VARCHAR ELSE '' END AS v, count(*) AS m FROM t WHERE k IS NOT NULL GROUP BY ALL),
 p AS (SELECT s.o_orderpriority, v, sum(CASE WHEN s.o_orderstatus = 'F' THEN m / nk ELSE 0 END) AS p, sum(CASE WHEN s.o_orderstatus = 'O' THEN m / nk ELSE 0 END) AS q FROM s JOIN c USING (o_orderpriority, o_orderstatus) GROUP BY ALL),
 f AS (SELECT a.o_orderpriority, (a.n - a.nk) / a.n AS x, (b.n - b.nk) / b.n AS y FROM c a JOIN c b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')
 SELECT o_orderpriority, 'k' AS field, 'null_rate' AS metric, round(x, 6) AS baseline, round(y, 6) AS current, round(abs(y - x), 6) AS score FROM f
 UNION ALL SELECT o_orderpriority, 'k', m, 0.0, 0.0, 0.0 FROM f, (VALUES ('missing_rate'), ('invalid_rate')) AS z(m)
 UNION ALL SELECT o_orderpriority, 'k', 'categories', NULL, NULL, round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END)), 6) FROM p GROUP BY 1""")
def drift_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between two profile tables, group by group, by a full outer join of their rows."""
    k = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5).cast("long").alias("k")
    c = Contract("o", "1.0.0", {"o": _model(k={"type": "integer", "allowed": (0, 1)})})
    side = lambda s: PT.of_groups(Source(_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select("o_orderpriority", k), "columns", s), c, "o_orderpriority")
    found = PT.rates(side("F"), side("O"), "o_orderpriority")
    return found.select("o_orderpriority", "field", "metric", *[F.round(x, 6).alias(x) for x in ("baseline", "current", "score")])


@query("""WITH x AS (SELECT 'l_partkey' AS field, floor(log2(l_partkey)) AS octave, count(DISTINCT l_partkey) OVER () AS d FROM lineitem WHERE l_partkey > 0)
 SELECT field, CAST(octave AS INTEGER) AS octave, count(*) AS n, 0 AS off FROM x GROUP BY ALL""")
def profile_sketch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of three parts, merged: the histogram's octaves, and by how many times 5 % the union of sketches is off the exact number."""
    df = _table(spark, sf_dir, "lineitem").where("l_partkey > 0")
    c = Contract("l", "1.0.0", {"l": _model(l_partkey={"type": "integer"})})
    parts = [P.profile_source(spark, Source(df.where(F.pmod("l_orderkey", F.lit(3)) == k), "columns", "part"), c) for k in range(3)]
    f = P.merge(spark, P.merge(spark, parts[0], parts[1]), parts[2]).fields["l_partkey"]
    exact = df.agg(F.count_distinct("l_partkey")).first()[0]
    octaves: dict[int, int] = {}
    for x, n in P.ordered(f.histogram):
        octaves[math.frexp(x)[1] - 1] = octaves.get(math.frexp(x)[1] - 1, 0) + n
    off = int(abs(f.distinct / exact - 1) / 0.05)
    return spark.createDataFrame([("l_partkey", k, n, off) for k, n in octaves.items()], "field string, octave int, n long, off int")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(s_acctbal) AS DOUBLE) AS least, CAST(max(s_acctbal) AS DOUBLE) AS most FROM supplier")
def profile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile written as a file and read back."""
    c = Contract("s", "1.0.0", {"s": _model(s_acctbal={"type": "float"})})
    p = P.Profile.parse(P.profile_source(spark, Source(_table(spark, sf_dir, "supplier"), "columns", "s"), c).to_json())
    n = p.fields["s_acctbal"].numbers
    return spark.createDataFrame([(n["count"], n["min"], n["max"])], "n long, least double, most double")


@query("SELECT 'o_orderkey' AS field, 'integer' AS type, NULL AS allowed, CAST(min(o_orderkey) AS DOUBLE) AS least, CAST(max(o_orderkey) AS DOUBLE) AS most FROM orders "
       "UNION ALL SELECT 'o_totalprice', 'float', NULL, min(o_totalprice), max(o_totalprice) FROM orders UNION ALL SELECT 'o_orderstatus', 'string', string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), NULL, NULL FROM orders "
       "UNION ALL SELECT 'o_orderdate', 'timestamp', NULL, NULL, NULL UNION ALL SELECT 'o_orderpriority', 'string', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), NULL, NULL FROM orders "
       "UNION ALL SELECT 'o_custkey', 'integer', NULL, CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM orders")  # fmt: skip
def infer_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract drafted from all rows: types, closed sets, bounds."""
    found = infer.infer(spark, f"{sf_dir}/orders.parquet", sample=0).contract.models["orders"].fields
    number = lambda x: None if x is None else float(x)
    rows = [(n, f.type, None if f.allowed is None else ",".join(f.allowed), number(f.min), number(f.max)) for n, f in found.items()]
    return spark.createDataFrame(rows, "field string, type string, allowed string, least double, most double")


# --- metadata ----------------------------------------------------------------


@query("""WITH b AS (SELECT replace(p_brand, '#', '_') AS f, bool_or(p_size > 45) AS has, bool_or(p_size = 1) AS old FROM part GROUP BY 1)
 SELECT 'error' AS level, 'fields.' || f AS place FROM b WHERE NOT has UNION ALL SELECT 'warning', 'fields.' || f FROM b WHERE has AND old UNION ALL SELECT 'error', 'verified'""")
def consumer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer's manifest against the contract, a field for each brand of parts: fields that are gone, deprecated ones, a pin behind a break."""
    brands = _table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_brand", "#", "_").alias("f")).agg(F.bool_or(F.col("p_size") > 45).alias("has"), F.bool_or(F.col("p_size") == 1).alias("old")).orderBy("f").collect()  # a row a brand
    fields = {r["f"]: Field("string", deprecated="use another" if r["old"] else None) for r in brands if r["has"]}
    c = Contract("c", "2.0.0", {"m": Model(fields)}, owner="t")
    m = consumers.parse(f"consumer: 1\nid: dash\nconsumes: [{{contract: c, fields: [{', '.join(r['f'] for r in brands)}], verified: 1.4.0}}, {{contract: other, fields: [x]}}]\n")
    at = lambda path: path.split(".", 1)[1] if "." in path else path
    return spark.createDataFrame([(f.level, at(f.path)) for f in consumers.verify(m, c)], "level string, place string")


@query(f"""WITH s AS ({Q._SEGMENTS}), t AS (SELECT o, CASE WHEN len(n) = 0 THEN 2 WHEN {Q._ADDED} THEN 1 ELSE 0 END AS r FROM s WHERE len(o) > 0)
 SELECT n_name AS consumer, CASE max(r) WHEN 2 THEN 'breaking' ELSE 'risky' END AS severity FROM nation JOIN t ON list_contains(o, n_nationkey) GROUP BY 1 HAVING max(r) > 0""")
def consumers_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers that the changes of a version reach, by their manifests: each nation reads the segments of its customers."""
    old, new, sets = Q._segment_contracts(spark, sf_dir)
    reads = {r["n_name"]: [s["c_mktsegment"] for s in sets if r["n_nationkey"] in s["o"]] for r in _table(spark, sf_dir, "nation").collect()}
    ms = [consumers.parse(f"consumer: 1\nid: {name}\nconsumes: [{{contract: c, fields: [{', '.join(fs)}]}}]\n") for name, fs in reads.items() if fs]
    r = consumers.annotate(D.diff(old, new), old, new, ms)
    return spark.createDataFrame([(i["consumer"], i["severity"]) for i in r.impacted], "consumer string, severity string")


_STANDARD = """
apiVersion: v3.0.2
kind: DataContract
id: orders
version: 1.0.0
status: active
schema:
  - name: orders
    properties:
      - {name: o_orderkey, logicalType: integer, required: true, unique: true, logicalTypeOptions: {minimum: 1}}
      - {name: o_orderpriority, logicalType: string, logicalTypeOptions: {pattern: '^[1-3]-', maxLength: 10}}
      - {name: o_totalprice, logicalType: number, logicalTypeOptions: {minimum: 2000, maximum: 400000}}
"""


@query("SELECT * FROM (" + _union(
    ("o_totalprice", "min", _where("o_totalprice < 2000")), ("o_totalprice", "max", _where("o_totalprice > 400000")), ("o_orderpriority", "pattern", _where("NOT regexp_matches(o_orderpriority, '^[1-3]-')")),
    ("o_orderpriority", "max_length", _where("length(o_orderpriority) > 10")), ("o_orderkey", "min", _where("o_orderkey < 1")), table="orders") + ") WHERE violations > 0")
def check_standard_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the open standard, compiled to the same rules."""
    return _told(spark, C.check(spark, _table(spark, sf_dir, "orders"), parse(_STANDARD), samples=False))


@query("SELECT CASE r_regionkey WHEN 0 THEN 'error' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'pass' ELSE 'fail' END AS outcome, CAST(count(*) AS INTEGER) AS n FROM region GROUP BY 1")
def conformance_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of conformance vectors, one a region: unreadable, with a rule that isn't enforced, as expected, not as expected."""
    doc = "apiVersion: v3.0.2\nkind: DataContract\nid: v\nversion: 1.0.0\nstatus: active\nschema: [{{name: m, properties: [{{name: k, logicalType: integer, logicalTypeOptions: {{{0}}}}}]}}]\n"
    keys = [r[0] for r in _table(spark, sf_dir, "region").select("r_regionkey").collect()]
    contract = lambda k: "kind: nothing" if k == 0 else doc.format("multipleOf: 2" if k == 1 else f"minimum: {k}")
    outcomes = [conformance.run(spark, {"contract": contract(k), "records": [{"k": 2}], "expect": {"verdict": "pass"}})[0] for k in keys]
    return spark.createDataFrame([(o, outcomes.count(o)) for o in dict.fromkeys(outcomes)], "outcome string, n int")
