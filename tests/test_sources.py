"""Row numbers, files and ragged lines of every source; many files in one job; all unique fields in one pass."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from pactlake.operators import check as C
from pactlake.plans import rules as R
from pactlake.plans.spec import Field, Model, parse
from pactlake.sources.read import FILE, ROW, plain_path, read


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written_csv(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([("a", "b"), *rows])
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("breaks", [False, True])
def test_csv_records_in_order_over_splits_and_files(spark, tmp_path, small_splits, end, breaks):
    random.seed(7)
    folder, want = tmp_path / "in.csv", []
    folder.mkdir()
    for k in range(3):
        text = lambda: random.choice(["plain", 'q"uo"te', "x, y", "é" * random.randint(1, 40)]) + (random.choice(["", "\n", "\n\n,\"", '"\n"' * 30, "l\n" * 500]) if breaks and random.random() < 0.3 else "")
        rows = [(str(k * 1000 + j), text() + "|") for j in range(random.choice((1, 90, 200)))]
        written_csv(folder / f"{k}.csv", rows, end)
        want += [(len(want) + j, f"{k}.csv", *r) for j, r in enumerate(rows)]
    source = read(spark, str(folder), rows=True)
    assert source.frame.rdd.getNumPartitions() > 3
    got = sorted((r[ROW], r[FILE].rpartition("/")[2], r["a"], r["b"]) for r in source.frame.collect())
    assert got == want
    assert read(spark, str(folder)).frame.count() == len(want)


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "line of words\n" * 400
    written_csv(tmp_path / "a.csv", [("1", "x"), ("2", long), ("3", "y"), ("4", long + '"'), ("5", "z")])
    rows = sorted((r[ROW], r["a"], r["b"]) for r in read(spark, str(tmp_path / "a.csv"), rows=True).frame.collect())
    assert rows == [(0, "1", "x"), (1, "2", long), (2, "3", "y"), (3, "4", long + '"'), (4, "5", "z")]


def test_samples_of_csv_in_several_splits(spark, tmp_path, small_splits):
    written_csv(tmp_path / "a.csv", [(str(k), "y" if k % 500 == 499 else "x") for k in range(3000)])
    contract = parse("contract: 1\nid: t\nversion: 1.0.0\nmodels: {t: {fields: {a: {type: integer}, b: {type: string, allowed: [x]}}}}")
    report = C.check(spark, str(tmp_path / "a.csv"), contract)
    assert [s.row for s in report.samples] == [499, 999, 1499, 1999, 2499, 2999] and all(s.file.endswith("a.csv") for s in report.samples)
    assert report.to_dict()["samples"][0]["file"].endswith("a.csv")


@pytest.mark.parametrize("breaks", [False, True])
def test_ragged_lines_are_mismatches(spark, tmp_path, breaks):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n\n7,x\n" + ('8,"9\n"\n' if breaks else "8,9\n"))
    contract = parse("contract: 1\nid: t\nversion: 1.0.0\nmodels: {t: {fields: {a: {type: integer, required: true, unique: true}, b: {type: string, required: true}}}}")
    report = C.check(spark, str(tmp_path / "a.csv"), contract)
    assert report.rows == 5 and report.per_rule == [(None, "type_mismatch", 2)]
    assert [(s.row, s.value) for s in report.samples] == [(1, "3"), (2, "4,5,6")]


def test_ragged_lines_where_no_column_is_declared(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    m = Model({"c": Field("string")})
    assert {(r["rule"], r["violations"]) for r in C.counts_frame(*C.bind(m, read(spark, str(tmp_path / "a.csv")))).collect()} == {("type_mismatch", 1)}


def test_rows_of_frames_and_folders(spark, tmp_path):
    frame = spark.range(0, 1000, 1, 7).where("id % 3 != 1")
    got = [r[ROW] for r in read(spark, frame, rows=True).frame.orderBy("id").collect()]
    assert got == list(range(len(got)))
    folder = str(tmp_path / "p.parquet")
    spark.range(0, 97, 1, 4).write.parquet(folder)
    got = [(r[ROW], r[FILE]) for r in read(spark, folder, rows=True).frame.orderBy("id").collect()]
    assert [n for n, _ in got] == list(range(97)) and len({f for _, f in got}) == 4
    assert [f for _, f in got] == sorted(f for _, f in got)


def test_samples_of_equal_files(spark, tmp_path):
    folder = str(tmp_path / "p.parquet")
    for _ in range(2):
        spark.range(5).coalesce(1).write.mode("append").parquet(folder)
    contract = parse("contract: 1\nid: t\nversion: 1.0.0\nmodels: {t: {fields: {id: {type: integer, unique: true}}}}")
    report = C.check(spark, folder, contract)
    assert report.violations == 5 and [(s.row, s.value) for s in report.samples] == [(5 + k, str(k)) for k in range(5)]


def test_samples_of_a_hot_key_are_the_first_ones(spark):
    frame = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    contract = parse("contract: 1\nid: t\nversion: 1.0.0\nmodels: {t: {fields: {k: {type: integer, unique: true}}}}")
    report = C.check(spark, frame, contract)
    assert report.violations == 6666 and [s.row for s in report.samples] == [3 * k for k in range(1, 11)]


def test_unique_fields_share_one_pass(spark):
    fields = {f"u{k}": Field("integer" if k % 2 else "string", unique=True) for k in range(5)}
    df = spark.range(1000).select(*[(F.col("id") % (k + 2)).cast("long" if k % 2 else "string").alias(f"u{k}") for k in range(5)], F.lit(0.0).alias("z"))
    compiled = R.compile_columns(Model(fields), df.schema)
    found = C.duplicates(df, compiled.unique)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Range (") == 1
    assert {r["field"]: r["violations"] for r in found.collect()} == {f"u{k}": 1000 - (k + 2) for k in range(5)}


MANY = """
contract: 1
id: m
version: 1.0.0
models:
  t:
    strict: true
    fields:
      id: {type: integer, required: true, unique: true, max: 5}
      s: {type: string, unique: true, allowed: [a, b]}
policy: {max_violations: 3, sample_violations: 2}
"""


@pytest.mark.parametrize("kind", ["ndjson", "parquet", "csv"])
def test_many_files_together_are_as_one_by_one(spark, tmp_path, kind):
    paths = []
    for k in range(8):
        rows = [{"id": j, "s": "abc"[j % (k % 3 + 1)]} | ({"extra": 1} if k == 5 else {}) for j in range(k * 2 if k != 3 else 0)]
        p = tmp_path / f"f {k}.{kind}"
        if kind == "ndjson":
            p.write_text("".join(json.dumps(r) + "\n\n" for r in rows))
        elif kind == "csv":
            p.write_text("id,s" + (",extra" if k == 5 else "") + "\n" + "".join(",".join(map(str, r.values())) + "\n" for r in rows) + ("1\n" if k == 6 else ""))
        else:
            import pandas as pd

            pd.DataFrame(rows, columns=["id", "s", *(["extra"] if k == 5 else [])]).astype({"id": "int64", "s": "string"}).to_parquet(p)
        paths.append(str(p))
    own = lambda r: {**r.to_dict(), "samples": [{**s, "file": s.get("file") and plain_path(s["file"])} for s in r.to_dict()["samples"]]}
    together, passed = C.check_all(spark, [*paths, paths[4]], MANY)
    assert not passed and [own(r) for r in together] == [own(C.check(spark, p, MANY)) for p in [*paths, paths[4]]]


def test_hundreds_of_files_are_few_jobs(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.ndjson").write_text(f'{{"id": {k % 7}, "s": "a"}}\n')
    spark.sparkContext.setJobGroup("many", "many")
    reports, _ = C.check_all(spark, [str(tmp_path / f"{k}.ndjson") for k in range(300)], MANY)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many"))
    spark.sparkContext.setJobGroup("other", "other")
    assert len(reports) == 300 and sum(r.violations for r in reports) == sum(k % 7 > 5 for k in range(300)) and jobs < 40


def _most_memory(spark, run) -> float:
    """MB that the tasks of one stage of run() took at most, together."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()))}
    before = set(stages())
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return max(s.peakExecutionMemory() for k, s in stages().items() if k not in before) / 1e6


def test_samples_of_many_files_take_little_memory(spark, tmp_path):
    for k in range(2):
        spark.range(600_000).selectExpr("id % 9 AS id", "cast(id % 1000 AS string) AS s").coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    paths = [p for k in range(2) for p in spark.read.parquet(str(tmp_path / f"{k}")).inputFiles()]
    contract = MANY.replace("max: 5", "max: 9").replace(", allowed: [a, b]", "")
    found: list = []
    assert _most_memory(spark, lambda: found.extend(C.check_all(spark, paths, contract)[0])) < 300
    assert [[(s.field, s.row) for s in r.samples] for r in found] == [[("id", 9), ("id", 10), ("s", 1000), ("s", 1001)]] * 2


def test_a_file_of_a_status_is_written_unsorted(spark):
    from pactlake.plans.queries import QUERIES

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    QUERIES["many_files"](spark, "/root/testdata/sf0.001")
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList(before, 1000))]
    written = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p]
    assert len(written) == 1 and "Sort" not in written[0]


def test_larger_tables_are_sorted_into_more_files(spark, tmp_path, monkeypatch):
    from pactlake.plans import queries as Q

    got = {}
    for rows in (1_000_000, 100):
        monkeypatch.setattr(Q, "SORTED_ROWS", rows, raising=False)
        monkeypatch.setattr(Q, "_own_folder", lambda s, kind, at=tmp_path / str(rows): f"{at}.{kind}")
        got[rows] = sorted(map(tuple, Q.samples_over_files(spark, "/root/testdata/sf0.001").collect()))
    files = {n: len(list((tmp_path / f"{n}.parquet").glob("*.parquet"))) for n in got}
    assert got[100] == got[1_000_000] and files[1_000_000] == 4 and files[100] == 15


@pytest.mark.parametrize("by_file", [False, True])
@pytest.mark.parametrize("fields", [["u"], ["u", "v", "w", "x"]])
def test_samples_of_later_copies_in_blocks(spark, monkeypatch, by_file, fields):
    monkeypatch.setattr(C, "BLOCK_BITS", 3)
    # copies late and far apart, a hot key, runs of one key, copies in another file alone
    rows = [(f"f{n // 500}", n, n if n < 400 or n % 90 else n - 300, 7.0 if n % 3 else float(n), str(n // 40), n % 500) for n in range(1000)]
    frame = spark.createDataFrame(rows, f"{FILE} string, {ROW} long, u long, v double, w string, x long").repartition(5)
    kinds = {"u": "integer", "v": "float", "w": "string", "x": "integer"}
    compiled = R.compile_columns(Model({n: Field(kinds[n], unique=True) for n in fields}), frame.select("u", "v", "w", "x").schema)
    got = {(fields[r["k"] - len(compiled.rules)], r["row"], r["file"], r["text"]) for r in C.sample_rows(frame, compiled, set(), set(fields), 4, by_file).collect()}
    want = set()
    for n in fields:
        seen: set = set()
        taken: dict = {}
        for r in rows:
            value, file = r[2 + "uvwx".index(n)], r[0] if by_file else None
            if (file, value) in seen and taken.setdefault(file, 0) < 4:
                taken[file] += 1
                want.add((n, r[1], r[0], str(value)))
            seen.add((file, value))
    assert got == want and {n for n, *_ in got} == set(fields) - ({"x"} if by_file else set())


def test_sets_of_values_from_tables(spark, tmp_path):
    df = spark.range(0, 5000, 1, 4).select((F.col("id") % 1000).alias("a"), F.when(F.col("id") % 3 == 0, F.lit("x")).when(F.col("id") % 3 == 1, F.lit("y")).alias("b"))
    contract = parse("contract: 1\nid: t\nversion: 1.0.0\nmodels: {t: {fields: {a: {type: integer}, b: {type: string}, c: {type: string}}}}\npolicy: {sample_violations: 3}")
    sets = {"a": spark.range(990).withColumn("more", F.lit(1)), "b": spark.createDataFrame([("x",), ("x",), (None,)], "v string"), "c": spark.range(1)}
    report = C.check(spark, df, contract, sets=sets)
    assert report.per_rule == [("a", "allowed", 50), ("b", "allowed", 1667)]
    assert [(s.field, s.row, s.value) for s in report.samples] == [("a", 990, "990"), ("a", 991, "991"), ("a", 992, "992"), ("b", 1, "y"), ("b", 4, "y"), ("b", 7, "y")]
    assert C.check(spark, df.where("a < 5"), contract, sets={"a": spark.range(9)}).passed
    with pytest.raises(ValueError, match="lacks"):
        C.check(spark, df, contract, sets={"z": spark.range(1)})
