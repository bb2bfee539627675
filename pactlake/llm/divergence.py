"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

A term is a run of letters and non-ASCII characters. Every task counts the terms of its documents in DuckDB, a batch
at a time, so that a term moves once a task and group. Shards by hash of language and term merge the counts and keep
the terms of enough documents; a second pass over the shards' terms computes, again in SQL, partial sums for pairs of sources
and the best terms of each group. Spark adds up the partial sums and ranks.

Most terms are absent from most sources, so a pair's sum over all kept terms is put together from what differs from absence:
with f0 the value of a term that neither has, the sum is V * f0, and for each source, by distinct counts, what its own terms
add if the other lacks them, and for terms that both have the correction to that. Only the last needs pairs, of sources within a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, small_batches, table

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Fixed value: the unit of the integer frequencies.
UNIT = 1_000_000_000
#: Bytes of texts counted at once, rows of counts after which a task merges them, rows of counts that a shard compares at once.
BATCH_BYTES, MERGE_ROWS, SHARD_ROWS = 1 << 20, 1 << 19, 1 << 17

_COUNTS = T.StructType().add("lang", "string").add("source", "string").add("term", "string").add("n", "long").add("docs", "long")
_PARTIAL = T.StructType().add("part", "string").add("lang", "string").add("source", "string").add("item", "string").add("value", "long")

#: Terms of a batch of documents: of each document once, then by group. The empty term marks that a group occurs.
_COUNT_BATCH = r"""
INSERT INTO counts
WITH words AS (
  SELECT place, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM arrived),
of_document AS (SELECT place, lang, source, term, count(*) AS n FROM words GROUP BY ALL)
SELECT lang, source, term, sum(n), count(*) FROM of_document GROUP BY ALL
UNION ALL SELECT lang, source, '', 0, 0 FROM arrived GROUP BY ALL
"""
_MERGE = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"
_KEEP = f"""
WITH merged AS ({_MERGE}), kept AS (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS in_documents FROM merged)
SELECT lang, source, term, n, docs FROM kept WHERE in_documents >= {{least}} OR term = ''
"""
#: Rows: lang, source, term, n, of the group its total and absent frequency p0, of the language its total and V.
_COMPARE = f"""
WITH p AS (
  SELECT *, 1 + ({UNIT}::HUGEINT * (n + 2)) // (total + 2 * v) AS p,
    1 + ({UNIT}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (lang_total + 2 * v) AS q FROM counts),
both_have AS (
  SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q, a.p0, b.p0 AS q0
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source),
terms AS (
  SELECT lang, source, term, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {{top}})
SELECT 'pair' AS part, lang, source, item,
  CAST(sum(((p - q) * (p - q)) // (p + q) - ((p - q0) * (p - q0)) // (p + q0) - ((p0 - q) * (p0 - q)) // (p0 + q) + ((p0 - q0) * (p0 - q0)) // (p0 + q0)) AS BIGINT) AS value
FROM both_have GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, CAST(value AS BIGINT) FROM terms
"""


def _database(schema: T.StructType):
    """An in-memory database of one task, of one thread, with an empty table `counts`."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1})
    kinds = {"string": "VARCHAR", "bigint": "BIGINT"}
    db.execute(f"CREATE TABLE counts ({', '.join(f'{f.name} {kinds[f.dataType.simpleString()]}' for f in schema)})").fetchall()
    return db


def _result(db, sql: str, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in db.sql(sql).to_arrow_table().to_batches(16384):
        yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in kinds], schema=kinds)


def _insert(db, sql: str, rows: pa.Table) -> None:
    db.register("arrived", rows)
    db.execute(sql).fetchall()
    db.unregister("arrived")


def _held(db) -> int:
    return db.execute("SELECT count(*) FROM counts").fetchall()[0][0]


def _slices(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_BYTES of texts, one row at least."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if held + n > BATCH_BYTES and k > at:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _count_terms(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """_COUNTS of each task's documents."""
    small_batches(docs.sparkSession)
    whole = lambda c: F.make_valid_utf8(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    lean = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).alias("text")).withColumn("size", F.octet_length("text"))
    kinds = to_arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database(_COUNTS)
        for whole_batch in batches:
            for part in _slices(whole_batch, whole_batch.column("size").to_pylist()):
                numbered = pa.Table.from_batches([part]).append_column("place", pa.array(range(part.num_rows), pa.int32()))
                _insert(db, _COUNT_BATCH, numbered)
            if _held(db) > MERGE_ROWS:
                db.execute(f"CREATE OR REPLACE TABLE counts AS {_MERGE}").fetchall()
                if _held(db) > MERGE_ROWS // 2:  # shards merge the rest
                    yield from _result(db, "SELECT * FROM counts", kinds)
                    db.execute("DELETE FROM counts").fetchall()
        yield from _result(db, _MERGE, kinds)
        db.close()

    return lean.mapInArrow(run, _COUNTS)


def _by_terms(df: DataFrame, schema: T.StructType, sql: str, out: T.StructType) -> DataFrame:
    """Runs SQL over the shards of df (by lang and term), a run of whole terms of about SHARD_ROWS rows at a time."""
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database(schema)
        add = lambda rows: _insert(db, "INSERT INTO counts SELECT * FROM arrived", pa.Table.from_batches([rows]))
        held, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows, at = batch.column("__h").to_numpy(), batch.select(schema.names), 0
            if held >= SHARD_ROWS:  # up to the end of the last term
                at = int((keys != last).argmax()) if keys[-1] != last else len(keys)
                if at:
                    add(rows.slice(0, at))
                if at < len(keys):
                    yield from _result(db, sql, kinds)
                    db.execute("DELETE FROM counts").fetchall()
                    held = 0
            if at < len(keys):
                add(rows.slice(at))
            held += len(keys) - at
            last = keys[-1]
        if held:
            yield from _result(db, sql, kinds)
        db.close()

    # a hash brings the rows of a term together as well as the term does, and sorts by its bits
    keyed = df.repartition("lang", "term").select(*schema.names, F.xxhash64("lang", "term").alias("__h"))
    return keyed.sortWithinPartitions("__h").mapInArrow(run, out)


def _share(n: Column, total: Column, v: Column) -> Column:
    """The integer frequency of a count; null where the language keeps no term."""
    whole = F.lit(UNIT).cast("decimal(12,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", whole, F.nullif(total + 2 * v, F.lit(0)).cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language, by the divergence of
    the sources' frequencies over all kept terms. Part `term`: the `top` terms by which a group stands out most from its language.

    Null text, lang and source count as empty; every row is a document, repeated ones too. A group without terms is
    paired like any other; a language without kept terms has pairs of value 0. Equal values rank by the item's UTF-8. No documents give
    no rows. Other columns don't matter.
    """
    kept = materialize(_by_terms(_count_terms(docs, lang, source, text), _COUNTS, _KEEP.format(least=int(least_documents)), _COUNTS))
    of_lang = Window.partitionBy("lang")
    # rows of groups and languages, not of terms
    vocabulary = kept.where(F.col("term") != "").select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).withColumn("lang_total", F.sum("total").over(of_lang))
    groups = groups.join(vocabulary, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    groups = materialize(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"))))
    sized = kept.where((F.col("term") != "") & (F.col("n") > 0)).drop("docs").join(groups, ["lang", "source"])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sized.schema])
    partial = materialize(_by_terms(sized, schema, _COMPARE.format(top=int(top)), _PARTIAL))

    # what a source's own terms add where the other one lacks them, by distinct counts
    counts = sized.groupBy("lang", "source", "n", "total", "v", "p0").agg(F.count(F.lit(1)).alias("times"))
    own = counts.withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))).select("lang", "source", "p", "p0", "times")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    p, q0, p0 = F.col("p"), F.col("q0"), F.col("p0")
    alone = (
        own.join(others, "lang").where(F.col("source") != F.col("item"))
        .groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"))
        .agg(F.sum(F.col("times") * (_apart(p, q0) - _apart(p0, q0))).alias("value"))
    )
    both = partial.where(F.col("part") == "pair").select("lang", "source", "item", "value")
    pairs = groups.select("lang", "source", "p0", "v").join(others, "lang").where(F.col("source") < F.col("item"))
    neither = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * _apart(p0, q0), F.lit(0)).alias("value"))
    summed = neither.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    each_way = summed.unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    terms = partial.where(F.col("part") == "term").select("lang", "source", "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = each_way.withColumn("rank", place).withColumn("part", F.lit("pair")).select(*columns)
    best = terms.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*columns)
    return ranked.unionByName(best)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
