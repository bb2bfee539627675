"""Rows of Spark's Kafka source as rows of its sink: clean records as they came, dead letters with their origin.

The connector itself (spark-sql-kafka) is the deployment's to add; these are plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Contract
from .gate import MAX_BYTES, REFUSE, BatchJudge, envelope, judge

HEADERS = T.ArrayType(T.StructType().add("key", "string").add("value", "binary"))
PREFIX = "contract.source"


def judged(source: DataFrame, contract: Contract, model: str | None = None, unique: str = REFUSE) -> DataFrame:
    """Kafka rows with violations and verdict; a tombstone (null value) passes unjudged."""
    return judge(source, contract, model, unique, "value")


def clean(rows: DataFrame, topic: str) -> DataFrame:
    """key, value, headers and timestamp of what passes, byte for byte, for the topic. A record over the
    size limit is never forwarded, not even under policy warn."""
    ok = rows.where((F.col("verdict") != "block") & (F.col("value").isNull() | (F.octet_length("value") <= MAX_BYTES)))
    return ok.select("key", "value", F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "timestamp", F.lit(topic).alias("topic"))


def dead_letters(rows: DataFrame, contract: Contract, topic: str, model: str | None = None) -> DataFrame:
    """key, envelope and headers of what doesn't pass, with the topic, partition and offset it came from."""
    name, _ = contract.model(model)
    origin = [
        F.struct(F.lit(f"{PREFIX}.{c}").alias("key"), F.col(c).cast("string").cast("binary").alias("value")) for c in ("topic", "partition", "offset")
    ]
    headers = F.concat(F.coalesce("headers", F.array().cast(HEADERS)), F.array(*origin).cast(HEADERS))
    bad = rows.where(F.col("verdict") != "pass")
    return bad.select("key", envelope(contract, name).cast("binary").alias("value"), headers.alias("headers"), F.lit(topic).alias("topic"))


def refused_partitions(rows: DataFrame) -> DataFrame:
    """(topic, partition, refused): whether a batch holds any blocked record, for gates that take or
    refuse a partition's batch as a whole."""
    return rows.groupBy("topic", "partition").agg(F.bool_or(F.col("verdict") == "block").alias("refused"))


class SentMarks:
    """Of each batch and output the offsets that were sent, as the highest one of each topic and partition, in a folder beside
    the checkpoint. A batch that failed after an output was sent runs again, and sends there only what lies beyond."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, number: int, output: str) -> str:
        return f"{self.folder}/batch={number}/{output}"

    def unsent(self, number: int, output: str, rows: DataFrame) -> DataFrame:
        at = self._at(number, output)
        if not self.store.exists(self.path(f"{at}/_SUCCESS")):
            return rows
        marks = self.spark.read.parquet(at)  # a row a partition of the topics
        return rows.join(F.broadcast(marks), ["topic", "partition"], "left").where(F.col("offset") > F.coalesce("__sent", F.lit(-1))).drop("__sent")

    def sent(self, number: int, output: str, rows: DataFrame) -> None:
        marks = rows.groupBy("topic", "partition").agg(F.max("offset").alias("__sent"))
        marks.coalesce(1).write.mode("overwrite").parquet(self._at(number, output))

    def forget_before(self, number: int) -> None:
        if self.store.exists(self.path(self.folder)):
            for x in self.store.listStatus(self.path(self.folder)):
                name = x.getPath().getName()
                if name.startswith("batch=") and int(name.removeprefix("batch=")) < number:
                    self.store.delete(x.getPath(), True)


def gate(source: DataFrame, contract: Contract, brokers: str, to: str, dlq: str, checkpoint: str, model: str | None = None, unique: str = REFUSE, trigger: dict | None = None, stats: str | None = None, sink: str = "kafka"):
    """Starts the gate from a Kafka stream to two topics. Offsets are committed to the checkpoint after
    both writes; what was sent is marked after each, so a batch that fails between them and runs again sends nothing twice. Only a write that
    fails half-way leaves records that are sent again. TRACK keeps the keys seen beside the checkpoint. Returns (query, GateStats of this run)."""
    judges = BatchJudge(source.sparkSession, contract, checkpoint, model, unique, "value", stats)
    marks = SentMarks(source.sparkSession, f"{checkpoint.rstrip('/')}-sent")

    def route(batch: DataFrame, number: int) -> None:
        marks.forget_before(number)
        with judges.batch(batch, number) as rows:
            for output, shaped in (("clean", lambda r: clean(r, to)), ("dead", lambda r: dead_letters(r, contract, dlq, model))):
                send(shaped(marks.unsent(number, output, rows)), brokers, sink)
                marks.sent(number, output, rows)

    writer = source.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(), judges.totals


def send(rows: DataFrame, brokers: str, sink: str = "kafka") -> None:
    """Appends rows to their topics; sink: another format that takes the same columns, with a folder as brokers."""
    writer = rows.write.mode("append").format(sink)
    if sink == "kafka":
        writer.option("kafka.bootstrap.servers", brokers).save()
    else:
        writer.partitionBy("topic").save(brokers)
