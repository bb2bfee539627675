"""What the operators of this subpackage share: tables, shared storage, Arrow passes over texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_own_folder: dict[str, str] = {}
#: Folders of the steps written by this process, oldest first.
_steps: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset on one
    machine (as in tests), a temporary folder of this process. On a cluster it must be set."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own_folder:
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder["dir"] = "file://" + folder
    return _own_folder["dir"]


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: cuts the lineage, survives lost
    executors, keeps column statistics. The step stays until drop_steps(), or own_steps(), deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _steps.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def _delete(paths: Iterable[str]) -> None:
    """By Hadoop's file systems, as the steps were written."""
    spark = SparkSession.getActiveSession()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        _steps.remove(p)


def drop_step(step: DataFrame) -> None:
    """Deletes a step of materialize() that nothing else reads any more."""
    _delete([step._step])


def drop_steps() -> None:
    """Deletes the steps that this process has written, once no result that reads them is needed."""
    _delete(list(_steps))


@contextmanager
def own_steps():
    """Of the steps written inside, only the last one, the block's result, stays; earlier ones go."""
    before = set(_steps)
    yield
    _delete([p for p in _steps[:-1] if p not in before])


def unused(columns: Iterable[str], name: str) -> str:
    """The name, with as many underscores as it takes to be none of the columns'."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(x: bytes | None) -> str:
    """A text from its bytes, in all operators alike: null is the empty text, and what isn't UTF-8 is U+FFFD."""
    return (x or b"").decode("utf-8", "replace")


def held_out(doc_id: str, parts: int, part: int):
    """crc32 of doc_id as text, modulo parts, equals part. A null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts)) == part


#: Rows of a batch of texts, read and sent to Python, for sessions that keep Spark's own numbers: 4096 and
#: 10,000 long texts are tens of MB a task, in arrays that the heap can only grow for. Both are read when a
#: plan runs, so they are set for the session and stay.
SMALL_BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
}


def small_batches(spark: SparkSession) -> None:
    for name, (default, small) in SMALL_BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, small)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    out: T.StructType,
    start: Callable[[], Callable[..., tuple]],
    part: int = 256,
    beside: tuple[str, ...] = (),
) -> DataFrame:
    """One Arrow pass without a shuffle: the columns `keep`, then those of `out`, computed from
    the whole text, and the columns `beside`, by what start() returns (start runs once a task). A kept
    column whose name `out` also has is replaced; other columns of df are ignored."""
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in out}
    keep = [c for c in keep if c.lower() not in names]
    own = [F.col(f"`{c}`") for c in keep]
    read = keep.index(text_col) if text_col in keep and dict(df.dtypes)[text_col] == "string" else len(keep)
    source = df.select(*own, *([F.col(f"`{text_col}`").cast("string").alias(unused([*keep, *beside], "__text__"))] if read == len(keep) else []), *beside)
    schema = T.StructType([source.schema[c] for c in keep] + list(out))
    added = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for whole in batches:
            for at in range(0, whole.num_rows, part):
                batch = whole.slice(at, part)
                rows = [one(*x) for x in zip(as_bytes(batch.column(read)), *[c.to_pylist() for c in batch.columns[batch.num_columns - len(beside) :]], strict=True)]
                columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *added.names])

    return source.mapInArrow(run, schema)


def scan_texts(df: DataFrame, columns: list[str], out: T.StructType, start: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]], rows: int = 4096) -> DataFrame:
    """One Arrow pass that gives any number of rows: start() returns, once a task, a function from
    the rows of a partition (text columns as UTF-8 bytes) to its result rows."""
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in columns])
    kinds = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                texts = lambda c: pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
                yield from zip(*[as_bytes(c) if texts(c) else c.to_pylist() for c in part.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for row in start()(read(batches)):
            made.append(row)
            if len(made) >= rows:
                yield _as_batch(made, kinds)
                made = []
        if made:
            yield _as_batch(made, kinds)

    return source.mapInArrow(run, out)


def _as_batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], kinds.names)
