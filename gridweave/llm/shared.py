"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, one of our own if all of Spark is one process;
    on a cluster there is then none that driver and executors are known to share, and this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if "/tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Bytes that Spark gathers for a Python worker at once where the session does not say, and rows that a worker takes from that.
BATCH_BYTES, SOME_ROWS = 4 << 20, 256


def small_batches(spark: SparkSession) -> None:
    """Batches of about BATCH_BYTES between Spark and Python workers from now on, if the session has no bound of its own:
    an executor holds several of them, both in the JVM and in each worker, and Spark's own bound is far larger."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, some rows at a time; one without rows gives none."""
    for at in range(0, batch.num_rows, SOME_ROWS):
        yield batch.slice(at, SOME_ROWS)


def values(column: pa.Array) -> Iterator:
    """The column's values, made some at a time."""
    for at in range(0, len(column), SOME_ROWS):
        yield from column.slice(at, SOME_ROWS).to_pylist()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as make them none of the columns'."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def bounded_sample(docs: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows: those whose doc_id has the smallest hashes. For choosing orders, fitting classifiers and the
    like; the bound is the caller's documented parameter."""
    order = F.xxhash64("doc_id")
    least = [r[0] for r in docs.select(order.alias("o")).orderBy("o").limit(n).collect()]
    return docs.where(order <= (least[-1] if least else 0)).limit(n)
