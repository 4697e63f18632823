"""What the operators of this package share: tables, Arrow batches, scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that a Python function handles at once; bounds a worker's memory whatever Arrow delivers.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input, read by Spark's own reader."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from another folder import this package (on a cluster, ship it with --py-files)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new local one, but only if the executors are this machine's too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shardloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read back (this cuts lineage and survives lost executors), and its path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that is no longer needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow for functions over plain columns: fn gets an iterator of {column: values} and yields the same."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(batches):
        for cols in fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in target for x in [cols[f.name]]], schema=target)

    return df.mapInArrow(run, out)


def pieces(cols: dict[str, list], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[dict[str, list]]:
    """cols in runs of rows with at most about `most` characters of text (one row at least)."""
    begin = held = 0
    values = cols[text]
    for i, t in enumerate(values):
        n = len(t) if t else 0
        if held and held + n > most:
            yield {k: v[begin:i] for k, v in cols.items()}
            begin, held = i, 0
        held += n
    if begin < len(values):
        yield {k: v[begin:] for k, v in cols.items()}


def id_bucket(col: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, mod n: the folds of the contracts. Null ids fall in bucket 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def id_bucket_py(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n
