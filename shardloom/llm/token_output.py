"""Token-id output: texts to ids with the tokenizers library, ids to files of range-coded blocks, and back.

write() makes a folder with one Parquet table. Its rows are segments, each of whole documents in ascending order of
id (ties by the texts' hash, then by the texts): the documents' ids and sizes, and the segment's ids in blocks with
their sizes and checksums (range_coder). Segments are numbered by part and place, parts are ranges of the document
ids, so (part, place) is the order of all documents; each segment holds the number of ids of its part before it. Spark
commits the files, so a lost executor only repeats its tasks, and ranges are cut on the pair (id, hash), so no id,
however often it repeats, must fit one task. A segment grows to SEGMENT ids and then ends with its document; texts are
never cut.

read() decodes the segments on the JVM and holds every block against its checksum. It gives each document its start,
the number of ids of all documents before it; that takes the totals of the parts, one row for each file.

Null and empty texts have only the end id. Null ids come first. Repeated rows are documents of their own. Other columns
are not looked at, whatever their names. A table without rows makes files without segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shardloom.llm import range_coder
from shardloom.llm.common import importable, scratch
from shardloom.llm.words import Words

END_ID = 1
SEGMENT = range_coder.BLOCK * 16
_ROWS = 512
_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path, END_ID)
    return _WORDS[path]


def write(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of df's texts to a new folder."""
    spark = df.sparkSession
    importable(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), F.asc("tie")).sortWithinPartitions(F.asc_nulls_first("id"), "tie", "text")
    kind = df.schema[id_col].dataType.simpleString()
    segment = f"place int, before bigint, bits int, docs array<{kind}>, sizes array<bigint>, n_ids bigint, ids binary"
    schema = spark.createDataFrame([], segment).schema
    target = to_arrow_schema(schema)

    def run(batches):
        w = words(tokenizer)
        place = before = held = 0
        docs, sizes, ids = [], [], []

        def done() -> pa.RecordBatch:
            row = [place, before, w.bits, pa.concat_arrays(docs).to_pylist(), np.concatenate(sizes).tolist(), held, np.concatenate(ids).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, target)], schema=target)

        for b in batches:
            for k, n, some, many in _runs(b, w):
                # Documents up to the one that fills the segment, again and again.
                ends, at, used = np.cumsum(many), 0, 0
                while at < n:
                    last = min(int(np.searchsorted(ends, used + SEGMENT - held)), n - 1)
                    docs.append(b.column(0).slice(k + at, last + 1 - at))
                    sizes.append(many[at : last + 1])
                    ids.append(some[used : ends[last]])
                    held, used, at = held + int(ends[last]) - used, int(ends[last]), last + 1
                    if held >= SEGMENT:
                        yield done()
                        place, before, held = place + 1, before + held, 0
                        docs, sizes, ids = [], [], []
        if docs:
            yield done()

    rows = ordered.select("id", "text").mapInArrow(run, schema)
    coded = rows.select("place", "before", "bits", "docs", "sizes", "n_ids", range_coder.blocks(spark, F.col("ids"), F.col("bits")).alias("blocks"))
    coded.withColumn("part", F.spark_partition_id()).write.option("parquet.block.size", 8 << 20).option("compression", "none").parquet(path)


def _runs(batch: pa.RecordBatch, w: Words):
    """(first row, rows, ids, their number by row) for runs of rows, so that few ids are held at once."""
    for k in range(0, batch.num_rows, _ROWS):
        some = batch.column(1).slice(k, _ROWS)
        yield k, len(some), *w.encode_arrow(some)


def _documents(spark, path: str, give_ids: bool) -> DataFrame:
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each file of segments: few, so one task and a broadcast do.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    found = range_coder.documents(spark, F.col("blocks"), F.col("bits"), F.col("sizes"), give_ids)
    each = rows.select("part", "before", F.arrays_zip("docs", found.alias("facts")).alias("all"))
    each = each.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("first"), F.explode("all").alias("one"))
    start = F.col("first") + F.col("one.facts.begin")
    return each.select(F.col("one.docs").alias("id"), start.alias("start"), *(F.col(f"one.facts.{c}").alias(c) for c in ("n_tokens", "ids_crc32", "ids")))


def read(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files; ids are decoded and checked."""
    return _documents(spark, path, False).drop("ids")


def read_ids(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids array<int>) of every document in the files."""
    return _documents(spark, path, True).drop("ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) as read back from files of df's texts."""
    path = scratch(df.sparkSession, "token-files")
    write(df, tokenizer, path, id_col, text_col)
    return read(df.sparkSession, path).withColumnRenamed("id", id_col)
