"""An adaptive context-mixing range coder for token ids: java/TokenBlocks.java, run by the executors' JVMs.

Ids are coded in blocks of BLOCK ids. Every block starts from the same fresh model and has its own checksum, so any
block decodes alone. Order 2 foretells an id from the two ids before (hashed), order 1 from the id before, each with a
confidence; order 0 counts all ids of the block so far. A logistic mixer, trained as it goes, joins what the three
orders say of the foretold id into the probability that it is right. If it isn't, the id is coded by the order-0
intervals of such ids, brought up to date at fixed places of the block, or spelled out if it has none yet. Nothing that
files depend on differs between machines.

A column of blocks holds, for each block, its number of ids, the crc32 of the ids as little-endian unsigned 32-bit
integers, the payload's size (4 bytes each, little-endian) and the payload.

The source is compiled by Janino, the compiler that Spark has for its own generated code, and reaches the executors as
a jar in the shared folder, so new executors get it too. A model that steps from id to id is over ten times faster
there than in numpy, which would have to step many blocks side by side.

Null ids or blocks have no result; no ids have no blocks.
"""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import _to_java_column, _to_seq
from pyspark.sql.types import DataType

from shardloom.llm.common import scratch

BLOCK = 1 << 16
_SOURCE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "java", "TokenBlocks.java")
_NAME = "shardloom.llm.TokenBlocks"
_LOADERS: dict[str, object] = {}


def _loader(spark: SparkSession):
    """The class loader of the compiled source, whose jar is sent to the executors once for an application."""
    app = spark.sparkContext.applicationId
    if app not in _LOADERS:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        with open(_SOURCE, encoding="utf-8") as f:
            compiler.cook(f.read())
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for one in compiler.getBytecodes().entrySet():
                z.writestr(one.getKey().replace(".", "/") + ".class", bytes(one.getValue()))
        path = jvm.org.apache.hadoop.fs.Path(scratch(spark, "token-blocks") + ".jar")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(path)
        out.write(bytearray(jar.getvalue()))
        out.close()
        spark.sparkContext._jsc.sc().addJar(fs.makeQualified(path).toString())
        _LOADERS[app] = compiler.getClassLoader()
    return _LOADERS[app]


def _column(spark: SparkSession, name: str, kind: str, *args: Column) -> Column:
    made = _loader(spark).loadClass(f"{_NAME}${name}").newInstance()
    returns = spark._jsparkSession.parseDataType(DataType.fromDDL(kind).json())
    # Not "deterministic", so that the optimizer never calls it twice for a row.
    function = made.function(returns).asNondeterministic()
    return Column(function.apply(_to_seq(spark.sparkContext, args, _to_java_column)))


def blocks(spark: SparkSession, ids: Column, bits: Column) -> Column:
    """The blocks of ids: a binary of 16-bit, or for more than 16 bits an id 32-bit, little-endian integers."""
    return F.when(ids.isNotNull(), _column(spark, "Writer", "binary", ids, bits))


def documents(spark: SparkSession, coded: Column, bits: Column, sizes: Column, give_ids: bool = False) -> Column:
    """For each of the documents whose ids make up the blocks, of these sizes: where it begins, its size, crc32 and ids.

    Every block is held against its checksum.
    """
    return _column(spark, "Reader", "array<struct<begin:bigint,n_tokens:bigint,ids_crc32:bigint,ids:array<int>>>", coded, bits, sizes, F.lit(give_ids))
