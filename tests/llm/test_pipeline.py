"""The pipeline against its stages' brute force, and the registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from shardloom.llm import byte_bpe, pii, quality_rules
from tests.llm.test_operators import brute_components, brute_contaminated, brute_print

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = {i: t for i, t in docs.items() if quality_rules.rejected_by(quality_rules.Text(t), quality_rules.RULES) is None}
    ids = sorted(stage)
    root = brute_components(ids, [brute_print(stage[i]) for i in ids])
    stage = {i: stage[i] for i in ids if root[i] == i}
    hit = brute_contaminated(list(stage.values()), items)
    stage = {i: t for (i, t), h in zip(stage.items(), hit) if not h[-1]}
    found = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == set(stage)
    c = byte_bpe.codec(byte_bpe_file(), corpus_pipeline.public_tokenizers.PATTERN)
    clean = [i for i, t in stage.items() if not pii._ANY.search(t or "")]
    assert clean and all(found[i] == len(c.encode(stage[i])) for i in clean)


def byte_bpe_file():
    return corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op3_decontaminate", "op10_quality_rules"])
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a = __spark_entry__.queries()[name](spark, SF).toPandas()
    b = con.sql(__spark_entry__.oracle_sql()[name]).df()
    key = lambda x: x[sorted(x)].sort_values(sorted(x)).reset_index(drop=True)
    assert key(a).equals(key(b))
