"""The corpus pipeline: every stage on awkward rows, and the registered queries next to their SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from assetpulse.llm.queries import ORACLES, QUERIES

from .util import corpus, empty, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from compare import duck

    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    from compare import differences

    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, corpus()[7][1])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("k", range(5))
def test_stage_takes_awkward_rows(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    df = frame(spark)
    out = stage(spark, df, folder)
    assert out.columns[: len(df.columns)] == df.columns or name == "sharding"
    left = {(r.doc_id, r.text) for r in out.collect()}
    assert left and left <= {(r.doc_id, r.text) for r in df.collect()}
    gone = {r.doc_id for r in df.collect()} - {i for i, _ in left}
    clean = set(range(60)) - {7, 0}
    if name in ("language_id", "simhash_dedup", "decontamination", "sharding"):
        assert not gone & clean
    if name == "decontamination":
        assert 7 in gone
    assert stage(spark, empty(spark), folder).count() == 0


def test_run_keeps_one_clean_copy(spark, folder):
    frame(spark, clash=False).drop("extra").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 7 not in ids and not ids & {61, 64, 65, 66}
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
