"""Rows keep their identity however scans are split: the same rows with 3, 4 and 16 splits, and with the count changed between the scans."""

import pytest
from pyspark.sql import functions as F

from tablescape.llm import decontamination, mixing, simhash
from tablescape.llm.common import identified

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture(scope="module")
def many(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("many") / "docs")
    more = docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" only here "), "doc_id")).otherwise(F.col("text")))
    more.repartition(13).write.parquet(at)
    return at


@pytest.fixture
def split(spark):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set(SPLITS, n)
    spark.conf.unset(SPLITS)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def stages(spark):
    bench = spark.createDataFrame([(1, "only here"), (2, "nothing of this")], "item_id bigint, text string")
    return {"near": simhash.keep_first, "clean": lambda d: decontamination.clean_documents(d, bench), "mixed": mixing.mixed_documents}


@pytest.mark.parametrize("name", ["near", "clean", "mixed"])
def test_stages_do_not_hang_on_splits(spark, many, split, name):
    step, seen = stages(spark)[name], []
    for first, second in ((3, 3), (4, 4), (16, 16), (4, 3), (3, 16), (16, 4)):
        split(first)
        out = step(spark.read.parquet(many))
        split(second)
        seen.append(sorted(map(str, out.collect())))
    assert len(seen[0]) > 20 and all(s == seen[0] for s in seen)


def test_identity_is_of_the_row(spark, many, docs, split):
    for df in (spark.read.parquet(many), docs, spark.read.parquet(many).withColumn("_metadata", F.lit(1)), spark.read.parquet(many).withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))):
        rows = identified(df, "tag")
        assert rows.select("tag").distinct().count() == df.count() and rows.columns == [*df.columns, "tag"]
    split(3)
    a = identified(spark.read.parquet(many), "tag").select("tag.*", "text").collect()
    split(16)
    assert sorted(map(str, identified(spark.read.parquet(many), "tag").select("tag.*", "text").collect())) == sorted(map(str, a))


def test_mix_hangs_on_rows_alone(spark, docs):
    more = docs.unionByName(docs.where("doc_id % 3 = 0"))
    seen = [sorted(map(str, mixing.mix(more.repartition(n), block=8).collect())) for n in (1, 4, 16)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == more.count()
