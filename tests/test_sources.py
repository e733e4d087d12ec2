import pytest
from pyspark.sql import functions as F

from skarn.sources import files


def test_csv_with_and_without_schema(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,when,x\n1,2020-01-02,0.5\n2,2020-01-03,\n")
    inferred = files.read_csv(spark, str(path))
    assert dict(inferred.dtypes)["x"] == "double" and inferred.count() == 2
    declared = files.read_csv(spark, str(path), "id long, when string, x double")
    assert declared.dtypes == [("id", "bigint"), ("when", "string"), ("x", "double")]
    assert [r["x"] for r in declared.orderBy("id").collect()] == [0.5, None]


def test_quoted_csv_keeps_commas_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Id,Score,Text\n2,5,"good, ""really""\nsecond line"\n1,1,plain\n3,3,last\n')
    schema = "Id long, Score int, Text string"
    rows = files.read_quoted_csv(spark, str(path), schema).orderBy("Id").collect()
    assert [r["Text"] for r in rows] == ["plain", 'good, "really"\nsecond line', "last"]
    assert [r["Id"] for r in files.read_quoted_csv(spark, str(path), schema, key="Id", n_rows=2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        files.read_quoted_csv(spark, str(path), schema, n_rows=2)


def test_land_and_read_back(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    files.land_parquet(df, str(tmp_path / "t"), partition_by=["p"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 10 and back.where("p = 1").count() == 5


def test_literal_table_quotes_text(spark):
    rows = files.literal_table(spark, {"t": "string", "v": "double"}, [("it's \\ x", 1.5), (None, -2.0)]).collect()
    assert [tuple(r) for r in rows] == [("it's \\ x", 1.5), (None, -2.0)]


def test_literal_table_is_broadcast_by_its_size(spark):
    small = files.literal_table(spark, {"id": "long"}, [(1,), (2,)])
    plan = spark.range(1000).join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_stored_uses_the_shared_folder(spark):
    df = files.stored(spark.range(5))
    assert df.count() == 5
    assert df.inputFiles()[0].startswith(f"file://{spark.conf.get('spark.checkpoint.dir')}/skarn-")


def test_spread_does_what_the_caller_asks(spark):
    wide = spark.range(100, numPartitions=64)
    assert files.spread(wide, "id") is wide
    spark.conf.set("skarn.inputPartitions", "5")
    try:
        assert files.spread(wide, "id").rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("skarn.inputPartitions")


def test_stored_tables_end_with_their_block(spark):
    import os

    from skarn.sources import files

    def folders():
        return {f for f in os.listdir(files.shared_dir(spark).removeprefix("file://")) if f.startswith("skarn-")}

    before = folders()
    with files.temporary(spark):
        outer = files.stored(spark.range(3))
        with pytest.raises(RuntimeError), files.temporary(spark):
            files.stored(spark.range(5))
            raise RuntimeError
        assert outer.count() == 3 and len(folders() - before) == 1
    assert folders() == before
    kept = files.stored(spark.range(2))
    assert kept.count() == 2 and len(folders() - before) == 1
