"""Working folders and written tables."""

import os

import pytest
from pyspark.sql import functions as F

from formloom import session


def test_shared_folders_are_new_and_qualified(spark):
    a, b = session.shared_dir(spark), session.shared_dir(spark)
    assert a != b and a.startswith("file:///") and os.path.isdir(a.removeprefix("file://"))
    assert a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_written_fixes_rows_and_cuts_the_plan(spark):
    df = spark.range(100).withColumn("r", F.rand()).withColumn("p", F.spark_partition_id())
    table = session.written(df)
    assert sorted(table.collect()) == sorted(table.collect()) and [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in df.schema]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "parquet" in plan
    assert session.written(df.where("false")).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_set_batch_size_is_left_alone(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "1m")
        session.importable(spark)
        assert spark.conf.get(setting) == "1m"
        spark.conf.unset(setting)
        session.importable(spark)
        assert spark.conf.get(setting) == session.ARROW_BATCH
    finally:
        spark.conf.set(setting, before)


def test_scratch_tables_last_as_long_as_their_scope(spark):
    import os

    from formloom.session import scratch, written

    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    free = written(spark.range(3))
    with scratch():
        first = written(spark.range(3))
        with scratch():
            inner, kept = written(spark.range(3)), written(spark.range(4), outer=True)
            names = [x.inputFiles()[0] for x in (inner, first)]
        assert not os.path.exists(names[0].removeprefix("file://")) and there(kept) and there(first) and kept.count() == 4
        final = written(spark.range(5), outer=True)
    assert not os.path.exists(names[1].removeprefix("file://")) and there(final) and there(free) and free.count() == 3
