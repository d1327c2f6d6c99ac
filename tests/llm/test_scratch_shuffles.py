"""A written intermediate table leaves no shuffle files behind."""
import time

from pyspark.sql import functions as F

from sward.llm import common as C


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if "shuffle_" in x}


def test_saved_table_takes_its_shuffle_with_it(spark):
    before, own = shuffle_files(spark), spark.conf.get(C.CLEANUP)
    df = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
    scratch = C.Scratch(spark, "t")
    table = scratch.save(df, "counts")
    end = time.monotonic() + 10
    while (left := shuffle_files(spark) - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(C.CLEANUP) == own
    # the same frame can be written again, and what was written is whole
    again = scratch.save(df, "again")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, again.collect())) == sorted((k, len(range(k, 10_000, 97))) for k in range(97))


def test_setting_of_the_session_stays(spark):
    own = spark.conf.get(C.CLEANUP)
    try:
        spark.conf.set(C.CLEANUP, "true")
        C.Scratch(spark, "t").save(spark.range(3), "ids")
        assert spark.conf.get(C.CLEANUP) == "true"
    finally:
        spark.conf.set(C.CLEANUP, own)
