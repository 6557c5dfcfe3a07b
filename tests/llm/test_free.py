import os
import time

from evidentia.llm.common import drop_staged, free, staged


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for d in dirs for _, _, names in os.walk(d.getPath()) for name in names if name.startswith("shuffle_")}


def test_shuffle_files_of_the_plan_that_ended_last_go(spark):
    before = shuffle_files(spark)
    out = staged(spark.range(1000).repartition(7), "numbers")
    mine = shuffle_files(spark) - before
    assert mine
    free(spark)
    for _ in range(50):
        if not mine & shuffle_files(spark):
            break
        time.sleep(0.1)
    assert not mine & shuffle_files(spark)
    assert out.count() == 1000
    drop_staged(out)
