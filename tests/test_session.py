import os
import time

from pyspark.sql import functions as F

from shrinkwise.session import SHUFFLE_CLEANUP, clear_tables, new_shared_path, saved_table


def test_tables_of_an_application_can_be_removed(spark):
    table = saved_table(spark.range(5), "five")
    folder = os.path.dirname(new_shared_path(spark, "any")).removeprefix("file:")
    assert table.count() == 5 and os.listdir(folder)
    other = os.path.join(os.path.dirname(folder), "other-application")
    os.makedirs(other)
    clear_tables(spark)
    assert not os.path.exists(folder) and os.path.exists(other)
    assert saved_table(spark.range(2), "two").count() == 2


def test_a_saved_table_leaves_no_shuffle_files(spark):
    def shuffle_files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(blocks.size()) if (name := blocks.apply(k).getName()).startswith("shuffle_")}

    before, setting = shuffle_files(), spark.conf.get(SHUFFLE_CLEANUP)
    table = saved_table(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):  # Spark removes them in the background.
        if not shuffle_files() - before:
            break
        time.sleep(0.1)
    assert not shuffle_files() - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting and table.count() == 7
