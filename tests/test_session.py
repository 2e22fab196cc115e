import os

from sparkloom.session import clear_scratch, scratch_dir, stored


def test_scratch_is_one_folder_that_can_be_cleared(spark):
    spark = spark.newSession()
    kept = spark.conf.get("spark.checkpoint.dir", None)
    a, b = scratch_dir(spark), scratch_dir(spark)
    assert a != b and a.rpartition("/")[0] == b.rpartition("/")[0]
    if kept is None:  # else other tests' tables are in it
        assert stored(spark.range(3)).count() == 3
        top = a.rpartition("/")[0].removeprefix("file://")
        assert os.path.isdir(top)
        clear_scratch(spark)
        assert not os.path.isdir(top)


def test_shuffle_files_go_with_their_query(spark):
    import time

    from sparkloom.session import shuffles_removed, stored

    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        names = manager.getAllFiles()
        return {names.apply(i).getName() for i in range(names.size()) if names.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, old = spark.conf.get(key), files()
    with shuffles_removed(spark):
        out = stored(spark.range(1000).selectExpr("id % 7 k").repartition(5, "k").groupBy("k").count())
        assert out.count() == 7
    until = time.time() + 10
    while files() - old and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not files() - old and spark.conf.get(key) == setting
