from fenestra import checkpoints


def test_shuffle_files_go_with_their_query(spark):
    checkpoints.cut(spark.range(100).groupBy("id").count())
    assert spark.conf.get(checkpoints.FREED) == "true"
