from ledgerlens.functions.batches import spread


def test_scans_of_few_files_are_spread(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    one = spark.read.parquet(f"{sf}/orders.parquet").coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).exceptAll(one).isEmpty() and spread(one).count() == one.count()
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many
