from inkgraph.operators import graph


def test_a_task_has_a_bounded_number_of_rows(spark):
    df = spark.createDataFrame([(k % 900, k % 3, None if k % 7 else "x") for k in range(2000)], "a long, b int, c string")
    got = graph.distinct_rows(df, dealt=250)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.distinct().collect()))
    assert got.rdd.getNumPartitions() == 9
    assert graph.distinct_rows(df.limit(0)).count() == 0
