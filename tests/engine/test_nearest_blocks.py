from groundwork.operators import vector


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, i % 2, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, collection int, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, float(i), -2.0]) for i in range(23)], "query_id int, query_vector array<double>")
    whole = sorted(map(str, vector.nearest(queries, vectors).collect()))
    monkeypatch.setattr(vector, "MAX_QUERIES", 5)
    assert sorted(map(str, vector.nearest(queries, vectors).collect())) == whole and len(whole) == 23 * 2 * 3
