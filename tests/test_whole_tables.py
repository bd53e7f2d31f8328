"""Queries read whole rows: no component or row of their tables is left out."""

from touchline.plans import state


def _rows(out, name):
    return [r[name] for r in out.orderBy("item").collect()]


def test_clusters_use_the_whole_embedding(spark, tmp_path):
    same = [0.5] * 8
    vectors = [(i, 0, [*same, *([0.0] * 55), 1.0 if i % 2 else -1.0]) for i in range(6)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert _rows(state.q_greedy_cluster(spark, str(tmp_path)), "cluster") == [0, 1, 0, 1, 0, 1]
    side = _rows(state.q_two_means(spark, str(tmp_path)), "side")
    assert side[0] != side[1] and side == side[:2] * 3
